import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import relational, spans
from framewright.plans import q_prep, registry
from framewright.prep import blending, chats, packing, retrieval, sampling, tokens


def test_knapsack():
    assert packing.knapsack([3, 2, 4, 1], 5) == [[2, 3], [0, 1]]
    assert packing.knapsack([3, 3, 2, 2, 1, 1, 1, 1], 5) == [[0, 2], [1, 3], [4, 5, 6, 7]]
    assert packing.knapsack([], 5) == [] and packing.knapsack([9], 5) == []


def test_packed_sample(spark):
    t = spark.createDataFrame([(1, [7, 8, 9], [1, 1, 1]), (2, [5, 6], [2, 2]), (3, [1] * 9, [0] * 9)], "id int, input_ids array<int>, labels array<int>").withColumn("n", F.size("input_ids"))
    r = packing.packed_samples(t, packing.pack(t, "id", "n", 8), "id", 8).collect()
    assert len(r) == 1 and r[0].attention_mask == [1, 1, 1, 2, 2, 0, 0, 0] and r[0].position_ids == [0, 1, 2, 0, 1, 0, 0, 0] and r[0].labels == [1, 1, 1, 2, 2, -100, -100, -100]
    o = packing.ordered_samples(t, packing.pack_in_order(t, "id", "n", 8, "id", multiple=2), "id", 8, multiple=2).collect()
    assert len(o) == 1 and o[0].seq_lens == [3, 2] and o[0].seq_lens_padded == [4, 4] and o[0].input_ids == [7, 8, 9, 0, 5, 6, 0, 0] and o[0].position_ids == [0, 1, 2, 3, 0, 1, 2, 3]
    with pytest.raises(Exception, match="longer than a pack"):
        packing.pack(t, "id", "n", 8, too_long="error").collect()
    b = packing.stacked(packing.ordered_samples(t, packing.pack_in_order(t, "id", "n", 4, "id"), "id", 4).withColumn("batch", F.lit(0)), ["batch"]).collect()[0]
    assert len(b.input_ids) == 2 and all(len(x) == 1 for x in b.seq_lens)


def test_blends(spark):
    who, place = blending.blend_order([0.7, 0.3], 10)
    assert who.tolist() == [0, 1, 0, 0, 1, 0, 0, 1, 0, 0] and place.tolist()[:3] == [0, 0, 1]
    who, _ = blending.exhaustive_order([3, 0, 2])
    assert sorted(who.tolist()) == [0, 0, 0, 2, 2]
    assert blending.split_bounds(blending.split_shares("99,1")) == [(0, 0.99), (0.99, 1.0), None]
    assert blending.read_blend('{"val": ["a"]}') == {"validation": ["a"]} and blending.zipped(["30", "a", "70", "b"]) == [(30.0, "a"), (70.0, "b")]
    assert blending.blend_sizes([1, 3], [10], 0.5) == [[5], [12]]
    d = spark.createDataFrame([(0, 5), (1, 0), (2, 7), (3, 1)], "doc int, n int")
    got = [tuple(r) for r in blending.sample_index(d, "doc", "n", 4).orderBy("sample").collect()]
    flat = [(k, i) for k, n in ((0, 5), (2, 7), (3, 1)) for i in range(n)]
    assert got == [(s, *flat[s * 4]) for s in range((13 - 1) // 4 + 1)]


def test_windows():
    t = np.array([1, 5, 5, 1, 5, 1, 5, 5, 5, 5])
    assert blending.aligned_windows(t, 2, 1) == [(0, 3), (3, 6), (5, 8)]
    p = blending.sentence_pairs([5, 5, 5, 5, 5], [0, 5], 10, short_share=0)
    assert sorted(x[:2] for x in p) == [(0, 2), (2, 5)]
    assert sampling.worker_ranges(10, 4) == [(0, 2), (2, 4), (4, 6), (6, 10)]


def test_samplers(spark):
    d = spark.range(103).withColumn("n", F.col("id") % 13).withColumn("g", F.when(F.col("id") < 100, "a").otherwise("b"))
    a = [r.id for r in sampling.shuffled(d, "id", 1).orderBy("position").collect()]
    assert sorted(a) == list(range(103)) and a != sorted(a)
    r = sampling.repeated(d, 3, "id", 1)
    assert r.count() == 309 and r.where("epoch = 1").agg(F.min("position")).collect()[0][0] == 103
    b = sampling.bucket_batches(d, "id", "g", F.lit(2), 4, 1, drop_last=False)
    assert b.where("g = 'b'").count() == 4 and b.groupBy("replica").count().select("count").distinct().count() == 1
    parts = sampling.rank_parts(d, ["id"], 10).groupBy("part").count().orderBy("part").collect()
    assert [x["count"] for x in parts] == [11] * 3 + [10] * 7
    assert sampling.cover_frames({1: {"a"}, 5: {"a", "b"}, 9: {"c"}}, 5, 2) == [5, 9]
    t = spark.createDataFrame([(1, [1, 2, 3, 4] * 5, [1] * 20)], "id int, ids array<int>, m array<int>")
    c = sampling.corrupt_blocks(t, "id", "ids", "m", 99, 1, 5).collect()[0]
    assert [x == 99 for x in c.noisy_ids] == c.noise_mask
    k = sampling.keyframes(spark.range(60).withColumn("v", F.lit("x")).withColumn("f", (F.col("id") % 7).cast("double")), ["v"], "id", ["f"], max_gap=20)
    assert 4 <= k.count() <= 12
    assert [r.token for r in sampling.vocabulary(t, "ids", "m", 10, 5, (9, 9)).orderBy("place").collect()] == [9, 1, 2, 3, 4]


def test_ordinal_and_choice(spark):
    d = spark.range(50).withColumn("x", -F.col("id"))
    assert [(r.id, r["__ord"]) for r in relational.ordinal(d, ["x"]).orderBy("id").collect()] == [(i, 49 - i) for i in range(50)]
    assert relational.ordinal(d.limit(0), ["x"]).count() == 0
    s = spark.createDataFrame([(0, 0.1), (15, 0.5), (30, 0.5), (60, 0.2)], "f int, p double")
    got = [(r.s, r.e, r.n, r.peak_frame) for r in spans.sessions(s.withColumn("k", F.lit(1)), ["k"], "f", "p", 15).orderBy("s").collect()]
    assert got == [(0, 30, 3, 15), (60, 60, 1, 60)]
    one = spark.range(1).select(spans.merged(F.array(*[F.struct(F.lit(a).cast("long").alias("s"), F.lit(b).cast("long").alias("e")) for a, b in ((1, 4), (5, 6), (9, 10), (2, 3))])).alias("m"), spans.downsample(F.array(*[F.struct(F.lit(i).alias("s"), F.lit(i + 1).alias("e")) for i in range(10)]), 4).alias("d")).collect()[0]
    assert [tuple(x) for x in one.m] == [(1, 6), (9, 10)] and [tuple(x) for x in one.d] == [(0, 1), (1, 2), (6, 7), (9, 10)] or [tuple(x) for x in one.d] == [(0, 1), (1, 2), (5, 6), (9, 10)]


def test_overlap_join_counts_once(spark):
    r = random.Random(1)
    a = [(i, s := r.randint(0, 90), s + r.randint(0, 40)) for i in range(40)]
    b = [(i, s := r.randint(0, 90), s + r.randint(0, 40)) for i in range(40)]
    x = spark.createDataFrame(a, "a int, s int, e int").withColumn("k", F.lit(1))
    y = spark.createDataFrame(b, "b int, s2 int, e2 int").withColumn("k", F.lit(1))
    for width in (1, 7, 1000):
        got = sorted((q.a, q.b) for q in spans.overlap_join(x, y, ["k"], width).collect())
        assert got == sorted((i, j) for i, s, e in a for j, t, u in b if s <= u and t <= e)


def test_overlap_join_with_long_spans(spark, monkeypatch):
    """Spans of one bin to a whole day of frames; no row is dealt into more bins than its level allows."""
    r = random.Random(2)
    size = lambda: r.choice([0, 3, 40, 300, 5000, 90000])
    a = [(i, s := r.randint(0, 90000), s + size()) for i in range(50)]
    b = [(i, s := r.randint(0, 90000), s + size()) for i in range(50)]
    x, y = spark.createDataFrame(a, "a int, s int, e int").withColumn("k", F.lit(1)), spark.createDataFrame(b, "b int, s2 int, e2 int").withColumn("k", F.lit(1))
    for most in (64, 4):
        monkeypatch.setattr(spans, "MOST_BINS", most)
        got = sorted((q.a, q.b) for q in spans.overlap_join(x, y, ["k"], 2).collect())
        assert got == sorted((i, j) for i, s, e in a for j, t, u in b if s <= u and t <= e)


AGENT = [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "let me", "reasoning_content": "hm"}, {"role": "tool_call", "content": '{"name": "f", "arguments": {"x": 1}}'}, {"role": "tool_call", "content": '{"name": "g"}'}, {"role": "tool_response", "content": "1"}, {"role": "tool_response", "content": "2"}, {"role": "assistant", "content": "done", "reasoning_content": "ok"}]


def test_agent_messages(spark):
    m = chats.agent_messages(AGENT, 7, True)
    assert [x["role"] for x in m] == ["user", "assistant", "tool", "tool", "assistant"]
    assert [c["id"] for c in m[1]["tool_calls"]] == ["call_7_0", "call_7_1"] == [x["tool_call_id"] for x in m[2:4]]
    assert "reasoning_content" not in m[1] and m[4]["reasoning_content"] == "ok"
    df = spark.createDataFrame([(7, json.dumps(AGENT)), (8, json.dumps([{"role": "user", "content": "x"}]))], "id long, messages string")
    p = chats.agent_positions(df, "id").collect()
    assert len(p) == 1 and json.loads(p[0].gt_tool_calls)[0] == {"name": "f", "arguments": {"x": 1}} and len(json.loads(p[0].prompt_messages)) == 1
    # the same as share-style turns
    who = {"user": "human", "assistant": "gpt", "tool_call": "function_call", "tool_response": "observation"}
    turns = json.dumps([{"from": who[m["role"]], "value": m["content"]} | {k: m[k] for k in ("reasoning_content",) if k in m} for m in AGENT])
    q = chats.agent_positions(spark.createDataFrame([(7, turns)], "id long, conversations string"), "id", None, None, "conversations").collect()
    assert [tuple(r) for r in q] == [tuple(r) for r in p]
    thoughts = chats.agent_messages(chats.messages_of({"conversations": turns}, chats.AGENT_ROLES), 7)
    assert [m.get("reasoning_content") for m in thoughts if m["role"] == "assistant"] == ["hm", "ok"]
    n = {r.id: r for r in chats.normalised(spark.createDataFrame([(1, '[{"role": "assistant", "content": [{"text": "a"}, {"text": "b"}], "tool_calls": [{"function": {"name": "f", "arguments": {}}}]}]'), (2, '[{"role": "boss"}]'), (3, None), (4, "{")], "id long, messages string"), "id").collect()}
    got = json.loads(n[1].messages)[0]
    assert got["content"] == "a b" and got["tool_calls"][0]["id"] == "call_0" and "boss" in n[2].error and n[3].error and n[4].error


@pytest.mark.parametrize("text,names", [
    ('<tool_call>{"name": "f", "arguments": {"a": {"b": 1}}}</tool_call>', ["f"]),
    ('<|python_tag|>{"name": "f", "parameters": {"a": "}"}}<|eom_id|>', ["f"]),
    ('[TOOL_CALLS][{"name": "f", "arguments": "{}"}, {"name": "g", "arguments": {}}]', ["f", "g"]),
    ('<|channel|>commentary to=functions.f <|message|>{"a": 1}', ["f"]),
    ('text {"name": "f", "arguments": {}} more {"x": 1}', ["f"]),
    ("<tool_call>{bad</tool_call>", [None]),
    ("nothing", []),
])
def test_tool_calls(text, names):
    assert [c["name"] for c in chats.tool_calls(text)] == names


def test_call_scores(spark):
    s = chats.call_scores(chats.tool_calls('{"name": "f", "arguments": {"a": 1, "b": 2}}'), [{"name": "f", "arguments": {"a": 1}}, {"name": "g", "arguments": {}}])
    assert s == {"has_call": 0.5, "name_correct": 0.5, "args_json_valid": 0.5, "args_field_recall": 0.5, "args_field_precision": 0.25, "args_exact_match": 0.0}
    df = spark.createDataFrame([(1, '{"name": "f", "arguments": {}}', '[{"name": "f", "arguments": {}}]'), (2, None, "[]")], "id int, a string, t string")
    assert chats.call_means(chats.score_calls(df, "id", "a", "t")).collect()[0].args_exact_match == 0.5
    sch = chats.tool_schema([{"name": "f", "parameters": {"x": {"type": "int"}, "y": {"type": "str", "default": 1}}}, {}])
    assert sch[0]["function"]["parameters"]["required"] == ["x"] and len(sch) == 1
    assert chats.tagged({"b": [1, 2], "a": "x"}) == "<s_b>1<sep/>2</s_b><s_a>x</s_a>"


def test_tokens(spark):
    assert tokens.last_turn([1, 1, -100, 2, 2, -100]) == [-100, -100, -100, 2, 2, -100]
    tok = lambda t: [ord(c) for c in t]
    p = tokens.prompt_completion("ab", "c", tok, 0, 9, None, 6)
    assert p == {"input_ids": [97, 98, 99, 9, 9, 9], "labels": [-100, 99, 0, -100, -100, -100], "attention_mask": [1, 1, 1, 0, 0, 0]}
    c = tokens.chat_sample([{"role": "user", "content": "u"}, {"role": "assistant", "content": "x"}], lambda m: "".join(x["content"] for x in m), tok, 0)
    assert c["labels"] == [ord("x")]
    df = spark.createDataFrame([(1, "q", "a"), (2, "q", " ")], "id int, q string, a string")
    assert [r.id for r in tokens.instruction_samples(df, "id", None, "q", "a", lambda: lambda t: [ord(c) for c in t], 0, 9).collect()] == [1]
    assert tokens.token_counts(df, "id", "q", lambda: lambda t: [len(w) for w in t.split()]).count() == 2


def test_retrieval_rows(spark):
    q = spark.createDataFrame([("q", "who", "c", [("a",), ("b",)], [("n",)])], "question_id string, question string, corpus_id string, pos_doc array<struct<id: string>>, neg_doc array<struct<id: string>>")
    c = spark.createDataFrame([("c", x, f"text {x}") for x in "abn"], "corpus_id string, id string, text string")
    assert [retrieval.training_rows(q, c, 2, e).collect()[0].doc_id for e in (0, 1, 2)] == [["a", "n", "n"], ["b", "n", "n"], ["a", "n", "n"]]
    with pytest.raises(Exception, match="unknown document"):
        retrieval.training_rows(q, c.where("id <> 'n'"), 1).collect()
    r = retrieval.training_rows(q, c, 1)
    a, b = retrieval.encoder_sides(r, "Q: ", "P: ")
    assert a.collect()[0].text == "Q: who" and sorted(x.text for x in b.collect()) == ["P: text a", "P: text n"]
    assert retrieval.pair_texts(r).count() == 2 and retrieval.corpus_conflicts(spark.createDataFrame([("c", "x"), ("c", "y"), ("d", "z")], "corpus_id string, path string")).count() == 1


def test_truncation(spark):
    rows = [(1, 0, "system", 2), (1, 1, "user", 3), (1, 2, "assistant", 3), (1, 3, "user", 3), (1, 4, "assistant", 3)]
    d = spark.createDataFrame(rows, "c int, t int, role string, n int")
    kept = lambda budget: [r.t for r in chats.truncated(d, "c", "t", "role", F.col("n"), budget).where("kept").orderBy("t").collect()]
    assert kept(14) == [0, 1, 2, 3, 4] and kept(8) == [0, 3, 4] and kept(1) == [0, 3, 4]


def _documents(spark, path, lengths):
    """doc_id and texts of such lengths, with letters beyond ASCII in them."""
    letters = "ab é字😀z\n"
    texts = {k: "".join(letters[(k + i * i) % len(letters)] for i in range(n)) for k, n in enumerate(lengths)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return texts


def test_packed_samples_query_keeps_whole_texts(spark, tmp_path):
    texts = _documents(spark, tmp_path, [5, 399, 400, 401, 1023, 1024, 1025, 2600, 700, 30, 30, 1, 0, 2599, 90])
    ids = spark.createDataFrame([(k,) for k in texts], "doc_id long")
    shard = {r.doc_id: r.s for r in ids.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("s")).collect()}
    want, size = [], max(map(len, texts.values()))
    for s in set(shard.values()):
        bins = []
        for k in sorted((k for k in texts if shard[k] == s), key=lambda k: (-len(texts[k]), k)):
            least = min(bins, key=lambda b: sum(len(texts[x]) for x in b), default=None)
            if least is None or sum(len(texts[x]) for x in least) + len(texts[k]) > size:
                bins.append(least := [])
            least.append(k)
        want += [(s, i, size, max([j + 1 for j, k in enumerate(b) if texts[k]], default=0), max(max(len(texts[k]) - 1, 0) for k in b)) for i, b in enumerate(bins)]
    got = registry.queries()["packed_samples"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    t = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("n", F.length("text"))
    s = packing.packed_samples(t, packing.pack(t, "doc_id", "n", size), "doc_id", size, ids="text", tokenize=q_prep.char_ids).collect()
    kept = sorted("".join(chr(c) for c, m in zip(r.input_ids, r.attention_mask) if m == k) for r in s for k in range(1, max(r.attention_mask) + 1))
    assert kept == sorted(x for x in texts.values() if x) and all(r.labels == [i if m else -100 for i, m in zip(r.input_ids, r.attention_mask)] for r in s)


@pytest.mark.parametrize("name", ["pack_sequential", "pack_knapsack"])
def test_packs_of_the_table_against_a_fold(spark, name):
    """Shards as they come, packs by the plain rule over the whole table."""
    sf = "/root/testdata/sf0.001"
    got = registry.queries()[name](spark, sf).collect()
    size = {r.doc_id: r.n_chars // 3 for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.length for r in got} == {i: n for i, n in size.items() if n <= 4096}
    want = []
    for s in {r.shard for r in got}:
        own = [r.doc_id for r in got if r.shard == s]
        bins = [[]]
        for i in sorted(own) if name == "pack_sequential" else sorted(own, key=lambda i: (-size[i], i)):
            to = bins[-1] if name == "pack_sequential" else min(bins, key=lambda b: sum(size[x] for x in b))
            if sum(size[x] for x in to) + size[i] > 4096:
                bins.append(to := [])
            to.append(i)
        want += [(i, s, k, j) for k, b in enumerate(bins) for j, i in enumerate(b)]
    assert sorted((r.doc_id, r.shard, r.pack, r.slot) for r in got) == sorted(want)


def test_corruption_queries_take_whole_texts(spark, tmp_path):
    texts = _documents(spark, tmp_path, [1, 31, 32, 33, 199, 200, 201, 256, 700, 0])
    at = spark.createDataFrame([(k, i, i // 32, i % 32) for k, t in texts.items() for i in range(len(t))], "doc_id long, i int, b int, j int")
    unit = lambda *c: sampling._unit("doc_id", *c)
    rows = at.select("*", unit(F.lit(7)).alias("p"), unit(F.lit(8), "i").alias("u"), unit(F.lit(7), "b").alias("m"), unit(F.lit(8), "b", "j").alias("v")).collect()
    hit = {k: {r.i for r in rows if r.doc_id == k and r.i % 3 and r.u < 0.001 + 0.999 * r.p} for k in texts}
    got = registry.queries()["corrupt_uniform"](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.noised, r.n) for r in got} == {k: (len(hit[k]), len(t)) for k, t in texts.items()}
    drawn = {k: set() for k in texts}
    for k, b in {(r.doc_id, r.b) for r in rows}:
        own = [r for r in rows if (r.doc_id, r.b) == (k, b)]
        m = 0.001 + 0.999 * own[0].m
        z = lambda r: (1 - m) * math.log(2) / 8 * r.j - math.log(-math.log(r.v))
        drawn[k] |= {r.i for r in sorted(own, key=z, reverse=True)[: round(m * len(own))]}
    got = registry.queries()["corrupt_blocks"](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.noised, r.n) for r in got} == {k: (len(drawn[k]), len(t)) for k, t in texts.items()}
    t = spark.createDataFrame([(k, [ord(c) for c in t], [1] * len(t)) for k, t in texts.items()], "doc_id long, ids array<int>, m array<int>")
    c = sampling.corrupt_blocks(t, "doc_id", "ids", "m", -1, 7, 32).collect()
    assert {r.doc_id: {i for i, h in enumerate(r.noise_mask) if h} for r in c} == drawn and all((x == -1) == h for r in c for x, h in zip(r.noisy_ids, r.noise_mask))


def test_block_noise_without_blocks_and_without_tokens(spark):
    """A row without a block size is one block with a place at least; draws run in no lambda of the JVM."""
    t = spark.createDataFrame([(1, [5] * 3000, [1] * 3000), (2, [], []), (3, None, [1]), (4, [7], [1])], "id long, ids array<int>, m array<int>")
    c = sampling.corrupt_blocks(t, "id", "ids", "m", 99, 1)
    assert "ArrowEvalPython" in c._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: r for r in c.collect()}
    one = t.where("id = 1").select(((F.pmod(F.xxhash64("id", F.lit(1), F.lit(0)), F.lit(1 << 52)) + 0.5) / (1 << 52)).alias("m")).collect()[0].m
    v = [r.v for r in t.where("id = 1").select(F.explode(F.sequence(F.lit(0), F.lit(2999))).alias("i"), "id").select(((F.pmod(F.xxhash64("id", F.lit(2), F.lit(0), "i"), F.lit(1 << 52)) + 0.5) / (1 << 52)).alias("v")).collect()]
    m = 0.001 + 0.999 * one
    z = [(1 - m) * math.log(2) / (0.25 * 3000) * i - math.log(-math.log(x)) for i, x in enumerate(v)]
    want = set(sorted(range(3000), key=lambda i: (z[i], i), reverse=True)[: round(m * 3000)])
    assert {i for i, h in enumerate(got[1].noise_mask) if h} == want
    assert got[2].noise_mask == [] and got[3].noisy_ids is None and got[4].noisy_ids == [99]


def test_tasks_of_shared_pairs_grow_with_the_pairs(spark, monkeypatch):
    rows = [(g, i, f) for g in (1, 2) for f in range(12) for i in range(f % 5 + 2)] * 2
    d = spark.createDataFrame(rows, "g int, item int, frame int")
    want = {}
    for g, a, f in set(rows):
        for b in range(a + 1, f % 5 + 2):
            want[g, a, b] = want.get((g, a, b), 0) + 1
    monkeypatch.setattr(spans, "PAIRS", 5)
    got = spans.shared_frame_pairs(d, ["g"], "item", "frame", 3)
    assert {(r.g, r.a, r.b): r.shared for r in got.collect()} == {k: n for k, n in want.items() if n >= 3}
    assert got.rdd.getNumPartitions() == -(-sum(want.values()) // 5) > 8
