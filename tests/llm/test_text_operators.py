"""PII, decontamination, sharding, BPE and chats against brute force, with nulls, ties, clashes and empty tables."""

import hashlib
import random
import re
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from framewright.llm import bpe, chat, decontaminate, pii, queries, shards


def docs(spark, texts, more=""):
    return spark.createDataFrame([(i, t, "s", i) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_hit int")


# ---- personal data -----------------------------------------------------------------------------------


def brute_spans(t):
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == 2 and not (12 <= len(d) <= 19 and pii.luhn(d)):
                continue
            if k == 3 and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return [(s, e, pii.KINDS[k]) for s, k, e in sorted(out)]


def test_patterns_against_brute_force():
    r = random.Random(2)
    bits = ["a.b@c.de", "@", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+44 (20) 7946-0958", "+1", " ", ".", "x", "é", "12", "-", "5.", "a@b", "@c.d", "00001.2.3.004", "\n", "+"]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 9)))
        assert pii.base_spans(t) == brute_spans(t), t


@pytest.fixture(scope="module")
def crf(spark):
    return pii.fit(pii.sample_table(spark))


def test_crf_on_its_own_kind(crf):
    rows = [x for t, y in pii.sample_rows(300, seed=99) for x in pii.runs_of(t, y)]
    labels = crf.decode([t for t, _ in rows])
    assert sum(a == b for a, (_, b) in zip(labels, rows)) / len(rows) > 0.9


def test_shapes_are_of_whole_tokens():
    assert pii.shape("x" * 64 + "a@b") == "xxxx@x" and pii.shape("x" * 200 + "1-2-3") == "xxxxd-d-d"
    assert pii.shape("ABCDEé--..///") == "XXXXx--..//" and pii.shape("") == ""


def test_words_beside_a_run_count():
    rows = [((cue, ["5551234567"], None), [label]) for cue, label in (("phone:", "B-phone"), ("order", "O")) for _ in range(20)]
    model = pii.train_crf(rows)
    assert model.decode([("phone", ["5559876543"], None), ("order", ["5559876543"], None)]) == [["B-phone"], ["O"]]
    assert pii._beside("call me  555 now", 9, -1) == "me" and pii._beside("call 555", 8, 1) is None and pii._beside("5 a", 1, 1) == "a"


def best_labels(model, run):
    """The best legal labels by trying them all."""
    import itertools

    import numpy as np

    left, t, right = run
    emit = model.weights[np.array(pii._features(t, left, right))].sum(axis=1)
    n = len(pii.LABELS)
    value = lambda y: model.trans[0, y[0]] + sum(emit[i, a] for i, a in enumerate(y)) + sum(model.trans[a, b] for a, b in zip(y, y[1:])) + model.trans[y[-1], 0]
    return [pii.LABELS[a] for a in max(itertools.product(range(n), repeat=len(t)), key=value)]


def test_viterbi_against_all_labellings(crf):
    r = random.Random(8)
    runs = [x for t, y in pii.sample_rows(60, seed=3) for x, _ in pii.runs_of(t, y) if len(x[1]) <= 4] + [("to", [r.choice(["(555)", "12", "a@b.c", "1.2.3.4", "+1", "99-88"]) for _ in range(k)], None) for k in (1, 2, 3, 4) for _ in range(5)]
    assert crf.decode(runs) == [best_labels(crf, x) for x in runs]

def test_pii_report_and_redaction(spark, crf):
    texts = ["mail a@b.co now", None, "", "call (555) 123-4567 or +1 555 123 4567", "x " * 50000 + "1.2.3.4", "plain"]
    df = docs(spark, texts)
    got = {r.doc_id: r for r in pii.report(df, crf).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(pii.as_text(want).encode()).hexdigest()
        assert set(pii.as_text(want).split(",")) <= set(got[i].spans.split(","))
    assert "phone:5:19" in got[3].spans
    red = {r.doc_id: r.text for r in pii.redact(df, crf).collect()}
    assert red[0] == "mail [EMAIL] now" and red[5] == "plain" and pii.redact(df, crf).columns == df.columns
    assert pii.report(df.limit(0), crf).count() == 0


def test_pii_repeats_nulls_and_clashes(spark, crf):
    df = spark.createDataFrame([(1, "a@b.co", "s", 5, 3), (1, "a@b.co", "s", 5, 3), (None, "1.2.3.4", None, 6, None), (2, None, None, 7, 0)], "doc_id long, text string, spans string, n_email int, n_chars int")
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.spans) for r in pii.report(df, crf).collect())
    assert got == [("1", 1, 0, "email:0:6"), ("1", 1, 0, "email:0:6"), ("2", 0, 0, ""), ("None", 0, 1, "ip:0:7")]
    red = pii.redact(df, crf, length_col="n_chars")
    assert red.columns == df.columns and sorted((r.text or "", r.n_chars, r.spans) for r in red.collect()) == sorted([("[EMAIL]", 7, "s"), ("[EMAIL]", 7, "s"), ("[IP]", 4, None), ("", 0, None)], key=str)


# ---- decontamination ---------------------------------------------------------------------------------


def tokens(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute_hits(texts, items):
    out = []
    for t in texts:
        w = tokens(t)
        hit, found = set(), set()
        for i, x in items:
            v = tokens(x)
            size = min(13, len(v))
            for k in range(len(v) - size + 1) if v else ():
                for j in range(len(w) - size + 1):
                    if w[j : j + size] == v[k : k + size]:
                        found.add(str(i))
                        hit |= set(range(j, j + size))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("pass_bytes", [1 << 20, 60])
def test_decontamination_against_brute_force(spark, pass_bytes):
    r = random.Random(3)
    word = lambda: r.choice(["a", "B", "c9", "é", "dd"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((1, 3, 13, 14, 30, 0))] + [(10, None), (2, "zz yy")]
    texts = [" ".join(word() for _ in range(r.randint(0, 60))) for _ in range(25)] + [None, "", "Zz. YY!", "q " * 4000 + (items[3][1] or "")]
    df, bench = docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(x)[1:5] for x in decontaminate.report(df, bench, pass_bytes=pass_bytes).orderBy("doc_id").collect()]
    assert got == brute_hits(texts, items)
    kept = {x.doc_id for x in decontaminate.drop_contaminated(df, bench, pass_bytes=pass_bytes).collect()}
    assert kept == {i for i, (n, h, _, _) in enumerate(got) if not (h > 0 and 20 * h >= n)}
    assert [x.n_hit for x in decontaminate.report(df, bench.limit(0)).collect()] == [0] * len(texts)
    assert decontaminate.report(df.limit(0), bench).count() == 0


def test_decontamination_on_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b", 7, "x"), (1, "a b", 7, "x"), (None, "A-B", 7, None), (2, None, 7, None), (3, "b a", 7, None)], "doc_id long, text string, n_words int, items string")
    bench = spark.createDataFrame([(5, "a b", 1), (5, "a b", 1), (6, "c", 2), (None, "b", 3), (7, None, 4)], "item_id long, text string, n_hit int")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.report(df, bench).collect())
    assert got == [("1", 2, 2, 1, True), ("1", 2, 2, 1, True), ("2", 0, 0, 0, False), ("3", 2, 0, 0, False), ("None", 2, 2, 1, True)]
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_words_are_compared_byte_by_byte():
    import numpy as np
    import pyarrow as pa

    from framewright.llm.textbytes import Powers

    a, b = (decontaminate.Words(pa.array([t]), Powers()) for t in ("One two THREE x", "one twp three xx"))
    assert a.same(np.arange(4), b, np.arange(4)).tolist() == [True, False, True, False]


# ---- shards --------------------------------------------------------------------------------------------


def test_shards_match_the_mixture(spark):
    rows = [(i, "x" * (i % 7), "big" if i % 3 else "small", None) for i in range(2000)] + [(5000, None, None, 1), (5000, None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int")
    got = shards.shard(df, 8, bucket_rows=64).collect()
    assert len(got) == 2002 and {r.law for r in got} == {"rows"} and all(r.grown_shard is None for r in got)
    kind = {i: s for i, _, s, _ in rows}
    for k in range(8):
        own = sorted((r for r in got if r.shard == k), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own))) and len(own) in (250, 251)
        assert abs(sum(kind[r.doc_id] == "big" for r in own) - 1333 / 8) <= 3
    r = next(r for r in got if r.doc_id == 6)
    assert r.size == 22 and r.text_crc32 == crc32(b"xxxxxx")
    assert sorted((r.doc_id, r.shard, r.slot) for r in shards.shard(df.repartition(7), 8, bucket_rows=64).collect()) == sorted((r.doc_id, r.shard, r.slot) for r in got)
    assert shards.shard(df.limit(0), 8).count() == 0


# ---- byte-level BPE ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    path, pattern = queries.tokenizer()
    return bpe.Coder(bpe.load_ranks(path), pattern, 64, 32), bpe.Coder(bpe.load_ranks(path), pattern)


def test_bpe_tree_is_the_library(coder):
    small, plain = coder
    r = random.Random(5)
    parts = ["the ", " cat", "é", "ßß", "日本", "\n\n", "  ", "1234567", "x" * 90, "don't", "'s", "\t", "🙂", ".,.,", "<|endoftext|>", " " * 70, " "]
    for _ in range(300):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 60)))
        want = plain.core.encode_ordinary(t)
        for c in (small, plain):
            assert c.encode(t) == want, repr(t)
        assert small.decode(want) == t.encode()


def test_bpe_tree_in_production_settings(coder, monkeypatch):
    """Texts of more than one leaf are joined from halves, whatever their kind, and are what the library gives."""
    _, plain = coder
    joins = []
    monkeypatch.setattr(bpe.Coder, "_join", lambda self, *a, real=bpe.Coder._join: joins.append(a) or real(self, *a))
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgß日é") for _ in range(r.randint(1, 9)))
    texts = [" ".join(word() for _ in range(n)) for n in (200, 1000, 5000)] + ["日本語" * 700, "x" * 3000, "=" * 2000, " " * 1500 + "a", "\n\n" * 800, ("word" + " " * 40) * 60, "12345" * 400, "it's " * 300, "🙂" * 900]
    for t in texts:
        before = len(joins)
        ids = plain.encode(t)
        assert ids == plain.core.encode_ordinary(t), t[:40]
        assert plain.decode(ids) == t.encode() and len(joins) > before


def test_bpe_refuses_patterns_without_the_boundary():
    path, _ = queries.tokenizer()
    with pytest.raises(ValueError, match="matches across"):
        bpe.Coder(bpe.load_ranks(path), r"\S+ \S+|\s+|\S+")


def test_bpe_repeats_nulls_and_clashes(spark):
    path, pattern = queries.tokenizer()
    df = spark.createDataFrame([(1, "a b", 5, "x"), (1, "a b", 5, "x"), (None, "a b", 6, None), (None, None, 6, None)], "doc_id long, text string, n_tokens int, ids string")
    got = bpe.digests(df, path, pattern).collect()
    assert sorted(r.n_tokens for r in got) == [0, 2, 2, 2] and sum(r.doc_id is None for r in got) == 2
    assert sorted(len(r.ids) for r in bpe.encode(df, path, pattern).collect()) == [0, 2, 2, 2]


def test_bpe_tables(spark):
    path, pattern = queries.tokenizer()
    df = docs(spark, ["hello world", None, "", "a" * 30000, "word " * 20000])
    e = bpe.encode(df, path, pattern)
    got = {r.doc_id: r.text for r in bpe.decode(e, path, pattern).collect()}
    assert got == {0: "hello world", 1: "", 2: "", 3: "a" * 30000, 4: "word " * 20000}
    d = {r.doc_id: r for r in bpe.digests(df, path, pattern).collect()}
    assert d[1].n_tokens == 0 and d[1].ids_sha256 == hashlib.sha256(b"").hexdigest() and d[4].decoded_sha256 == hashlib.sha256(b"word " * 20000).hexdigest()
    assert bpe.digests(df.limit(0), path, pattern).count() == 0


# ---- chats ---------------------------------------------------------------------------------------------


def test_maximal_conversations(spark):
    turns = lambda c, *ts: [(c, i, "user" if i % 2 == 0 else "assistant", t, c) for i, t in enumerate(ts)]
    rows = turns(1, "a", "b") + turns(2, "a", "b", "c") + turns(3, "a", "b", "c") + turns(4, "a", "x") + turns(5, None) + [(6, 5, None, "a", 0), (6, 7, "user", "z", 0), (None, 0, "user", "a", 0), (7, None, "user", "a", 0)] + turns(2, "a")
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat.maximal_conversations(df, chunk=2).collect()}
    assert got == {2: (3, 2), 4: (2, 1), 5: (1, 1), 6: (2, 1)}
    text = {r.conv_id: r.rendered for r in chat.format_chats(df).collect()}
    assert text[4] == "<|user|>\na<|end|>\n<|assistant|>\nx<|end|>\n" and text[5] == "<|user|>\n<|end|>\n"
    assert chat.format_chats(df.limit(0)).count() == 0
    many = [(1, i, "user", str(i), 0) for i in range(1000)] + [(2, i, "user", str(i), 0) for i in range(999)]
    big = spark.createDataFrame(many, "conv_id long, turn long, role string, text string, n_turns int")
    assert [(r.conv_id, r.n_turns) for r in chat.maximal_conversations(big).collect()] == [(1, 1000)]
    parts = chat.format_chats(big).orderBy("part").collect()
    assert "".join(p.rendered for p in parts).count("<|user|>") == 1000


def test_chat_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat.format_chats(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and F is not None
