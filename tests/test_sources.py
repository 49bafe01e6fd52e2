import json

import numpy as np
import pytest
from graphs import random_graph, walkers
from pyspark.sql import functions as F

from framewright import schemas, udf
from framewright.graph import normalise, queries
from framewright.metrics import tubes
from framewright.plans import q_sources
from framewright.sources import annotations, exports, graphs, tables, tokenstore
from framewright.streaming import streams


def lines(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return str(path)


def test_graph_files(spark, tmp_path):
    p = lines(tmp_path / "g.jsonl", [walkers(), "", "{broken", random_graph(3)])
    g = graphs.read_graphs(spark, p)
    assert sorted(r.video_path for r in g.collect()) == ["v1.mp4", "v3.mp4"]
    v = spark.createDataFrame([("a/v1.mp4",), ("v9.mp4",)], "video_path string")
    assert [r.video_path for r in graphs.unfinished(v, g).collect()] == ["v9.mp4"]
    new = g.where("video_path = 'v1.mp4'").withColumn("video_width", F.lit(7).cast("long"))
    graphs.upsert_file(spark, p, new, str(tmp_path / "out"))
    assert {r.video_path: r.video_width for r in graphs.read_graphs(spark, str(tmp_path / "out")).collect()} == {"v1.mp4": 7, "v3.mp4": 100}
    for n in ("b.mp4", "a.mp4", "c.avi", "x.txt"):
        (tmp_path / n).write_text("x")
    names = [r.video_path.rsplit("/", 1)[-1] for i in (0, 1) for r in graphs.shard(graphs.list_videos(spark, str(tmp_path)), i, 2).orderBy("video_path").collect()]
    assert sorted(names) == ["a.mp4", "b.mp4", "c.avi"]
    c = [graphs.chunk(spark.range(10), ["id"], i, 4).count() for i in range(4)]
    assert c == [3, 3, 3, 1]


def normalised(g):
    known = {o["node_id"] for o in g["object_nodes"]}
    return normalise.relations(g, known)


def test_normalise_and_merge(spark):
    g = walkers()
    g["object_nodes"].append(dict(g["object_nodes"][1], node_id=" dog_9 ", global_track_id=9, attributes=["Wet", "wet"], bboxes={"9": [1.0, 1.0, 2.0, 2.0], "-1": [0.0] * 4, "2": [9.0] * 4}))
    g["object_nodes"].append({"node_id": " ", "start_frame": 0, "end_frame": 9})
    g["edges"].append({"source_id": "dog_1", "target_id": "dog_9", "reference_relationship": "same_entity"})
    g["edges"].append({"subject_id": "dog_9", "relationships": [{"object_id": "person_0", "predicate_verb": "chase", "relationship_type": "motion", "start_frame": 3, "end_frame": 8}, {"object_id": "nobody", "predicate_verb": "x", "start_frame": 0, "end_frame": 9}]})
    n = normalise.normalise(spark.createDataFrame([g], schemas.GRAPH), 2).collect()[0]
    o = {x.node_id: x for x in n.object_nodes}
    assert set(o) == {"person_0", "dog_1"} and o["dog_1"].bboxes == {"2": [40.0, 40.0, 60.0, 60.0], "7": [42.0, 40.0, 62.0, 60.0], "9": [1.0, 1.0, 2.0, 2.0]}
    assert o["dog_1"].attributes == ["Wet"] and o["dog_1"].end_frame == 9
    acts = {a.object_id: [(x.action_label, x.start_frame, x.end_frame) for x in a.actions] for a in n.action_nodes}
    assert acts["dog_1"] == [("chase", 3, 8)] and [e.subject_id for e in n.edges] == ["person_0"]
    assert [(t.start_frame, t.end_frame) for t in n.edges[0].relationships[0].time_spans] == [(2, 7)]
    assert normalise.normalise(spark.createDataFrame([], schemas.GRAPH)).count() == 0


def test_action_fold():
    a = {"action_label": "Watch", "start_frame": 5, "end_frame": 9, "target_object_ids": ["a"]}
    m = {"action_label": "looking at", "start_frame": 8, "end_frame": 20, "target_object_ids": ["b"], "_source": "motion"}
    assert normalise.fold_actions([a, m]) == [{"action_label": "Watch", "frame_idx": 5, "start_frame": 5, "end_frame": 9, "target_object_ids": ["a", "b"]}]
    assert normalise.fold_actions([m, dict(m, start_frame=10, end_frame=30)])[0]["end_frame"] == 30
    assert normalise.fold_actions([{"action_label": "x", "start_frame": 1, "end_frame": 2}]) == []


def test_annotations(spark, tmp_path):
    q = lines(tmp_path / "q.jsonl", [{"video_path": "a.mp4", "query": "x", "query_id": "1", "box": '{"d": {"3": [0.1, 0.1, 0.5, 0.5]}}', "difficulty_bucket": "easy", "D": 0.5}, {"video_path": "a.mp4", "query": "y", "queryid": "2", "video_width": 10, "video_height": 10, "target_members": [{"target_index": 1, "boxes": {"4": [1, 1, 5, 5], "z": [1, 1, 1, 1]}}]}, {"video_path": "b.mp4", "query": "z", "query_id": "3"}])
    s = {r.sample_id: r for r in annotations.queries(spark, q).collect()}
    assert s["1"].gt[0].s == 3 and s["2"].gt[0].boxes == {4: [0.1, 0.1, 0.5, 0.5]} and s["3"].gt[0].s is None and s["1"].difficulty_score == 0.5
    h = tmp_path / "h.json"
    h.write_text(json.dumps({"v.mp4": {"st_frame": 5, "ed_frame": 6, "width": 100, "height": 50, "bbox": [[0, 0, 50, 25], [10, 0, 50, 25]], "English": "q", "img_size": [1, 1], "st_time": 0, "ed_time": 1}, "bad.mp4": {"st_frame": 5, "ed_frame": 5, "width": 100, "height": 50, "bbox": [[90, 0, 50, 25]], "English": "q", "img_size": [1, 1], "st_time": 0, "ed_time": 1}}))
    r = annotations.corner_sized(spark, str(h)).collect()
    assert len(r) == 1 and r[0].gt[0].boxes == {5: [0.0, 0.0, 0.5, 0.5], 6: [0.1, 0.0, 0.6, 0.5]}
    v = tmp_path / "v.json"
    v.write_text(json.dumps({"i": {"vid": "k", "temp_gt": {"begin_fid": 2, "end_fid": 2}, "target_bboxs": [{"xmin": 1, "ymin": 1, "xmax": 5, "ymax": 5}], "qtype": "declar", "sentence": {"description": "s"}, "fps": 2, "width": 10, "height": 10, "frame_count": 9}}))
    d = annotations.cornered(spark, str(v))
    ask = spark.createDataFrame([("i", '{"s": {"2": [0.1, 0.1, 0.5, 0.5]}}')], "sample_id string, answer string")
    got = tubes.score(annotations.with_answers(d, ask)).collect()[0]
    assert got.vIoU == 1 and {x.group for x in tubes.means_by_question(tubes.score(annotations.with_answers(d, ask))).collect()} == {"overall", "declarative"}
    a = tmp_path / "a.json"
    a.write_text(json.dumps([{"video_path": "x.mp4", "QA": {"q": "who"}, "meta": {"time_token": {"<s>": 9, "<e>": 3}, "split": [5, 2]}, "id": "1"}, {"video_path": "y.mp4", "QA": [{"question": "w"}], "meta": {"time_token": {"<s>": 1}}}]))
    r = annotations.aligned(spark, str(a)).collect()
    assert len(r) == 1 and (r[0].query, r[0].gt[0].s, r[0].gt[0].e, r[0].clip_split) == ("who", 3, 9, [2, 5])


def test_official_predictions(spark):
    rows = spark.createDataFrame([(0, "d/a.mp4", 10.0, 10.0), (1, "b.mp4", 10.0, 10.0)], "ord int, video_path string, width double, height double")
    p = spark.createDataFrame([("a", None, 5, 2, 4, {"1": [[1.0] * 4], "2": [[1.0, 1.0, 5.0, 5.0]], "4": [[1.0] * 4]})], "key string, name string, ord int, s int, e int, boxes map<string, array<array<double>>>")
    got = {r.ord: r.target for r in annotations.official_predictions(rows, p).collect()}
    assert got == {0: {2: [0.1, 0.1, 0.5, 0.5]}, 1: {}}


def test_exports(spark):
    df = queries.generate(spark.createDataFrame([walkers()], schemas.GRAPH))
    t = exports.training_records(df).collect()
    assert t and all(json.loads(r.box) and r.Width == 100 for r in t)
    rows = spark.createDataFrame([("/m/a/x.mp4", "q", "1", 100, 100, None, None, {"3": [10.0, 10.0, 50.0, 50.0]}), ("/m/b/y.mp4", " ", "2", 100, 100, None, None, None)], "video_path string, query string, query_id string, video_width int, video_height int, box string, box_01 string, boxes map<string, array<double>>")
    s = exports.chat_samples(rows, answer="both").collect()
    assert len(s) == 1 and s[0].videos == ["a/x.mp4"] and s[0].messages[1].content == "The object box is: <3, 1.5, 10.0, 10.0, 50.0, 50.0 />\nThe object box (0-1 normalized) is: <3, 1.5, 0.1000, 0.1000, 0.5000, 0.5000 />"
    gt = spark.createDataFrame([(0, "a.mp4", 10, 10, [{"description": "d", "s": 1, "e": 2, "boxes": {1: [0.1, 0.1, 0.5, 0.5]}}])], f"ord int, video_path string, width int, height int, gt array<{schemas.TRACK}>")
    st = exports.sentence_rows(gt)
    assert [(r.vid, r.frame_count, r.target_id) for r in st.collect()] == [("a", 3, 0)]
    tr = {r.frame: r.targets for r in exports.trajectories(st).collect()}
    assert len(tr) == 3 and tr[1][0].bbox.xmax == 5 and tr[0] == []
    m = exports.mixed_split({"a": spark.range(6), "b": spark.range(6, 10)}, 5, 2, "id")
    assert {r.part: r["count"] for r in m.groupBy("part").count().collect()} == {"sft": 7, "rl": 3}


def test_names():
    assert tables.is_table_name("a.b.c") and not tables.is_table_name("a.b") and not tables.is_table_name("s3://a.b.c") and not tables.is_table_name("a..c")
    assert tables.is_delta("delta://x") and tables.is_delta("dbfs:/x") and not tables.is_delta("x") and not tables.is_delta(None)
    assert tables.quoted("a`b") == "`a``b`" and tables.derived("select 1 ;", ["x"]) == "SELECT `x` FROM (select 1) AS q"
    assert tables.is_hub_id("owner/set") and not tables.is_hub_id("a/b.json")
    assert udf.find_dataset("HC_STVG") is annotations.corner_sized
    with pytest.raises(ValueError, match="unknown model"):
        udf.find_model("nothing")


def test_readers(spark, tmp_path):
    spark.range(10).createOrReplaceTempView("ten")
    assert tables.read(spark, sql="select id, id * 2 as x from ten", columns=["x"]).columns == ["x"]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "_delta_log").mkdir()
    assert tables.is_delta(str(tmp_path / "log"), spark) and not tables.is_delta(str(tmp_path), spark)
    c = lines(tmp_path / "c.jsonl", [{"id": str(i), "messages": [{"role": "user", "content": "x"}]} for i in range(5)] + ["{bad"])
    assert tables.read_chats(spark, c, "train[1:3]", "id", skip_invalid=True).count() == 2
    d = lines(tmp_path / "d.csv", ["v,0902,0.1,0.2,0.3,0.4,5,0.9", "v,0903,0.1,0.2,0.3,0.4,6,0.8"])
    assert [r.frame for r in tables.read_detections(spark, d, [5]).collect()] == [902]
    m = lines(tmp_path / "m.txt", ['label {', '  name: "run"', "  id: 3", "}", "label {", '  name: "sit"', "  label_id: 4", "}"])
    assert sorted((r.label, r.name) for r in tables.read_labels(spark, m).collect()) == [(3, "run"), (4, "sit")]
    tables.write_shards(spark.range(4).withColumn("part", F.col("id") % 2), str(tmp_path / "s"), "part", ["id"])
    assert tables.shards_present(spark, str(tmp_path / "s"), "part").count() == 2
    with pytest.raises(ValueError, match="version"):
        tables.shards_present(spark, str(tmp_path / "s"), "part", 2)


def test_token_stores(spark, tmp_path):
    tokenstore.register(spark)
    d = spark.createDataFrame([(0, [1, 5, 6]), (0, [1, 7]), (1, [1, 9, 9, 9])], "document long, tokens array<int>")
    d.coalesce(1).write.format("token_shards").option("path", str(tmp_path / "sh")).option("bos", 1).mode("append").save()
    want = [1, 5, 6, 1, 7, 1, 9, 9, 9]
    assert [r.tokens for r in spark.read.format("token_shards").load(str(tmp_path / "sh")).collect()] == [want]
    assert [r.tokens for r in tokenstore.from_binary(spark, str(tmp_path / "sh")).collect()] == [want]
    assert np.fromfile(next((tmp_path / "sh").glob("*.bos.idx")), dtype=np.int32).tolist() == [0, 3, 5]
    with pytest.raises(ValueError):
        tokenstore.shard_tokens(b"x" * 2000)
    d.coalesce(1).select("document", "tokens").write.format("indexed_tokens").option("path", str(tmp_path / "ix" / "a")).mode("append").save()
    p = tokenstore.prefixes([str(tmp_path / "ix" / "*")])
    got = [tuple(r) for r in spark.read.format("indexed_tokens").option("rows_per_partition", 2).load(p[0]).orderBy("sequence").collect()]
    assert got == [(0, 0, None, [1, 5, 6]), (1, 0, None, [1, 7]), (2, 1, None, [1, 9, 9, 9])]


def test_models(spark):
    @udf.model("Echo One")
    def factory():
        def ask(batch):
            if "bad" in set(batch["query"]):
                raise RuntimeError
            return ['{"temporal_span": [1, 4]}'] * len(batch)

        return ask

    track = [{"description": "q", "s": 1, "e": 4, "boxes": {}}]
    s = spark.createDataFrame([(1, "v", "q", track), (2, "v", "bad", track)], f"sample_id int, video_path string, query string, gt array<{schemas.TRACK}>")
    r = {x.sample_id: x.tIoU for x in udf.evaluate_spans(s, udf.find_model("echo-one")).collect()}
    assert r in ({1: 1.0, 2: 0.0}, {1: 0.0, 2: 0.0})
    a = udf.asked(s, "sample_id", "query", lambda: lambda p: p * 2, lambda t: t if t != "badbad" else None, tries=2)
    assert {x.sample_id: x.answer for x in a.collect()} == {1: "qq", 2: None}
    k = udf.KeyPool(["a"], 1)
    assert k.take() == "a" and k.take() is None


def test_rows_and_shuffle(spark):
    r = streams.Rows(spark.range(100), "id")
    assert [x.id for x in r.take(7).take(3).df().collect()] == [0, 1, 2]
    a = r.shard(4, 1).shuffle(1).df()
    assert sorted(x.id for x in a.collect()) == list(range(1, 100, 4))
    assert r.shuffle(1).set_epoch(2).take(5).after(2).count() == 3
    assert sorted(streams.reservoir_order(list(range(50)), 8, 1)) == list(range(50))


def test_buffered_shuffle_stream(spark, tmp_path):
    spark.range(60).select("id", F.col("id").cast("string").alias("v")).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("id long, v string").parquet(str(tmp_path / "in"))
    q = streams.buffered_shuffle(s, "id", "v", 2, 8, 1).writeStream.format("memory").queryName("shuffled_rows").outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(40):  # idle lanes give up what they hold once their timer runs out
            q.awaitTermination(1)
            if spark.table("shuffled_rows").count() >= 60:
                break
    finally:
        q.stop()
    got = [r.id for r in spark.table("shuffled_rows").collect()]
    assert sorted(got) == list(range(60)) and got != sorted(got)


def test_documents_across_blocks(spark, tmp_path):
    """Entries are those of the whole document, wherever its blocks are cut."""
    from framewright.sources import documents

    whole = {f"k{i}": {"a": 'x}",{[\\' * (i % 4), "b": [{"c": i}, {}], "d": "é" * (i % 7)} for i in range(400)}
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "one.json").write_text(json.dumps(whole, ensure_ascii=False) + "\n")
    (tmp_path / "o" / "two.json").write_text("\n" + json.dumps({"z": {"a": "y"}, "e": {}}, indent=2))
    (tmp_path / "o" / "cut.json").write_text('{"p": {"a": 1}, "q": {"a"')
    (tmp_path / "o" / "none.json").write_text("{}")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "l.json").write_text(json.dumps(list(whole.values()), indent=1))
    (tmp_path / "a" / "s.json").write_text(json.dumps({"a": "single"}))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("97", "1000", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = {}
            for r in documents.entries(spark, str(tmp_path / "o"), "{").collect():
                got |= json.loads("{" + r.value + "}")
            assert got == whole | {"z": {"a": "y"}, "e": {}}
            items = [json.loads(r.value) for r in documents.entries(spark, str(tmp_path / "a"), "[").collect()]
            key = lambda x: json.dumps(x, sort_keys=True)
            assert sorted(items, key=key) == sorted([*whole.values(), {"a": "single"}], key=key)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    documents.write_document(spark.createDataFrame([], "value string"), str(tmp_path / "empty"), "[")
    assert documents.entries(spark, str(tmp_path / "empty"), "[").count() == 0


def test_scans_hold_no_document_in_a_row(spark, tmp_path):
    """The documents are written entry by entry: no row is longer than an entry."""
    from framewright.plans import registry

    for name, kind in (("scan_cornered", "cornered"), ("scan_corner_sized", "corner"), ("scan_aligned", "aligned")):
        seen = []
        write = q_sources._document
        q_sources._document = lambda rows, *a: seen.append(rows.agg(F.max(F.length("value"))).collect()[0][0]) or write(rows, *a)
        try:
            assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
        finally:
            q_sources._document = write
        assert 0 < seen[0] < 500, kind


def test_pairs_are_found_by_shared_frames(spark, monkeypatch):
    """Objects that share too few frames never meet; long and short ones give the pairs of plain rules."""
    import random

    from framewright.graph import tables as graph_tables

    r, o = random.Random(2), []
    sets = {f"n{i}": sorted(r.sample(range(12), r.randint(1, 8))) for i in range(40)}
    for k, f in sets.items():
        o.append({"node_id": k, "start_frame": f[0], "end_frame": f[-1], "bboxes": {str(x): [0.0] * 4 for x in f}})
    g = spark.createDataFrame([{"video_path": "v", "object_nodes": o}], schemas.GRAPH)
    for most in (24, 4):
        monkeypatch.setattr(graph_tables, "MOST_FRAMES", most)
        for least in (1, 2, 3):
            got = {(x.a, x.b): x.frames for x in graph_tables.pair_infos(g, least).collect()}
            every = graph_tables.pair_infos(g, least).count()
            both = {(a, b): sorted(set(sets[a]) & set(sets[b])) for a in sets for b in sets if a < b}
            want = {k: v for k, v in both.items() if len(v) >= least}
            assert got == want and every == len(want)


def test_shards_are_bounded(spark, tmp_path):
    """A partition's tokens go into several shards once one is full, and all are read back."""
    d = spark.range(50).select(F.col("id").alias("document"), F.transform(F.sequence(F.lit(1), F.col("id") + 1), lambda x: x.cast("int")).alias("tokens"))
    tokenstore.register(spark)
    d.coalesce(1).write.format("token_shards").option("path", str(tmp_path / "s")).option("bos", 1).option("shard_tokens", 100).mode("append").save()
    got = [r.tokens for r in spark.read.format("token_shards").load(str(tmp_path / "s")).collect()]
    assert 5 < len(got) and max(map(len, got)) < 150
    assert sorted(t for x in got for t in x) == sorted(k for i in range(50) for k in range(1, i + 2))


def test_large_graphs_are_normalised_in_parts(spark):
    """Without edges and targets a graph's objects and actions are the same from parts; other graphs stay whole."""
    from framewright.graph import tables as graph_tables

    o = [{"node_id": f"n{i}", "start_frame": 0, "end_frame": 9, "bboxes": {"0": [0.0] * 4, "9": [1.0] * 4}} for i in range(50)]
    a = [{"node_id": f"g{i}", "object_id": f"n{i}", "actions": [{"action_label": "walk", "start_frame": i % 4, "end_frame": 8}]} for i in range(50)]
    g = spark.createDataFrame([{"video_path": "v", "object_nodes": o, "action_nodes": a, "edges": []}, random_graph(3)], schemas.GRAPH)
    p = normalise.parts(g, 10)
    assert p.count() == 6 and p.agg(F.max(F.size("object_nodes"))).collect()[0][0] < 50
    for table in (graph_tables.objects, graph_tables.actions):
        rows = lambda x: sorted(map(str, table(normalise.normalise(x, 2)).collect()))
        assert rows(p) == rows(g)
