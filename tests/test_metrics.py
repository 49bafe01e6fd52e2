import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import answers, arrays, box, interval, media, text
from framewright.metrics import classify, detect, retrieve, tubes
from framewright.operators import curves


def one(spark, *cols):
    return spark.range(1).select(*cols).collect()[0]


def test_golden_spans(spark):
    L = F.lit
    r = one(spark, interval.tiou_closed(L(0), L(4), L(3), L(6)), interval.tiou_half_open(L(0), L(4), L(3), L(6)), interval.tiou_closed(L(0), L(1), L(2), L(3)), interval.tiou_closed(L(None).cast("int"), L(4), L(3), L(6)), interval.tiou_closed(L(0), L(2), L(2), L(4)), interval.tiou_half_open(L(0), L(2), L(2), L(4)))
    assert list(r) == pytest.approx([2 / 7, 1 / 6, 0, 0, 1 / 5, 0])


def test_golden_boxes(spark):
    b = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    r = one(spark, box.box_iou(b(0, 0, 0.5, 0.5), b(0.25, 0.25, 0.75, 0.75)), box.box_iou(b(0, 0, 1, 1), b(1, 0, 2, 1)), box.box_iou(F.lit(None).cast("array<double>"), b(1, 0, 2, 1)))
    assert list(r) == pytest.approx([1 / 7, 0, 0])
    t = lambda *fs: F.create_map(*[x for f in fs for x in (F.lit(f), b(0, 0, 1, 1))])
    r = one(spark, box.tube_viou(t(1, 2, 3), t(2, 3, 4)), box.tube_siou(t(1, 2, 3), t(2, 3, 4)))
    assert list(r) == [0.5, 1.0]
    p = one(spark, box.point_to_box(F.lit(50.0), F.lit(0.5), 0.1, F.lit(10), F.lit(10)), box.point_to_box(F.lit(0.5), F.lit(0.5), 0.1, F.lit(10), F.lit(10)), box.point_to_box(F.lit(200.0), F.lit(0.0), 0.1, F.lit(400), F.lit(400)))
    assert [round(x[0], 3) for x in p] == [0.4, 0.4, 0.4]


def test_resize(spark):
    s = [one(spark, media.resize_image(F.lit(h), F.lit(w)))[0] for h, w in ((480, 640), (20, 20), (2160, 3840))]
    assert [(x.h, x.w) for x in s] == [(476, 644), (56, 56), (728, 1316)]
    assert all(w * h <= 65536 for _, w, h, _ in media.bucket_rows())


def test_text(spark):
    df = spark.createDataFrame([("is",), ("looking",), ("us",), ("red",)], "w string")
    assert [r[0] for r in df.select(text.stem(F.col("w"))).collect()] == ["be", "look", "us", "red"]
    keys = spark.createDataFrame([("looking at",), ("hand shake",), ("Wave hello",)], "w string").select(text.merge_key(F.col("w"))).collect()
    assert [r[0] for r in keys] == ["watch", "hand", "wave hello"]
    assert one(spark, text.doc_hash63(F.lit("doc-1")))[0] == 2915996249217350858
    assert one(spark, text.squeeze(F.lit(" a  b\t")))[0] == "a b"


def test_arrays(spark):
    a = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, arrays.even_positions(F.lit(10), F.lit(4)))[0] == [0, 3, 6, 9]
    assert one(spark, arrays.even_positions(F.lit(6), F.lit(3)))[0] == [0, 2, 5]
    assert one(spark, arrays.last_run(a(1, 1, 0, 1, 1, 0)))[0] == [0, 0, 0, 1, 1, 0]
    assert one(spark, arrays.last_run(a(0, 0)))[0] == [0, 0]
    assert one(spark, arrays.attention_from_labels(a(-100, 5, -100, -100)))[0] == [1, 1, 0, 0]
    assert one(spark, arrays.attention_from_labels(a(-100, -100)))[0] == [1, 1]
    assert one(spark, arrays.positions_with_reset(a(5, 0, 6, 7, 0, 8), 0))[0] == [0, 1, 0, 1, 2, 0]
    assert one(spark, arrays.block_causal_mask(a(2, 1)))[0] == [[1, 0, 0], [1, 1, 0], [0, 0, 1]]
    assert one(spark, arrays.linear_indices(F.lit(3), F.lit(12), F.lit(4)))[0] == [3, 6, 9, 12]
    assert one(spark, arrays.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>")))[0] == 0


#: Queries and the prompts that they become.
POINT_PROMPTS = {
    "Where does who carries it occur in the video?": "point to the person carrying it",
    "where does   who  makes tea\noccur in the video?": "point to the person making tea",
    "what is red?": "point to the red",
    "which dog.": "point to the dog",
    "the cup": "point to the the cup",
    "who is there": "point to the person there",
    "who are running": "point to the person are running",
    "Who has a hat": "point to the person having a hat",
    "who does it": "point to the person doing it",
    "who sits": "point to the person siting",
    "who use it": "point to the person using it",
    "who sing": "point to the person sing",
    "who run fast": "point to the person runing fast",
    "who yes": "point to the person yeing",
    "who be": "point to the person being",
    "who": "point to the who",
    "": "",
}


def test_vqa_answers(spark):
    from framewright.functions import text

    said = {"The CANT": "can't", "dont, go": "don't go", "Whos there?": "who's there", "an apple": "apple", "Two cats": "2 cats", "somebody'd": "somebodyd", "y'allll": "y'all'll", "1,000 dogs": "1000 dogs", "let's": "let's", "twas": "'twas"}
    for t, want in said.items():
        assert one(spark, text.vqa_answer(F.lit(t)))[0] == want, t


def test_answers(spark):
    ask = lambda t: one(spark, answers.temporal_span(F.lit(t)))[0]
    assert tuple(ask("3.5s to 6s")) == (7, 12) and tuple(ask("frames 9 - 4")) == (4, 9) and ask("none") is None
    assert tuple(ask('{"temporal_span": [1, 2]} then "temporal_span": [9.5, 3]')) == (3, 10)
    assert tuple(ask('{"start": 4, "end": 1}')) == (1, 4)
    good = answers.parse_tracks('```json\n{"the dog": {"3": [0.1, 0, 2, 0.5], "4": ["x", 0, 1, 1]}, "the dog": {"5": [0, 0, 1, 1]}}\n```')
    assert [(t["description"], t["s"], t["e"]) for t in good] == [("the dog", 5, 5)]
    cut = answers.parse_tracks('{"a": {"1": [0, 0, 1, 1], "2": [0, 0, 1')
    assert [(t["s"], t["e"]) for t in cut] == [(1, 1)] and answers.parse_tracks(None) == []
    assert answers.remap_text('{"1": [0], "3": [1], "9": [2]}', [10, 20, 30]) == '{"10": [0], "30": [1], "9": [2]}'
    for said, want in POINT_PROMPTS.items():
        assert one(spark, answers.point_prompts(F.lit(said)))[0] == want, said
    assert answers.collect_points({"3": {"point": [1, 2]}, "a": [{"frame": 4, "x": 5, "y": 6}]}) == [(3, 1.0, 2.0), (4, 5.0, 6.0)]
    nested = {"t": "7", "points": [[1, 2], {"x": "3", "y": 4}, '<point x1="5.5" y1="6">'], "in": {"8": [[0.5, 1, 9], [2]], "z": {"9": {"points": {"x": None, "y": 1}}}}}
    assert answers.collect_points(nested) == [(7, 1.0, 2.0), (7, 3.0, 4.0), (7, 5.5, 6.0), (8, 0.5, 1.0)]
    assert answers.collect_points([]) == answers.collect_points(None) == answers.collect_points({"x": 1, "y": 2}) == []
    assert answers.normalise_answer('note {"3": [0, 0, 1, 2]} end', "it") == '{"it": {"3": [0.0, 0.0, 1.0, 1.0]}}'
    m = one(spark, answers.grid_tubes(F.lit("<TEMP-001>:[<WIDTH-000><HEIGHT-099><WIDTH-099><HEIGHT-033>]"), F.array(F.lit(5), F.lit(7))))[0]
    assert list(m) == [7] and m[7] == pytest.approx([0, 1, 1, 1 / 3])
    assert tuple(one(spark, answers.frame_span(F.lit("frames 9 through 4")))[0]) == (4, 9)
    assert tuple(one(spark, answers.seconds_span(F.lit("from 2.5 s to 1")))[0]) == (1.0, 2.5)


@pytest.mark.parametrize("n", [1, 3, 5, 15])
def test_assignment(n):
    r = random.Random(n)
    m = [[r.random() for _ in range(n + 1)] for _ in range(n)]
    total = lambda p: sum(m[i][j] for i, j in p)
    got = tubes.assignment(m)
    assert len(got) == n and len({j for _, j in got}) == n
    padded = lambda i, j: m[i][j] if i < n else 0.0
    assert total(got) == pytest.approx(sum(padded(i, j) for i, j in enumerate(tubes._by_prices(n + 1, padded)) if i < n))
    assert tubes.assignment([[1.0, 1.0], [1.0, 1.0]]) == [(0, 0), (1, 1)] and tubes.assignment([]) == []


def test_multi_target(spark):
    b = {f: [0.0, 0.0, 1.0, 1.0] for f in range(3)}
    t = {"description": "x", "s": 0, "e": 2, "boxes": b}
    rows = [(1, [t, t | {"s": 9, "e": 9, "boxes": {9: [0.0, 0.0, 1.0, 1.0]}}], [t]), (2, [], []), (3, [t], [t]), (4, None, [t])]
    df = spark.createDataFrame(rows, f"id int, gt array<{tubes_schema()}>, pred array<{tubes_schema()}>")
    got = {r.id: r for r in tubes.score(df).collect()}
    assert got[1].m_vIoU == 0.5 and got[1].m_tIoU == 0.5 and got[1]["vIoU@0.5"] == 1 and got[1].match_count == 1
    assert got[2].m_vIoU == 0 and got[2].matches == [] and got[3].tIoU == 1 and got[4].m_vIoU == 0
    m = tubes.means_by_label(tubes.score(df).withColumn("difficulty_bucket", F.when(F.col("id") < 3, "easy"))).orderBy("__order").collect()
    assert [(r.group, r.num_samples) for r in m] == [("overall", 4), ("easy", 2)]
    assert tubes.means(tubes.score(df.limit(0))).collect()[0].m_vIoU == 0


def tubes_schema():
    from framewright.schemas import TRACK

    return TRACK


def brute_ap(hits, total):
    tp = fp = 0
    p, r = [], []
    for h in hits:
        tp, fp = tp + h, fp + (not h)
        p.append(tp / (tp + fp))
        r.append(tp / total)
    p, r = [0, *p, 0], [0, *r, 1]
    for i in range(len(p) - 2, -1, -1):
        p[i] = max(p[i], p[i + 1])
    return sum((r[i] - r[i - 1]) * p[i] for i in range(1, len(r)) if r[i] != r[i - 1])


def test_average_precision(spark):
    r = random.Random(3)
    rows = [(k, r.random(), r.random() < 0.4, i) for k in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "k string, s double, hit boolean, i int")
    n = spark.createDataFrame([("a", 120), ("b", 90), ("c", 5), ("d", 0)], "k string, n int")
    got = {x.k: x.ap for x in curves.interpolated_average_precision(df, ["k"], "s", "hit", n, "n", ["i"]).collect()}
    for k, total in (("a", 120), ("b", 90)):
        assert got[k] == pytest.approx(brute_ap([h for _, _, h, _ in sorted((x for x in rows if x[0] == k), key=lambda x: -x[1])], total))
    assert got["c"] == 0 and got["d"] is None


def test_segments_against_brute_force(spark):
    r = random.Random(5)
    t = [(c, v, float(s := r.randint(0, 50)), float(s + r.randint(1, 20))) for c in "xy" for v in range(3) for _ in range(4)]
    g = [(c, v, float(s := r.randint(0, 50)), float(s + r.randint(1, 20)), r.random()) for c in "xy" for v in range(4) for _ in range(8)]
    got = {(x.label, round(x.threshold, 2)): x.ap for x in detect.segment_average_precision(spark.createDataFrame(t, "label string, video int, s double, e double"), spark.createDataFrame(g, "label string, video int, s double, e double, score double"), (0.3, 0.6)).collect()}
    for c in "xy":
        for th in (0.3, 0.6):
            used, hits = set(), []
            for _, v, s, e, _ in sorted((x for x in g if x[0] == c), key=lambda x: -x[4]):
                own = [(min(e, b) - max(s, a), a, b, i) for i, (k, w, a, b) in enumerate(t) if k == c and w == v]
                iou = sorted(((max(0, n) / ((e - s) + (b - a) - max(0, n)), i) for n, a, b, i in own), reverse=True)
                hit = next((i for x, i in iou if x >= th and i not in used), None)
                used.add(hit)
                hits.append(hit is not None)
            assert got[c, th] == pytest.approx(brute_ap(hits, sum(x[0] == c for x in t)))


def test_tubes_and_linking(spark):
    f = np.arange(1, 21)
    track = np.column_stack([f, f * 1.0, f * 0.0, f + 20.0, f * 0 + 10.0])
    assert detect.tube_iou(track, track) == 1 and detect.tube_iou(track[:10], track[15:]) == 0
    frames = {int(k): np.array([[k * 1.0, 0, k + 20.0, 10, 0.9], [500, 500, 510, 510, 0.001]]) for k in f}
    out = detect.linked(frames, 20)
    assert len(out) == 1 and len(out[0][1]) == 20 and out[0][0] == pytest.approx(0.9)
    rows = [("a", "v", int(k), [float(k), 0.0, float(k + 20), 10.0], 0.9) for k in f]
    d = spark.createDataFrame(rows, "label string, video string, frame int, box array<double>, score double")
    got = detect.link_tubes(d, spark.createDataFrame([("v", 20)], "video string, n_frames int"))
    truth = spark.createDataFrame([("a", "v", got.collect()[0].tube), ("b", "v", [])], f"label string, video string, tube {detect.TUBE}").where("size(tube) > 0")
    assert detect.video_average_precision(truth, got).collect()[0].ap == 1
    e = detect.error_summary(detect.tube_errors(truth, got.withColumn("label", F.lit("b")), 0.5), truth).collect()
    assert e[0].label == "a" and e[0].missed == 100
    assert [r.error for r in detect.tube_errors(truth, got.withColumn("label", F.lit("b")), 0.5).collect()] == ["class"]
    kept = detect.suppress(np.array([[0, 0, 10, 10, 0.9], [1, 1, 10, 10, 0.8], [50, 50, 60, 60, 0.5]]), 0.3)
    assert kept[0, -1] == 0.9 and kept[1, -1] == 0.5 and kept[2, -1] < 0.3


def test_proposals(spark):
    t = spark.createDataFrame([("v", 0.0, 10.0), ("v", 20.0, 30.0), ("w", 0.0, 5.0)], "video string, s double, e double")
    p = spark.createDataFrame([("v", 0.0, 10.0, 0.9), ("v", 20.0, 30.0, 0.8), ("w", 50.0, 55.0, 0.7)], "video string, s double, e double, score double")
    s = detect.proposal_summary(detect.proposal_recall(t, p, 2.0)).collect()[0]
    assert s["AR@100"] == pytest.approx(2 / 3) and 0 < s.auc <= 100


def test_retrieval(spark):
    g = np.random.default_rng(1)
    a, b = g.normal(size=(40, 8)), g.normal(size=(40, 8))
    df = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist()) for i in range(40)], "i long, t array<double>, w array<double>")
    un = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    s = un(a) @ un(b).T
    want = {i: int((s[i] > s[i, i]).sum()) for i in range(40)}
    assert {r.i: r.above for r in retrieve.ranks(df, "i", "t", "w", block=16).collect()} == want
    q = df.select(F.col("i").alias("query_id"), F.col("t").alias("embedding"))
    d = df.select(F.col("i").alias("doc_id"), F.col("w").alias("embedding"))
    pos = df.select(F.col("i").alias("query_id"), F.col("i").alias("doc_id"))
    raw = np.round(a @ b.T, 9)
    for kind, top in (("abs", lambda x: x - 0.5), ("perc", lambda x: x * 0.9)):
        got = {}
        for r in retrieve.hard_negatives(q, d, pos, 3, 0.5 if kind == "abs" else 0.9, kind, block=16).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.doc_id)
        for i in range(40):
            ok = [j for j in np.argsort(-raw[i], kind="stable") if j != i and raw[i, j] <= round(top(raw[i, i]), 9)][:3]
            assert got.get(i, []) == ok


def test_classification(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 0)], "t int, g int")
    assert classify.mean_class_accuracy(df, "t", "g").collect()[0][0] == pytest.approx((0.5 + 1 + 0) / 3)
    m = {(r.truth, r.guess): r.value for r in classify.confusion_matrix(df, "t", "g", "true").collect()}
    assert len(m) == 9 and m[0, 0] == 0.5 and m[2, 0] == 1 and m[1, 0] == 0
    with pytest.raises(ValueError):
        classify.confusion_matrix(df, "t", "g", "other")


def test_blocks_by_keys_give_what_a_broadcast_gives(spark, monkeypatch):
    import numpy as np

    from framewright.metrics import retrieve

    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=8)], [float(x) for x in r.normal(size=8)]) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, t array<double>, w array<double>")
    t, w = (np.array([x[c] for x in rows]) for c in (1, 2))
    t, w = (m / np.sqrt((m * m).sum(axis=1, keepdims=True)) for m in (t, w))
    s = t @ w.T
    want = {i: int((s[i] > s[i, i] + 1e-12).sum()) for i in range(60)}
    for limit in (retrieve.BROADCAST_BYTES, 0):
        monkeypatch.setattr(retrieve.score_blocks, "__defaults__", (limit,))
        assert {x.k: x.above for x in retrieve.ranks(df, "k", "t", "w", block=7).collect()} == want


def test_chains_of_tubelets_take_every_tubelet_once():
    import numpy as np

    from framewright.metrics import detect

    r = np.random.default_rng(6)
    a, b = r.uniform(0, 50, (5, 3, 4)), r.uniform(0, 50, (3, 4))
    a[..., 2:] += a[..., :2]
    b[..., 2:] += b[..., :2]

    def iou(p, q):
        w, h = max(0, min(p[2], q[2]) - max(p[0], q[0])), max(0, min(p[3], q[3]) - max(p[1], q[1]))
        return w * h / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - w * h)

    chain = detect.Chain(4, b, 0.5)
    for frame, pairs in ((5, [(0, 1), (1, 2)]), (6, [(0, 2)]), (7, [(0, 2)]), (9, [(0, 2)])):
        assert np.allclose(chain.fit(frame, a), [np.mean([iou(x[i], b[j]) for i, j in pairs]) for x in a])
    frames = {f: np.array([[10 * n + f, 0, 10 * n + f + 9, 9, 10 * n + f + 1, 0, 10 * n + f + 10, 9, 0.5 + 0.1 * n] for n in (0, 3)], dtype=float) for f in range(1, 9)}
    out = detect.linked(frames, 9, 2, 3)
    assert sorted(round(s, 3) for s, _ in out) == [0.5, 0.8] and all(t[:, 0].tolist() == list(range(1, 10)) for _, t in out)
    assert np.allclose(out[0][1][:, 3] - out[0][1][:, 1], 9) and detect.linked({}, 9, 2, 3) == []


def test_pairs_are_counted_by_their_ends(spark):
    """Counts of overlapping spans of two users grow with the distinct spans, and are those of the pairs."""
    import random

    from framewright.operators import spans

    r, rows = random.Random(3), []
    for user in range(40):
        at = 0
        while at < 60:
            at += r.randint(2, 9)
            rows.append((user, r.choice("ab"), at, at := at + r.randint(0, 3)))
    rows.append((None, "a", 1, 50))
    d = spark.createDataFrame(rows, "user_id int, event_type string, s long, e long")
    got = {tuple(x)[:5]: x.pairs for x in spans.overlap_counts(d, ["event_type"], "user_id").collect()}
    want = {}
    rows = [x for x in rows if x[0] is not None]
    for i, x in enumerate(rows):
        for y in rows[:i]:
            if x[0] != y[0] and x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3]:
                key = (x[1], *min(x[2:], y[2:]), *max(x[2:], y[2:]))
                want[key] = want.get(key, 0) + 1
    assert got == want
    a = d.where("user_id is not null")
    b = a.select("event_type", F.col("user_id").alias("u2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    assert spans.overlap_join(a, b, ["event_type"], 16).where("user_id < u2").count() == sum(want.values())


def test_bins_are_as_wide_as_the_spans(spark):
    """Short spans aren't met with all of a wide bin: the join has little more rows than pairs."""
    from framewright.operators import spans

    d = spark.range(2000).select((F.col("id") % 200).alias("s"), (F.col("id") % 200).alias("e"), F.lit("k").alias("k"))
    j = spans.overlap_join(d, d.select("k", F.col("s").alias("s2"), F.col("e").alias("e2")), ["k"], 16)
    assert j.count() == 200 * 10 * 10
    assert spans.fitted_width([(d, "s", "e")], 16) == 1
    long = d.withColumn("e", F.col("s") + 90)
    assert spans.fitted_width([(d, "s", "e"), (long, "s", "e")], 16) == 16


def test_values_are_worked_out_once_for_equal_ends(spark):
    """Pairs are only written: what is said of them is worked out before items are spread, and the bins fit."""
    from framewright.operators import spans

    d = spark.range(600).select(F.lit("k").alias("k"), "id", (F.col("id") % 3).alias("s"), (F.col("id") % 3 + 1).alias("e"))
    for part in (7, 2048):
        p = spans.overlap_pairs(d, ["k"], "id", {"v": F.col("s") * 10 + F.col("s2")}, part)
        got = {(r.a, r.b): r.v for r in p.collect()}
        want = {(a, b): a % 3 * 10 + b % 3 for a in range(600) for b in range(a + 1, 600) if abs(a % 3 - b % 3) <= 1}
        assert got == want


def test_block_pairs(spark, monkeypatch):
    """Blocks, slices and lots of pairs of any size give the pairs of plain rules."""
    import random

    from framewright.operators import pairs

    r, rows, sets = random.Random(5), [], []
    for user in range(70):
        sets += [(user * 3, t) for t in r.sample("abcdefgh", r.randint(0, 4))]
        at = 0
        while at < 50:
            at += r.randint(2, 9)
            rows.append((user * 3, r.choice("xy"), at, at := at + r.randint(0, 12)))
    spans = spark.createDataFrame(rows, "u long, k string, s long, e long")
    own = {}
    for u, t in sets:
        own.setdefault(u, set()).add(t)
    shared = {(a, b): len(own[a] & own[b]) for a in own for b in own if a < b and own[a] & own[b]}
    met = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]:
                met.setdefault((a[1], a[0], b[0]), []).append((0, max(a[3], b[3]) - min(a[2], b[2]), a[2], a[3], b[2], b[3]))
    best = {(*k, *x[2:], *x[:2], n) for k, v in met.items() for n, x in enumerate(sorted(v)[:2], 1)}
    mass = {}
    for (k, a, b), v in met.items():
        for _, _, s, e, s2, e2 in v:
            if (a, b) in shared:
                n = min(e, e2) - max(s, s2) + 1
                c = (shared[a, b] / len(own[a] | own[b]) * n / (e - s + e2 - s2 + 2 - n)) ** 2
                for end in ((k, a, s, e), (k, b, s2, e2)):
                    x = mass.setdefault(end, [0, 0.0])
                    x[0], x[1] = x[0] + 1, x[1] + c
    cut = spark.createDataFrame(sets, "u long, t string")
    for block, part, lot in ((8192, 512, 1 << 20), (9, 4, 3)):
        monkeypatch.setattr(pairs, "BLOCK", block)
        monkeypatch.setattr(pairs, "SLICE", part)
        monkeypatch.setattr(pairs, "PAIRS", lot)
        got = {(x.a, x.b): (x.shared, x.na, x.nb) for x in pairs.shared_token_pairs(cut, "u", "t").collect()}
        assert got == {(a, b): (n, len(own[a]), len(own[b])) for (a, b), n in shared.items()}
        top = pairs.best_overlaps(spans, "k", "u", 2).collect()
        assert len(top) == len(best) and {tuple(x) for x in top} == best
        found = {tuple(x)[:4]: (x.rivals, x.m) for x in pairs.confusable(spans, cut, "k", "u", "t").collect()}
        assert found == {k: (n, pytest.approx(m)) for k, (n, m) in mass.items()}


@pytest.mark.parametrize("kind", ["perc", "abs"])
def test_negatives_by_label_are_those_by_pairs(spark, kind, monkeypatch):
    """A label column gives what its pairs give, without the pairs; missing labels are no positives; ties go to the smaller id."""
    r = random.Random(9)
    e = spark.createDataFrame([(i, r.choice([0, 1, 2, None]), [float(r.randint(-2, 2)) for _ in range(4)]) for i in range(90)], "id long, label int, embedding array<double>")
    q, d = e.withColumnRenamed("id", "query_id"), e.withColumnRenamed("id", "doc_id")
    pos = q.select("query_id", "label").join(d.select("doc_id", "label"), "label")
    rows = lambda x: sorted(map(tuple, x.collect()))
    for limit in (retrieve.BROADCAST_BYTES, 1):
        monkeypatch.setattr(retrieve.score_blocks, "__defaults__", (limit,))
        got = rows(retrieve.hard_negatives(q, d, "label", 4, -0.1 if kind == "abs" else 0.95, kind, block=16))
        assert got and got == rows(retrieve.hard_negatives(q, d, pos, 4, -0.1 if kind == "abs" else 0.95, kind, block=200))


def test_tubes_are_ranked_once_for_all_thresholds(spark):
    """Hits of a guess are a range of thresholds: the same as taking every threshold by itself."""
    r = random.Random(5)
    tube = lambda s, e: [(f, float(f), 0.0, f + 20.0, 10.0) for f in range(s, e)]
    span = lambda: (s := r.randint(0, 9), s + r.randint(1, 6))
    truth = [(r.choice("ab"), r.choice([1, 2, None]), tube(*span())) for _ in range(40)]
    guess = [(r.choice("abc"), r.choice([1, 2, None]), r.randint(0, 9) / 10, tube(*span())) for _ in range(60)]
    t = spark.createDataFrame(truth, f"label string, video int, tube {detect.TUBE}")
    g = spark.createDataFrame(guess, f"label string, video int, score double, tube {detect.TUBE}")
    grid = (0.1, 0.3, 0.5, 0.7, 1.0)
    got = {(x.label, x.video, x.ord, x.threshold): x.hit for x in detect.matched_tubes(t, g, grid).collect()}
    want = {}
    for key in {x[:2] for x in guess}:
        own = sorted((x for x in guess if x[:2] == key), key=lambda x: (-x[2], x[3][0][0], len(x[3])))
        other = sorted((x[2] for x in truth if x[:2] == key), key=lambda x: (x[0][0], len(x)))
        iou = np.array([[detect.tube_iou(np.array(b, float), np.array(x[3], float)) for b in other] for x in own]).reshape(len(own), len(other))
        for th in grid:
            want |= {(*key, i, th): bool(h) for i, h in enumerate(detect.best_only(iou, th))}
    assert got == want
    assert detect._tube_hits(t, g, grid).count() == len(guess)


def test_equal_answers_are_read_once(monkeypatch):
    import pandas as pd

    read, parse = [], answers.parse_tracks
    monkeypatch.setattr(answers, "parse_tracks", lambda t: read.append(t) or parse(t))
    texts = ["", None, "", '{"a": {"1": [0.1, 0.1, 0.2, 0.2]}}', ""]
    assert list(answers.tracks.__wrapped__(pd.Series(texts))) == [parse(t) for t in texts]
    assert len(read) == 3
