import random

import pytest

from framewright.llm import neardup
from framewright.operators.components import connected_components


def brute(rows, k, percent=80):
    """Components by comparing all pairs of full sets."""
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split() if t else []
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets[i] = s
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, n_base=12, copies=30):
    r = random.Random(seed)
    word = lambda: "w%d" % r.randint(0, 5000)
    rows, i = [], 0
    for b in range(n_base):
        base = [word() for _ in range(r.choice([3, 6, 20, 80, 200]))]
        for _ in range(r.choice([1, 2, 5, copies])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = word()
            rows.append((i, " ".join(w) if r.random() < 0.9 else " ".join(w).upper()))
            i += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block,lot", [(1, 256, 1024), (2, 8, 4), (3, 3, 2)])
def test_against_brute_force(spark, seed, block, lot):
    rows = corpus(seed) + [(10_000, None), (10_001, ""), (10_002, "  "), (10_003, "one"), (10_004, "ONE"), (10_005, "x " * 3000)]
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4, block=block, lot=lot).collect()}
    want = brute(rows, 4)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_nulls_repeats_clashes_and_empty(spark):
    rows = [(1, "a b c d e f", 7), (1, "a b c d e f", 7), (2, "A b c d e f", 8), (None, "a b c d e f", 9), (None, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((r.doc_id is None, r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect() if r.doc_id)
    assert got == [(False, 1, 1, True), (False, 1, 1, True), (False, 2, 1, False)]
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "None", "None"]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    n = 60
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (5, 5), (None, 3)], "u long, v long")
    got = dict(connected_components(e).collect())
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100}


def test_regions_are_cut_at_the_shortest_prefix():
    key = lambda *v: b"".join(x.to_bytes(2, "big") for x in v)
    keys = [key(1, 1, 1), key(1, 1, 2), key(1, 2, 1), key(2, 1, 1), key(2, 1, 2), key(2, 2, 1)]
    assert neardup.prefix_lengths(keys).tolist() == [2, 1, 0, 2, 1]
    assert [neardup.region_end(keys, b) for b in (6, 5, 3, 2, 1)] == [6, 3, 3, 2, 1]
    assert neardup.region_end([key(7, 7)] * 5, 3) == 3  # no shorter prefix anywhere


def test_many_of_one_template_stay_apart(spark):
    """Texts that share 60 hundredths of their words fill regions without being alike."""
    r = random.Random(7)
    rows = []
    for i in range(150):
        w = ["t%d" % j for j in range(120)]
        at = r.randrange(60)
        w[at : at + 60] = ["u%d_%d" % (i, j) for j in range(60)]
        rows.append((i, " ".join(w)))
    rows.append((500, rows[3][1] + " end"))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), lot=16, block=16).collect()}
    assert got == brute(rows, 5)


def test_recall_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, k=4).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 4)


def test_connected_pairs_are_exact():
    import numpy as np

    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 50)).astype(np.uint64)) for _ in range(60)]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 50 * len(np.union1d(sets[i], sets[j]))}
    assert {tuple(x) for x in neardup.links(sets, percent=50, columns=16).tolist()} == want
