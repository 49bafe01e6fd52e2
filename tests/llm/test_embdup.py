import numpy as np
import pytest

from framewright.llm import embdup


def brute(rows, cosine=0.95):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    up = {i: i for i, _ in rows if i is not None}
    n = dict.fromkeys(up, 0)
    x = embdup.unit(np.array([v for _, v in ok], dtype=np.float64))
    on = x @ x.T >= cosine

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, (i, _) in enumerate(ok):
        for b in np.flatnonzero(on[a]).tolist():
            if a != b:
                n[i] += 1
                p, q = find(i), find(ok[b][0])
                up[max(p, q)] = min(p, q)
    return {i: (n[i], find(i)) for i in up}


def vectors(seed, dims=16):
    r = np.random.default_rng(seed)
    out = []
    for k in range(40):
        base = r.normal(size=dims)
        for _ in range([1, 2, 7, 60][k % 4]):
            out.append((base + r.normal(size=dims) * r.choice([0.0, 0.01, 0.1, 0.25])).astype(np.float32))
    r.shuffle(out)
    return [(i, [float(x) for x in v]) for i, v in enumerate(out)]


@pytest.mark.parametrize("seed,rows,blocks", [(1, 4096, 3), (2, 64, 12)])
def test_against_brute_force(spark, seed, rows, blocks):
    v = vectors(seed) + [(5000, None), (5001, [0.0] * 16), (5002, [None] + [1.0] * 15), (5003, [float("nan")] + [1.0] * 15), (5004, [float("inf")] * 16), (5005, [])]
    got = embdup.near_duplicates(spark.createDataFrame(v, "vec_id long, embedding array<float>"), block_rows=rows, least_blocks=blocks).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(v)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got) and len(got) == len(v)


def test_small_cases(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, [2.0, 0.0], 3), (3, [1.0, 0.0, 0.0], 4)], "vec_id long, embedding array<double>, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embdup.near_duplicates(df).collect()}
    assert got == {None: (0, None, True), 1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True)}
    assert embdup.near_duplicates(df.limit(0)).count() == 0
    assert embdup.near_duplicates(df.where("vec_id = 99")).count() == 0


@pytest.mark.parametrize("cosine", [0.95, 0.8, 0.999999])
def test_traversal_finds_exactly_the_pairs(cosine):
    x = embdup.unit(np.array([v for _, v in vectors(5)]))
    x = np.unique(x, axis=0)
    t = embdup.Tree(x)
    w = np.ones(len(x), dtype=np.int64)
    count, _, root = embdup.dual(t, t, cosine, True, w, w, lot=64)
    on = t.x @ t.x.T >= cosine
    assert (count == on.sum(axis=1) - 1).all() and root.tolist() == first_rows(on)
    a, b = embdup.Tree(x[::2]), Shallow(x[1::2])
    ca, cb, root = embdup.dual(a, b, cosine, False, w[::2], w[1::2])
    on = a.x @ b.x.T >= cosine
    assert (ca == on.sum(axis=1)).all() and (cb == on.sum(axis=0)).all()
    n, m = on.shape
    assert root.tolist() == first_rows(np.block([[np.eye(n, dtype=bool), on], [on.T, np.eye(m, dtype=bool)]]))


class Shallow(embdup.Tree):
    """A tree of another depth."""

    radii = staticmethod(lambda x: [0.6, 0.3])


def first_rows(on):
    """The first row of every row's component."""
    at = list(range(len(on)))
    for _ in on:
        new = [min(at[j] for j in np.flatnonzero(on[i])) if on[i].any() else at[i] for i in range(len(on))]
        if new == at:
            break
        at = new
    return at


def test_levels_go_on_where_rows_are_dense():
    r = np.random.default_rng(3)
    assert len(embdup.Tree.radii(embdup.unit(r.normal(size=(500, 32))))) == 3
    assert len(embdup.Tree.radii(embdup.unit(1 + r.normal(size=(2000, 8)) * 0.01))) > 3


def test_magnitudes_do_not_matter(spark):
    rows = [(1, [1e200, 1e200]), (2, [1.0, 1.0]), (3, [1e-200, 1e-200]), (4, [5e-324, 5e-324]), (5, [1e308, -1e308]), (6, [0.0, -0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embdup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6)}


def test_many_blocks_and_centres(spark):
    v = vectors(9)
    got = embdup.near_duplicates(spark.createDataFrame(v + [(9000, v[0][1])] * 3, "vec_id long, embedding array<float>"), block_rows=20, least_blocks=5).collect()
    want = brute(v + [(9000 + k, v[0][1]) for k in range(3)])
    assert {r.vec_id: r.n_links for r in got} == {i: n for i, (n, _) in want.items() if i < 9001}
