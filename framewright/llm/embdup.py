"""Embedding near-duplicates: exact cosine threshold pairs by dual traversal of cover trees.

On unit vectors a cosine of at least c is a distance of at most
sqrt(2 - 2c). Equal vectors fall together first. The others are dealt into
blocks by their nearest centres (farthest-first centres of a bounded sample,
more of them for more vectors; full cells are cut by the second nearest). Each
block gets a cover tree, built once: nested levels whose radii halve, as many as
its vectors ask for. Pairs of trees are traversed together: a pair of nodes is
pruned when the distance of its centres is more than both covering radii and
the threshold allow, and accepted whole when it is less by both radii; only
what remains is compared, in double precision. Pairs of blocks are pruned by the
same bound first, in tasks of their own.

Links are merged into components while they are found, so a task holds two
trees and never the links. Tasks give a count and one link to its component for
each vector, so rows grow with the vectors and not with the square of a group.
In data without near neighbours in low dimension no bound prunes, and the number
of compared pairs grows with the square of the vectors: that is the price of
an exact answer by this method.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.components import connected_components
from framewright.session import settle, shuffle_partitions

#: Vectors that a block aims at, and the number of blocks in small data.
BLOCK_ROWS, LEAST_BLOCKS = 4096, 12
#: Centres at most, and rows that they are chosen from by hash order: for each centre so many, but these at least.
MAX_CENTRES, SAMPLE_EACH, SAMPLE = 2048, 8, 2048
#: The coarsest radius of a tree; radii halve from there until a level has no more than a few rows a node.
TOP_RADIUS, ROWS_A_NODE, MOST_LEVELS = 0.6, 2, 6
#: Blocks whose middles are broadcast at once to plan the pairs, and neighbouring blocks that travel together.
PLAN_BLOCKS, TILE = 50_000, 4
_SLACK = 1e-9


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component is divided out first, so that no square over- or underflows."""
    x = rows.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def centres(x: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first rows: every prefix is a net, so the levels are nested."""
    chosen = [0]
    d = distances(x, x[:1])[:, 0]
    while len(chosen) < min(n, len(x)) and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, distances(x, x[chosen[-1] :][:1])[:, 0])
    return x[chosen]


def net(x: np.ndarray, radius: float, batch: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """(centre rows, each row's centre): centres are more than radius apart, and every row is within it of its own."""
    centre: list[int] = []
    of = np.full(len(x), -1)
    for i in range(0, len(x), batch):
        part = np.arange(i, min(i + batch, len(x)))
        if centre:
            d = distances(x[part], x[centre])
            best = d.argmin(axis=1)
            near = d[np.arange(len(part)), best] <= radius
            of[part[near]] = best[near]
        rest = part[of[part] < 0]
        if len(rest):
            d = distances(x[rest], x[rest])
            for k, r in enumerate(rest):
                if of[r] < 0:
                    new = (d[k] <= radius) & (of[rest] < 0)
                    of[rest[new]] = len(centre)
                    of[r] = len(centre)
                    centre.append(int(r))
    return np.array(centre), of


class Tree:
    """Levels of nodes over rows ordered so that every node is a run of them.

    levels[k] = (centre rows, covering radii, bounds of the children in the next level or of rows, bounds of rows).
    """

    def __init__(self, x: np.ndarray) -> None:
        order = np.arange(len(x))
        points, of_row = np.arange(len(x)), np.arange(len(x))
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        for radius in reversed(self.radii(x)):  # from the leaves up: centres of a level are among those below
            c, of = net(x[points], radius)
            points, of_row = points[c], of[of_row]
            steps.append((points, of_row))
        order = np.lexsort([of for _, of in steps])  # the coarsest level first
        self.order, self.x = order, x[order]
        self.levels = []
        below = np.arange(len(x) + 1)
        place = np.argsort(order)
        for points, label in steps:
            run = label[order]
            start = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            rows = np.append(start, len(x))
            centre = place[points[run[start]]]
            c = self.x[centre]
            gap = np.sqrt(np.maximum(((self.x - np.repeat(c, np.diff(rows), axis=0)) ** 2).sum(axis=1), 0))
            self.levels.append((centre, np.maximum.reduceat(gap, start), np.searchsorted(below, rows), rows))
            below = rows
        self.levels.reverse()

    def packed(self) -> bytes:
        return pickle.dumps((self.x, self.levels), 5)

    @classmethod
    def unpacked(cls, b: bytes) -> Tree:
        t = cls.__new__(cls)
        t.x, t.levels = pickle.loads(b)
        return t

    def down_to(self, depth: int) -> list:
        """The levels, and below them as many of single rows as are wanted."""
        n = len(self.x)
        return self.levels + [(np.arange(n), np.zeros(n), np.arange(n + 1), np.arange(n + 1))] * (depth - len(self.levels))

    @staticmethod
    def radii(x: np.ndarray) -> list[float]:
        """Halving radii, three at least, and on while the rows of a sample still share nodes with many others."""
        some = x[:: max(1, len(x) // 256)]
        gaps = distances(some, some)
        out = [TOP_RADIUS / 2**k for k in range(3)]
        while len(out) < MOST_LEVELS and np.median((gaps <= out[-1]).sum(axis=1)) * (len(x) / len(some)) > ROWS_A_NODE * 16:
            out.append(out[-1] / 2)
        return out


def merge(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of the pairs (a, b); up[i] leads to the first row of i's component, in place."""
    while len(a):
        ra, rb = up[a], up[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(further := up[up], up):
            up[:] = further


def _children(pairs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All pairs of children of pairs of nodes."""
    na, nb = a[pairs[:, 0] + 1] - a[pairs[:, 0]], b[pairs[:, 1] + 1] - b[pairs[:, 1]]
    n = na * nb
    which = np.repeat(np.arange(len(pairs)), n)
    k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return np.stack([a[pairs[which, 0]] + k // nb[which], b[pairs[which, 1]] + k % nb[which]], axis=1)


def dual(p: Tree, q: Tree, cosine: float, same: bool, weight_p: np.ndarray, weight_q: np.ndarray, lot: int = 1 << 19):
    """Linked weights of both trees' rows, and for each row of p, then of q, the first row of its component.

    Rows and weights are in tree order. With same, p is q: its rows don't link
    with themselves and stand once.
    """
    eps = float(np.sqrt(max(2.0 - 2.0 * cosine, 0.0)))
    count_p, count_q = np.zeros(len(p.x), dtype=np.int64), np.zeros(len(q.x), dtype=np.int64)
    shift = 0 if same else len(p.x)
    up = np.arange(len(p.x) + (0 if same else len(q.x)))
    sums_p, sums_q = np.append(0, np.cumsum(weight_p)), np.append(0, np.cumsum(weight_q))
    depth = max(len(p.levels), len(q.levels))
    levels_p, levels_q = p.down_to(depth), q.down_to(depth)

    def whole_runs(runs: list[tuple[int, int, int, int]]) -> None:
        """All of two runs are linked: a star joins them."""
        ends: list[np.ndarray] = []
        for a0, a1, b0, b1 in runs:
            count_p[a0:a1] += sums_q[b1] - sums_q[b0]
            ends.append(np.stack([np.arange(a0, a1), np.full(a1 - a0, b0 + shift)]))
            if not same:
                count_q[b0:b1] += sums_p[a1] - sums_p[a0]
                ends.append(np.stack([np.full(b1 - b0, a0), np.arange(b0, b1) + shift]))
        if ends:
            merge(up, *np.concatenate(ends, axis=1))

    def leaf(pairs: np.ndarray) -> None:
        for i in range(0, len(pairs), lot // 8):
            a, b = pairs[i : i + lot // 8].T
            on = (p.x[a] * q.x[b]).sum(axis=1) >= cosine
            a, b = a[on], b[on]
            np.add.at(count_p, a, weight_q[b])
            if not same:
                np.add.at(count_q, b, weight_p[a])
            merge(up, a, b + shift)

    def descend(level: int, pairs: np.ndarray) -> None:
        ca, ra, _, rows_a = levels_p[level]
        cb, rb, _, rows_b = levels_q[level]
        ca, cb = p.x[ca], q.x[cb]
        for i in range(0, len(pairs), lot):
            part = pairs[i : i + lot]
            keep, whole = [], []
            for j in range(0, len(part), lot // 8):
                a, b = part[j : j + lot // 8].T
                d = np.sqrt(np.maximum(2.0 - 2.0 * (ca[a] * cb[b]).sum(axis=1), 0.0))
                r = ra[a] + rb[b]
                near = d <= eps + r + _SLACK
                # equal vectors are one row, so a run of several rows is linked whole only if all are within eps of each other
                inside = near & (d + r <= eps - 1e-7)
                keep.append(part[j : j + lot // 8][near & ~inside])
                whole.append(part[j : j + lot // 8][inside])
            whole_runs([(rows_a[a], rows_a[a + 1], rows_b[b], rows_b[b + 1]) for a, b in np.concatenate(whole).tolist()])
            rest = np.concatenate(keep)
            if len(rest):
                expand(level, rest)

    def expand(level: int, rest: np.ndarray) -> None:
        ka, kb = levels_p[level][2], levels_q[level][2]
        n = (ka[rest[:, 0] + 1] - ka[rest[:, 0]]) * (kb[rest[:, 1] + 1] - kb[rest[:, 1]])
        start, total = 0, np.cumsum(n)
        while start < len(rest):
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + lot, "right")))
            some = _children(rest[start:end], ka, kb)
            if level + 1 < depth:
                descend(level + 1, some)
            else:
                leaf(some)
            start = end

    # the top levels meet in one matrix product, in strips
    ca, ra = levels_p[0][:2]
    cb, rb = levels_q[0][:2]
    ca, cb = p.x[ca], q.x[cb]
    for i in range(0, len(ca), 512):
        near = np.argwhere(distances(ca[i : i + 512], cb) <= eps + ra[i : i + 512, None] + rb[None] + _SLACK)
        if len(near):
            near[:, 0] += i
            descend(0, near)
    if same:
        count_p -= weight_p  # every vector is linked with itself
    return count_p, count_q, up


def _valid(vec):
    """Non-null arrays of finite numbers that aren't all nought."""
    ok = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vec.isNotNull() & F.coalesce(ok, F.lit(False)) & F.exists(vec, lambda v: v != 0)


def _assign(reps: DataFrame, shared, kind: str) -> DataFrame:
    """(node, w, cell, second, vec): the two nearest centres of every vector, which comes as a unit vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                x = unit(np.asarray(part.column(2).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(part.num_rows, -1))
                d = distances(x, c)
                cell = d.argmin(axis=1)
                d[np.arange(len(x)), cell] = np.inf
                second = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell.astype(np.int32)), pa.array(second.astype(np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], names=["node", "w", "cell", "second", "vec"])

    return reps.select("node", "w", "vec").mapInArrow(run, f"node {kind}, w long, cell int, second int, vec binary")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, block_rows: int = BLOCK_ROWS, least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """(id, n_links, component_id, kept), one row for each row of df.

    Vectors with a cosine of at least the threshold are linked. Null or zero
    vectors and those with null or non-finite components are linked with
    nothing; vectors of different lengths aren't compared. Rows with one id count
    as rows; a null id is linked with nothing and kept. An empty table gives no
    rows. Finite magnitudes of any size are compared.
    """
    spark = df.sparkSession
    kind, n_parts = dict(df.dtypes)[id_col], shuffle_partitions(spark)
    own = df.select(df[id_col].alias("__id"), df[vec_col].cast("array<double>").alias("vec"))
    ok = F.coalesce(_valid(F.col("vec")), F.lit(False)) & F.col("__id").isNotNull()
    # vectors travel once; equal ones are known by 128 bits from here on
    good = own.where(ok).withColumn("__a", F.xxhash64("vec")).withColumn("__b", F.xxhash64(F.lit(1), "vec"))
    reps = settle(good.groupBy("__a", "__b").agg(F.min("__id").alias("node"), F.count("*").alias("w"), F.first("vec").alias("vec")))
    sizes = [r[0] for r in reps.select(F.size("vec")).distinct().collect()]  # one, as a rule
    alone = F.col("__id").alias("__comp")
    rest = own.where(~ok).select("__id", F.lit(0).cast("long").alias("__n"), alone)
    if sizes:
        found = settle(reduce(DataFrame.union, [_links(reps.where(F.size("vec") == d), d, cosine, kind, n_parts, block_rows, least_blocks) for d in sizes]))
        linked = connected_components(found, "node", "root")
        counts = found.groupBy("node").agg(F.sum("c").alias("c"))
        at = reps.select("__a", "__b", "node", "w").join(counts, "node", "left").join(linked, "node", "left").select("__a", "__b", (F.col("w") - 1 + F.coalesce("c", F.lit(0))).alias("__n"), F.coalesce("component", "node").alias("__comp"))
        rest = good.select("__id", "__a", "__b").join(at, ["__a", "__b"]).select("__id", "__n", "__comp").union(rest)
    return rest.select(F.col("__id").alias(id_col), F.col("__n").cast("long").alias("n_links"), F.col("__comp").alias("component_id"), F.coalesce(F.col("__id") == F.col("__comp"), F.lit(True)).alias("kept"))


def _links(reps: DataFrame, dims: int, cosine: float, kind: str, n_parts: int, block_rows: int, least_blocks: int) -> DataFrame:
    """(node, c, root): linked weight beside the vector's own copies, and a linked node."""
    spark = reps.sparkSession
    total = reps.count()
    want = max(least_blocks, -(-total // block_rows))
    n_centres = min(MAX_CENTRES, want)
    sample = [r.vec for r in reps.orderBy("__a", "__b").limit(max(SAMPLE, SAMPLE_EACH * n_centres)).select("vec").collect()]
    c = centres(unit(np.array(sample)), n_centres)
    cells = settle(_assign(reps, spark.sparkContext.broadcast(c), kind))
    # blocks of like size, however full a cell is: cells are cut by the second nearest centre, and what is still too full by hash
    each = max(1, total // want)
    few_parts = lambda n, size: F.greatest(F.lit(1), F.bround(F.col(n) / size)).cast("int")
    sizes = F.broadcast(cells.groupBy("cell").agg(F.count("*").alias("n")).select("cell", few_parts("n", each).alias("parts")))  # MAX_CENTRES rows at most
    dealt = cells.join(sizes, "cell").withColumn("part", F.pmod(F.col("second"), F.col("parts")))
    if total > MAX_CENTRES * block_rows:  # a row for each block
        full = settle(dealt.groupBy("cell", "part").agg(F.count("*").alias("n")).select("cell", "part", few_parts("n", 2 * each).alias("cuts")))
        dealt = dealt.join(full, ["cell", "part"])
    else:
        full = F.broadcast(dealt.groupBy("cell", "part").agg(F.count("*").alias("n")).select("cell", "part", few_parts("n", 2 * each).alias("cuts")))
        dealt = dealt.join(full, ["cell", "part"])
    dealt = dealt.withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each run of a block: its tree with the nodes in tree order, its middle and radius."""
        key, nodes, ws, vecs = None, [], [], []

        def done():
            x = np.frombuffer(b"".join(vecs), dtype=np.float64).reshape(len(vecs), dims)
            t = Tree(x)
            mean = x.mean(axis=0)
            length = np.sqrt((mean * mean).sum())
            mid = mean / length if length > 0 else x[0]
            order = t.order.tolist()
            return pa.RecordBatch.from_arrays([pa.array([[nodes[i] for i in order]], pa.list_(types[0])), pa.array([[ws[i] for i in order]], pa.list_(pa.int64())), pa.array([t.packed()], pa.binary()), pa.array([mid.tobytes()], pa.binary()), pa.array([float(distances(x, mid[None]).max())]), pa.array([key[0]], pa.int32())], names=["nodes", "ws", "tree", "mid", "radius", "cell"])

        types: list = []
        for b in batches:
            types[:] = [b.column(3).type]
            for *at, node, w, v in zip(*[col.to_pylist() for col in b.columns]):
                if at != key or len(vecs) >= 2 * block_rows:
                    if vecs:
                        yield done()
                    key, nodes, ws, vecs = at, [], [], []
                nodes.append(node)
                ws.append(w)
                vecs.append(v)
        if vecs:
            yield done()

    by = ["cell", "part", "cut"]
    sorted_rows = dealt.select(*by, "node", "w", "vec").repartition(n_parts, *by).sortWithinPartitions(*by, "node")
    planted = sorted_rows.mapInArrow(plant, f"nodes array<{kind}>, ws array<long>, tree binary, mid binary, radius double, cell int")
    planted = settle(planted.withColumn("run", F.monotonically_increasing_id()))
    plan = settle(_plan(planted.select("run", "cell", "mid", "radius"), dims, cosine))
    sent = planted.drop("mid", "radius", "cell").join(plan, "run").repartition(n_parts, "pair").sortWithinPartitions("pair", "run")

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        types: list = []

        def done() -> Iterator[pa.RecordBatch]:
            trees = {run: (Tree.unpacked(tree), nodes, np.array(ws, dtype=np.int64)) for run, (nodes, ws, tree, _) in held.items()}
            for run, (*_, partners) in held.items():
                for other in partners:
                    (p, np_, wp), (q, nq, wq) = trees[run], trees[other]
                    same = run == other
                    cp, cq, root = dual(p, q, cosine, same, wp, wq)
                    nodes = np_ if same else np_ + nq
                    counts = cp if same else np.concatenate([cp, cq])
                    low: dict = {}
                    for i, r in enumerate(root.tolist()):
                        low[r] = min(low.get(r, nodes[i]), nodes[i])
                    on = np.flatnonzero(counts > 0).tolist()
                    if on:
                        yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in on], types[0]), pa.array(counts[on], pa.int64()), pa.array([low[int(root[i])] for i in on], types[0])], names=["node", "c", "root"])

        pair = None
        for b in batches:
            types[:] = [b.column(2).type.value_type]
            for i in range(b.num_rows):  # a row is a tree
                k, run, nodes, ws, tree, partners = (col[i].as_py() for col in b.columns)
                if k != pair:
                    yield from done()
                    pair, held = k, {}
                held[run] = nodes, ws, tree, partners
        yield from done()

    return sent.select("pair", "run", "nodes", "ws", "tree", "partners").mapInArrow(traverse, f"node {kind}, c long, root {kind}")


def _plan(runs: DataFrame, dims: int, cosine: float) -> DataFrame:
    """(pair, run, partners): the pairs of tiles, with the blocks that meet there.

    Neighbouring blocks are a tile. partners are the later blocks of the pair,
    itself included, that the covering bound can't keep from a block. Every task
    holds its own blocks' middles against a broadcast part of all.
    """
    spark = runs.sparkSession
    eps = float(np.sqrt(max(2.0 - 2.0 * cosine, 0.0)))
    ids = [r.run for r in runs.select("cell", "run").orderBy("cell", "run").collect()]  # a number for each block_rows vectors
    size = max(1, min(TILE, len(ids) // 16))
    numbers = spark.sparkContext.broadcast({r: i for i, r in enumerate(ids)})

    def against(lo: int) -> DataFrame:
        part = ids[lo : lo + PLAN_BLOCKS]
        found = {r.run: r for r in runs.where(F.col("run").isin(part) if len(ids) > PLAN_BLOCKS else F.lit(True)).collect()}
        rows = [found[i] for i in part]
        shared = spark.sparkContext.broadcast((np.array(part, dtype=np.int64), np.array([np.frombuffer(r.mid) for r in rows]).reshape(len(rows), dims), np.array([r.radius for r in rows])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            other, mids, radii = shared.value
            number = numbers.value
            for b in batches:
                for k, mid, radius in zip(*[c.to_pylist() for c in b.columns]):
                    me = number[k]
                    at = np.arange(lo, lo + len(other))
                    near = (distances(np.frombuffer(mid)[None], mids)[0] <= eps + radius + radii + _SLACK) & (at >= me) | (at == me)
                    tiles: dict[int, list[int]] = {}
                    for i in np.flatnonzero(near).tolist():
                        tiles.setdefault((lo + i) // size, []).append(int(other[i]))
                    out = []
                    for t, partners in tiles.items():
                        pair = (me // size << 31) + t
                        out.append((pair, k, partners))
                        out += [(pair, o, []) for o in partners if o != k]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int64()))], names=["pair", "run", "partners"])

        return runs.select("run", "mid", "radius").mapInArrow(run, "pair long, run long, partners array<long>")

    rows = reduce(DataFrame.union, [against(i) for i in range(0, len(ids), PLAN_BLOCKS)])
    return rows.groupBy("pair", "run").agg(F.flatten(F.collect_list("partners")).alias("partners"))  # TILE partners at most
