"""MinHash near-duplicates with an LSH forest, links confirmed on full shingle sets.

1. Equal sets fall together by a 128-bit hash; one document stands for each set.
2. The forest: every set has TREES labels of DEPTH MinHash values, the roots of
   its regions. Two sets of similarity 0.8 share a region with probability
   1 - 5e-5. Only sets that share one go on.
3. Their signatures are sorted in several orders. Neighbours with the longest
   common prefixes are the candidates: the sorted rows are cut where the common
   prefix of two neighbours is shortest, so that a region of the order goes as
   deep as its density asks for, and the sets of a region are compared in full.
4. What the sorted orders left apart: in every region of the forest the sets of
   different components are held against each other by whole signatures. Where
   a pair can be alike, one of its sets goes to the other's region of the first
   sorted order and is compared with all full sets there. So no pair of a region
   is left out that could join two components, whatever its size.

Large regions of the forest are dealt into blocks; only sets outside a region's
largest component travel to other blocks, as signatures. Near copies are nearly
all in that component after step 3. Rows grow with (such sets) x (blocks), never
with the pairs: that is the price of an exact answer for many sets that share
their smallest hashes and still aren't alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import map_text
from framewright.llm.textbytes import NON_SPACE, Powers, buffer_of, counts_by_doc, mix, words
from framewright.operators.components import connected_components
from framewright.session import few, settle, shuffle_partitions

TREES, DEPTH = 25, 5
HASHES = TREES * DEPTH
#: Sorted orders, the rows of a region of an order at most, and the bytes of sets that a task holds for one.
BLOCK, ORDERS, HELD_BYTES = 256, 3, 24 << 20
#: Sets of a forest's region that are held against each other at once.
LOT = 1024
#: Members with their sets that a task takes at least.
MEMBERS = 2000
#: Ids that may be broadcast after they were counted; beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS = mix(_SEEDS + np.uint64(99)) | np.uint64(1)


def shingle_sets(texts: pa.Array, powers: Powers, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of k neighbouring words; of all words where there are fewer, of none if none."""
    raw, offs = buffer_of(texts)
    s, _, h = words(raw, offs, NON_SPACE, powers)
    b = counts_by_doc(s, offs)
    roll = np.zeros(len(h), dtype=np.uint64)
    if len(h) >= k:
        n = len(h) - k + 1
        for j in range(k):
            roll[:n] = mix(roll[:n] * np.uint64(0x9E3779B97F4A7C15) + h[j : n + j])
    out = []
    for i in range(len(b) - 1):
        lo, hi = int(b[i]), int(b[i + 1])
        if hi - lo >= k:
            out.append(np.unique(roll[lo : hi - k + 1]))
        elif hi > lo:
            x = np.zeros(1, dtype=np.uint64)
            for j in range(lo, hi):
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + h[j])
            out.append(mix(x + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signatures(sets: list[np.ndarray], run: int = 1 << 15) -> np.ndarray:
    """(sets, HASHES) of 16 bits each; all sets have members."""
    out = np.empty((len(sets), HASHES), dtype=np.uint16)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= run):
            size += len(sets[j])
            j += 1
        flat = mix(np.concatenate(sets[i:j]))
        at = np.cumsum([0] + [len(x) for x in sets[i : j - 1]])
        buf = np.empty_like(flat)
        for f in range(HASHES):
            np.bitwise_xor(flat, _SEEDS[f], out=buf)
            np.multiply(buf, _FACTORS[f], out=buf)
            out[i:j, f] = (mix(np.minimum.reduceat(buf, at)) >> np.uint64(48)).astype(np.uint16)
        i = j
    return out


def sort_key(sig: np.ndarray, order: int) -> bytes:
    """A signature as the text that one of the forest's orders sorts by."""
    return np.roll(sig, -order * DEPTH)[:16].astype(">u2").tobytes()


def bucket_ids(sigs: np.ndarray) -> np.ndarray:
    """(rows, TREES): hash of each tree's first DEPTH values."""
    out = np.empty((len(sigs), TREES), dtype=np.uint64)
    for t in range(TREES):
        h = np.full(len(sigs), t + 1, dtype=np.uint64)
        for j in range(t * DEPTH, (t + 1) * DEPTH):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sigs[:, j])
        out[:, t] = h
    return out


def links(sets: list[np.ndarray], percent: int = 80, columns: int = 8192) -> np.ndarray:
    """Rows (i, j), i < j, with 100 * intersection >= percent * union, by counts over shared members."""
    n = len(sets)
    if n < 2:
        return np.zeros((0, 2), dtype=np.int64)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    col = np.cumsum(new) - 1
    shared = np.bincount(col)[col] > 1
    col, owner = col[shared], owner[shared]
    inter = np.zeros((n, n), dtype=np.float32)
    if len(col):
        _, col = np.unique(col, return_inverse=True)
        cuts = np.searchsorted(col, np.arange(0, col[-1] + columns + 1, columns))
        for k in range(len(cuts) - 1):
            c, o = col[cuts[k] : cuts[k + 1]], owner[cuts[k] : cuts[k + 1]]
            if len(c):
                m = np.zeros((n, int(c[-1]) - k * columns + 1), dtype=np.float32)
                m[o, c - k * columns] = 1
                inter += m @ m.T
    inter = inter.astype(np.int64)
    union = size[:, None] + size[None] - inter
    i, j = np.nonzero((100 * inter >= percent * union) & (union > 0))
    keep = i < j
    return np.stack([i[keep], j[keep]], axis=1)


def roots(n: int, pairs: np.ndarray) -> list[int]:
    """For each of n rows the first row of its component."""
    up = list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def _described(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(__id, __n, __a, __b, __sig): set size, 128-bit hash of the set and signature of every row."""

    def setup():
        powers = Powers()

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(b.column("__text"), powers, k)
            full = [i for i, s in enumerate(sets) if len(s)]
            sig: list[bytes | None] = [None] * len(sets)
            keys = np.zeros((2, len(sets)), dtype=np.uint64)
            if full:
                some = [sets[i] for i in full]
                for i, row in zip(full, signatures(some)):
                    sig[i] = row.tobytes()
                flat = np.concatenate(some)
                at = np.cumsum([0] + [len(x) for x in some[:-1]])
                for j in range(2):
                    keys[j, full] = np.add.reduceat(mix(flat + np.uint64(1 + j)), at)
            cols = [b.column("__id"), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(x.view(np.int64)) for x in keys], pa.array(sig, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["__id", "__n", "__a", "__b", "__sig"])

        return work

    return map_text(docs, {"__id": id_col, "__text": text_col}, "__text", setup, f"__id {dict(docs.dtypes)[id_col]}, __n long, __a long, __b long, __sig binary")


def _labels(sets: DataFrame, kind: str) -> DataFrame:
    """(bucket, node): a row for each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                if part.num_rows:
                    sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint16).reshape(part.num_rows, HASHES)
                    node = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), TREES)))
                    yield pa.RecordBatch.from_arrays([pa.array(bucket_ids(sigs).ravel().view(np.int64)), node], names=["bucket", "node"])

    return sets.select("node", "__sig").mapInArrow(run, f"bucket long, node {kind}")


def _edges(pairs: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], kind), pa.array([p[1] for p in pairs], kind)], names=["u", "v"])


def prefix_lengths(keys: list[bytes]) -> np.ndarray:
    """Values that each key has in common with the next one."""
    k = np.frombuffer(b"".join(keys), dtype=">u2").reshape(len(keys), -1)
    return np.logical_and.accumulate(k[1:] == k[:-1], axis=1).sum(axis=1)


def region_end(keys: list[bytes], block: int) -> int:
    """Rows of the first region of sorted keys, block at most: the cut is at the shortest common prefix, the last of those."""
    if len(keys) <= block:
        return len(keys)
    common = prefix_lengths(keys[: block + 1])
    return len(common) - int(common[::-1].argmin())


def _neighbours(members: DataFrame, order: int, kind: str, block: int, percent: int, parts: int, n_members: int) -> DataFrame:
    """Edges (u, v, region) inside the regions of one sorted order, each from the first row of its component there.

    region is the region's first node; every row has at least one edge, be it to itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, types = 0, []

        def compared(n: int) -> list[tuple]:
            rows = held[:n]
            del held[:n]
            to = roots(n, links([np.frombuffer(r[2], dtype=np.uint64) for r in rows], percent))
            return [(rows[j][1], rows[i][1], rows[0][1]) for i, j in enumerate(to)]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, types[0]) for c in zip(*rows)], names=["u", "v", "region"])

        for b in batches:
            types[:] = [b.column(1).type]
            out: list[tuple] = []
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if held and row == held[-1]:  # repeated rows of one id
                    continue
                held.append(row)
                size += len(row[2])
                if len(held) >= 2 * block or size >= HELD_BYTES:
                    out += compared(region_end([r[0] for r in held], max(1, min(block, len(held) // 2))))
                    size = sum(len(r[2]) for r in held)
            if out:
                yield batch(out)
        while held:
            yield batch(compared(region_end([r[0] for r in held], block)))

    key = f"k{order}"
    rows = few(members.select(key, "node", "set").repartitionByRange(parts, key, "node"), n_members, MEMBERS)
    return rows.sortWithinPartitions(key, "node").mapInArrow(run, f"u {kind}, v {kind}, region {kind}")


def _member_sets(docs: DataFrame, nodes: DataFrame, n_nodes: int, id_col: str, text_col: str, k: int, kind: str) -> DataFrame:
    """(node, set, k0, k1, ..): the full sets of the nodes, with a key for each order."""
    own = docs.select(docs[id_col].alias("node"), docs[text_col].alias("__text"))
    keys = [f"k{o}" for o in range(ORDERS)]

    def setup():
        powers = Powers()

        def work(b: pa.RecordBatch) -> pa.RecordBatch | None:
            sets = shingle_sets(b.column("__text"), powers, k)
            full = [i for i, s in enumerate(sets) if len(s)]
            if not full:
                return None
            sets = [sets[i] for i in full]
            sigs = signatures(sets)
            cols = [b.column("node").take(pa.array(full)), pa.array([s.tobytes() for s in sets], pa.binary())]
            cols += [pa.array([sort_key(s, o) for s in sigs], pa.binary()) for o in range(ORDERS)]
            return pa.RecordBatch.from_arrays(cols, names=["node", "set", *keys])

        return work

    both = own.join(F.broadcast(nodes) if n_nodes <= BROADCAST_IDS else nodes, "node")
    return map_text(both, {"node": "node", "__text": "__text"}, "__text", setup, f"node {kind}, set binary, " + ", ".join(f"{c} binary" for c in keys))


def least_matches(percent: int) -> int:
    """Equal signature values that a pair of the asked similarity has but for a chance of 1e-5."""
    p = percent / 100
    return max(1, int(np.floor(HASHES * p - 4.4 * np.sqrt(HASHES * p * (1 - p)))))


def _alike(rows: DataFrame, kind: str, percent: int) -> DataFrame:
    """(node, region): where a set of another component may be alike by size and signature.

    rows: (bucket, block, guest, far, node, comp, region, size, sig), sorted by
    the first three. A block's own rows are compared with each other and with
    its guests, which pass in lots, so a task holds one block and one lot. Of a
    pair it is the one outside the main component that travels.
    """
    least = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list = []
        key, own, lot = None, [], []
        ready: list[tuple] = []  # pairs whose signatures wait for comparison
        found: set[tuple] = set()

        def compare() -> None:
            if ready:
                a, b = (np.frombuffer(b"".join(r[x][8] for r in ready), dtype=np.uint16).reshape(-1, HASHES) for x in (0, 1))
                for i in np.flatnonzero((a == b).sum(axis=1) >= least).tolist():
                    x, y = ready[i]
                    x, y = (x, y) if x[3] else (y, x)
                    found.add((x[4], y[6]))
                ready.clear()

        def pair_up(left: list[tuple], right: list[tuple] | None) -> None:
            second = left if right is None else right
            if not left or not second:
                return
            comps = {c: i for i, c in enumerate({r[5] for r in left} | {r[5] for r in second})}
            ca, cb = (np.array([comps[r[5]] for r in x]) for x in (left, second))
            na, nb = (np.array([r[7] for r in x]) for x in (left, second))
            on = (ca[:, None] != cb[None]) & (100 * np.minimum(na[:, None], nb[None]) >= percent * np.maximum(na[:, None], nb[None]))
            if right is None:
                on = np.triu(on, 1)
            for i, j in np.argwhere(on).tolist():
                ready.append((left[i], second[j]))
                if len(ready) >= 1 << 14:
                    compare()

        def batch() -> pa.RecordBatch:
            rows = sorted(found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[x] for r in rows], types[0]) for x in (0, 1)], names=["node", "region"])

        def end_block() -> None:
            pair_up(lot, own)
            pair_up(own, None)

        for b in batches:
            types[:] = [b.column(4).type]
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if row[:2] != key:
                    end_block()
                    key, own, lot = row[:2], [], []
                if row[2]:
                    lot.append(row)
                    if len(lot) >= LOT:
                        pair_up(lot, own)
                        lot = []
                else:
                    own.append(row)
            if len(found) > 1 << 12:
                yield batch()
        end_block()
        compare()
        if found:
            yield batch()

    return rows.select("bucket", "block", "guest", "far", "node", "comp", "region", "size", "sig").mapInArrow(run, f"node {kind}, region {kind}")


def shared_members(one: np.ndarray, values: np.ndarray, starts: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many members a set shares with each of n sets, given as their distinct values with the owners of each."""
    at = np.minimum(np.searchsorted(values, one), len(values) - 1)
    at = at[values[at] == one]
    m = starts[at + 1] - starts[at]
    return np.bincount(owner[np.repeat(starts[at] - np.cumsum(m) + m, m) + np.arange(m.sum())], minlength=n)


def _visits(rows: DataFrame, kind: str, percent: int) -> DataFrame:
    """Edges between visiting sets and the sets of a region, one for each component there.

    rows: (region, guest, node, comp, set), sorted by the first two: a region's own sets come first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, index = None, [], None
        for b in batches:
            out: set[tuple] = set()
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if row[0] != key:
                    key, own, index = row[0], [], None
                if not row[1]:
                    if not own or row != own[-1]:
                        own.append(row)
                    continue
                if not own:
                    continue
                if index is None:
                    sets = [np.frombuffer(r[4], dtype=np.uint64) for r in own]
                    size = np.array([len(x) for x in sets])
                    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
                    order = np.argsort(flat, kind="stable")
                    flat, owner = flat[order], owner[order]
                    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
                    index = flat[first], np.append(first, len(flat)), owner, len(sets)
                x = np.frombuffer(row[4], dtype=np.uint64)
                inter = shared_members(x, *index)
                on = np.flatnonzero(100 * inter >= percent * (len(x) + size - inter))
                # one link to each component will do
                out.update((row[2], v) for v in {own[i][3]: own[i][2] for i in on.tolist() if own[i][3] != row[3]}.values())
            if out:
                yield _edges(sorted(out), b.column(2).type)

    return rows.select("region", "guest", "node", "comp", "set").mapInArrow(run, f"u {kind}, v {kind}")


def _apart(forest: DataFrame, places: DataFrame, reps: DataFrame, members: DataFrame, kind: str, n: int, n_nodes: int, percent: int, lot: int) -> DataFrame | None:
    """Links between sets of one region of the forest that are in different components so far.

    forest: (bucket, node); places: (node, comp, region) of every node.
    """
    comp = settle(forest.join(places, "node"))
    mixed = comp.groupBy("bucket", "comp").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("rows"), F.count("*").alias("k")).where("k > 1").drop("k")
    blocks = F.ceil(F.col("rows") / lot).cast("int")
    at = comp.join(mixed, "bucket").join(reps.select("node", F.col("__n").alias("size"), F.col("__sig").alias("sig")), "node")
    at = settle(at.select("bucket", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), blocks.alias("blocks"), (F.col("comp") != F.col("main")).alias("far"), "node", "comp", "region", "size", "sig"))
    total, most = at.agg(F.count("*"), F.max("blocks")).collect()[0]
    if not total:
        return None
    cols = ["far", "node", "comp", "region", "size", "sig"]
    rows = at.select("bucket", "block", F.lit(0).alias("guest"), *cols)
    if most > 1:
        sent = at.where("far and blocks > 1").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("to <> block")
        rows = rows.union(sent.select("bucket", F.col("to").alias("block"), F.lit(1).alias("guest"), *cols))
    rows = few(rows.repartition(n, "bucket", "block"), total, 10 * MEMBERS).sortWithinPartitions("bucket", "block", "guest")
    visits = settle(_alike(rows, kind, percent).distinct())
    n_visits = visits.count()
    if not n_visits:
        return None
    sets = members.select("node", "set").join(places, "node")
    guests = visits.join(sets.drop("region"), "node").select("region", F.lit(1).alias("guest"), "node", "comp", "set")
    hosts = sets.join(visits.select("region").distinct(), "region", "left_semi").select("region", F.lit(0).alias("guest"), "node", "comp", "set")
    both = few(hosts.union(guests).repartition(n, "region"), n_visits + n_nodes, MEMBERS).sortWithinPartitions("region", "guest", "node")
    return settle(_visits(both, kind, percent))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, block: int = BLOCK, lot: int = LOT) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row for each row of docs.

    Texts whose sets of k-word shingles have at least percent hundredths in
    common are linked; component_id is the smallest id reachable. A text of
    fewer words is one shingle; a null or blank text has none and is linked with
    nothing. Rows with the same id are one document; a null id is linked with
    nothing and kept. An empty table gives no rows.
    """
    spark = docs.sparkSession
    kind, n = dict(docs.dtypes)[id_col], shuffle_partitions(spark)
    base = settle(_described(docs, id_col, text_col, k))
    real = base.where("__n > 0 and __id is not null")
    # copies fall together before anything is shuffled
    reps = settle(real.groupBy("__a", "__b").agg(F.min("__id").alias("node"), F.first("__n").alias("__n"), F.first("__sig").alias("__sig")))
    labels = settle(_labels(reps, kind))
    shared = labels.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("tail")).where("head <> tail").select("bucket")
    forest = settle(labels.join(shared, "bucket"))
    nodes = settle(forest.select("node").distinct())
    n_nodes = nodes.count()
    linked = None
    if n_nodes:
        members = settle(_member_sets(docs, nodes, n_nodes, id_col, text_col, k, kind))
        edges = [_neighbours(members, o, kind, block, percent, n, n_nodes) for o in range(ORDERS)]
        edges[0] = settle(edges[0])
        linked = settle(connected_components(reduce(DataFrame.union, edges)))
        # equal ids with different sets stand in several regions of the order
        places = edges[0].select(F.col("v").alias("node"), "region").distinct().join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("comp"), "region")
        more = _apart(forest, settle(places), reps, members, kind, n, n_nodes, percent, lot)
        if more is not None:
            linked = connected_components(linked.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    found = reps.join(linked, "node", "left").select("__a", "__b", F.coalesce("component", "node").alias("__c")) if linked is not None else reps.select("__a", "__b", F.col("node").alias("__c"))
    full = base.withColumn("__real", (F.col("__n") > 0) & F.col("__id").isNotNull())
    # sets of nothing stay out of the join: they would all meet at one key
    joined = full.where("__real").join(found, ["__a", "__b"]).select("__id", "__n", "__c").union(full.where("not __real").select("__id", "__n", F.col("__id").alias("__c")))
    return joined.select(F.col("__id").alias(id_col), F.col("__n").alias("n_shingles"), F.col("__c").alias("component_id"), F.coalesce(F.col("__id") == F.col("__c"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, with the smallest id of every group of near duplicates.

    Repeated rows of a kept id all stay: they are one document.
    """
    found = near_duplicates(docs, id_col, text_col, k, percent)
    gone = settle(found.where("not kept").select(F.col(id_col).alias("__gone")).distinct())
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    names = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = f"c{names.index(id_col)}"
    return own.join(gone, own[at] == F.col("__gone"), "left_anti").toDF(*names)
