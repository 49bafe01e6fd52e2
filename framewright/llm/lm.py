"""Language-model scoring with a log-frequency Bloom filter.

Training counts words and pairs of words of the whole training text. A count
is quantised to q = 1 + floor(log_b count), and the n-gram is put into a Bloom
filter together with each of 1..q; probing 1, 2, .. until the first miss gives
q back, never less and rarely more. Probabilities are interpolated from the
counts that the probes stand for.

Counts travel as packed arrays: every task sums up its n-grams and deals them by
hash into slices, whose number follows the bytes of the training text, so a
slice and what a task gathers for it are of bounded size. Each slice becomes a
filter of its own size beside the exact word counts (for the base score). Slices
are broadcast in segments of at most SEGMENT_BYTES. One pass over the texts
probes all of them, one segment after the other for each chunk of text, so a
worker holds one segment and two bytes a token of the chunk, and the bits an
n-gram gets don't depend on the size of the corpus. All segments lie on every
executor's disk: that is the bound of a filter that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import fold_of, map_text
from framewright.llm.features import segment_sum
from framewright.llm.textbytes import NON_SPACE, Powers, buffer_of, counts_by_doc, mix, pieces, words
from framewright.session import settle, shuffle_partitions

#: Bytes of filters and counts that one broadcast holds, and of training text that a slice stands for.
SEGMENT_BYTES, SLICE_BYTES = 48 << 20, 4 << 20
#: Parts that a segment comes to the driver in.
LOADERS = 8
#: Tasks that gather slices at most; beyond it a task gathers several, one after the other.
MOST_TASKS = 20_000
#: Bytes of text that are probed in one go: with one segment, and with several that are loaded for each chunk.
CHUNK, LARGE_CHUNK = 2 << 20, 6 << 20
BITS_PER_ENTRY, PROBES, BASE = 10, 5, 1.5
#: Entries that a task sums up before it sends or keeps them, and tokens, so that their counts fit into 32 bits.
PENDING, PENDING_TOKENS = 1_500_000, 1 << 31
#: Weight of the word's own probability against a history's count.
BACKOFF = 4.0
END = mix(np.array([0x5EED], dtype=np.uint64))[0]
_PAIR, _STEP = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_Q_MAX = 120


def quantise(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def _meaning() -> np.ndarray:
    """The count that a quantised one stands for: the middle of the whole numbers it covers; 0 for none."""
    out = [0.0]
    for q in range(1, _Q_MAX + 2):
        lo, hi = np.ceil(BASE ** (q - 1) - 1e-9), np.ceil(BASE**q - 1e-9) - 1
        out.append(float((lo + max(lo, hi)) / 2))
    return np.array(out)


def _stream(texts: pa.Array, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, an end after each text, and the bounds."""
    raw, offs = buffer_of(texts)
    s, _, h = words(raw, offs, NON_SPACE, powers)
    b = counts_by_doc(s, offs)
    return np.insert(h, b[1:], END), b + np.arange(len(b))


def _pairs(tokens: np.ndarray) -> np.ndarray:
    """A key for every token with the one before it; a text's first follows an end."""
    return mix(np.append(END, tokens[:-1]) * _PAIR + tokens)


def _slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


class Filter:
    """One slice: bits in words of 8, sized by its own entries."""

    @staticmethod
    def build(keys: np.ndarray, q: np.ndarray) -> np.ndarray:
        size = max(64, int(q.sum()) * BITS_PER_ENTRY)
        bits = np.zeros(-(-size // 8), dtype=np.uint8)
        m = np.uint64(len(bits) * 8)
        for j in range(1, int(q.max(initial=0)) + 1):
            k = keys[q >= j]
            for p in range(PROBES):
                at = Filter.place(k, j, p, m)
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        return bits

    @staticmethod
    def place(keys: np.ndarray, j: int, p: int, m: np.ndarray | np.uint64) -> np.ndarray:
        x = mix(keys * _STEP + np.uint64(j * PROBES + p + 1))
        return (x >> np.uint64(32)) * m >> np.uint64(32)


class Segment:
    """Neighbouring slices [lo, hi) with their filters in one array and their exact word counts."""

    def __init__(self, lo: int, slices: int, filters: list[np.ndarray], keys: list[np.ndarray], counts: list[np.ndarray]) -> None:
        self.lo, self.hi, self.slices = lo, lo + len(filters), slices
        self.bits = np.concatenate(filters) if filters else np.zeros(8, dtype=np.uint8)
        size = np.array([len(f) for f in filters], dtype=np.int64)
        self.size = (size * 8).astype(np.uint64)
        self.start = ((np.cumsum(size) - size) * 8).astype(np.uint64)
        self.keys = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, dtype=np.uint64)

    def mine(self, keys: np.ndarray) -> np.ndarray:
        """Which keys this segment knows about; None if all."""
        s = _slice_of(keys, self.slices)
        return (s >= self.lo) & (s < self.hi)

    def quantised(self, keys: np.ndarray, lot: int = 1 << 17) -> np.ndarray:
        """Repeated membership probes: 1, 2, .. until the first miss."""
        return np.concatenate([self._probe(keys[i : i + lot]) for i in range(0, len(keys), lot)] or [np.zeros(0, dtype=np.uint8)])

    def _probe(self, keys: np.ndarray) -> np.ndarray:
        q = np.zeros(len(keys), dtype=np.uint8)
        s = _slice_of(keys, self.slices) - self.lo
        start, size = self.start[s], self.size[s]
        on = np.arange(len(keys))
        for j in range(1, _Q_MAX):
            for p in range(PROBES):
                at = start[on] + Filter.place(keys[on], j, p, size[on])
                hit = (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
                on = on[hit.astype(bool)]
                if not len(on):
                    return q
            q[on] = j
        return q

    def exact(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0).astype(np.int64)


def count_slices(train: DataFrame, text_col: str, slices: int) -> DataFrame:
    """(slice, n, v, keys, counts, filter), a row for each slice that has n-grams."""

    own = train.select(train[text_col].alias("__text"))

    def emit(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        cut = np.searchsorted(_slice_of(keys, slices), np.arange(slices + 1))
        on = np.flatnonzero(np.diff(cut))
        part = lambda a, s: a[cut[s] : cut[s + 1]].tobytes()
        small = counts.astype(np.uint32)
        return pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(np.full(len(on), kind), pa.int32()), pa.array([part(keys, s) for s in on], pa.binary()), pa.array([part(small, s) for s in on], pa.binary())], names=["slice", "kind", "keys", "counts"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        held: dict[int, list] = {1: [], 2: []}
        size = total = 0
        for b in batches:
            for i, n in pieces(b.column(0)):
                tokens, _ = _stream(b.column(0).slice(i, n), powers)
                total += len(tokens)
                for kind, keys in ((1, tokens), (2, _pairs(tokens))):
                    held[kind].append(np.unique(keys, return_counts=True))
                    size += len(held[kind][-1][0])
                if size >= PENDING or total >= PENDING_TOKENS:
                    for kind, v in held.items():
                        yield emit(kind, *_summed(np.concatenate([k for k, _ in v]), np.concatenate([c for _, c in v])))
                    held, size, total = {1: [], 2: []}, 0, 0
        for kind, v in held.items():
            if v:
                yield emit(kind, *_summed(np.concatenate([k for k, _ in v]), np.concatenate([c for _, c in v])))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, list] = {1: [], 2: []}
        size = 0
        at: int | None = None

        def compact() -> None:
            for kind, v in state.items():
                if len(v) > 1:
                    state[kind] = [_summed(np.concatenate([k for k, _ in v]), np.concatenate([c for _, c in v]))]

        def done() -> pa.RecordBatch:
            compact()
            none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
            (k1, c1), (k2, c2) = (state[kind][0] if state[kind] else none for kind in (1, 2))
            # words and pairs share the filter: their keys are hashes of different things
            bits = Filter.build(np.concatenate([k1, k2]), np.minimum(quantise(np.concatenate([c1, c2])), _Q_MAX - 1))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([int(c1.sum())], pa.int64()), pa.array([len(k1)], pa.int64()), pa.array([k1.tobytes()], pa.binary()), pa.array([c1.astype(np.uint64).tobytes()], pa.binary()), pa.array([bits.tobytes()], pa.binary())], names=["slice", "n", "v", "keys", "counts", "filter"])

        for b in batches:
            for s, kind, k, c in zip(*[col.to_pylist() for col in b.columns]):
                if s != at:
                    if at is not None:
                        yield done()
                    at, state, size = s, {1: [], 2: []}, 0
                state[kind].append((np.frombuffer(k, dtype=np.uint64), np.frombuffer(c, dtype=np.uint32).astype(np.int64)))
                size += len(k) // 8
                if size >= PENDING:
                    compact()
                    size = 0
        if at is not None:
            yield done()

    n = max(shuffle_partitions(train.sparkSession), min(slices, MOST_TASKS))
    dealt = own.mapInArrow(tally, "slice int, kind int, keys binary, counts binary").repartition(n, "slice").sortWithinPartitions("slice", "kind")
    return dealt.mapInArrow(gather, "slice int, n long, v long, keys binary, counts binary, filter binary")


def _segments(table: DataFrame, slices: int, limit: int):
    """Segments one after the other; each is loaded when it is asked for."""
    sizes = {r.slice: r.b for r in table.select("slice", (F.length("keys") + F.length("counts") + F.length("filter")).alias("b")).collect()}
    cuts, size, lo = [], 0, 0
    for s in range(slices):
        if size and size + sizes.get(s, 0) > limit:
            cuts.append((lo, s))
            lo, size = s, 0
        size += sizes.get(s, 0)
    cuts.append((lo, slices))

    def load(lo: int, hi: int) -> Segment:
        rows = {r.slice: (np.frombuffer(r.filter, dtype=np.uint8), np.frombuffer(r.keys, dtype=np.uint64), np.frombuffer(r["counts"], dtype=np.uint64)) for r in table.where((F.col("slice") >= lo) & (F.col("slice") < hi)).select("slice", "keys", "counts", "filter").coalesce(LOADERS).toLocalIterator()}
        none = (np.zeros(8, dtype=np.uint8), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64))
        got = [rows.get(s, none) for s in range(lo, hi)]
        return Segment(lo, slices, *map(list, zip(*got)))

    return (load(*c) for c in cuts)


def interpolated(q_word: np.ndarray, q_pair: np.ndarray, q_history: np.ndarray, n: int, v: int) -> np.ndarray:
    """log10 probability of every token from quantised counts."""
    means = _meaning()
    own = (means[q_word] + 1.0) / (n + v + 1.0)
    history = means[q_history]
    rest = BACKOFF / (history + BACKOFF)
    follow = np.minimum(means[q_pair] / np.maximum(history, 1.0), 1.0)
    return np.log10((1.0 - rest) * follow + rest * np.minimum(own, 1.0))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: tuple[int, int] = (7, 2), segment_bytes: int = SEGMENT_BYTES, slices: int | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text.

    Texts outside the held-out fold are the training text. A null text is
    empty: its one token is the end. Repeated rows are counted and returned as
    often as they stand; an empty table gives no rows.
    """
    spark = docs.sparkSession
    out = fold_of(docs[id_col], held[0]) == held[1]
    train = docs.where(~out)
    if not slices:
        size = train.agg(F.sum(F.octet_length(docs[text_col]).cast("long"))).collect()[0][0] or 0
        slices = max(64, -(-size // SLICE_BYTES))
    table = settle(count_slices(train, text_col, slices))
    n, v = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).collect()[0]
    shared = [spark.sparkContext.broadcast(x) for x in _segments(table, slices, segment_bytes)]
    several = len(shared) > 1
    own = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text"), out.alias("__held"))

    def setup():
        powers = Powers()

        def work(b: pa.RecordBatch) -> pa.RecordBatch:
            tokens, bounds = _stream(b.column("__text"), powers)
            kinds, of = np.unique(tokens, return_inverse=True)
            pair = _pairs(tokens)
            exact, q1 = np.zeros(len(kinds), dtype=np.int64), np.zeros(len(kinds), dtype=np.uint8)
            q2 = np.zeros(len(pair), dtype=np.uint8)
            for one in shared:
                segment: Segment = one.value
                on = segment.mine(kinds)
                exact[on], q1[on] = segment.exact(kinds[on]), segment.quantised(kinds[on])
                on = segment.mine(pair)
                q2[on] = segment.quantised(pair[on])
                if several:
                    del segment
                    one.__dict__.pop("_value", None)  # it is read from the executor's disk for the next chunk
            size = np.diff(bounds)
            base = segment_sum(np.log10(exact + 1.0)[of], bounds) - size * np.log10(n + v + 1.0)
            known = segment_sum((exact > 0).astype(np.float64)[of], bounds).astype(np.int64)
            word = q1[of]
            end = word[bounds[1] - 1] if len(bounds) > 1 else np.uint8(0)  # the end's own count
            logs = interpolated(word, q2, np.append(end, word[:-1]), n, v)
            return pa.RecordBatch.from_arrays([b.column("__id"), b.column("__held"), pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(size), n), pa.int64()), pa.array(base), pa.array(segment_sum(logs, bounds))], names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        return work

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return map_text(own, {x: x for x in own.columns}, "__text", setup, schema, LARGE_CHUNK if several else CHUNK)
