"""Benchmark decontamination by Wu-Manber search over words.

The test strings are windows of benchmark words. A table of blocks (two
neighbouring words) says how far the search may shift: a block that stands in
no test string skips nearly a whole window, so most words are never looked
at. Where the shift is nought, the hash of the last words selects a bucket of
test strings, and all their words are compared directly.

The tables hold words as 64-bit ids; what they let pass is confirmed byte by
byte. Many texts are searched in step, each in segments that overlap by a
window. A benchmark too large for one pass takes several; the driver holds one
pass's tables at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import map_rows, map_text
from framewright.llm.textbytes import ALNUM, Powers, buffer_of, counts_by_doc, mix, words
from framewright.session import settle

WINDOW = 13
SEGMENT = 256
#: Benchmark bytes that one pass holds; a larger benchmark takes several passes over the documents.
PASS_BYTES = 16 << 20
_K = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of texts: bytes with A-Z lowered, starts, ends, ids (hash and length in one), and the texts' bounds."""

    def __init__(self, texts: pa.Array, powers: Powers) -> None:
        self.raw, offs = buffer_of(texts)
        self.start, self.end, h = words(self.raw, offs, ALNUM, powers)
        self.ids = h ^ mix((self.end - self.start).astype(np.uint64))
        self.bounds = counts_by_doc(self.start, offs)

    def same(self, at: np.ndarray, other: Words, of: np.ndarray) -> np.ndarray:
        """Whether the words at and the other's words are equal byte by byte."""
        size, s, t = self.end[at] - self.start[at], self.start[at], other.start[of]
        out = size == other.end[of] - t
        for i in range(0, len(at), 1 << 16):
            part = slice(i, i + (1 << 16))
            on = np.flatnonzero(out[part]) + i
            n = size[on]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a, b = self.raw[np.repeat(s[on], n) + k], other.raw[np.repeat(t[on], n) + k]
            bad = (a + 32 * ((a >= 65) & (a <= 90))) != (b + 32 * ((b >= 65) & (b <= 90)))
            out[np.repeat(on, n)[bad]] = False
        return out


class Patterns:
    """Test strings of one length with their shift table and suffix buckets.

    first: the place of each row's first word among the words of the benchmark.
    """

    def __init__(self, rows: np.ndarray, items: np.ndarray, first: np.ndarray) -> None:
        self.length = rows.shape[1]
        self.b = min(2, self.length)
        order = np.lexsort(rows.T[::-1])
        rows, items, first = rows[order], items[order], first[order]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        self.rows, self.first = rows[new], first[new]
        of = np.cumsum(new) - 1
        self.item_of, self.first_item = items, np.append(np.searchsorted(of, np.arange(len(self.rows))), len(items))
        blocks, shifts = [], []
        for end in range(self.b - 1, self.length):
            blocks.append(self._block(self.rows[:, end - 1] if self.b == 2 else None, self.rows[:, end]))
            shifts.append(np.full(len(self.rows), self.length - 1 - end))
        blocks, shifts = np.concatenate(blocks), np.concatenate(shifts)
        order = np.lexsort((shifts, blocks))
        blocks, shifts = blocks[order], shifts[order]
        keep = np.ones(len(blocks), dtype=bool)
        keep[1:] = blocks[1:] != blocks[:-1]
        self.blocks, self.shifts, self.skip = blocks[keep], shifts[keep], self.length - self.b + 1
        self.tail = min(4, self.length)
        suffix = self._suffix(self.rows[:, -self.tail :])
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.by_suffix = suffix[order], order

    @staticmethod
    def _block(a: np.ndarray | None, b: np.ndarray) -> np.ndarray:
        return b if a is None else mix(a * _K + b)

    @staticmethod
    def _suffix(rows: np.ndarray) -> np.ndarray:
        h = np.zeros(len(rows), dtype=np.uint64)
        for j in range(rows.shape[1]):
            h = mix(h * _K + rows[:, j])
        return h

    def find(self, text: Words, source: Words) -> tuple[np.ndarray, np.ndarray]:
        """(last word, pattern) of all occurrences."""
        ids, bounds = text.ids, text.bounds
        lo, hi = bounds[:-1] + self.length - 1, bounds[1:]
        n = np.maximum(0, -(-(hi - lo) // SEGMENT))
        doc = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        pos = lo[doc] + k * SEGMENT
        end = np.minimum(pos + SEGMENT, hi[doc])
        found = []
        while len(pos):
            block = self._block(ids[pos - 1] if self.b == 2 else None, ids[pos])
            at = np.minimum(np.searchsorted(self.blocks, block), len(self.blocks) - 1)
            shift = np.where(self.blocks[at] == block, self.shifts[at], self.skip)
            found.append(pos[shift == 0])
            pos = pos + np.maximum(shift, 1)
            going = pos < end
            pos, end = pos[going], end[going]
        ends = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        out_e, out_p = [], []
        for i in range(0, len(ends), 1 << 16):
            e = ends[i : i + (1 << 16)]
            h = self._suffix(ids[e[:, None] + np.arange(1 - self.tail, 1)])
            a, b = np.searchsorted(self.suffix, h, "left"), np.searchsorted(self.suffix, h, "right")
            m = b - a
            e = np.repeat(e, m)
            p = self.by_suffix[np.repeat(a, m) + np.arange(len(e)) - np.repeat(np.cumsum(m) - m, m)]
            for j in range(self.length - 1, -1, -1):  # direct comparison, word by word: ids first, then bytes
                same = ids[e - (self.length - 1 - j)] == self.rows[p, j]
                e, p = e[same], p[same]
            for j in range(self.length):
                same = text.same(e - (self.length - 1 - j), source, self.first[p] + j)
                e, p = e[same], p[same]
            out_e.append(e)
            out_p.append(p)
        z = np.zeros(0, dtype=np.int64)
        return (np.concatenate(out_e), np.concatenate(out_p)) if out_e else (z, z)


def compile_patterns(texts: list[str | None], window: int = WINDOW) -> tuple[Words, list[Patterns]]:
    """The benchmark's words and pattern sets by length; items are given by their place in texts."""
    source = Words(pa.array(texts, pa.large_string()), Powers())
    by: dict[int, list] = {}
    for k in range(len(texts)):
        lo, hi = source.bounds[k], source.bounds[k + 1]
        if hi > lo:
            size = min(window, hi - lo)
            rows = np.lib.stride_tricks.sliding_window_view(source.ids[lo:hi], size)
            by.setdefault(size, []).append((rows, np.full(len(rows), k), lo + np.arange(len(rows))))
    return source, [Patterns(*(np.concatenate(x) for x in zip(*v))) for _, v in sorted(by.items())]


def _passes(bench: DataFrame, id_col: str, text_col: str, window: int, pass_bytes: int):
    """(broadcast of (item ids as text, words, patterns), whether it is the last), each of about pass_bytes of benchmark text.

    Made when asked for, so the driver holds one. Equal ids are one item: it
    occurs if a window of any of its rows does.
    """
    rows = bench.select(bench[id_col].cast("string").alias("i"), bench[text_col].cast("string").alias("t")).where("i is not null and t is not null")
    shared = lambda part: bench.sparkSession.sparkContext.broadcast(([i for i, _ in part], *compile_patterns([t for _, t in part], window)))
    part, size = [], 0
    for r in rows.toLocalIterator():
        if size >= pass_bytes:
            yield shared(part), False
            part, size = [], 0
        part.append((r.i, r.t))
        size += len(r.t.encode())
    yield shared(part), True


def _search(shared, powers: Powers, texts: pa.Array):
    """Word ids' bounds, which words are hit, and the (text, item) pairs."""
    _, source, sets = shared
    text = Words(texts, powers)
    cover = np.zeros(len(text.ids) + 1, dtype=np.int32)
    docs, items = [], []
    for p in sets:
        e, k = p.find(text, source)
        if len(e):
            np.add.at(cover, e - p.length + 1, 1)
            np.add.at(cover, e + 1, -1)
            m = p.first_item[k + 1] - p.first_item[k]
            items.append(p.item_of[np.repeat(p.first_item[k], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)])
            docs.append(np.repeat(np.searchsorted(text.bounds, e, "right") - 1, m))
    hit = np.cumsum(cover[:-1]) > 0
    pairs = np.unique(np.stack([np.concatenate(docs), np.concatenate(items)]), axis=1) if docs else np.zeros((2, 0), dtype=np.int64)
    return text.bounds, hit, pairs


def _names(n: int, pairs: np.ndarray, item_ids: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[] for _ in range(n)]
    for d, i in pairs.T.tolist():
        out[d].append(item_ids[i])
    return out


def scan(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(id, n_words, n_hit, items array<string> sorted) of every document.

    A null text has no words; repeated rows give repeated rows; an empty
    benchmark hits nothing; items without words occur nowhere.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = "__id " + kind + ", __text string, __hit binary, items array<string>"
    state = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text"), F.lit(None).cast("binary").alias("__hit"), F.lit(None).cast("array<string>").alias("items"))
    for shared, last in _passes(bench, item_col, item_text, window, pass_bytes):

        def setup(shared=shared, last=last):
            powers = Powers()

            def work(b: pa.RecordBatch) -> pa.RecordBatch:
                texts = b.column("__text")
                bounds, hit, pairs = _search(shared.value, powers, texts)
                names = _names(len(texts), pairs, shared.value[0])
                before, had = b.column("__hit").to_pylist(), b.column("items").to_pylist()
                names = [sorted({*a, *(o or ())}) for a, o in zip(names, had)]
                for i, h in enumerate(before):
                    if h is not None:
                        n = bounds[i + 1] - bounds[i]
                        hit[bounds[i] : bounds[i + 1]] |= np.unpackbits(np.frombuffer(h, dtype=np.uint8), count=n).astype(bool)
                found = pa.array(names, pa.list_(pa.string()))
                if not last:
                    packed = [np.packbits(hit[bounds[i] : bounds[i + 1]]).tobytes() for i in range(len(texts))]
                    return pa.RecordBatch.from_arrays([b.column("__id"), texts, pa.array(packed, pa.binary()), found], names=["__id", "__text", "__hit", "items"])
                total = np.append(0, np.cumsum(hit))
                n_hit = total[bounds[1:]] - total[bounds[:-1]]
                return pa.RecordBatch.from_arrays([b.column("__id"), pa.array(np.diff(bounds), pa.int64()), pa.array(n_hit, pa.int64()), found], names=[id_col, "n_words", "n_hit", "items"])

            return work

        out = f"`{id_col}` {kind}, n_words long, n_hit long, items array<string>" if last else schema
        state = map_text(state, {x: x for x in ("__id", "__text", "__hit", "items")}, "__text", setup, out)
        if not last:
            state = settle(state)
            shared.destroy()
    return state


def report(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated): hit words are at least a twentieth."""
    found = scan(docs, bench, id_col, **options)
    n = F.size("items").cast("long")
    bad = (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
    return found.select(id_col, "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), bad.alias("contaminated"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs, all columns, without contaminated rows.

    A benchmark of several passes is searched by scan() on a row number first.
    """
    shared, only = next(_passes(bench, item_col, item_text, window, pass_bytes))
    if not only:
        shared.destroy()
        own = settle(docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).withColumn("__row", F.monotonically_increasing_id()))
        at = f"c{docs.columns.index(text_col)}"
        bad = scan(own, bench, "__row", at, item_col, item_text, window, pass_bytes).where("n_hit > 0 and n_hit * 20 >= n_words").select("__row")
        return own.join(bad, "__row", "left_anti").drop("__row").toDF(*docs.columns)

    def setup():
        powers = Powers()

        def work(b: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
            bounds, hit, _ = _search(shared.value, powers, texts)
            total = np.append(0, np.cumsum(hit))
            n_hit = total[bounds[1:]] - total[bounds[:-1]]
            return b.filter(pa.array(~((n_hit > 0) & (n_hit * 20 >= np.diff(bounds)))))

        return work

    return map_rows(docs, text_col, setup)


def items_sha256(items: list[str]) -> str:
    """What report() gives for a list of item ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
