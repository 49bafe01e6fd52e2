"""JSON documents of any size: the entries of one object or array that fills a file, without the document in one row.

The text is read in the blocks that Spark's reader makes. A first pass says for
each block how it changes the state (inside a string, depth); from these few
numbers a block's state at its start is known, and a second pass cuts it into
entries. An entry that lies across blocks is put together from its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.session import settle

_ESCAPE = re.compile(rb"\\.", re.S)
_BLOCKS = "file string, start long, head string, inside boolean, out_depth long, in_depth long"
_PIECES = "file string, start long, part int, whole boolean, ends boolean, value string"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """(file, start, text) of consecutive rows of one block."""
    for b in batches:
        files, starts, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()
        i = 0
        while i < len(files):
            j = i
            while j < len(files) and files[j] == files[i] and starts[j] == starts[i]:
                j += 1
            yield files[i], starts[i], b"".join(t + b"}" for t in texts[i:j])
            i = j


def _scan(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, whether an odd number of quotes lies before each, steps of depth), as if the text started outside a string."""
    plain = _ESCAPE.sub(b"__", text) if b"\\" in text else text
    a = np.frombuffer(plain, dtype=np.uint8)
    odd = np.cumsum(a == 34, dtype=np.int64) % 2 == 1
    step = ((a == 123) | (a == 91)).astype(np.int8) - ((a == 125) | (a == 93)).astype(np.int8)
    return a, odd, step


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block: its first character, whether its quotes are odd, its depth if it starts outside or inside a string."""
    found: dict[tuple, list] = {}
    for file, start, text in _chunks(batches):
        x = found.setdefault((file, start), ["", False, 0, 0])
        x[0] = x[0] or text.lstrip(b" \t\r\n\xef\xbb\xbf")[:1].decode("latin-1")
        _, odd, step = _scan(text)
        out, inn = int(step[~odd].sum()), int(step[odd].sum())
        if x[1]:
            out, inn = inn, out
        x[2] += out
        x[3] += inn
        x[1] ^= bool(len(odd) and odd[-1])
    rows = [(*k, *v) for k, v in found.items()]
    yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(("file", "start", "head", "inside", "out_depth", "in_depth"), (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64())))})


def _states(rows: list, opening: str) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """(inside, depth, depth of an entry's end) at the start of every block of the files that are whole documents."""
    out = {}
    by_file: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["file"], r["start"])):
        by_file.setdefault(r["file"], []).append(r)
    for file, blocks in by_file.items():
        head = next((r["head"] for r in blocks if r["head"]), "")
        if head not in ("{", opening):
            continue
        inside, depth, mine = False, 0, {}
        for r in blocks:
            mine[file, r["start"]] = (inside, depth, 1 if head == opening else 0)
            depth += r["in_depth"] if inside else r["out_depth"]
            inside ^= r["inside"]
        if not inside and depth in (0, -1):  # the last piece has an end put to it, also where the file goes on with a line's end
            out |= mine
    return out


def _cutter(states):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now, left, inside, depth, level, part, over = states.value, None, [], False, 0, 1, 0, False

        def row(rows: list, text: bytes, whole: bool, ends: bool) -> None:
            rows.append((*now, part, whole, ends, text.decode("utf-8", "replace")))

        def flush(rows: list) -> None:
            if now in known and left and not over:
                row(rows, b"".join(left), False, False)

        def batch(rows: list) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["file", "start", "part", "whole", "ends", "value"])

        for file, start, text in _chunks(batches):
            rows: list[tuple] = []
            if (file, start) != now:
                flush(rows)
                now, left, part, over = (file, start), [], 0, False
                if now in known:
                    inside, depth, level = known[now]
                    over = depth == 0 and start > 0
            if now in known and not over:
                a, odd, step = _scan(text)
                outside = odd if inside else ~odd
                deep = depth + np.cumsum(np.where(outside, step, 0), dtype=np.int64)
                # the outer bracket is no part of an entry; the first one opens the document
                ends = np.flatnonzero(outside & (((a == 44) & (deep == level)) | ((deep == 0) & (step < 0))))
                last = 0
                if depth == 0 and level == 1:
                    last = int(np.argmax(deep == 1)) + 1 if (deep == 1).any() else len(text)
                for k in ends.tolist():
                    closes = deep[k] == 0
                    left.append(text[last : k + (closes and level == 0)])
                    # the first end of a later block belongs to what the block before began
                    row(rows, b"".join(left), part > 0 or start == 0, True)
                    left, last, part = [], k + 1, part + 1
                    if closes:
                        over = True
                        break
                if not over:
                    left.append(text[last:])
                    inside, depth = bool(inside ^ odd[-1]), int(deep[-1])
            if rows:
                yield batch(rows)
        rows = []
        flush(rows)
        if rows:
            yield batch(rows)

    return run


def entries(spark: SparkSession, path: str, opening: str) -> DataFrame:
    """(value): the text of every entry of the documents at path, with its key where the document is an object.

    opening: '{' for an object with an entry a key, '[' for an array; where an
    array is asked for, a single object is one entry. A file that isn't one
    whole document has no entries.
    """
    text = spark.read.option("lineSep", "}").text(path).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), "value")
    states = spark.sparkContext.broadcast(_states(text.mapInArrow(_summaries, _BLOCKS).collect(), opening))  # a row for each block of a file
    cut = text.mapInArrow(_cutter(states), _PIECES)
    if len(states.value) == len({f for f, _ in states.value}):
        return _filled(cut)
    # entries that lie across blocks: at most two parts a block
    x = F.sort_array(F.collect_list(F.struct("start", "part", "ends", "value")))
    seams = settle(cut.where("not whole")).groupBy("file").agg(x.alias("x")).select("x").mapInArrow(_sew, "value string")
    return _filled(cut.where("whole").select("value").union(seams))


def _sew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for parts in b.column(0).to_pylist():
            out, left = [], []
            for p in parts:
                left.append(p["value"])
                if p["ends"]:
                    out.append("".join(left))
                    left = []
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})


def _filled(d: DataFrame) -> DataFrame:
    return d.select("value").where(F.col("value").rlike(r"\S"))


def write_document(rows: DataFrame, path: str, opening: str) -> None:
    """rows (value: the text of an entry) as one JSON document in one file, in pieces."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": [opening]})
        first = True
        for b in batches:
            out = [v for v in b.column(0).to_pylist() if v is not None]
            if out:
                yield pa.RecordBatch.from_pydict({"value": [out[0] if first else "," + out[0], *("," + v for v in out[1:])]})
                first = False
        yield pa.RecordBatch.from_pydict({"value": [{"{": "}", "[": "]"}[opening]]})

    none = rows.sparkSession.range(1).select(F.lit(None).cast("string").alias("value"))  # so that a table without rows is an empty document
    rows.select("value").union(none).repartition(1).mapInArrow(lines, "value string").write.option("lineSep", "\n").text(path)


def entry_text(key, value):
    """The text of an object's entry."""
    one = F.to_json(F.create_map(key, value))
    return F.substring(one, F.lit(2), F.length(one) - 2)
