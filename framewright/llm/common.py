"""Shared pieces of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.textbytes import pieces


def map_text(df: DataFrame, cols: dict[str, str], text: str, setup: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, limit: int = 1 << 21) -> DataFrame:
    """Arrow-batched map over rows of bounded bytes.

    cols: output name -> input column, read under names of our own so that no
    clash with other columns of df can arise. setup() runs once a task and
    gives the function that maps a batch; the batch has about limit bytes of
    text, or one longer text.
    """
    chosen = df.select(*[df[c].alias(o) for o, c in cols.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for b in batches:
            for i, n in pieces(b.column(b.schema.get_field_index(text)), limit):
                work = work or setup()
                out = work(b.slice(i, n))
                if out is not None:
                    yield out

    return chosen.mapInArrow(run, schema)


def map_rows(df: DataFrame, text_col: str, setup: Callable[[], Callable[[pa.RecordBatch, pa.Array], pa.RecordBatch]], limit: int = 1 << 21) -> DataFrame:
    """Arrow-batched map that keeps all columns of df, whatever their names.

    The function gets the batch and its texts and returns a batch of the same
    columns: rows may be dropped and the text column may be set anew.
    """
    at = df.columns.index(text_col)
    own = df.toDF(*[f"c{i}" for i in range(len(df.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for b in batches:
            for i, n in pieces(b.column(at), limit):
                work = work or setup()
                part = b.slice(i, n)
                yield work(part, part.column(at))

    return own.mapInArrow(run, own.schema).toDF(*df.columns)


def fold_of(id_col: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % n


def lowered(text: str) -> str:
    """A-Z only, unlike str.lower()."""
    return text.translate(_AZ)


_AZ = {c: c + 32 for c in range(65, 91)}
