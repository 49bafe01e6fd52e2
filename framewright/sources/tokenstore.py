"""Binary token stores as data sources: token shards, and indexed pairs of .idx and .bin files.

spark.dataSource.register(TokenShards) and so on, then
spark.read.format("token_shards").load(path). Files are read and written on
executors, by paths that these can open (a shared mount); the canonical
storage at scale is Parquet with array<int>, and from_binary() reads any store
that Spark reads.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Headers and number codes of the formats.
SHARD_MAGIC, SHARD_MAGIC_OLD, SHARD_VERSION, SHARD_HEADER = 278895051, 20240520, 1, 256 * 4
INDEX_HEADER = b"MMIDIDX\x00\x00"
DTYPES = {1: np.uint8, 2: np.int8, 3: np.int16, 4: np.int32, 5: np.int64, 6: np.float64, 7: np.float32, 8: np.uint16}


def shard_tokens(raw: bytes) -> np.ndarray:
    """The tokens of a shard; a wrong header is an error."""
    head = np.frombuffer(raw[:SHARD_HEADER], dtype=np.int32)
    if len(head) < 256 or head[0] not in (SHARD_MAGIC, SHARD_MAGIC_OLD) or head[1] != SHARD_VERSION:
        raise ValueError("not a token shard")
    if head[0] == SHARD_MAGIC_OLD:
        kind = np.uint16
    elif int(head[3]) in (2, 4):
        kind = {2: np.uint16, 4: np.uint32}[int(head[3])]
    else:
        raise ValueError(f"{head[3]} bytes a token")
    return np.frombuffer(raw, dtype=kind, count=int(head[2]), offset=SHARD_HEADER)


def shard_bytes(tokens: np.ndarray, vocabulary: int) -> bytes:
    kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
    head = np.zeros(256, dtype=np.int32)
    head[:4] = SHARD_MAGIC, SHARD_VERSION, len(tokens), np.dtype(kind).itemsize
    return head.tobytes() + np.asarray(tokens).astype(kind).tobytes()


def index_of(raw: bytes) -> dict:
    """dtype, lengths, pointers, document bounds and modes (or None) of an .idx file."""
    if raw[:9] != INDEX_HEADER or struct.unpack_from("<Q", raw, 9)[0] != 1:
        raise ValueError("not an index")
    kind = DTYPES[raw[17]]
    n, d = struct.unpack_from("<QQ", raw, 18)
    at = 34
    out = {"dtype": kind}
    for name, t, k in (("lengths", np.int32, n), ("pointers", np.int64, n), ("documents", np.int64, d)):
        out[name] = np.frombuffer(raw, dtype=t, count=k, offset=at)
        at += k * np.dtype(t).itemsize
    out["modes"] = np.frombuffer(raw, dtype=np.int8, count=n, offset=at) if len(raw) >= at + n > at else None
    return out


def index_bytes(lengths: list[int], documents: list[int], kind=np.int32, modes: list[int] | None = None) -> bytes:
    code = next(c for c, t in DTYPES.items() if t == kind)
    size = np.array(lengths, dtype=np.int32)
    pointers = (np.cumsum(size, dtype=np.int64) - size) * np.dtype(kind).itemsize
    parts = [INDEX_HEADER, struct.pack("<QB", 1, code), struct.pack("<QQ", len(size), len(documents)), size.tobytes(), pointers.astype(np.int64).tobytes(), np.array(documents, dtype=np.int64).tobytes()]
    return b"".join(parts + ([np.array(modes, dtype=np.int8).tobytes()] if modes is not None else []))


def prefixes(patterns: list[str]) -> list[str]:
    """Unique sorted path prefixes of .bin and .idx files."""
    return sorted({os.path.splitext(f)[0] for p in patterns for f in glob.glob(p) if f.endswith((".bin", ".idx"))})


#: Tokens after which a shard is full, and those of sequences that are in one batch.
SHARD_TOKENS, BATCH_TOKENS = 1 << 22, 1 << 20


class _File(InputPartition):
    def __init__(self, path: str, lo: int = 0, hi: int = -1) -> None:
        self.path, self.lo, self.hi = path, lo, hi


class TokenShards(DataSource):
    """Read: (file, tokens), a row a shard. Write: array<int> column tokens, with a .bos.idx of document starts; a partition's rows go into a new shard once one has shard_tokens."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return "file string, tokens array<int>"

    def reader(self, schema):
        return _ShardReader(self.options)

    def writer(self, schema, overwrite):
        return _ShardWriter(self.options)


class _ShardReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]

    def partitions(self):
        files = sorted(glob.glob(os.path.join(self.path, "*.bin"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [_File(f) for f in files]

    def read(self, part) -> Iterator[pa.RecordBatch]:
        with open(part.path, "rb") as f:
            tokens = shard_tokens(f.read()).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(part.path)]), pa.ListArray.from_arrays(pa.array([0, len(tokens)], pa.int32()), pa.array(tokens))], names=["file", "tokens"])


class _ShardWriter(DataSourceArrowWriter):
    def __init__(self, options) -> None:
        self.path, self.vocabulary, self.bos = options["path"], int(options.get("vocabulary", 1 << 16)), options.get("bos")
        self.most = int(options.get("shard_tokens", SHARD_TOKENS))

    def write(self, batches) -> WriterCommitMessage:
        parts, n = [], 0
        for b in batches:
            for t in b.column("tokens"):
                parts.append(_numbers(t))
                n += len(parts[-1])
                if n >= self.most:
                    self._shard(parts)
                    parts, n = [], 0
        if parts:
            self._shard(parts)
        return WriterCommitMessage()

    def _shard(self, parts: list[np.ndarray]) -> None:
        os.makedirs(self.path, exist_ok=True)
        tokens = np.concatenate(parts)
        name = os.path.join(self.path, f"{uuid.uuid4().hex}.bin")
        _put(name, shard_bytes(tokens, self.vocabulary))
        if self.bos is not None:
            _put(name[:-4] + ".bos.idx", np.flatnonzero(tokens == int(self.bos)).astype(np.int32).tobytes())


def _numbers(row: pa.ListScalar) -> np.ndarray:
    return row.values.to_numpy(zero_copy_only=False)


def _put(name: str, raw: bytes) -> None:
    """Whole files only: written aside and renamed."""
    with open(name + ".part", "wb") as f:
        f.write(raw)
    os.replace(name + ".part", name)


class IndexedTokens(DataSource):
    """Read: (sequence, document, mode, tokens) of a prefix. Write: columns tokens and document (its number), sorted in one partition a prefix."""

    @classmethod
    def name(cls) -> str:
        return "indexed_tokens"

    def schema(self) -> str:
        return "sequence long, document long, mode int, tokens array<long>"

    def reader(self, schema):
        return _IndexReader(self.options)

    def writer(self, schema, overwrite):
        return _IndexWriter(self.options)


class _IndexReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.rows = options["path"], int(options.get("rows_per_partition", 65536))

    def partitions(self):
        with open(self.path + ".idx", "rb") as f:
            n = len(index_of(f.read())["lengths"])
        return [_File(self.path, i, min(n, i + self.rows)) for i in range(0, n, self.rows)]

    def read(self, part) -> Iterator[pa.RecordBatch]:
        with open(part.path + ".idx", "rb") as f:
            x = index_of(f.read())

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            at, docs, modes, tokens = zip(*rows)
            ends = np.cumsum([0, *map(len, tokens)], dtype=np.int32)
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(docs, pa.int64()), pa.array(modes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens)))], names=["sequence", "document", "mode", "tokens"])

        rows, n = [], 0
        size = np.dtype(x["dtype"]).itemsize
        with open(part.path + ".bin", "rb") as f:
            for i in range(part.lo, part.hi):
                f.seek(int(x["pointers"][i]))
                t = np.frombuffer(f.read(int(x["lengths"][i]) * size), dtype=x["dtype"])
                d = int(np.searchsorted(x["documents"], i, "right")) - 1
                rows.append((i, d, None if x["modes"] is None else int(x["modes"][i]), t.astype(np.int64)))
                n += len(t)
                if n >= BATCH_TOKENS or len(rows) >= 10_000:
                    yield batch(rows)
                    rows, n = [], 0
        if rows:
            yield batch(rows)


class _IndexWriter(DataSourceArrowWriter):
    def __init__(self, options) -> None:
        self.path, self.kind = options["path"], np.dtype(options.get("dtype", "int32")).type

    def write(self, batches) -> WriterCommitMessage:
        rows = ((d, _numbers(t)) for b in batches for d, t in zip(b.column("document").to_pylist(), b.column("tokens")))
        lengths, documents, last, n = [], [0], None, 0
        name = f"{self.path}-{uuid.uuid4().hex}"
        os.makedirs(os.path.dirname(name) or ".", exist_ok=True)
        with open(name + ".bin.part", "wb") as f:
            for document, tokens in rows:
                if last is not None and document != last:
                    documents.append(n)
                last = document
                t = np.asarray(tokens, dtype=self.kind)
                f.write(t.tobytes())
                lengths.append(len(t))
                n += 1
        if n:
            documents.append(n)
            os.replace(name + ".bin.part", name + ".bin")
            _put(name + ".idx", index_bytes(lengths, documents, self.kind))
        else:
            os.remove(name + ".bin.part")
        return WriterCommitMessage()


def register(spark: SparkSession) -> None:
    for s in (TokenShards, IndexedTokens):
        spark.dataSource.register(s)


def from_binary(spark: SparkSession, path: str) -> DataFrame:
    """(file, tokens) of token shards in any store that Spark reads."""
    import pandas as pd

    def run(parts):
        for x in parts:
            yield pd.DataFrame({"file": x["path"], "tokens": [shard_tokens(b).astype(np.int64).tolist() for b in x["content"]]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, tokens array<long>").withColumn("file", F.regexp_extract("file", r"([^/]+)$", 1))
