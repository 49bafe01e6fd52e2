"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until a half is a leaf. The elements of the monoid are
(text span, its token ids); joining neighbours keeps all tokens but those in
a window around the seam, which is encoded anew and grows until the tokens
outside are proven stable:

* A place between a character that is no white space and a single space before
  a letter or digit is a match boundary of the split pattern whatever stands
  around it, if no alternative has a space after its first character. Tokens
  left of such a place and right of it don't depend on each other, so a window
  from one such place to another proves all other tokens. A pattern is tried for
  it when a coder is made, and refused if it fails.
* Inside one match of the pattern (a very long word) a row of tokens is the
  encoding exactly when every two neighbours encode to themselves, so a
  window stands when its outer tokens agree with their neighbours in this way.

Decoding concatenates the tokens' bytes up the same tree.
"""

from __future__ import annotations

import hashlib
from base64 import b64decode
from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from framewright.llm.common import map_text

LEAF_CHARS = 512
#: Longest match of the pattern, in bytes, that is given to the merge loop in one go.
LEAF_PIECE = 512
#: Characters of every class around a space, to try a pattern with.
_PROBES = ("a", "Z", "9", "é", "ñ", "日", "ß", "٣", "'", "'s", "don't", ".", ",", "_", "<|", "🙂", "\u0301", "\u200d", "((")


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes and its rank on every line."""
    with open(path, "rb") as f:
        return {b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Coder:
    """Encodes and decodes with one vocabulary; made once a task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, leaf_piece: int = LEAF_PIECE) -> None:
        import tiktoken

        self.leaf_chars, self.leaf_piece = leaf_chars, leaf_piece
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            self.bytes_of[i] = t
        self.text_of = list(map(str, range(len(self.bytes_of))))
        self.split = regex.compile(pattern)
        self.cut = regex.compile(r"(?<=\S)(?= [\p{L}\p{N}])")
        for a in _PROBES:
            for b in _PROBES[:8]:
                for text in (f"{a} {b}", f"x {a}{a} {b}{b} y", f"  {a} {b}  {a}"):
                    starts = {m.start() for m in self.split.finditer(text)}
                    if not all(m.start() in starts for m in self.cut.finditer(text)):
                        raise ValueError(f"the pattern has matches across {text!r}")
        self.long = regex.compile(r"\S{%d}|\s{%d}" % (leaf_piece // 4, leaf_piece // 4))

    # ---- one match of the pattern -------------------------------------------------
    def _merge(self, piece: bytes) -> list[int]:
        return self.core._encode_single_piece(piece)

    def _agree(self, a: int, b: int) -> bool:
        return self._merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def piece(self, piece: bytes) -> list[int]:
        """Tokens of one match, by halves."""
        if len(piece) <= self.leaf_piece:
            return self._merge(piece)
        half = len(piece) // 2
        return self._join_pieces(self.piece(piece[:half]), self.piece(piece[half:]))

    def _join_pieces(self, a: list[int], b: list[int]) -> list[int]:
        k = 2
        while True:
            i, j = max(0, len(a) - k), min(len(b), k)
            window = self._merge(b"".join(map(self.bytes_of.__getitem__, a[i:] + b[:j])))
            left = i == 0 or self._agree(a[i - 1], window[0])
            right = j == len(b) or self._agree(window[-1], b[j])
            if left and right:
                return a[:i] + window + b[j:]
            k *= 2

    # ---- whole texts ----------------------------------------------------------------
    def _plain(self, text: str) -> list[int]:
        if self.long.search(text) is None:  # no match of the pattern is longer than a leaf
            return self.core.encode_ordinary(text)
        out: list[int] = []
        for m in self.split.finditer(text):
            out += self.piece(m.group().encode())
        return out

    def encode(self, text: str) -> list[int]:
        # lone surrogates can't come from UTF-8 columns
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf_chars:
            return self._plain(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def _drop(self, ids: list[int], n: int, last: bool) -> list[int]:
        """ids without the first or last tokens that hold n bytes; a token ends there."""
        order = range(len(ids) - 1, -1, -1) if last else range(len(ids))
        k = 0
        for i in order:
            if n <= 0:
                break
            n -= len(self.bytes_of[ids[i]])
            k += 1
        if n < 0:
            raise AssertionError("a match boundary inside a token")
        return ids[: len(ids) - k] if last else ids[k:]

    def _join(self, text: str, lo: int, mid: int, hi: int, a: list[int], b: list[int]) -> list[int]:
        w = 32
        while True:
            i, j = max(lo, mid - w), min(hi, mid + w)
            left = next((m.start() for m in self.cut.finditer(text, i, mid, overlapped=False) if m.start() > lo), None) if i > lo else lo
            right = None
            if j < hi:
                for m in self.cut.finditer(text, mid + 1, j):
                    right = m.start()
            else:
                right = hi
            if left is not None and right is not None:
                seam = self._plain(text[left:right])
                head = self._drop(a, len(text[left:mid].encode()), True)
                tail = self._drop(b, len(text[mid:right].encode()), False)
                return head + seam + tail
            w *= 2

    def decode(self, ids: list[int]) -> bytes:
        """Concatenation is associative: by halves, the leaves joined in one go."""
        if len(ids) <= 1 << 16:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        parts = [b"".join(map(self.bytes_of.__getitem__, ids[i : i + (1 << 16)])) for i in range(0, len(ids), 1 << 16)]
        while len(parts) > 1:
            parts = [reduce(bytes.__add__, parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0]

    def id_text(self, ids: list[int]) -> str:
        return ",".join(map(self.text_of.__getitem__, ids))


def _mapped(docs: DataFrame, path: str, pattern: str, cols: dict[str, str], work, schema: str) -> DataFrame:
    """The vocabulary's size is fixed (one rank file), so it is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def setup():
        coder = Coder(shared.value, pattern)
        return lambda b: work(coder, b)

    return map_text(docs, cols, "__text", setup, schema)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text, without special tokens.

    A null or empty text has an empty array; repeated rows give repeated rows;
    an empty table gives none. Other columns aren't read.
    """

    def work(c: Coder, b: pa.RecordBatch) -> pa.RecordBatch:
        ids = [c.encode(t or "") for t in b.column("__text").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("__id"), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return _mapped(docs, path, pattern, {"__id": id_col, "__text": text_col}, work, f"`{id_col}` {dict(docs.dtypes)[id_col]}, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from token ids; null ids give the empty text. Bytes that aren't UTF-8 become U+FFFD."""
    shared = tokens.sparkSession.sparkContext.broadcast(load_ranks(path))
    chosen = tokens.select(tokens[id_col].alias("__id"), tokens[ids_col].alias("__ids"))

    def run(batches):
        coder = Coder(shared.value, pattern)
        for b in batches:
            out = [coder.decode(i or []).decode("utf-8", "replace") for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[id_col, "text"])

    return chosen.mapInArrow(run, f"`{id_col}` {dict(tokens.dtypes)[id_col]}, text string")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass, nothing shuffled."""

    def work(c: Coder, b: pa.RecordBatch) -> pa.RecordBatch:
        n, ids_hash, back_hash = [], [], []
        for t in b.column("__text").to_pylist():
            ids = c.encode(t or "")
            n.append(len(ids))
            ids_hash.append(hashlib.sha256(c.id_text(ids).encode()).hexdigest())
            back_hash.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([b.column("__id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(back_hash, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return _mapped(docs, path, pattern, {"__id": id_col, "__text": text_col}, work, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
