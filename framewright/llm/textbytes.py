"""Vectorised word scanning over the UTF-8 buffers of Arrow string arrays.

Every function works on whole texts: a buffer is read in slices that end at a
document end or at a byte between words, so memory follows the slice and not
the longest text. A null text is an empty one. Word hashes are 64-bit
polynomials of the word's bytes, finished by a bijective mixer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1


def class_table(word: bytes) -> np.ndarray:
    """256 booleans: the bytes that belong to words."""
    t = np.zeros(256, dtype=bool)
    t[np.frombuffer(word, dtype=np.uint8)] = True
    return t


#: Words of everything but ASCII white space.
NON_SPACE = class_table(bytes(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D))
#: Words of digits, lower-case ASCII letters and all that is not ASCII.
ALNUM = class_table(bytes(b for b in range(256) if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    inv = pow(_P, -1, 1 << 64)
    out = []
    for base in (_P, inv):
        a = np.empty(n, dtype=np.uint64)
        a[0] = 1
        done = 1
        step = base
        while done < n:
            k = min(done, n - done)
            a[done : done + k] = a[:k] * np.uint64(step)
            done += k
            step = step * step & _M64
        out.append(a)
    return out[0], out[1]


class Powers:
    """Grows on demand; one per task."""

    def __init__(self) -> None:
        self.up, self.down = _powers(SLICE_BYTES + 4096)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = _powers(n)
        return self.up[:n], self.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string array; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    if offs is None or not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray, powers: Powers, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, in text order; words don't span documents."""
    starts, ends, hashes = [], [], []
    n, at = len(raw), 0
    case = _LOWER if lower else _SAME
    while at < n:
        stop = min(n, at + SLICE_BYTES)
        if stop < n:
            # back to the last byte between words; on to the next if there is none
            tail = np.flatnonzero(~table[case[raw[max(at, stop - 4096) : stop]]])
            if len(tail):
                stop = max(at, stop - 4096) + int(tail[-1]) + 1
            else:
                while stop < n:
                    gap = np.flatnonzero(~table[case[raw[stop : stop + 65536]]])
                    if len(gap):
                        stop += int(gap[0]) + 1
                        break
                    stop = min(n, stop + 65536)
        low = case[raw[at:stop]]
        inside = table[low]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cut = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, stop, "left")] - at
        cut = cut[(cut > 0) & (cut < len(low))]
        if len(cut):
            both = cut[inside[cut] & inside[cut - 1]]
            first[both] = True
            last[both - 1] = True
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = powers.get(len(low) + 1)
        total = np.empty(len(low) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s]))
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    if not starts:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(0, dtype=np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def counts_by_doc(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n + 1 positions in the word list: document i has words [out[i], out[i + 1])."""
    return np.searchsorted(starts, offsets, "left")


def pieces(texts: pa.Array, limit: int = 1 << 21):
    """(first row, row count) of runs of rows with about limit bytes; a longer text is a run of its own."""
    _, o = buffer_of(texts)
    n, i = len(o) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(o, o[i] + limit, "right")) - 1)
        yield i, min(j, n) - i
        i = min(j, n)
