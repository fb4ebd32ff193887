"""Words of many texts as flat numpy arrays: borders, text numbers and 63-bit fingerprints, without a Python loop."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

SPACE = 32
_MULTIPLIER = 0x9E3779B97F4A7C15


def byte_table(is_word) -> bytes:
    """A table for bytes.translate: ASCII capitals become small, every byte that is no part of a word becomes a space.
    Bytes from 0x80 belong to words, so classes defined on code points hold on UTF-8 as well."""
    return bytes((c + 32 if 65 <= c <= 90 else c) if c >= 0x80 or is_word(c) else SPACE for c in range(256))


#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: digits, small letters and all that is not ASCII.
ALNUM = byte_table(lambda c: 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122)
#: Words [^\x20\x09-\x0D]+ after lower-casing: whatever stands between ASCII white space.
BLANK = byte_table(lambda c: c != 32 and not 9 <= c <= 13)


@dataclass
class Words:
    data: bytes  # folded text, texts apart by one space
    starts: np.ndarray  # byte where each word begins
    ends: np.ndarray  # and the byte after it
    first: np.ndarray  # of each text, the number of its first word; one more entry at the end
    hashes: np.ndarray | None = None  # int64, not negative

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def phrase(self, a: int, b: int) -> bytes:
        """Words a to b - 1, one space between."""
        return b" ".join(self.data[self.starts[a] : self.ends[b - 1]].split())


class Hasher:
    """Fingerprints of slices of a byte array: eight bytes at a time are mixed in, so that no sum of bytes, however the
    slices repeat themselves, cancels out; slices of more than LONG bytes by a cryptographic digest."""

    LONG = 512
    _KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)

    def __init__(self, seed: int = 7):
        self.seed = np.uint64(seed)

    def __call__(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=data + bytes(8), strides=(1,))
        left = ends - starts
        h = mixed((left.astype(np.uint64) << np.uint64(8)) + self.seed)
        long_ = np.flatnonzero(left > self.LONG)
        at, on = starts, None  # on: the slices that have bytes left; None: all
        while len(at):
            h_on = mixed((h if on is None else h[on]) ^ (eight[at] & self._KEEP[np.minimum(left, 8)]))
            if on is None:
                h = h_on
            else:
                h[on] = h_on
            more = np.flatnonzero((left > 8) & (left <= self.LONG))
            at, left, on = at[more] + 8, left[more] - 8, more if on is None else on[more]
        for k in long_.tolist():
            digest = hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8, salt=int(self.seed).to_bytes(8)).digest()
            h[k] = np.uint64(int.from_bytes(digest))
        return (h >> np.uint64(1)).astype(np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits; int64, not negative."""
    return (mixed(h) >> np.uint64(1)).astype(np.int64)


def joined(hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of every run of n neighbouring words: entry i is of words i to i + n - 1."""
    size = max(0, len(hashes) - n + 1)
    h = np.full(size, n, dtype=np.uint64)
    for k in range(n):
        h = mixed(h * np.uint64(_MULTIPLIER) + hashes[k : k + size].astype(np.uint64))
    return (h >> np.uint64(1)).astype(np.int64)


def words_of(texts: list[str], table: bytes, hasher: Hasher | None = None) -> Words:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = b" ".join(raw).translate(table)
    at = np.cumsum([0] + [len(r) + 1 for r in raw])  # where each text begins
    inside = np.frombuffer(data, dtype=np.uint8) != SPACE
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    first = np.searchsorted(starts, at)
    first[-1] = len(starts)
    return Words(data, starts, ends, first, hasher(data, starts, ends) if hasher else None)
