"""Vectorised 64-bit hashing of words, shingles and byte windows (numpy only)."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    key = "i" if inverse else "p"
    if key not in _powers or len(_powers[key]) < n:
        a = np.full(max(n, 1 << 16), INVERSE if inverse else BASE, np.uint64)
        a[0] = 1
        _powers[key] = np.cumprod(a, dtype=np.uint64)
    return _powers[key][:n]


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """S with S[j] = sum of (byte+1) * base**i for i < j; length len(buf)+1."""
    out = np.zeros(len(buf) + 1, np.uint64)
    out[1:] = buf
    out[1:] += np.uint64(1)
    out[1:] *= powers(len(buf))
    np.cumsum(out, out=out)
    return out


def ranges(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of buf[start:end] from prefix sums ``s``."""
    return mix((s[end] - s[start]) * powers(len(s), True)[start] + (end - start).astype(np.uint64))


def windows(s: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every window of ``width`` bytes."""
    n = len(s) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((s[width:] - s[:n]) * powers(len(s), True)[:n])


#: Bytes of text that are hashed at once, unless one document is longer.
PIECE = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document index) of each word of lower-cased UTF-8 documents; words are runs
    without the space and the bytes 0x09 to 0x0D. Documents are hashed about ``PIECE`` bytes at
    a time; a word's hash does not depend on its piece."""
    hs, ds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(docs):
        end, size = at, 0
        while end < len(docs) and (end == at or size + len(docs[end]) <= PIECE):
            size += len(docs[end])
            end += 1
        h, d = _piece_words(docs[at:end])
        hs.append(h)
        ds.append(d + at)
        at = end
    return np.concatenate(hs), np.concatenate(ds)


def _piece_words(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b" ".join([b"", *docs, b""]), np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    ends = np.cumsum(np.fromiter((len(d) + 1 for d in docs), np.int64, len(docs)))
    return ranges(prefix_sums(buf), start, end), np.searchsorted(ends, start, side="right")


def shingles(docs: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document index), with repeats, of every ``width``-word shingle; a document
    with fewer words gives its whole sequence as one shingle, one without words none."""
    w, d = words(docs)
    n = len(w) - width + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        h = mix(h ^ w[k : k + n]) * BASE
    whole = d[:n] == d[width - 1 :] if n > 0 else np.zeros(0, bool)
    count = np.bincount(d, minlength=len(docs)) if len(d) else np.zeros(len(docs), np.int64)
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < width))
    more = np.zeros(len(short), np.uint64)
    for j, x in enumerate(short):
        a = np.array([count[x]], np.uint64)
        for k in range(first[x], first[x] + count[x]):
            a = mix(a ^ w[k : k + 1]) * BASE
        more[j] = a[0]
    return np.concatenate([h[whole], more]), np.concatenate([d[:n][whole] if n > 0 else d[:0], short])


def planes(a: np.ndarray) -> bytes:
    """64-bit values stored byte plane by byte plane: like bytes lie together and pack well."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(b: bytes, dtype=np.uint64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(dtype).reshape(-1)


def sorted_planes(a: np.ndarray) -> bytes:
    """Ascending unsigned values as differences in planes."""
    return planes(np.diff(a, prepend=np.uint64(0)))


def unsorted_planes(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b), dtype=np.uint64)
