"""Words, shingles and packed blocks of 64-bit hashes in numpy, for the operators that run in Python."""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard

_U = np.uint64
#: Odd constants for sums of hashes.
_ODD = [_U(x | 1) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: Words longer than this are hashed one by one.
_LONG = 64
_BASE = 0xD1342543DE82EF95

#: True for the bytes \x20 and \x09-\x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random 64-bit number for each byte.
_BYTES = np.frombuffer(b"".join(xxhash.xxh3_64_digest(bytes([c])) for c in range(256)), ">u8").astype(_U)
_powers = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(2 * n, 1 << 16)
        for j, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, _U)
            p[0] = 1
            _powers[j] = np.cumprod(p, dtype=_U)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """A 64-bit hash for each word [^\\x20\\x09-\\x0D]+ of a whole text; lower: A-Z as a-z.

    All words at once: a word is the difference of two sums of its bytes' numbers times powers of a base.
    """
    if not text:
        return np.empty(0, _U)
    b = text.encode("utf-8", "surrogatepass")
    a = np.frombuffer(b.lower() if lower else b, np.uint8)  # bytes.lower knows ASCII only
    edge = np.flatnonzero(np.diff(_SPACE[a], prepend=True, append=True))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, _U)
    up, down = powers(len(a))
    sums = np.empty(len(a) + 1, _U)
    sums[0] = 0
    np.cumsum(_BYTES[a] * up, out=sums[1:])
    h = mixed((sums[stop] - sums[start]) * down[start])
    for k in np.flatnonzero(stop - start > _LONG):
        h[k] = xxhash.xxh3_64_intdigest(a[start[k] : stop[k]].tobytes())
    return h


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted and each once; sorting is faster here than numpy's hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _ODD[1]
    x = (x ^ (x >> _U(27))) * _ODD[2]
    return x ^ (x >> _U(31))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words."""
    if len(h) < n:
        return np.empty(0, _U)
    out = h[: len(h) - n + 1] * _ODD[0]
    for k in range(1, n):
        out = out + h[k : len(h) - n + 1 + k] * (_ODD[k % 5] + _U(2 * (k // 5)))
    return mixed(out)


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """The sorted distinct n-word shingles of a lower-cased text; of a shorter one, the whole sequence as one."""
    h = word_hashes(text, lower=True)
    if 0 < len(h) < n:
        return ngrams(h, len(h)) ^ _U(len(h))
    return distinct(ngrams(h, n))


# ---- blocks: sorted 64-bit keys as deltas by byte plane -------------------------------------------------


def pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit numbers."""
    if not len(keys):
        return b""
    d = np.diff(keys, prepend=_U(0)).astype("<u8")
    planes = max(1, (int(d[1:].max()).bit_length() + 7) // 8) if len(d) > 1 else 1
    rest = np.ascontiguousarray(d[1:].view(np.uint8).reshape(-1, 8)[:, :planes].T)
    return d[:1].tobytes() + bytes([planes]) + rest.tobytes()


def unpack(b: bytes) -> np.ndarray:
    if not b:
        return np.empty(0, _U)
    planes = b[8]
    rest = np.frombuffer(b, np.uint8, offset=9).reshape(planes, -1)
    d = np.zeros((rest.shape[1] + 1, 8), np.uint8)
    d[0] = np.frombuffer(b, np.uint8, 8)
    d[1:, :planes] = rest.T
    return np.cumsum(d.view("<u8").ravel(), dtype=_U)


def squeeze(x: np.ndarray) -> bytes:
    """Any array as compressed bytes by byte plane; expand() needs its type."""
    if not len(x):
        return b""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def expand(b: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    if not b:
        return np.empty(0, kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def bounds(buckets: int) -> np.ndarray:
    """The first key of each bucket when 64-bit keys are cut into equal ranges."""
    return np.array([(k << 64) // buckets for k in range(buckets)], _U)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """The starts of runs of equal keys, and the length at the end."""
    if not len(sorted_keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])
