"""Words and shingles of whole Arrow batches at once, with numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D. UTF-8 keeps those bytes for
themselves, so splitting bytes is splitting characters. Words get 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import worker_cache

_U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: For words of letters and digits: every ASCII byte that is neither parts them.
MARKS = np.zeros(256, bool)
MARKS[:128] = True
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works on a copy."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        for k, base in enumerate((_R, _R_INV)):
            out = np.full(n, base, _U)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            _powers[k] = out
    return _powers[0], _powers[1]


def slices(column: pa.Array, most: int = 1 << 18):
    """Parts of a string column of at most ``most`` bytes, or of one row."""
    worker_cache("words")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), len(column))
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[at] : offsets[end]]
        yield at, end, data, offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, parts: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()):
    """(hash, document, start, end) of each word of the documents that ``offsets`` marks off in ``data``.

    A-Z are lowered; ``parts`` tells which bytes part words. With ``prefixes``, a list of the hashes of the
    words' first so many bytes comes fifth (0 for shorter words).
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return (np.zeros(0, _U), none, none, none, *[[np.zeros(0, _U) for _ in prefixes]] * bool(prefixes))
    ink = np.zeros(n + 2, bool)
    ink[1:-1] = ~parts[data]
    begins = ink[1:-1] & ~ink[:-2]
    ends = ink[1:-1] & ~ink[2:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]  # words end where documents do
    begins[inner] = ink[1:-1][inner]
    ends[inner - 1] = ink[1:-1][inner - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    power, inverse = _powers_to(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum(_LOWER[data].astype(_U) * power[:n], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    h = mix(h + _U(0x632BE59BD9B4E019) * (end - start).astype(_U))
    doc = np.searchsorted(offsets, start, "right") - 1
    if not prefixes:
        return h, doc, start, end
    heads = []
    for k in prefixes:
        p = mix((total[np.minimum(start + k, n)] - total[start]) * inverse[start] + _U(0x2545F4914F6CDD1D) * _U(k))
        heads.append(np.where(end - start >= k, p, _U(0)))
    return h, doc, start, end, heads


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, shingle hash) pairs, sorted; a document of fewer words has them all as one shingle."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(count)))
    short = np.flatnonzero((count > 0) & (count < size))
    m = len(h) - size + 1
    if m > 0:
        same = doc[: m] == doc[size - 1 :]
        value = np.zeros(m, _U)
        for k in range(size):
            value = (value + h[k : k + m]) * _U(0xD6E8FEB86659FD93 + 2 * k)
            value ^= value >> _U(29)
        value, owner = mix(value)[same], doc[:m][same]
    else:
        value, owner = np.zeros(0, _U), np.zeros(0, np.int64)
    if len(short):
        extra = np.zeros(len(short), _U)
        for i, d in enumerate(short):
            v = _U(count[d])
            with np.errstate(over="ignore"):
                for x in h[first[d] : first[d + 1]]:
                    v = (v ^ x) * _U(0xA24BAED4963EE407)
                    v ^= v >> _U(31)
            extra[i] = v
        value, owner = np.concatenate((value, mix(extra))), np.concatenate((owner, short))
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], value[new]


def shingle_set(text: str, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of one text."""
    data = np.frombuffer(text.encode(), np.uint8)
    h, doc, _, _ = words(data, np.array([0, len(data)]))
    return shingles(h, doc, 1, size)[1]
