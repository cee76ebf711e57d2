"""Names of stretches of a flat array, and the smallest value of each window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix

#: Names are polynomials of drawn bases modulo this prime, so no pattern makes two stretches agree for every base:
#: of two different ones of ``n`` letters, at most ``n`` bases in 2**61 give one name.
PRIME = 2**61 - 1
_P, _61, _31, _30, _32, _29 = (np.uint64(x) for x in (PRIME, 61, 31, 30, 32, 29))
_LOW31, _LOW30, _LOW32, _LOW29 = (np.uint64(2**k - 1) for k in (31, 30, 32, 29))
_BASES = tuple(int(x) for x in np.random.default_rng(20_240_229).integers(2**40, PRIME, 2))
_powers: dict[tuple[int, int], np.ndarray] = {}


def folded(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime."""
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, from halves of 31 bits."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = a1 * b0 + a0 * b1
    return folded(((a1 * b1) << np.uint64(1)) + (middle >> _30) + ((middle & _LOW30) << _31) + a0 * b0)


def powers(which: int, n: int, sign: int = 1) -> np.ndarray:
    """Powers of a base, or of its inverse, modulo the prime."""
    got = _powers.get((which, sign))
    if got is None or len(got) < n:
        base = pow(_BASES[which], sign, PRIME)
        size = max(n, 1 << 20)
        got = np.ones(1, dtype=np.uint64)
        while len(got) < size:
            got = np.concatenate([got, times(got, np.uint64(pow(base, len(got), PRIME)))])
        _powers[which, sign] = got
    return got


class Sums:
    """Prefix sums from which the name of any stretch of a flat array is had."""

    def __init__(self, values: np.ndarray, which: int = 0):
        """``values``: bytes, or 64-bit names."""
        n = len(values)
        self.which = which
        up = powers(which, n)[:n]
        # a letter of zero would leave no trace, so one is added
        if values.dtype == np.uint8:
            letter = values.astype(np.uint64) + np.uint64(1)
            upper = letter * (up >> _31)
            terms = (upper >> _30) + ((upper & _LOW30) << _31) + letter * (up & _LOW31)
        else:
            terms = times(folded(values) + np.uint64(1), up)
        # upper and lower digits are summed apart, so that no sum overflows
        high, low = np.cumsum(terms >> _32), np.cumsum(terms & _LOW32)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        self.sums[1:] = folded((high >> _29) + ((high & _LOW29) << _32) + low)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        part = self.sums[end] + (_P - self.sums[start])
        return mix(times(np.where(part >= _P, part - _P, part), powers(self.which, len(self.sums), -1)[start]))


_ODD, _LETTERS = 0x9E3779B97F4A7C15, np.random.default_rng(20_240_229).integers(0, 2**64, 256, dtype=np.uint64)
_rolled: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def picks(flat: np.ndarray, size: int) -> np.ndarray:
    """A number for each stretch of ``size`` bytes, by its start: equal for equal ones, made to choose among
    stretches. It names none, as different ones may have the same: it is a sum modulo 2**64."""
    n = len(flat)
    if n < size:
        return np.zeros(0, dtype=np.uint64)
    if 0 not in _rolled or len(_rolled[0][0]) <= n:
        most = max(n + 1, 1 << 21)
        _rolled[0] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(most - 1, np.uint64(x))]) for x in (_ODD, pow(_ODD, -1, 2**64)))
    up, down = _rolled[0]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_LETTERS[flat] * up[:n], out=sums[1:])
    x = (sums[size:] - sums[:-size]) * down[: n + 1 - size]
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    return x


def slide(x: np.ndarray, n: int, best=np.minimum) -> np.ndarray:
    """The best of each ``n`` neighbours, by the first one's place."""
    if len(x) < n:
        return x[:0]
    k = 1
    while 2 * k <= n:
        x = best(x[:-k], x[k:])
        k *= 2
    return best(x[: len(x) - (n - k)], x[n - k :]) if k < n else x


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...``, ``count`` of them, for each start."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts - starts, counts)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column in one array, and where each row starts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.cast(pa.large_binary())
    if wide.null_count:
        wide = pc.fill_null(wide, b"")
    n = len(wide)
    _, offsets, data = wide.buffers()
    if not n or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    off = np.frombuffer(offsets, dtype=np.int64)[wide.offset : wide.offset + n + 1]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return flat[off[0] : off[-1]], off - off[0]


def is_space() -> np.ndarray:
    space = np.zeros(256, dtype=bool)
    space[[32, *range(9, 14)]] = True
    return space


_SPACE = is_space()


def words(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between white space (ASCII): where they start and end, and the number of words before each row."""
    n = len(flat)
    space = _SPACE[flat]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    inside = ~space
    first, last = inside.copy(), inside.copy()
    first[1:] &= space[:-1] | edge[1:n]
    last[:-1] &= space[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off, "left")


def groups(batches: Iterator[pa.RecordBatch], key: str, most: int, most_bytes: int = 256 << 20) -> Iterator[pa.Table]:
    """Batches sorted by ``key`` in tables of about ``most`` rows or bytes that never part equal keys."""
    held: list[pa.RecordBatch] = []
    n = size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n, size = n + b.num_rows, size + b.nbytes
        if n >= most or size >= most_bytes:
            t = pa.Table.from_batches(held)
            k = t.column(key).to_numpy()
            cut = int(np.searchsorted(k, k[-1], "left"))
            if cut:
                yield t.slice(0, cut)
                held, n = t.slice(cut).to_batches(), t.num_rows - cut
                size = sum(x.nbytes for x in held)
    if n:
        yield pa.Table.from_batches(held)
