"""Fixed-rate floating-point blocks after the published ZFP design (P. Lindstrom, 2014): blocks of 4 values a
dimension share an exponent, go through a lifting transform that is reversible to rounding, are ordered by
total sequency, and are coded bit plane by bit plane from the most significant on, until each has its number
of bits.

All blocks of a chunk are coded at once. A plane of a block is first the bits of the places that a higher
plane has reached, then for the places beyond them a test whether any is set, and if so the bits up to and
with the next set one, and so on; the last place's bit is implied by its test. Which of these stand in a
plane follows from its bits and those above, so an encoder lays all of them out and keeps the first as many
as a block has; a decoder takes one bit of every block at a time.
"""

from __future__ import annotations

from math import prod

import numpy as np

from ..errors import FormatError, TypeMismatchError, UnsupportedError

#: Number, width, exponent bits and bias of each value type (fixed values).
KINDS = {"i4": (1, 32, 0, 0), "i8": (2, 64, 0, 0), "f4": (3, 32, 8, 127), "f8": (4, 64, 11, 1023)}
#: The first word of a filter's client data, and what its header begins with (fixed values).
VERSION_WORD, MAGIC = 269504785, b"zfp\x05"
#: Bits of a dimension's length in a header, by rank (fixed values).
LENGTH_BITS = {1: 48, 2: 24, 3: 16, 4: 12}
#: Blocks that are laid out together.
BATCH = 512

#: The order of a three-dimensional block's values (fixed values).
ORDER_3 = (
    0, 1, 4, 16, 20, 17, 5, 2, 8, 32, 21, 6, 18, 24, 9, 33, 36, 3, 12, 48, 22, 25, 37, 40, 34, 10,
    7, 19, 28, 13, 49, 52, 41, 38, 26, 23, 29, 53, 11, 35, 44, 14, 50, 56, 42, 27, 39, 45, 30, 54,
    57, 60, 51, 15, 43, 46, 58, 61, 55, 31, 62, 59, 47, 63,
)


def sequency(rank: int) -> np.ndarray:
    """Places of a block in order of total sequency, then of the square sum."""
    if rank == 3:
        return np.array(ORDER_3)
    steps = np.indices((4,) * rank).reshape(rank, -1)
    return np.lexsort((*steps[::-1], (steps**2).sum(0), steps.sum(0)))


def lift(block: np.ndarray, axis: int) -> None:
    """The forward transform of each vector along an axis, in place."""
    x, y, z, w = (block.take(i, axis) for i in range(4))
    x = x + w >> 1
    w = w - x
    z = z + y >> 1
    y = y - z
    x = x + z >> 1
    z = z - x
    w = w + y >> 1
    y = y - w
    w = w + (y >> 1)
    y = y - (w >> 1)
    block[...] = np.stack([x, y, z, w], axis)


def unlift(block: np.ndarray, axis: int) -> None:
    x, y, z, w = (block.take(i, axis) for i in range(4))
    y = y + (w >> 1)
    w = w - (y >> 1)
    y = y + w
    w = (w << 1) - y
    z = z + x
    x = (x << 1) - z
    y = y + z
    z = (z << 1) - y
    w = w + x
    x = (x << 1) - w
    block[...] = np.stack([x, y, z, w], axis)


def reached(planes: np.ndarray) -> np.ndarray:
    """For each block and plane (planes: block, plane, place), how many places higher planes have reached."""
    size = planes.shape[2]
    last = np.where(planes.any(2), size - planes[:, :, ::-1].argmax(2), 0)
    return np.concatenate((np.zeros((len(planes), 1), last.dtype), np.maximum.accumulate(last, 1)[:, :-1]), 1)


def code(values: np.ndarray, width: int, budget: np.ndarray) -> np.ndarray:
    """The bits of blocks (block, place; unsigned), as many as budget says, the rest 0."""
    size, n = values.shape[1], int(budget.max(initial=0))
    out = np.zeros((len(values), n), np.uint8)
    shifts = np.arange(width - 1, -1, -1, dtype=np.uint64)
    planes = (values[:, None, :] >> shifts[:, None]) & np.uint64(1) != 0
    start, place = reached(planes)[:, :, None], np.arange(size)
    open_ = np.logical_or.accumulate(planes[:, :, ::-1], 2)[:, :, ::-1]  # whether a place or one after it is set
    before = np.concatenate((np.zeros((*planes.shape[:2], 1), bool), planes[:, :, :-1]), 2)
    tested = (place == start) | (place > start) & before
    given = (place < start) | open_ & (place < size - 1)
    # A test comes before the bit of its place.
    said = np.stack((tested, given), 3).reshape(len(values), -1)
    bits = np.stack((open_, planes), 3).reshape(len(values), -1)
    at = np.cumsum(said, 1) - 1
    block, slot = np.nonzero(said & (at < budget[:, None]))
    out[block, at[block, slot]] = bits[block, slot]
    return out


def uncode(bits: np.ndarray, size: int, width: int, budget: np.ndarray) -> np.ndarray:
    """The values of blocks (block, place) from their bits; what the budget doesn't reach is 0."""
    n_blocks = len(bits)
    values, every = np.zeros((n_blocks, size), np.uint64), np.arange(n_blocks)
    plane, done, at = np.full(n_blocks, width - 1), np.zeros(n_blocks, np.int64), np.zeros(n_blocks, np.int64)
    VERBATIM, TEST, RUN = 0, 1, 2
    state = np.full(n_blocks, TEST)
    for step in range(int(budget.max(initial=0))):
        live = (step < budget) & (plane >= 0)
        if not live.any():
            break
        bit = bits[:, step] != 0
        verbatim, test, run = (live & (state == s) for s in (VERBATIM, TEST, RUN))
        put = every[verbatim & bit]
        values[put, at[put]] |= np.uint64(1) << plane[put].astype(np.uint64)
        at[verbatim] += 1
        state[verbatim & (at >= done)] = TEST
        over = verbatim & (at >= size) | test & ~bit
        # A test that says yes opens a run of places, which ends with a set one; the last place needs no bit.
        state[test & bit] = RUN
        done[run & ~bit] += 1
        hit = every[run & bit | (test & bit | run & ~bit) & (done == size - 1)]
        values[hit, done[hit]] |= np.uint64(1) << plane[hit].astype(np.uint64)
        done[hit] += 1
        state[hit] = TEST
        over[hit] |= done[hit] >= size
        plane[over] -= 1
        at[over] = 0
        state[over] = np.where(done[over] > 0, VERBATIM, TEST)
    cut = every[(state == RUN) & (plane >= 0)]  # the budget ended within a run
    values[cut, done[cut]] |= np.uint64(1) << plane[cut].astype(np.uint64)
    return values


def _settings(dtype: np.dtype, rank: int, rate: float) -> tuple[int, int, int, int]:
    """Width, exponent bits, bias, and the bits of a block."""
    kind = f"{dtype.kind}{dtype.itemsize}"
    if kind not in KINDS or not 1 <= rank <= 3:
        raise UnsupportedError(f"zfp of {kind}, rank {rank}")
    _, width, ebits, bias = KINDS[kind]
    return width, ebits, bias, max(round(4**rank * rate), 1 + ebits if ebits else 1)


def _grid(shape: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(-(-n // 4) for n in shape)


def compress(array: np.ndarray, rate: float) -> bytes:
    """rate bits a value. Blocks at the edge are filled by repeating their last values."""
    rank = array.ndim
    width, ebits, bias, budget = _settings(array.dtype, rank, rate)
    grid = _grid(array.shape)
    whole = np.pad(array, [(0, 4 * g - n) for g, n in zip(grid, array.shape, strict=True)], mode="edge")
    # (g0, 4, g1, 4, ...) to (block, 4, 4, ...)
    whole = whole.reshape([x for g in grid for x in (g, 4)]).transpose(*range(0, 2 * rank, 2), *range(1, 2 * rank, 2)).reshape(-1, *(4,) * rank)
    order, mask = sequency(rank), np.uint64(int("aa" * (width // 8), 16))
    streams = []
    for first in range(0, len(whole), BATCH):
        part = whole[first : first + BATCH]
        bits = np.zeros((len(part), budget), np.uint8)
        left, some = np.full(len(part), budget), np.ones(len(part), bool)
        if ebits:
            x = part.astype(np.float64)
            top = np.abs(x).reshape(len(part), -1).max(1)
            if not np.isfinite(top).all():
                raise UnsupportedError("zfp takes finite values only")
            e = np.maximum(np.frexp(top)[1], 1 - bias)
            some = (top > 0) & (e + bias >= 1)
            head = (2 * (e + bias) + 1).astype(np.uint64)
            bits[:, : 1 + ebits] = (head[:, None] >> np.arange(1 + ebits, dtype=np.uint64)) & np.uint64(1)
            bits[~some] = 0
            left = np.where(some, budget - 1 - ebits, 0)
            block = np.trunc(np.ldexp(x, (width - 2 - e).reshape(-1, *(1,) * rank))).astype(np.int64)
        else:
            block = part.astype(np.int64)
        for axis in range(rank, 0, -1):
            lift(block, axis)
        flat = block.reshape(len(part), -1)[:, order].astype(np.uint64)
        negabinary = ((flat + mask) ^ mask) & np.uint64((1 << width) - 1)
        coded = code(negabinary, width, left)
        begin = 1 + ebits if ebits else 0
        bits[:, begin : begin + coded.shape[1]] |= coded
        streams.append(bits)
    stream = np.packbits(np.concatenate(streams).ravel(), bitorder="little").tobytes() if streams else b""
    return stream + bytes(-len(stream) % 8)


def decompress(data: bytes, shape: tuple[int, ...], dtype: np.dtype, rate: float) -> np.ndarray:
    dtype, rank = np.dtype(dtype), len(shape)
    width, ebits, bias, budget = _settings(dtype, rank, rate)
    grid = _grid(shape)
    n = prod(grid)
    if len(data) * 8 < n * budget:
        raise FormatError("zfp data is cut")
    stream = np.unpackbits(np.frombuffer(data, np.uint8), count=n * budget, bitorder="little").reshape(n, budget)
    order, mask = sequency(rank), np.uint64(int("aa" * (width // 8), 16))
    begin = 1 + ebits if ebits else 0
    left, e = np.full(n, budget), np.zeros(n, np.int64)
    if ebits:
        left = np.where(stream[:, 0] != 0, budget - begin, 0)
        e = (stream[:, 1:begin].astype(np.int64) << np.arange(ebits)).sum(1) - bias
    values = uncode(stream[:, begin:], 4**rank, width, left)
    flat = np.zeros((n, 4**rank), np.int64)
    unsigned = ((values ^ mask) - mask) & np.uint64((1 << width) - 1)
    flat[:, order] = unsigned.astype(np.uint32).view(np.int32) if width == 32 else unsigned.view(np.int64)
    block = flat.reshape(n, *(4,) * rank)
    for axis in range(1, rank + 1):
        unlift(block, axis)
    if ebits:
        block = np.ldexp(block.astype(np.float64), (e - width + 2).reshape(-1, *(1,) * rank))
        block[left == 0] = 0
    whole = block.reshape(*grid, *(4,) * rank).transpose([x for d in range(rank) for x in (d, rank + d)]).reshape([4 * g for g in grid])
    return whole[tuple(slice(0, s) for s in shape)].astype(dtype)


def client_data(dtype: np.dtype, shape: tuple[int, ...], rate: float) -> list[int]:
    """The words that a filter message holds: a version, then a header of magic, type, rank, lengths and bits of a block."""
    rank = len(shape)
    budget = _settings(dtype, rank, rate)[3]
    if budget > 2048 or max(shape) > 1 << LENGTH_BITS[rank]:
        raise UnsupportedError(f"zfp of {shape} at {rate} bits")
    meta = 0
    for n in shape:
        meta = meta << LENGTH_BITS[rank] | n - 1
    meta = meta << 4 | rank - 1 << 2 | KINDS[f"{dtype.kind}{dtype.itemsize}"][0] - 1
    whole = MAGIC + (meta | budget - 1 << 52).to_bytes(8, "little")
    return [VERSION_WORD, *(int.from_bytes(whole[i : i + 4], "little") for i in range(0, 12, 4))]


def from_client_data(words: tuple[int, ...]) -> tuple[float, tuple[int, ...]]:
    """The rate and the shape of what was compressed."""
    whole = b"".join(w.to_bytes(4, "little") for w in words[1:])
    if len(whole) < 12 or whole[:4] != MAGIC:
        raise FormatError("no zfp header")
    head = int.from_bytes(whole[4:12], "little")
    meta, mode = head & (1 << 52) - 1, head >> 52
    rank = (meta >> 2 & 3) + 1
    if mode > 2047:
        raise UnsupportedError("zfp of other than a fixed rate")
    if rank > 3:
        raise UnsupportedError("zfp of rank 4")
    meta, n = meta >> 4, LENGTH_BITS[rank]
    shape = tuple((meta >> n * d & (1 << n) - 1) + 1 for d in reversed(range(rank)))
    return (mode + 1) / 4**rank, shape
