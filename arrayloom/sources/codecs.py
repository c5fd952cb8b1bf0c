"""Chunk filters: deflate, shuffle, fletcher32, LZF, scale-offset and fixed-rate blocks, on bytes with numpy.

A pipeline is a list of (name, parameter); zfp's parameter is bits a value, or with them the chunk's shape, which placed()
adds. Encoding applies it forwards, decoding backwards; bit i of a
chunk's mask says that filter i was left out, as when it could not make the chunk smaller.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..errors import ChecksumError, FormatError, UnsupportedError
from ..operators.frame import ArrayFrame
from . import zfp

#: Registered filter numbers (fixed values).
IDS = {"deflate": 1, "shuffle": 2, "fletcher32": 3, "szip": 4, "nbit": 5, "scaleoffset": 6, "lzf": 32000, "zfp": 32013}
NAMES = {v: k for k, v in IDS.items()}
HEADER = 21  # bytes before a scale-offset chunk's packed values


def shuffle(data: bytes, width: int) -> bytes:
    """Bytes of equal significance together; what is left after the last whole element stays at the end."""
    n = len(data) // width
    if width < 2 or n < 2:
        return data
    body = np.frombuffer(data, np.uint8, n * width).reshape(n, width)
    return body.T.tobytes() + data[n * width :]


def unshuffle(data: bytes, width: int) -> bytes:
    n = len(data) // width
    if width < 2 or n < 2:
        return data
    body = np.frombuffer(data, np.uint8, n * width).reshape(width, n)
    return body.T.tobytes() + data[n * width :]


def fletcher32(data: bytes) -> int:
    """Two sums over big-endian 16-bit words, carries folded back after every 360 words; an odd last byte is a high half."""
    even = data + b"\0" if len(data) % 2 else data
    words = np.frombuffer(even, ">u2").astype(np.uint64)
    one = two = 0
    for at in range(0, len(words), 360):
        block = words[at : at + 360]
        n = len(block)
        total = int(block.sum())
        two += n * one + int((block * np.arange(n, 0, -1, dtype=np.uint64)).sum())
        one += total
        one, two = (one & 0xFFFF) + (one >> 16), (two & 0xFFFF) + (two >> 16)
        one, two = (one & 0xFFFF) + (one >> 16), (two & 0xFFFF) + (two >> 16)
    return (two << 16) | one


def lzf_compress(data: bytes) -> bytes:
    """Literal runs of up to 32 bytes and copies of 3 to 264 bytes from the 8 KiB before."""
    out, seen, at, literal = bytearray(), {}, 0, 0

    def flush(end: int) -> None:
        for s in range(literal, end, 32):
            run = data[s : min(s + 32, end)]
            out.append(len(run) - 1)
            out.extend(run)

    while at < len(data) - 2:
        key = data[at : at + 3]
        before = seen.get(key, -1)
        seen[key] = at
        if before < 0 or at - before > 8192:
            at += 1
            continue
        size, most = 3, min(264, len(data) - at)
        while size < most and data[before + size] == data[at + size]:
            size += 1
        flush(at)
        back, short = at - before - 1, size - 2
        out.append((min(short, 7) << 5) | (back >> 8))
        if short >= 7:
            out.append(short - 7)
        out.append(back & 255)
        at += size
        literal = at
    flush(len(data))
    return bytes(out)


def lzf_decompress(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    try:
        while at < len(data):
            control = data[at]
            at += 1
            if control < 32:
                run = data[at : at + control + 1]
                if len(run) != control + 1:
                    raise FormatError("LZF literals end early")
                out += run
                at += control + 1
                continue
            count = control >> 5
            if count == 7:
                count += data[at]
                at += 1
            start = len(out) - (((control & 31) << 8) | data[at]) - 1
            at += 1
            if start < 0:
                raise FormatError("LZF copies from before the start")
            for k in range(count + 2):
                out.append(out[start + k])
            if len(out) > size:
                raise FormatError("LZF data is longer than its chunk")
    except IndexError:
        raise FormatError("LZF data ends early") from None
    return bytes(out)


def half_away(x: np.ndarray) -> np.ndarray:
    low = np.floor(np.abs(x))
    return np.copysign(low + (np.abs(x) - low >= 0.5), x)


def scaleoffset_compress(data: bytes, dtype: np.dtype, mode: str, digits: int, fill=None) -> bytes:
    """Offsets from the chunk's minimum in as few bits as hold them all; a fill value takes the code of all ones."""
    values = np.frombuffer(data, dtype)
    filled = np.zeros(len(values), bool) if fill is None else values == dtype.type(fill)
    own = values[~filled]
    width = dtype.itemsize * 8
    if mode == "integer":
        low = int(own.min()) if len(own) else 0
        span = (int(own.max()) - low if len(own) else 0) + 1
        offsets = (values.astype(np.int64 if dtype.kind == "i" else np.uint64) - np.array(low).astype(np.int64 if dtype.kind == "i" else np.uint64)).astype(np.uint64)
        minimum = low & (1 << 64) - 1
    else:
        scale = dtype.type(10.0**digits)
        least = own.min() if len(own) else dtype.type(0)
        offsets = half_away(values * scale - least * scale)
        span = (int(offsets[~filled].max()) if len(own) else 0) + 1
        offsets = np.where(filled, 0, offsets).astype(np.uint64)
        minimum = int.from_bytes(np.array(least, dtype).tobytes(), "little")
    bits = int(span - 1 + (fill is not None)).bit_length()
    head = min(bits, width).to_bytes(4, "little") + b"\x08" + minimum.to_bytes(8, "little")
    head += bytes(HEADER - len(head))
    if bits >= width:
        return head + data
    if not bits:
        return head
    offsets = np.where(filled, (1 << bits) - 1, offsets).astype(np.uint64)
    stream = ((offsets[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(stream.ravel()).tobytes()
    return head + packed.ljust(len(values) * bits // 8 + 1, b"\0")


def scaleoffset_decompress(data: bytes, dtype: np.dtype, mode: str, digits: int, n: int, fill=None) -> bytes:
    if len(data) < HEADER:
        raise FormatError("scale-offset header is cut")
    bits = int.from_bytes(data[:4], "little")
    minimum = int.from_bytes(data[5:13], "little")
    if bits >= dtype.itemsize * 8:
        return data[HEADER : HEADER + n * dtype.itemsize]
    if bits:
        stream = np.unpackbits(np.frombuffer(data, np.uint8, offset=HEADER), count=n * bits).reshape(n, bits)
        offsets = (stream.astype(np.uint64) << np.arange(bits - 1, -1, -1, dtype=np.uint64)).sum(1, dtype=np.uint64)
    else:
        offsets = np.zeros(n, np.uint64)
    if mode == "integer":
        values = (offsets + np.uint64(minimum)).astype(np.dtype(f"u{dtype.itemsize}")).view(dtype)
    else:
        least = np.frombuffer(minimum.to_bytes(8, "little")[: dtype.itemsize], dtype)[0]
        values = (offsets.astype(dtype) / dtype.type(10.0**digits) + least).astype(dtype)
    if fill is not None and bits:
        values = np.where(offsets == np.uint64((1 << bits) - 1), dtype.type(fill), values)
    return values.tobytes()


def check_pipeline(filters: list) -> None:
    """Refuses filters that can't follow one another."""
    names = [f for f, _ in filters]
    if unknown := [n for n in names if n not in IDS]:
        raise UnsupportedError(f"no filter {unknown[0]}")
    for a, b in (("scaleoffset", "shuffle"), ("lzf", "deflate"), ("zfp", "shuffle"), ("zfp", "scaleoffset"), ("zfp", "deflate"), ("zfp", "lzf")):
        if a in names and b in names:
            raise UnsupportedError(f"{a} and {b} don't go together")


def is_lossless(filters: list) -> bool:
    return not any(f == "zfp" or f == "scaleoffset" and p[0] == "float" for f, p in filters)


def placed(filters: list, chunks: tuple[int, ...]) -> list:
    """filters as they stand for chunks of a shape."""
    return [(f, (p, tuple(chunks))) if f == "zfp" and not isinstance(p, tuple) else (f, p) for f, p in filters]


def encode(data: bytes, filters: list, dtype: np.dtype, fill=None) -> tuple[bytes, int]:
    """A chunk through its pipeline, and the mask of filters left out."""
    mask = 0
    for i, (name, parameter) in enumerate(filters):
        if name == "deflate":
            data = zlib.compress(data, 6 if parameter is None else parameter)
        elif name == "shuffle":
            data = shuffle(data, dtype.itemsize)
        elif name == "fletcher32":
            data += fletcher32(data).to_bytes(4, "little")
        elif name == "lzf":
            small = lzf_compress(data)
            if len(small) < len(data):
                data = small
            else:
                mask |= 1 << i
        elif name == "scaleoffset":
            data = scaleoffset_compress(data, dtype, *parameter, fill)
        elif name == "zfp":
            data = zfp.compress(np.frombuffer(data, dtype).reshape(parameter[1]), parameter[0])
        else:
            raise UnsupportedError(f"no encoder for {name}")
    return data, mask


def decode(data: bytes, filters: list, dtype: np.dtype, size: int, mask: int = 0, fill=None) -> bytes:
    """The chunk's size bytes again; never more than a bounded amount is inflated."""
    for i in reversed(range(len(filters))):
        name, parameter = filters[i]
        if mask >> i & 1:
            continue
        if name == "deflate":
            inflater = zlib.decompressobj()
            try:
                data = inflater.decompress(data, size + size // 8 + 4096)
            except zlib.error as e:
                raise FormatError(f"deflate: {e}") from None
            if inflater.unconsumed_tail:
                raise FormatError("deflate data is longer than its chunk")
        elif name == "shuffle":
            data = unshuffle(data, dtype.itemsize)
        elif name == "fletcher32":
            data, stored = data[:-4], int.from_bytes(data[-4:], "little")
            if fletcher32(data) != stored:
                raise ChecksumError("fletcher32 differs")
        elif name == "lzf":
            data = lzf_decompress(data, size + size // 8 + 4096)
        elif name == "scaleoffset":
            data = scaleoffset_decompress(data, dtype, *parameter, size // dtype.itemsize, fill)
        elif name == "zfp":
            data = zfp.decompress(data, tuple(parameter[1]), dtype, parameter[0]).tobytes()
        else:
            raise UnsupportedError(f"no decoder for {name}")
    if len(data) != size:
        raise FormatError(f"a chunk has {len(data)} bytes, not {size}")
    return data


#: numpy's name of each element type.
NUMPY = {"i8": "<i1", "i16": "<i2", "i32": "<i4", "i64": "<i8", "u8": "<u1", "u16": "<u2", "u32": "<u4", "u64": "<u8", "f32": "<f4", "f64": "<f8"}


def to_chunks(frame: ArrayFrame, filters: list):
    """chunk, payload, mask: each chunk encoded where its elements meet. Absent elements have the fill value, or are zero."""
    check_pipeline(filters)
    frame = frame.rebased()
    dtype, chunks, rank, fill = np.dtype(NUMPY[frame.element]), frame._grid_chunks(), frame.rank, frame.fill
    filters = placed(filters, chunks)
    size = int(np.prod(chunks))

    def pack(key, group):
        start = key[0].as_py()
        place = np.zeros(group.num_rows, np.int64)
        for d in range(rank):
            place = place * chunks[d] + group.column(f"i{d}").to_numpy() - start[d]
        block = np.full(size, 0 if fill is None else fill, dtype)
        block[place] = group.column("value").to_numpy()
        payload, mask = encode(block.tobytes(), filters, dtype, fill)
        return pa.table({"chunk": pa.array([start], pa.list_(pa.int64())), "payload": pa.array([payload], pa.binary()), "mask": pa.array([mask], pa.int32())})

    return frame.with_chunk().groupBy("chunk").applyInArrow(pack, "chunk array<long>, payload binary, mask int")


def from_chunks(chunks_df, frame: ArrayFrame, filters: list) -> ArrayFrame:
    """Elements of encoded chunks, cut at the dataset's edge."""
    frame = frame.rebased()
    dtype, chunks, shape, fill = np.dtype(NUMPY[frame.element]), frame._grid_chunks(), frame.shape, frame.fill
    filters = placed(filters, chunks)
    size = int(np.prod(chunks)) * dtype.itemsize
    kind, coords = frame.df.schema["value"].dataType.simpleString(), frame.coords

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload, mask in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                block = np.frombuffer(decode(payload, filters, dtype, size, mask, fill), dtype).reshape(chunks)
                block = block[tuple(slice(0, min(c, n - s)) for c, n, s in zip(chunks, shape, start, strict=True))]
                at = np.indices(block.shape).reshape(len(chunks), -1) + np.array(start)[:, None]
                yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in at], pa.array(block.ravel())], names=[*coords, "value"])

    schema = ", ".join([*[f"{c} long" for c in coords], f"value {kind}"])
    return frame._with(chunks_df.select("chunk", "payload", "mask").mapInArrow(unpack, schema))


def roundtrip(frame: ArrayFrame, filters: list) -> ArrayFrame:
    """frame encoded to chunks and decoded again."""
    narrow = frame._with(frame.df.select(*frame.coords, F.col(frame.value).alias("value")))
    return from_chunks(to_chunks(narrow, filters), narrow, filters)
