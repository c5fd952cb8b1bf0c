"""Fixed-rate blocks: size, error and exactness."""

import numpy as np
import pytest

from arrayloom.errors import FormatError, UnsupportedError
from arrayloom.sources import codecs, zfp
from arrayloom.sources.h5.reader import File
from arrayloom.sources.h5.writer import FileBuilder


@pytest.mark.parametrize("shape", [(10,), (7, 9), (5, 6, 4)])
@pytest.mark.parametrize("kind", ["<f8", "<f4"])
def test_error_falls_with_the_rate(shape, kind):
    at = np.indices(shape).sum(0)
    x = (np.sin(at / 3) * 100 + at).astype(kind)
    before = np.inf
    for rate in (8, 16, 30):
        data = zfp.compress(x, rate)
        blocks = int(np.prod([-(-n // 4) for n in shape]))
        assert len(data) == (blocks * 4 ** len(shape) * rate + 63) // 64 * 8
        error = np.abs(zfp.decompress(data, shape, kind, rate).astype(float) - x).max()
        assert error <= before
        before = error
    assert before < 1e-3 * np.abs(x).max()


@pytest.mark.parametrize("kind", ["<i4", "<i8"])
def test_integers_at_full_rate(kind):
    x = (np.arange(64).reshape(8, 8) * 1000 - 20_000).astype(kind)
    got = zfp.decompress(zfp.compress(x, 8 * x.dtype.itemsize), (8, 8), kind, 8 * x.dtype.itemsize)
    assert np.abs(got - x).max() <= 8  # the transform drops low bits


def test_as_a_chunk_filter():
    x = np.arange(12.0)
    packed, mask = codecs.encode(x.tobytes(), [("zfp", (32, (12,)))], x.dtype)
    assert len(packed) == 48 and mask == 0
    assert np.abs(np.frombuffer(codecs.decode(packed, [("zfp", (32, (12,)))], x.dtype, 96)) - x).max() < 1e-4


def test_zeros_and_refusals():
    assert (zfp.decompress(zfp.compress(np.zeros((5, 5)), 4), (5, 5), "<f8", 4) == 0).all()
    with pytest.raises(UnsupportedError):
        zfp.compress(np.array([np.nan] * 4), 8)
    with pytest.raises(UnsupportedError):
        zfp.compress(np.zeros(4, "u1"), 8)
    with pytest.raises(UnsupportedError):
        zfp.compress(np.zeros((4, 4, 4, 4)), 8)
    with pytest.raises(FormatError):
        zfp.decompress(b"", (4,), "<f8", 8)


def plain_bits(values, width, budget):
    """The bits of one block, plane by plane, as the format describes them."""
    out, done, size = [], 0, len(values)
    for k in reversed(range(width)):
        plane = [v >> k & 1 for v in values]
        out += plane[:done]
        while done < size:
            out.append(int(any(plane[done:])))
            if not out[-1]:
                break
            while done < size - 1:
                out.append(plane[done])
                if plane[done]:
                    break
                done += 1
            done += 1
    return (out + [0] * budget)[:budget]


@pytest.mark.parametrize("size", [4, 16, 64])
def test_bits_of_planes(size):
    rng = np.random.default_rng(size)
    for budget in (1, 3, 17, 40, 200, 900):
        values = rng.integers(0, 1 << 16, (20, size), dtype=np.uint64) >> rng.integers(0, 17, (20, size), dtype=np.uint64)
        values[0] = 0
        bits = zfp.code(values, 16, np.full(20, budget))
        assert bits.tolist() == [plain_bits(v, 16, budget) for v in values.tolist()]
    whole = 16 * (2 * size)
    assert (zfp.uncode(zfp.code(values, 16, np.full(20, whole)), size, 16, np.full(20, whole)) == values).all()


def test_many_blocks_at_once():
    x = np.cumsum(np.random.default_rng(0).normal(size=(64, 96)), 1)
    one = zfp.compress(x[:4, :4], 16)
    assert zfp.compress(x, 16)[: len(one)] == one
    assert np.abs(zfp.decompress(zfp.compress(x, 24), x.shape, "<f8", 24) - x).max() < 1e-3


#: Words as other programs write them (fixed values): 16 and 32 floats at 16 and 8 bits.
WORDS = {(16, 16.0): [269504785, 91252346, 242, 66060288], (16, 8.0): [269504785, 91252346, 242, 32505856], (32, 16.0): [269504785, 91252346, 498, 66060288]}


@pytest.mark.parametrize("n, rate", WORDS)
def test_client_data(n, rate):
    words = zfp.client_data(np.dtype("<f4"), (n,), rate)
    assert words == WORDS[n, rate] and zfp.from_client_data(tuple(words)) == (rate, (n,))
    assert len(zfp.compress(np.arange(n, dtype="<f4"), rate)) == n * rate / 8
    deep = zfp.client_data(np.dtype("<f8"), (5, 6, 70), 7)
    assert zfp.from_client_data(tuple(deep)) == (7, (5, 6, 70))


def test_in_a_file():
    x = (np.sin(np.indices((30, 21)).sum(0) / 5) * 50).astype("<f4")
    builder = FileBuilder()
    builder.create_dataset("x", x, chunks=(8, 16), filters=[("zfp", 20)])
    builder.create_dataset("line", x[0].astype("<f8"), chunks=(7,), filters=[("zfp", 32), ("fletcher32", None)])
    with File(builder.finish()) as f:
        assert np.abs(f.read("/x") - x).max() < 1e-2
        assert np.abs(f.read("/line") - x[0]).max() < 1e-5
        assert f.filters(f.resolve("/x"))[0].stage(None) == ("zfp", (20.0, (8, 16)))


def test_transform_undoes_itself_to_rounding():
    x = np.random.default_rng(1).integers(-(2**28), 2**28, (4, 4, 4))
    y = x.copy()
    for a in (2, 1, 0):
        zfp.lift(y, a)
    for a in (0, 1, 2):
        zfp.unlift(y, a)
    assert np.abs(x - y).max() <= 16
