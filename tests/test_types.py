"""Numbers of any layout, addresses, marks and free space of files."""

import io
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arrayloom.errors import FormatError, TypeMismatchError, UnsupportedError
from arrayloom.options import MetadataCache
from arrayloom.sources.h5 import (
    AddressRange, BitField, File, FileBuilder, FileSpaceInfo, FillTime, Fixed, Float, MessageType, PhysicalAddress, StatusFlags, StoredAddress, Superblock, Time,
    clear_status_flags, file_space_info,
)
from arrayloom.sources.h5 import space
from arrayloom.sources.h5.checksum import lookup3
from arrayloom.sources.h5.types import parse
from arrayloom.sources.h5.writer import Group


def there_and_back(kind):
    got, at = parse(kind.encoded())
    assert got == kind and at == len(kind.encoded())
    return got


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 8), st.booleans(), st.booleans(), st.data())
def test_integers_of_any_bits(size, signed, big, data):
    offset = data.draw(st.integers(0, 8 * size - 1))
    bits = data.draw(st.integers(1, 8 * size - offset))
    kind = there_and_back(Fixed(size, signed, big, offset, None if bits == 8 * size else bits, high_padding=data.draw(st.booleans())))
    low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
    values = data.draw(st.lists(st.integers(low, high), min_size=1, max_size=5))
    noise = data.draw(st.integers(0, (1 << 8 * size) - 1)) & ~(((1 << bits) - 1) << offset)
    stored = b"".join((noise | (v & (1 << bits) - 1) << offset).to_bytes(size, "big" if big else "little") for v in values)
    assert kind.decode(np.frombuffer(stored, kind.dtype())).tolist() == values
    field = there_and_back(BitField(size, big, offset, None if bits == 8 * size else bits))
    assert field.decode(np.frombuffer(stored, field.dtype())).tolist() == [v & (1 << bits) - 1 for v in values]


def test_builders_check():
    kind = Fixed.builder().size(4).byte_order("big").signed(True).bit_offset(3).bit_precision(20).low_padding(True).high_padding(False).build()
    assert kind == Fixed(4, True, True, 3, 20, True) and kind.layout == (True, 3, 20, True, False) and (kind.byte_order, kind.bit_offset, kind.bit_precision) == ("big", 3, 20)
    assert Fixed.from_layout(4, "big", kind.layout) == kind and kind.with_padding(False, True).high_padding
    assert BitField.builder().size(2).byte_order("little").bit_precision(5).build() == BitField(2, False, 0, 5)
    for bad in (Fixed.builder().size(4), BitField.builder().size(2).byte_order("little"), Float.builder().size(4)):
        with pytest.raises(TypeMismatchError):
            bad.build()
    for make in (lambda: Fixed(2, offset=10, precision=7), lambda: BitField(1, precision=9), lambda: Float(3), lambda: Time(4, precision=40), lambda: Float(4, fields=(31, 23, 8, 20, 23, 127))):
        with pytest.raises(TypeMismatchError):
            make()
    with pytest.raises(AttributeError):
        Fixed.builder().exponent_bias(3)
    assert there_and_back(Time(4, True, 31)).decode(np.array([7], ">i4")).tolist() == [7]


def test_floats_of_any_fields():
    values = [0.0, -0.0, 1.5, -2.25, 3e5, 1e-7, float("inf"), -float("inf"), 2.0**-24]
    for kind, code in ((Float(2), "e"), (Float(4), "f"), (Float(8, True), "d")):
        kept = there_and_back(kind)
        order = ">" if kind.big else "<"
        stored = b"".join(struct.pack(order + code, v) if abs(v) < 6e4 or v in (float("inf"), -float("inf")) or code != "e" else struct.pack(order + code, 0) for v in values)
        want = [struct.unpack(order + code, stored[i : i + kind.size])[0] for i in range(0, len(stored), kind.size)]
        assert kept.decode(np.frombuffer(stored, kept.dtype())).tolist() == want
        assert Float(kind.size, kind.big, kind.parts, "implied", 0, 8 * kind.size).plain() == kind and kind.layout["exponent_bias"] == kind.exponent_bias
    # Upper halves of four-byte numbers, as some programs keep.
    half = there_and_back(Float(2, False, (15, 7, 8, 0, 7, 127)))
    assert not half.is_ieee and half.element == "f64"
    stored = b"".join(struct.pack("<f", v)[2:] for v in (1.5, -2.25, 0.0, float("inf"), 2.0**-130))
    assert half.decode(np.frombuffer(stored, half.dtype())).tolist() == [1.5, -2.25, 0.0, float("inf"), 2.0**-130]
    # All of the mantissa stored, its first bit before the point.
    whole = there_and_back(Float(1, False, (7, 4, 3, 0, 4, 3), "none"))
    assert whole.decode(np.frombuffer(bytes([0b0_100_1100, 0b1_011_1000]), whole.dtype())).tolist() == [3.0, -1.0]
    built = Float.builder().size(2).byte_order("little").mantissa_normalization("implied").sign_location(15).exponent_location(7).exponent_size(8).mantissa_location(0).mantissa_size(7).exponent_bias(127).bit_precision(16).build()
    assert built == half and Float.from_layout(2, "little", half.layout) == half and Float.ieee(4, "big") == Float(4, True)


def test_numbers_of_any_layout_in_files():
    builder = FileBuilder()
    odd, half = Fixed(4, True, False, 5, 12), Float(2, False, (15, 7, 8, 0, 7, 127))
    builder.create_dataset("odd", np.array([(v & 0xFFF) << 5 for v in (-7, 0, 2047)], "<u4").view("<i4"), kind=odd)
    builder.create_dataset("half", np.frombuffer(b"".join(struct.pack("<f", v)[2:] for v in (1.5, -8.0)), "V2"), kind=half, shape=(2,))
    builder.create_dataset("bits", np.array([1, 255], "u1"), kind=BitField(1, precision=3))
    with File(builder.finish()) as f:
        assert f.read("/odd").tolist() == [-7, 0, 2047] and f.read("/half").tolist() == [1.5, -8.0] and f.read("/bits").tolist() == [1, 7]


def test_addresses():
    a, b = PhysicalAddress(100), PhysicalAddress(160)
    assert b.checked_distance_from(a) == 60 and a.checked_distance_from(b) is None and a.checked_sub(101) is None and a.checked_add(60) == b
    with pytest.raises(FormatError):
        PhysicalAddress((1 << 64) - 1).checked_add(1)
    assert StoredAddress.undefined(4).is_undefined(4) and not StoredAddress(7).is_undefined()
    r, s = AddressRange(a, 60), AddressRange(b, 10)
    assert r.adjoins(s) and r.precedes(s) and not r.overlaps(s) and r.intersection(s) is None
    assert r.contains(AddressRange(PhysicalAddress(110), 5)) and r.intersection(AddressRange(PhysicalAddress(150), 50)) == AddressRange(PhysicalAddress(150), 10)
    assert AddressRange(a, 0).is_empty and r.end == b
    with File(FileBuilder(userblock=512).finish()) as f:
        assert f.physical(StoredAddress(48)) == PhysicalAddress(560) and f.stored_address(PhysicalAddress(560)) == StoredAddress(48)
        with pytest.raises(FormatError):
            f.stored_address(PhysicalAddress(10))
        with pytest.raises(FormatError):
            f.physical(StoredAddress.undefined())
    assert MessageType(12).name == "attribute" and MessageType(99).unknown_id == 99 and not MessageType(99).is_known and MessageType(5) == MessageType(5)


def test_marks_of_a_writer(tmp_path):
    path = tmp_path / "f.h5"
    builder = FileBuilder()
    builder.create_dataset("x", np.arange(5))
    builder.write(str(path))
    data = bytearray(path.read_bytes())
    data[11] = 5
    data[44:48] = lookup3(bytes(data[:44])).to_bytes(4, "little")
    path.write_bytes(data)
    with File(str(path)) as f:
        mark = Superblock.of(f)
        assert mark.flags == StatusFlags.WRITE | StatusFlags.SWMR_WRITE and not mark.flags.is_inconsistent and (mark.version, mark.extension) == (3, None) and f.file_size == len(data)
    assert clear_status_flags(str(path)) == 5 and clear_status_flags(str(path)) == 0
    with File(str(path)) as f:
        assert f.read("/x").tolist() == list(range(5)) and not Superblock.of(f).flags
    assert StatusFlags(4).is_inconsistent and StatusFlags(12).unknown_bits == 8


def test_settings_that_files_record():
    builder = FileBuilder(link_phase_change=(2, 1), space=FileSpaceInfo("page", False, 3, 8192))
    for i in range(3):
        builder.create_dataset(f"d{i}", np.arange(i), fill_time=list(FillTime)[i])
    kind = builder.commit_datatype("shared", Fixed(2)) if hasattr(builder, "commit_datatype") else None
    made = builder.create_group_with("inner", lambda g: g.create_group("deep"), link_phase_change=(0, 0))
    builder.add_group("ready", Group()).set_attr("n", 3)
    if kind is not None:
        made.set_attr_committed("v", np.arange(3), kind)
    with pytest.raises(ZeroDivisionError):
        builder.create_group_with("never", lambda g: 1 / 0)
    with pytest.raises(TypeMismatchError):
        Group(link_phase_change=(2, 9))
    with pytest.raises(UnsupportedError):
        FileBuilder(space=FileSpaceInfo(persist=True))
    with File(builder.finish()) as f:
        info = file_space_info(f)
        assert (info.strategy, info.persist, info.threshold, info.page_size) == ("page", False, 3, 8192)
        assert f.link_phase_change(f.resolve("/")) == (2, 1) and f.link_phase_change(f.resolve("/inner")) == (0, 0) and f.link_phase_change(f.resolve("/ready")) == (8, 6)
        assert [f.fill_time(f.resolve(f"/d{i}")) for i in range(3)] == list(FillTime)
        assert f.resolve("/inner/deep").is_group and "never" not in f.links(f.resolve("/")) and f.attributes(f.resolve("/ready"))["n"] == 3
        if kind is not None:
            assert f.attributes(f.resolve("/inner"))["v"].tolist() == [0, 1, 2] and f.attribute_types(f.resolve("/inner"))["v"] == Fixed(2)
    with File(FileBuilder().finish()) as f:
        assert file_space_info(f) is None and space.persisted_free_sections(f) == []


def test_free_sections_by_hand():
    """A manager and its list as the format describes them: two sections of 64 bytes, one of 300."""
    seal = lambda b: b + lookup3(b).to_bytes(4, "little")
    u8 = lambda *xs: b"".join(x.to_bytes(8, "little") for x in xs)
    body = b"FSSE\0" + u8(64)
    body += bytes([2]) + (64).to_bytes(2, "little") + (1000).to_bytes(4, "little") + b"\0" + (500).to_bytes(4, "little") + b"\0"
    body += bytes([1]) + (300).to_bytes(2, "little") + (4000).to_bytes(4, "little") + b"\0"
    listed = seal(body)
    head = seal(b"FSHD" + bytes([0, 1]) + u8(428, 3, 3, 0) + (2).to_bytes(2, "little") + (80).to_bytes(2, "little") + (120).to_bytes(2, "little") + (32).to_bytes(2, "little") + u8(512, 256, len(listed), len(listed)))
    data = bytes(64) + head.ljust(192, b"\0") + listed
    file = File.__new__(File)
    file.metadata_config = MetadataCache()
    file.stream, file.base, file.length, file.offset_size, file.length_size = io.BytesIO(data), 0, len(data), 8, 8
    found = space.free_sections(file, 64)
    assert [(s.address, s.length, s.end_address) for s in found.sections] == [(500, 64, 564), (1000, 64, 1064), (4000, 300, 4300)]
    assert found.free_bytes == 428 and found.section_count == 3 and found.sections[0].range == AddressRange(StoredAddress(500), 64)
