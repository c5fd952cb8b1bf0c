"""Values to and from MATLAB 7.3 files.

Arrays are stored with their dimensions reversed, as MATLAB runs down columns first. Classes are named
by an attribute; text is UTF-16 code units, logicals are bytes, cells hold references, structs are
groups, complex values are records of real and imag, and empties store their dimensions.

Objects (string arrays, tables, datetimes and the like) are those of objects.py; a table may also be a
struct of columns, see register_table.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..errors import FormatError, TypeMismatchError, UnsupportedError
from ..operators.frame import ArrayFrame
from ..sources.h5 import Compound, File, FileBuilder, Fixed, Float, Reference, String, Vlen, of_element
from ..sources.h5.writer import Dataset, Group, attribute
from ..sources.spool import Spool
from .names import dedupe_name, is_valid_name, sanitize_name
from .objects import KNOWN, OPAQUE, Interned, Store, Strings, Table

USERBLOCK, TEXT = 512, 124
DESCRIPTION = "MATLAB 7.3 MAT-file, Platform: Spark"
#: Numeric classes and their element types (fixed values).
CLASSES = {"double": "f64", "single": "f32", "int8": "i8", "int16": "i16", "int32": "i32", "int64": "i64", "uint8": "u8", "uint16": "u16", "uint32": "u32", "uint64": "u64"}
NAMED = {v: k for k, v in CLASSES.items()}


@dataclass(frozen=True)
class Char:
    """Text that stays a char array, and whether a list of texts was its rows."""

    text: str


@dataclass(frozen=True)
class Empty:
    """A value without elements, whose class and dimensions still count."""

    matlab_class: str
    dims: tuple[int, ...] = (0, 0)


def header(description: str = DESCRIPTION) -> bytes:
    """The block before the file proper: text, version 2.0, and the mark of little-endian files."""
    text = "".join(c if c.isascii() and c != "\0" else "?" for c in description)[:TEXT]
    return (text.ljust(TEXT).encode() + b"\x00\x02IM").ljust(USERBLOCK, b"\0")


def verify_header(data: bytes) -> None:
    if len(data) < USERBLOCK:
        raise FormatError("no room for a header")
    if data[124:126] != b"\x00\x02":
        raise FormatError("not version 2.0")
    if data[126:128] != b"IM":
        raise FormatError("not little-endian")


def vector_dims(n: int, row: bool = False) -> tuple[int, int]:
    """A vector's dimensions; without elements it has no orientation."""
    return (0, 0) if not n else (1, n) if row else (n, 1)


def matrix_dims(extents: tuple[int, ...], row: bool = False) -> tuple[int, ...]:
    return (1, 1) if not extents else vector_dims(extents[0], row) if len(extents) == 1 else tuple(extents)


@dataclass(frozen=True)
class StructArray:
    """Structs of the same fields, each field a list with a value for each; without any it still has its fields."""

    fields: dict[str, list]

    def __post_init__(self):
        if len({len(v) for v in self.fields.values()}) > 1:
            raise TypeMismatchError("fields of different lengths")

    def __len__(self) -> int:
        return len(next(iter(self.fields.values()), []))


def elem_size(matlab_class: str) -> int | None:
    """Bytes of an element of a class, None for those without a fixed one."""
    return {"char": 2, "logical": 1}.get(matlab_class) or (int(CLASSES[matlab_class][1:]) // 8 if matlab_class in CLASSES else None)


#: What MatBuilder's options may be.
CHOICES = {"names": ("sanitize", "strict"), "strings": ("char", "string"), "nulls": ("empty", "struct", "skip", "error"), "sequences": ("cell", "double"), "unsupported": ("error", "skip")}


class MatBuilder:
    """Variables of a file to be.

    row: vectors lie, instead of standing. names: what happens to names that MATLAB doesn't take. strings: texts
    are char arrays or string objects. nulls: None is an empty double, an empty struct array, left out, or an error.
    sequences: a list without values is an empty cell or double. unsupported: values without a class are
    an error or left out.
    """

    def __init__(self, row: bool = False, names: str = "sanitize", deflate: int | None = None, description: str = DESCRIPTION, strings: str = "char", nulls: str = "empty", sequences: str = "cell", unsupported: str = "error"):
        self.options = {"names": names, "strings": strings, "nulls": nulls, "sequences": sequences, "unsupported": unsupported}
        for option, value in self.options.items():
            if value not in CHOICES[option]:
                raise TypeMismatchError(f"{option} may be {', '.join(CHOICES[option])}")
        if deflate is not None and not 0 <= deflate <= 9:
            raise TypeMismatchError(f"no deflate level {deflate}")
        self.file, self.row, self.deflate = FileBuilder(USERBLOCK, header(description)), row, deflate
        self.refs: Group | None = None
        self.next_ref = 0
        self.objects = Interned(self._apart)

    def write(self, name: str, value: object) -> MatBuilder:
        if not self._left_out(value):
            self._put(self.file, name, value)
        return self

    def write_to(self, out) -> None:
        """The whole file to a binary stream."""
        out.write(self.finish())

    def _left_out(self, value: object) -> bool:
        if value is None and self.options["nulls"] == "error":
            raise TypeMismatchError("None has no MATLAB value")
        if value is None:
            return self.options["nulls"] == "skip"
        if self.options["unsupported"] == "error" or isinstance(value, (Empty, StructArray, Spool, dict, str, Char, list, tuple, *KNOWN)):
            return False
        x = np.asarray(value)
        return not (x.dtype.names == ("real", "imag") or x.dtype.kind in "bc" or f"{x.dtype.kind}{x.dtype.itemsize * 8}" in NAMED)

    def save(self, path: str) -> None:
        self._subsystem()
        self.file.write(path)

    def finish(self) -> bytes:
        self._subsystem()
        return self.file.finish()

    def _apart(self, value: object):
        """A value by itself, for what refers to it."""
        if self.refs is None:
            self.refs = self.file.members.setdefault("#refs#", Group())
        self.next_ref += 1
        return self._put(self.refs, f"r{self.next_ref}", value, True)

    def _subsystem(self) -> None:
        """The list of objects, an empty cell, and their values, for files that have any."""
        if not self.objects.objects or "#subsystem#" in self.file.members:
            return
        blob = self._class(self.refs.create_dataset("wrapper", np.frombuffer(self.objects.blob(), "u1").reshape(1, -1)), "uint8")
        cells = [blob, self._empty(self.refs, "nothing", "cell", (0, 0)), *self.objects.cells]
        store = self.file.members.setdefault("#subsystem#", Group()).create_dataset("MCOS", cells, shape=(1, len(cells)), kind=Reference())
        self._class(store, "FileWrapper__", object_decode=np.int32(OPAQUE))

    def _name(self, group: Group, name: str) -> str:
        if not is_valid_name(name):
            if self.options["names"] == "strict":
                raise TypeMismatchError(f"{name!r} is no MATLAB name")
            name = sanitize_name(name)
        return dedupe_name(name, set(group.members))

    def _class(self, member, name: str, **more):
        member.set_attr("MATLAB_class", name, String(len(name), "nullpad", "ascii"))
        for k, v in more.items():
            member.set_attr(f"MATLAB_{k}", v)
        return member

    def _empty(self, group: Group, name: str, kind: str, dims: tuple[int, ...]):
        return self._class(group.create_dataset(name, np.array(dims, "<u8")), kind, empty=np.uint8(1))

    def _put(self, group: Group, name: str, value: object, own: bool = False):
        name = name if own else self._name(group, name)
        if isinstance(value, Empty):
            return self._empty(group, name, value.matlab_class, value.dims)
        if value is None:
            return self._empty(group, name, "double" if self.options["nulls"] == "empty" else "struct", (0, 0))
        if isinstance(value, StructArray):
            return self._structs(group, name, value)
        if isinstance(value, str) and self.options["strings"] == "string":
            value = Strings([value], (1, 1))
        if isinstance(value, KNOWN):
            return self._class(group.create_dataset(name, self.objects.add(value).reshape(1, -1)), value.matlab_class, object_decode=np.int32(OPAQUE))
        if isinstance(value, dict):
            made = self._class(group.create_group(name), "struct")
            fields = []
            for k, v in value.items():
                if self._left_out(v):
                    continue
                fields.append(self._name(made, k))
                self._put(made, fields[-1], v, True)
            made.attrs["MATLAB_fields"] = attribute(fields or None)
            return made
        if isinstance(value, str | Char):
            text = value.text if isinstance(value, Char) else value
            units = np.frombuffer(text.encode("utf-16-le"), "<u2")
            if not len(units):
                return self._empty(group, name, "char", (0, 0))
            return self._class(group.create_dataset(name, units.reshape(-1, 1)), "char", int_decode=np.int32(2))
        if isinstance(value, list | tuple):
            return self._cell(group, name, list(value))
        if isinstance(value, Spool) and len(value) and not self.deflate:
            return self._spooled(group, name, value)
        x = value.read() if isinstance(value, Spool) else np.asarray(value)
        dims = matrix_dims(x.shape, self.row)
        if x.dtype.names == ("real", "imag") and x.dtype["real"] == x.dtype["imag"] and (base := f"{x.dtype['real'].kind}{x.dtype['real'].itemsize * 8}") in NAMED:
            kind = Compound.packed(real=of_element(base), imag=of_element(base))  # complex integers, which numpy has as records
            return self._class(group.create_dataset(name, np.ascontiguousarray(x.reshape(dims).T).astype(kind.dtype()), kind=kind), NAMED[base])
        if not x.size:
            return self._empty(group, name, "logical" if x.dtype.kind == "b" else NAMED.get(f"{x.dtype.kind}{x.dtype.itemsize * 8}", "double"), dims)
        stored = np.ascontiguousarray(x.reshape(dims).T)
        how = {"chunks": stored.shape, "filters": [("deflate", self.deflate)]} if self.deflate and x.size > 64 else {}
        if x.dtype.kind == "b":
            return self._class(group.create_dataset(name, stored.astype("u1"), **how), "logical", int_decode=np.int32(1))
        if x.dtype.kind == "c":
            base = f"f{x.dtype.itemsize * 4}"
            kind = Compound.packed(real=of_element(base), imag=of_element(base))
            data = np.zeros(stored.shape, kind.dtype())
            data["real"], data["imag"] = stored.real, stored.imag
            return self._class(group.create_dataset(name, data, kind=kind, **how), NAMED[base])
        element = f"{x.dtype.kind}{x.dtype.itemsize * 8}"
        if element not in NAMED:
            raise TypeMismatchError(f"no MATLAB class for {x.dtype}")
        return self._class(group.create_dataset(name, stored, **how), NAMED[element])

    def _spooled(self, group: Group, name: str, value: Spool):
        """A vector that is copied into the file from where its elements were written."""
        kind = value.kind
        base = f"{kind.dtype().kind}{kind.size * 8}"
        if isinstance(kind, Compound) and [f[0] for f in kind.fields] == ["real", "imag"]:
            base = kind.fields[0][2].element
        if base not in NAMED:
            raise TypeMismatchError(f"no MATLAB class for {kind}")
        return self._class(group.create_dataset(name, value, shape=vector_dims(len(value), self.row)[::-1], kind=kind), NAMED[base])

    def _cell(self, group: Group, name: str, values: list):
        values = [v for v in values if not self._left_out(v)]
        if not values:
            return self._empty(group, name, self.options["sequences"], (0, 0))
        made = [self._apart(v) for v in values]
        dims = vector_dims(len(values), self.row)
        return self._class(group.create_dataset(name, made, shape=dims[::-1], kind=Reference()), "cell")


    def _structs(self, group: Group, name: str, value: StructArray):
        """A group with a dataset of references for each field."""
        if not len(value):
            made = self._empty(group, name, "struct", (0, 0))
            made.attrs["MATLAB_fields"] = attribute(list(value.fields) or None)
            return made
        made, fields = self._class(group.create_group(name), "struct"), []
        for k, values in value.fields.items():
            fields.append(self._name(made, k))
            held = [self._apart(v) for v in values]
            made.create_dataset(fields[-1], held, shape=vector_dims(len(held), self.row)[::-1], kind=Reference())
        made.attrs["MATLAB_fields"] = attribute(fields)
        return made


def write_mat(path: str, values: dict, **how) -> None:
    """A file of variables, all or nothing."""
    builder = MatBuilder(**how)
    for name, value in values.items():
        builder.write(name, value)
    builder.save(path)


def _class_of(attrs: dict, found) -> str:
    name = attrs.get("MATLAB_class")
    if name is None:
        return "struct" if found.is_group else "?"
    return name


def _decode(file: File, address: int):
    found = file.object(address)
    attrs = file.attributes(found)
    kind = _class_of(attrs, found)
    if found.is_group and "EnumerationInstanceTag" in file.links(found):
        links = file.links(found)
        words = {n: np.asarray(file.stored(x := file.object(links[n]), (0,) * len(x.shape), x.shape)).reshape(-1).tolist() for n in ("ClassName", "ValueNames", "ValueIndices")}
        return _store(file).enumeration(words["ClassName"][0], words["ValueNames"], words["ValueIndices"])
    if attrs.get("MATLAB_object_decode") == OPAQUE and found.is_dataset:
        return _store(file).of(file.stored(found, (0,) * len(found.shape), found.shape), lambda address: _decode(file, address))
    if "MATLAB_object_decode" in attrs and found.is_dataset and int(attrs["MATLAB_object_decode"]) > 2:
        raise UnsupportedError(f"objects of class {kind}")
    if found.is_group:
        links = file.links(found)
        fields = attrs.get("MATLAB_fields")
        names = [str(f) for f in fields] if isinstance(fields, list) and fields and isinstance(fields[0], str) else list(links)
        parts = {n: file.object(links[n]) for n in names}
        if parts and all(p.is_dataset and isinstance(p.kind, Reference) and "MATLAB_class" not in file.attributes(p) for p in parts.values()):
            columns = {n: [_decode(file, a) for a in _references(file, p)] for n, p in parts.items()}
            return [dict(zip(columns, row, strict=True)) for row in zip(*columns.values(), strict=True)]
        return {n: _decode(file, links[n]) for n in names}
    if attrs.get("MATLAB_empty"):
        dims = tuple(int(x) for x in np.asarray(file.values(found.kind, file.stored(found, (0,), found.shape))))
        return "" if kind == "char" else [] if kind == "cell" else [] if kind == "struct" else Empty(kind, dims) if kind not in CLASSES and kind != "logical" else np.zeros(dims, bool if kind == "logical" else _dtype(CLASSES[kind]))
    if kind == "cell":
        return [_decode(file, a) for a in _references(file, found)]
    stored = file.stored(found, (0,) * len(found.shape), found.shape)
    if kind == "char":
        units = np.ascontiguousarray(stored.T).astype("<u2")
        rows = [r.tobytes().decode("utf-16-le", errors="surrogatepass") for r in units.reshape(units.shape[0], -1)]
        return rows[0] if len(rows) == 1 else rows
    if isinstance(found.kind, Compound):
        if stored.dtype["real"].kind != "f":
            return np.ascontiguousarray(stored.T)
        return np.ascontiguousarray((stored["real"] + 1j * stored["imag"]).T)
    values = np.asarray(file.values(found.kind, np.ascontiguousarray(stored))).reshape(stored.shape).T
    if kind == "logical":
        values = values.astype(bool)
    elif kind not in CLASSES and kind != "?":
        raise UnsupportedError(f"class {kind}")
    return values[0, 0] if values.shape == (1, 1) else np.ascontiguousarray(values)


def _store(file: File) -> Store:
    """What the file keeps of its objects, read once."""
    if not hasattr(file, "objects_store"):
        below = file.links(file.object(file.root)).get("#subsystem#")
        place = file.links(file.object(below)).get("MCOS") if below is not None else None
        if place is None:
            raise FormatError("objects without a subsystem")
        cells = _references(file, file.object(place))
        blob = file.object(cells[0])
        file.objects_store = Store(cells, file.stored(blob, (0,) * len(blob.shape), blob.shape).tobytes())
    return file.objects_store


def _dtype(element: str) -> np.dtype:
    return np.dtype(f"{element[0]}{int(element[1:]) // 8}")


def _references(file: File, found) -> list[int]:
    """Addresses in MATLAB's order, which is the stored one."""
    return file.stored(found, (0,) * len(found.shape), found.shape).reshape(-1).tolist()


def read_mat(source) -> dict:
    """Variables of a file by name: scalars, arrays in MATLAB's shape, text, lists for cells, dicts for structs."""
    with File(source) as file:
        if file.base:
            verify_header(file._at(0, USERBLOCK))
        return {name: _decode(file, target) for name, target in file.links(file.object(file.root)).items() if not name.startswith("#")}


def variables(spark: SparkSession, path: str) -> DataFrame:
    """name, class, dims, n_elements of each variable; only headers are read."""
    rows = []
    with File(path) as file:
        for name, target in file.links(file.object(file.root)).items():
            if name.startswith("#"):
                continue
            found = file.object(target)
            attrs = file.attributes(found)
            dims = [1, 1] if found.is_group else [int(x) for x in found.shape[::-1]]
            if attrs.get("MATLAB_empty"):
                dims = [int(x) for x in file.stored(found, (0,), found.shape)]
            rows.append((name, _class_of(attrs, found), dims, prod(dims)))
    return spark.createDataFrame(rows, "name string, class string, dims array<long>, n_elements long")


def variable_frame(spark: SparkSession, path: str, name: str, **options) -> ArrayFrame:
    """A numeric variable as a frame in MATLAB's order: i0 runs down the rows."""
    from ..sources.datasource import read_frame

    return read_frame(spark, path, f"/{name}", **options).transpose()


def register_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table, timetable, or struct of equally long columns as a DataFrame, with row_number from 0. Tables of vectors are read
    in parallel, where the DataFrame is used; other tables, and structs, must fit the driver."""
    from . import scan

    if (found := scan.table(spark, path, name)) is not None:
        return found
    with File(path) as file:
        value = _decode(file, file.links(file.object(file.root))[name])
    if isinstance(value, Table):
        return value.frame(spark)
    if not isinstance(value, dict):
        raise TypeMismatchError(f"{name} is no struct")
    columns = {k: v if isinstance(v, list) else np.asarray(v).reshape(-1).tolist() for k, v in value.items()}
    if len({len(c) for c in columns.values()}) > 1:
        raise TypeMismatchError("columns of different lengths")
    return spark.createDataFrame([(i, *row) for i, row in enumerate(zip(*columns.values(), strict=True))], ["row_number", *columns])


__all__ = ["CLASSES", "Char", "Empty", "Fixed", "Float", "MatBuilder", "StructArray", "Vlen", "elem_size", "read_mat", "register_table", "variable_frame", "variables", "write_mat"]
