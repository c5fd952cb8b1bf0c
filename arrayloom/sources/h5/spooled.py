"""Elements that were written to files before they have a place in one."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from ...errors import TypeMismatchError

#: Bytes that are held at once of what is copied or encoded.
RUN_BYTES = 4 << 20


@dataclass
class Spool:
    """Elements in order: sources are bytes, or files with how many bytes they hold."""

    kind: object
    sources: list = field(default_factory=list)

    @property
    def nbytes(self) -> int:
        return sum(len(s) if isinstance(s, bytes) else s[1] for s in self.sources)

    def __len__(self) -> int:
        return self.nbytes // self.kind.size

    def runs(self) -> Iterator[bytes]:
        """All bytes, some at a time."""
        for s in self.sources:
            if isinstance(s, bytes):
                yield s
                continue
            with open(s[0], "rb") as file:
                left = s[1]
                while left:
                    if not (data := file.read(min(left, RUN_BYTES))):
                        raise TypeMismatchError(f"{s[0]} ends early")
                    yield data
                    left -= len(data)

    def read(self, first: int = 0, count: int | None = None) -> np.ndarray:
        """Elements from first on; only the bytes they take are read."""
        size = self.kind.size
        low, high, at, out = first * size, (len(self) if count is None else min(first + count, len(self))) * size, 0, []
        for s in self.sources:
            n = len(s) if isinstance(s, bytes) else s[1]
            a, b = max(low - at, 0), min(high - at, n)
            if a < b and isinstance(s, bytes):
                out.append(s[a:b])
            elif a < b:
                with open(s[0], "rb") as file:
                    file.seek(a)
                    out.append(file.read(b - a))
            at += n
        return np.frombuffer(b"".join(out), self.kind.dtype(), max(0, high - low) // size)

    def drop(self) -> None:
        """Deletes the files."""
        for s in self.sources:
            if not isinstance(s, bytes):
                os.unlink(s[0])
