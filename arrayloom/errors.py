"""One exception class for each family of failure that a user can tell apart."""

from __future__ import annotations


class ArrayError(Exception):
    """Any failure of this package."""


class FormatError(ArrayError):
    """Bytes that are not a well-formed file."""


class UnsupportedError(ArrayError):
    """A well-formed file that uses something this package does not read or write."""


class NotFoundError(ArrayError):
    """No object at a path."""


class SelectionError(ArrayError):
    """A region of the wrong rank, or out of bounds."""


class TypeMismatchError(ArrayError):
    """Values of another type or shape than the dataset's."""


class LinkError(ArrayError):
    """A soft link that dangles or goes round, or an external link."""


class ChecksumError(FormatError):
    """Stored and computed checksums differ."""
