"""Options of files and datasets, validated where they are made.

Spark bounds memory per task and publishes files by one rename, so options that tune an in-place storage
engine (page buffers, free-space managers, locks, phase changes of links) are accepted, checked and
reported, and change nothing about results.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum

from .errors import TypeMismatchError


class LibVer(Enum):
    """Format generations, by the superblock each may write (fixed values)."""

    EARLIEST = 0
    V18 = 2
    V110 = 3
    V112 = 3.1
    V114 = 3.2

    @classmethod
    def from_superblock_version(cls, version: int) -> LibVer:
        return {0: cls.EARLIEST, 1: cls.EARLIEST, 2: cls.V18, 3: cls.V110}[version]

    @property
    def label(self) -> str:
        return self.name.lower()


class Locking(Enum):
    ENABLED = "enabled"
    DISABLED = "disabled"
    BEST_EFFORT = "best_effort"


class SyncPolicy(Enum):
    ALWAYS = "always"
    CLOSE = "close"


class SpaceStrategy(Enum):
    FSM_AGGR = "fsm_aggr"
    PAGE = "page"
    AGGR = "aggr"
    NONE = "none"


@dataclass(frozen=True)
class ChunkCache:
    """Decoded chunks that a reader keeps: up to so many bytes and slots."""

    max_bytes: int = 1 << 20
    max_slots: int = 16
    index_cache: bool = True

    def __post_init__(self):
        if self.max_bytes < 0 or self.max_slots < 0:
            raise TypeMismatchError("a cache's bounds are not negative")

    @classmethod
    def from_h5p_cache(cls, slots: int, size: int) -> ChunkCache:
        return cls(size, slots)

    @classmethod
    def disabled(cls) -> ChunkCache:
        return cls(0, 0, False)

    def with_max_bytes(self, n: int) -> ChunkCache:
        return replace(self, max_bytes=n)

    def with_max_slots(self, n: int) -> ChunkCache:
        return replace(self, max_slots=n)

    def with_index_cache(self, on: bool) -> ChunkCache:
        return replace(self, index_cache=on)


@dataclass
class CacheStats:
    """What a cache did; counts only grow until reset."""

    hits: int = 0
    misses: int = 0
    evictions: int = 0
    oversize: int = 0
    cached: int = 0
    cached_bytes: int = 0

    @property
    def lookups(self) -> int:
        return self.hits + self.misses

    @property
    def hit_rate(self) -> float | None:
        return self.hits / self.lookups if self.lookups else None

    def reset(self) -> None:
        self.hits = self.misses = self.evictions = self.oversize = 0


@dataclass(frozen=True)
class MetadataCache:
    max_bytes: int = 0
    max_entry_bytes: int = 4096

    def __post_init__(self):
        if self.max_bytes < 0 or self.max_entry_bytes < 0:
            raise TypeMismatchError("a cache's bounds are not negative")

    @property
    def is_enabled(self) -> bool:
        return self.max_bytes > 0

    @classmethod
    def disabled(cls) -> MetadataCache:
        return cls(0)


@dataclass(frozen=True)
class FileSpace:
    strategy: SpaceStrategy = SpaceStrategy.FSM_AGGR
    persist: bool = False
    threshold: int = 1
    page_size: int = 4096

    def __post_init__(self):
        if self.threshold < 0 or not 512 <= self.page_size <= 1 << 30:
            raise TypeMismatchError("a page has 512 bytes to 1 GiB")


@dataclass(frozen=True)
class Access:
    """How a file is opened."""

    chunk_cache: ChunkCache = field(default_factory=ChunkCache)
    metadata_cache: MetadataCache = field(default_factory=MetadataCache)
    locking: Locking = Locking.ENABLED
    sync: SyncPolicy = SyncPolicy.ALWAYS
    libver: tuple[LibVer, LibVer] | None = None
    page_buffer: int = 0

    def __post_init__(self):
        if self.libver and self.libver[0].value > self.libver[1].value:
            raise TypeMismatchError("the low bound is over the high one")
        if self.page_buffer < 0:
            raise TypeMismatchError("a page buffer is not negative")

    def with_(self, **changed) -> Access:
        return replace(self, **changed)


@dataclass(frozen=True)
class Repack:
    drop: tuple[str, ...] = ()
    libver: tuple[LibVer, LibVer] | None = None
    space: FileSpace | None = None

    def drop_path(self, path: str) -> Repack:
        return replace(self, drop=(*self.drop, path))


@dataclass(frozen=True)
class Append:
    """lossy_tail: whether a partial last chunk may be encoded again by a lossy filter, 'reject' or 'allow'."""

    lossy_tail: str = "reject"

    def __post_init__(self):
        if self.lossy_tail not in ("reject", "allow"):
            raise TypeMismatchError(self.lossy_tail)
