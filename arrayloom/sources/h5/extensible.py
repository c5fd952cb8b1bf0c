"""Extensible arrays: chunk records of a dataset that grows, by place, in blocks that double as it does.

Place p below HEAD stands in the index block. After it, level u holds 2 ** u times MIN_BLOCK places in
2 ** (u // 2) data blocks. The blocks of the first LEVELS_INSIDE levels are listed in the index block,
those of each later level in a block of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Creation parameters (fixed values): bits of a place, places in the index block, in the least data block, pointers, bits of a page.
PLACE_BITS, HEAD, MIN_BLOCK, POINTERS, PAGE_BITS = 32, 4, 16, 4, 10


@dataclass(frozen=True)
class Geometry:
    place_bits: int = PLACE_BITS
    head: int = HEAD
    min_block: int = MIN_BLOCK
    pointers: int = POINTERS
    page_bits: int = PAGE_BITS

    @property
    def levels(self) -> int:
        return 1 + self.place_bits - (self.min_block.bit_length() - 1)

    @property
    def levels_inside(self) -> int:
        return 2 * (self.pointers.bit_length() - 1)

    @property
    def offset_size(self) -> int:
        return (self.place_bits + 7) // 8

    def blocks(self, level: int) -> int:
        return 1 << level // 2

    def block_places(self, level: int) -> int:
        return self.min_block << (level + 1) // 2

    def start(self, level: int) -> int:
        """The first place of a level, counted after the index block's own."""
        return ((1 << level) - 1) * self.min_block

    def blocks_before(self, level: int) -> int:
        return sum(self.blocks(k) for k in range(level))

    def pages(self, level: int) -> int:
        """Pages of a data block, 0 if it is whole."""
        return self.block_places(level) >> self.page_bits if self.block_places(level) > 1 << self.page_bits else 0

    def where(self, place: int) -> tuple[int, int, int]:
        """Level, data block in it and place in that, of a place after the index block's own."""
        level = (place // self.min_block + 1).bit_length() - 1
        inside = place - self.start(level)
        return level, inside // self.block_places(level), inside % self.block_places(level)
