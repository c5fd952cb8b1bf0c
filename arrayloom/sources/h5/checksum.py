"""The format's metadata checksum: Bob Jenkins's public-domain lookup3 hash of little-endian words."""

from __future__ import annotations

M = 0xFFFFFFFF
#: Rotations of the two mixing steps (fixed values).
MIX, FINAL = (4, 6, 8, 16, 19, 4), (14, 11, 25, 16, 4, 14, 24)


def _turn(x: int, k: int) -> int:
    return (x << k | x >> 32 - k) & M


def lookup3(data: bytes, start: int = 0) -> int:
    n = len(data)
    state = [(0xDEADBEEF + n + start) & M] * 3
    if not n:
        return state[2]
    for at in range(0, n, 12):
        block = data[at : at + 12].ljust(12, b"\0")
        state = [v + int.from_bytes(block[4 * i : 4 * i + 4], "little") & M for i, v in enumerate(state)]
        if at + 12 < n:
            for i, k in enumerate(MIX):  # each word in turn, from the one before it
                x, y, z = i % 3, (i + 2) % 3, (i + 1) % 3
                state[x] = (state[x] - state[y] & M) ^ _turn(state[y], k)
                state[y] = state[y] + state[z] & M
    for i, k in enumerate(FINAL):
        x, y = (i + 2) % 3, (i + 1) % 3
        state[x] = (state[x] ^ state[y]) - _turn(state[y], k) & M
    return state[2]
