"""Names of variables and fields: a letter, then letters, digits and underscores; no keyword; at most LONGEST."""

from __future__ import annotations

import re

LONGEST = 2048
#: Reserved words (fixed values).
KEYWORDS = (
    "break", "case", "catch", "classdef", "continue", "else", "elseif", "end", "events", "for", "function", "global", "if", "methods",
    "otherwise", "parfor", "persistent", "properties", "return", "spmd", "switch", "try", "while",
)
_VALID = re.compile(r"[A-Za-z][A-Za-z0-9_]*\Z")


def is_valid_name(name: str) -> bool:
    return bool(_VALID.match(name)) and len(name) <= LONGEST and name not in KEYWORDS


def sanitize_name(name: str) -> str:
    """A valid name like name: x before what can't come first, underscores for what can't come at all."""
    if not name:
        return "x"
    out = re.sub(r"[^A-Za-z0-9_]", "_", name)
    if not ("a" <= out[0].lower() <= "z"):
        out = "x" + out
    return (out + "_" if out in KEYWORDS else out)[:LONGEST]


def dedupe_name(name: str, used: set[str]) -> str:
    """name, or name with the first free of _1, _2, ... after it."""
    out, k = name, 0
    while out in used:
        k += 1
        tail = f"_{k}"
        out = name[: LONGEST - len(tail)] + tail
    return out
