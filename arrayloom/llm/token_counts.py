"""Token counts of every prefix of a text, without encoding it again.

Within a pre-token, dynamic programming over byte prefixes keeps the last token of each prefix's
encoding: the token t ends the prefix of length i exactly if t is a suffix of it and t may follow the
last token of the prefix of length i - len(t), which a table of compatible neighbours answers. The
count is that prefix's count plus one. Between pre-tokens counts add up, so a text costs one look-up
for each word and a corpus costs one program run for each distinct word of a worker.

Defined results: a null text counts as empty; an empty text has one prefix, of 0 tokens; strings of
special tokens inside a text are one token each, as the tokenizer's library has it by default; repeated
rows give repeated rows; added columns replace ones of the same name; an empty table stays empty.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import table

#: How many units a worker remembers from one text to the next: a bound of its memory, not of what is counted.
REMEMBERED_UNITS = 500_000
#: Bytes after which the beginnings of words are remembered, the longest first.
STEMS = (8, 5)
LIMIT = 1024
SPECIAL = "<|endoftext|>"


class PrefixCounter:
    """Counts for byte-level BPE given by ranks; pattern splits a text into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, special: str | None = SPECIAL):
        import regex
        import tiktoken

        self.ranks = ranks
        self.special = special
        self.pieces = regex.compile(pattern)
        # A unit: the part of a run of blanks that is a pre-token of its own, then one more pre-token. A
        # prefix of the text cuts one unit only, and what precedes a unit never depends on it.
        # Words come first, as most units are one; no other unit starts like them.
        self.units = regex.compile(rf" ?\p{{L}}+|(?:\s+(?!\S))?(?:{pattern.replace('|' + chr(92) + 's+(?!' + chr(92) + 'S)', '').replace('|' + chr(92) + 's+', '')}|\s)")
        #: The longest token that ends in four given bytes: how far back a prefix's last token can start.
        self.reach: dict[bytes, int] = {}
        for token in ranks:
            if len(token) > 3 and len(token) > self.reach.get(token[-4:], 3):
                self.reach[token[-4:]] = len(token)
        core = tiktoken.Encoding("prefix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.merge = core.encode_single_piece
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.stems: dict[bytes, tuple[list[bytes], list[int]]] = {}
        self.forget()

    def may_follow(self, a: bytes, b: bytes) -> bool:
        """Whether the encoding of a + b is a, b."""
        ok = self.merge(a + b) == [self.ranks[a], self.ranks[b]]
        if len(self.follows) > 2_000_000:
            self.follows.clear()
        self.follows[a, b] = ok
        return ok

    def byte_prefixes(self, word: bytes) -> list[int]:
        """Token counts of word[:1], word[:2], ... when nothing follows. What words that begin alike share is reckoned once."""
        ranks, follows, reach, stems = self.ranks, self.follows, self.reach.get, self.stems
        last, counts = [b""], [0]
        for size in STEMS:
            if (known := stems.get(word[:size])) is not None:
                last, counts = known[0].copy(), known[1].copy()
                break
        for end in range(len(last), len(word) + 1):
            for start in range(max(0, end - reach(word[end - 4 : end], 3)) if end > 3 else 0, end):
                token = word[start:end]
                if token in ranks:
                    before = last[start]
                    if not start:
                        break
                    ok = follows.get((before, token))
                    if ok or ok is None and self.may_follow(before, token):
                        break
            last.append(token)
            counts.append(counts[start] + 1)
            if end in STEMS:
                if len(stems) > REMEMBERED_UNITS:
                    stems.clear()
                stems[word[:end]] = last.copy(), counts.copy()
        return counts[1:]

    def piece_prefixes(self, piece: str) -> list[int]:
        """As byte_prefixes, at character ends."""
        data = piece.encode()
        counts = self.byte_prefixes(data)
        if len(data) == len(piece):
            return counts
        return [n for n, following in zip(counts, data[1:] + b" ", strict=True) if following & 0xC0 != 0x80]

    def whole(self, text: str) -> int:
        return sum(self.piece_prefixes(p)[-1] for p in self.pieces.findall(text))

    def of_unit(self, unit: str, at_end: bool) -> tuple[list[int], int]:
        """Counts at each character of a unit if the text ended there, and the unit's count within a longer text."""
        if unit.isalpha() or unit[0] == " " and unit[1:].isalpha():
            counts = self.piece_prefixes(unit)
            return counts, counts[-1]
        pieces = self.pieces.findall(unit)
        blanks = len(unit) - len(unit.lstrip()) if unit[:1].isspace() else 0
        if not blanks and len(pieces) == 1 and unit[0] != "'":
            counts = self.piece_prefixes(unit)
            return counts, counts[-1]
        counts = self.piece_prefixes(unit[:blanks]) if blanks else []
        rest = unit[blanks:]
        if not rest:
            inside = counts[-1] if at_end or blanks == 1 else self.piece_prefixes(unit[:-1])[-1] + self.piece_prefixes(unit[-1])[-1]
            return counts, inside
        before, joined = 0, rest
        if blanks:  # the last blank goes with what follows if the pattern lets it
            own = unit[blanks - 1] == " "
            alone = blanks - own
            before = self.piece_prefixes(unit[:alone])[-1] if alone else 0
            joined = unit[alone:]
        if rest[0] == "'" and rest[1:].isalpha():  # may be cut within 's and its like, which then is punctuation and letters
            tail = [self.whole(joined[: len(joined) - len(rest) + k]) for k in range(1, len(rest) + 1)]
        else:
            tail = self.piece_prefixes(joined)[len(joined) - len(rest) :]
        counts = counts + [before + x for x in tail]
        return counts, counts[-1]

    def segment(self, text: str) -> np.ndarray:
        """Counts at every character of a text without special strings."""
        units = self.units.findall(text)
        if not units:
            return np.zeros(0, np.int32)
        if len(self.known) > REMEMBERED_UNITS or self.characters > 16 * REMEMBERED_UNITS:
            self.forget()
        found = list(map(self.known.get, units))
        if None in found:
            for i, unit in enumerate(units):
                if found[i] is None:
                    found[i] = self.known.get(unit) or self.learn(unit)
        inside = np.fromiter([x[1] for x in found], np.int32, len(units))
        out = np.frombuffer(b"".join([x[0] for x in found]), np.int32)
        return out + np.repeat(np.cumsum(inside, dtype=np.int32) - inside, np.fromiter(map(len, units), np.int32, len(units)))

    def forget(self) -> None:
        """Units met: their counts at each character, and their count inside a text."""
        self.known: dict[str, tuple[bytes, int]] = {}
        self.characters = 0

    def learn(self, unit: str) -> tuple[bytes, int]:
        counts, inside = self.of_unit(unit, False)
        self.characters += len(unit)
        self.known[unit] = found = array("i", counts).tobytes(), inside
        return found

    def prefixes(self, text: str) -> np.ndarray:
        """Exact token counts of text[:0], text[:1], ..., text."""
        if not self.special or self.special not in text:
            return np.concatenate(([0], self.segment(text))).astype(np.int32)
        out, base = [np.zeros(1, np.int32)], 0
        parts = text.split(self.special)
        for i, part in enumerate(parts):
            if i == len(parts) - 1:
                counts = self.segment(part)
            else:
                counts = self.segment(part + self.special[:-1])
                whole = self.segment(part)
                own = int(whole[-1]) if len(whole) else 0
                counts = np.concatenate((whole, counts[len(part) :], [own + 1]))
            out.append(counts + base)
            base += int(counts[-1]) if len(counts) else 0
        return np.concatenate(out).astype(np.int32)


def fits(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix within a budget of tokens."""
    if counts[-1] <= budget:
        return len(counts) - 1
    return int(np.flatnonzero(counts <= budget)[-1])


def packed(counts: np.ndarray) -> bytes:
    """Counts as their steps from prefix to prefix, a byte each, or two or four where a step needs them; the first byte says which."""
    steps = np.diff(counts)
    most = int(np.abs(steps).max(initial=0))
    kind = np.int8 if most < 1 << 7 else np.int16 if most < 1 << 15 else np.int32
    return bytes([np.dtype(kind).itemsize]) + steps.astype(kind).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """The count at every prefix, the empty one first."""
    return np.concatenate(([0], np.cumsum(np.frombuffer(data, f"i{data[0]}", offset=1), dtype=np.int32))).astype(np.int32)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


_COUNTERS: dict = {}


def count_prefixes(docs: DataFrame, ranks_path: str, pattern: str, budgets: tuple[int, ...] = (LIMIT,), keep_counts: bool | str = True, special: str | None = SPECIAL, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens, cut_<budget> for each budget (characters of the longest prefix that fits)
    and, if asked for, prefix_tokens: the count at every prefix, one entry a character and one for the empty prefix,
    or with keep_counts="packed" prefix_steps: the same as packed() has it.

    One narrow map. The vocabulary, whose size is fixed, is broadcast.
    """
    with open(ranks_path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), *[T.StructField(f"cut_{b}", T.LongType()) for b in budgets]]
    if keep_counts:
        added.append(T.StructField("prefix_steps", T.BinaryType()) if keep_counts == "packed" else T.StructField("prefix_tokens", T.ArrayType(T.IntegerType())))
    names = {f.name.lower() for f in added}
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names or c == text])
    fields = [f for f in own.schema.fields if f.name.lower() not in names]
    schema = T.StructType(fields + added)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (hash(vocabulary.value), pattern, special)
        if key not in _COUNTERS:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
            _COUNTERS.clear()
            _COUNTERS[key] = PrefixCounter(ranks, pattern, special)
        counter = _COUNTERS[key]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # long arrays of counts, so few rows at once
                batch = whole.slice(at, 256)
                n_bytes, n_tokens, cuts, kept = [], [], [[] for _ in budgets], []
                for value in batch.column(batch.schema.get_field_index(text)):
                    body = value.as_py() or ""
                    counts = counter.prefixes(body)
                    n_bytes.append(len(body.encode()))
                    n_tokens.append(int(counts[-1]))
                    for cut, budget in zip(cuts, budgets, strict=True):
                        cut.append(fits(counts, budget))
                    if keep_counts:
                        kept.append(packed(counts) if keep_counts == "packed" else counts)
                columns = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
                columns += [pa.array(x, pa.int64()) for x in (n_bytes, n_tokens, *cuts)]
                if keep_counts:
                    columns.append(pa.array(kept, pa.binary() if keep_counts == "packed" else pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return own.mapInArrow(count, schema)


def tokens_within(characters, counts: str = "prefix_tokens"):
    """Tokens of the first so many characters, from the stored counts."""
    c = characters if not isinstance(characters, int) else F.lit(characters)
    return F.element_at(F.col(counts), F.least(c, F.size(counts) - 1).cast("int") + 1)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = count_prefixes(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_counts="packed")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), f"cut_{LIMIT}", "prefix_steps")
