"""Substring deduplication: passages of MIN_WORDS words that an earlier document has go, wherever they start or end.

1. Of the hashes of ANCHOR words in a row, the least of every WINDOW in a row are a document's anchors, so
   that each MIN_WORDS words in a row hold an anchor that depends on nothing but these words. Anchors that
   several documents have are found over all documents.
2. Around these, and nowhere else, each MIN_WORDS words in a row are hashed, at every word. A word goes if
   it is in one of these runs that a document before (by id) has: a passage goes from its first word to its
   last, whether or not it starts or ends with a sentence.
3. Within one document a repeat goes sentence by sentence: the later places of the shortest run of at least
   two whole sentences with MIN_WORDS words, from every sentence on and up to every sentence (a sentence of
   LONG words is a run by itself).

What is shuffled is a hash and an id an anchor (one in six words or so), then a hash and an id for each
word of what is shared. Texts are joined to what is known of them, by broadcast up to a checked size.

Defined results: a sentence ends after . ! or ? before a blank, or at a line's end; words are compared,
not the blanks between them; n_removed counts sentences that lost words, all or some; the blanks before a
word go with it; a null text stays null; rows that share an id, or have none and the same text, are one
document, those without an id after all others; texts without a repeat are left alone; other columns are kept; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import materialise, table, unused

MIN_WORDS, LONG = 20, 30
ANCHOR = 10
WINDOW = MIN_WORDS - ANCHOR + 1
#: What is known of texts is broadcast up to so many bytes, as for a few documents; else texts are shuffled to it by id.
BROADCAST_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BLANK, _STOP, _STEP = (np.isin(np.arange(256), list(x)) for x in (b" \t\n\x0b\x0c\r", b".!?", b" \t\r\x0b\x0c"))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = np.where(_BLANK, np.uint64(0), mix(np.arange(1, 257, dtype=np.uint64) * BASE))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, ... of n at least."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        size = 1 << max(12, int(n).bit_length())
        known = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, base))), dtype=np.uint64)
        if size <= 1 << 20:
            _POWERS[int(base)] = known
    return known


class Words:
    """The words of a text: where they start and end in its bytes, their hashes, and sums from which any row of them is hashed."""

    def __init__(self, data: bytes | pa.Buffer | None):
        self.bytes = np.frombuffer(data or b"", np.uint8)
        b = self.bytes
        blank = _BLANK[b]
        turns = np.flatnonzero(np.diff(blank, prepend=True, append=True))
        self.starts, self.ends = turns[0::2], turns[1::2]
        self.n = len(self.starts)
        if self.n:
            # A polynomial over each word's bytes; blanks count nothing.
            at = np.arange(self.starts[0], len(b)) - np.repeat(self.starts, np.diff(self.starts, append=len(b)))
            size = self.ends - self.starts
            at[blank[self.starts[0] :]] = 0
            values = _BYTES[b[self.starts[0] :]] * powers(BASE, int(size.max()))[at]
            hashes = mix(np.add.reduceat(values, self.starts - self.starts[0]) + size.astype(np.uint64))
        else:
            hashes = np.zeros(0, np.uint64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers(INVERSE, self.n)[: self.n], dtype=np.uint64)))

    def rows(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of the words from first to before end."""
        return mix((self.sums[end] - self.sums[first]) * powers(BASE, self.n + 1)[first] + (end - first).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        """The hash of each size words in a row."""
        first = np.arange(max(0, self.n - size + 1))
        return self.rows(first, first + size)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The places and hashes of the anchors; none in a text of fewer than MIN_WORDS words."""
        if self.n < MIN_WORDS:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = self.grams(ANCHOR)
        windows = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
        at = np.unique(windows.argmin(1) + np.arange(len(windows)))
        return at, h[at]

    def sentences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each sentence with words: its first word, and where its piece of the bytes, blanks before it and all, starts and ends."""
        b = self.bytes
        cuts = np.flatnonzero((_STOP[b[:-1]] & _STEP[b[1:]]) | (b[:-1] == 10)) + 1
        piece = np.searchsorted(cuts, self.starts, "right")
        first = np.flatnonzero(np.diff(piece, prepend=-1))
        edges = np.concatenate(([0], cuts, [len(b)]))
        return first, edges[piece[first]], edges[piece[first] + 1]

    def own_repeats(self, first: np.ndarray) -> np.ndarray:
        """Which words are in a run of whole sentences that the text has had before."""
        words = np.diff(first, append=self.n)
        n = len(words)
        total = np.append(first, self.n)
        every = np.arange(n)
        ends = np.where(words >= LONG, every, np.maximum(np.searchsorted(total, first + MIN_WORDS) - 1, every + 1))
        starts = np.where(words >= LONG, every, np.minimum(np.searchsorted(total, total[1:] - MIN_WORDS, "right") - 1, every - 1))
        runs = np.unique(np.concatenate([np.stack([every, ends], 1)[ends < n], np.stack([starts, every], 1)[starts >= 0]]), axis=0)
        # Sums over the sentences' hashes: the same words cut into other sentences are another run.
        each = self.rows(first, first + words)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each * powers(INVERSE, n)[:n], dtype=np.uint64)))
        a, z = runs[:, 0], runs[:, 1]
        h = mix((sums[z + 1] - sums[a]) * powers(BASE, n + 1)[a] + (z - a).astype(np.uint64))
        again = np.ones(len(h), bool)
        again[np.unique(h, return_index=True)[1]] = False
        return covered(total[a[again]], total[z[again] + 1], self.n)


def covered(first: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places are in one of the ranges."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, end, -1)
    return np.cumsum(edges)[:n] > 0


def cleaned(data: pa.Buffer | None, known: np.ndarray) -> tuple[str | None, int, int]:
    """The text without what repeats (null: as it was), its sentences and how many of them lost words. known: hashes of MIN_WORDS words."""
    w = Words(data)
    if not w.n:
        return None, 0, 0
    first, start, end = w.sentences()
    lost = w.own_repeats(first)
    if len(known):
        at = np.flatnonzero(np.isin(w.grams(MIN_WORDS), known))
        lost |= covered(at, at + MIN_WORDS, w.n)
    if not lost.any():
        return None, len(first), 0
    gone = np.add.reduceat(lost, first, dtype=np.int64)
    words = np.diff(first, append=w.n)
    cuts = []
    for i in np.flatnonzero(gone).tolist():
        if gone[i] == words[i]:
            cuts.append((start[i], end[i]))
            continue
        here = lost[first[i] : first[i] + words[i]]
        turns = np.flatnonzero(np.diff(here, prepend=False, append=False)) + first[i]
        for a, z in zip(turns[0::2].tolist(), turns[1::2].tolist(), strict=True):
            if a == first[i] and w.starts[a] == start[i]:  # at a line's start the blanks after go
                cuts.append((w.starts[a], w.starts[z]))
            else:
                cuts.append((start[i] if a == first[i] else w.ends[a - 1], w.ends[z - 1]))
    raw, kept, at = bytes(data), [], 0
    for a, z in cuts:
        kept.append(raw[at:a])
        at = z
    kept.append(raw[at:])
    return b"".join(kept).decode().lstrip(" "), len(first), int((gone > 0).sum())


def _buffer(value: pa.Scalar) -> pa.Buffer | None:
    return value.as_buffer() if value.is_valid else None


def _rows(ids: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
    doc = np.repeat(np.array(ids, np.int64), [len(h) for h in found])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(doc)], names=["h", "doc"])


def _key():
    return F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64("text"), 2) + F.lit(1 << 62))


def anchors(docs: DataFrame) -> DataFrame:
    """h, doc: each distinct anchor of each document."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(Words(_buffer(x)).anchors()[1]) for x in batch.column("text")]
            if found:
                yield _rows(batch.column("doc").to_pylist(), found)

    return docs.select(_key().alias("doc"), "text").mapInArrow(draw, "h long, doc long")


def runs_near(texts: DataFrame) -> DataFrame:
    """h, doc: each distinct MIN_WORDS words in a row of doc, text that hold one of the anchors in hashes."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value, known in zip(batch.column("text"), batch.column("hashes"), strict=True):
                w = Words(_buffer(value))
                at, h = w.anchors()
                at = at[np.isin(h, _hashes(known))]
                n = max(0, w.n - MIN_WORDS + 1)
                near = np.flatnonzero(covered(np.clip(at - WINDOW + 1, 0, n), np.clip(at + 1, 0, n), n))
                found.append(np.unique(w.rows(near, near + MIN_WORDS)))
            if found:
                yield _rows(batch.column("doc").to_pylist(), found)

    return texts.select("doc", "text", "hashes").mapInArrow(draw, "h long, doc long")


def _hashes(known: pa.Scalar) -> np.ndarray:
    return known.values.to_numpy().view(np.uint64) if known.is_valid else np.zeros(0, np.uint64)


def shared(rows: DataFrame, owners: bool) -> DataFrame:
    """h, doc: the rows whose hash a document of a lesser id has too; with owners, also the row of the least id.

    One shuffle; however many documents share a hash, a task holds a batch and the last hash's owner.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, owner, told = None, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            h, doc = batch.column("h").to_numpy(), batch.column("doc").to_numpy()
            new = np.append(True, h[1:] != h[:-1])
            new[0] = last is None or h[0] != last
            begins = np.flatnonzero(np.append(True, new[1:]))  # the first group may go on from the batch before
            group = np.cumsum(np.append(False, new[1:]))
            firsts = doc[begins].copy()
            if not new[0]:
                firsts[0] = owner
            else:
                told = False
            later = doc > firsts[group]
            out_h, out_d = [h[later]], [doc[later]]
            met = np.zeros(len(begins), bool)
            met[group[later]] = True
            if owners:
                say = met.copy()
                say[0] &= not told
                out_h.append(h[begins[say]])
                out_d.append(firsts[say])
            told = bool(met[-1]) or (told and len(begins) == 1)
            last, owner = h[-1], firsts[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_h)), pa.array(np.concatenate(out_d))], names=["h", "doc"])

    held = rows.repartition("h").sortWithinPartitions("h", "doc")
    return held.mapInArrow(compare, "h long, doc long")


def _by_document(rows: DataFrame, label: str) -> DataFrame:
    """doc, hashes: at most a document's own words."""
    return materialise(rows.groupBy("doc").agg(F.collect_list("h").alias("hashes")), label)


def _hint(known: DataFrame) -> Callable[[DataFrame], DataFrame]:
    size = known.agg(F.sum(F.size("hashes")).alias("n"), F.count("*").alias("d")).first()
    small = 8 * (size["n"] or 0) + 64 * size["d"] <= BROADCAST_BYTES
    return F.broadcast if small else lambda df: df.hint("shuffle_hash")


def repeated(docs: DataFrame) -> DataFrame:
    """doc, hashes: of each document, the MIN_WORDS words in a row that a document before it has."""
    met = _by_document(shared(anchors(docs), owners=True), "anchors-shared")
    texts = docs.select(_key().alias("doc"), "text").join(_hint(met)(met), "doc")
    return _by_document(shared(runs_near(texts), owners=False), "runs-repeated")


def remove(docs: DataFrame) -> DataFrame:
    """docs with repeated passages taken out of text, and n_sentences, n_removed."""
    again = repeated(docs)
    hint = _hint(again)
    key, hashes = unused(docs, "__doc", "__hashes")
    again = again.select(F.col("doc").alias(key), F.col("hashes").alias(hashes))
    own = [c for c in docs.columns if c.lower() not in ("n_sentences", "n_removed")]
    joined = docs.select(*[F.col(f"`{c}`") for c in own], _key().alias(key)).join(hint(again), key, "left").drop(key)
    schema = T.StructType([*[f for f in docs.schema.fields if f.name in own], T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType())])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, gone = [], [], []
            for value, known in zip(batch.column(own.index("text")), batch.column(len(own)), strict=True):
                text, n, lost = cleaned(_buffer(value), _hashes(known))
                texts.append(value.as_py() if text is None else text)
                total.append(n)
                gone.append(lost)
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(i) for i, c in enumerate(own)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=schema.names)

    return joined.mapInArrow(clean, schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_sentences", "n_removed", "text")
