"""Exact top-k search by BM25 over sharded inverted indexes, with block-max WAND.

The index is built once, where the documents are read, and written to the shared folder: a row a shard of
at most SHARD_DOCS documents, with its words, its documents' word counts, and the documents it has of each
word. One document in PARTS, by a hash, is moved to pilot shards of their own, and one in PARTS of these to
others, until a level fits in one shard. Statistics (documents, their mean length, each query word's
document frequency) are global and taken from the index, so a shard's scores are final and the shards'
best k merge exactly.

Queries meet the shards in blocks of bounded size. For one query, a shard's posting lists fall in two: words
that at most one document in COMMON has are read in full and added up, as any document that holds
one of them may be a result; words more common than that have, for each block of BLOCK_DOCS documents, the
highest weight in it. What a document has so far plus the sum of its block's maxima bounds its score.
Documents under the threshold are skipped without a look at their common words, and with them
whole blocks. The others are scored in full from the highest bound down, and each result raises the threshold,
until no bound reaches it; after the first of them the rest are bounded by what they themselves have of the common words. The threshold begins at the k-th best score that the levels of pilot shards searched
before have found: a level has about PARTS * k documents above it for each query, whatever its size, so what
is sent and scored grows with the queries and not with the shards. There is one path for all queries: where
bounds are of no use, more documents are scored in full.

Defined results: words are separated by blanks, in lower case; each distinct word of a query counts
once; a query without words finds nothing; a document without any of them is never found; ties go to
the lesser id, a null id last; rows that share a query's id ask once, with the least text; repeated rows
are found once each; columns other than doc_id and text (query and text) are not read, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import materialise, table

K1, B, K = 1.2, 0.75, 10
#: A shard ends at so many documents or entries of its posting lists (one long text may exceed these).
SHARD_DOCS, SHARD_POSTINGS, BLOCK_DOCS = 8192, 4_000_000, 4
#: One document in so many is searched before the rest, for a floor under their scores.
PARTS = 8
#: Queries whose bounds are made together, and words of the queries that are sent to the shards at once.
BATCH, BLOCK_WORDS = 64, 2_000_000
#: The most common words, those that more than one document in so many has, are bounded by block.
COMMON = 12
INDEX = "level int, n long, length long, ids array<long>, sizes binary, starts binary, places binary, counts binary, words array<binary>, df array<int>"
_WORDS: dict = {}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


class Collected:
    """The documents of a shard while it is built."""

    def __init__(self, level: int):
        self.level, self.known = level, {}
        self.ids, self.sizes, self.starts, self.places, self.counts = [], [], array("q", [0]), array("i"), array("i")

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        known, held = self.known, Counter(words)
        places = list(map(known.get, held))
        if None in places:
            for i, word in enumerate(held):
                if places[i] is None:
                    places[i] = known[word] = len(known)
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.places.extend(places)
        self.counts.extend(held.values())
        self.starts.append(len(self.places))

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or len(self.places) >= SHARD_POSTINGS

    def row(self) -> pa.RecordBatch:
        df = np.bincount(np.frombuffer(self.places, np.int32), minlength=len(self.known)).astype(np.int32)
        columns = [pa.array([self.level], pa.int32()), pa.array([len(self.ids)], pa.int64()), pa.array([sum(self.sizes)], pa.int64()), pa.array([self.ids], pa.list_(pa.int64()))]
        columns += [pa.array([x.tobytes()], pa.binary()) for x in (array("q", self.sizes), self.starts, self.places, self.counts)]
        columns += [pa.array([list(self.known)], pa.list_(pa.binary())), pa.array([df], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=["level", "n", "length", "ids", "sizes", "starts", "places", "counts", "words", "df"])


def n_levels(docs: int) -> int:
    """How often one in PARTS is taken until a shard holds them."""
    levels = 0
    while docs > SHARD_DOCS:
        docs, levels = docs // PARTS, levels + 1
    return levels


def index(docs: DataFrame) -> tuple[DataFrame, int]:
    """A row a shard, as INDEX says, and the highest level of pilot shards. Only the pilots' texts move."""

    def build(level: int):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard = Collected(level)
            for batch in batches:
                for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    shard.add(doc, words_of(value.as_py()))
                    if shard.full():
                        yield shard.row()
                        shard = Collected(level)
            if shard.ids:
                yield shard.row()

        return rows

    n = docs.count()
    levels = n_levels(n)
    drawn = F.xxhash64("doc_id", "text")
    level = sum((F.when(F.pmod(drawn, F.lit(PARTS**i)) == 0, 1).otherwise(0) for i in range(1, levels + 1)), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", level.alias("level"))
    out = rows.filter("level = 0").select("doc_id", "text").mapInArrow(build(0), INDEX)
    if levels:
        pilots = materialise(rows.filter("level > 0"), "pilots", by="level")
    for i in range(1, levels + 1):
        full = -(-n // (PARTS**i * SHARD_DOCS))
        out = out.unionByName(pilots.filter(F.col("level") == i).coalesce(full).select("doc_id", "text").mapInArrow(build(i), INDEX))
    return materialise(out, "index", by="level"), levels


def _sorted(keys: np.ndarray) -> np.ndarray:
    """The places of keys (below 2**31, fewer than 2**32 of them) in ascending order, ties as they stand: numbers sort faster than places."""
    return np.sort((keys.astype(np.int64) << 32) | np.arange(len(keys))) & 0xFFFFFFFF


class Shard:
    """A shard as it answers queries, given which words it has: places in the queries' vocabulary, -1 for others."""

    def __init__(self, row: dict, place_of: np.ndarray, idf: np.ndarray, average: float, common: np.ndarray):
        self.ids, self.n = row["ids"], len(row["ids"])
        # Ties go to the lesser id, a null id last.
        self.order = np.argsort(np.array([np.iinfo(np.int64).max if i is None else i for i in self.ids], np.int64), kind="stable").argsort()
        places, held = place_of[row["places"]], np.diff(row["starts"])
        asked = places >= 0
        size = np.repeat(row["sizes"] / max(average, 1e-9), held)[asked]
        doc, places, tf = np.repeat(np.arange(self.n), held)[asked], places[asked], row["counts"][asked].astype(np.float64)
        weights = idf[places] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * size)))
        del size, tf
        order = _sorted(places)
        # Lists hold 64-bit numbers so that they are added up as they are.
        self.posted, self.weights = doc[order].astype(np.int64), weights[order]
        del doc, weights, order
        self.first = np.zeros(len(idf) + 1, np.int64)
        np.cumsum(np.bincount(places, minlength=len(idf)), out=self.first[1:])
        self.blocks = -(-self.n // BLOCK_DOCS)
        self.common = common
        self.row = np.full(len(idf), -1, np.int32)
        self.row[common] = np.arange(len(common))
        # A common word's list is kept by document, where it can be looked up at any place.
        self.by_doc = np.zeros((len(common), self.blocks * BLOCK_DOCS))
        for r, word in enumerate(common):
            s, e = self.first[word], self.first[word + 1]
            self.by_doc[r, self.posted[s:e]] = self.weights[s:e]
        self.ramp = np.arange(len(self.posted))
        # A block's documents lie self.blocks apart, so that bounds are added to long rows.
        self.highest = self.by_doc.reshape(len(common), BLOCK_DOCS, self.blocks).max(1).astype(np.float32)
        self.near = np.ascontiguousarray(self.by_doc.T, np.float32)

    def added(self, words: np.ndarray) -> np.ndarray:
        """The sum of the lists of some words, by document; each document's words in ascending order, in every shard."""
        starts = self.first[words]
        sizes = self.first[words + 1] - starts
        ends = np.cumsum(sizes)
        at = np.repeat(starts - ends + sizes, sizes)
        at += self.ramp[: len(at)]
        return np.bincount(self.posted.take(at, mode="clip"), self.weights.take(at, mode="clip"), self.blocks * BLOCK_DOCS)

    def score(self, sums: np.ndarray, rows: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Full scores. The common words are added one after the other, so that like documents score alike everywhere: NumPy
        does so over the first axis unless the second has one place only."""
        if len(docs) == 1:
            return self.score(sums, rows, np.repeat(docs, 2))[:1]
        return sums[docs] + np.add.reduce(self.by_doc[rows[:, None], docs], 0)

    def one(self, rare: np.ndarray, rows: np.ndarray, mark: np.ndarray, bounds: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        sums = self.added(rare)
        # Bounds are made in single precision: the slack covers its rounding.
        reach = (sums.reshape(BLOCK_DOCS, self.blocks) + bounds).ravel()
        least = max(floor, 2e-6)
        docs = np.flatnonzero(reach[: self.n] >= (least - 1e-6) / (1 + 1e-4))
        reach = reach[docs] * (1 + 1e-4) + 1e-6
        best_docs, best, step, near = np.zeros(0, np.int64), np.zeros(0), 4 * k, False
        while len(docs):
            if len(docs) > step and not near and len(best):
                # What documents themselves have of the common words, in single precision, leaves few.
                reach = (sums[docs] + self.near[docs] @ mark) * (1 + 1e-4) + 1e-6
                held, near = reach >= least, True
                docs, reach = docs[held], reach[held]
                continue
            if len(docs) > step:
                at = np.argpartition(reach, -step)[-step:]
                now, rest = docs[at], np.ones(len(docs), bool)
                rest[at] = False
                docs, reach = docs[rest], reach[rest]
            else:
                now, docs = docs, docs[:0]
            scores = self.score(sums, rows, now)
            best_docs, best = np.concatenate((best_docs, now)), np.concatenate((best, scores))
            if len(best) > k:
                keep = np.lexsort((self.order[best_docs], -best))[:k]
                best_docs, best = best_docs[keep], best[keep]
            if len(docs) and len(best) == k:  # the threshold rises
                least = max(least, best.min())
                held = reach >= least
                docs, reach = docs[held], reach[held]
            step *= 2
        found = (best > 0) & (best >= floor)
        return best_docs[found], best[found]

    def best(self, queries: list[np.ndarray], k: int, floors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of a batch of queries the k best documents and their scores, but for such as lie under its floor."""
        rows = [self.row[q] for q in queries]
        marks = np.zeros((len(queries), len(self.common)), np.float32)
        for i, row in enumerate(rows):
            marks[i, row[row >= 0]] = 1
        bounds = (marks @ self.highest).astype(np.float64)
        for query, row, mark, bound, floor in zip(queries, rows, marks, bounds, floors, strict=True):
            yield self.one(query[row < 0], row[row >= 0], mark, bound, k, floor)


def frequencies(shards: DataFrame, asked: DataFrame) -> DataFrame:
    """word, df: for each word of the queries, how many documents have it."""
    words = asked.select(F.explode("words").alias("word")).distinct()
    each = shards.select(F.explode(F.arrays_zip("words", "df")).alias("e")).select(F.col("e.words").alias("word"), F.col("e.df").alias("df"))
    return materialise(each.groupBy("word").agg(F.sum("df").alias("df")).join(words, "word"), "frequencies")


def search_block(shards: DataFrame, counted: DataFrame, asked: DataFrame, levels: int, n: int, mean: float, k: int) -> DataFrame:
    """query, doc_id, score: the best of each shard. asked: query and words, a block of them, which comes to the driver as Arrow."""
    context = shards.sparkSession.sparkContext
    known = counted.join(asked.select(F.explode("words").alias("word")).distinct(), "word", "left_semi").toArrow()
    df = known.column("df").to_numpy().astype(np.float64)
    vocabulary = known.column("word").combine_chunks()
    block = asked.orderBy("query").toArrow()
    ids = block.column("query").to_pylist()
    lists = block.column("words").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    places = pa.compute.index_in(lists.flatten(), value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
    queries = [np.sort(x[x >= 0]) for x in np.split(places, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))[:-1])]
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    sent = context.broadcast((b"\n".join(vocabulary.to_pylist()), ids, queries, idf, mean, np.flatnonzero(df > n / COMMON)))
    del known, vocabulary, block, lists, places
    # The k-th best score among some documents bounds the k-th best among all from below: the other shards need not
    # send what lies under it.
    floors = np.zeros(len(ids))
    place_of = {q: i for i, q in enumerate(ids)}
    best = None
    for level in range(levels, 0, -1):
        found = _search(shards.filter(F.col("level") == level), sent, context.broadcast(floors), k)
        best = materialise(_ranked(found if best is None else found.unionByName(best.drop("rank")), k), "best")
        floors = floors.copy()
        for r in best.filter(F.col("rank") == k).select("query", "score").collect():  # a number for each query of a block
            floors[place_of[r["query"]]] = r["score"]
    found = _search(shards.filter("level = 0"), sent, context.broadcast(floors), k)
    return materialise(found if best is None else found.unionByName(best.drop("rank")), "best-all")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _places(sent) -> dict[bytes, int]:
    """The place of each query word, built once a worker."""
    if _WORDS.get("of") is not sent.value:
        words = sent.value[0]
        _WORDS.update({"of": sent.value, "places": {w: i for i, w in enumerate(words.split(b"\n"))} if words else {}})
    return _WORDS["places"]


def _search(shards: DataFrame, sent, floors, k: int) -> DataFrame:
    """query, doc_id, score: what each shard may add to the best."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, low = _places(sent).get, floors.value
        _, q_ids, q_places, idf, average, common = sent.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: np.frombuffer(batch.column(name)[i].as_buffer(), kind) for name, kind in (("sizes", np.int64), ("starts", np.int64), ("places", np.int32), ("counts", np.int32))}
                row["ids"] = batch.column("ids")[i].as_py()
                place_of = np.array([places(w, -1) for w in batch.column("words")[i].values.to_pylist()], np.int64)
                shard = Shard(row, place_of, idf, average, common)
                out_q, out_d, out_s = [], [], [np.zeros(0)]
                for at in range(0, len(q_ids), BATCH):
                    for q, (found, scores) in zip(q_ids[at : at + BATCH], shard.best(q_places[at : at + BATCH], k, low[at : at + BATCH]), strict=True):
                        out_q += [q] * len(found)
                        out_d += [shard.ids[d] for d in found.tolist()]
                        out_s.append(scores)
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_d, pa.int64()), pa.array(np.concatenate(out_s))], names=["query", "doc_id", "score"])

    return shards.select("ids", "sizes", "starts", "places", "counts", "words").mapInArrow(search, "query long, doc_id long, score double")


def top_k(docs: DataFrame, queries: DataFrame, k: int = K, block_words: int = BLOCK_WORDS) -> DataFrame:
    """query, rank, doc_id, score: the k best rows of docs (doc_id, text) for each row of queries (query, text)."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(set(words_of(x.as_py()))) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("query"), pa.array(words, pa.list_(pa.binary()))], names=["query", "words"])

    asked = queries.filter("query IS NOT NULL").groupBy(F.col("query").cast("long").alias("query")).agg(F.min("text").alias("text"))
    asked = materialise(asked.mapInArrow(distinct, "query long, words array<binary>").filter(F.size("words") > 0), "queries")
    total = asked.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = -(-total // block_words)
    out = docs.sparkSession.createDataFrame([], "query long, doc_id long, score double")
    if blocks:
        shards, levels = index(docs)
        whole = shards.agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()
        n, mean = whole["n"] or 0, (whole["length"] or 0) / max(1, whole["n"] or 0)
        counted = frequencies(shards, asked)
    for b in range(blocks):
        out = out.unionByName(search_block(shards, counted, asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b), levels, n, mean, k))
    return _ranked(out, k).select("query", "rank", "doc_id", "score")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    queries = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query"), "text")
    return top_k(docs, queries).withColumnRenamed("query", "query_id")
