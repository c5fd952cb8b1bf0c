"""Self-join of documents by the Jaccard similarity of their word shingles: a chosen-path join.

1. Documents with the same set of shingles are one class of copies; only one of each goes on.
2. A set is embedded as COORDINATES minhash tokens, so that two sets share a token at a coordinate with
   the probability of their similarity. From a common root, each run picks one or two coordinates a
   step (BRANCH on average) by a hash of the path so far and descends by the tokens there; sets that
   share a path share a bucket. Buckets over BUCKET sets are split further, step by step; at the last
   step what still doesn't fit is compared block by block, so nothing is cut off. The number of runs
   follows from the recall wanted for pairs just at the threshold.
3. Pairs of a bucket whose tokens agree well enough become candidate links, a star
   for each group of a bucket; the candidates' components are then compared by brute force on the whole sets, in
   blocks, which gives the exact links, also such as no path has found.

Defined results: words are separated by blanks and compared as written; a text of one to four words is
one shingle, a text without words (or null) is like nothing; a document is an id with a set of shingles,
so rows that repeat both are one document, and rows of one id with other words are others; a null id
takes part under a negative number made from its text; columns other than doc_id and text are not read,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialise, table, text_of, unused
from .components import components

WORDS, THRESHOLD = 5, 0.8
COORDINATES, BRANCH, RECALL = 64, 1.25, 0.9995
FIRST_DEPTH, STEP_DEPTH, LAST_DEPTH = 2, 2, 6
BUCKET, BLOCK = 256, 128
#: Hashes of sets that are compared at a time: a bound of a worker's memory, about a hundred bytes each.
HASHES = 250_000
#: A component's members are dealt into so many parts at most, which bounds how often its sets are repeated.
PARTS = 64
#: Agreement of tokens from which a pair is a candidate: five standard deviations below the threshold.
AGREEMENT = 0.55
#: Ids, with the few columns beside them (a hundred bytes or so), are broadcast up to so many, else joined by shuffle.
BROADCAST_IDS = 250_000
SALTS = 8
#: Hashes of words that a worker remembers: a bound of its memory.
REMEMBERED_WORDS = 150_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _ODD = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    _ADD = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def runs_needed(recall: float = RECALL, threshold: float = THRESHOLD, depth: int = LAST_DEPTH) -> int:
    """Runs after which a pair at the threshold has shared a bucket of that depth with the probability recall."""
    two, lost = BRANCH - 1, 0.0
    for _ in range(depth):
        one = 1 - threshold + threshold * lost
        lost = (1 - two) * one + two * one * one
    return math.ceil(math.log(1 - recall) / math.log(lost))


_WORDS: dict[bytes, int] = {}


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of WORDS words."""
    import xxhash

    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > REMEMBERED_WORDS:
        _WORDS.clear()
    known = list(map(_WORDS.get, words))
    if None in known:
        for i, h in enumerate(known):
            if h is None:
                h = xxhash.xxh3_64_intdigest(words[i])
                if len(words[i]) < 64:
                    _WORDS[words[i]] = h
                known[i] = h
    h = np.array(known, np.uint64)
    n = min(WORDS, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(out)])
    return np.unique(out)


def minhash(s: np.ndarray) -> np.ndarray:
    """The token of each coordinate, 16 bits of the least hash."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        np.minimum(least, (s[None, at : at + 4096] * _ODD[:, None] + _ADD[:, None]).min(1), out=least)
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def _id():
    return F.coalesce(F.col("doc_id").cast("long"), -1 - F.shiftrightunsigned(F.xxhash64(text_of()), 1))


def sketches(docs: DataFrame) -> DataFrame:
    """id, key (a hash of the text), same (a digest of the set of shingles, null without any), tokens: a row a row of docs."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            same, tokens = [], []
            for value in batch.column("text"):
                s = shingles(value.as_py())
                same.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                tokens.append(minhash(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(same, pa.binary()), pa.array(tokens, pa.binary())], names=["id", "key", "same", "tokens"])

    return docs.select(_id().alias("id"), F.xxhash64("text").alias("key"), "text").mapInArrow(sketch, "id long, key long, same binary, tokens binary")


def _descend(path: np.ndarray, row: np.ndarray, tokens: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Paths and rows some steps on."""
    for _ in range(steps):
        u = mix(path)
        first = (u % np.uint64(COORDINATES)).astype(np.int64)
        second = ((u >> np.uint64(20)) % np.uint64(COORDINATES)).astype(np.int64)
        forks = ((u >> np.uint64(40)) % np.uint64(1000) < np.uint64(round(1000 * (BRANCH - 1)))) & (first != second)
        path, row, at = np.concatenate([path, path[forks]]), np.concatenate([row, row[forks]]), np.concatenate([first, second[forks]])
        path = mix(path ^ ((at.astype(np.uint64) << np.uint64(16)) + tokens[row, at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return path, row


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDINATES)


def first_paths(sets: DataFrame, runs: int) -> DataFrame:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, ids = _tokens(batch.column("tokens")), batch.column("rep").to_numpy()
            n = len(ids)
            for run in range(runs):
                path, row = _descend(np.full(n, mix(np.array([run + 1], np.uint64))[0]), np.arange(n), tokens, FIRST_DEPTH)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(ids[row])], names=["path", "rep"])

    return sets.select("rep", "tokens").mapInArrow(walk, "path long, rep long")


def next_paths(rows: DataFrame) -> DataFrame:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, ids = _tokens(batch.column("tokens")), batch.column("rep").to_numpy()
            path, row = _descend(batch.column("path").to_numpy().view(np.uint64), np.arange(len(ids)), tokens, STEP_DEPTH)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(ids[row])], names=["path", "rep"])

    return rows.select("path", "rep", "tokens").mapInArrow(walk, "path long, rep long")


def stars(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges from the least of each connected group to its others."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
    return [(find(x), x) for x in range(n) if find(x) != x]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys, of batches sorted by them; holds one group and one batch."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if held is None else pa.concat_tables([held, now])
        values = [now.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        starts = [0, *cuts.tolist()]
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            yield now.slice(s, e - s)
        held = now.slice(starts[-1])
    if held is not None and held.num_rows:
        yield held


def _blocked(rows: DataFrame, size: str, member: str, block: int, most: int = 1 << 30) -> DataFrame:
    """rows with side, p, q: each member of a group once for every pair of blocks that its own block is in; most: blocks at most."""
    blocks = F.least(F.ceil(F.col(size) / block), F.lit(most)).cast("int")
    mine = F.pmod(F.xxhash64(F.col(member), F.lit(7)), blocks).cast("int")
    out = rows.withColumn("side", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return out.withColumn("p", F.least("side", "other")).withColumn("q", F.greatest("side", "other")).drop("other")


def candidate_links(rows: DataFrame) -> DataFrame:
    """a, b: links by tokens in each bucket (path, p, q), whose members come with their side."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for group in _groups(batches, ["path", "p", "q"]):
            group = group.sort_by("rep")
            ids, tokens = group.column("rep").to_numpy(), _tokens(group.column("tokens"))
            n = len(ids)
            if n == 2:
                if ids[0] != ids[1] and (tokens[0] == tokens[1]).sum() >= AGREEMENT * COORDINATES:
                    found.append((int(ids[0]), int(ids[1])))
            elif n > 2:
                pairs_a, pairs_b = [], []
                for i in range(n - 1):
                    near = np.flatnonzero((tokens[i + 1 :] == tokens[i]).sum(1) >= AGREEMENT * COORDINATES) + i + 1
                    pairs_a.append(np.full(len(near), i))
                    pairs_b.append(near)
                found += [(int(ids[x]), int(ids[y])) for x, y in stars(n, np.concatenate(pairs_a), np.concatenate(pairs_b)) if ids[x] != ids[y]]
            if len(found) > 20_000:
                yield _pairs(found)
                found = []
        if found:
            yield _pairs(found)

    held = rows.select("path", "p", "q", "rep", "tokens").repartition("path", "p", "q").sortWithinPartitions("path", "p", "q")
    return held.mapInArrow(compare, "a long, b long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(found, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x[:, 0], x[:, 1])), pa.array(np.maximum(x[:, 0], x[:, 1]))], names=["a", "b"])


def _shared(whole: list[np.ndarray], n: int, out: np.ndarray) -> None:
    """Adds to out the sizes of the intersections of the first n sets with the others, or of all pairs if there are no others."""
    every, place = np.unique(np.concatenate(whole), return_inverse=True)
    row = np.repeat(np.arange(len(whole)), [len(s) for s in whole])
    shared = np.bincount(place, minlength=len(every)) > 1  # what only one set has can't be common
    keep = shared[place]
    place, row = (np.cumsum(shared) - 1)[place[keep]], row[keep]
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    width = 8192
    for at in range(0, int(shared.sum()), width):
        s, e = np.searchsorted(place, [at, at + width])
        dense = np.zeros((len(whole), width), np.float32)
        dense[row[s:e], place[s:e] - at] = 1
        out += dense[:n] @ (dense if n == len(whole) else dense[n:]).T


def overlaps(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of sorted sets with others, or of all pairs of them.

    Ranges of hashes, about HASHES of them at a time, are counted one after the other: what is held doesn't grow with the sets.
    """
    n, whole = len(sets), sets + (others or [])
    out = np.zeros((n, len(others) if others else n), np.float32)
    ranges = max(1, -(-sum(len(s) for s in whole) // HASHES))
    ends = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
    cuts = [[0, *np.searchsorted(s, ends).tolist(), len(s)] for s in whole]
    for i in range(ranges):
        _shared([s[c[i] : c[i + 1]] for s, c in zip(whole, cuts, strict=True)], n, out)
    return out


def _linked(sets: list[np.ndarray], copies: np.ndarray, threshold: float, mine: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For each set how many documents of the other side link to it, and places of sets that connect what is linked.

    mine, other: places of the sets of two sides, or the same, by size; BLOCK of them are compared at a time, and not
    those whose sizes alone rule a link out.
    """
    size, same = np.array([len(s) for s in sets], np.float64), mine is other
    links, tree = np.zeros(len(sets), np.int64), []
    for s in range(0, len(mine), BLOCK):
        a = mine[s : s + BLOCK]
        for t in range(s if same else 0, len(other), BLOCK):
            b = other[t : t + BLOCK]
            if size[b[0]] * threshold > size[a[-1]]:
                break
            if size[a[0]] * threshold > size[b[-1]]:
                continue
            one = same and s == t
            both = overlaps([sets[i] for i in a], None if one else [sets[i] for i in b])
            linked = (both >= threshold * (size[a][:, None] + size[b][None, :] - both) - 1e-9) & (a[:, None] != b[None, :])
            links[a] += linked @ copies[b]
            if not one:
                links[b] += copies[a] @ linked
            x, y = np.nonzero(linked)
            nodes = a if one else np.concatenate((a, b))
            tree += [(nodes[i], nodes[j]) for i, j in stars(len(nodes), x, y if one else y + len(a))]
    return links, tree


def exact_links(rows: DataFrame, threshold: float) -> DataFrame:
    """a, b, n: for each set a, how many documents other sets of its component link it to (b null), and edges that connect linked sets (n 0)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["component", "p", "q"]):
            ids, first = np.unique(group.column("rep").to_numpy(), return_index=True)
            if len(ids) < 2:
                continue
            group = group.take(first)  # rows that repeat a document brought its set again
            side, copies = group.column("side").to_numpy(), group.column("copies").to_numpy().astype(np.int64)
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
            by_size = np.argsort([len(s) for s in sets], kind="stable")
            p, q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
            if p != q and not (np.any(side == p) and np.any(side == q)):
                continue
            links, tree = _linked(sets, copies, threshold, *((by_size, by_size) if p == q else (by_size[side[by_size] == p], by_size[side[by_size] == q])))
            if len(tree) >= len(ids):  # as many as connect them are enough
                tree = stars(len(ids), *np.array(tree).T)
            a = [*ids[links > 0].tolist(), *[int(ids[i]) for i, _ in tree]]
            b = [*[None] * int((links > 0).sum()), *[int(ids[j]) for _, j in tree]]
            c = [*links[links > 0].tolist(), *[0] * len(tree)]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["a", "b", "n"])

    held = rows.repartition("component", "p", "q").sortWithinPartitions("component", "p", "q")
    return held.mapInArrow(compare, "a long, b long, n long")


def with_shingles(docs: DataFrame, members: DataFrame) -> DataFrame:
    """members (id, same and others) with their set of shingles, once for each row of their document. Members are broadcast up to a checked number, so texts stay where they are."""
    small = members.count() <= BROADCAST_IDS
    columns = [c for c in members.columns if c not in ("id", "same")]
    rows = docs.select(_id().alias("id"), "text").join(F.broadcast(members) if small else members, "id").select(*columns, "same", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sets = [shingles(x.as_py()).tobytes() for x in batch.column("text")]
            sets = [s if xxhash.xxh3_128_digest(s) == same else None for s, same in zip(sets, batch.column("same").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sets, pa.binary())], names=[*columns, "shingles"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema.fields if f.name in columns)
    return rows.mapInArrow(cut, f"{schema}, shingles binary").filter("shingles IS NOT NULL")


def _distinct(drawn: DataFrame) -> DataFrame:
    """same, id, copies, tokens, rep: a row a set, with the least of its documents' ids and their number.

    rep names the set: its id, or a negative number where several sets have that id.
    """
    each = drawn.filter("same IS NOT NULL").groupBy("same", "id").agg(F.first("tokens").alias("tokens"))
    sets = materialise(each.groupBy("same").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("tokens").alias("tokens")), "sets")
    twice = materialise(sets.groupBy("id").count().filter("count > 1").select("id"), "ids-of-several")
    n = twice.count()
    if not n:
        return sets.withColumn("rep", F.col("id"))
    twice = F.broadcast(twice) if n <= BROADCAST_IDS else twice
    own = sets.join(twice, "id", "left_anti").withColumn("rep", F.col("id"))
    named = sets.join(twice, "id", "left_semi").withColumn("rep", -1 - F.shiftrightunsigned(F.xxhash64("same"), 1))
    return materialise(own.unionByName(named), "sets")


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """id, key, same, node, class_id, n_links for each row of docs; node names the class, null where a document is its only one."""
    drawn = materialise(sketches(docs), "sketches")
    sets = _distinct(drawn)
    paths = materialise(first_paths(sets, runs_needed(recall, threshold)), "paths")
    links, depth = [], FIRST_DEPTH
    while True:
        full = paths.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1")
        shared = paths.join(materialise(full, "buckets"), "path").join(sets.select("rep", "tokens"), "rep")
        shared = materialise(shared, "shared")
        last = depth >= LAST_DEPTH
        fits = shared if last else shared.filter(F.col("size") <= BUCKET)
        links.append(materialise(candidate_links(_blocked(fits, "size", "rep", BUCKET)).distinct(), "candidates"))
        deeper = shared.filter(F.col("size") > BUCKET)
        if last or not deeper.limit(1).count():
            break
        paths, depth = materialise(next_paths(deeper), "paths"), depth + STEP_DEPTH
    candidates = links[0]
    for more in links[1:]:
        candidates = candidates.unionByName(more)
    members = components(candidates).withColumnRenamed("node", "rep")
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    members = materialise(members.join(sizes, "component").join(sets.select("rep", "id", "same", "copies"), "rep"), "members")
    blocks = _blocked(with_shingles(docs, members), "size", "rep", BLOCK, PARTS)
    found = materialise(exact_links(blocks.select("component", "p", "q", "side", "rep", "copies", "shingles"), threshold), "links")
    linked = found.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("linked")).withColumnRenamed("a", "rep")
    joined = components(found.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "rep")
    known = sets.select("same", "rep", "id", "copies").join(joined, "rep", "left").join(linked, "rep", "left").filter("copies > 1 OR linked IS NOT NULL")
    known = materialise(known.select("same", "id", F.coalesce("component", "rep").alias("node"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "classes")
    known = known.join(known.groupBy("node").agg(F.min("id").alias("class_id")), "node").drop("id")
    # A class of copies may hold a third of all rows: its few columns are repeated for each salt.
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = drawn.select("id", "key", "same", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    out = rows.join(known, ["same", "salt"], "left")
    return out.select("id", "key", "same", "node", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def similar(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """id, class_id, n_links for each row of docs.

    class_id is the least id of the documents that links connect with it; n_links counts the other
    documents whose similarity is at least threshold, copies included.
    """
    return classes(docs, threshold, recall).select("id", "class_id", "n_links")


def representatives(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without all but one row of each class: one of its document with the least id. Texts move only if what goes outgrows a broadcast.

    What goes is told by id and text, so a row stays unless its own text has another that represents it.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    id_, key, gone_id, gone_key = unused(docs, "__id", "__key", "__gone_id", "__gone_key")
    found = materialise(classes(docs, threshold), "similar")
    grouped = found.filter("node IS NOT NULL")
    first = grouped.groupBy("node").agg(F.min(F.struct("id", "key")).alias("r")).select("r.id", "r.key")
    gone = grouped.select("id", "key").distinct().join(first, ["id", "key"], "left_anti")
    twice = materialise(found.groupBy("id").count().filter("count > 1").select("id"), "repeated")
    n_twice = twice.count()

    def checked(ids: DataFrame, n: int) -> DataFrame:
        return F.broadcast(ids) if n <= BROADCAST_IDS else ids

    if n_twice:  # rows of one id: those with the same words, or none, are one document
        alike = found.filter("node IS NULL").join(checked(twice, n_twice), "id", "left_semi").select("id", "same", "key").distinct()
        least = alike.groupBy("id", "same").agg(F.min("key").alias("key"))
        gone = gone.unionByName(alike.join(least, ["id", "key"], "left_anti").select("id", "key"))
    gone = materialise(gone.select(F.col("id").alias(gone_id), F.col("key").alias(gone_key)), "dropped")
    keyed = docs.withColumn(id_, _id()).withColumn(key, F.xxhash64("text"))
    kept = keyed.join(checked(gone, gone.count()), (F.col(id_) == F.col(gone_id)) & (F.col(key) == F.col(gone_key)), "left_anti")
    if not n_twice:
        return kept.select(*own)
    again = checked(twice.select(F.col("id").alias(gone_id)), n_twice)  # of rows that are alike in all, one stays
    once = kept.join(again, F.col(id_) == F.col(gone_id), "left_anti")
    one = kept.join(again, F.col(id_) == F.col(gone_id), "left_semi").dropDuplicates([id_, key])
    return once.select(*own).unionByName(one.select(*own))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
