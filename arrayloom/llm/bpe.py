"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

1. Every partition splits its texts into pre-tokens and sends each distinct one once, packed by hash
   bucket, so a word costs the shuffle one entry a partition however often it occurs.
2. Every bucket encodes each of its distinct words once, whoever sent it, and returns them with their ids to
   the senders.
3. Every partition reads its texts again, looks the words' ids up and puts them together by position.
   Texts never cross the network; the two passes are lined up by zipping partitions.

Answers are found by word, not by their order: should a lost partition come back with its rows in another
order, nothing is mistaken, and a word without an answer is encoded where it stands. Texts are read in
chunks of CHUNK_ROWS rows, whose number doesn't depend on the rows' order, and words are sent in messages
of about CHUNK_CHARS.

Decoding looks token bytes up in the table of the vocabulary, whose size is fixed, and joins them.

Defined results: a null text counts as empty and has no ids; rows may repeat; added columns replace
ones of the same name; an empty table stays empty; a text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.serializers import BatchedSerializer, CPickleSerializer

from ._shared import table

CHUNK_CHARS, CHUNK_ROWS = 1 << 20, 64
#: What encode() can return of a text.
OUTPUTS = {"ids": T.BinaryType(), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
#: Bytes of text a bucket of words, up to so many buckets: distinct words grow more slowly than texts.
BUCKET_TEXT, BUCKETS = 32 << 20, 4096
#: Words whose ids a bucket remembers: a bound of its memory, not of what is encoded.
REMEMBERED_WORDS = 2_000_000
_CORES: dict = {}


def _ranks(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}


def _core(vocabulary: bytes, pattern: str):
    """One word's encoder: merges by rank within a pre-token."""
    key = zlib.crc32(vocabulary)
    if key not in _CORES:
        import tiktoken

        _CORES[key] = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=_ranks(vocabulary), special_tokens={})._core_bpe
    return _CORES[key].encode_single_piece


def _chunks(rows: Iterator) -> Iterator[list]:
    """Rows in runs of CHUNK_ROWS."""
    while run := list(islice(rows, CHUNK_ROWS)):
        yield [tuple(row) for row in run]


def _pack(parts: list[bytes]) -> bytes:
    import numpy as np

    return zlib.compress(np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts), 1)


def _unpack(blob: bytes) -> list[bytes]:
    import numpy as np

    data = zlib.decompress(blob)
    n = int.from_bytes(data[:4], "little")
    lengths = np.frombuffer(data, "<u4", n, 4).tolist()
    out, start = [], 4 + 4 * n
    for k in lengths:
        out.append(data[start : start + k])
        start += k
    return out


def _tokens(vocabulary: bytes) -> list[bytes]:
    """The bytes of each token, by id."""
    ranks = _ranks(vocabulary)
    out = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


def decode_ids(ids: bytes, tokens: list[bytes]) -> bytes:
    import numpy as np

    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", buckets: int | None = None, outputs: tuple[str, ...] = ("ids", "n_tokens")) -> DataFrame:
    """docs without its text, with outputs: ids (little-endian unsigned 32-bit integers), n_tokens, and SHA-256
    digests of the ids and of the bytes they decode to, for who needs no more than to check them."""
    spark = docs.sparkSession
    context = spark.sparkContext
    with open(ranks_path, "rb") as f:
        vocabulary = context.broadcast(f.read())
    kept = [c for c in docs.columns if c.lower() not in (*outputs, text.lower())]
    at = len(kept)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`")).rdd
    parts = rows.getNumPartitions()
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        buckets = min(max(context.defaultParallelism, -(-size // BUCKET_TEXT)), BUCKETS)

    def ask(part: int, found: Iterator) -> Iterator:
        """(bucket, (partition, words)), and the number of chunks in place of words."""
        import regex

        find, known, waiting, size, chunks = regex.compile(pattern).findall, set(), [], 0, 0

        def messages(words: list[str]) -> Iterator:
            by: dict[int, list[bytes]] = {}
            for w in words:
                data = w.encode()
                by.setdefault(zlib.crc32(data) % buckets, []).append(data)
            for b, datas in by.items():
                yield b, (part, _pack(datas))

        for run in _chunks(found):
            chunks += 1
            for row in run:
                new = [w for w in dict.fromkeys(find(row[at] or "")) if w not in known]
                known.update(new)
                waiting += new
                size += sum(map(len, new))
                if size >= CHUNK_CHARS:
                    yield from messages(waiting)
                    waiting, size = [], 0
        yield from messages(waiting)
        yield part % buckets, (part, chunks)

    def answer(found: Iterator) -> Iterator:
        merge, ids = _core(vocabulary.value, pattern), {}
        for _, (part, blob) in found:
            if isinstance(blob, int):
                yield part, blob
                continue
            words, out = _unpack(blob), []
            if len(ids) > REMEMBERED_WORDS:
                ids.clear()
            for word in words:
                got = ids.get(word)
                if got is None:
                    got = ids[word] = b"".join([x.to_bytes(4, "little") for x in merge(word)])
                out.append(got)
            yield part, (_pack(words), _pack(out))

    def by_chunk(found: Iterator) -> Iterator:
        """As many elements as the partition has chunks of rows: its answers, packed, in the first."""
        chunks, got = 0, []
        for _, message in found:
            if isinstance(message, int):
                chunks = message
            else:
                got.append(message)
        for i in range(chunks):
            yield got if not i else []

    def finish(found: Iterator) -> Iterator:
        import regex

        find, ids = regex.compile(pattern).findall, {}
        merge = _core(vocabulary.value, pattern)
        tokens = _tokens(vocabulary.value) if "decoded_sha256" in outputs else []
        make = {
            "ids": bytearray, "n_tokens": lambda x: len(x) // 4, "ids_sha256": lambda x: hashlib.sha256(x).hexdigest(),
            "decoded_sha256": lambda x: hashlib.sha256(decode_ids(x, tokens)).hexdigest(),
        }
        for run, messages in found:
            for words, answers in messages:
                ids.update(zip([w.decode() for w in _unpack(words)], _unpack(answers), strict=True))
            for row in run:
                own = find(row[at] or "")
                parts = list(map(ids.get, own))
                if None in parts:
                    for i, word in enumerate(own):
                        if parts[i] is None:
                            parts[i] = ids[word] = ids.get(word) or b"".join([x.to_bytes(4, "little") for x in merge(word.encode())])
                whole = b"".join(parts)
                yield (*row[:at], *[make[o](whole) for o in outputs])

    answers = rows.mapPartitionsWithIndex(ask).partitionBy(buckets, int).mapPartitions(answer)
    answers = answers.partitionBy(parts, int).mapPartitions(by_chunk)
    runs = rows.mapPartitions(_chunks)
    if (more := answers.getNumPartitions() - parts) > 0:
        runs = runs.union(context.parallelize([], more))
    fields = {f.name: f for f in docs.schema.fields}
    single = BatchedSerializer(CPickleSerializer(), 1)
    lined = runs._reserialize(single).zip(answers._reserialize(single))
    schema = T.StructType([*[fields[c] for c in kept], *[T.StructField(o, OUTPUTS[o]) for o in outputs]])
    return spark.createDataFrame(lined.mapPartitions(finish), schema, verifySchema=False)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """encoded with decoded, the bytes of its ids."""
    with open(ranks_path, "rb") as f:
        vocabulary = encoded.sparkSession.sparkContext.broadcast(f.read())
    own = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c.lower() != "decoded"])
    schema = T.StructType([*own.schema.fields, T.StructField("decoded", T.BinaryType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = None
        for whole in batches:
            tokens = tokens or _tokens(vocabulary.value)
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                out = [decode_ids(x.as_py() or b"", tokens) for x in batch.column(batch.schema.get_field_index(ids))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=schema.names)

    return own.mapInArrow(join, schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, ranks, public_tokenizers.PATTERN, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
