"""Prefix counts against the tokenizer's library; encoding against it and an exact round trip."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arrayloom.llm import bpe, token_counts
from arrayloom.llm.token_counts import PrefixCounter, read_ranks

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
HARD = [None, "", " ", "a", "  two  spaces ", "\n\n\nlines\n\n", "it's we'll 'l", "日本語 テキスト", "é" * 50, "<|endoftext|>", "a<|endoftext|>b <|endof", "x" * 3000, " " * 500 + "y", "12 345  6", "\t tab", "a a a a", "a a a a", "\x00\x1c　z"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_every_prefix(library):
    counter = PrefixCounter(read_ranks(RANKS), public_tokenizers.PATTERN)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'", "'s", "'ll", "é", "日本", "😀", "1", "23", "!", "<|", "<|endoftext|>", "|>", " ", " hello", "ing"]
    rnd = random.Random(3)
    for _ in range(300):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
        assert list(counter.prefixes(text)) == [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)], text


def test_counts_answer_budgets(spark, documents, library):
    docs = documents(*HARD).withColumn("n_tokens", F.lit("clash")).withColumn("extra", F.lit(1))
    rows = token_counts.count_prefixes(docs, RANKS, public_tokenizers.PATTERN, budgets=(3,))
    rows = rows.withColumn("first_two", token_counts.tokens_within(2)).orderBy("doc_id").collect()
    assert len(rows) == len(HARD) and rows[0]["extra"] == 1
    for r in rows:
        text = HARD[r["doc_id"]] or ""
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)] if len(text) < 600 else None
        assert r["n_tokens"] == len(library.encode(text, add_special_tokens=False).ids)
        assert r["n_bytes"] == len(text.encode())
        if want:
            assert r["prefix_tokens"] == want
            assert r["cut_3"] == max(i for i, n in enumerate(want) if n <= 3)
            assert r["first_two"] == want[min(2, len(text))]


def test_long_texts_take_time_in_proportion(library):
    """Runs of marks, blanks, letters and digits of 100,000 characters: whole counts as the library has them, prefixes at a few places."""
    counter = PrefixCounter(read_ranks(RANKS), public_tokenizers.PATTERN)
    began = time.monotonic()
    for text in ("'" * 100_000, " '" * 50_000, "'s" * 50_000, "\n'" * 50_000, "''s'll" * 17_000, " " * 100_000, "a" * 100_000, "é" * 50_000, "1" * 100_000, "don't '" * 15_000):
        counts = counter.prefixes(text)
        for at in (1, 2, 3, 1001, 20_002, len(text)):
            assert counts[at] == len(library.encode(text[:at], add_special_tokens=False).ids)
    assert time.monotonic() - began < 120


def test_packed_counts():
    for counts in ([0], [0, 1, 1, 2], [0, 200, 3], [0, 40_000, 1, 1], list(range(0, 700, 7))):
        packed = token_counts.packed(np.array(counts, np.int32))
        assert token_counts.unpacked(packed).tolist() == counts
    assert token_counts.packed(np.array([0, 1, 1])) == b"\x01\x01\x00"


def test_counts_of_an_empty_table(spark, documents):
    out = token_counts.count_prefixes(documents().drop("lang"), RANKS, public_tokenizers.PATTERN)
    assert out.count() == 0 and "prefix_tokens" in out.columns


def test_encode_as_the_library_and_back(spark, documents):
    texts = HARD + ["the same text twice"] * 2 + [f"word{i % 7} and {i}" for i in range(200)]
    docs = documents(*texts).withColumn("ids", F.lit("clash")).repartition(3)
    tok = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    rows = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert len(rows) == len(texts) and rows[0]["source"] == "s"
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == tok.encode_ordinary(text)
        assert r["n_tokens"] == len(r["ids"]) // 4
        assert bytes(r["decoded"]) == text.encode()


def test_encode_in_many_chunks_and_buckets(spark, documents, monkeypatch):
    texts = [f"{i} some words {i % 3}" for i in range(300)]
    monkeypatch.setattr(bpe, "CHUNK_ROWS", 7)
    out = bpe.decode(bpe.encode(documents(*texts).coalesce(2), RANKS, public_tokenizers.PATTERN, buckets=5), RANKS)
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in out.collect()} == dict(enumerate(texts))


def test_rows_in_another_order_the_second_time(spark, documents, monkeypatch):
    """A partition that is read again may have its rows in another order: every row keeps its own ids."""
    monkeypatch.setattr(bpe, "CHUNK_ROWS", 5)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 40)
    texts = [f"{i} some words {i % 3} {'long' * (i % 7)}" for i in range(200)]
    docs = documents(*texts).coalesce(2)
    whole, turned = type(docs.rdd).mapPartitions, []

    def shuffled(self, f, *a, **b):
        if f is not bpe._chunks:
            return whole(self, f, *a, **b)
        turned.append(1)
        return whole(self, lambda rows: f(iter(sorted(rows, key=lambda r: hashlib.md5(repr(r).encode()).digest()))), *a, **b)

    monkeypatch.setattr(type(docs.rdd), "mapPartitions", shuffled)
    out = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, buckets=3)
    tok = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    rows = out.collect()
    assert turned and {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in rows} == {i: tok.encode_ordinary(t) for i, t in enumerate(texts)}


def test_encode_an_empty_table(spark, documents):
    assert bpe.encode(documents(), RANKS, public_tokenizers.PATTERN).count() == 0


def test_queries(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    tok = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    counts, coded = token_counts.op3_token_counts(spark, sf).collect(), bpe.op10_bpe(spark, sf).collect()
    assert len(counts) == len(coded) == len(texts)
    for r in counts:
        n = len(tok.encode_ordinary(texts[r["doc_id"]]))
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 1024)
        stored = token_counts.unpacked(bytes(r["prefix_steps"]))
        assert len(stored) == len(texts[r["doc_id"]]) + 1 and stored[-1] == n and token_counts.fits(stored, 1024) == r["cut_1024"]
    for r in coded:
        ids = np.array(tok.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
