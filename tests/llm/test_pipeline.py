"""The whole pipeline against plain Python, stage by stage."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from arrayloom.llm import quality_rules  # noqa: E402
from arrayloom.llm.token_counts import read_ranks  # noqa: E402

from .test_ngram_join import brute as all_pairs  # noqa: E402
from .test_pii import brute as base_spans  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def passes(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    letters = [c for c in text or "" if c.isalpha()]
    n, chars = len(w), sum(map(len, w))
    return not (
        n < 50 or 100 * len(again) > 50 * n or 100 * sum(c in quality_rules.SYMBOLS for c in text) > 30 * n
        or 100 * (len(lines) - len(set(lines))) > 40 * len(lines) or chars < 2 * n or chars > 20 * n
        or 100 * sum(c.isupper() for c in letters) > 40 * len(letters)
    )


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        if name != "bpe":
            assert sorted(out.columns) == sorted(docs.columns)
            docs = out
        after[name] = out.collect()
    kept = sorted(r["doc_id"] for r in after["quality_rules"])
    assert kept == sorted(i for i, t in texts.items() if passes(t))
    _, least = all_pairs([texts[i] for i in kept])
    assert sorted(r["doc_id"] for r in after["ngram_join"]) == [i for k, i in enumerate(kept) if least[k] == k]
    for r in after["pii"]:
        assert r["n_chars"] == len(r["text"])
        whole = texts[r["doc_id"]]
        for _, s, e in base_spans(whole):
            assert not base_spans(whole) or whole[s:e] not in r["text"]
        if not base_spans(whole) and "token" not in whole:
            assert r["text"] == whole
    mixed = Counter(r["doc_id"] for r in after["mixing"])
    masked = {r["doc_id"]: r["text"] for r in after["pii"]}
    assert set(mixed) <= set(masked) and max(mixed.values()) <= 2
    tok = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(corpus_pipeline.RANKS), special_tokens={})
    assert Counter(r["doc_id"] for r in after["bpe"]) == mixed
    for r in after["bpe"]:
        ids = tok.encode_ordinary(masked[r["doc_id"]])
        assert bytes(r["ids"]) == b"".join(i.to_bytes(4, "little") for i in ids) and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(masked[r["doc_id"]].encode()).hexdigest()


def test_run_is_the_stages_and_repeats(spark):
    first = sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert first == sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert len(first) > 0
