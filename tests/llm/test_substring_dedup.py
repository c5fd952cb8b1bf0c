"""Sentence spans against a quadratic search, and on long repeated passages."""

import random
import re

from pyspark.sql import functions as F

from arrayloom.llm import substring_dedup as s


def brute(texts):
    seen, out = {}, {}
    docs = []
    for doc, text in enumerate(texts):
        pieces = [p for p in re.split(r"(?<=[.!?])(?=[ \t\r\x0b\x0c])|(?<=\n)", text or "") if p]
        docs.append([(p, p.encode().split()) for p in pieces])
    for doc, pieces in enumerate(docs):
        full = [(i, w) for i, (_, w) in enumerate(pieces) if w]
        lost, runs = set(), set()
        for i in range(len(full)):
            for lo, hi in ((i, None), (None, i)):
                size, k = 0, i
                while 0 <= k < len(full):
                    size += len(full[k][1])
                    if size >= s.MIN_WORDS and k != i or len(full[i][1]) >= s.LONG:
                        runs.add((min(i, k), max(i, k)))
                        break
                    k += 1 if hi is None else -1
        for a, b in sorted(runs):
            key = tuple(b" ".join(w) for _, w in full[a : b + 1])
            if seen.setdefault(key, (doc, a)) != (doc, a):
                lost |= {i for i, _ in full[a : b + 1]}
        text = texts[doc]
        out[doc] = (len(full), len(lost), text if not lost else "".join(p for i, (p, _) in enumerate(pieces) if i not in lost).lstrip(" "))
    return out


def some(start, n, words=6):
    return " ".join(f"Sentence {start + i} " + " ".join(f"w{(start + i) * 31 + j}" for j in range(words)) + "." for i in range(n))


def test_against_brute_force(spark, documents):
    shared = some(1000, 8)
    texts = [
        some(0, 5) + " " + shared, shared, f"{some(20, 3)}\n{shared}\n{some(30, 3)}", shared + " " + shared, None, "", "One. Two. Three. Four.", "One. Two. Three. Four.",
        some(40, 2), some(40, 2), some(50, 4), some(50, 4).replace(" ", "  "), "é ü. " * 30, "x" * 50_000 + ". " + shared, "no end " * 40, "no end " * 40, "a b c d e f g h. " * 9, some(60, 400), some(60, 400),
    ]
    docs = documents(*texts).withColumn("n_removed", F.lit("clash")).withColumn("hashes", F.lit(1)).repartition(3)
    rows = s.remove(docs).collect()
    want = brute(texts)
    assert len(rows) == len(texts) and rows[0]["hashes"] == 1
    for r in rows:
        assert (r["n_sentences"], r["n_removed"], r["text"]) == want[r["doc_id"]], r["doc_id"]


def test_shuffled_removal_is_the_same(spark, documents, monkeypatch):
    texts = [some(i % 3 * 10, 5) for i in range(12)]
    here = sorted(map(tuple, s.remove(documents(*texts)).collect()))
    monkeypatch.setattr(s, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, s.remove(documents(*texts)).collect())) == here


def test_long_repeats_go(spark):
    """No passage of 60 words is left in two documents of different text, unless it has fewer than three whole sentences."""
    rows = s.op6_substring_dedup(spark, "/root/testdata/sf0.01").collect()
    seen, left = {}, set()
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        words = (r["text"] or "").encode().split()
        for i in range(0, len(words) - 59):
            key = b" ".join(words[i : i + 60])
            ends = sum(w[-1:] in b".!?" for w in words[i : i + 60])
            if ends >= 4 and seen.setdefault(key, r["doc_id"]) != r["doc_id"]:
                left.add(r["doc_id"])
    assert len(left) <= 0.002 * len(rows), sorted(left)[:20]


def test_empty(spark, documents):
    assert s.remove(documents()).count() == 0


def test_planted_passages_go_and_the_rest_stays(spark, documents):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    passages = [[sentence(rnd.randint(3, 14)) for _ in range(rnd.randint(5, 9))] for _ in range(4)]
    passages = [p + [sentence(50 - min(45, sum(map(len, map(str.split, p)))))] for p in passages]
    own, texts = [], []
    for i in range(60):
        body = [sentence(rnd.randint(1, 18)) for _ in range(rnd.randint(4, 30))]
        own.append(body)
        at = rnd.randint(0, len(body))
        texts.append(" ".join(body[:at] + passages[i % 4] + body[at:]) if i % 3 else "\n".join(body))
    rows = s.remove(documents(*texts)).collect()
    first = {}
    for i in range(60):
        if i % 3:
            first.setdefault(i % 4, i)
    for r in rows:
        i = r["doc_id"]
        kept = [p for p in passages[i % 4] if p in r["text"]]
        assert all(x in r["text"] for x in own[i])
        if i % 3 and first[i % 4] != i:
            assert not kept and r["n_removed"] == len(passages[i % 4])
        else:
            assert r["n_removed"] == 0 and r["text"] == texts[i]


def words_from(rnd, n):
    return ["".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(4, 9))) for _ in range(n)]


def test_passages_go_from_their_first_word_to_their_last(spark, documents):
    """Passages of MIN_WORDS words and more that start and end inside sentences, of one sentence or of several."""
    rnd = random.Random(11)
    passages, texts, hosts = [], [], []
    for n in [s.MIN_WORDS, s.MIN_WORDS + 1, 24, 29, 35, 48]:
        for stops in [(), (n // 2,), (3, n - 4), (1, 2, n - 1)]:
            passages.append([w + "." * (i + 1 in stops) for i, w in enumerate(words_from(rnd, n))])
    for i in range(3 * len(passages)):
        before, after = words_from(rnd, rnd.randint(1, 40)), words_from(rnd, rnd.randint(1, 40))
        hosts.append(before + after)
        texts.append(" ".join(before + passages[i % len(passages)] + after) + ("\n" if i % 2 else "."))
    for r in s.remove(documents(*texts).repartition(3)).collect():
        i = r["doc_id"]
        if i < len(passages):
            assert r["text"] == texts[i] and r["n_removed"] == 0
        else:
            assert r["text"].rstrip(".\n").split() == hosts[i] and r["n_removed"] > 0, i


def test_passages_below_the_floor_stay(spark, documents):
    rnd = random.Random(12)
    passage = words_from(rnd, s.MIN_WORDS - 1)
    texts = [" ".join(words_from(rnd, 15) + passage + words_from(rnd, 15)) + "." for _ in range(4)]
    assert [r["text"] for r in s.remove(documents(*texts)).orderBy("doc_id").collect()] == texts


def test_shared_hashes_across_batches(spark):
    """Groups of a hash that go on over many batches, against sets in plain Python."""
    rnd = random.Random(13)
    rows = {(rnd.randint(0, 40) ** 2 // 40, rnd.randint(0, 300)) for _ in range(2500)} | {(99, d) for d in range(50)} | {(1000 + i, i) for i in range(50)}
    held = {}
    for h, d in rows:
        held.setdefault(h, set()).add(d)
    later = sorted((h, d) for h, ds in held.items() for d in ds if d > min(ds))
    owned = sorted((h, min(ds)) for h, ds in held.items() if len(ds) > 1)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        df = spark.createDataFrame(sorted(rows), "h long, doc long")
        assert sorted(map(tuple, s.shared(df, owners=False).collect())) == later
        assert sorted(map(tuple, s.shared(df, owners=True).collect())) == sorted(later + owned)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
