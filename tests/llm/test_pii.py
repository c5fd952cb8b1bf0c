"""Spans against Python's own expressions; what the model adds and what it leaves alone."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from arrayloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def checks(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    digits = lambda m: re.sub(r"[^0-9]", "", m.group())
    out = [("email", m) for m in EMAIL.finditer(text)]
    out += [("ip", m) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and checks(digits(m))]
    out += [("phone", m) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def compare(rows, texts):
    for r in rows:
        want = brute(texts[r["doc_id"]] or "")
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), (texts[r["doc_id"]], said, r["spans"])
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[0] == k for x in want) for k in ("email", "ip", "card", "phone")]
        assert {x for x in said.split(",") if x} <= set(r["spans"].split(","))


HARD = [None, "", "a@b.c@d.e.f", "a@b.c%x@d.e", "x@y..z", "😀 é a@b-c.de.", "1.2.3.4.5.6.7.8", "300.1.1.1 1.1.1.1", "0001.02.3.4", "99999999999.1.1.1",
        "4111 1111 1111 1111", "4111-1111-1111-1112", "4111 1111  1111 1111", "+1 (988) 555-2345.", "+12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "++1 (988) 555-23450)", "@.", "1", "a@b" + ".c" * 20_000, "9" * 60_000, "a" * 60_000, "5.5.5.5" * 3000]


def test_base_spans(spark, documents):
    rnd = random.Random(5)
    parts = ["a", "b1", "@", ".", "..", "c-d", "%", "+", "1", "23", "256", "4", " ", "-", "(", ")", "4111111111111111", "é", "\n", "+1 555", "555-7713"]
    texts = HARD + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14))) for _ in range(1500)]
    docs = documents(*texts).withColumn("spans", F.lit("clash")).withColumn("s", F.lit(1))
    rows = pii.detect(docs).collect()
    assert len(rows) == len(texts) and rows[0]["s"] == 1
    compare(rows, texts)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.op9_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    compare(rows, texts)
    secrets = sum("secret:" in r["spans"] for r in rows)
    planted = sum('token = "' in (t or "") for t in texts.values())
    assert secrets >= planted > 0


@pytest.fixture
def learned(documents):
    tokens = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(30)]
    return documents(*[f'the token = "{t}" is here' for t in tokens], *["plain words only, in 1999 or 2001"] * 30, None, "mail a@b.com or 4111 1111 1111 1111 now")


def test_masking(spark, learned):
    rows = {r["doc_id"]: r["text"] for r in pii.redact(learned).collect()}
    assert rows[0] == 'the token = "<SECRET>" is here'
    assert rows[40] == "plain words only, in 1999 or 2001"
    assert rows[60] is None
    assert rows[61] == "mail <EMAIL> or <CARD> now"
    assert pii.redact(learned).columns == learned.columns


CONTEXT_CLASS = {"": 0, " ": 0, "\n": 0, "\t": 0, "\r": 0}


def seen(text):
    """What the labelers and the classifier see of each candidate, by Python's means: kind, start, end, passes, votes, features."""
    out = []
    for at, kind in enumerate(pii.KINDS):
        for m in regex.finditer(pii.PATTERNS[kind], text):
            t, s, e = m.group(), m.start(), m.end()
            n = sum(c in "0123456789" for c in t)
            ok = {
                "email": True, "ip": all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in t.split(".")) if kind == "ip" else False,
                "card": 13 <= n <= 19 and checks(re.sub("[^0-9]", "", t)), "phone": 9 <= n <= 15,
                "secret": len(t) >= 24 and n >= 4 and bool(re.search("^(?:[0-9a-f]+|[0-9A-F]+|[A-Za-z]{2,5}_[A-Za-z0-9]+)$", t)),
            }[kind]
            sides = [CONTEXT_CLASS.get(c, 1 if regex.match(r"[\p{L}\p{N}_]", c) else 2) for c in (text[max(0, s - 1) : s], text[e : e + 1])]
            marks = [ok, regex.search(pii.KNOWN[kind], t), regex.search(pii.CONTEXT[kind], text[max(0, s - 32) : s]), 1 not in sides]
            out.append((at, s, e, ok, sum(1 << i for i, x in enumerate(marks) if x), (min(9, len(t) // 3), n * 4 // len(t), *sides)))
    return out


def model(found):
    """Weights of the classifier by plain sums and loops."""
    weights = {}
    for kind in {c[0] for c in found}:
        mine = [c for c in found if c[0] == kind]
        votes = Counter(c[4] for c in mine)
        prior, a, b = 0.5, [0.8] * 4, [0.1] * 4

        def odds(v):
            yes, no = prior, 1 - prior
            for j in range(4):
                yes, no = yes * (a[j] if v >> j & 1 else 1 - a[j]), no * (b[j] if v >> j & 1 else 1 - b[j])
            return yes / (yes + no)

        for _ in range(pii.ROUNDS):
            r = {v: odds(v) for v in votes}
            n1, n = sum(votes[v] * r[v] for v in votes), sum(votes.values())
            hits = [(sum(votes[v] * r[v] for v in votes if v >> j & 1) + 4) / (n1 + 5) for j in range(4)]
            alarms = [(sum(votes[v] * (1 - r[v]) for v in votes if v >> j & 1) + 1) / (n - n1 + 10) for j in range(4)]
            prior, a, b = (n1 + 1) / (n + 2), hits, alarms
        ty = sum(odds(c[4]) for c in mine)
        tz = len(mine) - ty
        weights[str(kind)] = math.log((ty + 1) / (tz + 1))
        sums = defaultdict(lambda: [0.0, 0.0])
        for c in mine:
            for key in (f"{kind}:v:{c[4]}", *(f"{kind}:f{i}:{x}" for i, x in enumerate(c[5]))):
                sums[key][0] += odds(c[4])
                sums[key][1] += 1 - odds(c[4])
        for key, (y, z) in sums.items():
            weights[key] = math.log((y + 0.5) / (ty + 5) / ((z + 0.5) / (tz + 5)))
    return weights


def test_whole_result_by_brute_force(spark):
    """Candidates, votes, reliabilities, weights and decisions, against plain Python over all texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    found = {i: seen(t) for i, t in texts.items()}
    weights = model([c for cs in found.values() for c in cs])
    got = docs.select(F.explode(pii.candidates(pii.text_of())).alias("c")).select(F.struct("c.*").alias("s"))
    mine = pii.fit(got.groupBy().agg(F.collect_list("s").alias("all")), "all")
    assert set(mine) == set(weights) and all(abs(mine[k] - weights[k]) < 1e-6 for k in weights)
    for r in pii.op9_pii(spark, "/root/testdata/sf0.001").collect():
        want = []
        for kind, s, e, ok, votes, features in found[r["doc_id"]]:
            odds = weights[str(kind)] + weights[f"{kind}:v:{votes}"] + sum(weights[f"{kind}:f{i}:{x}"] for i, x in enumerate(features))
            if ok and kind < pii.BASE_KINDS or votes & pii.EVIDENCE and odds >= 0:
                want.append(f"{pii.KINDS[kind]}:{s}:{e}")
        assert r["spans"] == ",".join(want)


def test_long_texts_take_time_in_proportion(spark, documents):
    """200 KB of addresses and as much of numbers: every span, and the mask of each."""
    mails = " ".join(f"é{i} someone{i}@example.org" for i in range(8000))
    numbers = "10.0.0.1," * 20_000 + "9 " * 20_000
    docs = documents(mails, numbers, "x " * 100_000 + " a@b.com " + "é😀 " * 100_000).withColumn("__c", F.lit("clash"))
    began = time.monotonic()
    rows = {r["doc_id"]: r for r in pii.detect(docs).collect()}
    compare(rows.values(), {0: mails, 1: numbers, 2: "x " * 100_000 + " a@b.com " + "é😀 " * 100_000})
    masked = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert masked[0]["text"] == EMAIL.sub("<EMAIL>", mails) and masked[0]["__c"] == "clash" == rows[0]["__c"]
    assert masked[2]["text"] == "x " * 100_000 + " <EMAIL> " + "é😀 " * 100_000
    assert masked[1]["text"].count("<IP>") == 20_000
    assert time.monotonic() - began < 120


@pytest.mark.parametrize("seed", range(3))
def test_masks_anywhere(spark, seed):
    """Spans within and over the borders of a text's parts, overlapping and at its ends."""
    rnd = random.Random(seed)
    rows = []
    for i in range(60):
        text = "".join(rnd.choice("ab é😀\n") for _ in range(rnd.choice([0, 5, 1023, 1024, 1025, 2048, 5000])))
        spans = []
        for _ in range(rnd.choice([0, 1, 3, 200])):
            s = rnd.randint(0, len(text))
            spans.append((s, min(len(text), s + rnd.choice([0, 1, 7, 1100])), rnd.randrange(5)))
        rows.append((i, text, [s for s in spans if s[0] < s[1]]))
    schema = "id int, text string, spans array<struct<s: int, e: int, kind: int>>"
    got = {r["id"]: r["m"] for r in spark.createDataFrame(rows, schema).select("id", pii.masked(F.col("text"), F.col("spans")).alias("m")).collect()}
    for i, text, spans in rows:
        out, at = [], 0
        for s, e, kind in sorted(spans):
            if s >= at:
                out += [text[at:s], f"<{pii.KINDS[kind].upper()}>"]
            at = max(at, e)
        assert got[i] == "".join([*out, text[at:]])


def test_empty(spark, documents):
    assert pii.detect(documents()).count() == 0
    assert [r["spans"] for r in pii.detect(documents("nothing", None)).collect()] == ["", ""]


def test_short_cards_are_candidates_in_every_text(spark, documents):
    """A short number is a candidate whatever else the text has: a run of twelve digits elsewhere makes no difference."""
    docs = documents("card 4111 11", "card 4111 11 and then 123456789012", "card 4 and", "card 41")
    rows = docs.select("doc_id", F.transform(F.filter(pii.candidates(F.col("text")), lambda c: c["kind"] == 2), lambda c: F.concat_ws(":", c["s"], c["e"], c["votes"])).alias("c")).collect()
    found = {r["doc_id"]: r["c"] for r in rows}
    assert len(found[0]) == 1 and found[0] == found[1][:1] and len(found[1]) == 2
    assert found[2] == [] and len(found[3]) == 1
