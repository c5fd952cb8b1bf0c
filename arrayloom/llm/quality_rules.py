"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document; the ledger keeps one bit per failed rule and the
measurements behind the bits. A policy is a named, versioned set of bits, so changing what is
rejected, or asking what a rule alone would change, never reads a text again.

Defined results: a null or empty text has no words and fails `too_few_words`; other columns are kept,
and one whose name clashes with a ledger column is replaced by it; repeated rows give repeated rows;
an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import BLANKS, let, table, text_of, unused, word_array

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")


@dataclass(frozen=True)
class Rule:
    """A rule fails where `fails`, SQL over the measurements, is true."""

    name: str
    fails: str


#: The position of a rule is its bit; rules are only ever appended.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 30 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    Rule("upper_case", "100 * n_upper > 40 * n_letters"),
)
BITS = {rule.name: 1 << i for i, rule in enumerate(RULES)}
BASE = BITS["too_few_words"] | BITS["repeated_windows"]
#: A document is kept under a policy if it fails none of the policy's rules.
POLICIES = {"base-1": BASE, "standard-1": sum(BITS.values())}


def repeated_window_words(words: Column) -> Column:
    """Words that lie in a three-word window found at least twice in the text."""

    def windows(w):
        return F.transform(
            F.sequence(F.lit(1), F.size(w) - 2),
            lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)),
        )

    def covered(h):
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def of_sorted(s):
            again = F.filter(
                s,
                lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]),
            )
            starts = F.sort_array(F.transform(again, lambda x: x["i"]))
            return let(
                starts,
                lambda p: F.aggregate(
                    F.transform(p, lambda x, k: F.least(F.lit(3), x - F.coalesce(F.get(p, k - 1), F.lit(-3)))),
                    F.lit(0),
                    lambda total, x: total + x,
                ),
            )

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, of_sorted))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows(words), covered))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements of each text."""
    whole = text_of(text)
    (m,) = unused(docs, "__m")
    letters = F.regexp_replace(whole, r"[^\p{L}]+", "")
    lines = F.filter(F.split(whole, "\n"), lambda x: F.translate(x, " " + BLANKS, "") != "")
    counted = docs.withColumn(
        m,
        F.struct(
            let(word_array(whole), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_window_words(w).cast("long").alias("r"))).alias("w"),
            F.length(F.translate(whole, " " + BLANKS, "")).cast("long").alias("chars"),
            (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("l"),
            let(letters, lambda x: F.struct(F.length(x).cast("long").alias("n"), F.length(F.regexp_replace(x, r"[^\p{Lu}]+", "")).cast("long").alias("u"))).alias("c"),
        ),
    )
    found = {
        "n_words": "w.n", "word_chars": "chars", "n_symbols": "symbols", "n_dup_lines": "l.d",
        "n_repeat_words": "w.r", "n_lines": "l.n", "n_upper": "c.u", "n_letters": "c.n",
    }
    return counted.withColumns({k: F.col(f"{m}.{v}") for k, v in found.items()}).drop(m)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with measurements and `failed_rules`, the bits of the rules that each document fails. One narrow map, no shuffle."""
    bits = F.lit(0)
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(BITS[rule.name])).otherwise(F.lit(0)))
    return measured(docs, text).withColumn("failed_rules", bits.cast("long"))


def kept(policy: str = "standard-1", mask: str = "failed_rules") -> Column:
    """Whether a ledger row passes a policy."""
    return F.col(mask).bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(rows: DataFrame, policy: str = "standard-1", mask: str = "failed_rules") -> DataFrame:
    """One row a rule of the policy: documents failing it, those that only it rejects, and what is kept without it.

    Aggregates the ledger by mask first (at most 2 ** rules rows), so the corpus is touched once.
    """
    by_mask = rows.groupBy(F.col(mask).bitwiseAND(F.lit(POLICIES[policy])).alias("m")).agg(F.count("*").alias("n"))
    parts = []
    for name, bit in BITS.items():
        if POLICIES[policy] & bit:
            parts += [
                F.sum(F.when(F.col("m").bitwiseAND(F.lit(bit)) != 0, F.col("n")).otherwise(0)).alias(f"{name}__failed"),
                F.sum(F.when(F.col("m") == bit, F.col("n")).otherwise(0)).alias(f"{name}__alone"),
            ]
    kept_now = F.sum(F.when(F.col("m") == 0, F.col("n")).otherwise(0)).alias("kept_now")
    names = [name for name, bit in BITS.items() if POLICIES[policy] & bit]
    wide = by_mask.agg(kept_now, *parts).na.fill(0)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"{n}__failed").alias("failed"), F.col(f"{n}__alone").alias("alone"), (F.col("kept_now") + F.col(f"{n}__alone")).alias("kept_without")) for n in names]))
    return wide.select(each.alias("r")).select("r.*")


def filter_documents(docs: DataFrame, policy: str = "standard-1") -> DataFrame:
    """The documents that a policy keeps, with their own columns only; those are kept aside, so that names can't clash."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col("text").alias("t"))
    return ledger(packed, "t").filter(kept(policy)).select("d.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed_rules").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"),
        kept("standard-1").alias("kept"), "failed_rules", "n_lines", "n_upper", "n_letters",
    )


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS a FROM d),
win AS (SELECT k, unnest(range(1, len(a) - 1)) AS i, a FROM w WHERE len(a) >= 3),
win2 AS (SELECT k, i, a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] AS s FROM win),
rep AS (SELECT k, s FROM win2 GROUP BY k, s HAVING count(*) > 1),
pos AS (SELECT DISTINCT k, unnest([i, i + 1, i + 2]) AS i FROM win2 JOIN rep USING (k, s)),
r AS (SELECT k, count(*) AS n FROM pos GROUP BY k),
ln AS (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d),
l AS (SELECT k, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
m AS (SELECT k, doc_id, CAST(len(a) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(l.n, 0) AS BIGINT) AS n_lines,
  CAST(length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS BIGINT) AS n_upper,
  CAST(length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS BIGINT) AS n_letters
  FROM d JOIN w USING (k) LEFT JOIN r USING (k) LEFT JOIN l USING (k)),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END)
  + (CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 16 ELSE 0 END)
  + (CASE WHEN 100 * n_upper > 40 * n_letters THEN 32 ELSE 0 END) AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept,
  CAST(bits AS BIGINT) AS failed_rules, n_lines, n_upper, n_letters FROM f
"""
