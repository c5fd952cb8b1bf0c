"""Personal data: weak labelers vote on candidate spans, expectation-maximisation weighs them, a span classifier decides.

Candidates are the matches of one pattern a kind. Spans that pass their kind's exact test are always
reported. Four labelers vote on every candidate: its exact test, a gazetteer (top-level domains,
card issuers, country codes, key prefixes), words of the context before it, and whether it stands
alone. The votes are counted by pattern of votes over the whole corpus; on these few counts
expectation-maximisation estimates each labeler's hit and false-alarm rate for each kind, and the
resulting odds label the features a naive Bayes classifier is trained on. It adds candidates that it
takes to be personal data although their exact test fails, or there is none.

DataFrame functions only. Only counts are shuffled: at most kinds x vote patterns x feature values rows,
however large the corpus.

A text is read from its start to its end, whatever it holds: offsets and contexts are carried along from
match to match, so the time grows with the text, not with its square.

Defined results: a null text counts as empty and has no spans; offsets count code points; repeated rows
give repeated rows; all other columns are kept, whatever their names, but that one named like a result is
replaced; without candidates nothing is added; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import let, materialise, table, text_of, unused

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = 4
#: The contract's patterns, with possessive loops: the same matches, without backtracking or deep stacks.
#: A match starts where the last ended or where a run of its characters does.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])(?=[0-9_]*+[A-Za-z])[A-Za-z0-9_]{16,}+",
}
#: Each is implied by its pattern: without it a text has no candidate of the kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "secret": r"[A-Za-z_][0-9]|[0-9][A-Za-z_]"}
#: Gazetteers and context words (fixed values).
KNOWN = {
    "email": r"\.(?:com|org|net|edu|gov|info|io|co|de|fr|es|it|nl|eu|uk|us)$",
    "ip": r"^(?!0+\.|255\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}$",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)",
    "phone": r"^\+(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "secret": r"^(?:AKIA|ASIA|ghp_|gho_|sk_|pk_|xox|AIza)|^[0-9a-f]{32,}$",
}
CONTEXT = {
    "email": r"(?i)mail|contact|correo|courriel|kontakt",
    "ip": r"(?i)\bip\b|host|server|addr|login",
    "card": r"(?i)card|visa|credit|karte|tarjeta|carte",
    "phone": r"(?i)phone|tel\b|tel\.|call|fax|mobile|telefon",
    "secret": r"(?i)token|key|secret|passw|pwd|auth|credential",
}
CONTEXT_CHARS = 32
#: Items of a part that is scanned by itself; characters of a part of a text are two to this many bits.
PART, TEXT_BITS = 32, 10
LABELERS, FEATURES, ROUNDS = 4, 4, 25
THRESHOLD = 0.5
#: Votes of which a span needs one at least to be added: its exact test or its context. Digits alone prove nothing.
EVIDENCE = 0b0101


def part(items: Column, j: Column) -> Column:
    return F.slice(items, j * PART + 1, F.lit(PART))


def by_part(items: Column, body) -> Column:
    """body(j) for each part j of PART items."""
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / PART).cast("int")), body))


def scan(items: Column, begin, step, kind: str) -> Column:
    """The outputs of step(state, x) -> struct<state, out> over items, a bound name; kind: the SQL type of an output.

    An aggregate copies what it has gathered at every step, so each part of the items has one of its own;
    begin(j) is the state before part j.
    """

    def add(acc, x):
        return let(step(acc["state"], x), lambda now: F.struct(now["state"].alias("state"), F.array_append(acc["out"], now["out"]).alias("out")))

    def of(j):
        return F.aggregate(part(items, j), F.struct(begin(j).alias("state"), F.expr(f"CAST(array() AS array<{kind}>)").alias("out")), add, lambda acc: acc["out"])

    return F.coalesce(F.flatten(by_part(items, of)), F.expr(f"CAST(array() AS array<{kind}>)"))


def raw_spans(text: Column, pattern: str, hint: str) -> Column:
    """array<struct<s, e, t, before, after>>: the matches with their offsets, the CONTEXT_CHARS before and the one after, from the pieces that the pattern cuts a text into."""
    kind = "struct<s: int, e: int, t: string, before: string, after: string>"

    def step(state, x):
        def of(s, before):
            e = s + F.length(x["m"])
            after = F.when(x["next"] != "", F.substring(x["next"], 1, 1)).otherwise(F.coalesce(F.substring(x["then"], 1, 1), F.lit("")))
            went = F.struct(e.alias("at"), F.right(F.concat(before, x["m"]), F.lit(CONTEXT_CHARS)).alias("tail"))
            return F.struct(went.alias("state"), F.struct(s.alias("s"), e.alias("e"), x["m"].alias("t"), before.alias("before"), after.alias("after")).alias("out"))

        come = F.struct((state["at"] + F.length(x["p"])).alias("s"), F.right(F.concat(state["tail"], x["p"]), F.lit(CONTEXT_CHARS)).alias("before"))
        return let(come, lambda c: of(c["s"], c["before"]))

    def total(numbers):
        return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)

    def placed(each, sizes):
        def begin(j):
            # A match has a character at least, so as many matches as the context has characters fill it.
            last = F.slice(each, F.greatest(j * PART - CONTEXT_CHARS, F.lit(0)) + 1, F.least(j * PART, F.lit(CONTEXT_CHARS)))
            tail = F.right(F.array_join(F.transform(last, lambda x: F.concat(x["p"], x["m"])), ""), F.lit(CONTEXT_CHARS))
            return F.struct(total(F.slice(sizes, F.lit(1), j)).alias("at"), tail.alias("tail"))

        return scan(each, begin, step, kind)

    def cut(m, p):
        each = F.transform(m, lambda x, i: F.struct(x.alias("m"), F.get(p, i).alias("p"), F.get(p, i + 1).alias("next"), F.get(m, i + 1).alias("then")))
        return let(each, lambda e: let(F.struct(by_part(e, lambda j: total(F.transform(part(e, j), lambda x: F.length(x["p"]) + F.length(x["m"])))).alias("n")), lambda z: placed(e, z["n"])))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    there = F.contains(text, F.lit(hint)) if hint == "@" else F.regexp_like(text, F.lit(hint))
    return F.when(there, let(both, lambda x: cut(x["m"], x["p"]))).otherwise(F.expr(f"CAST(array() AS array<{kind}>)"))


def n_digits(t: Column) -> Column:
    return F.length(t) - F.length(F.translate(t, "0123456789", ""))


def luhn(t: Column) -> Column:
    """Whether the digits of t pass the check sum."""

    def of(r):
        values = F.transform(F.split(r, ""), lambda c, i: let(F.ascii(c) - 48, lambda d: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)))
        return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0

    return let(F.reverse(F.translate(t, " -", "")), of)


def valid(kind: str, t: Column) -> Column:
    """The exact test of a kind."""
    if kind == "ip":
        parts = F.split(t, r"\.")
        return F.forall(parts, lambda p: F.coalesce(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.lit(False)) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return n_digits(t).between(13, 19) & luhn(t)
    if kind == "phone":
        return n_digits(t).between(9, 15)
    if kind == "secret":
        return (F.length(t) >= 24) & (n_digits(t) >= 4) & F.regexp_like(t, F.lit("^(?:[0-9a-f]+|[0-9A-F]+|[A-Za-z]{2,5}_[A-Za-z0-9]+)$"))
    return F.lit(True)


def char_class(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")).isin("", " ", "\n", "\t", "\r"), 0).when(F.regexp_like(c, F.lit(r"^[\p{L}\p{N}_]$")), 1).otherwise(2)


def candidates(text: Column) -> Column:
    """array<struct<kind, s, e, valid, votes, f0..f3>> of a text, by kind and start."""

    def of(kind_at: int, kind: str):
        def judge(x):
            before, right = x["before"], x["after"]
            left = F.right(before, F.lit(1))

            def vote(v):
                marks = [v, F.regexp_like(x["t"], F.lit(KNOWN[kind])), F.regexp_like(before, F.lit(CONTEXT[kind])), (char_class(left) != 1) & (char_class(right) != 1)]
                votes = sum((F.when(m, 1 << i).otherwise(0) for i, m in enumerate(marks)), F.lit(0))
                size = F.length(x["t"])
                return F.struct(
                    F.lit(kind_at).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), v.alias("valid"), votes.alias("votes"),
                    F.least(F.lit(9), F.floor(size / 3).cast("int")).alias("f0"), F.floor(n_digits(x["t"]) * 4 / size).cast("int").alias("f1"),
                    char_class(left).alias("f2"), char_class(right).alias("f3"),
                )

            return let(valid(kind, x["t"]), vote)

        return F.transform(raw_spans(text, PATTERNS[kind], HINTS[kind]), judge)

    return F.concat(*[of(i, k) for i, k in enumerate(KINDS)])


def reliabilities(counts: DataFrame) -> DataFrame:
    """kind, prior, a0.., b0..: hit and false-alarm rates by expectation-maximisation over counts (kind, votes, n).

    The fold runs inside one expression a kind, over its at most 2 ** LABELERS patterns.
    """
    by_kind = counts.groupBy("kind", "votes").agg(F.sum("n").cast("double").alias("n")).groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p"))
    names = [f"{x}{j}" for x in "ab" for j in range(LABELERS)]

    def bit(p, j):
        return p["votes"].bitwiseAND(F.lit(1 << j)) != 0

    def fired(j, value):
        return lambda x: F.when(bit(x, j), value(x)).otherwise(0.0)

    def posterior(s, p):
        yes, no = s["prior"], 1 - s["prior"]
        for j in range(LABELERS):
            yes = yes * F.when(bit(p, j), s[f"a{j}"]).otherwise(1 - s[f"a{j}"])
            no = no * F.when(bit(p, j), s[f"b{j}"]).otherwise(1 - s[f"b{j}"])
        return yes / (yes + no)

    def total(p, value):
        return F.aggregate(F.transform(p, value), F.lit(0.0), lambda a, x: a + x)

    def step(s, _):
        weighed = F.transform(F.col("p"), lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), posterior(s, p).alias("r")))

        def update(w):
            n1, n = total(w, lambda x: x["n"] * x["r"]), total(w, lambda x: x["n"])
            # Rates are drawn towards a labeler that is better than chance, so that the classes can't swap.
            hits = [((total(w, fired(j, lambda x: x["n"] * x["r"])) + 4) / (n1 + 5)).alias(f"a{j}") for j in range(LABELERS)]
            alarms = [((total(w, fired(j, lambda x: x["n"] * (1 - x["r"]))) + 1) / (n - n1 + 10)).alias(f"b{j}") for j in range(LABELERS)]
            return F.struct(((n1 + 1) / (n + 2)).alias("prior"), *hits, *alarms)

        return let(weighed, update)

    first = F.struct(F.lit(0.5).alias("prior"), *[F.lit(0.8 if x[0] == "a" else 0.1).alias(x) for x in names])
    fitted = by_kind.select("kind", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), first, step).alias("s"))
    return fitted.select("kind", "s.*")


def classifier(counts: DataFrame) -> DataFrame:
    """key, weight: log odds of a kind ('k') and of each feature value of it ('k:feature:value'), trained on soft labels."""
    rates = reliabilities(counts)
    rows = counts.join(rates, "kind")
    yes, no = F.col("prior"), 1 - F.col("prior")
    for j in range(LABELERS):
        fires = F.col("votes").bitwiseAND(F.lit(1 << j)) != 0
        yes = yes * F.when(fires, F.col(f"a{j}")).otherwise(1 - F.col(f"a{j}"))
        no = no * F.when(fires, F.col(f"b{j}")).otherwise(1 - F.col(f"b{j}"))
    rows = rows.withColumn("y", F.col("n") * yes / (yes + no)).withColumn("z", F.col("n") - F.col("y"))
    # What the labelers saw is a feature too; the others let like spans share strength.
    each = [F.struct(F.lit("v").alias("f"), F.col("votes").alias("x"))] + [F.struct(F.lit(f"f{i}").alias("f"), F.col(f"f{i}").alias("x")) for i in range(FEATURES)]
    spread = rows.select("kind", "y", "z", F.explode(F.array(*each)).alias("e"))
    by_value = spread.groupBy("kind", "e.f", "e.x").agg(F.sum("y").alias("y"), F.sum("z").alias("z"))
    by_kind = rows.groupBy("kind").agg(F.sum("y").alias("ty"), F.sum("z").alias("tz"))
    odds = by_value.join(by_kind, "kind").select(
        F.concat_ws(":", "kind", "f", "x").alias("key"),
        F.log((F.col("y") + 0.5) / (F.col("ty") + 5) / ((F.col("z") + 0.5) / (F.col("tz") + 5))).alias("weight"),
    )
    return odds.unionByName(by_kind.select(F.col("kind").cast("string").alias("key"), F.log((F.col("ty") + 1) / (F.col("tz") + 1)).alias("weight")))


def count_votes(found: DataFrame, column: str) -> DataFrame:
    """Candidates counted by what the model sees of them."""
    one = found.filter(F.size(column) > 0).select(F.explode(column).alias("c"))
    return one.groupBy("c.kind", "c.votes", *[f"c.f{i}" for i in range(FEATURES)]).agg(F.count("*").alias("n"))


def fit(found: DataFrame, column: str) -> dict[str, float]:
    """The classifier's weights: a bounded number (kinds x feature values), whatever the corpus."""
    return {r["key"]: r["weight"] for r in classifier(count_votes(found, column)).orderBy("key").collect()}


def decided(found: Column, weights: dict[str, float]) -> Column:
    """Of the candidates, those that pass their exact test or that the classifier takes; secrets need the classifier."""
    if not weights:
        return F.filter(found, lambda c: c["valid"] & (c["kind"] < BASE_KINDS))
    model = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv])

    def keep(c):
        odds = F.coalesce(F.try_element_at(model, c["kind"].cast("string")), F.lit(0.0))
        for name, value in [("v", c["votes"]), *[(f"f{i}", c[f"f{i}"]) for i in range(FEATURES)]]:
            odds = odds + F.coalesce(F.try_element_at(model, F.concat_ws(":", c["kind"].cast("string"), F.lit(name), value.cast("string"))), F.lit(0.0))
        spoken_for = c["votes"].bitwiseAND(F.lit(EVIDENCE)) != 0
        return (c["valid"] & (c["kind"] < BASE_KINDS)) | (spoken_for & (1 / (1 + F.exp(-odds)) >= THRESHOLD))

    return F.filter(found, keep)


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.element_at(names, c["kind"] + 1), c["s"].cast("string"), c["e"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in angle brackets; of overlapping spans the first to start names it."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def step(at, x):
        return F.struct(F.greatest(at, x["e"]).alias("state"), F.struct(at.alias("a"), x["s"].alias("z"), F.when(x["s"] >= at, x["k"]).alias("k")).alias("out"))

    def low(i):
        return i.bitwiseAND(F.lit((1 << TEXT_BITS) - 1))

    def put_together(parts, ordered, farthest):
        # A place is found in its part, as characters of UTF-8 are counted from where a string begins.
        def plain(a, z):
            def of(p, q):
                between = F.array_join(F.slice(parts, p + 2, F.greatest(q - p - 1, F.lit(0))), "")
                apart = F.concat(F.substring(F.get(parts, p), low(a) + 1, F.lit(1 << TEXT_BITS)), between, F.coalesce(F.substring(F.get(parts, q), F.lit(1), low(z)), F.lit("")))
                return F.when(p == q, F.substring(F.get(parts, p), low(a) + 1, z - a)).otherwise(apart)

            return F.when(a < z, of(F.shiftright(a, TEXT_BITS), F.shiftright(z, TEXT_BITS))).otherwise(F.lit(""))

        found = scan(ordered, lambda j: F.coalesce(F.array_max(F.slice(farthest, F.lit(1), j)), F.lit(0)), step, "struct<a: int, z: int, k: int>")
        pieces = F.transform(F.filter(found, lambda x: x["k"].isNotNull()), lambda x: F.concat(plain(x["a"], x["z"]), F.element_at(names, x["k"] + 1)))
        rest = let(F.struct(F.array_max(farthest).alias("a"), F.length(text).alias("z")), lambda x: plain(x["a"], x["z"]))
        return F.concat(F.array_join(pieces, ""), rest)

    ordered = F.sort_array(F.transform(spans, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("k"))))
    both = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << TEXT_BITS}}}"), F.lit(0)).alias("parts"), ordered.alias("o"))

    def ends(x):
        farthest = by_part(x["o"], lambda j: F.array_max(F.transform(part(x["o"], j), lambda y: y["e"])))
        return let(F.struct(farthest.alias("e")), lambda f: put_together(x["parts"], x["o"], f["e"]))

    return F.when(F.size(spans) > 0, let(both, ends)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text masked; the model is fitted on docs. Null texts stay null. Candidates are written beside their texts, as finding them costs more than reading."""
    (c,) = unused(docs, "__c")
    found = materialise(docs.withColumn(c, candidates(text_of())), "pii-texts")
    weights = fit(found, c)
    text = F.when(F.col("text").isNotNull(), let(decided(F.col(c), weights), lambda spans: masked(F.col("text"), spans)))
    return found.select(*[text.alias(x) if x == "text" else F.col(f"`{x}`") for x in docs.columns])


def detect(docs: DataFrame) -> DataFrame:
    """docs without text, with the counts and spans of each. Candidates, a few a document, are written once and read twice."""
    out = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    (c,) = unused(docs, "__c")
    own = [F.col(f"`{x}`") for x in docs.columns if x.lower() not in (*out, "text")]
    found = materialise(docs.select(*own, candidates(text_of()).alias(c)), "pii-candidates")
    weights = fit(found, c)
    base = F.filter(c, lambda x: x["valid"] & (x["kind"] < BASE_KINDS))

    def of_kind(i):
        return F.filter(c, lambda x: x["valid"] & (x["kind"] == i))

    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:BASE_KINDS])]
    return found.select(*own, *counts, F.sha2(written(base), 256).alias("base_sha256"), written(decided(F.col(c), weights)).alias("spans"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
