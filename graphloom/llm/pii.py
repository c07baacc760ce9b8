"""Personal data in texts: exact base patterns, and bootstrapped contextual extraction, all in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.repeats import Scratch

KINDS = ("email", "ip", "card", "phone")
#: A further kind, which only bootstrapping looks for: identifiers of any shape.
ALL = (*KINDS, "id")
#: The base patterns, in forms without backtracking over groups, whose depth on the JVM's stack would follow the
#: text: U+0003 stands between two dots, or two separators, where a repeated group must end.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+\x03-]))[A-Za-z0-9._%+\x03-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]*[A-Za-z0-9-]",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9\x20-]{12,}[0-9]",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What must not stand together in a match.
APART = {"email": r"(?<=\.)(?=\.)", "card": r"(?<=[\x20-])(?=[\x20-])"}
#: What a text must hold for a pattern to be tried.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9\x20-]{14}", "phone": r"\+[0-9]"}
#: Seeds of identifiers: long lower-case hexadecimal strings.
SEED = {"id": r"(?<![0-9A-Za-z])[0-9a-f]{32,128}+(?![0-9A-Za-z])"}
SEED_HINT = {"id": "[0-9a-f]{32}"}
#: Looser shapes of each kind, which count only in a telling context. An identifier may be anything that stands between
#: white space, quotes or brackets and holds a digit.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|@)\x20?[A-Za-z0-9-]{1,63}+\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z]{2,24}",
    "ip": r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}:[0-9A-Fa-f:]{2,34}[0-9A-Fa-f](?![0-9A-Fa-f:.])",
    "card": r"(?<![0-9])[0-9][0-9\x20-]{10,30}[0-9](?![0-9])",
    "phone": r"(?<![0-9+])[0-9(][0-9\x20().-]{5,22}[0-9](?![0-9])",
    "id": r"(?<![^\s\x22\x27\x60=,;()\[\]{}<>])[^\s\x22\x27\x60=,;()\[\]{}<>]{8,128}+(?![^\s\x22\x27\x60=,;()\[\]{}<>])",
}
LOOSE_HINT = {"id": r"[0-9]", "email": r"(?i)@|[(\[]at[)\]]", "ip": "[0-9A-Fa-f]:[0-9A-Fa-f:]{2}", "card": r"[0-9\x20-]{12}", "phone": r"[0-9\x20().-]{7}"}
SPAN = "array<struct<start: int, k: int, end: int, value: string>>"
#: Rounds of scoring; instances that a pattern needs; least score of a pattern and of a discovery.
ROUNDS, SUPPORT, PATTERN, ACCEPT = 3, 3, 0.5, 0.7
WORD = r"[^\p{L}\p{N}]+"


def clean(part: Column) -> Column:
    return F.translate(part, "\x02\x03", "")


def spans(parts: Column, kind: str) -> Column:
    """Spans in code points from a text that was cut in front of each match, with U+0002 behind the match."""
    start = F.struct(
        F.length(clean(F.element_at(parts, 1))).alias("at"), F.array().cast(SPAN).alias("out")
    )

    def add(seen, part):
        value = clean(F.substring_index(part, "\x02", 1))
        span = F.struct(
            seen["at"].alias("start"), F.lit(ALL.index(kind)).alias("k"), (seen["at"] + F.length(value)).alias("end"), value.alias("value")
        )
        return F.struct((seen["at"] + F.length(clean(part))).alias("at"), F.concat(seen["out"], F.array(span)).alias("out"))

    return F.when(
        F.size(parts) > 1, F.aggregate(F.slice(parts, 2, F.size(parts) - 1), start, add, lambda seen: seen["out"])
    ).otherwise(F.array().cast(SPAN))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    n = F.length(number)

    def term(i):
        d = F.substr(number, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), term), F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, span: Column) -> Column:
    value = span["value"]
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        small = lambda part: part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
        return F.forall(F.split(value, r"\."), small)
    number = digits(value)
    if kind == "card":
        return F.when(F.length(number).between(14, 19), luhn(number)).otherwise(F.lit(False))
    return F.length(number).between(10, 15)


def seed_valid(kind: str, span: Column) -> Column:
    return span["value"].rlike("[0-9]") & span["value"].rlike("[a-f]")


def loosely_valid(kind: str, span: Column) -> Column:
    if kind == "id":
        return span["value"].rlike("[0-9]")
    n = F.length(digits(span["value"]))
    return {"email": F.lit(True), "ip": span["value"].rlike(":.*:"), "card": n.between(12, 19), "phone": n.between(7, 15)}[kind]


def sought(rows: DataFrame, name: str, patterns: dict, hints: dict, check) -> DataFrame:
    """Adds the column `name`: the spans of all kinds by start, then kind. Each step is a projection of its own, so
    that no expensive expression is evaluated more than once."""
    for kind, pattern in patterns.items():
        text = F.col("plain")
        if kind in APART and patterns is BASE:
            text = F.regexp_replace(text, APART[kind], "\x03")
        marked = F.regexp_replace(text, pattern, "\x01$0\x02")
        rows = rows.withColumn(f"m_{kind}", F.when(F.col("plain").rlike(hints[kind]), F.split(marked, "\x01", -1)).otherwise(F.array(F.lit(""))))
    for kind in patterns:
        rows = rows.withColumn(f"s_{kind}", spans(F.col(f"m_{kind}"), kind))
    of = lambda kind: lambda s: check(kind, s)
    found = [F.filter(f"s_{kind}", of(kind)) for kind in patterns]
    rows = rows.withColumn(name, F.array_sort(F.concat(*found)))
    return rows.drop(*(f"{x}_{kind}" for kind in patterns for x in "ms"))


def in_context(span: Column) -> Column:
    """The span with the words on either side, in lower case."""
    before = F.greatest(span["start"] - 48, F.lit(0))
    left = F.substr(F.col("plain"), before + 1, span["start"] - before)
    right = F.substr(F.col("plain"), span["end"] + 1, F.lit(48))
    return F.struct(
        *(span[x].alias(x) for x in ("start", "k", "end", "value")),
        F.lower(F.regexp_extract(left, r"([\p{L}\p{N}]{1,40})[^\p{L}\p{N}]*$", 1)).alias("left"),
        F.lower(F.regexp_extract(right, r"^[^\p{L}\p{N}]*([\p{L}\p{N}]{1,40})", 1)).alias("right"),
    )


def extracted(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, t (a hash of the text), base spans, seeds of identifiers, and loose spans that don't overlap
    either."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("t"),
        F.translate(F.coalesce("text", F.lit("")), "\x01\x02\x03", "\x04\x04\x04").alias("plain"),
    )
    rows = sought(rows, "base", BASE, HINT, valid)
    rows = sought(rows, "seeds", SEED, SEED_HINT, seed_valid)
    rows = sought(rows, "loose", LOOSE, LOOSE_HINT, loosely_valid)
    apart = lambda s: ~F.exists(F.concat("base", "seeds"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    rows = rows.withColumn("loose", F.filter("loose", apart))
    return rows.select("doc_id", "t", *(F.transform(c, in_context).alias(c) for c in ("base", "seeds", "loose")))


def discovered(docs: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Spans (doc_id, t, start, k, end, value) that only their context tells, or None without any candidate.

    The base spans, and of identifiers the long hexadecimal strings, are seeds. A lexical pattern is a word to the left or right of a span of one kind. Its score is
    the sum of the scores of its accepted instances over the number of times that its word occurs at all, so that
    common words tell nothing; loose spans that aren't accepted speak neither for nor against it. An instance has
    score 1 as a seed, else that of its patterns together, and is accepted from ACCEPT on. Each round makes its
    patterns anew from seeds and discoveries, so that a discovery's other word can lead to further ones. All tables
    follow the number of spans, but for the counts of words, which are summed before they are shuffled.
    """
    one = lambda column, seed: found.select("doc_id", "t", F.explode(column).alias("s"), F.lit(seed).alias("seed"))
    instances = one(F.concat("base", "seeds"), 1.0).unionByName(one("loose", 0.0)).distinct()
    instances = instances.select("doc_id", "t", "s.*", "seed")
    if found.where(F.size("loose") > 0).isEmpty() or found.where(F.size("base") + F.size("seeds") > 0).isEmpty():
        return None
    sides = F.explode(
        F.array(F.struct(F.lit("L").alias("side"), F.col("left").alias("word")), F.struct(F.lit("R").alias("side"), F.col("right").alias("word")))
    )
    links = instances.withColumn("id", F.xxhash64("doc_id", "t", "start", "k", "end")).select("*", sides.alias("p"))
    links = links.select("doc_id", "t", "start", "k", "end", "value", "seed", "id", "p.side", "p.word").where("word <> ''")
    # A pattern of fewer different values can't get the support in any round.
    able = links.groupBy("k", "side", "word").agg(F.countDistinct("value").alias("n")).where(F.col("n") >= SUPPORT).drop("n")
    links = scratch.write(links.join(able, ["k", "side", "word"]))
    words = links.select("word").distinct()
    counts = docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), WORD)).alias("word")).groupBy("word").agg(F.count("*").alias("times"))
    links = scratch.write(links.join(counts.join(words, "word", "left_semi"), "word"))
    scores = links.where("seed > 0").select("id", F.col("seed").alias("score")).distinct()
    for _ in range(ROUNDS):
        # All patterns beside what is accepted by now: seeds, and what the round before discovered.
        known = links.join(scores.where(F.col("score") >= ACCEPT), "id", "left")
        patterns = known.groupBy("k", "side", "word").agg(
            F.sum("score").alias("sum"),
            (F.max("times") - F.sum(F.col("score").isNull().cast("long"))).alias("told"),
            F.countDistinct(F.when(F.col("score").isNotNull(), F.col("value"))).alias("support"),
        )
        patterns = patterns.where(F.col("support") >= SUPPORT).select(
            "k", "side", "word", F.least(F.col("sum") / F.greatest("told", "sum"), F.lit(0.99)).alias("pattern")
        ).where(F.col("pattern") >= PATTERN)
        scores = links.join(patterns, ["k", "side", "word"], "left").groupBy("id").agg(
            F.greatest(F.max("seed"), 1 - F.exp(F.sum(F.log(1 - F.coalesce("pattern", F.lit(0.0)))))).alias("score")
        )
        scores = scratch.write(scores)
    new = links.where("seed = 0").join(scores.where(F.col("score") >= ACCEPT), "id")
    new = scratch.write(new.select("doc_id", "t", "start", "k", "end", "value").distinct())
    scratch.clear(found, new)
    return new


def written_spans(column: str) -> Column:
    names = F.array(*map(F.lit, ALL))
    each = lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(column, each), ",")


def private_spans(docs: DataFrame) -> DataFrame:
    """doc_id, t, base and spans (base, seeds and discovered, by start, then kind) of every row of docs."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.write(extracted(docs))
    plain = lambda column: F.transform(column, lambda s: F.struct(*(s[x].alias(x) for x in ("start", "k", "end", "value"))))
    rows = found.select("doc_id", "t", plain("base").alias("base"), plain("seeds").alias("seeds"))
    new = discovered(docs, found, scratch)
    if new is None:
        return rows.select("doc_id", "t", "base", F.array_sort(F.concat("base", "seeds")).alias("spans"))
    new = new.groupBy(F.col("doc_id").alias("d"), F.col("t").alias("u")).agg(
        F.collect_set(F.struct("start", "k", "end", "value")).alias("new")
    )
    rows = rows.join(new, rows["doc_id"].eqNullSafe(new["d"]) & (rows["t"] == new["u"]), "left")
    every = F.array_sort(F.concat("base", "seeds", F.coalesce("new", F.array().cast(SPAN))))
    return rows.select("doc_id", "t", "base", every.alias("spans"))


def private(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 (of the base
    spans as kind:start:end, by start, then kind, comma-joined; in code points), spans (all, joined likewise) and n_spans.
    Of the kind id, identifiers of any shape, all spans come from bootstrapping.

    Base spans are the leftmost matches of each kind's pattern that don't overlap, less those that fail its check.
    Bootstrapping adds spans and removes none; see discovered(). A null text is empty. Repeated rows have equal
    results, as have rows with the same doc_id and text; an empty table gives an empty table; other columns are not
    read. U+0001 to U+0003 in a text are read as U+0004, which no pattern holds either.
    """
    rows = private_spans(docs)
    number = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    return rows.select(
        "doc_id",
        *(number(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
        F.sha2(written_spans("base").cast("binary"), 256).alias("base_sha256"),
        written_spans("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with all their columns, whatever their names, and in place of each span of personal data its kind, as in
    [EMAIL]."""
    rows = private_spans(docs).select(F.col("doc_id").alias("d"), "t", "spans").where(F.size("spans") > 0).dropDuplicates(["d", "t"])
    names = F.array(*(F.lit(f"[{kind.upper()}]") for kind in ALL))
    start, whole = F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), F.col("row")["text"]

    def cover(seen, s):
        text = F.concat(seen["out"], F.substr(whole, seen["at"] + 1, s["start"] - seen["at"]), F.element_at(names, s["k"] + 1))
        # A span that begins inside the one before is part of it.
        return F.when(s["start"] >= seen["at"], F.struct(s["end"].alias("at"), text.alias("out"))).otherwise(
            F.struct(F.greatest(s["end"], seen["at"]).alias("at"), seen["out"].alias("out"))
        )

    rest = lambda seen: F.concat(seen["out"], F.substr(whole, seen["at"] + 1, F.length(whole)))
    own = docs.select(F.expr("struct(*)").alias("row"))
    key = F.xxhash64(whole) == rows["t"]
    joined = own.join(rows, F.col("row")["doc_id"].cast("long").eqNullSafe(rows["d"]) & key, "left")
    text = F.when(F.col("spans").isNull(), whole).otherwise(F.aggregate("spans", start, cover, rest))
    return joined.select(*((text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns))
