"""Line dedup by a deletion-neighbourhood join.

Lines are what line breaks separate.  Their edit distance counts units
inserted, deleted or replaced: words (what single spaces separate) in lines of
``min_words`` or more, characters in shorter lines of ``min_chars`` or more.
A line is removed if an earlier one, in the order of (doc_id, line number), is
equal to it, or has the same kind of units and lies within one edit.  The
earliest stays.  Shorter lines, where one character is much of the content
("Page 1", "Page 2"), must be equal; lines of white space alone are never
removed.

Every distinct line emits its deletion neighbourhood as hashed keys: itself
and itself without any one unit.  Lines of equal length that differ in one
unit share the variant without it, at the same place; a line and the same with
one unit more share the shorter one.  Before that, a line is dropped if no
other line has its first or its second half (one edit leaves one of them as it
was), which spares most lines the variants.  Witnesses are verified unit by
unit.

Only DataFrame functions.  No step gathers a group: keys are pre-aggregated
to their two extreme members and their earliest lines, so that work is linear
in a group's size, every join is an equi-join on hashes or ids, and lines with
very many copies are salted.

Null and empty texts have one empty line and stay as they are.  A null doc_id
comes first.  Rows that share doc_id and text are one document: equal lines at
equal places count once, and each row loses what is found.  Rows that share a
doc_id but not the text are documents of their own, in the order of a hash of
their texts.  An empty table gives an empty result; other columns, whatever
their names, are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_WORDS = 8
MIN_CHARS = 16


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, also where ``use`` has lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _parts() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n")


def line_rows(docs: DataFrame) -> DataFrame:
    """did, line_no and line of all lines that are not blank; docs has did and text."""
    rows = docs.select("did", F.posexplode(_parts()).alias("line_no", "line"))
    return rows.where(F.trim(F.col("line"), F.lit(" \t\r\x0b\x0c")) != "")


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("a", F.xxhash64("line")).withColumn("b", F.xxhash64(F.lit(1), "line"))


def _units(min_words: int) -> Column:
    words = F.split("line", " ", -1)
    return once(words, lambda w: F.when(F.size(w) >= min_words, w).otherwise(F.split("line", "")))


def distinct_lines(docs: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """a, b (128 bits of hash), first (did, line_no), copies, n units, whether these are words, and the hashes of its halves."""
    rows = _hashed(line_rows(docs)).withColumn("w", F.split("line", " ", -1)).withColumn("words", F.size("w") >= min_words)
    rows = rows.withColumn("fuzzy", F.col("words") | (F.char_length("line") >= min_chars))
    rows = rows.withColumn("w", F.when(F.col("words"), F.col("w")).when(F.col("fuzzy"), F.split("line", ""))).withColumn("n", F.size("w"))
    half, less = F.expr("n div 2").cast("int"), F.expr("(n - 1) div 2").cast("int")

    def head(c: Column) -> Column:
        return F.xxhash64(F.lit("head"), "words", F.slice("w", F.lit(1), c))

    def tail(c: Column) -> Column:
        return F.xxhash64(F.lit("tail"), "words", F.slice("w", F.col("n") - c + 1, c))

    rows = rows.select(
        "a", "b", "did", "line_no", "n", "words",
        *[F.when(F.col("fuzzy"), x).alias(k) for k, x in (("h1", head(half)), ("h2", head(less)), ("t1", tail(F.col("n") - half)), ("t2", tail(F.col("n") - 1 - less)))],
    )
    return rows.groupBy("a", "b").agg(
        F.min(F.struct("did", "line_no")).alias("first"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("words").alias("words"),
        *[F.max(k).alias(k) for k in ("h1", "h2", "t1", "t2")],
    )


def with_company(keyed: DataFrame, key: str) -> DataFrame:
    """The rows whose key belongs to more than one line ``a``."""
    shared = keyed.groupBy(key).agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo <> hi").select(key)
    return keyed.join(shared, key)


def candidates(lines: DataFrame, docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(survivors with their units, pairs a, other, i of lines and an earlier witness that share a variant), both written."""
    halves = lines.where("h1 is not null").select("a", F.explode(F.array_distinct(F.array("h1", "h2", "t1", "t2"))).alias("key"))
    near = with_company(halves, "key").select("a").distinct()
    survivors = common.materialize(lines.join(near, "a").select("a", "b", "n", "words", "first.did", "first.line_no"))
    wanted = survivors.groupBy("did").agg(F.collect_list("line_no").alias("nos"))
    texts = docs.join(wanted.hint("merge"), "did").select(
        "did",
        F.explode(once(_parts(), lambda p: F.transform("nos", lambda i: F.struct(i.alias("line_no"), F.get(p, i).alias("line"))))).alias("x"),
    )
    texts = _hashed(texts.select("did", "x.line_no", "x.line").where("x.line is not null"))
    parts = common.partitions_for(docs.sparkSession, 0)
    # a document that occurs in several rows gives its lines more than once
    found = texts.join(survivors, ["a", "b", "did", "line_no"]).dropDuplicates(["a"])
    found = common.materialize(found.select("a", "b", "did", "line_no", "n", "words", _units(min_words).alias("w")).repartition(parts, "a"))
    # units by place; x is the unit's hash at its place, y one place to the left
    words = found.repartition(parts, "a").select("a", "n", "words", F.posexplode("w").alias("i", "unit"))
    words = words.select("a", "n", "words", "i", F.xxhash64("unit", "i").alias("x"), F.xxhash64("unit", F.col("i") - 1).alias("y"))
    run = Window.partitionBy("a").orderBy("i")
    upto, all_ = run.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("a").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    words = words.select(
        "a", "n", "words", "i",
        F.bit_xor("x").over(upto).bitwiseXOR(F.col("x")).bitwiseXOR(F.bit_xor("y").over(upto)).bitwiseXOR(F.bit_xor("y").over(all_)).alias("v"),
        F.bit_xor("x").over(all_).alias("self"),
    )
    less = words.select("a", "i", F.xxhash64("words", F.col("n") - 1, "v").alias("key"))
    own = words.where("i = 0").select("a", F.lit(-1).alias("i"), F.xxhash64("words", "n", "self").alias("key"))
    shared = common.materialize(with_company(less.union(own), "key"))
    placed = shared.join(found.select("a", F.struct("did", "line_no", "a").alias("at")), "a")
    low = placed.groupBy("key", "i").agg(F.min("at").alias("low"))
    replaced = placed.where("i >= 0").join(low, ["key", "i"]).where("at > low").select("a", F.col("low.a").alias("other"), "i")
    whole = low.where("i < 0").select("key", F.col("low").alias("low_self"))
    longer = low.where("i >= 0").groupBy("key").agg(F.min(F.struct("low", "i")).alias("lo"))
    inserted = placed.where("i >= 0").join(whole, "key").where("at > low_self").select("a", F.col("low_self.a").alias("other"), "i")
    deleted = placed.where("i < 0").join(longer, "key").where("at > lo.low").select("a", F.col("lo.low.a").alias("other"), F.col("lo.i").alias("i"))
    pairs = common.materialize(replaced.union(inserted).union(deleted).dropDuplicates(["a", "other", "i"]))
    common.discard(survivors, shared)
    return found, pairs


def verified(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """a and b of the lines whose witness is within one edit, unit by unit."""
    left = found.select("a", "b", "words", "w")
    right = found.select(F.col("a").alias("other"), F.col("words").alias("same"), F.col("w").alias("v"))
    both = pairs.join(left, "a").join(right, "other").where("words = same")
    differ = F.size(F.filter(F.zip_with("w", "v", lambda x, y: ~x.eqNullSafe(y)), lambda d: d))

    def without(words: str) -> Column:
        return F.concat(F.slice(words, F.lit(1), F.col("i")), F.slice(words, F.col("i") + 2, F.size(words)))

    near = (
        F.when(F.size("w") == F.size("v"), differ <= 1)
        .when(F.size("w") == F.size("v") + 1, without("w") == F.col("v"))
        .when(F.size("w") + 1 == F.size("v"), without("v") == F.col("w"))
        .otherwise(False)
    )
    return both.where(near).select("a", "b").distinct()


def _rewritten(docs: DataFrame, min_words: int, min_chars: int, length_column: str | None) -> DataFrame:
    """row (the columns of ``docs`` with the kept text), n_lines and n_removed."""
    # what the input calls its columns is kept apart, so that no name clashes
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    whole = common.identified(whole).select(F.struct("id", "ta", "tb").alias("did"), "text", "row")
    texts = whole.select("did", "text")
    lines = common.materialize(distinct_lines(texts, min_words, min_chars))
    found, pairs = candidates(lines, texts, min_words)
    near = common.materialize(verified(found, pairs).withColumn("near", F.lit(True)))
    common.discard(found, pairs)
    hit = lines.select("a", "b", "first", "copies").join(near, ["a", "b"], "left").where("copies > 1 or near")
    hit = hit.select("a", "b", "copies", F.coalesce("near", F.lit(False)).alias("near"), F.col("first.did").alias("f_did"), F.col("first.line_no").alias("f_no"))
    hit = common.materialize(hit)
    total = hit.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    every = _hashed(line_rows(texts)).select("did", "line_no", "a", "b")
    gone = common.met(every, hit, ["a", "b"], total, "copies").where("near or did <> f_did or line_no <> f_no").select("did", "line_no")
    gone = common.materialize(gone.groupBy("did").agg(F.collect_set("line_no").alias("gone")))
    common.discard(lines, near, hit)
    rows = whole.join(gone.hint("merge"), "did", "left")
    kept = once(_parts(), lambda p: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.coalesce("gone", F.array().cast("array<int>"))), lambda i: F.get(p, i)), "\n"))
    rows = rows.select(
        "row", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), F.size(_parts()).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )

    def value(c: str) -> Column:
        if c == "text":
            return F.col("text")
        old = F.col(f"row.`{c}`")
        if c == length_column:
            return F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(old)
        return old

    return rows.select(F.struct(*[value(c).alias(c) for c in docs.columns]).alias("row"), "n_lines", "n_removed")


def rewritten(docs: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, length_column: str | None = None) -> DataFrame:
    """The columns of ``docs``, with the text of the kept lines; ``length_column``, if given, gets its new length."""
    return _rewritten(docs, min_words, min_chars, length_column).select("row.*")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, length_column: str | None = None) -> DataFrame:
    """As :func:`rewritten`, with n_lines and n_removed behind, which replace columns of those names."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return _rewritten(docs, min_words, min_chars, length_column).select(*[F.col(f"row.`{c}`") for c in own], "n_lines", "n_removed")
