"""Quality rules with thresholds that adapt to each language and source.

Signals are computed with array functions inside the row. Every signal is
counted in a sketch for each (lang, source): a histogram whose integer bins
widen with the value, 1/32 of it at most. Sketches merge by adding counts, so
partial aggregation ships bins instead of rows, the result does not depend on
the order of merging, and a quantile is exact to the width of its bin.

A threshold comes from the group's sketch alone: the upper quartile plus ``SPREAD``
times its distance from the median. Where these are equal, as for a signal that is
zero in most documents, it is Tukey's fence of the documents in which the signal is
not zero: their upper quartile plus one and a half times the distance of their
quartiles. No threshold is below the ninth decile. A group of under ``MIN_GROUP``
documents takes the merged sketch of its language, and a small language that of all
documents.

Defined results: a null text has no words and fails the base rules; a null lang
or source is a group of its own; repeated rows count as often as they occur; an
empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsift.llm.common import SPACE, documents, let, words
from twinsift.plans.workspace import materialize

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 30
#: Signals per thousand words.
SIGNALS = ("mean_chars", "symbols", "dup_lines", "repeats")
SPREAD = 6
MIN_GROUP = 50
#: Quantiles of all documents of a group, and of those in which the signal is not zero.
QUANTILES, PART_QUANTILES = (50, 75, 90), (25, 75)


def repeat_words(parts: Column, window: int = WINDOW) -> Column:
    """Words inside windows that are found twice or more, the first included."""

    def covered(keys: Column) -> Column:
        order = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a)["k"] == F.get(s, b)["k"], F.lit(False))
            hit = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
            starts = F.array_sort(F.transform(hit, lambda i: F.get(s, i)["i"]))
            zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            step = lambda a, p: F.struct((p + window).alias("end"), (a["n"] + F.least(F.lit(window), p + window - a["end"])).alias("n"))
            return F.aggregate(starts, zero, step, lambda a: a["n"])

        return let(order, twice)

    def of(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        at = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
        counted = lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), 0).otherwise(covered(k))
        return F.when(F.size(w) < window, 0).otherwise(let(let(hashes, at), counted))

    return of(parts).cast("long")


def signals(docs: DataFrame) -> DataFrame:
    """One narrow row for each document: its counts and its rates."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    counts = docs.select(
        "doc_id", "lang", "source",
        let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "lang", "source", "w.*", "word_chars", "n_symbols", "n_dup_lines")
    rate = lambda c: F.when(F.col("n_words") > 0, F.floor(F.col(c) * 1000 / F.col("n_words")).cast("long")).otherwise(0)
    return counts.withColumn(
        "rates",
        F.struct(rate("word_chars").alias("mean_chars"), rate("n_symbols").alias("symbols"), rate("n_dup_lines").alias("dup_lines"), rate("n_repeat_words").alias("repeats")),
    )


def bin_of(v: Column) -> Column:
    """Bin of a count: exact below 64, then 32 bins for each doubling."""
    shift = F.length(F.bin(v)) - 6
    return F.when(v < 64, v).otherwise(F.shiftleft(shift.cast("long"), 32) + F.call_function("shiftright", v, shift.cast("int"))).cast("long")


def bin_top(b: Column) -> Column:
    """Largest count in a bin."""
    shift = F.call_function("shiftright", b, F.lit(32)).cast("int")
    low = F.call_function("shiftleft", b.bitwiseAND(0xFFFFFFFF), shift)
    return F.when(b < 64, b).otherwise(low + F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1)


def sketches(rows: DataFrame) -> DataFrame:
    """Counts of (lang, source, signal, bin); they merge by addition."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), bin_of(F.col(f"rates.{s}")).alias("bin")) for s in SIGNALS]))
    return rows.select("lang", "source", each.alias("e")).groupBy("lang", "source", "e.signal", "e.bin").agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    group = Window.partitionBy(*by, "signal")
    merged = sketch.groupBy(*by, "signal", "bin").agg(F.sum("n").alias("n"))
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))
    ranked = ranked.withColumn("zero", F.sum(F.when(F.col("bin") == 0, F.col("n")).otherwise(0)).over(group))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, bin_top(F.col("bin"))))
    part = lambda q: F.min(F.when((F.col("bin") > 0) & ((F.col("upto") - F.col("zero")) * 100 >= (F.col("total") - F.col("zero")) * q), bin_top(F.col("bin"))))
    return ranked.groupBy(*by, "signal").agg(F.max("total").alias("total"), *[at(q).alias(f"q{q}") for q in QUANTILES], *[F.coalesce(part(q), F.lit(0)).alias(f"p{q}") for q in PART_QUANTILES])


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row for each (lang, source): the upper limit of every signal."""
    own, lang, everything = _quantiles(sketch, ["lang", "source"]), _quantiles(sketch, ["lang"]), _quantiles(sketch, [])
    o, l, a = own.alias("o"), lang.alias("l"), everything.alias("a")
    joined = o.join(l, F.expr("o.lang <=> l.lang AND o.signal = l.signal")).join(a, F.expr("o.signal = a.signal"))
    pick = lambda c: F.when(F.col("o.total") >= MIN_GROUP, F.col(f"o.{c}")).when(F.col("l.total") >= MIN_GROUP, F.col(f"l.{c}")).otherwise(F.col(f"a.{c}"))
    rows = joined.select("o.lang", "o.source", "o.signal", *[pick(f"q{q}").alias(f"q{q}") for q in QUANTILES], *[pick(f"p{q}").alias(f"p{q}") for q in PART_QUANTILES])
    fence = F.when(F.col("q75") > F.col("q50"), F.col("q75") + SPREAD * (F.col("q75") - F.col("q50"))).otherwise(F.col("p75") + F.floor((F.col("p75") - F.col("p25")) * 3 / 2))
    rows = rows.withColumn("top", F.greatest("q90", fence).cast("long"))
    return rows.groupBy("lang", "source").agg(*[F.max(F.when(F.col("signal") == s, F.col("top"))).alias(f"max_{s}") for s in SIGNALS])


def quality_rules(docs: DataFrame) -> DataFrame:
    """Judge every document by the base rules and by its group's thresholds.

    The table of thresholds has a row for each (lang, source) and is joined
    without a hint: it is broadcast only if Spark finds it small at run time.
    """
    rows = materialize(signals(docs), "signals")
    limits = thresholds(sketches(rows))
    r, t = rows.alias("r"), limits.alias("t")
    judged = r.join(t, F.expr("r.lang <=> t.lang AND r.source <=> t.source"), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    within = reduce(lambda x, y: x & y, [F.col(f"rates.{s}") <= F.coalesce(F.col(f"max_{s}"), F.lit(0)) for s in SIGNALS])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & within).alias("kept"), *[F.col(f"max_{s}") for s in SIGNALS],
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))
