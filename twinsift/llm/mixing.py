"""Mixing sources to target weights by Pareto order sampling (Rosén, 1997).

1. Targets. Sources in order of code point, null last, have the repeating
   weights of ``WEIGHTS`` and share ``SHARE`` of all words. A target above
   ``MAX_REPEAT`` times its source's size stops there and the excess is dealt
   again by weight until none is above. This table has a row for each source.
2. Whole copies. Every document of a source gets the whole number of copies
   below target / size for certain.
3. The rest is sampled. A document's inclusion probability grows with the
   square root of its size, capped at one; the cap is found exactly from the
   histogram of (source, size). Documents rank by random odds divided by
   inclusion odds, where the random number is a hash of the id, and the
   sample ends at the rank whose words come nearest the rest of the target.

The rank is never a sort of a whole source: words are summed for each of
``BINS`` intervals of the ranking variable, twice over, and only documents of
the last interval, one in ``BINS`` squared, are numbered.

Defined results: a document without words, of null text for one, is never
taken; null sources are one source; equal ids draw the same number, and rows
equal in id and text are interchangeable; an empty table gives an empty
result.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsift.llm.common import documents, n_words, text_key
from twinsift.plans.workspace import materialize

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MAX_REPEAT = 2
SIZE_POWER = 0.5
SEED = 17
BINS = 1024


def fill_targets(sizes: list[int], weights: list[int], total: Fraction, most: list[Fraction]) -> list[Fraction]:
    """Share ``total`` by weight; what exceeds a source's most is dealt again."""
    out, open_ = [Fraction(0)] * len(sizes), set(range(len(sizes)))
    left = total
    while open_ and left > 0:
        scale = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if scale * weights[i] > most[i]}
        for i in over or open_:
            out[i] = most[i] if i in over else scale * weights[i]
            left -= out[i]
        open_ -= over or open_
    return out


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, rest) from (source, size, ...) rows.

    The sums of the sources, one row each, are put in order on the driver.
    """
    spark = sizes.sparkSession
    rows = sizes.groupBy("source").agg(F.sum("size").alias("n")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    ns = [r["n"] for r in rows]
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))]
    wanted = fill_targets(ns, weights, SHARE * sum(ns), [Fraction(MAX_REPEAT * n) for n in ns])
    data = [(r["source"], n, float(t), int(t // n) if n else 0, float(t - (t // n) * n) if n else 0.0) for r, n, t in zip(rows, ns, wanted, strict=True)]
    schema = f"source {sizes.schema['source'].dataType.simpleString()}, source_size long, target double, copies int, rest double"
    return spark.createDataFrame(data, schema)


def _fetched(few: DataFrame) -> DataFrame:
    """The same rows without their plan, by way of the driver; for tables of a row for each source, as :func:`targets` holds.

    The figures of one step are in each column of the next, and a plan that carries them all is planned and compiled in many copies.
    """
    return few.sparkSession.createDataFrame(few.collect(), few.schema)


def _inclusion_scale(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, scale): a document's probability is scale * size ** SIZE_POWER, at most 1.

    In order of falling size, a size is certain if, with all larger ones
    certain, its own probability would exceed one.
    """
    kinds = sizes.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    g = F.pow(F.col("size").cast("double"), F.lit(SIZE_POWER))
    rows = kinds.join(F.broadcast(goals.select(F.col("source").alias("s"), "rest")), F.expr("source <=> s")).filter("rest > 0")
    larger = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(0, Window.unboundedFollowing)
    before = F.coalesce(F.sum(F.col("size") * F.col("n")).over(larger), F.lit(0))
    scale = (F.col("rest") - before) / F.sum(F.col("size") * F.col("n") * g).over(onward)
    tried = rows.select("source", "size", scale.alias("scale"), (scale * g).alias("p"))
    # the first size whose probability is below one sets the scale of all that are not certain
    return tried.filter("p < 1").groupBy("source").agg(F.max_by("scale", "size").alias("scale"))


def _interval(q: Column, level: int) -> Column:
    """Interval of the ranking variable, whose odds are mapped into 0 to 1."""
    share = q / (q + 1)
    return F.least(F.floor(share * BINS**level), F.lit(BINS**level - 1)).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """Copies of every document: doc_id, key, source, size, its source's figures, copies, taken."""
    sized = materialize(docs.select("doc_id", text_key(F.col("text")).alias("key"), "source", n_words(F.col("text")).alias("size")), "sizes")
    goals = targets(sized)
    scales = _fetched(_inclusion_scale(sized, goals).select(F.col("source").alias("s2"), "scale"))
    figures = goals.join(scales, F.expr("source <=> s2"), "left").drop("s2").withColumnRenamed("source", "s")
    # a row for each source: the driver has just held this table, so it is safe to broadcast
    rows = sized.join(F.broadcast(figures), F.expr("source <=> s")).drop("s")
    u = (F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    p = F.least(F.lit(1.0), F.coalesce(F.col("scale"), F.lit(1.0)) * F.pow(F.col("size").cast("double"), F.lit(SIZE_POWER)))
    odds = F.when(p >= 1, 0.0).otherwise((u / (1 - u)) / (p / (1 - p)))
    rows = rows.withColumn("q", F.when((F.col("rest") > 0) & (F.col("size") > 0), odds))
    drawn = rows.filter("q IS NOT NULL").withColumn("b1", _interval(F.col("q"), 1)).withColumn("b2", _interval(F.col("q"), 2))

    def cut(frame: DataFrame, by: str, start: Column) -> DataFrame:
        """The interval in which the rest of the target ends, and the words before it."""
        sums = frame.groupBy("source", by).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"), F.first(start).alias("start"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy(by)) + F.col("start")
        over = sums.withColumn("upto", upto).filter("upto > rest")
        return over.groupBy(F.col("source").alias("s")).agg(F.min(by).alias(f"cut_{by}"), F.min(F.col("upto") - F.col("n")).alias(f"had_{by}"))

    join = lambda f, c: f.join(F.broadcast(c), F.expr("source <=> s"), "left").drop("s")  # noqa: E731  a row for each source
    first = _fetched(cut(drawn, "b1", F.lit(0)))
    drawn = join(drawn, first)
    second = _fetched(cut(drawn.filter("b1 = cut_b1"), "b2", F.col("had_b1")))
    drawn = join(drawn, second)
    order = Window.partitionBy("source").orderBy("q", "doc_id", "key")
    last = drawn.filter("b1 = cut_b1 AND b2 = cut_b2").withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("had_b2"))
    ends = last.withColumn("more", (F.col("upto") - F.col("size") / 2 <= F.col("rest")).cast("int"))
    whole = drawn.filter("cut_b1 IS NULL OR b1 < cut_b1 OR (b1 = cut_b1 AND (cut_b2 IS NULL OR b2 < cut_b2))").withColumn("more", F.lit(1))
    rest = rows.filter("q IS NULL").withColumn("more", F.lit(0))
    keep = ["doc_id", "key", "source", "size", "source_size", "target", (F.col("copies") + F.col("more")).alias("copies")]
    out = whole.select(*keep).union(drawn.filter("b1 > cut_b1 OR (b1 = cut_b1 AND b2 > cut_b2)").withColumn("more", F.lit(0)).select(*keep))
    out = out.union(ends.select(*keep)).union(rest.select(*keep))
    copies = F.when(F.col("size") > 0, F.col("copies")).otherwise(0).cast("int")
    return out.withColumn("copies", copies).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, as often as they are taken.

    Rows equal in id, text and source share their copies evenly. What is left
    over, in the one group at a source's cut, goes to the first of its rows.
    """
    chosen = mix(docs).filter("copies > 0").groupBy("doc_id", "key", "source").agg(F.sum("copies").alias("n"), F.count("*").alias("rows"))
    c = chosen.select(F.col("doc_id").alias("_mix_id"), F.col("key").alias("_mix_key"), F.col("source").alias("_mix_source"), F.expr("n div rows").cast("int").alias("_mix_n"), F.expr("n % rows").cast("int").alias("_mix_more"))
    equal = docs["doc_id"].eqNullSafe(c["_mix_id"]) & (text_key(docs["text"]) == c["_mix_key"]) & docs["source"].eqNullSafe(c["_mix_source"])
    joined = docs.join(c, equal)
    place = F.row_number().over(Window.partitionBy("_mix_id", "_mix_key", "_mix_source").orderBy(F.lit(1)))
    even = joined.filter("_mix_more = 0")
    rest = joined.filter("_mix_more > 0").withColumn("_mix_n", F.col("_mix_n") + (place <= F.col("_mix_more")).cast("int"))
    copies = F.explode(F.when(F.col("_mix_n") > 0, F.sequence(F.lit(1), F.col("_mix_n"))).otherwise(F.array().cast("array<int>")))
    return even.union(rest).withColumn("_mix_n", copies).drop("_mix_id", "_mix_key", "_mix_source", "_mix_n", "_mix_more")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
