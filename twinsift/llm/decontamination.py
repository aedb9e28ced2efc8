"""Benchmark decontamination by a distributed positional inverted index.

1. Each test window (10 words, or a whole shorter item) is a phrase. The
   corpus frequency of every test term is counted, and a phrase is looked up
   by its two rarest terms only.
2. The index holds the postings (term, document, position) of those terms,
   each with the document's words around it as payload, written to the shared
   folder. A fixed-size bitmap of the terms filters words before rows are made
   of them, so frequent words that no phrase is looked up by cost no posting.
3. Lists are shifted by the term's offset in the phrase and intersected on
   (phrase, document, start), rarest first. What is left is compared with the
   payload, which gives exact matches. A proximity match has the phrase's
   rarest term and at least ``NEAR`` of its distinct terms within one window
   length to either side.

All steps are DataFrame operations. Terms, phrases and items are joined without
hints: Spark broadcasts them only if they prove small at run time.

Defined results: a null text has no words; a null item_id is an item whose
windows count as hits but which adds no id to the list; equal items with equal
ids count once; repeated documents have repeated results; with an empty
benchmark nothing is hit; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm.common import documents, let, lower_ascii, text_key
from twinsift.plans.workspace import materialize

WINDOW = 10
NEAR = 0.8
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Bits of the term filter, in words of 32; its size does not grow with the data.
FILTER_BITS = 1 << 17


def test_words(text: Column) -> Column:
    """Lower-cased words of letters, digits and characters beyond ASCII."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAKS), lambda w: w != "")


def phrases(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(phrase, words) once each, and (phrase, item_id) for every item that has it."""

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - window + 1))
        return F.when(F.size(w) == 0, F.array().cast("array<array<string>>")).otherwise(F.transform(starts, lambda i: F.slice(w, i, window)))

    each = benchmark.select("item_id", F.explode(let(test_words(F.col("text")), cut)).alias("words"))
    each = each.withColumn("phrase", F.array_join("words", " "))
    return each.select("phrase", "words").dropDuplicates(["phrase"]), each.select("phrase", "item_id").distinct()


def term_filter(terms: DataFrame) -> Column:
    """The bitmap of the terms' hashes as one literal of 32-bit words: FILTER_BITS bits, whatever the terms."""
    bit = F.pmod(F.xxhash64("term"), F.lit(FILTER_BITS))
    words = terms.select(F.floor(bit / 32).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 32).cast("int")).alias("bit"))
    out = [0] * (FILTER_BITS // 32)
    for row in words.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():
        out[row["at"]] = row["bits"]
    return F.expr(f"cast(split('{','.join(map(str, out))}', ',') as array<bigint>)")  # folded by the optimizer


def _in_filter(bits: Column, word: Column) -> Column:
    h = F.pmod(F.xxhash64(word), F.lit(FILTER_BITS))
    at = F.get(bits, F.floor(h / 32).cast("int"))
    return F.call_function("shiftright", at, (h % 32).cast("int")).bitwiseAND(1) == 1


def rarest(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(phrase, words, lead, second): offsets of the two rarest words of each phrase."""
    terms = found.select(F.explode("words").alias("term")).distinct()
    bits = term_filter(terms)
    tokens = docs.select(F.explode(F.filter(test_words(F.col("text")), lambda w: _in_filter(bits, w))).alias("term"))
    # counted before the join, so that a frequent term is a row for each task
    counts = tokens.groupBy("term").agg(F.count("*").alias("df")).join(terms, "term", "left_semi")
    each = found.select("phrase", F.posexplode("words").alias("at", "term"))
    ranked = each.join(counts, "term", "left").groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "at", "term"))).alias("r"))
    second = F.get(F.filter("r", lambda x: x["term"] != F.get("r", F.lit(0))["term"]), F.lit(0))
    return ranked.select("phrase", F.get("r", F.lit(0)).alias("lead"), second.alias("second")).join(found, "phrase")


def build_index(docs: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """Postings (term, doc_id, key, pos, left, around) of the given terms, written to the shared folder.

    ``around`` holds up to ``window`` - 1 words to either side of the posting
    and ``left`` says how many stand before it.
    """
    bits = term_filter(terms)
    side = window - 1

    def hits(w: Column, filter_: Column) -> Column:
        at = F.filter(F.transform(w, lambda x, i: F.when(_in_filter(filter_, x), i)), lambda i: i.isNotNull())
        left = lambda i: F.least(i, F.lit(side))
        return F.transform(at, lambda i: F.struct(F.get(w, i).alias("term"), i.alias("pos"), left(i).alias("left"), F.slice(w, i - left(i) + 1, left(i) + 1 + side).alias("around")))

    found = F.explode(let(test_words(F.col("text")), lambda w: hits(w, bits))).alias("p")
    postings = docs.select("doc_id", text_key(F.col("text")).alias("key"), found).select("doc_id", "key", "p.*")
    return materialize(postings.join(terms, "term", "left_semi"), "postings", free=True)


def search(index: DataFrame, looked_up: DataFrame, window: int = WINDOW) -> DataFrame:
    """(phrase, doc_id, key, start, length, exact): exact matches and proximity matches."""
    p = looked_up.select("phrase", "words", "lead", "second")
    lead = p.select("phrase", "words", "second", F.col("lead.term").alias("term"), F.col("lead.at").alias("at")).join(index, "term")
    lead = lead.withColumn("start", F.col("pos") - F.col("at"))
    second = p.filter("second IS NOT NULL").select("phrase", F.col("second.term").alias("term"), F.col("second.at").alias("at")).join(index, "term")
    second = second.select("phrase", "doc_id", "key", (F.col("pos") - F.col("at")).alias("start"))
    second = second.distinct()  # repeated documents have repeated postings
    both = lead.filter("second IS NOT NULL").alias("x").join(second.alias("y"), F.expr("x.phrase = y.phrase AND x.doc_id <=> y.doc_id AND x.key = y.key AND x.start = y.start")).select("x.*")
    n = F.size("words")
    here = F.slice("around", F.greatest(F.col("left") - F.col("at") + 1, F.lit(1)), n)
    exact = both.union(lead.filter("second IS NULL")).filter((F.col("start") >= 0) & (F.col("left") >= F.col("at")) & (here == F.col("words")))
    terms = F.array_distinct("words")
    near = lead.filter(F.size(F.array_intersect(terms, F.col("around"))) >= NEAR * F.size(terms))
    cols = ["phrase", "doc_id", "key", "start", n.alias("length")]
    return exact.select(*cols, F.lit(True).alias("exact")).union(near.select(*cols, F.lit(False).alias("exact")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each document: doc_id, key, n_words, n_hit, n_items, items_sha256, n_near, contaminated."""
    rows = docs.select("doc_id", "text")
    found, of_item = phrases(benchmark.select("item_id", "text"), window)
    found, of_item = materialize(found, "phrases"), materialize(of_item, "items")
    looked_up = materialize(rarest(rows, found), "rarest")
    terms = looked_up.select(F.col("lead.term").alias("term")).union(looked_up.filter("second IS NOT NULL").select("second.term")).distinct()
    matches = materialize(search(build_index(rows, terms, window), looked_up, window).distinct(), "matches", free=True)
    exact = matches.filter("exact")
    doc = ["doc_id", "key"]
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(a: Column, s: Column) -> Column:
        end = F.greatest(a["end"], s["start"] + s["length"])
        return F.struct(end.alias("end"), (a["n"] + end - F.greatest(a["end"], s["start"])).alias("n"))

    covered = F.aggregate(F.array_sort(F.collect_set(F.struct("start", "length"))), zero, step, lambda a: a["n"])
    words = exact.select(*doc, "start", "length").distinct().groupBy(*doc).agg(covered.cast("long").alias("n_hit"))
    listed = exact.join(of_item, "phrase").select(*doc, F.col("item_id").cast("string").alias("item")).distinct()
    items = listed.groupBy(*doc).agg(F.count("item").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    near = matches.filter("NOT exact").join(of_item, "phrase").select(*doc, "item_id").distinct().groupBy(*doc).agg(F.count("*").alias("n_near"))
    parts = near.select(*doc, "n_near", F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("long").alias("n_items"), F.lit(None).cast("string").alias("items"))
    parts = parts.union(words.select(*doc, F.lit(None).cast("long"), "n_hit", F.lit(None).cast("long"), F.lit(None).cast("string")))
    parts = parts.union(items.select(*doc, F.lit(None).cast("long"), F.lit(None).cast("long"), "n_items", "items"))
    one = parts.groupBy(*doc).agg(*[F.max(c).alias(c) for c in ("n_near", "n_hit", "n_items", "items")]).alias("o")
    everything = rows.select("doc_id", text_key(F.col("text")).alias("key"), F.size(test_words(F.col("text"))).cast("long").alias("n_words")).alias("d")
    out = everything.join(one, F.expr("d.doc_id <=> o.doc_id AND d.key = o.key"), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "d.doc_id", "d.key", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a test window, all columns kept."""
    bad = contamination(docs, benchmark, window).filter("contaminated").select(F.col("doc_id").alias("_hit_id"), F.col("key").alias("_hit_key")).distinct()
    match = docs["doc_id"].eqNullSafe(bad["_hit_id"]) & (text_key(docs["text"]) == bad["_hit_key"])
    return docs.join(bad, match, "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("key")
