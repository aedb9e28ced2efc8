"""SimHash near-duplicates by covering locality-sensitive hashing (Pagh, 2016).

A fingerprint has 64 bits by majority over the XXH64 of 3-word shingles. For
radius r, each bit position i gets a random nonzero m(i) of r + 1 bits; for
every nonzero v of r + 1 bits there is a table whose mask keeps the positions
with <m(i), v> = 1. The m(i) of r differing positions never span all r + 1
dimensions, so some v is orthogonal to all of them, and that table's key is
the same for both: each pair within the radius meets in one of the
2**(r+1) - 1 = 15 tables.

Only distinct fingerprints enter the tables, so exact copies cost nothing. A
bucket is compared in pieces of ``PIECE`` fingerprints; each pair of pieces is
a task's work of its own and returns a spanning forest, never its pairs.
Components run over fingerprints in Spark.

Defined results: null and empty texts have fingerprint zero and are linked like
any other; a null doc_id is linked but never names a component (a component of
null ids only has a null component_id); repeated rows are repeated in the
result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm.common import documents, let, lower_ascii, text_key, words
from twinsift.operators.components import connected_components
from twinsift.plans.workspace import materialize

SHINGLE = 3
RADIUS = 3
PIECE = 4096
SEED = 7
#: Lanes of 16 bits count bits of up to this many hashes without overflow.
LANE = 65535
#: Groups of up to this many fingerprints are compared together.
SMALL = 32


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of each shingle of the lower-cased words."""

    def of(w: Column) -> Column:
        at = lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + k) for k in range(size)]))
        return (
            F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), at))
            .when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "))))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return let(words(lower_ascii(text)), of)


def majority(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A fingerprint for each range of hashes: the bits set in over half of them."""
    n = len(offsets) - 1
    counts = np.diff(offsets)
    out = np.zeros(n, np.uint64)
    # ranges are cut to what a lane can count; the pieces' counts are added afterwards
    pieces = [np.arange(a, b, LANE) if b - a > LANE else np.array([a]) for a, b in zip(offsets[:-1], offsets[1:], strict=True) if b > a] if counts.max(initial=0) > LANE else None
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts = np.concatenate(pieces) if pieces else offsets[:-1][full]
    owner = np.repeat(np.arange(len(full)), [len(p) for p in pieces]) if pieces else None
    half = counts[full]
    for shift in range(16):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & np.uint64(0x0001000100010001), starts)
        for lane in range(4):
            set_ = (lanes >> np.uint64(16 * lane)).astype(np.int64) & 0xFFFF
            if owner is not None:
                set_ = np.bincount(owner, set_, len(full)).astype(np.int64)
            out[full] |= (2 * set_ > half).astype(np.uint64) << np.uint64(shift + 16 * lane)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp): one row for each document, fp as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), shingle_hashes(F.col("text")).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("h")
            offsets = h.offsets.to_numpy().astype(np.int64)
            fp = majority(h.values.to_numpy(zero_copy_only=False).view(np.uint64), offsets)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(fp.view(np.int64))], ["doc_id", "key", "fp"])

    return rows.mapInArrow(run, "doc_id long, key long, fp long")


def covering_masks(radius: int = RADIUS, seed: int = SEED) -> list[int]:
    """Masks as signed longs; the random m(i) are fixed by the seed."""
    m = np.random.default_rng(seed).integers(1, 1 << (radius + 1), 64)
    masks = [sum(1 << i for i in range(64) if int(m[i] & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def _small_groups(fp: np.ndarray, bounds: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links inside each group of up to ``SMALL`` rows, all groups at once."""
    sizes = np.diff(bounds)
    group = np.repeat(np.where(sizes <= SMALL, np.arange(len(sizes)), -1), sizes)
    out = [(np.empty(0, np.uint64), np.empty(0, np.uint64))]
    for d in range(1, min(SMALL, int(sizes.max()))):
        at = np.flatnonzero((group[:-d] == group[d:]) & (group[d:] >= 0))
        if not len(at):
            break
        at = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= radius]
        out.append((fp[at], fp[at + d]))
    return out


def _forest(fp: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the rows in two masks."""
    label, src, dst = np.arange(len(fp)), [], []
    others = np.flatnonzero(right)
    for i in np.flatnonzero(left):
        near = others[np.bitwise_count(fp[others] ^ fp[i]) <= radius]
        roots, at = np.unique(label[near], return_index=True)
        for r, j in zip(roots, near[at], strict=True):
            if r != label[i]:
                src.append(fp[i])
                dst.append(fp[j])
        label[np.isin(label, roots)] = label[i]
    return np.array(src, np.uint64), np.array(dst, np.uint64)


def links(fps: DataFrame, radius: int = RADIUS, piece: int = PIECE) -> DataFrame:
    """(src, dst) between distinct fingerprints: the same components as all links.

    ``fps`` has one distinct column ``fp``.
    """
    masks = covering_masks(radius)
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)]))
    table = fps.select("fp", keys.alias("b")).select("fp", "b.t", "b.k")
    # a bucket of n fingerprints has ceil(n / piece) pieces; every pair of them meets once
    sizes = table.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1")
    member = table.join(sizes, ["t", "k"])
    pieces = F.ceil(F.col("n") / piece).cast("int")
    own = F.pmod(F.xxhash64("fp"), pieces).cast("int")
    pairs = F.explode(F.transform(F.sequence(F.lit(0), pieces - 1), lambda p: F.struct(F.least(own, p).alias("p"), F.greatest(own, p).alias("q"))))
    dealt = member.select("t", "k", "fp", pairs.alias("c"), own.alias("own")).select("t", "k", "c.p", "c.q", "own", "fp")

    group = ["t", "k", "p", "q"]
    dealt = dealt.repartition(*group).sortWithinPartitions(*group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for b in batches:
            rows = pa.Table.from_batches([b]) if left is None else pa.concat_tables([left, pa.Table.from_batches([b])])
            ids = [rows[c].to_numpy() for c in group]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1
            done = int(change[-1]) if len(change) else 0
            left = rows.slice(done)  # the last group may go on
            if done:
                yield from compared(rows.slice(0, done), np.concatenate([[0], change]))
        if left is not None and len(left):
            yield from compared(left, np.array([0, len(left)]))

    def compared(rows: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        fp, own = rows["fp"].to_numpy().view(np.uint64), rows["own"].to_numpy()
        p, q = rows["p"].to_numpy(), rows["q"].to_numpy()
        pairs = _small_groups(fp, bounds, radius)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo > SMALL:
                x, first = fp[lo:hi], own[lo:hi] == p[lo]
                pairs.append(_forest(x, first, ~first if p[lo] != q[lo] else first, radius))
        src, dst = (np.concatenate(x) for x in zip(*pairs, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], ["src", "dst"])

    return dealt.mapInArrow(run, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, key, fp, component_id, first) for every row.

    ``component_id`` is the smallest doc_id of the group. ``first`` is true for
    the rows that stand for the group: those of that id and, among its texts,
    of the smallest key.
    """
    rows = materialize(fingerprints(docs), "fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    heads = materialize(rows.groupBy("fp").agg(best.alias("head")), "heads")
    groups = connected_components(links(heads.select("fp"), radius))
    labelled = heads.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    tops = labelled.groupBy("component").agg(F.min("head").alias("top"))
    named = labelled.join(tops, "component").select("fp", F.col("top.doc_id").alias("component_id"), F.col("top.key").alias("top_key"))
    # copies of one fingerprint are rows of one join key: the join splits them at run time
    out = rows.join(named, "fp", "left")
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("top_key"))
    return out.select("doc_id", "key", "fp", "component_id", first.alias("first"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, all columns kept."""
    firsts = near_duplicates(docs, radius).filter("first").select(F.col("doc_id").alias("_near_id"), F.col("key").alias("_near_key")).distinct()
    match = docs["doc_id"].eqNullSafe(firsts["_near_id"]) & (text_key(docs["text"]) == firsts["_near_key"])
    return docs.join(firsts, match).dropDuplicates(["_near_id", "_near_key"]).drop("_near_id", "_near_key")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
