"""Substring dedup by Rabin-Karp hashes of every 50-word window.

1. A window's hash is the polynomial sum of its words' 64-bit hashes with an
   odd base modulo 2**64, built for all windows of a piece of text by doubling
   (1, 2, 4 ... 32 words) and then mixed.
2. A task groups the windows of about ``PIECE`` words. Of equal windows in
   different documents only those of the smallest doc_id go on; the others are
   already repeats. So a passage that a third of all documents share reaches
   the next step once for each piece.
3. Hashes are dealt to buckets by their low bits. A bucket groups equal hashes
   in Spark, finds the smallest doc_id of each, and marks all occurrences in
   later documents.
4. Marks go to their document, where overlapping windows merge into maximal
   removal intervals; the text is cut once, by slices of its words.

Steps 2 and 3 send packed arrays in place of rows (about nine bytes a window),
since a row for each word would be several times the input.

Defined results: null and short texts have no windows and stay whole; a null
doc_id has no smaller or larger id, so nothing is removed from it or because of
it; rows of one doc_id never count as earlier than each other; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.llm.common import documents, let, power_of_two, text_bytes, text_key, words
from twinsift.llm.packing import documents_of, each_bucket, pack, unpack
from twinsift.plans.workspace import materialize

WINDOW = 50
PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of packed windows that a bucket gets, about.
BUCKET_BYTES = 12 << 20
MESSAGE = "bucket int, payload binary"


def window_hashes(h: np.ndarray, window: int) -> np.ndarray:
    """Mixed polynomial hash of each run of ``window`` values."""
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total, have = np.zeros(n, np.uint64), 0
    power, span, base = h, 1, BASE
    while True:
        if window & span:  # append the next ``span`` words
            total = total * base + power[have : have + n]
            have += span
        if span * 2 > window:
            break
        power = power[:-span] * base + power[span:]
        with np.errstate(over="ignore"):
            span, base = span * 2, base * base
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    return total ^ (total >> np.uint64(32))


def _repeats(h: np.ndarray, doc: np.ndarray, order: np.ndarray) -> np.ndarray:
    """In hash order: whether a row's document is later than the first with that hash."""
    s, d = h[order], doc[order]
    head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    low = np.minimum.reduceat(d, head)
    size = np.diff(np.append(head, len(s)))
    return d > np.repeat(low, size)


def _windows(docs: DataFrame, window: int, buckets: int):
    rows = docs.filter("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"),
        let(words(F.col("text")), lambda w: F.when(F.size(w) >= window, F.transform(w, lambda x: F.xxhash64(x)))).alias("h"),
    ).filter("h IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column("doc_id").to_numpy(), b.column("key").to_numpy()
            for lo, hi, values, offsets in documents_of(b, "h", PIECE):
                out = piece(ids[lo:hi], keys[lo:hi], values.view(np.uint64), offsets)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "payload"])

    def piece(ids, keys, values, offsets):
        n = np.diff(offsets) - window + 1
        index = np.repeat(np.arange(len(ids), dtype=np.uint32), n)
        pos = (np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint32)
        h = window_hashes(values, window)[np.repeat(offsets[:-1], n) + pos]
        order = np.argsort(h)
        later = np.zeros(len(h), bool)
        later[order] = _repeats(h, ids[index], order)
        bucket = (h & np.uint64(buckets - 1)).astype(np.int64)
        out = []
        for k, at in each_bucket(bucket):  # in order of document and position
            sent, known = at[~later[at]], at[later[at]]
            bytes_ = (h[sent] >> np.uint64(8)).view(np.uint8).reshape(-1, 8)[:, :7]
            out.append((k, pack(*_docs(ids, keys, index, sent, pos), bytes_.reshape(-1), *_docs(ids, keys, index, known, pos))))
        return out

    return rows.mapInArrow(run, MESSAGE)


def _docs(ids, keys, index, at, pos):
    """Occurrences in order as (doc ids, keys, number in each, position steps)."""
    d = index[at]
    head = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.empty(0, np.int64)
    n = np.diff(np.append(head, len(d))).astype(np.uint32)
    p = pos[at].astype(np.int64)
    step = np.diff(p, prepend=0)
    step[head] = p[head]
    return ids[d[head]], keys[d[head]], n, step.astype(np.min_scalar_type(int(step.max(initial=0))))


def _positions(n: np.ndarray, step: np.ndarray) -> np.ndarray:
    total = np.cumsum(step.astype(np.int64))
    head = np.cumsum(n.astype(np.int64)) - n
    return total - np.repeat(total[head] - step[head], n)


def repeats(messages: DataFrame, blocks: int) -> DataFrame:
    """Packed marks (doc id, key, position) for each block of documents."""

    def run(group: pa.Table) -> pa.Table:
        ids, keys, counts, pos, hashes, marked = [], [], [], [], [], []
        for payload in group["payload"].to_pylist():
            i, k, n, step, seven, *known = unpack(payload)
            if len(known[0]):
                marked.append((np.repeat(known[0], known[2]), np.repeat(known[1], known[2]), _positions(known[2], known[3])))
            if len(i):
                eight = np.zeros((len(seven) // 7, 8), np.uint8)
                eight[:, :7] = seven.reshape(-1, 7)
                hashes.append(eight.reshape(-1).view(np.uint64))
                ids.append(i), keys.append(k), counts.append(n), pos.append(_positions(n, step))
        if hashes:
            h, n = np.concatenate(hashes), np.concatenate(counts)
            doc, key, at = np.repeat(np.concatenate(ids), n), np.repeat(np.concatenate(keys), n), np.concatenate(pos)
            order = np.argsort(h)
            hit = order[_repeats(h, doc, order)]
            marked.append((doc[hit], key[hit], at[hit]))
        if not marked or not sum(len(m[0]) for m in marked):
            return pa.table({"bucket": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})
        doc, key, at = (np.concatenate(x) for x in zip(*marked, strict=True))
        order = np.lexsort((at, key, doc))
        doc, key, at = doc[order], key[order], at[order].astype(np.uint32)
        out = []
        for b, rows in each_bucket(((doc.view(np.uint64) * BASE) >> np.uint64(16)).astype(np.int64) % blocks):
            d, k = doc[rows], key[rows]
            head = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])]))
            out.append((b, pack(d[head], k[head], np.diff(np.append(head, len(d))).astype(np.uint32), at[rows])))
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "payload": pa.array([x[1] for x in out], pa.binary())})

    return messages.groupBy("bucket").applyInArrow(run, MESSAGE)


def kept_intervals(marks: DataFrame, window: int) -> DataFrame:
    """(doc_id, key, n_removed, kept): the parts of a text between its maximal removal intervals."""
    schema = "doc_id long, key long, n_removed long, kept array<struct<start:int,len:int>>"

    def run(group: pa.Table) -> pa.Table:
        parts = []
        for payload in group["payload"].to_pylist():
            d, k, n, at = unpack(payload)
            parts.append((np.repeat(d, n), np.repeat(k, n), at.astype(np.int64)))
        doc, key, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, key, doc))
        doc, key, at = doc[order], key[order], at[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
        gap = new.copy()
        gap[1:] |= at[1:] > at[:-1] + window
        head = np.flatnonzero(gap)
        start, end = at[head], at[np.append(head[1:], len(at)) - 1] + window
        first = np.flatnonzero(new[head])
        bounds = np.append(first, len(head))
        removed = np.add.reduceat(end - start, first)
        # a document keeps what stands before each of its intervals and, to the end, what follows the last
        n = np.diff(bounds)
        offsets = np.append(0, np.cumsum(n + 1))
        starts, ends = np.zeros(offsets[-1], np.int64), np.full(offsets[-1], 2**31 - 1)
        opening = np.zeros(offsets[-1], bool)
        opening[offsets[:-1]] = True
        closing = np.roll(opening, -1)
        starts[~opening], ends[~closing] = end, start
        items = pa.StructArray.from_arrays([pa.array(starts.astype(np.int32)), pa.array((ends - starts).astype(np.int32))], ["start", "len"])
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), items)
        at_first = head[first]
        return pa.table({"doc_id": doc[at_first], "key": key[at_first], "n_removed": removed.astype(np.int64), "kept": lists})

    return marks.groupBy("bucket").applyInArrow(run, schema)


def repeated_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, key, n_removed, kept) of the documents that lose words."""
    size = text_bytes(docs)
    buckets = power_of_two(size * 1.6 / BUCKET_BYTES, 256)
    blocks = power_of_two(size / (64 << 20), 64)
    marks = materialize(repeats(_windows(docs, window, buckets), blocks), "marks", free=True)
    return kept_intervals(marks, window)


def cut_words(text: Column, kept: Column) -> Column:
    """The words of a text that lie in the kept parts; all of them if ``kept`` is null."""
    parts = lambda w: F.when(kept.isNull(), w).otherwise(F.flatten(F.transform(kept, lambda s: F.slice(w, s["start"] + 1, s["len"]))))
    return let(words(text), parts)


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, key, n_removed, kept_text) for every document; kept words are joined by one space."""
    found = repeated_substrings(docs, window).alias("f")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text").alias("d")
    joined = rows.join(found, F.expr("d.doc_id = f.doc_id AND d.key = f.key"), "left")
    removed = F.coalesce("f.n_removed", F.lit(0)).cast("long")
    left = F.array_join(cut_words(F.col("d.text"), F.col("f.kept")), " ")
    return joined.select("d.doc_id", "d.key", removed.alias("n_removed"), left.alias("kept_text"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(documents(spark, sf_dir))
    kept = let(F.col("kept_text"), lambda t: F.struct(F.sha2(t, 256).alias("sha"), F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).alias("n")))
    rows = out.select("doc_id", "n_removed", kept.alias("k"))
    return rows.select("doc_id", (F.col("k.n") + F.col("n_removed")).cast("long").alias("n_words"), "n_removed", F.col("k.sha").alias("kept_sha256"))
