"""A scan: catalogue and fingerprints in, ranked duplicate groups out.

    filter -> exact edges + (bands -> candidates -> distance ladder -> rejections)
    -> components -> keep row -> percent and badge -> filter

Equal fingerprints are one node of the candidate search, so a hot fingerprint
never makes pairs; their rows join the groups by an edge to the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.config import ScanConfig
from twinsift.functions import distances as D
from twinsift.functions.fingerprints import hash_bytes, hash_bytes144
from twinsift.functions.predicates import aspect_compatible, extension_enabled, is_supported, size_between
from twinsift.operators import groups as G
from twinsift.operators import lsh
from twinsift.operators.folders import first_items
from twinsift.operators.pairs import drop_rejected, window_candidates
from twinsift.plans.workspace import materialize


def filter_files(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Supported images of the enabled extensions and sizes."""
    return files.filter(
        is_supported(F.col("mime_type"), F.col("name")) & size_between(F.col("size"), config.min_bytes, config.max_bytes) & extension_enabled(F.col("name"), config.extensions)
    )


def _first_items(files: DataFrame, config: ScanConfig) -> DataFrame:
    """The first ``max_items`` files by scan position, before any filter."""
    if config.max_items is None:
        return files
    if "idx" not in files.columns:
        raise ValueError("a limit of items goes by scan position: files need idx")
    return first_items(files, config.max_items)


def _window_pairs(rows: DataFrame, reps: DataFrame, reach: int) -> DataFrame:
    """(i, j) of nodes that have rows less than ``reach`` positions apart with near brightness and edges.

    Cropped copies may share no band. All rows take part, not only the nodes'
    first, since a copy can be near where the first is not.
    """
    l1 = lambda c, at, n: F.aggregate(F.zip_with(F.slice(f"a.{c}", at, n), F.slice(f"b.{c}", at, n), lambda x, y: F.abs(x - y)), F.lit(0).cast("double"), lambda s, x: s + x)
    near = (l1("color_hist", 25, 8) < 200) & (l1("edge_hist", 1, 6) < 300)
    found = window_candidates(rows.select("idx", "color_hist", "edge_hist"), "idx", reach, near, "color_hist", "edge_hist")
    node = lambda c, name: rows.join(reps, "_sig").select(F.col("idx").alias(c), F.col("_rep").alias(name))
    both = found.join(node("i", "a"), "i").join(node("j", "b"), "j").filter("a <> b")
    return both.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct()


def _band_pairs(nodes: DataFrame, distance, config: ScanConfig) -> DataFrame:
    """(i, j) of nodes that share a band. In mode auto, no pair with fingerprints, frequency hashes or, if compared, variants
    within the threshold is missing; without crops and colours, only such pairs are there. Crops are compared among the pairs
    that share a block and, with colours, those of the window."""
    parts = hash_bytes if config.bits == 64 else hash_bytes144
    if config.lsh_mode != "auto":
        setting = lsh.choose_setting(nodes.select("id", "fp"), distance, config.threshold, config.lsh_mode)
        return lsh.candidates(lsh.explode_bands(nodes, parts(F.col("fp")), config.bits, setting, "id"))
    every = F.array_distinct(F.concat(F.array("fp"), F.coalesce(F.col("variants"), F.array()))) if config.with_variants else F.array("fp")
    hashes = nodes.select("id", F.explode(every).alias("h"))
    if config.with_crops or config.with_colour:
        found = lsh.lossless_candidates(hashes, parts, config.bits, config.threshold)
    else:
        found = lsh.pairs_near(hashes, parts, config.bits, config.threshold, distance)
    if config.with_phash:
        found = found.union(lsh.pairs_near(nodes.select("id", "phash"), hash_bytes, 64, D.phash_bound(config.threshold), D.hamming, value="phash")).distinct()
    return found


def scan_fingerprints(found: DataFrame, bits: int = 144) -> DataFrame:
    """The rows of ``fingerprint_images`` in the form that :func:`match_edges` takes; images with an error have no row.

    Crops have hashes of 144 bits only.
    """
    hash_ = "d8" if bits == 64 else "d12"
    crops = F.transform("crops", lambda c: c["d12"]) if bits == 144 else F.lit(None).cast("array<bigint>")
    variants = F.transform("variants", lambda v: v[hash_])
    return found.filter("error IS NULL").select("id", F.col(hash_).alias("fp"), variants.alias("variants"), crops.alias("crops"), "color_hist", "edge_hist", "phash")


def failed_images(found: DataFrame) -> DataFrame:
    """(id, error) of the images that have no fingerprint."""
    return found.filter("error IS NOT NULL").select("id", "error")


def match_edges(files: DataFrame, fps: DataFrame, config: ScanConfig, rejections: DataFrame | None = None) -> DataFrame:
    """(src, dst, dist, match_type) between files by fingerprint.

    ``fps`` has id and ``fp``: a long for 64 bits, a struct for 144; and where
    the options ask for them, ``variants``, ``crops``, ``color_hist``,
    ``edge_hist`` and ``phash``. With crops and colours, ``files`` has ``idx``, the scan position.
    """
    if config.with_crops and config.with_colour and "idx" not in files.columns:
        raise ValueError("crops with colours are matched by scan position too: files need idx")
    distance = D.hamming if config.bits == 64 else D.hamming144
    t = config.threshold
    rows = files.select("id", "width", "height").join(fps, "id").filter("fp IS NOT NULL")
    # rows that no pair test can tell apart share a node
    same = [c for c in ("fp", "width", "height", "variants", "crops", "color_hist", "edge_hist", "phash") if c in rows.columns]
    rows = rows.withColumn("_sig", F.md5(F.to_json(F.struct(*same))))
    reps = rows.groupBy("_sig").agg(F.min("id").alias("_rep"))
    copies = rows.select("id", "_sig").join(reps, "_sig").filter("id <> _rep").select(F.col("_rep").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("dist"), F.lit("structural").alias("match_type"))
    nodes = materialize(rows.join(reps.select("_rep"), F.col("id") == F.col("_rep"), "left_semi").drop("_sig"), "nodes")
    found = _band_pairs(nodes, distance, config)
    if config.with_crops and config.with_colour:
        found = found.select("i", "j").union(_window_pairs(rows.join(files.select("id", "idx"), "id"), reps, config.window)).distinct()
    a, b = nodes.alias("a"), nodes.alias("b")
    pairs = found.join(a, F.col("i") == F.col("a.id")).join(b, F.col("j") == F.col("b.id"))
    if config.aspect_filter:
        pairs = pairs.filter(aspect_compatible(F.col("a.width"), F.col("a.height"), F.col("b.width"), F.col("b.height"), config.aspect_tolerance_pct))
    base = D.best_distance(F.col("a.fp"), F.col("a.variants"), F.col("b.fp"), F.col("b.variants"), distance) if config.with_variants else distance(F.col("a.fp"), F.col("b.fp"))
    crop = D.best_crop_distance(F.col("a.fp"), F.col("a.crops"), F.col("b.fp"), F.col("b.crops"), distance) if config.with_crops else None
    combined = D.combined_hist_distance(D.hist_distance(F.col("a.color_hist"), F.col("b.color_hist")), D.hist_distance(F.col("a.edge_hist"), F.col("b.edge_hist"))) if config.with_colour else None
    dist = base
    if config.with_phash:
        dist = D.with_phash(base, D.hamming(F.col("a.phash"), F.col("b.phash")), D.phash_bound(t))
    final = D.extended_distance(dist, t, crop, combined, config.crop_parity) if crop is not None or combined is not None else dist
    kind = F.when(base <= t, "structural").when(dist <= t, "phash")
    kind = kind.when(crop <= t, "crop").otherwise("colour") if crop is not None else kind.otherwise("colour")
    scored = pairs.select("i", "j", F.col("a.fp").alias("fa"), F.col("b.fp").alias("fb"), final.alias("dist"), kind.alias("match_type")).filter(F.col("dist") <= t)
    if rejections is not None:
        scored = drop_rejected(scored, rejections, "fa", "fb")
    return scored.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("dist").cast("int").alias("dist"), "match_type").union(copies)


def run_scan(files: DataFrame, fps: DataFrame, config: ScanConfig | None = None, rejections: DataFrame | None = None) -> DataFrame:
    """Ranked rows: group_id, id, is_keep, dist, pct, badge, group_pct and the file's columns."""
    config = config or ScanConfig()
    listed = filter_files(_first_items(files.dropDuplicates(["id"]), config), config)
    edges = match_edges(listed, fps, config, rejections).select("src", "dst")
    if config.exact_edges:
        edges = edges.union(G.exact_edges(listed))
    members = materialize(G.match_groups(edges, listed), "members")
    rows = members.join(listed, "id")
    rank = G.folder_rank(list(config.folder_priority), F.col("parents")[0], F.col("name"), F.col("path")) if "path" in rows.columns else G.folder_rank(list(config.folder_priority), F.col("parents")[0], F.col("name"))
    key = G.keep_key(config.keep_rule, F.col("size"), F.col("modified_time"), F.col("width"), F.col("height"), rank)
    ranked = G.mark_keep(rows, key, order="idx" if "idx" in rows.columns else "id")
    keeps = ranked.filter("is_keep").select("group_id", F.col("id").alias("_k")).join(fps.select(F.col("id").alias("_k"), F.col("fp").alias("_kf")), "_k", "left").drop("_k")
    distance = D.hamming if config.bits == 64 else D.hamming144
    scored = ranked.join(keeps, "group_id").join(fps.select("id", "fp"), "id", "left").withColumn("dist", distance(F.col("fp"), F.col("_kf"))).drop("fp", "_kf")
    scored = scored.withColumn("pct", D.percent(F.col("dist"), config.bits)).withColumn("badge", D.badge(F.col("pct")))
    return G.similarity_filter(G.best_percent(scored), config.min_similarity_pct)


def exact_scan(files: DataFrame, config: ScanConfig | None = None) -> DataFrame:
    """Ranked rows of exact groups, without fingerprints: percents are null."""
    config = config or ScanConfig()
    listed = filter_files(files.dropDuplicates(["id"]), config)
    groups = G.exact_groups(listed).withColumnRenamed("first_id", "group_id")
    rows = listed.join(groups.select("md5", "size", "group_id"), ["md5", "size"])
    key = G.keep_key(config.keep_rule, F.col("size"), F.col("modified_time"), F.col("width"), F.col("height"), F.lit(G.NO_PRIORITY))
    return G.mark_keep(rows, key, order="id")
