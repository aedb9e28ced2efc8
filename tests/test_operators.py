import random

import pytest
from pyspark.sql import functions as F

from twinsift.config import ScanConfig
from twinsift.functions import distances as D
from twinsift.functions.fingerprints import hash_bytes, hash_bytes144
from twinsift.operators import cache, feedback, folders, lsh, pairs
from twinsift.operators import groups as G
from twinsift.operators.components import connected_components
from twinsift.plans import scan
from twinsift.sources import readers, writers
from twinsift.streaming import progressive


def closure(edges):
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        label[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in label}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "clique"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {
        "chain": [(i, i + 1) for i in range(40)], "star": [(0, i) for i in range(1, 60)] + [(100, 101)],
        "random": [(rng.randrange(90), rng.randrange(90)) for _ in range(60)], "clique": [(i, j) for i in range(8) for j in range(i)],
    }[kind]
    df = spark.createDataFrame([*edges, (None, 5), (7, None)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == closure([e for e in edges if e[0] != e[1]])


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("bits, setting, bound", [(64, "loose", 7), (64, "normal", 3), (64, "strict", 1), (144, "loose", 11), (144, "normal", 5), (144, "strict", 3)])
def test_pairs_within_the_bound_are_candidates(spark, bits, setting, bound):
    rng = random.Random(bits)
    base = rng.getrandbits(bits)
    near = [base] + [base ^ sum(1 << b for b in rng.sample(range(bits), bound)) for _ in range(30)]
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    if bits == 64:
        df = spark.createDataFrame([(i, sign(h)) for i, h in enumerate(near)], "id int, fp long")
        parts = hash_bytes(F.col("fp"))
    else:
        rows = [(i, (sign(h >> 80), sign((h >> 16) & (2**64 - 1)), h & 0xFFFF)) for i, h in enumerate(near)]
        df = spark.createDataFrame(rows, "id int, fp struct<w0:long,w1:long,w2:int>")
        parts = hash_bytes144(F.col("fp"))
    found = {(r["i"], r["j"]) for r in lsh.candidates(lsh.explode_bands(df, parts, bits, setting, "id")).collect()}
    assert {(0, i) for i in range(1, 31)} <= found


def test_bands_are_disjoint():
    for (bits, setting), (n, rows) in lsh.SETTINGS.items():
        flat = sum(lsh.band_bytes(bits, setting), [])
        assert len(flat) == len(set(flat)) == n * rows <= bits // 8


def test_settings():
    assert [lsh.adaptive_setting(n, t) for n, t in ((20000, 5), (20000, 6), (500, 3), (5000, 15), (5000, 6), (5000, 10))] == ["strict", "normal", "loose", "loose", "strict", "normal"]
    assert lsh.tuned_setting(None, 10) == "normal"
    assert [lsh.tuned_setting({"p10": a, "p50": b}, 10) for a, b in ((16, 30), (1, 4), (10, 20))] == ["loose", "strict", "normal"]


def test_window_join_is_the_range_join(spark):
    df = spark.range(100).withColumnRenamed("id", "idx")
    got = {tuple(r) for r in pairs.window_candidates(df, "idx", 7, F.lit(True)).collect()}
    assert got == {(i, j) for i in range(100) for j in range(i + 1, min(100, i + 7))}


def test_tiles_give_each_pair_once(spark):
    got = [tuple(r) for r in pairs.tiled_pairs(spark.range(30), "id", 4).select("a.id", "b.id").collect()]
    assert sorted(got) == [(i, j) for i in range(30) for j in range(i + 1, 30)]


def test_rejections(spark):
    e = spark.createDataFrame([(1, 2, 10, 20), (1, 3, 10, 30), (2, 3, 20, 30)], "i int, j int, fa long, fb long")
    r = feedback.reject(e.filter("i = 1 AND j = 2"), "fb", "fa", F.lit(1))
    left = pairs.drop_rejected(e, r, "fa", "fb")
    assert {(x["i"], x["j"]) for x in left.collect()} == {(1, 3), (2, 3)}
    assert connected_components(left, "i", "j").select("component").distinct().count() == 1
    many = spark.range(20).select(F.col("id").alias("lo"), F.col("id").alias("hi"), F.col("id").alias("seq"))
    assert {x["seq"] for x in feedback.newest_rejections(many, 5).collect()} == set(range(15, 20))


def test_members_stay_unless_all_partners_reject(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 8), (2, 9)], "group_id int, id int")
    rejected = spark.createDataFrame([(1, 2), (1, 3), (8, 9)], "i int, j int")
    assert {r["id"] for r in feedback.keep_unrejected(rows, rejected).collect()} == {2, 3, 8, 9}


def files(spark, *rows):
    schema = "id int, size long, modified_time timestamp, width int, height int, group_id int, idx int"
    import datetime as dt

    return spark.createDataFrame([(i, s, None if t is None else dt.datetime.fromtimestamp(t, dt.timezone.utc), w, h, 1, i) for i, s, t, w, h in rows], schema)


@pytest.mark.parametrize("rule, keep", [("newest", 2), ("oldest", 3), ("largest", 3), ("smallest", 1), ("hires", 3), ("none", 1)])
def test_keep_rules(spark, rule, keep):
    rows = files(spark, (1, 5, 100, 1920, 1080), (2, 5, 200, 1920, 1080), (3, 9_000_000, None, None, None))
    key = G.keep_key(rule, F.col("size"), F.col("modified_time"), F.col("width"), F.col("height"))
    assert [r["id"] for r in G.mark_keep(rows, key).filter("is_keep").collect()] == [keep]


def test_folder_priority(spark):
    rank = G.folder_rank(["best", " ok"], F.col("a"), F.col("b"))
    rows = spark.createDataFrame([("x", "ok.png"), ("Best", None), ("no", "no"), ("ok", "best")], "a string, b string")
    assert [r[0] for r in rows.select(rank).collect()] == [1, 0, G.NO_PRIORITY, 0]


def test_filters_drop_orphans(spark):
    rows = spark.createDataFrame([(1, 1, True, 100), (1, 2, False, 60), (2, 3, True, 100), (2, 4, False, 80), (3, 5, True, None), (3, 6, False, None)], "group_id int, id int, is_keep boolean, pct int")
    assert {r["id"] for r in G.similarity_filter(rows, 75).collect()} == {3, 4}
    gone = spark.createDataFrame([(2,)], "id int")
    assert {r["id"] for r in G.remove_ids(rows, gone).collect()} == {3, 4, 5, 6}


def test_tree(spark):
    f = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("d", "c", "D"), ("x", "y", "X"), ("y", "x", "Y")], "id string, parent_id string, name string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    depth = lambda df: {r["id"]: r["depth"] for r in df.collect()}
    assert depth(folders.breadth_first(f, ids("a"))) == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert depth(folders.breadth_first(f, ids("a"), ids("b"))) == {"a": 0}
    assert depth(folders.breadth_first(f, ids("x"))) == {"x": 0, "y": 1}
    items = spark.createDataFrame([(1, "one", "d"), (2, "two", None), (3, "three", "lost")], "id int, name string, parent_id string")
    assert {r["id"]: r["path"] for r in folders.paths(items, f).collect()} == {1: "/A/B/C/D/one", 2: "/two", 3: "/three"}


def test_cache(spark):
    c = spark.createDataFrame([(1, "a", 7, 1), (2, "b", 7, None)], "id int, md5 string, d12 int, phash int").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    f = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (1, "new")], "id int, md5 string")
    hits, misses = cache.lookup(f, c, cache.features_present(phash=True))
    assert [r["id"] for r in hits.collect()] == [1]
    assert {(r["id"], r["md5"]) for r in misses.collect()} == {(2, "b"), (3, "c"), (1, "new")}
    now = F.lit("2024-06-01").cast("timestamp")
    up = cache.upsert(c, spark.createDataFrame([(2, "b", 8, 1), (4, "d", 8, 1)], "id int, md5 string, d12 int, phash int"), now)
    assert {(r["id"], r["d12"]) for r in up.collect()} == {(1, 7), (2, 8), (4, 8)}
    assert {r["id"] for r in cache.expire(up, now).collect()} == {2, 4}


def test_undo(spark):
    a = spark.range(1, 52).select(F.col("id").alias("seq"), F.col("id"), F.lit("n").alias("name"), F.lit("trash").alias("action"), F.lit(204).alias("status"), F.timestamp_seconds(F.when(F.col("id") == 5, 0).otherwise(100000)).alias("ts"))
    left = feedback.undo_stack(a, F.timestamp_seconds(F.lit(100100)))
    assert {r["seq"] for r in left.collect()} == set(range(2, 52)) - {5}


def test_batch_response(spark):
    text = "--b\nContent-ID: <response-item-f1>\n\nHTTP/1.1 204 No Content\n--b\nContent-ID: <response-item-f2>\n\nHTTP/1.1 404 x\n--b\nContent-ID: <response-item-f3>\n\nHTTP/1.1 403 x\n--b--"
    ids = spark.createDataFrame([("f1",), ("f2",), ("f3",), ("f4",)], "id string")
    got = feedback.trash_outcome(ids, feedback.parse_batch_response(spark.createDataFrame([(text,), ("",)], "text string"), "b"))
    assert {r["id"]: r["outcome"] for r in got.collect()} == {"f1": "success", "f2": "success", "f3": "failed", "f4": "retry"}


def test_delta(spark):
    listed = spark.createDataFrame([(1,), (2,)], "id long")
    ch = spark.createDataFrame([(1, 2, True), (2, 3, False), (3, 3, False)], "seq long, file_id long, removed boolean")
    assert sorted(r["id"] for r in progressive.merge_changes(listed, progressive.latest_changes(ch)).collect()) == [1, 3]
    trashed = spark.createDataFrame([(1, 2, None, True)], "seq long, file_id long, removed boolean, trashed boolean")
    assert progressive.latest_changes(trashed).first()["removed"] is True


def test_progressive_retires_merged_groups(spark, tmp_path):
    sink = progressive.ProgressiveGroups(spark, f"file://{tmp_path}/out")
    for n, edges in enumerate([[(1, 2), (5, 6)], [(2, 5)], [(8, 9)]]):
        sink(spark.createDataFrame(edges, "src long, dst long"), n)
    out = progressive.emissions(spark, sink.path)
    assert [r["group_id"] for r in out.filter("retired").collect()] == [5]
    assert {(r["group_id"], r["id"]) for r in progressive.current_groups(out).collect()} == {(1, 1), (1, 2), (1, 5), (1, 6), (8, 8), (8, 9)}


def test_csv_quotes_only_where_needed(spark):
    row = spark.createDataFrame([(1, True, "a", 'x,"y"', "/p", 5, "m", None, 3, 4, 0, "exact", None)], "group_id int, is_keep boolean, id string, name string, path string, size long, md5 string, mime_type string, width int, height int, dist int, match_type string, web_view_link string")
    row = row.withColumn("modified_time", F.lit(None).cast("timestamp")).withColumn("created_time", F.lit(None).cast("timestamp"))
    assert writers.csv_lines(writers.export_rows(row)).first()[0] == '1,KEEP,"x,""y""",/p,5,,m,,3,4,100,exact,a,'


def test_json_catalogue(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"id":"1","name":"a.png","size":"12"}\n{"id":"2","size":null}\n{"id":"3","size":"x"}\n')
    assert [r["size"] for r in readers.read_files(spark, str(tmp_path), "json").orderBy("id").collect()] == [12, 0, 0]


def test_settings_table(spark):
    t = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("zz", "9", 1)], "key string, value string, ts int")
    assert readers.settings(t, {"a": "0", "b": "5"}) == {"a": "2", "b": "5"}


def test_scan_equals_brute_force(spark):
    rng = random.Random(5)
    hashes = []
    for _ in range(12):
        base = rng.getrandbits(63)
        hashes += [base ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(4))) for _ in range(4)]
    df = spark.createDataFrame([(i, f"p{i}.png", h) for i, h in enumerate(hashes)], "id long, name string, fp long")
    rows = df.select("id", "name", F.lit("image/png").alias("mime_type"), F.lit(10).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified_time"), F.array(F.lit("f")).alias("parents"), F.col("id").cast("string").alias("md5"), F.lit(4).alias("width"), F.lit(3).alias("height"))
    out = scan.run_scan(rows, df.select("id", "fp"), ScanConfig(bits=64, max_distance=7, lsh_mode="loose"))
    got = {r["id"]: r["group_id"] for r in out.collect()}
    edges = [(i, j) for i in range(48) for j in range(i) if bin(hashes[i] ^ hashes[j]).count("1") <= 7]
    assert got == closure(edges)
    assert out.filter("is_keep").count() == len(set(got.values()))
    assert D.BADGES[0][1] == "identical"


def test_cropped_copies_that_share_no_band_are_matched(spark):
    from twinsift.config import ScanConfig
    from twinsift.plans import scan

    files = spark.createDataFrame([(1, 10, 10, 0), (2, 10, 10, 1500), (3, 10, 10, 3600)], "id long, width int, height int, idx long")
    hist = [8.0] * 32
    rows = [(1, 0, [-1], hist, hist), (2, -1, [5], hist, hist), (3, -1, [6], hist, hist)]
    fps = spark.createDataFrame(rows, "id long, fp long, crops array<long>, color_hist array<double>, edge_hist array<double>")
    got = {(r["src"], r["dst"], r["match_type"]) for r in scan.match_edges(files, fps, ScanConfig(bits=64, with_crops=True, with_colour=True)).collect()}
    # 3 is too far from 1, and has the fingerprint of 2
    assert (1, 2, "crop") in got and not any(g[:2] == (1, 3) for g in got)


def test_lossless_candidates_miss_nothing(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(12)]
    fps = [(i, base[i % 12] ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 12)))) for i in range(120)]
    df = spark.createDataFrame(fps, "id long, h long")
    for t in (0, 3, 7, 16, 20):
        got = {(r["i"], r["j"]) for r in lsh.lossless_candidates(df, hash_bytes, 64, t).collect()}
        want = {(i, j) for i, x in fps for j, y in fps if i < j and (x ^ y).bit_count() <= t}
        assert want <= got and all(i < j for i, j in got)


@pytest.mark.parametrize("bits", [64, 144])
def test_pairs_near_are_all_pairs_within_the_bound_and_no_others(spark, bits):
    rng = random.Random(5)
    base = [rng.getrandbits(bits) for _ in range(8)]
    raw = [(i % 60, base[i % 8] ^ sum(1 << b for b in rng.sample(range(bits), rng.randint(0, 12)))) for i in range(100)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    word = lambda h: signed(h) if bits == 64 else (signed(h >> 80), signed(h >> 16 & 2**64 - 1), h & 0xFFFF)
    df = spark.createDataFrame([*[(i, word(h)) for i, h in raw], (70, None)], f"id long, h {'long' if bits == 64 else 'struct<w0: long, w1: long, w2: int>'}")
    parts, distance = (hash_bytes, D.hamming) if bits == 64 else (hash_bytes144, D.hamming144)
    for t in (0, 2, 7, 14, 20):
        got = [(r["i"], r["j"]) for r in lsh.pairs_near(df, parts, bits, t, distance).collect()]
        want = {(i, j) for i, x in raw for j, y in raw if i < j and (x ^ y).bit_count() <= t}
        assert set(got) == want and len(got) == len(want)


def test_a_scan_makes_no_pairs_of_a_shared_block_and_misses_none_by_frequency(spark):
    """Fingerprints that share a block alone make no pair; frequency hashes within their bound do, without a shared block."""
    rng = random.Random(6)
    rows = [(i, 7 << 48 | rng.getrandbits(48), rng.getrandbits(62)) for i in range(50)]
    rows += [(100, 0, 0), (101, (1 << 63) - 1, 3)]
    nodes = spark.createDataFrame(rows, "id long, fp long, phash long")
    config = ScanConfig(bits=64, max_distance=7, with_phash=True, aspect_filter=False)
    assert [(r["i"], r["j"]) for r in scan._band_pairs(nodes, D.hamming, config).collect()] == [(100, 101)]
    files = nodes.select("id", F.lit(4).alias("width"), F.lit(3).alias("height"))
    assert [(r["src"], r["dst"], r["match_type"]) for r in scan.match_edges(files, nodes, config).collect()] == [(100, 101, "phash")]


def test_images_go_through_the_scan(spark, sf):
    """Groups of the image scan are the components of all pairs within the distance, by brute force."""
    from twinsift import queries as Q

    found = {r["id"]: r for r in scan.scan_fingerprints(Q.image_fingerprints(spark, sf).withColumn("id", F.col("id").cast("long"))).collect()}
    files = [tuple(r) for r in Q.catalogue(spark, sf).select("id", "md5", "size").collect()]
    known = [f[0] for f in files if f[0] in found]
    sides = {i: [(h["w0"], h["w1"], h["w2"]) for h in [found[i]["fp"], *found[i]["variants"]]] for i in known}
    bits = lambda x, y: sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(x, y, strict=True))
    config = ScanConfig(bits=144, max_distance=14, with_variants=True, aspect_filter=False)
    fps = scan.scan_fingerprints(Q.image_fingerprints(spark, sf).withColumn("id", F.col("id").cast("long")))
    edges = scan.match_edges(Q.catalogue(spark, sf), fps, config)
    label = {i: i for i in known}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in known:
        for j in known:
            if i < j and min(bits(x, y) for x in sides[i] for y in sides[j]) <= 14:
                label[root(j)] = root(i)
    want = {i: min(j for j in known if root(j) == root(i)) for i in known}
    got = {r["node"]: r["component"] for r in connected_components(edges.select("src", "dst")).collect()}
    assert got == {i: g for i, g in want.items() if sum(x == g for x in want.values()) > 1}


def test_streams_go_on_after_a_restart(spark, tmp_path):
    path = f"file://{tmp_path}/restart"
    edge = lambda a, b: spark.createDataFrame([(a, b)], "src long, dst long")
    progressive.ProgressiveGroups(spark, path)(edge(1, 2), 0)
    again = progressive.ProgressiveGroups(spark, path)
    again(edge(2, 3), 1)
    progressive.ProgressiveGroups(spark, path)(edge(2, 3), 1)  # the batch is given once more
    held = {(r["group_id"], r["id"]) for r in progressive.current_groups(progressive.emissions(spark, path)).collect()}
    assert held == {(1, 1), (1, 2), (1, 3)}
    rows = lambda *x: spark.createDataFrame(list(x), "file_id long, seq long, removed boolean")
    table = lambda: progressive.ChangeTable(spark, "file_id bigint, seq bigint, removed boolean", path=f"{path}-changes")
    table()(rows((1, 1, False), (2, 1, False)), 0)
    for _ in range(2):
        table()(rows((1, 2, True)), 1)
    assert sorted(tuple(r) for r in table().table.collect()) == [(1, 2, True), (2, 1, False)]


def test_deep_folders_are_listed(spark):
    f = spark.createDataFrame([(str(i), str(i - 1)) for i in range(1, 56)], "id string, parent_id string")
    assert folders.breadth_first(f, spark.createDataFrame([("0",)], "id string")).count() == 56


def test_numbers_follow_the_order(spark):
    rows = spark.range(500).select(((F.col("id") * 7919) % 500).alias("id"), F.lit("g").alias("group_id"))
    assert all(r["at"] == r["id"] + 1 for r in G.numbered(rows.repartition(7), "id", name="at").collect())


def test_pages_of_a_folder_give_each_file_once(spark):
    rows = spark.createDataFrame([(i, f"n{i % 3}", "p" if i % 5 else "q") for i in range(40)], "id int, name string, parent_id string")
    got, after = [], None
    while found := [(r["name"], r["id"]) for r in readers.listing_page(rows, "p", 7, after).collect()]:
        got, after = got + found, found[-1]
    assert got == sorted((f"n{i % 3}", i) for i in range(40) if i % 5)


def test_broken_cache_lines_come_with_an_error(spark, tmp_path):
    (tmp_path / "cache.json").write_text('{"id": "a", "d8": 5}\n{"id": "b", \n{"id": "c", "d8": "x"}\n')
    rows = {r["id"]: (r["d8"], r["error"]) for r in readers.import_cache(spark, str(tmp_path), "id string, d8 bigint").collect()}
    assert rows["a"] == (5, None) and rows["c"] == (None, '{"id": "c", "d8": "x"}')
    assert [e for _, e in rows.values() if e and e.startswith('{"id": "b"')]
