import pytest
from pyspark.sql import functions as F

from twinsift.functions import distances as D
from twinsift.functions import predicates as C
from twinsift.functions.fingerprints import flip_h, flip_v


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("name, ext", [("A.JPG?x=1", ".jpg"), ("noext", ""), (".png", ".png"), ("a.tar.gz", ".gz"), (None, ""), ("a#b.png", "")])
def test_extension(spark, name, ext):
    assert one(spark, C.extension(F.lit(name).cast("string")))[0] == ext


@pytest.mark.parametrize("mime, name, kept", [("application/octet-stream", "a.zip", False), ("application/octet-stream", "a.psd", True), ("image/gif", "x", True), (None, "a.tga", True), (None, None, False)])
def test_supported(spark, mime, name, kept):
    assert one(spark, C.is_supported(F.lit(mime).cast("string"), F.lit(name).cast("string")))[0] is kept


@pytest.mark.parametrize("a, b, ok", [((16, 9), (9, 16), True), ((4, 3), (16, 9), False), ((None, 3), (16, 9), True), ((0, 3), (16, 9), True), ((4, 3), (4, 3), True)])
def test_aspect(spark, a, b, ok):
    cols = [F.lit(x).cast("int") for x in (*a, *b)]
    assert one(spark, C.aspect_compatible(*cols), C.aspect_compatible(cols[2], cols[3], cols[0], cols[1])) == (ok, ok)


@pytest.mark.parametrize("d, pct", [(0, 100), (1, 99), (10, 93), (72, 50), (144, 0), (None, None)])
def test_percent(spark, d, pct):
    assert one(spark, D.percent(F.lit(d).cast("int")))[0] == pct


@pytest.mark.parametrize("pct, name", [(100, "identical"), (99, "near"), (90, "near"), (89, "similar"), (75, "similar"), (74, "loose"), (None, None)])
def test_badge(spark, pct, name):
    assert one(spark, D.badge(F.lit(pct).cast("int")))[0] == name


@pytest.mark.parametrize("pd, dist", [(4, 9), (5, 11), (6, 60)])
def test_phash_scale(spark, pd, dist):
    assert one(spark, D.with_phash(F.lit(60), F.lit(pd), D.phash_bound(10)))[0] == dist


def test_ladder(spark):
    lit = lambda x: F.lit(x)
    assert one(spark, D.extended_distance(lit(60), 10, lit(12), parity=True))[0] == 12
    assert one(spark, D.extended_distance(lit(60), 10, lit(12)))[0] == 60
    assert one(spark, D.extended_distance(lit(20), 10, combined=lit(0.05)))[0] == 10
    assert one(spark, D.extended_distance(lit(21), 10, combined=lit(0.05)))[0] == 21
    assert one(spark, D.extended_distance(lit(3), 10, lit(1), lit(0.5)))[0] == 3


def test_missing_sides_are_null(spark):
    none = F.lit(None).cast("bigint")
    arr = F.array(F.lit(1).cast("bigint"))
    assert one(spark, D.best_distance(none, arr, F.lit(1).cast("bigint"), arr))[0] is None
    assert one(spark, D.best_crop_distance(F.lit(1).cast("bigint"), F.array().cast("array<bigint>"), F.lit(1).cast("bigint"), arr))[0] is None
    assert one(spark, D.combined_hist_distance(F.lit(None).cast("double"), F.lit(0.5)))[0] == 0.5


def test_flips_are_involutions(spark):
    v = F.array(*map(F.lit, range(64)))
    assert list(one(spark, flip_h(flip_h(v)))[0]) == list(range(64)) == list(one(spark, flip_v(flip_v(v)))[0])


def test_human(spark):
    got = [one(spark, C.bytes_to_human(F.lit(n)))[0] for n in (0, 500, 1536, 20480, 5 * 1024**3)]
    assert got == ["—", "500 B", "1.5 KB", "20 KB", "5.0 GB"]
    assert one(spark, C.escape_html(F.lit("<a & 'b'>")))[0] == "&lt;a &amp; &#39;b&#39;&gt;"
    assert one(spark, C.sized_link(F.lit("http://x/y=s220")), C.sized_link(F.lit("http://x/y"))) == ("http://x/y=s256", "http://x/y=s256")
