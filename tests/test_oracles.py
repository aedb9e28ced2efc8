import random

import duckdb
import pytest
from oracle import connect, oracle_rows, rows_of

from twinsift.operators import lsh
from twinsift.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    got = rows_of(QUERIES[name](spark, sf))
    if name in ORACLES:
        assert got == oracle_rows(con, ORACLES[name])
    else:
        assert got[1]


@pytest.fixture(scope="module")
def copied(spark, tmp_path_factory):
    """A folder whose embeddings hold vectors three times over, so that pairs of rows share their fingerprints."""
    d = str(tmp_path_factory.mktemp("copied"))
    rng = random.Random(5)
    base = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(8)]
    near = [[*v[:60], 9.0, *v[61:]] for v in base]
    rows = [(i, (base + near)[i % 16], 0) for i in range(48)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet/*.parquet'")
    return d, con


@pytest.mark.parametrize("name", ["lsh_multiprobe_candidates", "lossless_matches"])
def test_pairs_of_copies_are_not_dealt_again(spark, copied, name):
    """A pair is made once, or judged where it is made: no aggregate or join over the pairs tells them apart."""
    d, con = copied
    df = QUERIES[name](spark, d)
    got = rows_of(df)
    assert got[1] and got == oracle_rows(con, ORACLES[name])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") if name == "lsh_multiprobe_candidates" else "Aggregate" not in plan, plan


def test_a_repeated_id_keeps_all_its_probes(spark):
    """An id may come with several vectors; its pairs come once."""
    rows = [(1, 0x00FF, 0), (1, 0xFF00, 0), (2, 0x00FF, 0), (3, 0xFF01, 0), (4, 0x0F0F, 0)]
    rows = [(i, k if b == 0 else 64 * (i + b) % 256, b) for i, k, _ in rows for b in range(2)]
    df = spark.createDataFrame(rows, "id long, key long, band int")
    near = {(min(x, y), max(x, y)) for x, k, b in rows for y, m, c in rows if x != y and b == c and (k ^ m).bit_count() <= 1 and k ^ m < 256}
    got = [tuple(r) for r in lsh.multiprobe_candidates(df, 64, "loose").collect()]
    assert sorted(got) == sorted(near) and (1, 2) in near and (1, 3) in near


def test_a_rejected_pair_leaves_others_of_its_fingerprints(spark, copied):
    d, con = copied
    got = rows_of(QUERIES["rejected_anti_join"](spark, d))
    assert got[1] and got == oracle_rows(con, ORACLES["rejected_anti_join"])
