import collections
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[1]))
import brute  # noqa: E402
from oracle import connect, oracle_rows, rows_of  # noqa: E402

import corpus_pipeline  # noqa: E402
from twinsift.llm import langid  # noqa: E402
from twinsift.llm.registry import oracle_sql, queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, sf, name):
    assert rows_of(queries()[name](spark, sf)) == oracle_rows(connect(sf), oracle_sql()[name])


def test_pipeline_is_its_stages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    langs = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    rows = [r for r in docs.collect() if langs[r["doc_id"]]["lang_pred"] != "und" and langs[r["doc_id"]]["score"] >= 0.5]
    named = brute.simhash_components([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r, (d, _, c) in zip(rows, named, strict=True) if d == c]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute.contamination([(r["doc_id"], r["text"]) for r in rows], items)
    rows = {r["doc_id"]: r for r, h in zip(rows, hits, strict=True) if not h[1]}
    out = corpus_pipeline.run(spark, sf).collect()
    sizes = collections.Counter()
    for r in rows.values():
        sizes[r["source"]] += len(brute.words(r["text"]))
    want, got, times = brute.targets(sizes), collections.Counter(), collections.Counter()
    for r in out:
        assert r["text"] == rows[r["doc_id"]]["text"] and r["lang"] == langs[r["doc_id"]]["lang_pred"]
        assert r["shard"] == brute.jump(brute.stable_key(r["doc_id"]), 40)
        got[r["source"]] += len(brute.words(r["text"]))
        times[r["doc_id"]] += 1
    assert max(times.values()) <= 2
    largest = max(len(brute.words(r["text"])) for r in rows.values())
    assert all(abs(got[s] - want[s]) <= largest for s in want)


def test_stages_pass_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0 and docs.columns[-1] == "shard"
