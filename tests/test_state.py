from pyspark.sql import functions as F

from twinsift.sources.state import StateTable, remaining_seconds


def test_state(spark, tmp_path):
    s = StateTable(spark, f"file://{tmp_path}/state")
    assert s.get("a") is None and s.get("a", 5) == 5 and s.token() is None
    s.put("a", {"x": 1}, 1.0)
    s.put("a", {"x": 2}, 2.0)
    assert s.get("a") == {"x": 2}
    s.delete("a", 3.0)
    assert s.get("a", "gone") == "gone"
    s.set_token(7, 1.0)
    assert StateTable(spark, f"file://{tmp_path}/state").token() == 7


def test_resume_expires(spark, tmp_path):
    s = StateTable(spark, f"file://{tmp_path}/state")
    s.save_resume(["f"], [], 3, {"bits": 144}, now=1000.0)
    assert s.load_resume(now=1000.0 + 86400)["found"] == 3
    assert s.load_resume(now=1001.0 + 86400) is None


def test_remaining(spark):
    row = spark.range(1).select(remaining_seconds(F.lit(25), F.lit(10.0)), remaining_seconds(F.lit(0), F.lit(1.0)), remaining_seconds(F.lit(100), F.lit(1.0))).first()
    assert row == (30.0, None, 0.0)
