"""Pools, logs, stores, samplers."""

import json
import re

import pytest
from pyspark.sql import functions as F

from siftwork.operators import sampling as S
from siftwork.operators.common import assert_covers, assert_unique, resolve_budget, skewed_join
from siftwork.sources import logs as L
from siftwork.sources import pool as P
from siftwork.sources import tables as T

ROWS = [{"instruction": f"q{i}", "response": f"a {i}", "source": "s"} for i in range(8)]


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n\n")
    return str(path)


def test_pool_round_trip_keeps_ids(spark, tmp_path):
    a = P.read_pool(spark, lines(tmp_path / "p.jsonl", ROWS))
    P.write_pool(a, str(tmp_path / "out"))
    b = P.read_pool(spark, str(tmp_path / "out"))
    assert {r.sample_id for r in a.collect()} == {r.sample_id for r in b.collect()} and b.count() == 8


def test_bad_pools_fail(spark, tmp_path):
    with pytest.raises(ValueError, match="not a pool row"):
        P.read_pool(spark, lines(tmp_path / "a", [*ROWS, {"instruction": "only"}]))
    with pytest.raises(ValueError, match="duplicate"):
        P.read_pool(spark, lines(tmp_path / "b", [*ROWS, ROWS[0]]))
    with pytest.raises(ValueError, match="empty"):
        P.read_pool(spark, lines(tmp_path / "c", [""]))
    assert P.read_pool(spark, lines(tmp_path / "d", [*ROWS, ROWS[0], "{bad"]), strict=False, unique=False).count() == 8


def test_external_scores_are_validated(spark):
    pool = spark.createDataFrame([(1,), (2,)], "sample_id int")
    ok = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "sample_id int, ifd double")
    assert T.join_external_scores(pool, ok).count() == 2
    with pytest.raises(ValueError, match="missing"):
        T.join_external_scores(pool, ok.where("sample_id <> 2"))
    with pytest.raises(ValueError, match="duplicate"):
        T.join_external_scores(pool, ok.union(ok))
    with pytest.raises(ValueError, match="sample_id"):
        T.join_external_scores(pool, ok.drop("sample_id"))


def test_missing_log_is_empty_and_nan_is_null(spark, tmp_path):
    assert L.read_log(spark, str(tmp_path / "none"), L.RESULT_SCHEMA).count() == 0
    d = spark.createDataFrame([('{"method":"m","metric":NaN,"extra":{"level":"L1"}}',), ("",)], "value string")
    r = L.with_extra_columns(L.parse_results(d)).collect()
    assert len(r) == 1 and r[0]["metric"] is None and r[0]["level"] == "L1"


def test_signature_store_prunes_sites(spark, tmp_path):
    d = spark.createDataFrame([(i, la, m, [0.5]) for i in range(3) for la in (3, 7) for m in ("a", "b")], "sample_id int, layer int, module string, g array<double>")
    T.write_signatures(d, str(tmp_path / "sig"))
    r = T.read_signatures(spark, str(tmp_path / "sig"), [(3, "a")])
    plan = r._jdf.queryExecution().executedPlan().toString()
    assert r.count() == 3 and re.search(r"PartitionFilters: \[[^\]]*layer", plan)
    assert T.read_signatures(spark, str(tmp_path / "sig"), []).count() == 0


def test_guards(spark):
    d = spark.createDataFrame([(1,), (1,)], "sample_id int")
    with pytest.raises(ValueError):
        assert_unique(d)
    with pytest.raises(ValueError):
        assert_covers(d, spark.createDataFrame([(2,)], "sample_id int"))


def test_budget_rule(spark):
    d = spark.range(10)
    for b, want in ((1, 1), (1.0, 1), (3, 3), (0.25, 2), (0.01, 1), (0.35, 4)):
        assert spark.range(1).select(resolve_budget(d, b).alias("k")).head()["k"] == want
    assert spark.range(1).select(resolve_budget(d, fraction=1.0).alias("k")).head()["k"] == 10


def test_sketch_thirds_and_small_pools(spark):
    d = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(120)], "sample_id int, response string")
    s = S.sketch_members(d, 32).toPandas()
    assert len(s) == 32 and sorted(s.groupby("stratum").size()) == [10, 11, 11]
    assert set(s.sample_id) == set(S.sketch_members(d.repartition(5), 32).toPandas().sample_id)
    assert S.sketch_members(d.limit(20), 32).count() == 20


def test_coverage_fills_and_stops(spark):
    pool = spark.createDataFrame([(i, i % 4) for i in range(8)], "sample_id int, cluster_id int")
    cfg = spark.createDataFrame([("a", "lora", 8, None, None), ("b", "adapter", None, 64, None)], "config string, family string, rank int, bottleneck int, prefix_len int")
    five = S.coverage_triples(pool, cfg, ["t"], 5).toPandas()
    assert len(five) == 5 and len(five.groupby(["cluster_id", "family"])) == 5
    assert S.coverage_triples(pool, cfg, ["t"], 100).count() == 16


def test_salted_join_is_exact(spark):
    left = spark.range(5000).select((F.col("id") % 7 * (F.col("id") % 2)).alias("k"), "id")
    right = spark.createDataFrame([(i, f"v{i}") for i in range(7)], "k bigint, v string")
    a = skewed_join(left, right, "k", rows_per_task=100)
    assert a.count() == 5000 and a.exceptAll(left.join(right, "k").select(*a.columns)).isEmpty()
