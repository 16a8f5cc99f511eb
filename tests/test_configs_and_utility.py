"""Configuration encoding, site weights, utilities and labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.operators import configs as C
from siftwork.operators import utility as U
from siftwork.sources import registry as R


def test_every_spec_encodes_on_every_backbone(spark):
    for model, *_ in R.MODELS:
        d = C.encode(R.with_model(R.specs(spark), model)).select(
            "name", F.size("z_p").alias("n"), F.aggregate("site_alpha", F.lit(0.0), lambda s, x: s + x).alias("t"), "n_active"
        ).toPandas()
        assert len(d) == 17 and (d["n"] == 128).all()
        assert np.allclose(d["t"], (d["n_active"] > 0).astype(float))


def test_unknown_names_fail(spark):
    with pytest.raises(KeyError):
        R.specs(spark, ["nope"])
    with pytest.raises(KeyError):
        R.with_model(R.specs(spark), "nope")


def test_fingerprint_is_appended_and_ids_are_stable(spark):
    d = C.with_layers(R.with_model(R.specs(spark, ["AD-b64", "L-r8-qv"])))
    a = d.select("name", C.config_id().alias("i")).toPandas()
    b = d.repartition(3).select("name", C.config_id().alias("i")).toPandas()
    assert dict(a.values) == dict(b.values) and a["i"].is_unique and (a["i"].str.len() == 16).all()
    f = C.encode(d.withColumn("fp", F.array_repeat(F.lit(0.5), 64)), fingerprint="fp")
    assert f.select(F.size("z_p")).head()[0] == 192


def test_utility_is_one_for_equal_and_zero_for_orthogonal(spark):
    unit = [1.0, 0.0, 0.0, 0.0]
    other = [0.0, 1.0, 0.0, 0.0]
    sig = spark.createDataFrame([(s, j, unit if s < 2 else other) for s in range(3) for j in range(24)], "sample_id int, site int, g array<double>")
    task = spark.createDataFrame([(j, unit) for j in range(24)], "site int, t array<double>")
    w = C.with_site_weights(R.with_model(R.specs(spark))).select(F.col("name").alias("config"), "site_alpha")
    u = U.utilities(U.site_similarities(sig, task), w).toPandas()
    assert np.allclose(u[u.sample_id < 2].u_lo, 1.0) and np.allclose(u[u.sample_id == 2].u_lo, 0.0)
    long = w.select("config", F.posexplode("site_alpha").alias("site", "alpha"))
    v = U.utilities_by_site(sig, task, long).toPandas()
    assert np.allclose(v[v.sample_id < 2].u_lo, 1.0)


def test_labels(spark):
    rows = [(f"s{i}", "p", "t", a, h, s * i * (1 + 0.1 * h)) for i in range(4) for a, s in ((0, 1.0), (1, 5.0)) for h in (1, 4)]
    d = spark.createDataFrame(rows, "sample_id string, peft_id string, task_id string, anchor_idx bigint, horizon bigint, delta_raw double")
    out = U.aggregate_labels(U.rank_normalised(d)).orderBy("sample_id").toPandas()
    assert len(out) == 4 and np.allclose(out["u_hi"], [0, 1 / 3, 2 / 3, 1]) and np.allclose(out["sigma_est"], 0)
    assert U.aggregate_labels(U.rank_normalised(d.where("1 = 0"))).count() == 0


def test_wide_projection_is_unit_and_repeatable(spark):
    rng = np.random.default_rng(0)
    d = spark.createDataFrame([(i, i % 2, rng.normal(size=12).tolist()) for i in range(20)], "sample_id bigint, site int, v array<double>")
    a = {r["sample_id"]: r["g"] for r in U.project_wide(d, 6).collect()}
    b = {r["sample_id"]: r["g"] for r in U.project_wide(d.repartition(4), 6).collect()}
    assert all(np.allclose(a[i], b[i]) and np.isclose(np.linalg.norm(a[i]), 1) for i in a)
