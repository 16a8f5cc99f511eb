"""Streaming equals batch, late rows, model round trip, outliers, plug-ins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.operators import model as Q
from siftwork.operators import ood as O
from siftwork.operators import plugins
from siftwork.operators import tokens as K
from siftwork.streaming import jobs as J


def test_late_events_are_left_out_of_closed_windows(spark, tmp_path):
    path = str(tmp_path / "log")
    batches = [[("10:05", 1.0), ("10:50", 1.0)], [("13:00", 1.0)], [("10:10", 5.0), ("16:00", 1.0)]]
    schema = "ts timestamp, stage string, gpu_hours double"
    for i, b in enumerate(batches):
        d = spark.createDataFrame([(f"2024-01-01 {t}:00", "feat", h) for t, h in b], "ts string, stage string, gpu_hours double")
        d.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").json(path)
        out = J.cost_rollup(J.read_stream(spark, path, schema), str(tmp_path / "out"))
    got = {r["start"].hour: r["gpu_hours"] for r in out.collect()}
    assert got == {10: 2.0, 13: 1.0}


def test_running_aggregates_equal_the_batch(spark, tmp_path):
    d = spark.range(40).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 7 == 0, float("nan")).otherwise(F.col("id").cast("double")).alias("metric"))
    d.repartition(4).write.json(str(tmp_path / "r"))
    s = J.read_stream(spark, str(tmp_path / "r"), "k bigint, metric double", files_per_batch=1)
    got = {r["k"]: (round(r["mean"], 9), r["n"]) for r in J.result_aggregates(s, str(tmp_path / "o"), ["k"]).collect()}
    b = d.where("not isnan(metric)").groupBy("k").agg(F.avg("metric").alias("m"), F.count("*").alias("n"))
    assert got == {r["k"]: (round(r["m"], 9), r["n"]) for r in b.collect()}


def again(target):
    """Let the last micro-batch look as if it had failed before it was recorded."""
    commits = target / "state" / "commits"
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (commits / name).unlink(missing_ok=True)


def write_batches(spark, folder, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)


def test_running_aggregates_over_batches_and_retries(spark, tmp_path):
    rng = np.random.default_rng(1)
    batches = [[(int(k), float(v) if v < 1e6 + 2 else float("nan")) for k, v in zip(rng.integers(0, 4, 30), 1e6 + rng.normal(size=30))] for _ in range(4)]
    batches[2] = [(9, float("nan"))] + batches[2]
    write_batches(spark, str(tmp_path / "r"), batches, "k bigint, metric double")

    def run():
        s = J.read_stream(spark, str(tmp_path / "r"), "k bigint, metric double", files_per_batch=1)
        return {r["k"]: (r["mean"], r["std"], r["n"]) for r in J.result_aggregates(s, str(tmp_path / "o"), ["k"]).collect()}

    first = run()
    for k in range(4):
        v = np.array([x for b in batches for i, x in b if i == k and not np.isnan(x)])
        assert first[k][2] == len(v) and abs(first[k][0] - v.mean()) < 1e-8 and abs(first[k][1] - v.std()) < 1e-6
    assert first[9] == (None, 0.0, 0)
    assert sorted(p.name for p in (tmp_path / "o" / "table").iterdir() if p.is_dir()) == ["batch=2", "batch=3"]
    again(tmp_path / "o")
    assert run() == first


def test_ingest_finds_copies_days_apart_and_survives_a_retry(spark, tmp_path):
    schema = "instruction string, response string, source string, ts timestamp"
    text = "instruction string, response string, source string, ts string"
    batches = [
        [("a", "1", "s", "2024-01-01 00:00:05"), ("a", "1", "s", "2024-01-01 00:00:01"), ("b", "1", None, "2024-01-01 00:00:00")],
        [("a", "1", "s", "2024-01-09 00:00:00"), ("c", "1", "s", "2024-01-09 00:00:00")],
        [("c", "1", "s", "2024-02-09 00:00:00"), ("b", "1", None, "2024-02-09 00:00:00"), ("d", None, "s", "2024-02-09 00:00:00")],
    ]
    write_batches(spark, str(tmp_path / "in"), batches, text)

    def run():
        s = J.read_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1)
        return sorted((r["instruction"], str(r["ts"])) for r in J.ingest(s, str(tmp_path / "o")).collect())

    want = [("a", "2024-01-01 00:00:01"), ("b", "2024-01-01 00:00:00"), ("c", "2024-01-09 00:00:00"), ("d", "2024-02-09 00:00:00")]
    assert run() == want
    again(tmp_path / "o")
    assert run() == want


def test_cutoffs_move_from_batch_to_batch(spark, tmp_path):
    first = spark.createDataFrame([(1, q / 10) for q in range(10)] + [(2, 0.5)], "cluster_id int, q double")
    # share 0.2 of ten rows: two may reach the edge, so it is 0.8; forty rows above move it up
    batches = [[(i, 1, 0.95) for i in range(40)] + [(100, 1, 0.75), (101, 2, 0.4), (102, 3, 9.0)], [(200, 1, 0.85), (201, 1, 1.5), (202, 3, 9.5)]]
    write_batches(spark, str(tmp_path / "in"), batches, "sample_id bigint, cluster_id int, q0 double")

    def run():
        s = J.read_stream(spark, str(tmp_path / "in"), "sample_id bigint, cluster_id int, q0 double", files_per_batch=1)
        score = lambda b: b.withColumn("mu", F.col("q0")).withColumn("sigma", F.lit(0.0)).withColumn("is_ood", F.lit(False))
        out = J.apply_selection(s, str(tmp_path / "o"), score, lambda b: b, first, share=0.2, width=0.1)
        return {r["sample_id"]: r["keep"] for r in out.collect()}

    got = run()
    assert got[0] and not got[100] and not got[101] and not got[102]  # no row of cluster 3 came before
    assert not got[200] and got[201]  # 0.85 would have reached the first cut-off
    again(tmp_path / "o")
    assert run() == got


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(0)
    rows = []
    w = rng.normal(size=6)
    for i in range(150):
        x = rng.normal(size=6)
        u = 1 / (1 + np.exp(-x @ w))
        rows.append((i, f"c{i % 2}", x.tolist(), [1.0, float(i % 2)], float(x @ w) / 10, float(u)))
    return spark.createDataFrame(rows, "sample_id int, config string, z_x array<double>, z_p array<double>, u_lo double, u_hi double")


def test_scorer_ranks_and_reloads(spark, labelled, tmp_path):
    s = Q.fit_joint(labelled, Q.fit_proxy(labelled, {"rank": 2}), ["config"])
    out = s.score(labelled)
    assert out.select(F.corr("mu", "u_hi")).head()[0] > 0.8 and out.where("sigma <= 0").isEmpty()
    s.save(str(tmp_path / "m"))
    again = Q.load_scorer(spark, str(tmp_path / "m")).score(labelled).select("sample_id", F.col("mu").alias("b"))
    assert out.join(again, "sample_id").select(F.max(F.abs(F.col("mu") - F.col("b")))).head()[0] < 1e-9


def test_calibration_reduces_the_error(labelled):
    shifted = Q.fit_proxy(labelled).score(labelled)
    fixed = Q.apply_calibration(shifted, Q.fit_calibration(shifted))
    mse = F.avg(F.pow(F.col("u_hi") - F.col("mu"), 2))
    assert fixed.select(mse).head()[0] < shifted.select(mse).head()[0]


def test_outliers(spark):
    rng = np.random.default_rng(1)
    d = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(300)], "sample_id int, v array<double>")
    s = O.fit(d, "v")
    share = O.flag(d, s, "v").select(F.avg(F.col("is_ood").cast("double"))).head()[0]
    assert abs(share - 0.05) < 0.02
    far = spark.createDataFrame([(0, (s.mean + 50).tolist())], "sample_id int, v array<double>")
    assert O.flag(far, s, "v").head()["is_ood"]


def test_loss_is_minus_mean_log_probability_and_mask_falls_back(spark):
    d = spark.createDataFrame([(1, ["a", "b", "c"], [0, 1, 1]), (2, ["a", "b", "a"], [0, 0, 0]), (3, ["a"], [1])], "sample_id int, tokens array<string>, mask array<int>")
    t = K.token_stats(d).toPandas().set_index("sample_id")
    assert set(t.index) == {1, 2} and np.allclose(t["loss_mean"], -t["avg_logprob"])
    assert (t["loss_max"] >= t["loss_mean"]).all() and np.allclose(t["ppl"], np.exp(t["loss_mean"]))


def test_token_budget_keeps_the_response(spark):
    d = spark.createDataFrame([(list("abcdef"), list("xy"))], "i array<string>, r array<string>")
    for n, want, mask in ((5, list("efxy") + ["</s>"], [0, 0, 1, 1, 1]), (2, list("xy"), [1, 1]), (3, ["x", "y", "</s>"], [1, 1, 1])):
        r = K.with_token_budget(d, F.col("i"), F.col("r"), n).head()
        assert r["tokens"] == want and r["mask"] == mask


def mean_score():
    return "mean_score", F.avg("score")


def test_metric_plug_in(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "task string, score double")
    r = plugins.apply_metric(d, ["task"], f"{__name__}:mean_score").head()
    assert r["metric"] == 2.0 and r["metric_name"] == "mean_score"
