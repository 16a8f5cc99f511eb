"""Utility model: proxy regression, residual and ranking heads, uncertainty, calibration.

Every fit is a Spark ML estimator over a long (sample, configuration) table; all
targets are scored by one transform.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import vectors as V
from siftwork.operators import metrics as M
from siftwork.operators.sampling import rank_pairs

WEIGHTS = (1.0, 0.3, 0.5, 0.2)  # rank, regression, proxy, uncertainty
SIGMA_FLOOR = 1e-3


def features(z_x: str | None = "z_x", z_p: str | None = "z_p", z_t: str | None = None, rank: int = 4) -> Column:
    """[z_x, z_p, z_t] and the products of the leading ``rank`` entries of z_x and z_p.

    Leaving a part out gives the condition ablations.
    """
    parts = [F.col(c).cast("array<double>") for c in (z_x, z_p, z_t) if c]
    if z_x and z_p and rank:
        lead = F.slice(z_p, 1, rank)
        parts.append(F.flatten(F.transform(F.slice(z_x, 1, rank), lambda a: F.transform(lead, lambda b: a * b))))
    return array_to_vector(F.concat(*parts))


@dataclass
class Scorer:
    proxy: LinearRegressionModel
    residual: LinearRegressionModel | None = None
    ranker: LogisticRegressionModel | None = None
    spread: LinearRegressionModel | None = None
    parts: dict = field(default_factory=dict)  # arguments of ``features``
    weights: tuple = WEIGHTS

    def score(self, df: DataFrame) -> DataFrame:
        """Add mu and sigma."""
        d = df.withColumn("_f", features(**self.parts))
        d = self.proxy.transform(d)
        mu = F.col("_proxy")
        blend = sum(w for w, m in zip(self.weights, (self.ranker, self.residual)) if m is not None)
        if self.residual is not None:
            d = self.residual.transform(d)
            mu = mu + F.lit(self.weights[1] / blend) * F.col("_residual")
        if self.ranker is not None:
            d = self.ranker.transform(d)
            # margin of a linear ranker, squashed to the scale of utilities
            mu = mu + F.lit(self.weights[0] / blend) * (1 / (1 + F.exp(-F.get(vector_to_array("_rank_raw"), 1))) - 0.5)
        d = d.withColumn("mu", mu)
        sigma = F.lit(0.0)
        if self.spread is not None:
            d = self.spread.transform(d)
            sigma = F.greatest(F.exp(0.5 * F.least(F.col("_log_var"), F.lit(20.0))), F.lit(SIGMA_FLOOR))
        return d.withColumn("sigma", sigma).select(*df.columns, "mu", "sigma")

    def save(self, path: str) -> None:
        for name in ("proxy", "residual", "ranker", "spread"):
            m = getattr(self, name)
            if m is not None:
                m.write().overwrite().save(f"{path}/{name}")
        spark = SparkSession.active()
        row = [(str(k), v if v is None else str(v)) for k, v in self.parts.items()]
        spark.createDataFrame(row, "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/parts")


def load_scorer(spark: SparkSession, path: str) -> Scorer:
    from siftwork.sources.logs import _exists

    def get(name, cls):
        return cls.load(f"{path}/{name}") if _exists(spark, f"{path}/{name}") else None

    parts = {}
    for r in spark.read.schema("key string, value string").json(f"{path}/parts").collect():
        parts[r["key"]] = int(r["value"]) if r["key"] == "rank" else r["value"]
    return Scorer(
        get("proxy", LinearRegressionModel),
        get("residual", LinearRegressionModel),
        get("ranker", LogisticRegressionModel),
        get("spread", LinearRegressionModel),
        parts,
    )


def _linear(label: str, out: str, reg: float, loss: str = "squaredError") -> LinearRegression:
    return LinearRegression(
        featuresCol="_f", labelCol=label, predictionCol=out, regParam=reg, loss=loss, maxIter=50, standardization=True
    )


def fit_proxy(triples: DataFrame, parts: dict | None = None, reg: float = 1e-3) -> Scorer:
    """Phase A: regress u_lo on all triples."""
    parts = parts or {}
    d = triples.where("u_lo is not null").withColumn("_f", features(**parts))
    return Scorer(_linear("u_lo", "_proxy", reg).fit(d.select("_f", "u_lo")), parts=parts)


def fit_joint(labelled: DataFrame, scorer: Scorer, by: list[str], pairs_per_bucket: int = 256, reg: float = 1e-2, id_col: str = "sample_id") -> Scorer:
    """Phase B: residual head (Huber) on u_hi, pairwise ranking head, spread head."""
    d = labelled.where("u_hi is not null").withColumn("_f", features(**scorer.parts))
    d = scorer.proxy.transform(d).withColumn("_gap", F.col("u_hi") - F.col("_proxy"))
    residual = _linear("_gap", "_residual", reg, "huber").fit(d.select("_f", "_gap"))
    ranker = fit_ranker(d, by, pairs_per_bucket, reg, id_col)
    joint = Scorer(scorer.proxy, residual, ranker, None, scorer.parts, scorer.weights)
    s = joint.score(labelled.where("u_hi is not null"))
    s = s.withColumn("_f", features(**scorer.parts)).withColumn("_lv", F.log(F.pow(F.col("u_hi") - F.col("mu"), 2) + 1e-6))
    joint.spread = _linear("_lv", "_log_var", reg).fit(s.select("_f", "_lv"))
    return joint


def fit_ranker(d: DataFrame, by: list[str], pairs_per_bucket: int, reg: float, id_col: str = "sample_id") -> LogisticRegressionModel | None:
    """A linear ranker: logistic regression without intercept on feature differences of label pairs."""
    p = rank_pairs(d, "u_hi", by, pairs_per_bucket, id_col=id_col).where("left_u <> right_u")
    f = d.select(*by, id_col, vector_to_array("_f").alias("_a"))
    left = f.withColumnsRenamed({id_col: "left_id", "_a": "_l"})
    right = f.withColumnsRenamed({id_col: "right_id", "_a": "_r"})
    j = p.join(left, [*by, "left_id"]).join(right, [*by, "right_id"])
    diff = F.when(F.col("pair_no") % 2 == 0, V.subtract("_l", "_r")).otherwise(V.subtract("_r", "_l"))
    win = F.when(F.col("pair_no") % 2 == 0, F.col("left_u") > F.col("right_u")).otherwise(F.col("right_u") > F.col("left_u"))
    t = j.select(array_to_vector(diff).alias("_f"), win.cast("double").alias("_y"))
    if t.select("_y").distinct().count() < 2:
        return None
    return LogisticRegression(
        featuresCol="_f", labelCol="_y", predictionCol="_rank", rawPredictionCol="_rank_raw", probabilityCol="_rank_p", fitIntercept=False, regParam=reg, maxIter=50
    ).fit(t)


# ---------------------------------------------------------------- loss values


def huber(err: Column, delta: float = 1.0) -> Column:
    a = F.abs(err)
    return F.when(a <= delta, 0.5 * err * err).otherwise(delta * (a - 0.5 * delta))


def loss_values(df: DataFrame, by: list[str]) -> DataFrame:
    """Huber regression, proxy distillation and heteroscedastic likelihood of (mu, sigma, u_hi, u_lo)."""
    var = F.pow("sigma", F.lit(2.0))
    gap = F.col("u_hi") - F.col("mu")
    return df.groupBy(*by).agg(
        F.avg(huber(F.col("mu") - F.col("u_hi"))).alias("reg"),
        F.avg(huber(F.col("mu") - F.col("u_lo"))).alias("proxy"),
        F.avg(0.5 * gap * gap / var + 0.5 * F.log(var)).alias("unc"),
    )


def pairwise_loss(pairs: DataFrame, by: list[str]) -> DataFrame:
    """-log sigmoid(sign(u_i - u_j) (mu_i - mu_j)) averaged over pairs (left_mu, right_mu, left_u, right_u)."""
    z = F.signum(F.col("left_u") - F.col("right_u")) * (F.col("left_mu") - F.col("right_mu"))
    return pairs.groupBy(*by).agg(F.avg(F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))).alias("rank"))


def combined_loss(losses: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    w = dict(zip(("rank", "reg", "proxy", "unc"), weights))
    total = sum((F.lit(w[c]) * F.col(c) for c in w if c in losses.columns), F.lit(0.0))
    return losses.withColumn("total", total)


# ------------------------------------------------------------- choice, calibration


def choose(train: DataFrame, held_out: DataFrame, by: list[str], regs: list[float], parts: dict | None = None) -> tuple[Scorer, DataFrame]:
    """Fit per candidate and keep the one with the best held-out NDCG."""
    best, rows = None, []
    for reg in regs:
        s = fit_joint(train, fit_proxy(train, parts, reg), by, reg=reg)
        d = s.score(held_out).select(*by, "sample_id", F.col("mu").alias("pred"), F.col("u_hi").alias("truth"))
        value = M.ndcg(d, by).agg(F.avg("ndcg_at_k").alias("v")).head()["v"]
        rows.append((float(reg), float(value)))
        if best is None or value > best[0]:
            best = (value, s)
    return best[1], SparkSession.active().createDataFrame(rows, "reg double, ndcg double")


def fit_calibration(scored: DataFrame, parts: dict | None = None, reg: float = 1e-1) -> LinearRegressionModel:
    """Linear residual u_hi - mu on the inputs, for a new target with few labels."""
    d = scored.withColumn("_f", features(**(parts or {}))).withColumn("_gap", F.col("u_hi") - F.col("mu"))
    return _linear("_gap", "_shift", reg).fit(d.select("_f", "_gap"))


def apply_calibration(scored: DataFrame, head: LinearRegressionModel, parts: dict | None = None) -> DataFrame:
    d = head.transform(scored.withColumn("_f", features(**(parts or {}))))
    return d.withColumn("mu", F.col("mu") + F.col("_shift")).drop("_f", "_shift")


def calibration_error(df: DataFrame, by: list[str], bins: int = 10, sigma: str = "sigma", err: str = "err", max_sigma: float | None = None) -> DataFrame:
    """Weighted |mean sigma - rmse| over equal-width sigma bins."""
    top = F.lit(max_sigma) if max_sigma else df.agg(F.max(sigma)).scalar()
    d = df.withColumn("_top", top)
    b = F.least(F.floor(F.col(sigma) / F.nullif("_top", F.lit(0.0)) * bins), F.lit(bins - 1))
    g = d.groupBy(*by, F.coalesce(b, F.lit(0)).alias("_b")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(sigma).alias("s"), F.sqrt(F.avg(F.col(err) * F.col(err))).alias("r")
    )
    return g.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("s") - F.col("r"))) / F.sum("n")).alias("ece"))
