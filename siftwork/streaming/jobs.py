"""Streaming roll-ups, ingest and selection.

Each job takes a streaming DataFrame and a target folder, runs what is available
and stops. ``foreachBatch`` sinks write one folder per batch id, so that a retried
batch replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftwork.session import cut_lineage
from siftwork.streaming.tables import KeyStore, StateTable


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.json(path)


def _run(writer, checkpoint: str) -> None:
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def _append(df: DataFrame, target: str) -> DataFrame:
    spark = df.sparkSession
    _run(df.writeStream.outputMode("append").format("parquet").option("path", f"{target}/rows"), f"{target}/state")
    return spark.read.schema(df.schema).parquet(f"{target}/rows")


def cost_rollup(events: DataFrame, target: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """GPU hours by stage and window; a window is written once the watermark has passed it."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "stage").agg(
        F.sum("gpu_hours").alias("gpu_hours"), F.count(F.lit(1)).alias("n")
    )
    return _append(g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "stage", "gpu_hours", "n"), target)


def cost_sessions(events: DataFrame, target: str, gap: str = "30 minutes", late: str = "10 minutes", key: str = "run_id") -> DataFrame:
    """GPU hours per run and session; a session closes after ``gap`` without events."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(
        F.sum("gpu_hours").alias("gpu_hours"), F.count(F.lit(1)).alias("n")
    )
    return _append(g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "gpu_hours", "n"), target)


def merge_moments(tables: DataFrame, by: list[str]) -> DataFrame:
    """One row a key from at most two of (n, mean, m2): counts add up, squares gain the distance of the means."""
    n = F.sum("n")
    between = F.pow(F.max("mean") - F.min("mean"), 2) * F.product(F.col("n").cast("double")) / n
    both = tables.where("n > 0").groupBy(*by).agg(
        n.alias("n"),
        (F.sum(F.col("n") * F.col("mean")) / n).alias("mean"),
        (F.sum("m2") + F.when(F.count(F.lit(1)) > 1, between).otherwise(0.0)).alias("m2"),
    )
    keys = tables.select(*by).distinct()
    same = [keys[c].eqNullSafe(both[c]) for c in by]
    return keys.join(both, same, "left").select(
        *[keys[c] for c in by], F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "mean", F.coalesce("m2", F.lit(0.0)).alias("m2")
    )


def result_aggregates(results: DataFrame, target: str, by: list[str]) -> DataFrame:
    """Running mean, deviation and count per key; NaN metrics do not count.

    A batch is reduced to (n, mean, m2) per key and merged into the table that the batch before it left, so a batch
    reads its own rows and one row a key, however long the stream has run; a retried batch merges into the same
    version again.
    """
    spark = results.sparkSession
    kinds = dict(results.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "n bigint, mean double, m2 double"])
    state = StateTable(spark, f"{target}/table", schema)
    v = F.when(~F.isnan("metric"), F.col("metric"))

    def merge(batch: DataFrame, batch_id: int) -> None:
        part = batch.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias("m2"))
        state.write(merge_moments(state.before(batch_id).unionByName(part), by), batch_id)

    _run(results.writeStream.outputMode("append").foreachBatch(merge), f"{target}/state")
    std = F.when(F.col("n") > 0, F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / F.col("n"))).otherwise(F.lit(0.0))
    return state.latest().select(*by, "mean", std.alias("std"), "n")


def ingest(rows: DataFrame, target: str) -> DataFrame:
    """Rows with their content ids, each id once for good: the first batch that brings it keeps its earliest row.

    Ids of earlier batches lie in a key store; a batch reads only the parts of it that its own ids fall into, and is
    anti-joined with them, so copies are found however far apart they come. Rows and keys are written by batch: a
    retried batch does not see its own keys and replaces its own rows.
    """
    from siftwork.functions.ids import sample_id

    d = rows.withColumn("sample_id", sample_id())
    store = KeyStore(rows.sparkSession, f"{target}/keys", "sample_id")

    def take(batch: DataFrame, batch_id: int) -> None:
        others = [c for c in batch.columns if c not in ("sample_id", "ts")]
        first = batch.groupBy("sample_id").agg(F.min_by(F.struct("ts", *others), F.struct("ts", *others)).alias("r")).select("sample_id", "r.*")
        first = cut_lineage(first)
        prefixes = [r[0] for r in first.select(F.substring("sample_id", 1, 2)).distinct().collect()]  # 256 at most
        new = cut_lineage(first.join(store.before(batch_id, prefixes), "sample_id", "left_anti"))
        new.select(*batch.columns).write.mode("overwrite").parquet(f"{target}/rows/batch_id={batch_id}")
        store.write(new, batch_id)

    _run(d.writeStream.outputMode("append").foreachBatch(take), f"{target}/state")
    return rows.sparkSession.read.schema(d.schema).parquet(f"{target}/rows").select(*d.columns)


CUTOFF_STATE = "cluster_id int, bin bigint, n bigint"


def cutoffs(state: DataFrame, share: float, width: float) -> DataFrame:
    """(cluster_id, n_seen, cutoff): the lowest bin edge that at most ``share`` of the cluster's rows reach.

    ``state`` counts rows by cluster and bin of q (``floor(q / width)``); sums over bins stay within a cluster's
    bins, of which there are as many as the range of q holds.
    """
    w = W.partitionBy("cluster_id")
    above = F.sum("n").over(w.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, W.currentRow))
    d = state.withColumn("_above", above).withColumn("n_seen", F.sum("n").over(w))
    edge = F.min(F.when(F.col("_above") <= F.col("n_seen") * share, F.col("bin")))
    g = d.groupBy("cluster_id").agg(F.max("n_seen").alias("n_seen"), F.coalesce(edge, F.max("bin") + 1).alias("edge"))
    return g.select("cluster_id", "n_seen", (F.col("edge") * F.lit(width)).alias("cutoff"))


def apply_selection(new_rows: DataFrame, target: str, score, assign, first: DataFrame, share: float = 0.1, width: float = 0.001, penalty: float = 0.2) -> DataFrame:
    """Keep or leave new rows as they come: (the rows' columns, cluster_id, mu, sigma, is_ood, q, keep, batch_id).

    ``score`` maps a batch to one with mu, sigma and is_ood under a frozen model, ``assign`` to one with cluster_id
    of the nearest fixed centre; q = mu - penalty * sigma. ``first`` (cluster_id, q) are the rows of the last batch
    selection. Each cluster's counts of q are a keyed table: a row is kept if its q reaches the cut-off that all rows
    before its batch give (``cutoffs``); then the batch's rows enter the counts, and the next batch finds the cut-off
    moved. A cluster without earlier rows keeps nothing. A retried batch starts from the same counts.
    """
    spark = new_rows.sparkSession
    state = StateTable(spark, f"{target}/cutoffs", CUTOFF_STATE)

    def counted(d: DataFrame) -> DataFrame:
        return d.groupBy(F.col("cluster_id").cast("int").alias("cluster_id"), F.floor(F.col("q") / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))

    if not state.versions():
        state.write(counted(first), -1)

    def take(batch: DataFrame, batch_id: int) -> None:
        before = state.before(batch_id)
        d = assign(score(batch)).withColumn("q", F.col("mu") - F.lit(penalty) * F.col("sigma"))
        d = d.join(cutoffs(before, share, width).select("cluster_id", "cutoff"), "cluster_id", "left")
        reached = F.floor(F.col("q") / width) >= F.round(F.col("cutoff") / width)
        d = cut_lineage(d.withColumn("keep", F.coalesce(reached, F.lit(False))).drop("cutoff"))
        d.write.mode("overwrite").parquet(f"{target}/rows/batch_id={batch_id}")
        both = before.unionByName(counted(d)).groupBy("cluster_id", "bin").agg(F.sum("n").alias("n"))
        state.write(both, batch_id)

    _run(new_rows.writeStream.outputMode("append").foreachBatch(take), f"{target}/state")
    return spark.read.parquet(f"{target}/rows")
