"""Heavy steps over tables of one file are dealt to all cores."""

import glob

import numpy as np
import pytest

from siftwork.operators import utility as U
from siftwork.plans import configurations, streams, utilities


@pytest.fixture
def tables(spark, tmp_path):
    """A folder with one-file tables of a few rows."""
    rng = np.random.default_rng(1)
    docs = [(i, f"q {i % 40}\nanswer {i % 40}", "en", "web") for i in range(90)]
    vecs = [(i, rng.normal(size=64).tolist(), i % 5) for i in range(90)]
    for name, rows, schema in (
        ("documents", docs, "doc_id bigint, text string, lang string, source string"),
        ("embeddings", vecs, "vec_id bigint, embedding array<float>, label int"),
        ("part", [(i, i % 50 + 1) for i in range(200)], "p_partkey bigint, p_size int"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_configurations_are_encoded_by_all_cores(spark, tables):
    d = configurations.instances(spark, tables)
    assert d.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and d.count() == 200
    assert configurations.e09(spark, tables).count() == 200 * 96


def test_projection_is_done_by_all_cores(spark, tables, monkeypatch):
    parts, project = [], U.project

    def seen(vectors, phi):
        parts.append(vectors.rdd.getNumPartitions())
        return project(vectors, phi)

    monkeypatch.setattr(U, "project", seen)
    assert utilities.c16(spark, tables).count() == 90 * 24 * 8
    assert parts[0] >= spark.sparkContext.defaultParallelism


def test_ingest_reads_batches_of_many_files(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "scratch_path", lambda spark, label: str(tmp_path / f"scratch-{label}"))
    out = streams.w03(spark, tables)
    assert out.count() == out.distinct().count() == 40
    assert len(glob.glob(str(tmp_path / "scratch-pool-log" / "part-*"))) >= spark.sparkContext.defaultParallelism
    assert len(glob.glob(str(tmp_path / "scratch-w03" / "rows" / "batch_id=*"))) == 3


def test_projection_of_odd_vectors(spark):
    phi = spark.createDataFrame([(0, [[1.0, 0.0], [0.0, 1.0]]), (1, [[0.0, 2.0], [0.0, 0.0]])], "site int, phi array<array<double>>")
    rows = [(1, 0, [3.0, 4.0]), (2, 1, [3.0, 4.0]), (3, 0, None), (4, 0, [1.0, None]), (5, 0, [1.0]), (6, 7, [1.0, 1.0]), (7, None, [1.0, 1.0]), (None, 0, [0.0, 0.0])]
    v = spark.createDataFrame(rows, "sample_id bigint, site int, v array<double>").coalesce(1)
    got = {r["sample_id"]: r["g"] for r in U.project(v, phi).collect()}
    assert got == {1: [0.6, 0.8], 2: [1.0, 0.0], 3: [None] * 2, 4: [None] * 2, 5: [None] * 2, None: [0.0, 0.0]}
