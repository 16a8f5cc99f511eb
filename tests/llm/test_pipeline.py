import re
from collections import Counter

import pytest
from samples import sentence

import corpus_pipeline as cp
from siftwork.llm.queries import ORACLES, QUERIES


@pytest.fixture
def folder(spark, make, tmp_path):
    shared = sentence(8080, 12)
    rows = [(i, sentence(i, 80) + ".\n" + sentence(700 + i, 30)) for i in range(200)]
    rows += [(200 + i, " ".join(w.upper() + "!!" for w in sentence(i, 60).split(" "))) for i in range(60)]
    rows += [(300, rows[5][1]), (301, rows[6][1].replace(" ", "  ")), (302, sentence(90, 30) + "\n" + sentence(91, 40)), (303, None), (304, "")]
    rows += [(310 + i, sentence(400 + i, 40) + "\n" + shared) for i in range(10)]
    make(rows, source=lambda i: None if i is None else f"s{i % 4}").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 200), 0) for i in range(260)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, sentence(90, 30))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, folder)
        left[name] = docs.collect()
        if name != "mixing":
            assert docs.columns == columns
        docs = spark.createDataFrame(left[name], docs.schema)
    ids = {n: [r.doc_id for r in rows] for n, rows in left.items()}
    assert not set(range(200, 260)) & set(ids["quality"]) and set(range(200)) <= set(ids["quality"])
    lines = {r.doc_id: r.text for r in left["line_dedup"]}
    assert 300 not in lines  # an exact copy loses all its lines
    assert sum(sentence(8080, 12) in t for t in lines.values() if t) == 1
    assert 301 not in ids["near_dedup"] and 6 in ids["near_dedup"]
    assert 302 in ids["near_dedup"] and 302 not in ids["decontamination"]
    assert set(ids["decontamination"]) == set(ids["near_dedup"]) - {90, 302}  # the item is the beginning of document 90, too
    size = Counter()
    for r in left["decontamination"]:
        size[r.source] += len(re.findall(r"\S+", r.text or ""))
    taken = Counter()
    for r in left["mixing"]:
        taken[r.source] += r.taken
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= len(size)
    assert sorted(map(str, ids["mixing"])) == sorted(str(r.doc_id) for r in cp.run(spark, folder).collect())


def test_rows_without_id_or_with_one_id_are_told_apart(spark, make, tmp_path):
    near, item = sentence(1, 80), sentence(90, 30)
    rows = [(1, near), (None, near.replace(" ", "  ")), (None, sentence(2, 80)), (7, near + " "), (7, sentence(3, 80)), (7, sentence(4, 20) + " " + item), (None, sentence(5, 20) + " " + item)]
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = cp.near_dedup(spark, make(rows), str(tmp_path)).collect()
    left = {rows[i] for i in (0, 2, 4, 5, 6)}
    assert {(r.doc_id, r.text) for r in out} == left and len(out) == 5
    out = cp.decontamination(spark, make(sorted(left, key=str)), str(tmp_path)).collect()
    assert {(r.doc_id, r.text) for r in out} == {rows[i] for i in (0, 2, 4)} and len(out) == 3


def test_names():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in sorted(QUERIES, key=lambda n: int(re.match(r"op(\d+)_", n)[1]))] == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
