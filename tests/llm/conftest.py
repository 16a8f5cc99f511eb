import pytest
from pyspark.sql import Row
from samples import sentence

@pytest.fixture(scope="session")
def make(spark):
    """Rows (id, text) as a table with extra columns whose names clash with those that operators add or use."""

    def table(rows, **extra):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, score double, kept string, h bigint"
        data = [
            Row(doc_id=i, text=t, lang=None, source=extra.get("source", lambda i: "s")(i), n_chars=None if t is None else len(t), size=-1, score=None, kept="x", h=5)
            for i, t in rows
        ]
        return spark.createDataFrame(data, schema)

    return table


@pytest.fixture(scope="session")
def odd_rows():
    """NULLs, empty and blank texts, ties, repeats, and one long text."""
    long = sentence(3, 6000)
    return [
        (1, sentence(1, 80)),
        (2, sentence(1, 80)),
        (3, None),
        (4, ""),
        (5, " \n\t \n"),
        (6, "One"),
        (7, sentence(2, 40) + "\n" + sentence(1, 60) + "\n" + sentence(2, 40)),
        (8, long),
        (9, long + " tail"),
        (9, long + " tail"),
        (10, sentence(4, 30)),
        (10, sentence(5, 30)),
        (None, sentence(1, 80)),
        (None, None),
        (11, "ÀÉ  Z\x0bq\x0c\r\n" + sentence(6, 12)),
    ]
