"""Near-duplicate removal against brute force, with a third of the rows in one family of copies."""

import random
import re

import pytest

from siftwork.operators import dedup as D
from siftwork.operators import setjoin as S
from siftwork.operators.gramfilter import bloom, only_likely
from siftwork.operators.graph import components


def grams(text, n=5):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    return {" ".join(w[i : i + n]) for i in range(max(len(w) - n, 0) + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    base = [rnd.choice(vocab) for _ in range(80)]
    rows = []
    for i in range(150):
        if i % 3 == 0:  # near-copies of one template, a few words changed
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
        elif i % 3 == 1 and rows:  # small families
            w = rows[rnd.randrange(len(rows))][1].split()
            if rnd.random() < 0.6:
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
        else:
            w = [rnd.choice(vocab) for _ in range(rnd.randint(3, 90))]
        rows.append((i, " ".join(w)))
    return rows


def linked(texts, threshold=0.8):
    """{id: smallest id reachable} by comparing all pairs."""
    sets = {i: grams(t) for i, t in texts}
    name = {i: i for i in sets}
    again = True
    while again:
        again = False
        for x in sets:
            for y in sets:
                if name[x] < name[y] and jaccard(sets[x], sets[y]) >= threshold:
                    name[y], again = name[x], True
    return name


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_near_components_match_brute_force(spark, texts, threshold, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 300)
    df = spark.createDataFrame(texts + [(990, None), (991, " ,")], "sample_id bigint, text string").repartition(5)
    got = {r["sample_id"]: r["component"] for r in D.near_components(df, "text", threshold=threshold).collect()}
    want = linked(texts, threshold)
    assert got == want
    gone = [r["sample_id"] for r in D.near_duplicates(df, "text", threshold=threshold).collect()]
    assert sorted(gone) == [i for i in sorted(want) if want[i] != i]


@pytest.mark.parametrize("pivots", [0, 1, 2])
def test_chains_and_hubs_are_whole_without_pivots_too(spark, pivots):
    r = random.Random(2)
    sets = []
    for i in range(60):  # a drifting chain: neighbours are similar, ends are not
        sets.append((i, list(range(3 * i, 3 * i + 40))))
    sets += [(100 + i, sorted({*range(1000, 1030), *r.sample(range(2000, 2400), 2)})) for i in range(40)]  # a family around one core
    sets += [(200 + i, r.sample(range(5000, 9000), 20)) for i in range(20)] + [(300, sets[0][1]), (301, [7])]
    df = spark.createDataFrame([(i, list(map(int, g))) for i, g in sets], "id bigint, grams array<bigint>")
    got = {r["id"]: r["component"] for r in S.similar_components(lambda ids, how: df if ids is None else df.join(ids, "id", how), 0.8, pivots).collect()}
    name = {i: i for i, _ in sets}
    for _ in sets:
        for x, a in sets:
            for y, b in sets:
                if name[x] < name[y] and jaccard(set(a), set(b)) >= 0.8:
                    name[y] = name[x]
    assert got == name
    none = df.limit(0)
    assert S.similar_components(lambda ids, how: none, 0.8, pivots).count() == 0


def test_whole_sets_are_cut_only_for_pairs_that_can_be_similar(spark):
    """Rows that share two rare grams each, a family, and an id that repeats."""
    r = random.Random(11)
    rare = [[f"x{i}-{j}" for j in range(6)] for i in range(10)]
    texts = [(i, " ".join(rare[i % 10] + [f"w{r.randrange(10**6)}" for _ in range(40)])) for i in range(60)]
    base = [f"f{j}" for j in range(50)]
    texts += [(100 + i, " ".join(base + [f"t{i}"])) for i in range(3)] + [(102, " ".join(rare[3] + base[:20]))]
    rows = spark.createDataFrame(texts, "id bigint, text string")
    asked = []

    def sets_of(ids, how):
        if ids is not None and how == "left_semi":
            asked.append({x["id"] for x in ids.collect()})
        return D.gram_sets(rows if ids is None else rows.join(ids, "id", how), "text", "id")

    got = {(x["id"], x["component"]) for x in S.similar_components(sets_of).collect()}
    assert got == {(i, i) for i in range(60)} | {(100, 100), (101, 100), (102, 100)}
    assert asked and set().union(*asked) == {100, 101, 102}


def test_only_repeated_elements_leave_a_range():
    import pyarrow as pa

    r = random.Random(3)
    g = sorted(r.randrange(120) for _ in range(150))
    rows = [pa.RecordBatch.from_pydict({"id": list(range(i, i + n)), "gram": g[i : i + n]}) for i, n in ((0, 1), (1, 40), (41, 1), (42, 1), (43, 107))]
    left = [x for b in S._repeated(iter(rows)) for x in b.column("id").to_pylist()]
    assert left == [i for i, x in enumerate(g) if g.count(x) > 1 or x in (g[0], g[-1])]
    assert list(S._repeated(iter([]))) == []


def test_components_of_links(spark):
    r = random.Random(4)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(45)] + [(500, 500 + i) for i in range(200)] + [(900 + i, 901 + i) for i in range(30)] + [(7, 7), (2000, 2000)]
    name = {v: v for pair in links for v in pair}
    for _ in range(60):
        for a, b in links:
            name[a] = name[b] = min(name[a], name[b])
    got = components(spark.createDataFrame(links, "a bigint, b bigint"))
    assert {x["id"]: x["component"] for x in got.collect()} == name
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_filter_keeps_every_item_gram_and_few_others(spark):
    r = random.Random(1)
    known = [r.randrange(-(1 << 63), 1 << 63) for _ in range(3000)]
    other = [r.randrange(-(1 << 63), 1 << 63) for _ in range(40_000)]
    made = bloom(spark.createDataFrame([(g,) for g in known], "gram bigint"))
    df = spark.createDataFrame([(1, known), (2, other), (3, [])], "id bigint, grams array<bigint>")
    left = {x["id"]: x["grams"] for x in only_likely(df, "grams", made).collect()}
    assert left[1] == known and left[3] == [] and len(left[2]) < 400
    assert only_likely(df, "grams", None) is df


def test_no_filter_beyond_its_bound(spark, monkeypatch):
    from siftwork.operators import gramfilter as G

    item = " ".join(f"q{i}" for i in range(40))
    df = spark.createDataFrame([(1, item), (2, item + " tail"), (3, "nothing in common")], "sample_id bigint, text string")
    items = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    monkeypatch.setattr(G, "MOST_BITS", 64)
    assert bloom(items.selectExpr("explode(split(text, ' ')) AS gram")) is None
    assert {x["sample_id"] for x in D.near_items(df, items).collect()} == {1, 2}


def test_stages_cover_every_row_once(spark, texts):
    rows = [(i, t, t.upper() if i % 5 else t, "s") for i, t in texts] + [(900, texts[0][1], texts[0][1], "s")]
    df = spark.createDataFrame(rows, "sample_id bigint, instruction string, response string, source string")
    got = D.dedup_stages(df).toPandas()
    assert len(got) == len(rows) and got["sample_id"].is_unique
    assert got.set_index("sample_id").loc[900, "stage"] != "kept"


def test_items_inside_the_pool_are_found(spark):
    item = " ".join(f"q{i}" for i in range(40))
    df = spark.createDataFrame([(1, item), (2, item + " tail"), (3, "nothing in common here at all")], "sample_id bigint, text string")
    items = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert {r["sample_id"] for r in D.gram_overlap(df, items).collect()} == {1, 2}
    assert {r["sample_id"] for r in D.near_items(df, items).collect()} == {1, 2}
    assert {(r["sample_id"], r["kind"]) for r in D.matching_items(df, items).collect()} == {(1, "exact"), (1, "normalised")}


def test_items_over_lines(spark):
    item = "one two three four five six seven\neight nine ten eleven twelve\nthirteen fourteen fifteen sixteen"
    long = "\n".join(f"line {i} of a long text" for i in range(150_000))
    rows = [(1, "before\n" + item + "\nafter"), (2, item.replace("\n", " ")), (3, long + "\n" + item.upper()), (4, "line 7 of a long text"), (5, None)]
    docs = spark.createDataFrame(rows, "sample_id bigint, text string")
    items = spark.createDataFrame([(1, item), (2, "line 7 of a long text")], "item_id bigint, text string")
    windows = D.line_windows(docs, items)
    assert windows.where("sample_id = 1").count() == 5 + 3
    hits = {tuple(r) for r in D.matching_items(windows, items).distinct().collect()}
    assert hits == {(1, "exact"), (1, "normalised"), (2, "normalised"), (3, "exact"), (3, "normalised"), (4, "exact"), (4, "normalised")}
    assert windows.where("sample_id = 3 and n_lines = 3").count() == 150_001


def test_windows_are_cut_only_from_rows_that_hold_an_item_gram(spark, monkeypatch):
    item = " ".join(f"q{i}" for i in range(12)) + "\n" + " ".join(f"r{i}" for i in range(12))
    rows = [(1, "head\n" + item.upper() + "\ntail of it"), (2, "nothing in common here\n" * 50), (3, "one two"), (4, "three\n\nOne, two!\nfour"), (5, None), (6, ""), (7, "q0 q1 q2 q3 q4 q5 alone")]
    docs = spark.createDataFrame(rows, "sample_id bigint, text string")
    cut, real = [], D.line_windows
    monkeypatch.setattr(D, "line_windows", lambda df, *a: cut.append({x["sample_id"] for x in df.collect()}) or real(df, *a))
    items = spark.createDataFrame([(1, item), (2, "one two")], "item_id bigint, text string")
    assert {tuple(x) for x in D.near_windows(docs, items).collect()} == {(1, 2, 2, 1), (3, 1, 1, 2), (4, 3, 1, 2), (4, 2, 2, 2)}
    assert {tuple(x) for x in D.near_windows(docs, items.where("item_id = 1")).collect()} == {(1, 2, 2, 1)}
    assert cut[1] == {1}


def test_normal_forms_of_runs_are_those_of_their_lines(spark):
    rows = [(1, "\u0391\u03a3\n\u0392 x-Y\n\u0130i \ud55c\n\n9.9"), (2, "A\r\nb\n"), (3, "\n")]
    docs = spark.createDataFrame(rows, "sample_id bigint, text string")
    items = spark.createDataFrame([(1, "a"), (2, "a\nb"), (3, "a\nb\nc")], "item_id bigint, text string")
    w = D.line_windows(docs, items).withColumn("whole", D.TX.normal_form("text"))
    assert w.count() == 5 + 4 + 3 + 3 + 2 + 1 + 2 + 1 and w.where("norm <> whole or norm is null").isEmpty()


def test_shared_folder_is_required_off_local_masters(spark, monkeypatch):
    import siftwork.session as session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Elsewhere:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Elsewhere())
    assert session.shared_dir(spark)


def test_scratch_tables_go_when_asked(spark):
    import os

    import siftwork.session as session

    session.drop_scratch(spark)
    out = session.stored(spark.range(5), "kept-until-dropped")
    paths = [f.removeprefix("file:") for f in out.inputFiles()]
    assert out.count() == 5 and all(os.path.exists(f.replace("//", "/", 1)) for f in paths)
    assert session.drop_scratch(spark) == 1 and not any(os.path.exists(f.replace("//", "/", 1)) for f in paths)
    assert session.drop_scratch(spark) == 0
