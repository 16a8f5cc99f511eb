import numpy as np
import pytest

from siftwork.llm import language_id as li

SOUNDS = {"aa": ["ka", "ru", "tol", "mi", "nen"], "bb": ["sch", "ing", "wer", "ta", "ol"], "cc": ["eau", "ille", "que", "ta", "ré"]}


def text(lang, seed, n=25):
    r = np.random.default_rng([seed, *lang.encode()])
    return " ".join("".join(r.choice(SOUNDS[lang], 3)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    out = [(i, text(lang, i, 4 + i % 60), lang) for i in range(120) for lang in SOUNDS]
    out += [(900, None, "aa"), (901, "", "bb"), (902, "12 + 5!", "cc"), (None, text("aa", 5000), None)]
    out += [(1000 + i, out[0][1], "aa") for i in range(150)]  # copies: a third of all rows
    return out


@pytest.fixture(scope="module")
def model(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    return li.fit_languages(df, rows_per_language=100)


def test_held_out_accuracy_and_sparse_weights(spark, model):
    assert model.languages == ("aa", "bb", "cc")
    data = [(i, text(lang, i, 12), lang, "x", 3) for i in range(2000, 2100) for lang in SOUNDS]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, lang_pred string, score int")
    out = li.identify(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    out = out.collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)
    assert all(1 / 3 <= r.score <= 1 for r in out)
    assert (model.weights == 0).mean() > 0.9


def test_odd_texts(spark, model, make, odd_rows):
    out = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in li.identify(make(odd_rows), model).collect()}
    assert out[3, None] == out[4, ""] == out[5, " \n\t \n"] == ("und", 0.0)
    assert all(p in model.languages for k, (p, _) in out.items() if k[1] and k[1].strip())
    assert li.identify(make([]), model).count() == 0
    none = li.fit_languages(make([(1, "abc")]))  # its language is NULL
    assert none.languages == () and none.predict("abc") == ("und", 0.0)


def test_one_language(spark):
    one = li.fit_languages(spark.createDataFrame([(i, text("aa", i), "aa") for i in range(30)], "doc_id bigint, text string, lang string"))
    assert one.predict("anything") == ("aa", 1.0) and one.predict("1") == ("und", 0.0)


def test_pieces_do_not_change_the_counts(monkeypatch):
    s = "Ab  c,d--Éß 12 xyz" * 9
    whole = li.grams(s)
    for piece in (1, 2, 3, 7, 50):
        monkeypatch.setattr(li, "PIECE", piece)
        at, n = li.grams(s)
        assert at.tolist() == whole[0].tolist() and n.tolist() == whole[1].tolist()


def test_step_follows_the_formula():
    r = np.random.default_rng(0)
    leader = li.Leader()
    z, n = np.zeros((5, 3)), np.zeros((5, 3))
    own_z, own_n = z.copy(), n.copy()
    for _ in range(40):
        at, x, label = np.array([0, 2, 4]), r.random(3), int(r.integers(0, 3))
        w = np.zeros((5, 3))
        for i in range(5):
            for k in range(3):
                if abs(own_z[i, k]) > leader.l1:
                    w[i, k] = -(own_z[i, k] - np.sign(own_z[i, k]) * leader.l1) / ((leader.smooth + own_n[i, k] ** 0.5) / leader.rate + leader.l2)
        margin = [sum(x[j] * w[at[j], k] for j in range(3)) for k in range(3)]
        p = np.exp(margin) / np.exp(margin).sum()
        for j, i in enumerate(at):
            for k in range(3):
                g = x[j] * (p[k] - (k == label))
                own_z[i, k] += g - ((own_n[i, k] + g * g) ** 0.5 - own_n[i, k] ** 0.5) / leader.rate * w[i, k]
                own_n[i, k] += g * g
        leader.step(z, n, at, x, label)
    assert np.allclose(z, own_z) and np.allclose(n, own_n)


def test_temperature_has_the_least_loss(spark):
    r = np.random.default_rng(1)
    m = li.LanguageModel(("a", "b"), np.ones(li.SIZE), np.zeros((li.SIZE + 1, 2)))
    m.weights[:200] = r.normal(size=(200, 2)) * 3
    rows = []
    for i in range(400):
        at = r.integers(0, 200, 3).astype("<i4")
        x = np.ones(3, "<f4")
        p = np.exp(0.4 * (x @ m.weights[at]))
        rows.append((int(r.random() > p[0] / p.sum()), bytearray(at.tobytes()), bytearray(x.tobytes())))
    df = spark.createDataFrame(rows, "label bigint, at binary, x binary")
    got = li._best_factor(df, spark.sparkContext.broadcast(m))

    def loss(f):
        out = 0.0
        for label, at, x in rows:
            v = f * (np.frombuffer(x, "<f4") @ m.weights[np.frombuffer(at, "<i4")])
            out += np.log(np.exp(v - v.max()).sum()) - (v - v.max())[label]
        return out

    grid = 2.0 ** np.linspace(-4, 4, 1025)
    assert abs(loss(got) - min(map(loss, grid))) < 0.05 and 0.25 < got < 0.6
