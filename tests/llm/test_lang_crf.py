import itertools

import numpy as np

from pricelattice.llm.lang_crf import forward_backward, gradient, identify, label_words, letters, spans, train
from pricelattice.llm.queries import op3_lang_crf


def test_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    emit, move = rng.random((4, 2, 3)) + 0.1, rng.random((3, 3)) + 0.1
    lengths = [4, 2]
    got = forward_backward(emit.copy(), np.array([2, 2, 1, 1]), move)
    for s, n in enumerate(lengths):
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=n):
            p = np.prod([emit[t, s, y] for t, y in enumerate(path)]) * np.prod([move[a, b] for a, b in zip(path, path[1:])])
            for t, y in enumerate(path):
                want[t, y] += p
        assert np.allclose(got[:n, s], want / want.sum(axis=1, keepdims=True))


def test_gradient_matches_enumeration():
    rng = np.random.default_rng(5)
    score, move = rng.normal(size=(6, 3)), rng.normal(size=(3, 3))
    words, labels = [np.array([0, 4, 2, 4]), np.array([5, 1])], [np.array([0, 1, 1, 2]), np.array([2, 2])]

    def loss(s, m):
        total = 0.0
        for w, y in zip(words, labels, strict=True):
            of = lambda path: sum(s[a, b] for a, b in zip(w, path)) + sum(m[a, b] for a, b in zip(path, path[1:]))
            total += np.log(sum(np.exp(of(p)) for p in itertools.product(range(3), repeat=len(w)))) - of(y)
        return total

    by_word, by_move, n = gradient(words, labels, score, move)
    assert n == 4
    for x, got, which in ((score, by_word, 0), (move, by_move, 1)):
        for at in np.ndindex(x.shape):
            up, down = x.copy(), x.copy()
            up[at] += 1e-5
            down[at] -= 1e-5
            slope = (loss(*((up, move) if which == 0 else (score, up))) - loss(*((down, move) if which == 0 else (score, down)))) / 2e-5
            assert abs(slope - got[at]) < 1e-6


def test_letters():
    assert letters("½ ² ③ x² Ünï_co9de") == ["x", "ünï", "co", "de"] and letters(None) == []


def test_code_switching(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang in ('en', 'de')").limit(300).collect()
    model = train([r.text for r in rows[:200]], [r.lang for r in rows[:200]])
    en, de = (next(r.text for r in rows[200:] if r.lang == x and len(r.text) > 300) for x in ("en", "de"))
    (own,) = spans(model, [" ".join(letters(en)[:30] + letters(de)[:30])])
    assert sum(s["n_words"] for s in own) == 60 and [s["first_word"] for s in own] == np.cumsum([0, *(s["n_words"] for s in own)])[:-1].tolist()
    top = [s["lang"] for s in own for _ in range(s["n_words"])]
    assert sum(a == b for a, b in zip(top, ["en"] * 30 + ["de"] * 30, strict=True)) >= 54


def test_spans_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in label_words(docs).collect():
        assert sum(s.n_words for s in r.spans) == len(letters(text[r.doc_id])) and all(0 <= s.probability <= 1 for s in r.spans)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = op3_lang_crf(spark, d).toPandas()
    true = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").toPandas()
    held = got.merge(true, on="doc_id").query("held_out")
    assert len(got) == len(true) and (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score string, lang_pred int"
    assert identify(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, None, "en", "", 1), (2, "", "en", "", 1), (3, "12 !", None, "", 1), (4, "one word", "en", None, None), (4, "one word", "en", None, None)]
    rows += [(None, "wort " * 60_000, "de", "", 1), (6, "wort", "de", "", 1)]
    got = sorted((r.doc_id or 0, r.lang_pred) for r in identify(spark.createDataFrame(rows, schema)).collect())
    assert [x for x in got if x[0] in (1, 2, 3)] == [(1, "und"), (2, "und"), (3, "und")] and len(got) == 7
    none = [(1, "a b", None, "", 1)]
    assert [(r.lang_pred, r.score) for r in identify(spark.createDataFrame(none, schema)).collect()] == [("und", 0.0)]
