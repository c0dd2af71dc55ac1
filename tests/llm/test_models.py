"""Chains, language ID and toxicity: brute force on small chains, held-out accuracy, odd inputs."""

import itertools
import random

import numpy as np

from tracequarry.llm import lang_id, toxicity
from tracequarry.llm.chains import best_states, marginals

COUNTS = np.array([1, 70, 3, 33, 32])


def test_best_states_equal_dynamic_programming():
    rng = np.random.default_rng(0)
    e = rng.normal(size=(COUNTS.sum(), 3))
    got, at = best_states(e, COUNTS, 1.5), 0
    for n in COUNTS:
        own, back = e[at : at + n], []
        v = own[0]
        for t in range(1, n):
            step = v[:, None] - 1.5 * (1 - np.eye(3))
            back.append(step.argmax(0))
            v = step.max(0) + own[t]
        path = [int(v.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert got[at : at + n].tolist() == path[::-1]
        at += n


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    counts, steps = np.array([5, 1, 4]), np.array([[1.0, 0.2], [0.5, 2.0]])
    w = rng.random((counts.sum(), 2)) + 0.1
    got, at = marginals(w, counts, steps), 0
    for n in counts:
        total = np.zeros((n, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            p = np.prod([w[at + t, s] for t, s in enumerate(path)]) * np.prod([steps[a, b] for a, b in zip(path, path[1:])]) * steps.sum(0)[path[0]] * steps.sum(1)[path[-1]]
            for t, s in enumerate(path):
                total[t, s] += p
        assert np.allclose(got[at : at + n], total / total.sum(1, keepdims=True))
        at += n


def language_docs(spark):
    r = random.Random(1)
    parts = {"en": ["the", "tion", "ing", "her", "was"], "de": ["der", "ung", "sch", "keit", "ein"], "el": ["και", "του", "ση", "με"]}
    rows = []
    for i in range(240):
        lang = ["en", "de", "el"][i % 3]
        rows.append((i, " ".join("".join(r.choices(parts[lang], k=r.randint(1, 3))) for _ in range(40)), lang, "s"))
    rows += [(1000, None, None, "s"), (1001, "", "en", "s"), (1002, "12 --- 34", "de", "s"), (None, rows[0][1], "de", "s"), (3, rows[3][1], "en", "s"), (1003, " ".join([rows[0][1], rows[1][1], rows[2][1]]), None, "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_language(spark):
    docs = language_docs(spark)
    found = lang_id.identify(docs, lang_id.fit(docs), keep=("lang",)).collect()
    assert len(found) == docs.count()
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert all(by[i].lang_pred == ["en", "de", "el"][i % 3] for i in range(240))
    assert all((by[i].lang_pred, by[i].score, by[i].spans) == ("und", 0.0, []) for i in (1000, 1001, 1002))
    assert [s.lang for s in by[1003].spans] == ["en", "de", "el"] and by[1003].spans[0].begin == 0 and by[1003].spans[-1].end == len(by[1003].text)
    none = docs.where("lang = 'xx'")
    assert lang_id.identify(docs, lang_id.fit(none), spans=False).where("lang_pred <> 'und'").isEmpty()
    assert lang_id.identify(none, lang_id.fit(none)).count() == 0


def test_toxicity(spark):
    r = random.Random(2)
    words = ["".join(r.choices("abcdefghij", k=5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        text = r.choices(words, k=60)
        if i % 4 == 0:
            for _ in range(3):
                text[r.randrange(60)] = r.choice(["Vilword", "nastything,", "vilwordish"])
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(i % 4 == 0)))
    rows += [(900, None, "x"), (901, "", "x"), (None, "vilword nastything", "x"), (902, "é vilword! nastything", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int"))
    found = {f.doc_id: f for f in toxicity.score(docs, model).collect()}
    held = [i for i in range(400) if __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    assert held and all((found[i].score >= 0.3) == (i % 4 == 0) for i in held)
    assert found[900].score == found[901].score < 0.3 and found[900].toxic_spans == []
    spans = found[902].toxic_spans
    assert (spans[0].begin, spans[-1].end) == (2, 21)
    flat = toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert {f.score for f in toxicity.score(docs, flat, spans=False).collect()} == {flat.constant}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_repeated_ids_count_once_in_fits(spark):
    docs = language_docs(spark).where("doc_id IS NOT NULL")
    once, copies = docs.dropDuplicates(["doc_id"]), docs.where("doc_id = 4").crossJoin(spark.range(300)).drop("id")
    a, b = lang_id.fit(once, fit_rows=1000), lang_id.fit(docs.unionByName(copies), fit_rows=1000)
    assert a.languages == b.languages and (a.weights == b.weights).all() and (a.allowed == b.allowed).all()
    labels = [(i, int(i % 3 == 0)) for i in range(240)]
    a, b = (toxicity.fit(d, spark.createDataFrame(rows, "doc_id long, toxic int"), fit_rows=5000) for d, rows in ((once, labels), (docs.unionByName(copies), labels * 2)))
    assert (a.weights == b.weights).all() and (a.steps == b.steps).all()
