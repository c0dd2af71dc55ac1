"""The pipeline's near-duplicate stage by rows against a plain version."""

import corpus_pipeline

A = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twenty-one twenty-two twenty-three twenty-four"
B = " ".join(reversed(A.split()))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, key int"


def survivors(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "clash", 7) for i, t in rows], SCHEMA)
    out = corpus_pipeline.one_of_near_duplicates(spark, docs, "")
    assert out.columns == corpus_pipeline.DOCUMENTS
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)


def test_one_row_a_class_is_left(spark):
    near_a, near_b = A + " more", B + " more"
    c, d = A.replace("o", "x"), B.replace("o", "x")
    rows = [(3, B), (5, A), (5, near_b), (6, c), (6, c), (6, c + " more"), (None, near_a), (None, d), (None, d), (None, d + " more"), (8, "alone"), (9, None), (None, "single")]
    assert survivors(spark, rows) in [sorted([(3, B), (5, A), (6, x), (None, y), (8, "alone"), (9, None), (None, "single")], key=str) for x in (c, c + " more") for y in (d, d + " more")]


def test_no_rows(spark):
    assert survivors(spark, []) == []
