"""The pipeline's stages and the queries without SQL: odd inputs, a whole run, held-out accuracy."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_pipeline import SCHEMA
from tests.llm.test_searches import brute_classes
from tracequarry.llm import queries

SF = "/root/testdata/sf0.1"


def corpus(seed: int = 3):
    r = random.Random(seed)
    words = {"en": ["the", "tion", "ing", "her", "was"], "de": ["der", "ung", "sch", "keit", "ein"]}
    rows, labels = [], []
    for i in range(160):
        lang = ("en", "de")[i % 2]
        text = ["".join(r.choices(words[lang], k=r.randint(1, 3))) for _ in range(50)]
        if i % 5 == 0:
            for _ in range(4):
                text[r.randrange(50)] = "vilword"
        rows.append((i, " ".join(text), lang))
        labels.append((i, int(i % 5 == 0)))
    for i in range(40):  # near copies of clean documents
        text = rows[1 + 5 * (i % 8)][1].split()
        text[r.choice([0, 49])] = "changed"
        rows.append((200 + i, " ".join(text), "en"))
    rows += [(300, None, "en"), (301, "", None), (302, "12 -- 3", "de"), (303, "x" * 400_000, "en"), (7, rows[7][1], "de"), (None, rows[9][1], None), (None, None, None)]
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "clash", 1) for i, t, lang in rows], SCHEMA)
    docs.withColumnsRenamed({"component_id": "lang_pred", "key": "score"}).repartition(3).write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}"


def test_run_equals_its_stages_by_hand(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    given = [(r.doc_id, r.text) for r in docs.collect()]
    first = corpus_pipeline.identified_language(spark, docs, tables)
    assert first.columns == corpus_pipeline.DOCUMENTS
    # All texts with a letter stay, whatever their language.
    kept = sorted(((r.doc_id, r.text) for r in first.collect()), key=str)
    assert kept == sorted(((i, t) for i, t in given if any(c.isalpha() for c in t or "")), key=str)
    second = corpus_pipeline.without_toxicity(spark, first, tables)
    clean = sorted(((r.doc_id, r.text) for r in second.collect()), key=str)
    assert clean == sorted(((i, t) for i, t in kept if "vilword" not in t), key=str)
    third = corpus_pipeline.one_of_near_duplicates(spark, second, tables)
    left = [(r.doc_id, r.text) for r in third.collect()]
    # One row a class: by brute force, with the rows numbered.
    unique = sorted(set(clean), key=str)
    classes = [c for _, _, c in brute_classes([(k, t) for k, (_, t) in enumerate(unique)])]
    assert len(left) == len(set(classes)) and sorted(classes[unique.index(row)] for row in left) == sorted(set(classes))
    packed = corpus_pipeline.run(spark, tables).collect()
    assert sorted({(r.doc_id, r.doc_tokens) for r in packed}, key=str) == sorted({(r.doc_id, r.doc_tokens) for r in corpus_pipeline.packed_sequences(spark, third, tables).collect()}, key=str)
    assert sum(r.length for r in packed) == sum(d for _, d in {((r.doc_id, r.doc_tokens), r.doc_tokens) for r in packed}) and {r.doc_id for r in packed} == {i for i, _ in left}


def test_stages_on_nothing(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("false").select(*corpus_pipeline.DOCUMENTS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0, name


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = queries.op6_language(spark, SF).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'")
    right, many = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert many > 100 and right >= 0.97 * many
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    both = queries.op9_toxicity(spark, SF).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id")
    hits, toxic, marked, clean = both.agg(*(F.count_if(F.expr(c)) for c in ("predicted = 1 AND toxic = 1", "toxic = 1", "predicted = 1 AND toxic = 0", "toxic = 0"))).first()
    assert toxic and hits >= 0.7 * toxic and marked <= 0.05 * clean
