"""Language identification without labels, and its stage on odd rows."""

from pyspark.sql import functions as F

import corpus_pipeline
from stocklens.llm import language

ROWS = [(1, "some words of a text"), (2, None), (3, ""), (4, "12 34 !"), (5, "été"), (None, "no id"), (1, "again one"), (6, "x" * 200_000)]


def test_without_known_languages_only_texts_without_letters_are_rejected(documents):
    docs = documents(ROWS, "row string, rejected string, lang_pred string")
    found = language.identify(docs, docs).collect()
    assert len(found) == len(ROWS) and {(r.lang_pred, r.score) for r in found} == {("und", 0.0)}
    assert sorted(r.row.doc_id for r in found if r.rejected) == [2, 3, 4]


def test_the_stage_keeps_unlabelled_documents(spark, documents, folder):
    docs = documents(ROWS)
    kept = corpus_pipeline.identify_language(spark, docs, folder)
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=repr) == sorted(
        docs.where("doc_id IS NULL OR doc_id NOT IN (2, 3, 4)").collect(), key=repr
    )


def test_a_language_of_few_rows_beside_rows_without_one(documents):
    docs = documents([(i, f"das ist ein kleiner text {i}") for i in range(12)] + [(99, None)])

    labelled = docs.withColumn("lang", F.when(F.col("doc_id") < 6, "de"))
    found = {r.row.doc_id: r.lang_pred for r in language.identify(docs, labelled).collect()}
    assert found[99] == "und" and {found[i] for i in range(12)} == {"de"}
