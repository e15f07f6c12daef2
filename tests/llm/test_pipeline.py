"""The corpus pipeline, stage by stage against the operators' own results, and on odd tables."""

import re
from collections import Counter

import corpus_pipeline
from conftest import SMALL
from test_operators import ROWS, SCHEMA, base_spans, check_sequences, rows

from inkframe.llm import near_dups, quality


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {n: f for n, f in corpus_pipeline.STAGES}
    first = kept["quality_classifier"](spark, docs, SMALL).cache()
    drawn = {r["doc_id"] for r in rows(quality.Classifier(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).report().where("kept"))}
    assert {r["doc_id"] for r in rows(first)} == drawn and first.columns == docs.columns
    second = kept["near_dedup"](spark, first, SMALL).cache()
    classes = {r["class_id"] for r in rows(near_dups.near_duplicates(first))}
    assert sorted(r["doc_id"] for r in rows(second)) == sorted(classes) and second.columns == docs.columns
    third = kept["pii"](spark, second, SMALL).cache()
    texts = {r["doc_id"]: r["text"] for r in rows(second)}
    assert third.count() == second.count() and third.columns == docs.columns
    for r in rows(third):
        assert not base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        assert base_spans(texts[r["doc_id"]]) or re.search("[0-9]", texts[r["doc_id"]]) or r["text"] == texts[r["doc_id"]]
    fourth = kept["mixing"](spark, third, SMALL).cache()
    assert fourth.columns == docs.columns and max(Counter(r["doc_id"] for r in rows(fourth)).values()) <= 2
    check_sequences(rows(kept["packing"](spark, fourth, SMALL)), 2048)


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0 and [n for n, _ in corpus_pipeline.STAGES][0] == "quality_classifier"


def test_odd(spark):
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * 9) for r in ROWS], SCHEMA)
    for table in (docs, docs.limit(0)):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SMALL).cache()
            assert name == "packing" or now.columns == docs.columns
            assert (now.count() > 0) == (table is docs)


def test_near_dedup_keeps_one_row_of_each_class(spark):
    passage = [" ".join(f"{w}{i}" for i in range(200)) for w in "abcd"]
    near = [p.replace("100", "new") for p in passage]
    table = [
        (10, "a" * 300), (10, "b" * 250),  # one id, two classes
        (3, passage[0]), (20, near[0]), (20, passage[1]),  # the unique text stays under an id that is a near copy elsewhere
        (None, passage[2]), (None, near[2]), (None, passage[2]),  # a class without ids
        (7, passage[3]), (None, near[3]), (None, passage[3]), (7, passage[3]),  # nameless copies of a named original
        (30, None), (None, ""), (30, "  "), (31, "."),
    ]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in table], "doc_id long, text string, lang string, source string, n_chars long")
    kept = Counter((r["doc_id"], r["text"]) for r in rows(dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SMALL)))
    nameless = [t for i, t in kept if i is None]
    assert len(nameless) == 1 and nameless[0] in (passage[2], near[2])
    empty = [t for i, t in kept if i == 30]
    assert len(empty) == 1 and empty[0] in (None, "  ")
    assert kept == Counter([(10, "a" * 300), (10, "b" * 250), (3, passage[0]), (20, passage[1]), (None, nameless[0]), (7, passage[3]), (30, empty[0])])
