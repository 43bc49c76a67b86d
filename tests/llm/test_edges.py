"""Nulls, empty and very long texts, ties and repeated rows, empty tables and clashing column names: each operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from starslice.llm import chat, decontaminate, line_dedup, mixing, ngram_jaccard, pii, quality_classifier, quality_rules, suffix_dedup, token_counts

LONG = "some words of a very long text. " * 8000
ODD = [(1, None, "a"), (2, "", None), (3, " \t\n", "a"), (4, LONG, "b"), (4, LONG, "b"), (5, "x", None), (5, "x", None), (None, "nobody's text is here", "c"), (None, None, None), (6, "é" * 70, "")]
# names that the operators use themselves
CLASH = ("id", "text_hash", "h", "n", "token", "tokens", "blocks", "block_id", "block_list", "mix_key", "size", "position", "epoch", "words", "taken", "keep", "p_form", "p_good",
         "votes", "spans", "sections", "n_words", "n_blocks", "source_size", "component", "rep", "late", "gram", "_text", "_id", "_part", "item", "n_tokens", "kept", "marks", "known")


@pytest.fixture(params=["odd", "empty"])
def docs(spark, request):
    rows = ODD if request.param == "odd" else []
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit(f"mine {c}") for c in CLASH})


def labels_of(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_classifier(spark, docs):
    for labels in (None, labels_of(spark), labels_of(spark, [(1, 1, 0), (2, None, None), (4, 0, 1), (4, 1, 0)])):
        model = quality_classifier.fit(docs, labels)
        got = quality_classifier.classify(docs, model)
        rows = got.collect()
        assert len(rows) == docs.count() and got.columns.count("keep") == 1
        assert len({r.p_form for r in rows if r.doc_id == 4}) <= 1
        assert {r.text_hash for r in rows} <= {"mine text_hash"}


def test_rules(spark, docs):
    measured = quality_rules.measure(docs)
    rows = quality_rules.judge(measured, quality_rules.fit(measured)).collect()
    assert len(rows) == docs.count()
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in rows if r.doc_id in (1, 2, 3))


def test_pii(spark, docs):
    rows = pii.find(docs, pii.fit(pii.labelled_sample(docs))).collect()
    assert len(rows) == docs.count() and not any(r.spans for r in rows)


def test_tokens(spark, docs):
    rows = token_counts.section_rows(token_counts.section_tokens(docs)).collect()
    assert sum(r.n_tokens for r in rows if r.doc_id == 4) == sum({r.doc_tokens for r in rows if r.doc_id == 4}) * (2 if rows else 0)


def test_chat(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    odd = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (2, 1, "u", LONG), (3, 1, "u", "")], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(odd.withColumn("n", F.lit(1)).withColumn("conv", F.lit(2))).count() == 3


def test_mixing(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(r.taken == 0 for r in rows if r.size == 0)
    order = mixing.training_order(docs)
    assert order.columns[-3:] == ["epoch", "words", "position"] and order.filter("words <= 0").count() == 0


def test_jaccard(spark, docs):
    rows = {r.doc_id: r for r in ngram_jaccard.jaccard_components(docs).collect()}
    assert set(rows) == {r.doc_id for r in docs.collect() if r.doc_id is not None}
    assert all(rows[k].component_id == k and rows[k].n_shingles == 0 for k in (1, 2, 3) if rows)
    kept = ngram_jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 4").count() == min(1, len(rows)) and kept.filter("doc_id IS NULL").count() == docs.filter("doc_id IS NULL").count()


def test_decontamination(spark, docs):
    for items in ([], [(1, "some words of a very long text"), (1, "some words of a very long text"), (2, None), (None, "x"), (3, "")]):
        items = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(0)).withColumn("h", F.lit(0))
        hits = decontaminate.contained_items(docs, items).collect()
        assert {(r.doc_id, r.item_id) for r in hits} == ({(4, 1)} if items.count() and docs.count() else set())
        assert decontaminate.decontaminated(docs, items).count() == docs.count() - 2 * len(hits)


def test_suffixes(spark, docs):
    rows = suffix_dedup.dedup_suffixes(docs).collect()
    assert len(rows) == len({r.doc_id for r in docs.collect() if r.doc_id is not None}) and not any(r.n_removed for r in rows)


def test_lines(spark, docs):
    got = line_dedup.dedup_lines(docs)
    assert set(docs.columns) <= set(got.columns) and got.count() == docs.count()
    assert not any(r.n_removed_words for r in got.collect())


def test_stages(spark, docs, tmp_path):
    d = str(tmp_path)
    labels_of(spark, [(4, 1, 0)]).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "no such words are here at all")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns, name
    corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
