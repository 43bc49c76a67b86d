"""The pipeline over a small table: every stage's decisions take effect on what the stage before it kept."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from starslice.llm import decontaminate, ngram_jaccard, registered


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    root, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        out.append(docs)
    return out


def test_stage_names():
    assert len(corpus_pipeline.STAGES) == 5 and "pipeline" in entry.queries()
    assert [n for n in entry.queries() if n.startswith("op")] and {n.split("_")[0] for n in entry.queries() if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}


def test_each_stage(spark, sf_dir, stages):
    first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[0].collect()}
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert sum(i in kept for i in clean) >= 0.9 * len(clean)
    assert all(s.columns == first.columns for s in stages[:4])
    assert stages[1].filter("length(text) <> n_chars").count() == 0
    assert ngram_jaccard.jaccard_components(stages[2]).filter("component_id <> doc_id").count() == 0
    assert decontaminate.contained_items(stages[3], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
    mix, words = stages[4].collect(), {r.doc_id: len(r.text.encode().split()) for r in stages[3].collect()}
    assert abs(sum(r.words for r in mix) - sum(words.values())) <= 20 and {r.doc_id for r in mix} <= set(words)


def test_run_gives_the_stages_rows(spark, sf_dir, stages):
    cols = ["doc_id", "epoch", "words"]
    assert sorted(corpus_pipeline.run(spark, sf_dir).select(*cols).collect()) == sorted(stages[4].select(*cols).collect())


@pytest.mark.parametrize("name", sorted(registered.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = registered.QUERIES[name](spark, sf_dir)
    res = con.execute(registered.SQL[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(str, ([r[c] for c in cols] for r in df.collect()))) == sorted(map(str, map(list, res.fetchall())))
