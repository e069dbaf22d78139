"""The pipeline end to end against a plain version of its stages, and the queries that SQL can express."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import pieces, quality, queries

SF = "/root/testdata/sf0.001"


def test_pipeline_keeps_what_the_stages_keep(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    scored = {r["doc_id"]: r["score"] for r in quality.score_quality(d, quality.fit_quality(d, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    good = d.filter(d.doc_id.isin([i for i, s in scored.items() if s >= quality.THRESHOLD]))
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for i, t in texts.items()}
    group = {i: i for i in texts}
    order = sorted(texts)
    for a in order:
        for b in order:
            if a < b and (texts[a] == texts[b] or sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                x, y = sorted((group[a], group[b]))
                group = {k: x if v == y else v for k, v in group.items()}
    one = {i: texts[i] for i in texts if group[i] == i}
    bad = {r["doc_id"] for r in queries.QUERIES["op3_decontamination"](spark, SF).filter("contaminated").collect()}
    want = {i for i in one if i not in bad}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == want and len(got) == len(want) and all(r["round_trip"] for r in got)
    m = pieces.PieceModel.of(pieces.model_path())
    clean = {r["doc_id"]: r["text"] for r in corpus_pipeline.secrets_stage(spark, good, SF).collect()}
    assert all(r["n_tokens"] == len(m.packed(clean[r["doc_id"]])) // 4 for r in got)


def test_stages_take_nulls_ties_and_other_columns(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b c d e f", None, "s", 11), (2, "a b c d e f", None, "s", 11), (3, "a b c d e f", "en", None, None), (None, "x password=hunter2hunter2", "en", "s", 3), (4, "long " * 20_000, "en", "s", 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("spans", F.lit(1)).withColumn("node", F.lit("n"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.dtypes == d.dtypes
        n = {"n-gram Jaccard join": 4, "quality classifier": out.count()}.get(name, len(rows))  # null and empty texts are equal, so are ids 2 and 3
        assert out.count() == n
    assert corpus_pipeline.STAGES[-1][1](spark, d, SF).count() == len(rows)


def test_stages_return_the_columns_of_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.dtypes == d.dtypes and 0 < out.count() <= d.count()
        assert stage(spark, d.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM read_parquet('{p}')")
    rows = lambda df: sorted(map(repr, df.reindex(sorted(df.columns), axis=1).astype(object).where(df.notna(), None).itertuples(index=False)))
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(queries.ORACLES[name]).df())
