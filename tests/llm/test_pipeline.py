"""The pipeline's stages on the smallest tables, and each query's rows."""

import duckdb
import pytest

import corpus_pipeline
from rasterloom.llm import common, queries

DATA = "/root/testdata/sf0.001"


def test_stages_shrink_and_keep_columns(spark):
    docs = common.table(spark, DATA, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, DATA), name)
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert out.select("doc_id").distinct().count() == n


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "events", "benchmark", "labels", "embeddings"):
        db.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    want = db.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, DATA).toPandas()
    key = want.columns[0]
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    a, b = got[sorted(got.columns)].sort_values(key).reset_index(drop=True), want[sorted(got.columns)].sort_values(key).reset_index(drop=True)
    for c in a.columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


ROWS = "doc_id long, text string, score double, n_removed int, n_chars long, component long"
A = " ".join(f"alpha{k} beta{k}" for k in range(20))
B = " ".join(f"gamma{k} delta{k}" for k in range(20))


def stage(spark, name, rows):
    out = dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame(rows, ROWS), DATA)
    assert out.columns == [x.split()[0] for x in ROWS.split(", ")]
    return sorted(map(tuple, out.collect()), key=str)


def test_groups_keep_one_row_each(spark):
    row = lambda doc_id, text, score=0.5: (doc_id, text, score, 1, 2, 3)
    rows = [row(3, B), row(7, A), row(7, B), row(9, A + " more"), row(9, "other words that stand here alone"), row(None, A), row(4, None), row(4, None), row(5, "")]
    got = stage(spark, "ngram_jaccard_join", rows)
    assert got == sorted([row(3, B), row(7, A), row(9, "other words that stand here alone"), row(4, None), row(4, None), row(5, "")], key=str)
    assert len(stage(spark, "ngram_jaccard_join", [row(2, A), row(2, A), row(None, B), row(None, B)])) == 2
    assert stage(spark, "ngram_jaccard_join", [row(2, A)][:0]) == []


def test_quality_reads_its_own_score(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    low, high = ([r[:2] for r in stage(spark, "quality_classifier", [(*d, s, 0, 0, 0) for d in docs])] for s in (0.0, 1.0))
    assert low == high and 0 < len(low) < len(docs)


def test_lines_and_leaks_go_by_row(spark):
    line = " ".join(f"word{k}" for k in range(12))
    got = stage(spark, "line_dedup", [(1, line, 0.0, 5, 9, 0), (2, line, 0.0, 6, 9, 0), (3, f"{line}\nnew", 0.0, 7, 9, 0), (4, None, 0.0, 8, None, 0), (5, "", None, None, 9, None)])
    assert got == sorted([(1, line, 0.0, 5, len(line), 0), (3, "new", 0.0, 7, 3, 0), (4, None, 0.0, 8, None, 0), (5, "", None, None, 0, None)], key=str)
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first()["text"]
    got = stage(spark, "benchmark_decontamination", [(9, f"{A} {item}", 0.0, 0, 0, 0), (9, A, 0.0, 0, 0, 0), (None, item, 0.0, 0, 0, 0), (None, None, 0.0, 0, 0, 0)])
    assert got == sorted([(9, A, 0.0, 0, 0, 0), (None, None, 0.0, 0, 0, 0)], key=str)


def test_whole_pipeline_by_plain_python(spark, tmp_path):
    """All five stages against plain Python on a small corpus; the model alone is the operator's."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = corpus_pipeline.quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in corpus_pipeline.quality.score(docs, model).collect()}
    kept = {r["doc_id"]: r["text"] or "" for r in docs.collect() if scores[r["doc_id"]] >= 0.3}
    db = duckdb.connect()
    frame = spark.createDataFrame(sorted(kept.items()), "doc_id long, text string").toPandas()  # noqa: F841
    db.execute("create table documents as select * from frame")
    lines = db.execute(queries.ORACLE_SQL["op9_line_dedup"]).fetchall()
    columns = [c[0] for c in db.description]
    lines = [dict(zip(columns, r, strict=True)) for r in lines]
    kept = {r["doc_id"]: r["text"] for r in lines if not r["n_removed"] or r["text"].strip(" \t\n\x0b\x0c\r")}
    frame = spark.createDataFrame(sorted(kept.items()), "doc_id long, text string").toPandas()  # noqa: F841
    db.execute("create or replace table documents as select * from frame")
    kept = {r[0]: kept[r[0]] for r in db.execute(f"select doc_id from ({queries.ORACLE_SQL['op2_ngram_jaccard_join']}) where doc_id = component_id").fetchall()}
    leaks = corpus_pipeline.decontamination.contaminated(spark.createDataFrame(sorted(kept.items()), "doc_id long, text string"), spark.read.parquet(f"{DATA}/benchmark.parquet"))
    kept = kept.keys() - {r["doc_id"] for r in leaks.collect()}
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in got} == kept
    taken = {}
    for r in got:
        taken.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in taken.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
