"""Every query with a SQL twin gives the rows of that twin; contracts of the others; the pipeline."""

from collections import Counter

import duckdb
import pytest

from precis.llm import pipeline
from precis.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    twin = duck.execute(ORACLES[name])
    names = [d[0] for d in twin.description]
    assert sorted(names) == sorted(found.columns)
    mine = sorted(tuple(str(r[c]) for c in names) for r in found.collect())
    assert mine == sorted(tuple(map(str, r)) for r in twin.fetchall())


def test_there_are_thirteen_queries():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))


def test_pipeline(spark):
    import corpus_pipeline

    assert corpus_pipeline.STAGES == pipeline.STAGES and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    sizes = []
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert sorted(docs.columns) == sorted(pipeline.COLUMNS), name
        docs = docs.cache()
        sizes.append(docs.count())
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} <= ids
    found = pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert found.count() == sizes[-1]
    assert sizes[0] >= 190 and sizes[1] < sizes[0] and sizes[2] == sizes[1]
    counts = Counter(r["doc_id"] for r in found.select("doc_id").collect())
    assert max(counts.values()) <= 3


def test_pipeline_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, f"some words that are number {i} of this table and go on for a while {i}", "en", "a", 60) for i in range(20)]
    rows += [(30, None, None, None, None), (31, "", "en", "b", 0), (32, "12 34", "en", "b", 5), (None, rows[3][1], "en", None, 1)]
    rows += [rows[4], rows[5]]
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
        got = docs.collect()
        assert {r["doc_id"] for r in got} <= {r[0] for r in table}
        assert all(r["n_tokens"] == len(r["ids"]) for r in got)


def test_one_row_of_repeated_ids_and_of_equal_texts_without_id(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = [" ".join(f"t{i}w{j}" for j in range(12)) for i in range(4)]
    rows = [(1, words[0]), (1, words[0]), (1, words[1]), (2, words[0]), (3, words[2]), (4, None), (4, None), (4, "")]
    rows += [(None, words[3])] * 3 + [(None, words[2]), (None, None), (None, None)]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], schema).repartition(3)
    found = pipeline.one_of_each_group(spark, docs, FOLDER)
    got = Counter((r["doc_id"], r["text"]) for r in found.collect())
    assert got == Counter(set(rows) - {(2, words[0])})
