"""The pipeline against its stages done by hand, and the corpus queries against their DuckDB twins."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from utxolens.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, str(DATA)).cache()
        counts.append(docs.count())
        if name == "packing":
            assert docs.agg({"length": "sum"}).first()[0] > 0 and docs.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
        else:
            assert docs.columns == columns
            assert docs.select("doc_id").distinct().join(before.select("doc_id").distinct(), "doc_id", "left_anti").count() == 0
        if name == "secret_scans":
            assert counts[-1] == counts[-2] and docs.filter("text rlike 'AKIA[A-Z0-9]{16}'").count() == 0
    whole = corpus_pipeline.run(spark, str(DATA))
    assert sorted(map(tuple, whole.drop("sequence_id", "offset").collect())) == sorted(map(tuple, docs.drop("sequence_id", "offset").collect()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twin(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    df = queries.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    twin = con.sql(queries.ORACLE_SQL[name])
    names = list(twin.columns)
    text = lambda x: repr(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    ours = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    assert ours == sorted(tuple(text(r[names.index(c)]) for c in columns) for r in twin.fetchall())
