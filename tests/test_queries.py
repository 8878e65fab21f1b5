import duckdb
import pytest

from treelake.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([tuple(r) for r in df.select(*cols).collect()], key=repr)
    if name not in ORACLE_SQL:
        assert got
        return
    r = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted([tuple(row[i] for i in at) for row in r.fetchall()], key=repr)


def test_entry_without_the_training_data_operators(monkeypatch):
    import sys

    import __spark_entry__

    every = __spark_entry__.queries()
    assert "op1_sentencepiece" in every and "pipeline" in every or "op1_sentencepiece" not in every
    for name in [n for n in sys.modules if n.startswith("treelake.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "treelake.llm", None)
    assert __spark_entry__.queries() == QUERIES and __spark_entry__.oracle_sql() == ORACLE_SQL
