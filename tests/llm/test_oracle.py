"""The corpus queries that have SQL, against an independent engine on the same tables."""

import duckdb
import pytest

from maskwright.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, name, sf):
    path = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    df = QUERIES[name](spark, path)
    cols = sorted(df.columns)
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == want


def test_all_eleven_are_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
