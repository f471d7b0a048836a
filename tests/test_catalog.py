"""Every registered query of the reference's operators against its DuckDB SQL at sf0.001."""

import duckdb
import pytest

from corpusmill import catalog

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events".split()


def canonical(frame):
    cols = sorted(frame.columns)
    out = frame[cols].copy()
    for c in cols:
        if str(out[c].dtype).startswith("float"):
            out[c] = out[c].map(lambda v: "null" if v != v else f"{v:.5f}")
        else:
            out[c] = out[c].map(lambda v: "null" if v is None or v != v else str(v))
    return cols, sorted(map(tuple, out.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = catalog.queries()[name](spark, SF).toPandas()
    want = con.sql(catalog.oracle_sql()[name]).df()
    assert canonical(got) == canonical(want)
