"""Every hash-checked query equals its DuckDB oracle (rows, columns, values)."""

import math

import pytest

import __spark_entry__ as E
from conftest import SF_ORACLE

ORACLES = E.oracle_sql()
QUERIES = E.queries()


def _norm(v):
    if v is None:
        return "NULL"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and math.isnan(v):
        return "NULL"
    return repr(v)


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, key):
    sp = QUERIES[key](spark, SF_ORACLE).toPandas()
    dk = duck.sql(ORACLES[key]).df()
    cs, rs = _rows(sp)
    cd, rd = _rows(dk)
    assert cs == cd
    assert len(rs) == len(rd)
    assert rs == rd


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["segmento", "acao_nome", "clientes", "aceites_esperados", "salvos_esperados", "custo"]
    assert sum(r["clientes"] for r in rows) == 100
