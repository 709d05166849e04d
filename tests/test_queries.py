"""Every registered query against its SQL on DuckDB, over the same tables."""

from __future__ import annotations

import pandas as pd
import pytest

from docquery import queries


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    cols = sorted(b.columns)
    assert sorted(a.columns) == cols

    def canon(df: pd.DataFrame) -> list[tuple]:
        return sorted(tuple("∅" if pd.isna(v) else f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None))

    assert canon(a) == canon(b)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(name, spark, duck, sf):
    same(queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(name, spark, sf):
    assert queries.QUERIES[name](spark, sf).limit(1).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(3).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
