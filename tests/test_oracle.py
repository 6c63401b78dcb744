"""Every query with SQL against DuckDB over the smallest tables."""

import math

import duckdb
import pytest

from groundphrase.plans import catalog, evaluation, intents

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def ducks():
    out = {}
    for sf in (SF, LARGER):
        out[sf] = duckdb.connect()
        for t in TABLES:
            out[sf].execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return out


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    one = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


#: Where more rows bring halves, ties and every wording, at the larger size too.
CASES = [(SF, n) for n in sorted(catalog.ORACLE_SQL)] + [(LARGER, n) for n in sorted(evaluation.ORACLE_SQL | intents.ORACLE_SQL) if n not in ("html_escaped", "restore_fuzzy", "paired_latency")]


@pytest.mark.parametrize(("sf", "name"), CASES, ids=[f"{n}-{sf[-5:]}" for sf, n in CASES])
def test_query(spark, ducks, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    rel = ducks[sf].execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.collect(), df.columns) == plain(rel.fetchall(), names)
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows_only(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
