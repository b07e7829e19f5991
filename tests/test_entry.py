import duckdb

from conftest import SF001


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].total_records > 0
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 40


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) or type(value).__name__ == "Decimal" else str(value)


def test_some_oracles_at_smallest_scale(spark):
    import __spark_entry__ as E
    con = duckdb.connect()
    for t in ("documents", "events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    q, o = E.queries(), E.oracle_sql()
    for name in ("dedup_totals", "checkpoint_groups", "monitor_snapshot", "keep_latest_plan", "history_trends"):
        got = q[name](spark, SF001)
        cols = sorted(got.columns)
        a = sorted(tuple(plain(r[c]) for c in cols) for r in got.collect())
        rel = con.sql(o[name])
        ocols = rel.columns
        b = sorted(tuple(plain(r[ocols.index(c)]) for c in cols) for r in rel.fetchall())
        assert sorted(ocols) == cols, name
        assert a == b, name
