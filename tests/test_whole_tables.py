"""Registered queries that take whole tables, against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def plain(rows):
    return sorted(str(tuple(x for _, x in sorted(r.items()))) for r in rows)


@pytest.mark.parametrize(
    "name, of, least",
    [
        ("duration_between", "orders", 1.0),
        ("varlen_trail", "customer", 0.9),
        ("varlen_bfs_distinct", "events", 0.5),
        ("shortest_path_len", None, 0),
        ("all_shortest_count", None, 0),
        ("named_path", "events", 0.5),
    ],
)
def test_no_id_range_is_left_out(spark, small, name, of, least):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    got = [r.asDict() for r in entry.queries()[name](spark, small).collect()]
    found = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert plain(got) == plain([dict(zip(columns, r, strict=True)) for r in found.fetchall()])
    if of:
        assert len(got) >= least * con.execute(f"SELECT count(*) FROM {of}").fetchone()[0]
