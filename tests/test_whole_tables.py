"""Queries over every row of their tables: what they give covers each row, not an id subset."""

from __future__ import annotations

from compare import connect

from quillon import queries as core


def test_every_row_counts(spark, small):
    c, run = connect(small), core.queries()
    one = lambda sql: c.execute(sql).fetchone()[0]
    ranges = run["range_overlap"](spark, small)
    lines = "from (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::bigint from lineitem)"
    assert ranges.count() == one(f"select count(*) {lines}")
    assert run["undoer_vote"](spark, small).count() == one("select count(distinct user_id) from events")
    assert run["history_window"](spark, small).count() == one("select count(distinct event_id) from events")


def test_landing_walks_all_orders(spark, small):
    orders = {r[0] for r in connect(small).execute("select o_orderkey from orders").fetchall()}
    wanted = {k: -(-k // 10) for k in orders if -(-k // 10) * 10 in orders}
    assert len(wanted) > 1000
    assert {r["sha"]: r["position"] for r in core.queries()["landing_positions"](spark, small).collect()} == wanted
