"""Common table expressions of the DuckDB oracles. They are written from the definitions, apart from the Spark code."""

from __future__ import annotations

_BARS = """
  first({p} ORDER BY {o}) AS open, max({p}) AS high, min({p}) AS low, last({p} ORDER BY {o}) AS close,
  sum({v}) AS volume, sum({v} * {p}) AS quote_volume, count(*) AS trades,
  sum(CASE WHEN {b} THEN {v} ELSE 0.0 END) AS taker_buy_base, sum(CASE WHEN {b} THEN {v} * {p} ELSE 0.0 END) AS taker_buy_quote
"""
HOURLY = "e AS (SELECT event_type AS symbol, date_trunc('hour', ts) + INTERVAL 1 HOUR AS ts, " + _BARS.format(p="value", o="ts, event_id", v="value", b="user_id % 2 = 0").replace("ORDER BY ts,", "ORDER BY events.ts,") + " FROM events GROUP BY 1, 2)"
DAILY = "o AS (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate) + INTERVAL 1 DAY AS ts, " + _BARS.format(p="o_totalprice", o="o_orderkey", v="1.0", b="o_custkey % 2 = 0") + " FROM orders GROUP BY 1, 2)"


def grid(bars: str, step: str, name: str) -> str:
    """A complete grid of a bars expression; prices are NULL and volumes 0 on gaps."""
    zero = ", ".join(f"coalesce(b.{c}, 0) AS {c}" for c in ("volume", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote"))
    return f"""{name} AS (SELECT s.symbol, s.ts, b.open, b.high, b.low, b.close, {zero}, b.close IS NULL AS gap
      FROM (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL {step})) AS ts FROM {bars} GROUP BY symbol) s LEFT JOIN {bars} b ON b.symbol = s.symbol AND b.ts = s.ts)"""


HOURLY_GRID = HOURLY + ", " + grid("e", "1 HOUR", "g")
DAILY_GRID = DAILY + ", " + grid("o", "1 DAY", "d")
LABELLED = "c AS (SELECT l.doc_id, d.source, l.quality AS y, round(1 / (1 + exp(-(ln(d.n_chars + 1.0) - 7.0))), 4) AS p, d.n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL)"
WEEKLY = "l AS (SELECT l_suppkey AS symbol, date_trunc('week', l_shipdate) AS ts, sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)"
