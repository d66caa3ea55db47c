"""Every named query with its SQL oracle."""

from __future__ import annotations

from tidemark.plans import q_accounts, q_backtest, q_bars, q_features, q_live, q_stats, q_studies  # noqa: F401  registers its queries
from tidemark.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
