"""All queries of the library outside the llm subpackage, with their SQL."""

from __future__ import annotations

from holdfast.plans import cycles, feature_tables, files, reads, regimes, replication

_PLANS = (cycles, feature_tables, files, reads, replication, regimes)
FLAGSHIP = "replication_report"


def queries() -> dict:
    return {name: fn for plan in _PLANS for name, fn in plan.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for plan in _PLANS for name, text in plan.SQL.items()}
