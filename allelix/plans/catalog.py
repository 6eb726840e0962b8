"""Registered queries of the variant operators and their DuckDB oracles."""

from __future__ import annotations

from allelix.plans import annotations, biases, calls, consequences, core, ligations, merges, models, pileups, streams, views  # noqa: F401  (they register their queries)
from allelix.plans.registry import ORACLES, QUERIES, Query

FLAGSHIP = "region_overlap_semi"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
