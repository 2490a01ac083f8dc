"""Registry of queries: each a function of (spark, sf_dir), most with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Query = Callable[..., DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Telemetry as SQL over the table events; what hearthlake.sources.telemetry.from_events reads.
TELEMETRY = """(SELECT user_id AS device_id, event_type AS metric_key, ts AS time, value,
  CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END AS quality, event_id % 50 = 7 AS is_virtual FROM events)"""
#: Its rows of quality 0 that are not virtual.
NORMAL = f"(SELECT * FROM {TELEMETRY} WHERE quality = 0 AND NOT is_virtual)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name. {T} and {N} in ``sql`` stand for TELEMETRY and NORMAL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql.replace("{T}", TELEMETRY).replace("{N}", NORMAL)
        return f

    return add
