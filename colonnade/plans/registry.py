"""Registration of queries: a callable (spark, sf_dir) -> DataFrame and, where SQL can say it, the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The event view over the events table, for the SQL side.
EV = """ev AS (SELECT CAST(event_id AS VARCHAR) AS id, event_type, user_id AS repo_id, 'u' || user_id AS owner, json_extract_string(props, '$.k') AS suffix,
  'u' || user_id || '/' || json_extract_string(props, '$.k') AS repo_name, epoch_us(ts) // 1000000 AS epoch_s, event_id AS pos FROM events)"""


def query(name: str, sql: str | None = None):
    """Registers the decorated function under name; ``{EV}`` in the SQL stands for the event view."""

    def put(f):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql.replace("{EV}", EV)
        return f

    return put
