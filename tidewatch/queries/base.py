"""Registry of named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise KeyError(f"query {name!r} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, folder)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# The flow views as SQL common table expressions.
FE = """
fe0 AS (SELECT event_id, ts AS timestamp, CAST(event_type = 'error' AS INTEGER) AS label,
  value AS flow_duration, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS k1,
  value, CASE user_id % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' ELSE 'ICMP' END AS protocol,
  value / (value + CAST(50 AS DOUBLE)) AS score FROM events),
fe1 AS (SELECT event_id, timestamp, label, flow_duration, CAST(k1 AS DOUBLE) AS total_packets,
  value * CAST(k1 AS DOUBLE) AS total_bytes, protocol, score FROM fe0),
fe AS (SELECT *, CASE WHEN flow_duration > 0 THEN total_packets / flow_duration ELSE 0 END AS packet_rate,
  CASE WHEN flow_duration > 0 THEN total_bytes / flow_duration ELSE 0 END AS byte_rate,
  CASE WHEN total_packets > 0 THEN total_bytes / total_packets ELSE 0 END AS mean_packet_size,
  CASE WHEN total_packets > 0 THEN total_bytes / total_packets ELSE 0 END AS bytes_per_packet,
  ln(1 + flow_duration) AS duration_log1p, ln(1 + total_packets) AS packets_log1p,
  ln(1 + total_bytes) AS bytes_log1p FROM fe1)"""

FL = """
fl0 AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate AS timestamp,
  CAST(l_returnflag = 'R' AS INTEGER) AS label, l_tax * CAST(100 AS DOUBLE) AS flow_duration,
  l_quantity AS forward_packets, CAST(l_linenumber AS DOUBLE) AS backward_packets,
  l_extendedprice AS forward_bytes, l_extendedprice * l_discount AS backward_bytes,
  l_linestatus AS protocol, l_discount * CAST(10 AS DOUBLE) AS score FROM lineitem),
fl1 AS (SELECT *, forward_packets + backward_packets AS total_packets,
  forward_bytes + backward_bytes AS total_bytes FROM fl0),
fl AS (SELECT *, CASE WHEN flow_duration > 0 THEN total_packets / flow_duration ELSE 0 END AS packet_rate,
  CASE WHEN flow_duration > 0 THEN total_bytes / flow_duration ELSE 0 END AS byte_rate,
  CASE WHEN total_packets > 0 THEN total_bytes / total_packets ELSE 0 END AS mean_packet_size,
  CASE WHEN total_packets > 0 THEN total_bytes / total_packets ELSE 0 END AS bytes_per_packet,
  ln(1 + flow_duration) AS duration_log1p, ln(1 + total_packets) AS packets_log1p,
  ln(1 + total_bytes) AS bytes_log1p,
  least(greatest(forward_bytes / (total_bytes + CAST(1e-9 AS DOUBLE)), 0), 1) AS bytes_ratio,
  least(greatest(forward_packets / (total_packets + CAST(1e-9 AS DOUBLE)), 0), 1) AS packets_ratio FROM fl1)"""


def cuts_sql(source: str, fractions: tuple[float, ...] = (0.5, 0.15, 0.15, 0.2)) -> str:
    """CTEs ``cuts`` (one row c1..) and ``sp`` (rows with their period) over a flow CTE."""
    names = ["train", "validation", "backtest", "forward"][: len(fractions)]
    running, cols = 0.0, []
    for i, fraction in enumerate(fractions[:-1], 1):
        running += fraction
        cols.append(f"min(CASE WHEN cum >= round_even(total * CAST({running!r} AS DOUBLE), 0) THEN timestamp END) AS c{i}")
    cases = " ".join(f"WHEN timestamp <= c{i} THEN '{names[i - 1]}'" for i in range(1, len(fractions)))
    return f"""
axis AS (SELECT timestamp, sum(count(*)) OVER (ORDER BY timestamp) AS cum, sum(count(*)) OVER () AS total
  FROM {source} GROUP BY timestamp),
cuts AS (SELECT {', '.join(cols)} FROM axis),
sp AS (SELECT {source}.*, CASE {cases} ELSE '{names[-1]}' END AS period FROM {source}, cuts)"""
