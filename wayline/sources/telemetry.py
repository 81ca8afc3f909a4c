"""Dense telemetry derived from the events table: the same text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TELEMETRY_SQL = """
SELECT concat('D', CAST(dev AS VARCHAR(4))) AS device_id,
  1704067200000 + seq*100 + CAST(floor(seq/900) AS BIGINT)*5000 AS t_ms,
  CASE WHEN event_id % 211 = 0 THEN 'GPCHC' ELSE 'GPCHCX' END AS protocol,
  CAST(c % 10 AS INT) AS fix_mode, CAST(CAST(floor(c/10) AS BIGINT) % 4 AS INT) AS nav_mode, CAST(c % 32768 AS INT) AS warning,
  CASE WHEN event_id % 307 = 0 THEN NULL
       WHEN regime = 0 THEN 1.0E0 + ((c % 101) - 50)/10000.0E0
       WHEN regime = 3 THEN 1.0E0 + (c % 9000)/10000.0E0
       ELSE 1.011E0 + (c % 100)/10000.0E0 END AS ax,
  0.0E0 AS ay, 0.0E0 AS az,
  (c % 13)/10.0E0 AS gx, (c % 17)/10.0E0 AS gy, (c % 19)/10.0E0 AS gz,
  CASE WHEN regime = 0 THEN (c % 40)/100.0E0
       WHEN regime = 3 THEN 5.0E0 + (c % 4000)/100.0E0
       ELSE 20.0E0 + (c % 600)/100.0E0 END AS speed,
  31.2E0 + seq*0.00002E0 + CASE WHEN event_id % 997 = 0 THEN 0.01E0 ELSE 0.0E0 END AS lat,
  121.6E0 + dev*0.1E0 AS lon,
  (c % 500)/10.0E0 AS alt,
  (c % 700)/100.0E0 AS ve, (c % 900)/100.0E0 AS vn,
  (c % 300)/100.0E0 AS lat_std, (c % 250)/100.0E0 AS lon_std, (c % 350)/100.0E0 AS alt_std,
  ((c % 41) - 20)*1.0E0 AS pitch, ((c % 61) - 30)*1.0E0 AS roll,
  (c % 360)*1.0E0 AS heading, (c % 15)*1.0E0 AS age,
  (c % 1100)/100.0E0 - 5.5E0 AS vu, (c % 530)/100.0E0 AS ve_std, (c % 200)/100.0E0 AS vn_std, (c % 150)/100.0E0 AS vu_std,
  (c % 90)/100.0E0 AS roll_std, (c % 80)/100.0E0 AS pitch_std, (c % 120)/100.0E0 AS heading_std,
  ((c * 7) % 360)*1.0E0 AS course, (c % 140)/100.0E0 AS course_std,
  (c % 30)*1.0E0 AS sat1, (c % 28)*1.0E0 AS sat2
FROM (
  SELECT *, CAST(floor(seq/50) AS BIGINT) % 4 AS regime FROM (
    SELECT event_id, user_id, event_type, CAST(round(value*100) AS BIGINT) AS c,
           event_id % 4 AS dev, CAST(floor(event_id/4) AS BIGINT) AS seq
    FROM {events}))
"""


#: Rows of a task whose work is heavy for each row: some tens of seconds.
TASK_ROWS = 100_000


def telemetry(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The view over the events; dealt, if what follows is heavy for each row."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if dealt:  # its columns only: they are a sixth of the view's
        events = spread(events.select("event_id", "user_id", "event_type", "value"))
    return spark.sql(TELEMETRY_SQL, events=events)


def spread(scan: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """Rows of a scan dealt to all cores, and to tasks of about so many rows, if it has fewer parts than that: for work that is heavy for each row. A part of a scan may hold millions of rows, or none."""
    parts = max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // rows))
    return scan.repartition(parts) if scan.rdd.getNumPartitions() < parts else scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
