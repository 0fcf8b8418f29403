"""Views that put annotation shapes on the test tables; the same text runs on Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "a1": """
        SELECT concat('v', CAST(s_suppkey AS STRING)) AS video_id,
          concat('H', CAST(s_suppkey % 7 AS STRING), ',I', CAST(s_suppkey % 5 AS STRING)) AS camera_id,
          concat('/data/clips/H', CAST(s_suppkey % 7 AS STRING), '%2CI', CAST(s_suppkey % 5 AS STRING),
                 '/v', CAST(s_suppkey AS STRING), '.mp4') AS video_path,
          CAST(60 + s_suppkey % 40 AS BIGINT) AS frames_count,
          CAST(60 + s_suppkey % 40 AS DOUBLE) / CAST(25 AS DOUBLE) AS duration,
          CAST(24 + s_suppkey % 13 AS DOUBLE) AS true_fps
        FROM {supplier}""",
    "a2": """
        SELECT concat(CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING), '_', CAST(l_partkey AS STRING),
                 '_', CAST(l_suppkey AS STRING)) AS track_id,
          concat('v', CAST(l_suppkey AS STRING)) AS video_id,
          concat('H', CAST(l_suppkey % 7 AS STRING), ',I', CAST(l_suppkey % 5 AS STRING)) AS camera_id,
          CASE l_returnflag WHEN 'A' THEN 'Foraging' WHEN 'N' THEN 'Resting' ELSE 'Preening' END AS label,
          CAST(1 + l_partkey % 50 AS BIGINT) AS frame_begin,
          CAST(1 + l_partkey % 50 + CAST(l_quantity AS BIGINT) % 30 AS BIGINT) AS frame_end
        FROM {lineitem}""",
    "a3": """
        SELECT concat('u', CAST(user_id AS STRING), '_', event_type) AS track_id,
          event_id % 97 AS frame,
          CAST(min(event_id % 60) AS DOUBLE) AS x, CAST(min((event_id * 3) % 60) AS DOUBLE) AS y,
          CAST(min(10 + user_id % 20) AS DOUBLE) AS width, CAST(min(8 + event_id % 15) AS DOUBLE) AS height
        FROM {events} GROUP BY user_id, event_type, event_id % 97""",
    "a4": """
        SELECT CAST(vec_id % 5 AS BIGINT) AS video_id, CAST(floor(vec_id / 15) AS BIGINT) AS frame,
          concat('c', CAST(CAST(floor(vec_id / 5) AS BIGINT) % 3 AS STRING)) AS cage_id, embedding
        FROM {embeddings}""",
    "a5": """
        SELECT CAST(l_orderkey % 20 AS BIGINT) AS video_id, CAST(l_linenumber AS BIGINT) AS cage_id,
          CAST(floor(l_orderkey / 20) AS BIGINT) AS frame,
          max(l_quantity) > 5 AS has_gt, max(l_tax) > 0.015 AS has_pred,
          CAST(1 + CAST(floor(l_orderkey / 400) AS BIGINT) % 3 AS BIGINT) AS pred_id,
          CAST(20 + min(l_partkey) % 50 AS DOUBLE) AS gt_left, CAST(15 + min(l_suppkey) % 40 AS DOUBLE) AS gt_top,
          CAST(30 AS DOUBLE) AS w, CAST(24 AS DOUBLE) AS h,
          CAST(20 + min(l_partkey) % 50 + l_orderkey % 13 AS DOUBLE) AS pred_left,
          CAST(15 + min(l_suppkey) % 40 + min(l_partkey) % 7 AS DOUBLE) AS pred_top
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "a6": "SELECT vec_id, label AS true_class, embedding FROM {embeddings}",
    "a7": """
        SELECT CAST(o_custkey % 20 AS BIGINT) AS run_id, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS epoch,
          o_orderkey AS batch_id, o_totalprice / CAST(100000 AS DOUBLE) AS loss,
          CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS correct
        FROM {orders}""",
    "a8": """
        SELECT o.o_orderkey AS video_idx, l.l_linenumber AS result_no,
          CAST(l.l_orderkey AS STRING) || '_' || CAST(l.l_linenumber AS STRING) || '_' || CAST(l.l_partkey AS STRING)
            || '_' || CAST(l.l_suppkey AS STRING) AS track_id,
          CASE l.l_returnflag WHEN 'A' THEN 'Foraging' WHEN 'N' THEN 'Resting' ELSE 'Preening' END AS label,
          CAST(l.l_partkey % 50 AS BIGINT) AS frame
        FROM {orders} o LEFT JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that go to one task where they are nested by key.
ROWS_A_TASK = 250_000


def tasks_for(spark: SparkSession, sf_dir: str, name: str, rows_a_task: int | None = None) -> int:
    """Tasks for the rows of a table, which are counted from the files' footers; at least as many as run at once."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, name).count() // (rows_a_task or ROWS_A_TASK)))


def adapter(spark: SparkSession, sf_dir: str, name: str, keys: dict[str, str] | None = None) -> DataFrame:
    """The view ``name``. With ``keys``, tables go by these columns to tasks whose number grows with the tables (rows are counted from
    the files' footers), so that what a task nests does not."""
    used = set(re.findall(r"\{(\w+)\}", SQL[name]))
    tables = {t: table(spark, sf_dir, t) for t in used}
    if keys:
        n = max(tasks_for(spark, sf_dir, t) for t in keys)
        tables |= {t: tables[t].repartition(n, key) for t, key in keys.items()}
    return spark.sql(SQL[name], **tables)


#: What ``a8`` is nested by.
TASK_KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}


def oracle(query: str, *names: str, recursive: bool = False) -> str:
    """SQL for DuckDB: the adapters as common table expressions before a query that starts with its own
    ones (``name AS (...), ...``) or with SELECT."""
    views = [f"{n} AS ({re.sub(r'[{}]', '', SQL[n])})" for n in names]
    body = query.strip()
    joint = " " if body.upper().startswith("SELECT") else ", "
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(views)}{joint}{body}"
