"""Plans for ETL jobs and file sources/sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitlens.operators import etl as E
from splitlens.pinned import MONEY
from splitlens.plans.registry import query
from splitlens.sources import files
from splitlens.sources.tables import read_table

_COLS = "event_id, ts, user_id, event_type, value, props"


@query("clean_logs", f"""
WITH raw AS (
  SELECT {_COLS}, 0 AS src FROM events
  UNION ALL SELECT event_id, ts, user_id, '  ' || upper(event_type) || ' ', value, props, 1 FROM events
  UNION ALL SELECT event_id, ts, NULL, event_type, value, props, 2 FROM events
  UNION ALL SELECT event_id, ts, user_id, event_type, -value - 1, props, 3 FROM events),
n AS (SELECT event_id, ts, user_id, lower(trim(event_type)) AS event_type, value, props, src FROM raw),
v AS (SELECT * FROM n WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL
        AND event_type IN ('click', 'error', 'purchase', 'signup', 'view')
        AND (value IS NULL OR value >= 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY src, ts) AS rn FROM v)
SELECT {_COLS} FROM r WHERE rn = 1""")
def q_clean_logs(spark, sf):
    return E.clean_logs(E.dirty_copies(read_table(spark, sf, "events")))


@query("merge_events", f"""
WITH u AS (
  SELECT {_COLS}, 0 AS src FROM events WHERE hour(ts) < 16
  UNION ALL SELECT {_COLS}, 1 AS src FROM events WHERE hour(ts) >= 8),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY src) AS rn FROM u)
SELECT {_COLS} FROM r WHERE rn = 1""")
def q_merge_events(spark, sf):
    a, b = E.overlapping_exports(read_table(spark, sf, "events"))
    return E.merge_events(a, b)


@query("clean_tags", """
WITH m AS (SELECT user_id, '  ' || upper(event_type) || ' ,, V'
                  || CAST(CAST(floor(value / 100) AS BIGINT) AS VARCHAR) || ' ,' AS tags_raw FROM events),
t AS (SELECT user_id, unnest(string_split(tags_raw, ',')) AS raw FROM m),
c AS (SELECT DISTINCT user_id, lower(trim(raw)) AS tag FROM t WHERE trim(raw) <> '')
SELECT user_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM c GROUP BY 1""")
def q_clean_tags(spark, sf):
    return E.clean_tags(E.messy_tags(read_table(spark, sf, "events")))


_SUMMARY_SQL = """
SELECT user_id, CAST(count(*) AS BIGINT) AS events,
       CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS views,
       CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS clicks,
       CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS purchases,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total_value,
       min(ts) AS first_ts, max(ts) AS last_ts
FROM events GROUP BY user_id"""


@query("user_summary", _SUMMARY_SQL)
def q_user_summary(spark, sf):
    return E.user_summary(read_table(spark, sf, "events"))


@query("parquet_user_summary", _SUMMARY_SQL)
def q_parquet_user_summary(spark, sf):
    s = E.user_summary(read_table(spark, sf, "events"))
    return files.roundtrip_parquet(spark, s, "user_summary")


@query("csv_events", """
SELECT event_type, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total_value
FROM events GROUP BY event_type""")
def q_csv_events(spark, sf):
    ev = read_table(spark, sf, "events").select(*E.EVENT_COLS)
    back = files.roundtrip_csv(spark, ev, files.EVENTS_SCHEMA, "raw_events")
    return (back.groupBy("event_type")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                 F.sum(F.col("value").cast(MONEY)).cast(MONEY).alias("total_value")))


TSV_SCHEMA = T.StructType([T.StructField("n_nationkey", T.IntegerType()),
                           T.StructField("n_name", T.StringType()),
                           T.StructField("r_name", T.StringType())])


@query("tsv_export", """
SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def q_tsv_export(spark, sf):
    n, r = read_table(spark, sf, "nation"), read_table(spark, sf, "region")
    out = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    return files.roundtrip_csv(spark, out, TSV_SCHEMA, "nation_export", sep="\t")
