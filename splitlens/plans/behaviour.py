"""Plans for behaviour jobs."""

from __future__ import annotations

from splitlens.operators import behaviour as B
from splitlens.pinned import EXP_ID, SESSION_GAP_SECONDS
from splitlens.plans.common import duck_variant
from splitlens.plans.registry import query
from splitlens.sources.tables import read_table

_FUNNEL_CTE = """
ev AS (SELECT user_id, CAST(ts AS DATE) AS day, ts, event_type FROM events),
s1 AS (SELECT user_id, day, min(ts) AS t FROM ev WHERE event_type = 'view' GROUP BY 1, 2),
s2 AS (SELECT ev.user_id, ev.day, min(ev.ts) AS t FROM ev JOIN s1
         ON ev.user_id = s1.user_id AND ev.day = s1.day
       WHERE ev.event_type = 'click' AND ev.ts > s1.t GROUP BY 1, 2),
s3 AS (SELECT ev.user_id, ev.day, min(ev.ts) AS t FROM ev JOIN s2
         ON ev.user_id = s2.user_id AND ev.day = s2.day
       WHERE ev.event_type = 'purchase' AND ev.ts > s2.t GROUP BY 1, 2),
steps AS (SELECT 'view' AS step, 1 AS step_no, user_id FROM s1
          UNION ALL SELECT 'click', 2, user_id FROM s2
          UNION ALL SELECT 'purchase', 3, user_id FROM s3)"""


@query("funnel", f"""WITH {_FUNNEL_CTE},
c AS (SELECT step, step_no, count(*) AS n FROM steps GROUP BY 1, 2)
SELECT step, CAST(step_no AS INTEGER) AS step_no, CAST(n AS BIGINT) AS user_days,
       round(CASE WHEN step_no = 1 THEN 1.0
                  ELSE n / lag(n) OVER (ORDER BY step_no) END, 4) AS step_rate,
       round(n / first_value(n) OVER (ORDER BY step_no), 4) AS total_rate
FROM c""")
def q_funnel(spark, sf):
    return B.funnel(read_table(spark, sf, "events"))


@query("funnel_by_variant", f"""WITH {_FUNNEL_CTE},
c AS (SELECT {duck_variant('user_id')} AS variant, step, step_no, count(*) AS n
      FROM steps GROUP BY 1, 2, 3)
SELECT variant, step, CAST(step_no AS INTEGER) AS step_no, CAST(n AS BIGINT) AS user_days,
       round(CASE WHEN step_no = 1 THEN 1.0
                  ELSE n / lag(n) OVER (PARTITION BY variant ORDER BY step_no) END, 4) AS step_rate,
       round(n / first_value(n) OVER (PARTITION BY variant ORDER BY step_no), 4) AS total_rate
FROM c""")
def q_funnel_by_variant(spark, sf):
    return B.funnel(read_table(spark, sf, "events"), exp_id=EXP_ID)


_HOURS = ",\n       ".join(
    f"count(*) FILTER (WHERE hour(ts) = {h}) AS h{h}" for h in range(24))


@query("heatmap", f"""
SELECT CAST(isodow(ts) - 1 AS INTEGER) AS dow,
       {_HOURS}
FROM events GROUP BY 1""")
def q_heatmap(spark, sf):
    return B.heatmap(read_table(spark, sf, "events"))


@query("action_transitions", f"""
WITH l AS (
  SELECT event_type,
         lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_type,
         lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev_ts, ts
  FROM events WHERE user_id IS NOT NULL)
SELECT prev_type AS from_type, event_type AS to_type, CAST(count(*) AS BIGINT) AS n
FROM l
WHERE prev_ts IS NOT NULL AND date_diff('microsecond', prev_ts, ts) <= {SESSION_GAP_SECONDS * 1_000_000}
GROUP BY 1, 2""")
def q_action_transitions(spark, sf):
    return B.transitions(read_table(spark, sf, "events"))
