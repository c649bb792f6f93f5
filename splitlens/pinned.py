"""Pinned rules: the design decisions the blueprint fixes where the source leaves them open.

Fixed values (must stay exactly as written for results to line up with the oracle):
  experiment id ......... exp-1 (a second id, exp-2, only appears in the filter demo)
  variants .............. A, B
  experiment window ..... 1997-05-13 .. 1997-06-23, whole days, end inclusive
  churn reference date .. 2001-08-01, churn horizon 365 days
  churn-model cutoff .... 2000-08-01
  one-sample z null ..... 0.16
  session gap ........... 30 minutes
  funnel steps .......... view, click, purchase
  significance level .... 0.05
"""

from __future__ import annotations

import datetime as dt

EXP_ID = "exp-1"
EXP_ID_OTHER = "exp-2"
VARIANTS = ("A", "B")
WINDOW_START = dt.date(1997, 5, 13)
WINDOW_END = dt.date(1997, 6, 23)
CHURN_REF_DATE = dt.date(2001, 8, 1)
CHURN_HORIZON_DAYS = 365
CHURN_CUTOFF = dt.date(2000, 8, 1)
ONE_SAMPLE_NULL = 0.16
SESSION_GAP_SECONDS = 30 * 60
FUNNEL_STEPS = ("view", "click", "purchase")
ALPHA = 0.05

MONEY = "decimal(18,2)"
RATE_DP = 4      # ratios (the 4-decimal display rule)
STAT_DP = 6      # statistics and p-values
INTERVAL_DP = 5  # ends of Beta credible intervals
