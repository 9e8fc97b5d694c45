"""R2: call-gap audit of an event log against a calls-per-minute limit.

The reference spaces model calls with an in-process limiter (10 per minute,
i.e. 6 s apart).  The audit computes, per user, the gap to the previous call
and the wait the limiter would have imposed.  The "previous call" is found
with a distributed lag: a global rank over (user, ts, id) -- the range sort
splits a hot user over many tasks -- and an equi-join of rank r with r - 1
(unique keys, no skew), instead of a per-user window that would sort a hot
user's whole history in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.ranking import global_rank


def call_gap_audit(calls: DataFrame, max_per_minute: int = 10) -> DataFrame:
    """calls: (call_id, user_id, ts) -> (call_id, user_id, gap_s, wait_s)."""
    interval = 60.0 / max_per_minute
    c = calls.select("call_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    r = global_rank(c, [F.col("user_id").asc(), F.col("us").asc(), F.col("call_id").asc()])
    prev = r.select(F.col("rnk").alias("prnk"), F.col("user_id").alias("puser"), F.col("us").alias("pus"))
    j = r.join(prev, (F.col("rnk") - 1) == F.col("prnk"), "left")
    same = F.col("puser") == F.col("user_id")
    gap = F.when(same, (F.col("us") - F.col("pus")) / F.lit(1e6))
    return j.select("call_id", "user_id", F.round(gap, 6).alias("gap_s"),
                    F.round(F.coalesce(F.greatest(F.lit(0.0), F.lit(interval) - gap), F.lit(0.0)), 6)
                    .alias("wait_s"))
