"""Run history: deltas, last runs, ranks, running accuracy, streaks and the row at which a run would stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deltas(df: DataFrame, by: str, order: str, metric: str, dead: float = 0.05) -> DataFrame:
    """Change against the previous run of the same model, and its direction outside a dead band."""
    d = F.round(F.col(metric) - F.lag(metric).over(Window.partitionBy(by).orderBy(order)), 4)
    return df.withColumn("delta", d).withColumn("trend", F.when(d.isNull(), "new").when(d > dead, "up").when(d < -dead, "down").otherwise("same"))


def last_runs(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.col(order).desc())
    return df.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def running(df: DataFrame, by: str, order: str, ok: Column) -> DataFrame:
    """Rows seen, hits and accuracy so far, and the length of the current run of misses; rows that neither hit nor miss
    (ok null) leave the streak as it is."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    hit = F.when(ok, 1).otherwise(0)
    out = df.withColumn("seen", F.count(ok).over(w)).withColumn("hits", F.sum(hit).over(w))
    island = Window.partitionBy(by, "hits").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("streak", F.sum(F.when(~ok, 1).otherwise(0)).over(island))


def stops(df: DataFrame, by: str, order: str, ok: Column, label: str, streak: int = 25, same: int = 5, seconds: str | None = None, limit: float = 0.0) -> DataFrame:
    """The first row of each group at which one of the early-exit rules holds, and the rule; with a column of seconds, also
    that of a mean of twice the limit."""
    r = running(df, by, order, ok)
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("labels", F.size(F.collect_set(label).over(w))).withColumn("rows", F.count("*").over(w))
    slow = (F.col("rows") >= 2) & (F.avg(seconds).over(w) >= 2 * limit) if seconds else F.lit(False)
    rule = F.when((F.col("seen") == 0) & (F.col("rows") >= 2), "all_failed").when(slow, "slow").when(F.col("streak") >= streak, "streak").when((F.col("seen") >= same) & (F.col("labels") == 1), "one_label")
    return r.withColumn("rule", rule).where("rule is not null").groupBy(by).agg(F.min_by("rule", order).alias("rule"), F.min(order).alias("at"))


def best(df: DataFrame, metric: str, size: str) -> DataFrame:
    """Rows of the best metric flagged, and the smallest of them named the winner."""
    top = df.agg(F.max(metric).alias("_top"))
    out = df.crossJoin(F.broadcast(top)).withColumn("best", F.col(metric) == F.col("_top"))
    least = out.where("best").agg(F.min(size).alias("_least"))
    return out.crossJoin(F.broadcast(least)).withColumn("winner", F.col("best") & (F.col(size) == F.col("_least"))).drop("_top", "_least")
