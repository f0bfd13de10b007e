"""Audit of labelled rows: checks as conditions, issues in long form, quarantine and clean output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import text as X
from siftwork.functions import tokens as T


def row_checks(valid: T.Vocabulary = T.V7) -> list[tuple[str, str, Column]]:
    """(check, severity, condition) of every check that a row decides for itself."""
    c = F.col
    short = F.length(X.text_of("jd_text"))
    bad = [~c(f).isin(valid.names(f)) for f in ("loc", "arr", "sen", "comp")]
    s = T.scores(c("loc"), c("sen"), F.split("tech", ","), c("comp"), valid)
    return [
        ("missing_job_id", "critical", X.text_of("job_id") == ""),
        ("missing_title", "critical", X.text_of("title") == ""),
        ("missing_jd", "critical", short == 0),
        ("invalid_token", "critical", bad[0] | bad[1] | bad[2] | bad[3]),
        ("score_mismatch", "critical", c("score") != s["score"]),
        ("label_mismatch", "critical", c("label") != T.label(c("score"))),
        ("short_jd", "warning", (short > 0) & (short < 100)),
        ("long_jd", "warning", short > 15000),
        ("html_artifacts", "warning", X.html_artifacts(X.text_of("jd_text"))),
        ("trivial_bad_fit", "warning", (c("label") == "bad_fit") & (c("loc") == "OUTSIDE_UK") & (c("tech") == "OOS")),
    ]


def issues(df: DataFrame, order: str = "line_no") -> DataFrame:
    """line, job_id, severity, check: one row for each failed check, duplicates of keys included."""
    flagged = [F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(sev).alias("severity"), F.lit(name).alias("check"))) for name, sev, cond in row_checks()]
    own = df.select(F.col(order).alias("line"), "job_id", F.explode(F.array_compact(F.array(*flagged))).alias("x")).select("line", "job_id", "x.*")
    keys = {"duplicate_id": F.col("job_id"), "duplicate_title_company": X.pair_key(X.text_of("title"), X.text_of("company")), "duplicate_jd_fingerprint": X.fingerprint(X.text_of("jd_text"))}
    for name, k in keys.items():
        first = df.groupBy(k.alias("_k")).agg(F.min(order).alias("_f"))
        dup = df.withColumn("_m", k).join(first, F.col("_m") == F.col("_k")).where(F.col(order) > F.col("_f"))
        own = own.unionByName(dup.select(F.col(order).alias("line"), "job_id", F.lit("warning").alias("severity"), F.lit(name).alias("check")))
    return own


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("check").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warning"))


REMOVES = ["duplicate_id", "duplicate_title_company", "short_jd"]


def clean(df: DataFrame, found: DataFrame, order: str = "line_no") -> DataFrame:
    """Rows without a critical issue, a removed duplicate or a text that is too short."""
    bad = found.where((F.col("severity") == "critical") | F.col("check").isin(REMOVES)).select(F.col("line").alias("_l")).distinct()
    return df.join(bad, F.col(order) == F.col("_l"), "left_anti")


def quarantine(found: DataFrame) -> DataFrame:
    """Each issue with the bucket of its side output."""
    bucket = F.when(F.col("check").startswith("duplicate"), "duplicates").when(F.col("severity") == "critical", "bad_data").otherwise("suspicious")
    return found.withColumn("bucket", bucket)


def distribution_issues(df: DataFrame, half: float = 0.5, cap: float = 0.05, boundary: float = 0.15) -> DataFrame:
    """check, subject and pct: tokens above half of all rows, sources above their cap, and a boundary zone that is too small."""
    total = df.agg(F.count("*").alias("total"), F.count_if(F.col("score").between(50, 74)).alias("edge"))
    pct = lambda n: F.round(100.0 * n / F.col("total"), 1)
    tokens = df.select(F.explode(F.array(*[F.concat_ws("=", F.lit(f), F.coalesce(F.col(f), F.lit("(missing)"))) for f in T.FIELDS])).alias("subject"))
    shares = tokens.groupBy("subject").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).where(F.col("n") > half * F.col("total"))
    sources = df.where("source_file is not null").groupBy(F.col("source_file").alias("subject")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).where(F.col("n") > cap * F.col("total"))
    of = lambda name, found: found.select(F.lit(name).alias("check"), "subject", pct(F.col("n")).alias("pct"))
    zone = total.where((F.col("total") > 0) & (F.col("edge") < boundary * F.col("total"))).select(F.lit("score 50-74").alias("subject"), F.col("edge").alias("n"), "total")
    return of("distribution_imbalance", shares).unionByName(of("source_weight_cap", sources)).unionByName(of("boundary_starvation", zone))
