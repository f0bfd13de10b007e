"""Evaluation: gold against predictions, accuracies, confusion, hybrids of rules and model, intervals and bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import tokens as T

LABELS = ["good_fit", "maybe", "bad_fit"]
FIELDS = ["loc", "arr", "sen", "tech", "comp"]


def percent(hits: Column, n: Column, digits: int = 1) -> Column:
    return F.round(F.try_divide(100.0 * hits, F.greatest(n, F.lit(1))), digits)


def tech_set(c: Column) -> Column:
    return F.array_sort(F.split(c, ","))


def matches(df: DataFrame) -> DataFrame:
    """A flag for each field and the label; null where there is no prediction. Tech compares as a set."""
    eq = {f: (tech_set(F.col("p_tech")) == tech_set(F.col("g_tech"))) if f == "tech" else F.col(f"p_{f}") == F.col(f"g_{f}") for f in [*FIELDS, "label"]}
    return df.select("*", *[v.alias(f"ok_{f}") for f, v in eq.items()])


def field_accuracy(df: DataFrame) -> DataFrame:
    """field, correct, n, pct over rows that have a prediction."""
    m = matches(df).where("p_label is not null")
    long = m.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"ok_{f}").alias("ok")) for f in FIELDS])).alias("x")).select("x.*")
    return long.groupBy("field").agg(F.count_if("ok").alias("correct"), F.count("*").alias("n")).withColumn("pct", percent(F.col("correct"), F.col("n")))


def confusion(df: DataFrame, fail: bool = False) -> DataFrame:
    """actual, predicted, n over all pairs of labels, absent pairs as 0; fail adds parse_fail as a prediction."""
    spark = df.sparkSession
    seen = df.select(F.col("g_label").alias("actual"), F.coalesce("p_label", F.lit("parse_fail")).alias("predicted")).groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    grid = spark.createDataFrame([(a, p) for a in LABELS for p in LABELS + ["parse_fail"] * fail], "actual string, predicted string")
    return grid.join(seen, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def label_accuracy(df: DataFrame) -> DataFrame:
    """Each label's accuracy over predicted rows; labels that don't occur count as 0 in a macro average."""
    per = df.where("p_label is not null").groupBy(F.col("g_label").alias("label")).agg(F.count_if(F.col("p_label") == F.col("g_label")).alias("correct"), F.count("*").alias("n"))
    grid = df.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    out = grid.join(per, "label", "left").fillna(0, ["correct", "n"])
    return out.withColumn("pct", percent(F.col("correct"), F.col("n")))


def transitions(df: DataFrame) -> DataFrame:
    """field, change (gold->predicted) and n over wrong fields."""
    m = matches(df).where("p_label is not null")
    each = [F.when(~F.col(f"ok_{f}"), F.struct(F.lit(f).alias("field"), F.concat_ws("->", f"g_{f}", f"p_{f}").alias("change"))) for f in FIELDS]
    return m.select(F.explode(F.array_compact(F.array(*each))).alias("x")).groupBy("x.field", "x.change").agg(F.count("*").alias("n"))


def hybrids(df: DataFrame) -> DataFrame:
    """df with predictions of rules (r_*) beside those of a model (p_*): one row for each approach, with its tokens.

    A takes tech and comp from the rules, B arr too, v12 loc, tech and comp; without a model prediction all are the rules'.
    """
    own = {"model": [], "regex": FIELDS, "A": ["tech", "comp"], "B": ["arr", "tech", "comp"], "v12": ["loc", "tech", "comp"]}
    has = F.col("p_label").isNotNull()

    def of(name: str, ruled: list[str]) -> Column:
        take = {f: F.col(f"r_{f}") if f in ruled else (F.col(f"p_{f}") if name == "model" else F.when(has, F.col(f"p_{f}")).otherwise(F.col(f"r_{f}"))) for f in FIELDS}
        return F.struct(F.lit(name).alias("approach"), *[v.alias(k) for k, v in take.items()])

    out = df.select("*", F.explode(F.array(*[of(k, v) for k, v in own.items()])).alias("h")).select(*df.columns, "h.*")
    score = T.scores(F.col("loc"), F.col("sen"), F.split("tech", ","), F.col("comp"))
    return out.where("approach <> 'model' or p_label is not null").withColumn("label", score["label"])


def bounds(df: DataFrame) -> DataFrame:
    """Accuracy over valid rows, and over all if the rest were all wrong, all right, or right at the rate of the valid."""
    a = df.agg(F.count("*").alias("total"), F.count_if(F.col("p_label").isNotNull()).alias("valid"), F.count_if(F.col("p_label") == F.col("g_label")).alias("correct"))
    lost = F.col("total") - F.col("valid")
    return a.select(
        "total", "valid", "correct", percent(F.col("correct"), F.col("valid"), 2).alias("measured"), percent(F.col("correct"), F.col("total"), 2).alias("worst"),
        percent(F.col("correct") + lost, F.col("total"), 2).alias("best"),
        percent(F.col("correct") + lost * F.try_divide(F.col("correct"), F.col("valid")), F.col("total"), 2).alias("expected"),
    )
