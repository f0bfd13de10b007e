"""Row-multiplying augmentation: salary injection, contrastive pairs, location variants, truncation, recipes. Choices are
by hash, so a rerun gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Salary tiers: token, low and high in thousands. Fixed values.
TIERS = [("BELOW_45K", 30, 40), ("RANGE_55_74K", 60, 70), ("RANGE_75_99K", 80, 95), ("ABOVE_100K", 110, 130)]
SWAPS = {"London, UK": ("Manchester, England", "UK_OTHER"), "Manchester, England": ("London, UK", "IN_LONDON"), "Remote": ("Austin, TX", "OUTSIDE_UK")}
DOWNGRADES = ["Senior ", "Staff ", "Lead ", "Principal ", "Sr. "]
FORMS = {"London, UK": ["London", "Greater London, UK", "London, England"], "Remote": ["Remote (UK)", "Fully Remote"], "Manchester, England": ["Manchester, UK", "Manchester"]}


def pick(n: int, *parts: Column) -> Column:
    """A number below n by hash of the parts."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def salaries(df: DataFrame) -> DataFrame:
    """Each row once for each tier: new id, text with the salary first or last, token and kind."""
    tiers = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(t).alias("comp"), F.lit(f"Salary: £{a},000 - £{b},000 per annum.").alias("said")) for i, (t, a, b) in enumerate(TIERS)]))
    out = df.select("*", tiers.alias("t"))
    first = pick(2, F.col("job_id"), F.col("t.k").cast("string")) == 0
    text = F.when(first, F.concat("t.said", F.lit("\n"), "jd_text")).otherwise(F.concat("jd_text", F.lit("\n"), "t.said"))
    return out.select(F.concat("job_id", F.lit("_sal_"), F.col("t.k").cast("string")).alias("job_id"), F.col("job_id").alias("source_job_id"), F.col("t.comp").alias("comp"), text.alias("jd_text"), F.lit("salary").alias("kind"))


def contrastive(df: DataFrame) -> DataFrame:
    """Location swapped, seniority word taken from the title, Node swapped for Java: each where it applies."""
    loc = F.try_element_at(F.create_map(*[F.lit(x) for k, v in SWAPS.items() for x in (k, v[0])]), F.col("job_location"))
    down = F.regexp_replace("title", "^(" + "|".join(d.replace(".", "\\.") for d in DOWNGRADES) + ")", "")
    tech = F.regexp_replace("jd_text", "Node\\.js", "Java")
    made = F.array_compact(F.array(
        F.when(loc.isNotNull(), F.struct(F.lit("loc").alias("kind"), F.col("title").alias("title"), loc.alias("job_location"), F.col("jd_text").alias("jd_text"))),
        F.when(down != F.col("title"), F.struct(F.lit("title").alias("kind"), down.alias("title"), F.col("job_location").alias("job_location"), F.col("jd_text").alias("jd_text"))),
        F.when(tech != F.col("jd_text"), F.struct(F.lit("tech").alias("kind"), F.col("title").alias("title"), F.col("job_location").alias("job_location"), tech.alias("jd_text"))),
    ))
    return df.select("job_id", F.explode(made).alias("v")).select(F.concat("job_id", F.lit("_con_"), "v.kind").alias("job_id"), F.col("job_id").alias("source_job_id"), "v.*")


def locations(df: DataFrame) -> DataFrame:
    forms = F.create_map(*[x for k, v in FORMS.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    out = df.select("job_id", F.posexplode(F.try_element_at(forms, F.col("job_location"))).alias("k", "job_location"))
    return out.select(F.concat("job_id", F.lit("_locvar_"), F.col("k").cast("string")).alias("job_id"), F.col("job_id").alias("source_job_id"), "job_location")


def truncations(df: DataFrame) -> DataFrame:
    """Half and a quarter of the text, marked."""
    out = df.select("job_id", "jd_text", F.explode(F.array(F.lit(50), F.lit(25))).alias("pct"))
    n = F.floor(F.length("jd_text") * F.col("pct") / 100).cast("int")
    return out.select(F.concat("job_id", F.lit("_trunc"), F.col("pct").cast("string")).alias("job_id"), F.col("job_id").alias("source_job_id"), F.concat(F.substr("jd_text", F.lit(1), n), F.lit(" [truncated]")).alias("jd_text"))


def recipes(gaps: DataFrame, fields: list[str]) -> DataFrame:
    """Gaps (field, token, gap) as recipes: each field's missing tokens in hashed order, aligned by position; a field
    that runs out leaves null."""
    need = gaps.where("gap > 0").select("field", "token", F.explode(F.sequence(F.lit(1), F.col("gap").cast("int"))).alias("k"))
    w = Window.partitionBy("field").orderBy(F.md5(F.concat_ws("|", "token", F.col("k").cast("string"))))
    placed = need.withColumn("rn", F.row_number().over(w))
    wide = placed.groupBy("rn").pivot("field", fields).agg(F.first("token"))
    return wide.select(F.format_string("gen_%04d", F.col("rn") - 1).alias("recipe"), *fields)
