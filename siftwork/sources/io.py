"""Sources and sinks: JSON lines with comments, JSON arrays, CSV, SQL databases, result folders; manifests and side outputs.

Paths go through Spark's readers and writers alone, so any store that Spark opens will do. Line order is not kept by a
cluster; where it matters, rows carry line_no from the source or an order column of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.sources import scratch


def parsed_lines(lines: DataFrame, schema: str, column: str = "value", strict: bool = False) -> DataFrame:
    """Rows of JSON lines; blank lines and lines that start with # are skipped. A malformed line is null, or an error."""
    own = lines.where(~F.rlike(column, F.lit("^\\s*(#|$)")))
    return own.withColumn("_j", F.from_json(column, schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})).select(*[c for c in lines.columns if c != column], "_j.*")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    return parsed_lines(spark.read.text(path), schema, strict=strict)


def read_tagged(spark: SparkSession, path: str, schema: str, tag: str, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """JSON lines with a source column and columns filled from their aliases."""
    df = spark.read.schema(schema).json(path)
    for name, others in (aliases or {}).items():
        df = df.withColumn(name, first_of([F.col(c) for c in [name, *others] if c in df.columns]))
    return df.withColumn("_source", F.lit(tag))


def read_sources(frames: list[DataFrame]) -> DataFrame:
    """All rows of all sources; columns that a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """RFC 4180: doubled quotes, line breaks in quotes, a byte-order mark dropped."""
    r = spark.read.options(header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    df = (r.schema(schema) if schema else r).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_exports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array, or an object whose jobs are the array."""
    df = spark.read.text(path, wholetext=True)
    array = F.coalesce(F.from_json(F.get_json_object("value", "$.jobs"), f"array<struct<{schema}>>"), F.from_json("value", f"array<struct<{schema}>>"))
    return df.select(F.explode(array).alias("r")).select("r.*")


def read_database(spark: SparkSession, url: str, table: str, least: int = 200, **options: str) -> DataFrame:
    """A JDBC table; the predicate on description is pushed to the database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().where(f"description is not null and length(description) > {least}")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """field (in lower case), token and target of a distribution table."""
    t = read_csv(spark, path, "Field string, Token string, Total int")
    return t.select(F.lower("Field").alias("field"), F.col("Token").alias("token"), F.col("Total").alias("target"))


def existing(spark: SparkSession, paths: dict[str, str]) -> dict[str, str]:
    """Those of the named paths that exist."""
    return {k: p for k, p in paths.items() if scratch.exists(spark, p)}


def read_results(spark: SparkSession, glob: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of result files of many runs with the file each is from, and the files that aren't JSON."""
    raw = spark.read.text(glob, wholetext=True).select("value", F.input_file_name().alias("file"))
    read = raw.select("file", F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", schema)).alias("r"))
    return read.where("r is not null").select("r.*", "file"), read.where("r is null").select("file")


def merged_chunks(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """All rows of the chunk files; their order is a column's, which placed() numbers."""
    return read_jsonl(spark, glob, schema)


def placed(df: DataFrame, order: str, name: str = "place") -> DataFrame:
    """df with each row's place in the order of a numeric column, from 1. Ranges of the column are numbered where they
    are, and begin after the number of rows in those before, so no task sees all rows."""
    lo, hi, n = df.agg(F.min(order), F.max(order), F.count("*")).first()
    if not n:
        return df.withColumn(name, F.lit(0).cast("long"))
    width = max(1, (hi - lo + 1) // max(1, n // 10_000))
    cut = F.floor((F.col(order) - F.lit(lo)) / F.lit(width))
    keyed = df.withColumn("_cut", cut)
    sizes = keyed.groupBy("_cut").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_cut").orderBy(order))
    return keyed.join(before, "_cut").withColumn(name, (F.col("_before") + own).cast("long")).drop("_cut", "_before")


def refuses(write) -> bool:
    """Whether a write fails."""
    try:
        write()
    except Exception:  # Spark's or ours
        return True
    return False


def distinct_paths(source: str, target: str) -> None:
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("input and output are one")


def markdown_row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def yaml_item(c: dict[str, Column], tolerance: int) -> Column:
    """A test case: what it is about, its variables, and what must hold of an answer."""
    quoted = lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    lines = [
        F.concat(F.lit("- description: "), quoted(F.concat(c["job_id"], F.lit(" | "), c["title"], F.lit(" @ "), c["company"]))),
        F.lit("  vars:"),
        F.concat(F.lit("    job_title: "), quoted(c["title"])),
        F.concat(F.lit("    expected_label: "), c["label"]),
        F.concat(F.lit("    expected_score: "), c["score"]),
        F.lit("  assert:"),
        F.concat(F.lit("    - label == "), c["label"]),
        F.concat(F.lit("    - abs(score - "), c["score"], F.lit(f") <= {tolerance}")),
    ]
    return F.concat_ws("\n", *lines)


def first_of(columns: list[Column]) -> Column:
    """The first that isn't blank, as text."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns])


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with null fields kept; an existing folder is refused unless told otherwise."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_quarantine(issues: DataFrame, path: str) -> None:
    """One folder for each bucket."""
    issues.write.mode("errorifexists").partitionBy("bucket").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("quoteAll", True).option("escape", '"').csv(path)


def manifest(df: DataFrame, label: str, order: str) -> DataFrame:
    """n, counts by label and a digest of the rows: the hash of their hashes in order of the order column.

    Rows are hashed where they are; the digest folds 256 sums of hash bytes, so no task gathers all rows.
    """
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    h = F.sha2(F.concat_ws("|", F.col(order).cast("string"), line), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    per = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).select(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")).over(_whole()))).alias("by_label")).limit(1)
    return df.agg(F.count("*").alias("n"), F.sha2(F.concat_ws(",", *parts), 256).alias("sha256")).crossJoin(per)


def _whole():
    return Window.partitionBy()


GOLDEN = T.StructType([T.StructField(c, T.StringType()) for c in ("job_id", "title", "company", "location", "jd_text", "label")] + [T.StructField("score", T.IntegerType()), T.StructField("reasoning", T.StringType())])


def golden_errors(df: DataFrame) -> DataFrame:
    """job_id and error for each rule of the golden schema that a row breaks."""
    n = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    rules = {"job_id": n("job_id") > 0, "title": n("title") > 0, "company": n("company") > 0, "jd_text": n("jd_text") >= 40, "label": F.col("label").isin("good_fit", "maybe", "bad_fit"), "score": F.col("score").between(0, 100), "reasoning": n("reasoning").between(15, 600)}
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in rules.items()]))
    return df.select("job_id", F.explode(bad).alias("error"))
