"""Queries over files: what is written to the shared folder is read back by the sources that users have."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions import tokens as T
from siftwork.operators import label as B
from siftwork.plans import fixtures as fx
from siftwork.plans.catalog import query
from siftwork.plans.curation import COUNTS, counts
from siftwork.plans.fixtures import ctes, table
from siftwork.sources import io, scratch

L = ctes("labelled")
P = ctes("predictions")
R = ctes("runs")


@query("select doc_id, lang, source, n_chars from documents")
def jsonl_files(spark, d):
    """Documents written as JSON lines among comments and blank lines, and scanned."""
    where = scratch.path(spark)
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    io.write_jsonl(docs, where)
    spark.createDataFrame([("# a comment",), ("   ",)], "value string").coalesce(1).write.mode("append").text(where)
    return io.read_jsonl(spark, where, "doc_id long, lang string, source string, n_chars long")


@query("select doc_id, lang || chr(10) || '\"' || source || '\", x' said, n_chars from documents")
def csv_files(spark, d):
    """CSV files with quotes, commas and line breaks inside fields, and scanned."""
    where = scratch.path(spark)
    said = F.concat("lang", F.lit('\n"'), "source", F.lit('", x'))
    table(spark, d, "documents").select("doc_id", said.alias("said"), "n_chars").write.options(header=True, quoteAll=True, escape='"').csv(where)
    return io.read_csv(spark, where, "doc_id long, said string, n_chars long")


@query(ctes("labelled", "targets") + f", {COUNTS} select t.field, t.token, t.target, coalesce(n, 0) n, t.target - coalesce(n, 0) gap from targets t left join counts c on c.field = t.field and c.token = t.token")
def gap_report_from_csv(spark, d):
    """The gap report with its targets loaded from a CSV table whose field names are capitalised."""
    where = scratch.path(spark)
    table(spark, d, "targets").select(F.initcap("field").alias("Field"), F.col("token").alias("Token"), F.col("target").alias("Total")).write.option("header", True).csv(where)
    t = io.read_targets(spark, where)
    return t.join(counts(spark, d), ["field", "token"], "left").select("field", "token", "target", F.coalesce("n", F.lit(0)).alias("n"), (F.col("target") - F.coalesce("n", F.lit(0))).alias("gap"))


@query("select n_nationkey, n_name from nation union all select r_regionkey, r_name from region")
def export_scan(spark, d):
    """An export that is an object with jobs, and one that is an array."""
    where = scratch.path(spark)
    row = lambda t, k, n: F.to_json(F.collect_list(F.struct(F.col(k).alias("n_nationkey"), F.col(n).alias("n_name"))))
    nations = table(spark, d, "nation").agg(F.concat(F.lit('{"jobs": '), row("nation", "n_nationkey", "n_name"), F.lit("}")).alias("value"))
    nations.unionByName(table(spark, d, "region").agg(row("region", "r_regionkey", "r_name").alias("value"))).repartition(2, "value").write.text(where)
    return io.read_exports(spark, where, "n_nationkey long, n_name string")


@query("select 'documents' _source, coalesce(lang, source) text, doc_id from documents union all select 'benchmark', text, item_id from benchmark")
def tagged_sources(spark, d):
    """Tagged JSON-lines sources with an alias for a column, one of which doesn't exist and is passed over."""
    root = scratch.path(spark)
    io.write_jsonl(table(spark, d, "documents").select("doc_id", F.lit(None).cast("string").alias("text"), F.col("lang").alias("description")), f"{root}/a")
    io.write_jsonl(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), f"{root}/b")
    found = io.existing(spark, {"documents": f"{root}/a", "benchmark": f"{root}/b", "absent": f"{root}/c"})
    frames = [io.read_tagged(spark, p, "doc_id long, text string, description string", tag, {"text": ["description"]}) for tag, p in found.items()]
    return io.read_sources(frames).select("_source", "text", "doc_id")


@query(R + "select model, count(*) n_runs, sum(n)::bigint n, 1 bad_files from runs group by 1")
def result_files(spark, d):
    """A folder of result files, one a run, among them one that is no JSON, which is left out and counted."""
    where = scratch.path(spark)
    runs = table(spark, d, "runs")
    runs.select(F.to_json(F.struct("model", "n")).alias("value"), F.concat_ws("_", "model", F.col("run").cast("string")).alias("tag")).write.partitionBy("tag").text(where)
    spark.createDataFrame([("{ not json",)], "value string").coalesce(1).write.text(f"{where}/tag=broken")
    good, bad = io.read_results(spark, f"{where}/*", "model string, n long")
    return good.groupBy("model").agg(F.count("*").alias("n_runs"), F.sum("n").alias("n")).crossJoin(F.broadcast(bad.agg(F.count("*").alias("bad_files"))))


@query(P + "select job_index, p_label, row_number() over (order by job_index) place from predictions")
def prediction_chunks(spark, d):
    """Chunk files of predictions joined into one table in the order of job_index."""
    root = scratch.path(spark)
    p = table(spark, d, "predictions").select("job_index", "p_label")
    for k in range(3):
        io.write_jsonl(p.where(F.pmod(F.xxhash64("job_index"), F.lit(3)) == k), f"{root}/run_chunk{k + 1}of3.predictions")
    got = io.merged_chunks(spark, f"{root}/*_chunk*of3.predictions", "job_index long, p_label string")
    return io.placed(got, "job_index")


@query(R + "select run::varchar run, model, n::bigint n, '\"quoted\", ' || model note from runs")
def run_log(spark, d):
    """Rows appended to a log in two goes, all quoted and quotes doubled, and read back."""
    where = scratch.path(spark)
    rows = table(spark, d, "runs").select(F.col("run").cast("string").alias("run"), "model", F.col("n").cast("long").alias("n"), F.concat(F.lit('"quoted", '), "model").alias("note"))
    io.append_log(rows.where("n % 2 = 0"), where)
    io.append_log(rows.where("n % 2 <> 0"), where)
    return spark.read.options(quote='"', escape='"').schema("run string, model string, n long, note string").csv(where)


@query(L + "select label, count(*) n, 64 digits, true refused from labelled group by 1")
def manifest_counts(spark, d):
    """A dataset written once, its manifest's counts by label and digest, and a second write that is refused."""
    where = scratch.path(spark)
    rows = table(spark, d, "labelled").select("job_id", "label", "score")
    io.write_jsonl(rows, where)
    m = io.manifest(io.read_jsonl(spark, where, "job_id string, label string, score int"), "label", "job_id")
    refused = F.lit(io.refuses(lambda: io.write_jsonl(rows, where)) and io.refuses(lambda: io.distinct_paths(where, where)))
    return m.select(F.explode("by_label").alias("label", "n"), F.length("sha256").alias("digits"), refused.alias("refused"))


def stub(text: str, attempt: int) -> str:
    """Stands in for a hosted model: some texts fail at first, some always, and some get an answer of another shape."""
    kind = len(text.encode()) % 5
    if kind == 0 or kind == 3 and attempt == 1:
        raise TimeoutError("no answer")
    return "unsure" if kind == 2 else "good_fit"


@query(ctes("jobs") + "select status, count(*) n, sum(tries)::bigint attempts from (select case strlen(title) % 5 when 0 then 'failure' when 2 then 'inconsistency' else 'success' end status, case strlen(title) % 5 when 0 then 3 when 3 then 2 else 1 end tries from jobs) x group by 1")
def labelling_outcomes(spark, d):
    """A pass of a plugged-in model with attempts, its successes, failures and inconsistencies written apart and read back."""
    where = scratch.path(spark)
    done = B.labelled_by(table(spark, d, "jobs"), stub, "title")
    B.outcomes(done, F.col("output").isin("good_fit", "maybe", "bad_fit")).sortWithinPartitions("job_id").write.partitionBy("status").json(where)
    back = spark.read.schema("job_id string, output string, error string, attempts int, status string").json(where)
    return back.groupBy("status").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))


YAML = "'- description: \"' || job_id || ' | ' || title || ' @ ' || company || '\"' || chr(10) || '  vars:' || chr(10) || '    job_title: \"' || title || '\"' || chr(10) || '    expected_label: ' || label || chr(10) || '    expected_score: ' || score || chr(10) || '  assert:' || chr(10) || '    - label == ' || label || chr(10) || '    - abs(score - ' || score || ') <= 5'"


@query(L + f"select doc_id, {YAML} test from labelled")
def test_case_yaml(spark, d):
    """Test cases with their assertions as YAML items, one a row."""
    c = {k: F.col(k).cast("string") for k in ("job_id", "title", "company", "label", "score")}
    return table(spark, d, "labelled").select("doc_id", io.yaml_item(c, tolerance=5).alias("test"))


@query("select event_type line_of, '| ' || event_type || ' | ' || n || ' | ' || pct || '% |' line from (select event_type, count(*) n, printf('%.1f', 100.0 * count(*) / (select count(*) from events)) pct from events group by 1) x")
def report_lines(spark, d):
    """The lines of a Markdown table, from a tidy report."""
    e = table(spark, d, "events")
    total = e.agg(F.count("*").alias("total"))
    g = e.groupBy("event_type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))
    tidy = g.select("event_type", F.col("n").cast("string").alias("n"), F.format_string("%.1f%%", F.round(100.0 * F.col("n") / F.col("total"), 1)).alias("pct"))
    return tidy.select(F.col("event_type").alias("line_of"), io.markdown_row([F.col(c) for c in tidy.columns]).alias("line"))


@query(L + "select doc_id, loc, arr, sen, tech, comp, score, label from labelled")
def tokens_only(spark, d):
    """Rows without their texts and raw fields."""
    raw = ["line_no", "job_id", "title", "company", "job_location", "jd_text", "body", "source_file", "lang"]
    return table(spark, d, "labelled").drop(*raw)


NORMAL = "coalesce(nullif(trim(title), ''), 'Untitled') title, coalesce(nullif(trim(job_location), ''), 'Unknown') location"


@query(ctes("jobs") + f"select job_id, {NORMAL}, company from jobs where length(trim(body)) >= 40")
def normalised_records(spark, d):
    """Records under one set of names with defaults; those without a text of some length go."""
    own = lambda c, default: F.coalesce(io.first_of([F.col(c)]), F.lit(default))
    return table(spark, d, "jobs").where("length(trim(body)) >= 40").select("job_id", own("title", "Untitled").alias("title"), own("job_location", "Unknown").alias("location"), "company")


@query(L + f"select doc_id, {fx.score_sql('loc', 'sen', 'tech', 'comp')} score, true stamped from labelled")
def stamped_scores(spark, d):
    """Scores with the time of writing, an ISO 8601 stamp in UTC."""
    c = F.col
    s = T.scores(c("loc"), c("sen"), F.split("tech", ","), c("comp"))
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return table(spark, d, "labelled").select("doc_id", s["score"].alias("score"), F.rlike(stamp, F.lit(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$")).alias("stamped"))
