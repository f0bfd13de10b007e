"""Queries of scans, projections, filters, joins and chat examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions import text as X
from siftwork.functions import tokens as T
from siftwork.operators import chat as C
from siftwork.plans import fixtures as fx
from siftwork.plans.catalog import query
from siftwork.plans.fixtures import ctes, table
from siftwork.sources import io

L = ctes("labelled")
J = ctes("jobs")


def jobs(spark, d):
    return table(spark, d, "jobs")


def lab(spark, d):
    return table(spark, d, "labelled")


@query("select doc_id, lang, n_chars from documents")
def jsonl_scan(spark, d):
    """Documents as JSON lines among comments and blanks, read back."""
    docs = table(spark, d, "documents")
    line = F.to_json(F.struct("doc_id", "lang", "n_chars"), {"ignoreNullFields": "false"})
    lines = docs.select(F.explode(F.array(F.lit("# a comment"), line, F.lit("   "))).alias("value"))
    return io.parsed_lines(lines, "doc_id long, lang string, n_chars long", strict=True)


@query("select doc_id, lang || ', \"' || source || '\"' said, n_chars from documents")
def csv_scan(spark, d):
    """CSV lines with quotes and commas in a field, parsed."""
    docs = table(spark, d, "documents").select("doc_id", F.concat("lang", F.lit(', "'), "source", F.lit('"')).alias("said"), "n_chars")
    quoted = F.concat(F.lit('"'), F.replace("said", F.lit('"'), F.lit('""')), F.lit('"'))
    lines = docs.select(F.concat_ws(",", F.col("doc_id").cast("string"), quoted, F.col("n_chars").cast("string")).alias("v"))
    return lines.select(F.from_csv("v", "doc_id long, said string, n_chars long", {"quote": '"', "escape": '"'}).alias("r")).select("r.*")


@query("select 'documents' _source, doc_id id, lang, null::bigint item_id from documents union all select 'benchmark', null, null, item_id from benchmark")
def multi_source_union(spark, d):
    a = table(spark, d, "documents").select(F.lit("documents").alias("_source"), F.col("doc_id").alias("id"), "lang")
    b = table(spark, d, "benchmark").select(F.lit("benchmark").alias("_source"), "item_id")
    return io.read_sources([a, b])


@query(J + "select doc_id, coalesce(nullif(trim(case when doc_id % 3 = 0 then '  ' else job_id end), ''), nullif(trim(case when doc_id % 2 = 0 then title end), ''), company) name from jobs")
def alias_coalesce(spark, d):
    c = F.col
    return jobs(spark, d).select("doc_id", io.first_of([F.when(c("doc_id") % 3 == 0, "  ").otherwise(c("job_id")), F.when(c("doc_id") % 2 == 0, c("title")), c("company")]).alias("name"))


@query(J + "select doc_id, case doc_id % 3 when 0 then 'j' || doc_id when 1 then (1000000 + doc_id)::varchar else 'ukjob_' || substr(sha1(title || '|' || company || '|' || job_location), 1, 12) end id from jobs")
def job_id_extraction(spark, d):
    """The raw id, else the last long number of the URL, else a hash."""
    c = F.col
    raw = F.when(c("doc_id") % 3 == 0, F.concat(F.lit("j"), c("doc_id").cast("string")))
    url = F.when(c("doc_id") % 3 == 1, F.concat(F.lit("https://x.example/123456789/"), (c("doc_id") + 1000000).cast("string"))).otherwise("https://x.example/1")
    number = F.try_element_at(F.regexp_extract_all(url, F.lit(r"\b\d{6,}\b"), F.lit(0)), F.lit(-1))
    made = F.concat(F.lit("ukjob_"), F.substring(F.sha1(F.concat_ws("|", "title", "company", "job_location")), 1, 12))
    return jobs(spark, d).select("doc_id", F.coalesce(raw, number, made).alias("id"))


@query(J + "select doc_id, 'auto_' || substr(replace(replace(to_base64(encode(title || '|' || substr(jd_text, 1, 200))), '+', '-'), '/', '_'), 1, 16) id from jobs")
def auto_ids(spark, d):
    b = F.translate(F.base64(F.encode(F.concat("title", F.lit("|"), F.substring("jd_text", 1, 200)), "UTF-8")), "+/", "-_")
    return jobs(spark, d).select("doc_id", F.concat(F.lit("auto_"), F.substring(b, 1, 16)).alias("id"))


@query("select page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) host, nullif(regexp_extract(url, '^[a-z]+://(www|m|blog)\\.', 1), '') sub, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/', 1) lang from pages")
def url_parts(spark, d):
    u = F.col("url")
    sub = F.regexp_extract(u, r"^[a-z]+://(www|m|blog)\.", 1)
    return table(spark, d, "pages").select("page_id", F.regexp_extract(u, "^[a-z]+://([^/]+)", 1).alias("host"), F.nullif(sub, F.lit("")).alias("sub"), F.regexp_extract(u, "^[a-z]+://[^/]+/([a-z]{2})/", 1).alias("lang"))


@query(J + "select count(*) n, count(*) filter (job_location = '') no_location, count(*) filter (company = '') no_company, count(*) filter (jd_text not like '%£%') no_pay from jobs")
def missing_fields(spark, d):
    return jobs(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("job_location") == "").alias("no_location"), F.count_if(F.col("company") == "").alias("no_company"), F.count_if(~F.col("jd_text").contains("£")).alias("no_pay"))


@query(J + "select doc_id, title || case when job_location = '' then '' else ' in ' || job_location end || ' at ' || company text, printf('ses-%06d', line_no) id from jobs")
def built_texts(spark, d):
    where = F.when(F.col("job_location") != "", F.concat(F.lit("in "), "job_location"))
    return jobs(spark, d).select("doc_id", F.concat_ws(" ", "title", where, F.concat(F.lit("at "), "company")).alias("text"), F.format_string("ses-%06d", "line_no").alias("id"))


@query(L + f"select doc_id, substr('Location ' || ls || '; role ' || rs || '; pay ' || cs || '.', 1, 600) reasoning from (select doc_id, {fx._map('loc', fx.LOC_SCORE)} ls, case when tech = 'OOS' then 0 else {fx._map('sen', fx.SEN_SCORE)} end rs, {fx._map('comp', fx.COMP_SCORE)} cs from labelled) x")
def reasoning_text(spark, d):
    c = F.col
    s = T.scores(c("loc"), c("sen"), F.split("tech", ","), c("comp"))
    said = F.format_string("Location %d; role %d; pay %d.", s["loc_score"], s["role_score"], s["comp_score"])
    return lab(spark, d).select("doc_id", F.substring(said, 1, 600).alias("reasoning"))


@query(J + "select doc_id, 'Job: ' || title || chr(10) || 'At: ' || company || chr(10) || '' || body prompt from jobs")
def prompt_template(spark, d):
    tpl = "Job: {{title}}\nAt: {{company}}\n{{absent}}{{body}}"
    return jobs(spark, d).select("doc_id", C.filled(tpl, {"title": F.col("title"), "company": F.col("company"), "absent": F.lit(None).cast("string"), "body": F.col("body")}).alias("prompt"))


@query(L + "select doc_id, '{\"loc_raw\":null,\"loc\":\"' || loc || '\",\"tech\":[\"' || replace(tech, ',', '\",\"') || '\"],\"comp\":\"' || comp || '\"}' response from labelled")
def assistant_json(spark, d):
    return lab(spark, d).select("doc_id", C.serialised([F.lit(None).cast("string").alias("loc_raw"), F.col("loc"), F.split("tech", ",").alias("tech"), F.col("comp")]).alias("response"))


@query(L + "select doc_id, 3 n_messages, length('Title: ' || title || chr(10) || body) user_chars, title, loc from labelled")
def chat_format_and_parse(spark, d):
    user = F.concat(F.lit("Title: "), "title", F.lit("\n"), "body")
    said = F.concat(F.lit("<think>hm</think>"), C.serialised([F.col("loc"), F.col("sen")]))
    made = lab(spark, d).select("doc_id", C.example("You label jobs.", user, said).alias("m"))
    back = F.from_json(C.after_thought(C.message(F.col("m"), "assistant")), "loc string, sen string")
    u = C.message(F.col("m"), "user")
    return made.select("doc_id", F.size("m").alias("n_messages"), F.length(u).alias("user_chars"), F.regexp_extract(u, "^Title: ([^\n]*)", 1).alias("title"), back["loc"].alias("loc"))


@query(L + "select doc_id, case when ('0x' || substr(md5('42|' || job_id), 1, 8))::bigint / 4294967296.0 < 0.5 then 'all' else 'none' end mode from labelled")
def mixed_raw_mode(spark, d):
    return lab(spark, d).select("doc_id", F.when(C.variant(F.col("job_id"), 0.5, 42), "all").otherwise("none").alias("mode"))


@query("select role, count(*) n, round(avg(length(text)), 4) mean_chars, max(length(text)) max_chars from conversations group by 1")
def message_stats(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.max(F.length("text")).alias("max_chars"))


@query("select conv_id, count(*) n_turns, arg_min(text, turn) filter (role = 'user') first_user, arg_max(role, turn) last_role from conversations group by 1")
def chat_collect(spark, d):
    m = C.collected(table(spark, d, "conversations"))
    return m.select("conv_id", F.size("messages").cast("long").alias("n_turns"), C.message(F.col("messages"), "user").alias("first_user"), F.element_at("messages", -1)["role"].alias("last_role"))


FIXED = "case when line_no % 10 = 0 and loc = 'UNK' then 'REMOTE' else loc end"


@query(L + f"select doc_id, {FIXED} loc, {fx.score_sql(FIXED, 'sen', 'tech', 'comp')} score from labelled")
def apply_corrections(spark, d):
    """Corrections by line, applied where the old value is as the correction says; scores recomputed."""
    rows = lab(spark, d)
    fix = rows.where("line_no % 10 = 0").select(F.col("line_no").alias("l"), F.lit("UNK").alias("old"), F.lit("REMOTE").alias("new"))
    c = F.col
    out = rows.join(fix, c("line_no") == c("l"), "left").withColumn("loc2", F.when(c("loc") == c("old"), c("new")).otherwise(c("loc")))
    s = T.scores(c("loc2"), c("sen"), F.split("tech", ","), c("comp"))
    return out.select("doc_id", c("loc2").alias("loc"), s["score"].alias("score"))


@query(L + "select doc_id, score + 1 <> score changed, 'score:' || score || '->' || least(100, score + 1) diff from labelled where score < 100")
def rescore_diffs(spark, d):
    new = F.least(F.lit(100), F.col("score") + 1)
    return lab(spark, d).where("score < 100").select("doc_id", (new != F.col("score")).alias("changed"), F.concat(F.lit("score:"), F.col("score").cast("string"), F.lit("->"), new.cast("string")).alias("diff"))


@query(J + "select doc_id from jobs where job_id like 'doc_1%' or source_file in ('src3', 'src4') or lower(title) like '%node%'")
def synthetic_predicate(spark, d):
    c = F.col
    return jobs(spark, d).where(c("job_id").startswith("doc_1") | c("source_file").isin("src3", "src4") | F.lower("title").contains("node")).select("doc_id")


@query(J + "select doc_id from jobs where lower(jd_text) like '%react%' or lower(jd_text) like '%node.js%' or lower(jd_text) like '%nestjs%'")
def tracked_tech_predicate(spark, d):
    return jobs(spark, d).where(F.rlike("jd_text", F.lit(r"(?i)react|node\.js|nestjs"))).select("doc_id")


@query(J + "select doc_id from jobs where length(trim(body)) >= 30 and job_id <> '' and line_no between 10 and 500")
def min_length_and_range(spark, d):
    return jobs(spark, d).where("length(trim(body)) >= 30 and job_id <> '' and line_no between 10 and 500").select("doc_id")


@query(J + "select doc_id from jobs where length(trim(body)) >= 30 and job_id <> ''")
def min_length(spark, d):
    """The minimum length over the whole table, apart from the row range."""
    return jobs(spark, d).where("length(trim(body)) >= 30 and job_id <> ''").select("doc_id")


@query(L + "select doc_id from labelled where loc in ('IN_LONDON', 'REMOTE', 'UK_OTHER') and sen in ('LEVEL_3', 'LEVEL_2') and tech <> ''")
def domain_filter(spark, d):
    return lab(spark, d).where(F.col("loc").isin("IN_LONDON", "REMOTE", "UK_OTHER") & F.col("sen").isin("LEVEL_3", "LEVEL_2") & (F.size(F.split("tech", ",")) > 0)).select("doc_id")


@query(L + "select count(*) n, count(*) filter (job_id = '' or title = '') bad_ids, count(*) filter (length(jd_text) < 40) short_n, min(score) lo, max(score) hi from labelled")
def golden_validation(spark, d):
    return lab(spark, d).agg(F.count("*").alias("n"), F.count_if(F.expr("job_id = '' or title = ''")).alias("bad_ids"), F.count_if(F.length("jd_text") < 40).alias("short_n"), F.min("score").alias("lo"), F.max("score").alias("hi"))


@query("with p as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) k from conversations where role = 'user'), q as (select conv_id, text, row_number() over (partition by conv_id order by turn) k from conversations where role = 'assistant') select p.conv_id, p.k, length(p.text) u, length(q.text) a from p join q using (conv_id, k)")
def positional_zip(spark, d):
    """User and assistant turns of a conversation side by side, up to the shorter list."""
    m = C.collected(table(spark, d, "conversations"))
    of = lambda role: F.transform(F.filter("messages", lambda x: x["role"] == role), lambda x: F.length(x["content"]))
    z = m.select("conv_id", of("user").alias("u"), of("assistant").alias("a"))
    n = F.least(F.size("u"), F.size("a"))
    return z.where(n > 0).select("conv_id", F.posexplode(F.zip_with(F.slice("u", 1, n), F.slice("a", 1, n), lambda u, a: F.struct(u.alias("u"), a.alias("a"))))).select("conv_id", (F.col("pos") + 1).cast("long").alias("k"), "col.u", "col.a")


@query(L + "select doc_id, comp, case when comp like 'RANGE%' then 'range' when comp in ('NO_GBP', 'UP_TO_ONLY') then 'none' else 'edge' end kind from labelled")
def pay_kinds(spark, d):
    c = F.col("comp")
    return lab(spark, d).select("doc_id", "comp", F.when(c.startswith("RANGE"), "range").when(c.isin("NO_GBP", "UP_TO_ONLY"), "none").otherwise("edge").alias("kind"))


@query("select doc_id, len(regexp_split_to_array(trim(text), '\\s+')) < 50 short_text from documents")
def word_count_check(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.size(F.split(F.trim("text"), "\\s+")) < 50).alias("short_text"))


@query(L + "select title, company, 'slug_' || regexp_replace(regexp_replace(title, '[^A-Za-z0-9._-]+', '_', 'g'), '^_|_$', '', 'g') slug, count(*) n from labelled group by 1, 2")
def slugs(spark, d):
    return lab(spark, d).groupBy("title", "company").agg(F.count("*").alias("n")).withColumn("slug", F.concat(F.lit("slug_"), X.slug(F.col("title"))))


@query(L + "select doc_id, case when contains(jd_text, 'OTE') then 'NO_GBP' when contains(jd_text, '£500 per day') then 'UP_TO_ONLY' else comp end comp from labelled")
def postprocess_overrides(spark, d):
    t = F.col("jd_text")
    return lab(spark, d).select("doc_id", F.when(F.rlike(t, F.lit(r"\bOTE\b")), "NO_GBP").when(F.rlike(t, F.lit(r"(?i)/day|per day|day rate")), "UP_TO_ONLY").otherwise(F.col("comp")).alias("comp"))
