"""Further queries: evidence extraction, set operations, reports over labels and runs, assemblies."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.functions import rules as R
from siftwork.functions import text as X
from siftwork.functions import tokens as K
from siftwork.operators import sampling as S
from siftwork.operators.evaluate import percent
from siftwork.plans import fixtures as fx
from siftwork.plans.catalog import query
from siftwork.plans.fixtures import ctes, table

L = ctes("labelled")
J = ctes("jobs")
P = ctes("predictions")

#: Words that stand for a token in evidence. Fixed values.
EVIDENCE = {
    "NODE": r"\bnode(?:\.js|js)?\b",
    "REACT": r"\breact(?:\.js|js)?\b",
    "JS_TS": r"\b(?:java|type)script\b|(?<!\.)\bjs\b|(?<!\.)\bts\b",
    "AI_ML": r"artificial intelligence|machine learning|deep learning|neural networks?|computer vision|prompt engineering|fine[\s-]tuning|\bllms?\b|\bml\b|\bnlp\b|\blm\b|\bai\b|\bpytorch\b|\btensorflow\b",
}


def lab(spark, d):
    return table(spark, d, "labelled")


def evidence(text: str | None, tech: list[str]) -> str | None:
    """Terms of the labelled tokens as the text has them, in reading order, overlaps and repeats left out."""
    if not text or not tech or "OOS" in tech:
        return None
    found = sorted(((m.start(), k, m.end(), m[0]) for k, t in enumerate(tech) if t in EVIDENCE for m in re.finditer(EVIDENCE[t], text, re.I)), key=lambda x: x[:2])
    out: dict[str, str] = {}
    end = -1
    for a, _, b, term in found:
        if a >= end:
            end = b
            out.setdefault(term.lower(), term)
    return ", ".join(out.values()) or None


@F.pandas_udf(T.StringType())
def _evidence(text: pd.Series, tech: pd.Series) -> pd.Series:
    return pd.Series([evidence(t, x.split(",")) for t, x in zip(text, tech, strict=True)], dtype="object")


@query(L + "select doc_id, case tech when 'OOS' then null else case when jd_text like '%Node.js and TypeScript.%' then case when tech like '%NODE%' then 'Node.js, TypeScript' end when jd_text like '%React Native and JavaScript.%' then 'React, JavaScript' when jd_text like '%Machine learning with PyTorch.%' then 'Machine learning, PyTorch' when jd_text like '%NestJS, React, LLM fine-tuning.%' then 'React, LLM, fine-tuning' end end evidence from labelled")
def tech_evidence(spark, d):
    """Texts of rows out of scope don't reach Python."""
    head = F.substring_index("jd_text", "\n", 1)
    scope = F.col("tech") != "OOS"
    return lab(spark, d).select("doc_id", F.when(scope, _evidence(F.when(scope, head), F.when(scope, F.col("tech")).otherwise("OOS"))).alias("evidence"))


def unqualified(c, phrases: list[str]):
    """Whether a phrase stands without "no " before it and without "ignored" or "but not" in the twenty characters after."""
    said = "|".join(re.escape(p) for p in phrases)
    return F.rlike(c, F.lit(rf"(?<!no )(?:{said})(?![\s\S]{{0,13}}ignored|[\s\S]{{0,13}}but not)"))


@query(L + "select doc_id, doc_id % 4 in (0, 3) hit from labelled")
def unqualified_match(spark, d):
    said = F.expr("case doc_id % 4 when 0 then 'has remote work' when 1 then 'no remote work' when 2 then 'remote but ignored' else 'no remote, yet remote' end")
    return lab(spark, d).select("doc_id", unqualified(said, ["remote"]).alias("hit"))


@query(L + "select doc_id, case doc_id % 4 when 0 then null when 1 then 'mismatch' when 2 then 'no_arrow' else 'missing' end issue from labelled")
def reason_arrow_check(spark, d):
    reason = F.expr("case doc_id % 4 when 0 then 'London -> ' || loc when 1 then 'x -> OTHER' when 2 then 'plain' end")
    arrow = F.regexp_extract(reason, r"->\s*([A-Z][A-Z0-9_]*)\s*$", 1)
    issue = F.when(reason.isNull(), "missing").when(arrow == "", "no_arrow").when(arrow != F.col("loc"), "mismatch")
    return lab(spark, d).select("doc_id", issue.alias("issue"))


@query(J + "select doc_id, case when title in ('Backend Developer', 'Junior QA Engineer', 'Product Manager', 'Engineering Manager') and doc_id % 3 = 0 then 'Senior Software Engineer' end said from jobs")
def embedded_title_mismatch(spark, d):
    """A senior title at the head of a text whose stored title names no seniority."""
    rows = table(spark, d, "jobs").select("doc_id", "title", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Senior Software Engineer\n"), "body")).otherwise(F.col("body")).alias("t"))
    word = r"(?i)\b(senior|staff|principal|lead|leader|head|chief|director|vp|cto|founding|snr|sr|iii|distinguished)\b"
    full = r"(?i)\b(?:senior|staff|principal|lead|head|chief|director|vp|cto|founding|snr|sr\.?)\s+(?:(?:software|backend|frontend|full[- ]?stack|data|devops|cloud|platform|ml|machine learning|site reliability)\s+)?(?:engineer|developer|architect|scientist|sre)\b"
    said = F.nullif(F.regexp_extract(F.substring("t", 1, 300), full, 0), F.lit(""))
    return rows.select("doc_id", F.when(~F.rlike("title", F.lit(word)), said).alias("said"))


@query(L + "select doc_id, list_aggregate(list_filter([case when (jd_text like '%OTE £%' or jd_text like '%£500 per day%' or jd_text like '%total compensation%') and comp <> 'NO_GBP' then 'comp' end, case when job_location = 'Anywhere' and jd_text like '%remote%' and loc <> 'REMOTE' then 'loc' end], lambda x: x is not null), 'string_agg', ',') flags from labelled")
def label_audit_rules(spark, d):
    t = F.col("jd_text")
    pay = F.rlike(t, F.lit(r"(?i)\btotal\s+comp(ensation)?\b|\btc\b|\bote £|per\s+day|/day|\bday\s+rate\b"))
    flags = F.array_compact(F.array(F.when(pay & (F.col("comp") != "NO_GBP"), "comp"), F.when((F.col("job_location") == "Anywhere") & t.contains("remote") & (F.col("loc") != "REMOTE"), "loc")))
    return lab(spark, d).select("doc_id", F.when(F.size(flags) > 0, F.array_join(flags, ",")).alias("flags"))


@query(L + "select case source_file when 'src0' then 'it_support_scrape' when 'src1' then 'patch_scrape' else case when source_file like 'src1%' then 'low_salary' else 'other' end end bucket, count(*) n, round(100.0 * count(*) / (select count(*) from labelled), 1) pct from labelled group by 1")
def source_buckets(spark, d):
    c = F.col("source_file")
    b = F.when(c == "src0", "it_support_scrape").when(c == "src1", "patch_scrape").when(c.startswith("src1"), "low_salary").otherwise("other")
    rows = lab(spark, d)
    total = rows.agg(F.count("*").alias("total"))
    return rows.groupBy(b.alias("bucket")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("bucket", "n", percent(F.col("n"), F.col("total")).alias("pct"))


@query(L + "select doc_id, case when label = 'good_fit' then 3 else 0 end + case when comp = 'RANGE_55_74K' then 3 else 0 end + case when loc = 'IN_LONDON' then 2 else 0 end + case when tech like '%AI_ML%' then 3 else 0 end + case when tech <> 'OOS' then 1 else 0 end + case when score >= 55 then 1 else 0 end prio from labelled")
def supplement_priority(spark, d):
    one = lambda s, n: F.when(F.expr(s), n).otherwise(0)
    p = one("label = 'good_fit'", 3) + one("comp = 'RANGE_55_74K'", 3) + one("loc = 'IN_LONDON'", 2) + one("array_contains(split(tech, ','), 'AI_ML')", 3) + one("tech <> 'OOS'", 1) + one("score >= 55", 1)
    return lab(spark, d).select("doc_id", p.alias("prio"))


@query(L + f"select doc_id, {fx._map('loc', fx.LOC_SCORE)} loc_score, case when tech = 'OOS' then 0 else {fx._map('sen', fx.SEN_SCORE)} end role_score, case tech when 'NODE,JS_TS' then 15 when 'REACT,JS_TS' then 10 when 'AI_ML' then 10 when 'NODE,REACT,AI_ML' then 25 else 0 end tech_score, {fx._map('comp', fx.COMP_SCORE)} comp_score, true score_match, true label_match from labelled")
def score_breakdown(spark, d):
    c = F.col
    s = K.scores(c("loc"), c("sen"), F.split("tech", ","), c("comp"))
    return lab(spark, d).select("doc_id", *[s[k].alias(k) for k in ("loc_score", "role_score", "tech_score", "comp_score")], (s["score"] == c("score")).alias("score_match"), (s["label"] == c("label")).alias("label_match"))


@query("select lang, sum(length(text))::bigint before, sum(length(trim(regexp_replace(replace(text, chr(160), ' '), '[\\s\\x0b]+', ' ', 'g'))))::bigint after, count(*) filter (length(text) = 50) at_fifty from documents group by 1".replace("\\\\", "\\"))
def shrink_stats(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("lang").agg(F.sum(F.length("text")).alias("before"), F.sum(F.length(X.clean(F.col("text")))).alias("after"), F.count_if(F.length("text") == 50).alias("at_fifty"))


@query(P + "select job_index from predictions where p_label is null and job_index in (select job_index + 1 from predictions where p_label is not null)")
def excluded_here_valid_there(spark, d):
    p = table(spark, d, "predictions")
    valid = p.where("p_label is not null").select((F.col("job_index") + 1).alias("job_index"))
    return p.where("p_label is null").select("job_index").join(valid, "job_index", "left_semi")


@query(P + "select count(*) filter (g_arr <> 'UNK') n, count(*) filter (g_arr <> 'UNK' and p_arr = g_arr) hits, round(100.0 * count(*) filter (g_arr <> 'UNK' and p_arr = g_arr) / greatest(count(*) filter (g_arr <> 'UNK'), 1), 1) pct from predictions where p_label is not null")
def accuracy_skipping_null_gold(spark, d):
    gold = F.when(F.col("g_arr") != "UNK", F.col("g_arr"))
    return table(spark, d, "predictions").where("p_label is not null").agg(F.count(gold).alias("n"), F.count_if(gold == F.col("p_arr")).alias("hits"), percent(F.count_if(gold == F.col("p_arr")), F.count(gold)).alias("pct"))


@query(P + "select g_label, count(*) filter (p_score > g_score) over_n, count(*) filter (p_score < g_score) under_n, count(*) filter (p_score = g_score and p_label is not null) same_n from predictions group by 1")
def over_under_split(spark, d):
    c = F.col
    return table(spark, d, "predictions").groupBy("g_label").agg(F.count_if(c("p_score") > c("g_score")).alias("over_n"), F.count_if(c("p_score") < c("g_score")).alias("under_n"), F.count_if(c("p_score") == c("g_score")).alias("same_n"))


@query(P + "select g_loc, p_loc, n, case when n >= 0.2 * t then 'HIGH' when n >= 0.1 * t then 'MEDIUM' else 'LOW' end priority from (select g_loc, p_loc, count(*) n, sum(count(*)) over (partition by g_loc) t from predictions where p_label is not null group by 1, 2) x where g_loc <> p_loc and n >= 3")
def suggestions(spark, d):
    g = table(spark, d, "predictions").where("p_label is not null").groupBy("g_loc", "p_loc").agg(F.count("*").alias("n"))
    t = F.sum("n").over(Window.partitionBy("g_loc"))
    return g.withColumn("t", t).where("g_loc <> p_loc and n >= 3").select("g_loc", "p_loc", "n", F.when(F.col("n") >= 0.2 * F.col("t"), "HIGH").when(F.col("n") >= 0.1 * F.col("t"), "MEDIUM").otherwise("LOW").alias("priority"))


@query("select event_type, user_id, n from (select event_type, user_id, count(*) n, row_number() over (partition by event_type order by count(*) desc, user_id) rn from events group by 1, 2) x where rn <= 3")
def top_k_per_type(spark, d):
    g = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return S.ranked(g, ["event_type"], F.desc("n"), F.asc("user_id")).where("rn <= 3").drop("rn")


@query("select event_type, list_aggregate(list_transform(l[:3], lambda x: x.k || ':' || x.n), 'string_agg', ',') top from (select event_type, list({'n': n, 'k': k} order by n desc, k) l from (select event_type, json_extract(props, '$.k')::int k, count(*) n from events group by 1, 2) x group by 1) y")
def top_k_map(spark, d):
    e = table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))
    best = S.ranked(e, ["event_type"], F.desc("n"), F.asc("k")).where("rn <= 3")
    pairs = F.array_sort(F.collect_list(F.struct("rn", F.concat_ws(":", F.col("k").cast("string"), F.col("n").cast("string")).alias("s"))))
    return best.groupBy("event_type").agg(F.array_join(F.transform(pairs, lambda x: x["s"]), ",").alias("top"))


@query("select distinct event_type from events where lower(event_type) like '%p%' and event_type not in ('signup')")
def name_filters(spark, d):
    """A substring filter without case, and a list to skip."""
    e = table(spark, d, "events")
    skip = spark.createDataFrame([("signup",)], "event_type string")
    return e.where(F.lower("event_type").contains("P".lower())).join(F.broadcast(skip), "event_type", "left_anti").select("event_type").distinct()


@query("select doc_id from documents except select doc_id from labels")
def unlabelled_ids(spark, d):
    return table(spark, d, "documents").select("doc_id").exceptAll(table(spark, d, "labels").select("doc_id").distinct())


@query("select d.doc_id, coalesce(l.quality, -1) quality, l.doc_id is null missing from documents d left join labels l using (doc_id)")
def lookup_with_fallback(spark, d):
    own = table(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("hit"))
    j = table(spark, d, "documents").select("doc_id").join(own, "doc_id", "left")
    return j.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.col("hit").isNull().alias("missing"))


@query(L + "select title, count(*) n, bool_and(score between 0 and 100) in_range, count(distinct label) labels, max(sen) = min(sen) same_sen from labelled group by 1")
def batch_invariants(spark, d):
    return lab(spark, d).groupBy("title").agg(F.count("*").alias("n"), F.every(F.col("score").between(0, 100)).alias("in_range"), F.countDistinct("label").alias("labels"), (F.max("sen") == F.min("sen")).alias("same_sen"))


SYN = fx.u(41, 5) + " = 0"
TRAIN_GOALS = {"good_fit": 0.18, "maybe": 0.25, "bad_fit": 0.57}


def _train_sql() -> str:
    goal = "case label when 'good_fit' then 72 when 'maybe' then 100 else 228 end"
    return L + f""", x as (select doc_id, label, {SYN} syn, row_number() over (partition by label, {SYN} order by md5('42|' || doc_id)) rn, count(*) filter (not ({SYN})) over (partition by label) reals from labelled),
  want as (select label, any_value(greatest(0, {goal} - reals)) w, count(*) filter (syn) have, case label when 'good_fit' then 1 when 'maybe' then 2 else 3 end k from x group by 1),
  given as (select label, k, least(w, have) g from want), cum as (select label, g, sum(g) over (order by k) - g before from given), quota as (select label, greatest(0, least(g, 100 - before)) q from cum)
select doc_id, label from x join quota using (label) where (not syn and rn <= {goal}) or (syn and rn <= q)"""


@query(_train_sql())
def train_assemble(spark, d):
    """400 rows at 18 / 25 / 57 per cent; real rows first, made-up ones to a quarter of all, in the order of labels."""
    total = 400
    syn = F.expr(SYN)
    rows = lab(spark, d).select("doc_id", "label", syn.alias("syn"))
    have = {(r.label, r.syn): r["count"] for r in rows.groupBy("label", "syn").count().collect()}
    room, real, made = int(total * 0.25), {}, {}
    for k, share in TRAIN_GOALS.items():
        goal = S.half_up(total * share)
        real[k] = min(goal, have.get((k, False), 0))
        made[k] = min(goal - real[k], have.get((k, True), 0), room)
        room -= made[k]
    order = S.shuffled(42, "doc_id")
    return S.take(rows.where("not syn"), "label", real, order).unionByName(S.take(rows.where("syn"), "label", made, order)).select("doc_id", "label")


@query(L + f"select job_id, 'merged' part, label from labelled where {fx.u(43, 3)} <> 0 union all select 'new_' || job_id, 'added', label from labelled where {fx.u(43, 3)} = 0")
def merge_sources(spark, d):
    rows = lab(spark, d)
    new = F.expr(fx.u(43, 3)) == 0
    old = rows.where(~new).select("job_id", F.lit("merged").alias("part"), "label")
    return old.unionByName(rows.where(new).select(F.concat(F.lit("new_"), "job_id").alias("job_id"), F.lit("added").alias("part"), "label"))


@query(L + "select v.v variant, doc_id, v.v || ': ' || title said from labelled cross join (values ('vague'), ('short'), ('formal'), ('misleading')) v(v)")
def variant_grid(spark, d):
    """Each variant of every row."""
    v = F.explode(F.array(*[F.lit(x) for x in ("vague", "short", "formal", "misleading")])).alias("variant")
    return lab(spark, d).select("*", v).select("variant", "doc_id", F.concat("variant", F.lit(": "), "title").alias("said"))


@query(ctes("labelled", "targets") + ", counts as (select 'loc' field, loc token, count(*) n from labelled group by 2 union all select 'comp', comp, count(*) from labelled group by 2) select field, token, target - coalesce(n, 0) need from targets left join counts using (field, token) where field in ('loc', 'comp') and target > coalesce(n, 0)")
def gap_specs(spark, d):
    from siftwork.plans.curation import gap_report

    return gap_report(spark, d).where("field in ('loc', 'comp') and gap > 0").select("field", "token", F.col("gap").alias("need"))


@query("select k, 'gen_' || lpad(k::varchar, 4, '0') id, (['Backend', 'Frontend', 'Data'])[((('0x' || substr(md5('7|' || k), 1, 8))::bigint) % 3)::int + 1] || ' Engineer' title from (select unnest(range(0, 500)) k) x")
def template_rows(spark, d):
    k = F.col("id").cast("string")
    i = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("7|"), k)), 1, 8), 16, 10).cast("long"), F.lit(3)).cast("int")
    return spark.range(500).select(F.col("id").alias("k"), F.concat(F.lit("gen_"), F.lpad(k, 4, "0")).alias("id"), F.concat(F.element_at(F.array(F.lit("Backend"), F.lit("Frontend"), F.lit("Data")), i + 1), F.lit(" Engineer")).alias("title"))


@query(L + "select doc_id, case when doc_id % 10 = 0 and loc <> 'UNK' then 'loc:' || loc || '->UNK' end diff from labelled")
def version_comparison(spark, d):
    """Labels of two schema versions of one row, told apart by field."""
    a = lab(spark, d).select("doc_id", "loc")
    b = a.select("doc_id", F.when(F.col("doc_id") % 10 == 0, "UNK").otherwise(F.col("loc")).alias("loc2"))
    return a.join(b, "doc_id").select("doc_id", F.when(F.col("loc") != F.col("loc2"), F.concat_ws("", F.lit("loc:"), "loc", F.lit("->"), "loc2")).alias("diff"))


@query(J + "select doc_id, case when regexp_matches(jd_text, '(?i)\\bremote\\b') then 'REMOTE' when regexp_matches(jd_text, '(?i)\\bhybrid\\b') then 'HYBRID' when regexp_matches(jd_text, '(?i)on[- ]?site') then 'IN_OFFICE' else 'UNK' end hint from jobs".replace("\\\\", "\\"))
def hint_builder(spark, d):
    t = F.col("jd_text")
    return table(spark, d, "jobs").select("doc_id", F.when(F.rlike(t, F.lit(r"(?i)\bremote\b")), "REMOTE").when(F.rlike(t, F.lit(r"(?i)\bhybrid\b")), "HYBRID").when(F.rlike(t, F.lit("(?i)on[- ]?site")), "IN_OFFICE").otherwise("UNK").alias("hint"))


@query(L + "select doc_id, list_aggregate(list_sort(string_split(tech, ',')), 'string_agg', '+') sorted_tech from labelled")
def metadata_json_array(spark, d):
    """A JSON array within a string, parsed and sorted."""
    text = F.to_json(F.split("tech", ","))
    return lab(spark, d).select("doc_id", F.array_join(F.array_sort(F.from_json(text, "array<string>")), "+").alias("sorted_tech"))


@query(J + f", h as (select distinct lower(trim(title)) t from jobs where {fx.u(20, 100)} = 1), keyed as (select *, row_number() over (partition by lower(trim(title)) || '|' || lower(company) || '|' || job_location order by doc_id) rn from jobs) select doc_id from keyed where rn = 1 and lower(trim(title)) || job_location not in (select t || 'Remote' from h)")
def clean_eval_set(spark, d):
    """Rows whose title and place the training side doesn't have, one for each title, company and place."""
    from siftwork.operators.dedup import keep_first

    rows = table(spark, d, "jobs")
    held = rows.where(F.expr(fx.u(20, 100)) == 1).select(F.concat(F.lower(F.trim("title")), F.lit("Remote")).alias("k")).distinct()
    one = keep_first(rows, F.concat_ws("|", F.lower(F.trim("title")), F.lower("company"), "job_location"), "doc_id")
    return one.withColumn("k", F.concat(F.lower(F.trim("title")), "job_location")).join(held, "k", "left_anti").select("doc_id")


@query(J + "select doc_id, case when x_arr = 'UNK' then 'arrangement not stated' else lower(x_arr) end arr_raw, case when contains(jd_text, '£') then 'pay stated' else 'no pay' end comp_raw from jobs")
def canonical_fallbacks(spark, d):
    arr = R.arrangement(F.col("jd_text"))
    return table(spark, d, "jobs").select("doc_id", F.when(arr == "UNK", "arrangement not stated").otherwise(F.lower(arr)).alias("arr_raw"), F.when(F.col("jd_text").contains("£"), "pay stated").otherwise("no pay").alias("comp_raw"))
