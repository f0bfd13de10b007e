"""Queries of dedup, decontamination, audits and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions import text as X
from siftwork.operators import audit as A
from siftwork.operators import dedup as D
from siftwork.operators.evaluate import percent
from siftwork.plans import fixtures as fx
from siftwork.plans.catalog import query
from siftwork.plans.fixtures import ctes, table
from siftwork.plans.text import COMPANY, NORM

L = ctes("labelled")
J = ctes("jobs")


def lab(spark, d):
    return table(spark, d, "labelled")


@query("select doc_id from (select doc_id, row_number() over (partition by md5(text) order by doc_id) rn from documents) x where rn = 1")
def dedup_content_hash(spark, d):
    return D.keep_first(table(spark, d, "documents").select("doc_id", "text"), F.md5("text"), "doc_id").select("doc_id")


@query(J + "select min(doc_id) doc_id from jobs group by doc_id % 700")
def dedup_id_keep_first(spark, d):
    return D.keep_first(table(spark, d, "jobs"), F.col("doc_id") % 700, "line_no").select("doc_id")


@query(J + "select max(doc_id) doc_id from jobs group by doc_id % 700")
def dedup_id_keep_last(spark, d):
    return D.keep_first(table(spark, d, "jobs"), F.col("doc_id") % 700, "line_no", last=True).select("doc_id")


PAIR = f"lower(trim(title)) || '||' || {COMPANY}"


@query(J + f"select min(line_no) line_no, {PAIR} pair_key from jobs group by 2")
def dedup_title_company(spark, d):
    k = X.pair_key(F.col("title"), F.col("company"))
    return D.keep_first(table(spark, d, "jobs"), k, "line_no").select("line_no", k.alias("pair_key"))


@query(f"select doc_id, first_seen from (select doc_id, min(doc_id) over (partition by f) first_seen from (select doc_id, substr(sha256({NORM.format('lower(substr(text, 1, 500))')}), 1, 16) f from documents) x) y where doc_id > first_seen")
def fingerprint_dups(spark, d):
    return D.first_seen(table(spark, d, "documents"), X.fingerprint(F.col("text")), "doc_id").select("doc_id", "first_seen")


LEVELS = {"id": ("job_id", "job_id"), "family": ("'f' || doc_id % 50", "'f' || doc_id % 50"), "fingerprint": ("md5(substr(body, 1, 500))", "md5(substr(body, 1, 500))")}


def _levels():
    fam = F.concat(F.lit("f"), (F.col("doc_id") % 50).cast("string"))
    fp = F.md5(F.substring("body", 1, 500))
    return {"id": (F.col("job_id"), F.col("job_id")), "family": (fam, fam), "fingerprint": (fp, fp)}


HELD = f"held as (select * from jobs where {fx.u(20, 100)} = 0)"


@query(J + f", {HELD} select doc_id, case when job_id in (select job_id from held) then 'id' when 'f' || doc_id % 50 in (select 'f' || doc_id % 50 from held) then 'family' when md5(substr(body, 1, 500)) in (select md5(substr(body, 1, 500)) from held) then 'fingerprint' end reason from jobs")
def decontaminate_3level(spark, d):
    j = table(spark, d, "jobs")
    return D.decontaminated(j, j.where(F.expr(fx.u(20, 100)) == 0), _levels()).select("doc_id", "reason")


@query(J + f", {HELD} select doc_id, job_id in (select job_id from held) id, 'f' || doc_id % 50 in (select 'f' || doc_id % 50 from held) family, md5(substr(body, 1, 500)) in (select md5(substr(body, 1, 500)) from held) fingerprint from jobs")
def contamination_flags(spark, d):
    j = table(spark, d, "jobs")
    return D.contaminated(j, j.where(F.expr(fx.u(20, 100)) == 0), _levels()).select("doc_id", "id", "family", "fingerprint")


@query(J + f", {HELD} select count(*) n from (select distinct title || company k from jobs where {fx.u(20, 100)} <> 0 intersect select title || company from held) x")
def split_overlap_check(spark, d):
    j = table(spark, d, "jobs").withColumn("k", F.concat("title", "company"))
    held = F.expr(fx.u(20, 100)) == 0
    return j.where(~held).select("k").intersect(j.where(held).select("k")).agg(F.count("*").alias("n"))


@query(J + f", {HELD} select doc_id from jobs where lower(title) || lower(company) not in (select lower(title) || lower(company) from held)")
def title_anti_join(spark, d):
    j = table(spark, d, "jobs").withColumn("k", F.concat(F.lower("title"), F.lower("company")))
    return j.join(j.where(F.expr(fx.u(20, 100)) == 0).select("k").distinct(), "k", "left_anti").select("doc_id")


WORDS = r"list_distinct(list_filter(string_split(regexp_replace(regexp_replace(trim(lower(substr(text, 1, 300))), '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s]', '', 'g'), ' '), lambda w: w <> ''))"
PAIRS = f"s as materialized (select doc_id, {WORDS} w from documents), cls as materialized (select min(doc_id) id, list_sort(w) w from s group by 2), e as materialized (select id, len(w) n, unnest(w) t from cls), pr as (select a.id a, b.id b, count(*) k, any_value(a.n) na, any_value(b.n) nb from e a join e b on a.t = b.t and a.id < b.id group by 1, 2), pairs as materialized (select a, b, k / (na + nb - k) jaccard from pr where k / (na + nb - k) >= 0.85)"


def word_classes(spark, d):
    s = table(spark, d, "documents").select("doc_id", F.array_sort(X.word_set(F.substring("text", 1, 300))).alias("w"))
    return s.groupBy("w").agg(F.min("doc_id").alias("id"))


@query(f"with {PAIRS} select a, b, round(jaccard, 6) jaccard from pairs")
def fuzzy_dedup_jaccard(spark, d):
    return D.similar_pairs(word_classes(spark, d), "id", "w", 0.85).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


#: Rows in order, each kept unless one of its earlier pairs is: a recursion that carries the list of the kept.
GREEDY = "ord as materialized (select id, row_number() over (order by id) rn from nodes), near as materialized (select b, list(a) l from pairs group by 1), step as (select 0::bigint rn, []::{kind}[] kept union all select s.rn + 1, case when n.l is not null and list_has_any(kept, n.l) then kept else list_append(kept, o.id) end from step s join ord o on o.rn = s.rn + 1 left join near n on n.b = o.id), done as (select unnest(kept) id from step where rn = (select max(rn) from ord))"


@query(f"with recursive {PAIRS}, nodes as (select id from cls), {GREEDY.format(kind='bigint')} select id from done")
def fuzzy_dedup_kept(spark, d):
    c = D.written(word_classes(spark, d))
    return D.greedy_kept(c.select("id"), D.similar_pairs(c, "id", "w", 0.85))


GRAMS = "list_sort(list_distinct(list_transform(range(1, length(lower(body)) - 1), lambda i: substr(lower(body), i, 3))))"
GRAM_PAIRS = f"g as materialized (select md5('42|' || doc_id) || '|' || doc_id id, doc_id, {GRAMS} w from labelled where tech = 'OOS'), cls as materialized (select min(id) id, arg_min(doc_id, id) doc_id, w from g group by 3), nodes as (select id from cls), e as materialized (select id, len(w) n, unnest(w) t from cls), pr as (select a.id a, b.id b, count(*) k, any_value(a.n) na, any_value(b.n) nb from e a join e b on a.t = b.t and a.id < b.id group by 1, 2), pairs as materialized (select a, b from pr where k / (na + nb - k) >= 0.7)"


@query(L + f", {GRAM_PAIRS}, {GREEDY.format(kind='varchar')} select doc_id from cls join done using (id)")
def diversity_downsample(spark, d):
    """Of the rows out of scope: those that no earlier kept one resembles (three-grams of whole texts, 0.7), in shuffled order."""
    from siftwork.operators.sampling import shuffled

    rows = lab(spark, d).where("tech = 'OOS'").select(F.concat(shuffled(42, "doc_id"), F.lit("|"), F.col("doc_id")).alias("id"), "doc_id", X.gram_codes(F.col("body")).alias("g"))
    reps = D.written(rows.groupBy("g").agg(F.min_by("doc_id", "id").alias("doc_id"), F.min("id").alias("id")))
    place = F.conv(F.substring("id", 1, 8), 16, 10).cast("double") / 2**32
    kept = D.greedy_unlike(reps.select("id", "g", place.alias("place")), 0.7)
    return reps.join(kept, "id", "left_semi").select("doc_id")


ALPHA = r"length(regexp_replace(substr(text, 1, 500), '[^\p{L}]', '', 'g')) / greatest(length(substr(text, 1, 500)), 1)"


@query(f"select doc_id, case when length(text) < 200 then 'short' when {ALPHA} < 0.4 then 'alpha' end reason, least(length(text), 50000) kept_chars from documents")
def quality_filter(spark, d):
    t = F.col("text")
    reason = F.when(F.length(t) < 200, "short").when(X.letter_share(t) < 0.4, "alpha")
    return table(spark, d, "documents").select("doc_id", reason.alias("reason"), F.length(F.substring(t, 1, 50000)).alias("kept_chars"))


@query(J + "select case when jd_text = '' then 'empty' when length(body) < 200 then 'short' when title = '' then 'title' when job_location = '' then 'location' else 'ok' end reason, count(*) n from jobs group by 1")
def reject_reasons(spark, d):
    r = F.when(F.col("jd_text") == "", "empty").when(F.length("body") < 200, "short").when(F.col("title") == "", "title").when(F.col("job_location") == "", "location").otherwise("ok")
    return table(spark, d, "jobs").groupBy(r.alias("reason")).agg(F.count("*").alias("n"))


FP = f"substr(sha256({NORM.format('lower(substr(jd_text, 1, 500))')}), 1, 16)"
ISSUES = L + rf""", b as (select line_no, job_id, {PAIR} pk, {FP} fp, tech, loc, label, jd_text, length(jd_text) n from labelled), issues as (
  select line_no line, job_id, 'warning' severity, 'short_jd' "check" from b where n < 100 union all select line_no, job_id, 'warning', 'long_jd' from b where n > 15000
  union all select line_no, job_id, 'warning', 'trivial_bad_fit' from b where label = 'bad_fit' and loc = 'OUTSIDE_UK' and tech = 'OOS'
  union all select line_no, job_id, 'warning', 'html_artifacts' from b where regexp_matches(jd_text, '(?i)&(amp|lt|gt|nbsp|quot|apos|#\d+);') or regexp_matches(jd_text, '(?i)</?[a-z][\s\S]*?>')
  union all select line_no, job_id, 'warning', 'duplicate_title_company' from (select *, min(line_no) over (partition by pk) f from b) x where line_no > f
  union all select line_no, job_id, 'warning', 'duplicate_jd_fingerprint' from (select *, min(line_no) over (partition by fp) f from b) x where line_no > f) """


@query(ISSUES + 'select line, job_id, severity, "check" from issues')
def audit_issues(spark, d):
    return A.issues(lab(spark, d))


@query(ISSUES + 'select "check", count(*) filter (severity = \'critical\') critical, count(*) filter (severity = \'warning\') warning from issues group by 1')
def audit_summary(spark, d):
    return A.summary(A.issues(lab(spark, d)))


@query(ISSUES + 'select line_no from labelled where line_no not in (select line from issues where severity = \'critical\' or "check" in (\'duplicate_id\', \'duplicate_title_company\', \'short_jd\'))')
def audit_clean(spark, d):
    rows = lab(spark, d)
    return A.clean(rows, A.issues(rows)).select("line_no")


@query(ISSUES + "select case when \"check\" like 'duplicate%' then 'duplicates' when severity = 'critical' then 'bad_data' else 'suspicious' end bucket, count(*) n from issues group by 1")
def audit_quarantine(spark, d):
    return A.quarantine(A.issues(lab(spark, d))).groupBy("bucket").agg(F.count("*").alias("n"))


@query(L + "select lower(trim(title)) t, list_sort(list_distinct(list(sen))) sens, count(*) n from labelled group by 1 having count(distinct sen) > 1")
def label_inconsistency(spark, d):
    g = lab(spark, d).groupBy(F.lower(F.trim("title")).alias("t")).agg(F.array_sort(F.collect_set("sen")).alias("sens"), F.count("*").alias("n"))
    return g.where(F.size("sens") > 1)


@query(L + "select source_file, count(*) n, round(100.0 * count(*) / (select count(*) from labelled), 1) pct from labelled group by 1 having count(*) > 0.04 * (select count(*) from labelled)")
def source_cap(spark, d):
    rows = lab(spark, d)
    total = rows.agg(F.count("*").alias("total"))
    g = rows.groupBy("source_file").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))
    return g.where("n > 0.04 * total").select("source_file", "n", percent(F.col("n"), F.col("total")).alias("pct"))


@query(L + "select round(100.0 * count(*) filter (score between 50 and 74) / count(*), 1) pct, count(*) filter (score between 50 and 74) < 0.15 * count(*) starved from labelled")
def boundary_share(spark, d):
    b, n = F.count_if(F.col("score").between(50, 74)), F.count("*")
    return lab(spark, d).agg(percent(b, n).alias("pct"), (b < 0.15 * n).alias("starved"))


@query(L + "select case when grouping(loc) = 0 then 'loc' when grouping(arr) = 0 then 'arr' when grouping(sen) = 0 then 'sen' else 'comp' end field, coalesce(loc, arr, sen, comp) token, count(*) n from labelled group by grouping sets ((loc), (arr), (sen), (comp))")
def token_hist_multi(spark, d):
    lab(spark, d).createOrReplaceTempView("_labelled_hist")
    return spark.sql("select case when grouping(loc) = 0 then 'loc' when grouping(arr) = 0 then 'arr' when grouping(sen) = 0 then 'sen' else 'comp' end field, coalesce(loc, arr, sen, comp) token, count(*) n from _labelled_hist group by grouping sets ((loc), (arr), (sen), (comp))")


@query(L + "select t tech, count(*) n from (select unnest(string_split(tech, ',')) t from labelled) x group by 1")
def tech_hist(spark, d):
    return lab(spark, d).select(F.explode(F.split("tech", ",")).alias("tech")).groupBy("tech").agg(F.count("*").alias("n"))


@query(L + "select list_aggregate(list_sort(string_split(tech, ',')), 'string_agg', ',') combo, count(*) n, round(100.0 * count(*) / sum(count(*)) over (), 1) pct from labelled group by 1")
def tech_combo_hist(spark, d):
    rows = lab(spark, d)
    total = rows.agg(F.count("*").alias("total"))
    g = rows.groupBy(F.array_join(F.array_sort(F.split("tech", ",")), ",").alias("combo")).agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(total)).select("combo", "n", percent(F.col("n"), F.col("total")).alias("pct"))


@query(L + "select label, sen, count(*) n from labelled group by cube (label, sen)")
def label_by_seniority_cube(spark, d):
    return lab(spark, d).cube("label", "sen").agg(F.count("*").alias("n"))


@query(L + "select label, count(distinct job_location) n_locations, count(*) n, round(avg(score), 4) mean_score from labelled group by 1")
def distinct_locations(spark, d):
    return lab(spark, d).groupBy("label").agg(F.countDistinct("job_location").alias("n_locations"), F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


COUNTS = "counts as (select 'loc' field, loc token, count(*) n from labelled group by 2 union all select 'arr', arr, count(*) from labelled group by 2 union all select 'sen', sen, count(*) from labelled group by 2 union all select 'comp', comp, count(*) from labelled group by 2)"
LT = ctes("labelled", "targets")


def counts(spark, d):
    rows = lab(spark, d).select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("token")) for f in ("loc", "arr", "sen", "comp")])).alias("x"))
    return rows.groupBy("x.field", "x.token").agg(F.count("*").alias("n"))


@query(LT + f", {COUNTS} select t.field, t.token, t.target, coalesce(n, 0) n, t.target - coalesce(n, 0) gap from targets t left join counts c on c.field = t.field and c.token = t.token")
def gap_report(spark, d):
    t = table(spark, d, "targets")
    return t.join(counts(spark, d), ["field", "token"], "left").select("field", "token", "target", F.coalesce("n", F.lit(0)).alias("n"), (F.col("target") - F.coalesce("n", F.lit(0))).alias("gap"))


@query(LT + f", {COUNTS} select t.field, t.token, case when abs(coalesce(n, 0) - target) <= 0.1 * greatest(target, 1) then 'ok' when abs(coalesce(n, 0) - target) <= 0.2 * greatest(target, 1) then 'warn' else 'fail' end verdict from targets t left join counts c on c.field = t.field and c.token = t.token")
def tolerance_report(spark, d):
    off = F.abs(F.coalesce("n", F.lit(0)) - F.col("target"))
    base = F.greatest(F.col("target"), F.lit(1))
    return table(spark, d, "targets").join(counts(spark, d), ["field", "token"], "left").select("field", "token", F.when(off <= 0.1 * base, "ok").when(off <= 0.2 * base, "warn").otherwise("fail").alias("verdict"))


@query("select lang, n, list_sort(l)[(floor((n - 1) * 0.5))::int + 1] p50, list_sort(l)[(floor((n - 1) * 0.9))::int + 1] p90, list_sort(l)[(floor((n - 1) * 0.99))::int + 1] p99, n_over from (select lang, count(*) n, list(length(text)) l, count(*) filter (length(text) > 1400) n_over from documents group by 1) x")
def percentile_lengths(spark, d):
    """Values at rank floor((n - 1) * p), through counts of equal lengths."""
    from pyspark.sql import Window

    per = table(spark, d, "documents").groupBy("lang", F.length("text").alias("len")).agg(F.count("*").alias("k"))
    w = Window.partitionBy("lang").orderBy("len")
    cum = per.withColumn("upto", F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("k").over(Window.partitionBy("lang")))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * p), F.col("len")))
    return cum.groupBy("lang").agg(F.max("n").alias("n"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.sum(F.when(F.col("len") > 1400, F.col("k")).otherwise(0)).alias("n_over"))


@query("select quality, toxic, count(*) n from documents join labels using (doc_id) group by 1, 2")
def label_join_strata(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


