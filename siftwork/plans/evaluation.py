"""Queries of the evaluation suite and of run histories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftwork.functions import tokens as T
from siftwork.operators import evaluate as E
from siftwork.operators import trends as H
from siftwork.plans import fixtures as fx
from siftwork.plans import text as X
from siftwork.plans.catalog import query
from siftwork.plans.fixtures import ctes, table

P = ctes("predictions")
R = ctes("runs")
TECH = "list_sort(string_split({}, ','))"
VALID = "p_label is not null"


def preds(spark, d):
    return table(spark, d, "predictions")


def _ok(f: str) -> str:
    return f"{TECH.format('p_tech')} = {TECH.format('g_tech')}" if f == "tech" else f"p_{f} = g_{f}"


@query(P + " union all ".join(f"select '{f}' field, count(*) filter ({_ok(f)}) correct, count(*) n, round(100.0 * count(*) filter ({_ok(f)}) / greatest(count(*), 1), 1) pct from predictions where {VALID}" for f in E.FIELDS))
def field_accuracy(spark, d):
    return E.field_accuracy(preds(spark, d))


@query(P + f"select l.label, coalesce(c, 0) correct, coalesce(n, 0) n, round(100.0 * coalesce(c, 0) / greatest(coalesce(n, 0), 1), 1) pct from (values ('good_fit'), ('maybe'), ('bad_fit')) l(label) left join (select g_label, count(*) filter (p_label = g_label) c, count(*) n from predictions where {VALID} group by 1) p on p.g_label = l.label")
def label_accuracy(spark, d):
    return E.label_accuracy(preds(spark, d))


@query(P + f"select round(avg(pct), 3) macro, sum(correct)::bigint correct, sum(n)::bigint n from (select coalesce(100.0 * c / n, 0) pct, coalesce(c, 0) correct, coalesce(n, 0) n from (values ('good_fit'), ('maybe'), ('bad_fit')) l(label) left join (select g_label, count(*) filter (p_label = g_label) c, count(*) n from predictions where {VALID} group by 1) p on p.g_label = l.label) x")
def macro_accuracy(spark, d):
    per = E.label_accuracy(preds(spark, d))
    exact = F.coalesce(F.try_divide(100.0 * F.col("correct"), F.col("n")), F.lit(0.0))
    return per.agg(F.round(F.avg(exact), 3).alias("macro"), F.sum("correct").alias("correct"), F.sum("n").alias("n"))


GRID = "(values ('good_fit'), ('maybe'), ('bad_fit')) a(actual) cross join (values ('good_fit'), ('maybe'), ('bad_fit'){}) p(predicted)"


@query(P + f"select actual, predicted, coalesce(n, 0) n from {GRID.format('')} left join (select g_label, p_label, count(*) n from predictions group by 1, 2) x on x.g_label = actual and x.p_label = predicted")
def confusion_dense(spark, d):
    return E.confusion(preds(spark, d))


@query(P + f"select actual, predicted, coalesce(n, 0) n from {GRID.format(", ('parse_fail')")} left join (select g_label, coalesce(p_label, 'parse_fail') q, count(*) n from predictions group by 1, 2) x on x.g_label = actual and x.q = predicted")
def confusion_parse_fail(spark, d):
    return E.confusion(preds(spark, d), fail=True)


@query(P + "select g_label actual, count(*) filter (p_label = 'good_fit') good_fit, count(*) filter (p_label = 'maybe') maybe, count(*) filter (p_label = 'bad_fit') bad_fit, count(*) filter (p_label is null) parse_fail from predictions group by 1")
def confusion_pivot(spark, d):
    p = preds(spark, d).select(F.col("g_label").alias("actual"), F.coalesce("p_label", F.lit("parse_fail")).alias("q"))
    return p.groupBy("actual").pivot("q", [*E.LABELS, "parse_fail"]).agg(F.count(F.lit(1))).fillna(0)


@query(P + "select field, change, n from (select *, row_number() over (partition by field order by n desc, change) rn from (" + " union all ".join(f"select '{f}' field, g_{f} || '->' || p_{f} change, count(*) n from predictions where {VALID} and not ({_ok(f)}) group by 2" for f in E.FIELDS) + ") x) y where rn <= 3")
def transitions_topk(spark, d):
    w = Window.partitionBy("field").orderBy(F.desc("n"), "change")
    return E.transitions(preds(spark, d)).withColumn("rn", F.row_number().over(w)).where("rn <= 3").drop("rn")


@query(P + f"select count(*) n, round(avg(abs(p_score - g_score)), 4) mae, round(avg(p_score - g_score), 4) bias, count(*) filter (p_score > g_score) over_n, count(*) filter (p_score < g_score) under_n from predictions where {VALID}")
def mae_bias(spark, d):
    e = F.col("p_score") - F.col("g_score")
    return preds(spark, d).where(VALID).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.avg(e), 4).alias("bias"), F.count_if(e > 0).alias("over_n"), F.count_if(e < 0).alias("under_n"))


@query(P + "select count(*) total, count(*) filter (parse_fail) failed, count(*) filter (invalid_token) invalid, round(100.0 * count(*) filter (parse_fail) / count(*), 1) fail_pct, count(*) filter (g_tech is not null and p_tech is not null) scored from predictions")
def parse_fail_rate(spark, d):
    n = F.count("*")
    return preds(spark, d).agg(n.alias("total"), F.count_if("parse_fail").alias("failed"), F.count_if("invalid_token").alias("invalid"), E.percent(F.count_if("parse_fail"), n).alias("fail_pct"), F.count_if(F.expr("g_tech is not null and p_tech is not null")).alias("scored"))


@query(P + f"select total, valid, correct, round(100.0 * correct / valid, 2) measured, round(100.0 * correct / total, 2) worst, round(100.0 * (correct + total - valid) / total, 2) best, round(100.0 * (correct + (total - valid) * correct::double / valid) / total, 2) expected from (select count(*) total, count(*) filter ({VALID}) valid, count(*) filter (p_label = g_label) correct from predictions) x")
def accuracy_bounds(spark, d):
    return E.bounds(preds(spark, d))


@query(P + "select label, round(100.0 * a / ta - 100.0 * b / tb, 4) shift, abs(100.0 * a / ta - 100.0 * b / tb) > 2 flagged from (select g_label label, count(*) filter (p_label is null) a, count(*) b from predictions group by 1) x, (select count(*) filter (p_label is null) ta, count(*) tb from predictions) y")
def exclusion_bias(spark, d):
    per = preds(spark, d).groupBy(F.col("g_label").alias("label")).agg(F.count_if(F.col("p_label").isNull()).alias("a"), F.count("*").alias("b"))
    tot = per.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    shift = 100.0 * F.col("a") / F.col("ta") - 100.0 * F.col("b") / F.col("tb")
    return per.crossJoin(F.broadcast(tot)).select("label", F.round(shift, 4).alias("shift"), (F.abs(shift) > 2).alias("flagged"))


Z = "1.96"
WILSON = f"select label, n, greatest(0, mid - half) low, least(1, mid + half) high from (select label, n, (p + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n) mid, {Z} * sqrt((p * (1 - p) + {Z} * {Z} / (4 * n)) / n) / (1 + {Z} * {Z} / n) half from (select g_label label, count(*)::double n, count(*) filter (p_label = g_label)::double / count(*) p from predictions where {VALID} group by 1) x) y"


@query(P + f"select label, n::bigint n, round(low, 6) low, round(high, 6) high from ({WILSON}) w")
def wilson_ci(spark, d):
    per = preds(spark, d).where(VALID).groupBy(F.col("g_label").alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("p_label") == F.col("g_label")).alias("c"))
    low, high = T.wilson(F.col("c"), F.col("n"))
    return per.select("label", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


# the rules' tokens are those of the classifiers over the adverts; the SQL looks up what the injected phrases mean
RULED = f"select p.*, r.loc r_loc, r.arr r_arr, r.sen r_sen, r.tech r_tech, r.comp r_comp from predictions p join ({X.RULED}) r using (doc_id)"
PJ = ctes("predictions", "jobs")


def with_rules(spark, d):
    """Gold and predictions beside the tokens of the rule classifiers, joined by ordinal."""
    rules = X.ruled(table(spark, d, "jobs")).select(F.col("line_no").alias("job_index"), F.col("loc").alias("r_loc"), F.col("arr").alias("r_arr"), F.col("sen").alias("r_sen"), F.array_join("tech", ",").alias("r_tech"), F.col("comp").alias("r_comp"))
    return preds(spark, d).join(rules, "job_index")


def _hybrid(name: str, ruled: list[str]) -> str:
    f = {k: (f"r_{k}" if k in ruled else f"p_{k}" if name == "model" else f"case when {VALID} then p_{k} else r_{k} end") for k in E.FIELDS}
    where = f"where {VALID}" if name == "model" else ""
    return f"select '{name}' approach, doc_id, g_label, {', '.join(f'{v} {k}' for k, v in f.items())} from ruled {where}"


HYBRID = f"hyb as (select approach, doc_id, g_label, {fx.label_sql('score')} label from (select *, {fx.score_sql('loc', 'sen', 'tech', 'comp')} score from (" + " union all ".join(_hybrid(k, v) for k, v in {"model": [], "regex": E.FIELDS, "A": ["tech", "comp"], "B": ["arr", "tech", "comp"], "v12": ["loc", "tech", "comp"]}.items()) + ") u) s)"


@query(PJ + f", ruled as ({RULED}), {HYBRID} select approach, count(*) n, count(*) filter (label = g_label) correct, round(100.0 * count(*) filter (label = g_label) / count(*), 1) pct from hyb group by 1")
def hybrid_summary(spark, d):
    n, c = F.count("*"), F.count_if(F.col("label") == F.col("g_label"))
    return E.hybrids(with_rules(spark, d)).groupBy("approach").agg(n.alias("n"), c.alias("correct"), E.percent(c, n).alias("pct"))


@query(PJ + f", ruled as ({RULED}), {HYBRID} select doc_id, string_agg(approach, ',' order by approach) wrong from hyb where label <> g_label group by 1")
def hybrid_errors(spark, d):
    h = E.hybrids(with_rules(spark, d)).where("label <> g_label")
    return h.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("approach")), ",").alias("wrong"))


@query(PJ + f", ruled as ({RULED}), {HYBRID}, e as (select doc_id, max(case when approach = 'model' then (label = g_label)::int end) m, max(case when approach = 'regex' then (label = g_label)::int end) r from hyb group by 1) select case when m is null then 'none' when m = 1 then 'right' else 'wrong' end model, case when r = 1 then 'right' else 'wrong' end regex, count(*) n from e group by 1, 2")
def error_correlation(spark, d):
    h = E.hybrids(with_rules(spark, d)).where("approach in ('model', 'regex')").withColumn("ok", F.col("label") == F.col("g_label"))
    w = h.groupBy("doc_id").agg(F.max(F.when(F.col("approach") == "model", F.col("ok"))).alias("m"), F.max(F.when(F.col("approach") == "regex", F.col("ok"))).alias("r"))
    say = lambda c: F.when(c.isNull(), "none").when(c, "right").otherwise("wrong")
    return w.groupBy(say(F.col("m")).alias("model"), say(F.col("r")).alias("regex")).agg(F.count("*").alias("n"))


@query(P + "select job_index, " + " || '|' || ".join(f"case when {_ok(f)} then '' else '{f}:' || g_{f} || '->' || p_{f} end" for f in E.FIELDS) + f" diff from predictions where {VALID} and p_label <> g_label")
def field_diffs(spark, d):
    m = E.matches(preds(spark, d)).where(f"{VALID} and p_label <> g_label")
    parts = [F.when(F.col(f"ok_{f}"), "").otherwise(F.concat(F.lit(f"{f}:"), F.col(f"g_{f}"), F.lit("->"), F.col(f"p_{f}"))) for f in E.FIELDS]
    return m.select("job_index", F.array_join(F.array(*parts), "|").alias("diff"))


@query(P + f"select job_index, abs(p_score - g_score) err, p_label, g_label from predictions where {VALID} order by err desc, job_index limit 20")
def worst_errors(spark, d):
    return preds(spark, d).where(VALID).select("job_index", F.abs(F.col("p_score") - F.col("g_score")).alias("err"), "p_label", "g_label").orderBy(F.desc("err"), "job_index").limit(20)


@query(P + f"select job_index, case when p_label is null then 0.0 when p_label = g_label and p_score = g_score then 1.0 when p_label = g_label then 0.7 else 0.0 end graded from predictions")
def graded_score(spark, d):
    same = F.col("p_label") == F.col("g_label")
    return preds(spark, d).select("job_index", F.when(same & (F.col("p_score") == F.col("g_score")), 1.0).when(same, 0.7).otherwise(0.0).alias("graded"))


@query(P + "select job_index, g_score, p_score from predictions where g_score between 45 and 75 or p_score between 50 and 74")
def boundary_zone(spark, d):
    return preds(spark, d).where("g_score between 45 and 75 or p_score between 50 and 74").select("job_index", "g_score", "p_score")


@query(P + "select list_aggregate(list_filter([case when pf > 10 then 'parse_fail' end, case when acc < 40 then 'accuracy' end, case when mae > 30 then 'mae' end], lambda x: x is not null), 'string_agg', ',') reasons, round(pf, 1) pf, round(acc, 1) acc, round(mae, 1) mae from (select 100.0 * count(*) filter (parse_fail) / count(*) pf, 100.0 * count(*) filter (p_label = g_label) / greatest(count(p_label), 1) acc, avg(abs(p_score - g_score)) mae from predictions) x")
def threshold_gate(spark, d):
    n = F.count("*")
    a = preds(spark, d).agg((100.0 * F.count_if("parse_fail") / n).alias("pf"), (100.0 * F.count_if(F.expr("p_label = g_label")) / F.greatest(F.count("p_label"), F.lit(1))).alias("acc"), F.avg(F.abs(F.col("p_score") - F.col("g_score"))).alias("mae"))
    why = F.array_join(F.array_compact(F.array(F.when(F.col("pf") > 10, "parse_fail"), F.when(F.col("acc") < 40, "accuracy"), F.when(F.col("mae") > 30, "mae"))), ",")
    return a.select(F.when(why != "", why).alias("reasons"), *[F.round(c, 1).alias(c) for c in ("pf", "acc", "mae")])


@query(P + "select job_index, case when coalesce(s, 0) >= 70 then 'good_fit' when coalesce(s, 0) >= 50 then 'maybe' else 'bad_fit' end label, greatest(0, least(100, coalesce(s, 0))) total from (select job_index, coalesce(p_score, 0) + 5 s from predictions) x")
def recompute_from_numbers(spark, d):
    s = F.coalesce("p_score", F.lit(0)) + 5
    return preds(spark, d).select("job_index", T.label(s).alias("label"), F.greatest(F.lit(0), F.least(F.lit(100), s)).alias("total"))


@query(P + f"select count(*) n, round(100.0 * count(*) filter (a.p_label = b.p_label) / count(*), 1) agree, count(*) filter (a.p_loc <> b.p_loc) loc_changed from predictions a join predictions b on b.job_index = a.job_index + 1 where a.p_label is not null and b.p_label is not null")
def run_comparison(spark, d):
    a = preds(spark, d).where(VALID).select("job_index", F.col("p_label").alias("la"), F.col("p_loc").alias("ca"))
    b = preds(spark, d).where(VALID).select((F.col("job_index") - 1).alias("job_index"), F.col("p_label").alias("lb"), F.col("p_loc").alias("cb"))
    n = F.count("*")
    return a.join(b, "job_index").agg(n.alias("n"), E.percent(F.count_if(F.expr("la = lb")), n).alias("agree"), F.count_if(F.expr("ca <> cb")).alias("loc_changed"))


@query(PJ + """, t as (select line_no job_index, lower(title) t from jobs) select v.version, job_index, case when regexp_matches(t, '\\b(lead|principal|staff|director|head\\s+of|vp|cto|chief|architect|manager|founding)\\b') then 'LEVEL_3'
  when regexp_matches(t, '\\bsenior\\b|\\bsr\\.|\\bsr\\s|\\bsnr\\b') then case v.version when 'v12' then 'LEVEL_2' else 'LEVEL_3' end else case v.version when 'v12' then 'LEVEL_1' else 'LEVEL_2' end end sen from t cross join (values ('v12'), ('v13'), ('v13.1')) v(version)""")
def version_cross_scores(spark, d):
    """Every advert's seniority under each registered version of the rules."""
    from siftwork.versions import VERSIONS, resolved

    rows = table(spark, d, "jobs").select(F.col("line_no").alias("job_index"), "title")
    each = [F.struct(F.lit(k).alias("version"), resolved(k).seniority(F.col("title")).alias("sen")) for k in VERSIONS]
    return rows.select("job_index", F.explode(F.array(*each)).alias("x")).select("x.version", "job_index", "x.sen")


# run histories

RUN = "select run, model, n, 100.0 * ok / n acc, abs_err / n mae from runs"


def runs(spark, d):
    r = table(spark, d, "runs")
    return r.select("run", "model", "n", (100.0 * F.col("ok") / F.col("n")).alias("acc"), (F.col("abs_err") / F.col("n")).alias("mae"))


@query(R + f"select run, model, round(acc, 3) acc, delta, case when delta is null then 'new' when delta > 0.05 then 'up' when delta < -0.05 then 'down' else 'same' end trend from (select *, round(acc - lag(acc) over (partition by model order by run), 4) delta from ({RUN}) r) x")
def run_delta_lag(spark, d):
    return H.deltas(runs(spark, d), "model", "run", "acc").select("run", "model", F.round("acc", 3).alias("acc"), "delta", "trend")


@query(R + f"select run, model, n, back from (select *, row_number() over (partition by model order by run desc) back from ({RUN}) r) x where back <= 3")
def last_n_runs(spark, d):
    return H.last_runs(runs(spark, d), "model", "run", 3).select("run", "model", "n", F.col("back").cast("long").alias("back"))


@query(R + f"select model, round(acc, 3) acc, rank() over (order by round(acc, 3) desc) place from ({RUN}) r where run = (select max(run) from runs)")
def leaderboard(spark, d):
    r = runs(spark, d)
    latest = r.agg(F.max("run").alias("run"))
    return r.join(F.broadcast(latest), "run").select("model", F.round("acc", 3).alias("acc")).withColumn("place", F.rank().over(Window.orderBy(F.desc("acc"))).cast("long"))


@query(R + f", m as (select model, round(100.0 * sum(ok) / sum(n), 1) acc, sum(n)::bigint size from runs group by 1) select model, acc, size, acc = (select max(acc) from m) best, acc = (select max(acc) from m) and size = (select min(size) from m where acc = (select max(acc) from m)) winner from m")
def smallest_tied_winner(spark, d):
    m = table(spark, d, "runs").groupBy("model").agg(F.round(100.0 * F.sum("ok") / F.sum("n"), 1).alias("acc"), F.sum("n").alias("size"))
    return H.best(m, "acc", "size")


OKS = "select job_index, g_label grp, case when p_label is null then null else p_label = g_label end ok, p_label from predictions"


@query(P + f"select grp, job_index, seen, hits, sum(case when not ok then 1 else 0 end) over (partition by grp, hits order by job_index)::bigint streak from (select *, count(ok) over w seen, sum(case when ok then 1 else 0 end) over w::bigint hits from ({OKS}) o window w as (partition by grp order by job_index)) x".replace("over w::bigint", "over w"))
def wrong_streak(spark, d):
    ok = F.col("p_label") == F.col("g_label")
    out = H.running(preds(spark, d).withColumn("grp", F.col("g_label")), "grp", "job_index", ok)
    return out.select("grp", "job_index", "seen", "hits", F.col("streak").cast("long").alias("streak"))


@query(P + f"select grp, job_index, round(hits / seen, 6) acc from (select grp, job_index, count(ok) over w seen, sum(case when ok then 1 else 0 end) over w hits from ({OKS}) o window w as (partition by grp order by job_index)) x where seen > 0")
def running_accuracy(spark, d):
    ok = F.col("p_label") == F.col("g_label")
    out = H.running(preds(spark, d).withColumn("grp", F.col("g_label")), "grp", "job_index", ok)
    return out.where("seen > 0").select("grp", "job_index", F.round(F.col("hits") / F.col("seen"), 6).alias("acc"))


@query(P + f"""select grp, min(job_index) "at", arg_min(rule, job_index) rule from (select *, case when seen = 0 and rs >= 2 then 'all_failed' when streak >= 3 then 'streak' when seen >= 5 and labels = 1 then 'one_label' end rule from (
  select *, sum(case when not ok then 1 else 0 end) over (partition by grp, hits order by job_index) streak from (select *, count(ok) over w seen, sum(case when ok then 1 else 0 end) over w hits, count(*) over w rs, count(distinct p_label) over w labels from ({OKS}) o window w as (partition by grp order by job_index)) x) y) z where rule is not null group by 1""")
def early_exit(spark, d):
    ok = F.col("p_label") == F.col("g_label")
    return H.stops(preds(spark, d).withColumn("grp", F.col("g_label")), "grp", "job_index", ok, "p_label", streak=3)


@query("select strftime(ts, '%Y%m%d_%H%M%S') id, strftime(ts, '%b %-d %H:%M') short, (event_id // 60)::varchar || 'm' || lpad((event_id % 60)::varchar, 2, '0') || 's' took, event_id from events")
def timestamps(spark, d):
    e = table(spark, d, "events")
    took = F.format_string("%dm%02ds", F.floor(F.col("event_id") / 60), F.col("event_id") % 60)
    return e.select(F.date_format("ts", "yyyyMMdd_HHmmss").alias("id"), F.date_format("ts", "MMM d HH:mm").alias("short"), took.alias("took"), "event_id")


@query("select event_type, count(*) n, sum(json_extract(props, '$.k')::bigint)::bigint k_sum, round(avg(value), 6) mean from events group by 1")
def token_usage(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"), F.round(F.avg("value"), 6).alias("mean"))
