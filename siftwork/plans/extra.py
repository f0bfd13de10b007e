"""Queries of joins, reports and rules that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftwork.functions import extract as E
from siftwork.functions import repair
from siftwork.functions import rules as R
from siftwork.functions import text as X
from siftwork.functions import tokens as T
from siftwork.operators import audit as A
from siftwork.operators import evaluate as V
from siftwork.operators import label as B
from siftwork.operators import trends as H
from siftwork.plans import fixtures as fx
from siftwork.plans import text as TX
from siftwork.plans.catalog import query
from siftwork.plans.fixtures import ctes, table

L = ctes("labelled")
J = ctes("jobs")
P = ctes("predictions")
P2 = ctes("predictions", "predictions_b")
RN = ctes("runs")


def lab(spark, d):
    return table(spark, d, "labelled")


def preds(spark, d):
    return table(spark, d, "predictions")


STALE = "select job_index, seq, p_label from (select job_index, 2 seq, p_label from predictions union all select job_index, 1, p_label from predictions_b) x"


@query(ctes("labelled", "predictions", "predictions_b") + f", every as ({STALE}), last as (select job_index, arg_max(coalesce(p_label, 'none'), seq) p from every group by 1) select line_no, label, case when p <> 'none' then p end predicted from labelled l left join last on job_index = line_no")
def gold_with_last_prediction(spark, d):
    """Gold with predictions by ordinal; of several predictions of a row the later one counts."""
    every = preds(spark, d).select("job_index", F.lit(2).alias("seq"), "p_label").unionByName(table(spark, d, "predictions_b").select("job_index", F.lit(1).alias("seq"), "p_label"))
    last = every.groupBy("job_index").agg(F.max_by(F.struct("p_label"), "seq").alias("p")).select(F.col("job_index").alias("line_no"), F.col("p.p_label").alias("predicted"))
    return lab(spark, d).select("line_no", "label").join(last, "line_no", "left")


@query(P2 + "select a.job_index from predictions a join predictions_b b using (job_index) where a.p_label is null and b.p_label is not null")
def excluded_by_one_model(spark, d):
    """Rows that one model's output excludes and another's doesn't."""
    valid = table(spark, d, "predictions_b").where("p_label is not null").select("job_index")
    return preds(spark, d).where("p_label is null").select("job_index").join(valid, "job_index", "left_semi")


@query(P2 + "select count(*) n, round(100.0 * count(*) filter (a.p_label = b.p_label) / count(*), 1) agree, count(*) filter (a.p_loc <> b.p_loc) loc_changed, count(*) filter (a.p_label = a.g_label and b.p_label <> b.g_label) lost, count(*) filter (a.p_label <> a.g_label and b.p_label = b.g_label) won from predictions a join predictions_b b using (job_index) where a.p_label is not null and b.p_label is not null")
def two_model_comparison(spark, d):
    side = lambda t, k: table(spark, d, t).where("p_label is not null").select("job_index", *[F.col(c).alias(f"{c}_{k}") for c in ("p_label", "g_label", "p_loc")])
    j = side("predictions", "a").join(side("predictions_b", "b"), "job_index")
    n = F.count("*")
    right = lambda k: F.col(f"p_label_{k}") == F.col(f"g_label_{k}")
    return j.agg(n.alias("n"), V.percent(F.count_if(F.expr("p_label_a = p_label_b")), n).alias("agree"), F.count_if(F.expr("p_loc_a <> p_loc_b")).alias("loc_changed"), F.count_if(right("a") & ~right("b")).alias("lost"), F.count_if(~right("a") & right("b")).alias("won"))


@query(L + f", v as (select doc_id, l.label was, {fx.label_sql('s')} now, l.score - s off from labelled l join (select doc_id, greatest(0, least(100, {fx._map('loc', T.V5.loc)} + {fx._map('role', T.V5.sen)} + {fx._map('tech', T.V5.tech)} + {fx._map('comp', T.V5.comp)})) s from ({TX.V5_SQL}) q) z using (doc_id)) select was, now, count(*) n, round(avg(off), 4) mean_off from v group by 1, 2")
def schema_version_changes(spark, d):
    """How labels and scores change between the two schema versions."""
    c = F.col
    v = T.to_v5(c("loc"), c("sen"), F.split("tech", ","), c("comp"))
    s = T.scores_flat(v["loc"], v["role"], v["tech"], v["comp"])
    return lab(spark, d).select(c("label").alias("was"), s["label"].alias("now"), (c("score") - s["score"]).alias("off")).groupBy("was", "now").agg(F.count("*").alias("n"), F.round(F.avg("off"), 4).alias("mean_off"))


@query(P + f", g as (select doc_id, q.* exclude doc_id from ({TX.V5_SQL.replace('labelled', '(select doc_id, g_loc loc, g_sen sen, g_tech tech, g_comp comp from predictions where p_label is not null) z')}) q), p as (select * from ({TX.V5_SQL.replace('labelled', '(select doc_id, p_loc loc, p_sen sen, p_tech tech, p_comp comp from predictions where p_label is not null) z')}) q) " + " union all ".join(f"select '{f}' field, count(*) filter (g.{f} = p.{f}) correct, count(*) n from g join p using (doc_id)" for f in ("loc", "role", "tech", "comp")))
def v5_prediction_scoring(spark, d):
    """Predictions against gold in the flat vocabulary of four scalar tokens."""
    rows = preds(spark, d).where("p_label is not null")
    side = lambda k: T.to_v5(F.col(f"{k}_loc"), F.col(f"{k}_sen"), F.split(f"{k}_tech", ","), F.col(f"{k}_comp"))
    g, p = side("g"), side("p")
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (g[f] == p[f]).alias("ok")) for f in g])).alias("x")).select("x.*")
    return long.groupBy("field").agg(F.count_if("ok").alias("correct"), F.count("*").alias("n"))


@query(L + "select label, count(*) n, round(avg(score), 4) mean, min(score) lo, max(score) hi from labelled group by 1")
def label_means(spark, d):
    return lab(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"), F.min("score").alias("lo"), F.max("score").alias("hi"))


_SHARES = " union all ".join(f"select '{f}' field, {f} token, count(*) n from labelled group by 2" for f in ("loc", "arr", "sen", "tech", "comp"))


@query(L + f"""select 'distribution_imbalance' "check", field || '=' || token subject, round(100.0 * n / (select count(*) from labelled), 1) pct from ({_SHARES}) x where n > 0.5 * (select count(*) from labelled)
  union all select 'source_weight_cap', source_file, round(100.0 * count(*) / (select count(*) from labelled), 1) from labelled group by 2 having count(*) > 0.05 * (select count(*) from labelled)
  union all select 'boundary_starvation', 'score 50-74', pct from (select round(100.0 * count(*) filter (score between 50 and 74) / count(*), 1) pct, count(*) filter (score between 50 and 74) < 0.15 * count(*) low from labelled) y where low""")
def distribution_warnings(spark, d):
    """Tokens above half of all rows, sources above their cap and a starved boundary, as rows of one issue table."""
    return A.distribution_issues(lab(spark, d))


@query(P + "select total, scorable, passed, round(100.0 * passed / total, 1) pct_total, round(100.0 * passed / scorable, 1) pct_scorable from (select count(*) total, count(p_label) scorable, count(*) filter (p_label = g_label) passed from predictions) x")
def pass_rates(spark, d):
    """Of all outputs, and of those that could be scored."""
    a = preds(spark, d).agg(F.count("*").alias("total"), F.count("p_label").alias("scorable"), F.count_if(F.expr("p_label = g_label")).alias("passed"))
    return a.select("*", V.percent(F.col("passed"), F.col("total")).alias("pct_total"), V.percent(F.col("passed"), F.col("scorable")).alias("pct_scorable"))


@query(P + " union all ".join(f"select job_index, '{f}' field, {TX_OK} pass, g_{f} expected, p_{f} got from predictions where p_label is not null" for f, TX_OK in [(f, "list_sort(string_split(p_tech, ',')) = list_sort(string_split(g_tech, ','))" if f == "tech" else f"p_{f} = g_{f}") for f in V.FIELDS]))
def component_results(spark, d):
    """An assertion's verdict as a struct with a result for each field, exploded."""
    m = V.matches(preds(spark, d)).where("p_label is not null")
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"ok_{f}").alias("pass"), F.col(f"g_{f}").alias("expected"), F.col(f"p_{f}").alias("got")) for f in V.FIELDS])
    verdict = F.struct(F.col("ok_label").alias("pass"), parts.alias("components"))
    return m.select("job_index", F.explode(verdict["components"]).alias("c")).select("job_index", "c.*")


@query(RN + ", m as (select model, round(100.0 * sum(ok) / sum(n), 1) acc, sum(n)::double / 1000 size, sum(n - ok)::bigint fails from runs group by 1), w as (select 'accuracy' category, arg_max(model, (acc, model)) winner, max(acc) val from m union all select 'efficiency', arg_max(model, (acc / greatest(size, 0.01), model)), round(max(acc / greatest(size, 0.01)), 4) from m union all select 'most_failures', arg_max(model, (fails, model)), max(fails)::double from m where fails > 0) select * from w")
def category_winners(spark, d):
    """The best by accuracy, by accuracy for its size, and the one with the most failures."""
    m = table(spark, d, "runs").groupBy("model").agg(F.round(100.0 * F.sum("ok") / F.sum("n"), 1).alias("acc"), (F.sum("n").cast("double") / 1000).alias("size"), F.sum(F.col("n") - F.col("ok")).alias("fails"))
    m = m.withColumn("eff", F.col("acc") / F.greatest(F.col("size"), F.lit(0.01)))
    top = lambda name, c, rows: rows.agg(F.max(F.struct(F.col(c).alias("v"), "model")).alias("x")).select(F.lit(name).alias("category"), F.col("x.model").alias("winner"), F.round(F.col("x.v").cast("double"), 4).alias("val"))
    return top("accuracy", "acc", m).unionByName(top("efficiency", "eff", m)).unionByName(top("most_failures", "fails", m.where("fails > 0")))


@query(RN + ", m as (select model, round(100.0 * sum(ok) / sum(n), 3) acc, sum(abs_err) / sum(n) <= 25 fine from runs group by 1) select model, acc, fine, row_number() over (order by fine desc, acc desc, model) place from m")
def leaderboard_errors_last(spark, d):
    """Models that pass the gate by accuracy, then those that don't."""
    m = table(spark, d, "runs").groupBy("model").agg(F.round(100.0 * F.sum("ok") / F.sum("n"), 3).alias("acc"), (F.sum("abs_err") / F.sum("n") <= 25).alias("fine"))
    return m.withColumn("place", F.row_number().over(Window.orderBy(F.desc("fine"), F.desc("acc"), "model")).cast("long"))


SLOW = f"select job_index, g_label grp, case when p_label is null then null else p_label = g_label end ok, p_label, 1.0 + {fx.u(61, 9)} secs from predictions"


@query(P + f"""select grp, min(job_index) "at", arg_min(rule, job_index) rule from (select *, case when seen = 0 and rs >= 2 then 'all_failed' when rs >= 2 and mean >= 2 * 2.6 then 'slow' when streak >= 25 then 'streak' when seen >= 5 and labels = 1 then 'one_label' end rule from (
  select *, sum(case when not ok then 1 else 0 end) over (partition by grp, hits order by job_index) streak from (select *, count(ok) over w seen, sum(case when ok then 1 else 0 end) over w hits, count(*) over w rs, avg(secs) over w mean, count(distinct p_label) over w labels from ({SLOW}) o window w as (partition by grp order by job_index)) a) b) c where rule is not null group by 1""")
def early_exit_rules(spark, d):
    """The first row at which a run would stop, by all four rules: nothing parsed, twice too slow, wrong in a row, one label."""
    rows = preds(spark, d).withColumn("grp", F.col("g_label")).withColumn("secs", F.expr(f"1.0 + {fx.u(61, 9)}"))
    return H.stops(rows, "grp", "job_index", F.col("p_label") == F.col("g_label"), "p_label", seconds="secs", limit=2.6)


@query("select event_type, event_id, round(done * 1.0 / total, 6) share, floor(elapsed::double / done * (total - done))::bigint eta from (select event_type, event_id, row_number() over w done, count(*) over (partition by event_type) total, sum(value::decimal(18, 6)) over w elapsed from events window w as (partition by event_type order by event_id)) x")
def run_eta(spark, d):
    """What is left at the mean pace so far."""
    w = Window.partitionBy("event_type").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, d, "events").select("event_type", "event_id", F.count("*").over(w).alias("done"), F.count("*").over(Window.partitionBy("event_type")).alias("total"), F.sum(F.col("value").cast("decimal(18,6)")).over(w).cast("double").alias("elapsed"))
    return e.select("event_type", "event_id", F.round(F.col("done") / F.col("total"), 6).alias("share"), F.floor(F.col("elapsed") / F.col("done") * (F.col("total") - F.col("done"))).alias("eta"))


SYN = "(lower(title) like '%node%' or source_file in ('src3', 'src4') or job_id like 'doc_1%' or contains(jd_text, 'CodeSynthetic') or dent = 3)"
KEY = "lower(title) || '|' || lower(job_location)"


@query(J + f", h as (select distinct {KEY} k from jobs where {fx.u(71, 40)} = 0), o as (select *, row_number() over (partition by md5(body) order by doc_id) rn from jobs) select coalesce(case when {SYN} then 'synthetic' when rn > 1 then 'duplicate' when {KEY} in (select k from h) then 'contaminated' end, 'kept') reason, count(*) n from o group by 1")
def filter_reasons(spark, d):
    """Why a row goes: made up (by flag, source, prefix or substring), a duplicate, or held out by its content key; in this order."""
    from siftwork.operators.dedup import contaminated, first_seen

    c = F.col
    rows = table(spark, d, "jobs")
    made = c("dent").eqNullSafe(3) | c("source_file").isin("src3", "src4") | c("job_id").startswith("doc_1") | c("jd_text").contains("CodeSynthetic") | F.lower("title").contains("node")
    content = F.concat_ws("|", F.lower("title"), F.lower("job_location"))
    held = rows.where(F.expr(fx.u(71, 40)) == 0)
    flagged = contaminated(rows, held, {"contaminated": (content, content)})
    again = first_seen(rows, F.md5("body"), "doc_id").select("doc_id", F.lit(True).alias("again"))
    why = F.when(made, "synthetic").when(c("again"), "duplicate").when(c("contaminated"), "contaminated").otherwise("kept")
    return flagged.join(again, "doc_id", "left").groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


@query("select v.name, e.event_type is not null known from (values ('click'), ('error'), ('refund')) v(name) left join (select distinct event_type from events) e on e.event_type = v.name")
def only_list_check(spark, d):
    """Names asked for, and whether there are such; unknown ones are to be warned of."""
    asked = spark.createDataFrame([("click",), ("error",), ("refund",)], "name string")
    known = table(spark, d, "events").select(F.col("event_type").alias("name")).distinct().withColumn("hit", F.lit(True))
    return asked.join(known, "name", "left").select("name", F.col("hit").isNotNull().alias("known"))


OLD_NEW = f"select doc_id, score, label, {fx.score_sql('loc', 'sen', 'tech', chr(39) + 'NO_GBP' + chr(39))} s2 from labelled"


@query(L + f"select doc_id, case when score <> s2 then 'score:' || score || '->' || s2 else '' end || case when label <> {fx.label_sql('s2')} then ',label:' || label || '->' || {fx.label_sql('s2')} else '' end diff from ({OLD_NEW}) x where score <> s2")
def rescored_without_pay(spark, d):
    """Rows whose score changes when pay counts for nothing, with the list of differences."""
    c = F.col
    s = T.scores(c("loc"), c("sen"), F.split("tech", ","), F.lit("NO_GBP"))
    r = lab(spark, d).select("doc_id", "score", "label", s["score"].alias("s2"), s["label"].alias("l2")).where("score <> s2")
    step = lambda name, a, b: F.when(c(a) != c(b), F.concat(F.lit(f"{name}:"), c(a).cast("string"), F.lit("->"), c(b).cast("string")))
    return r.select("doc_id", F.array_join(F.array_compact(F.array(step("score", "score", "s2"), step("label", "label", "l2"))), ",").alias("diff"))


_HINT = "case x_arr when 'UNK' then '' else 'HINT: work is ' || lower(x_arr) || chr(10) || chr(10) end"


@query(J + f"select doc_id, {_HINT} || trim(body) prompt from jobs")
def hinted_prompts(spark, d):
    """A hint of what the rules found, before the cleaned text."""
    arr = R.arrangement(F.col("jd_text"))
    hint = F.when(arr == "UNK", "").otherwise(F.concat(F.lit("HINT: work is "), F.lower(arr), F.lit("\n\n")))
    return table(spark, d, "jobs").select("doc_id", F.concat(hint, F.trim("body")).alias("prompt"))


RAW = {
    "good": """'{"loc":"' || loc || '","arr":"' || arr || '","sen":"' || sen || '","tech":["' || replace(tech, ',', '","') || '"],"comp":"' || comp || '"}'""",
    "quoted": """'<think>so</think>```json' || chr(10) || '{loc:"' || loc || '",arr:"' || arr || '",sen:"' || sen || '",tech:["' || replace(tech, ',', '","') || '"],comp:"' || comp || '"}```'""",
    "typo": """'{"loc":"' || loc || 'X","arr":"' || arr || '","sen":"' || sen || '","tech":["' || replace(tech, ',', '","') || '"],"comp":"' || comp || '"}'""",
    "broken": """'loc is "loc": "' || loc || '" and "arr": "' || arr || '" and "sen": "' || sen || '" with "tech": ["' || replace(tech, ',', '","') || '"] and "comp": "' || comp || '" then'""",
    "wrong": """'{"loc":"NOWHERE_AT_ALL","arr":"' || arr || '","sen":"' || sen || '","tech":["' || replace(tech, ',', '","') || '"],"comp":"' || comp || '"}'""",
    "noise": "'I cannot tell from this advert'",
}
_RAW = f"case {fx.u(81, 6)} " + " ".join(f"when {i} then {v}" for i, v in enumerate(RAW.values())) + " end"


@query(L + f"select doc_id, case {fx.u(81, 6)} when 4 then 'invalid_token' when 5 then 'parse_fail' else 'ok' end status, case when {fx.u(81, 6)} < 4 then loc end loc, case when {fx.u(81, 6)} < 4 then label end label from labelled")
def output_cascade(spark, d):
    """Raw outputs through the whole cascade: parsed, else salvaged; validated, else salvaged; scored. Status and tokens."""
    got = repair.cascade(lab(spark, d).select("doc_id", F.expr(_RAW).alias("raw")), "raw")
    s = T.scores(F.col("loc"), F.col("sen"), F.col("tech"), F.col("comp"))
    return got.select("doc_id", "status", "loc", F.when(F.col("status") == "ok", s["label"]).alias("label"))


@query(J + "select doc_id, title, case when x_tech = 'NODE,JS_TS' then 3 else 0 end + length(title) % 5 mine, length(title) theirs from jobs")
def plugged_scorers(spark, d):
    """Scores by functions that are plugged in."""
    mine = lambda c: F.when(c["x_tech"] == "NODE,JS_TS", 3).otherwise(0) + F.length(c["title"]) % 5
    return B.scored_by(table(spark, d, "jobs"), {"mine": mine, "theirs": lambda c: F.length(c["title"])}).select("doc_id", "title", "mine", "theirs")


@query(J + "select doc_id, substr(t, greatest(1, p - 40)::int, (p - greatest(1, p - 40) + 66)::int) ctx from (select doc_id, lower(jd_text) t, position('remote' in lower(jd_text)) p from jobs) x where p > 0")
def first_keyword_context(spark, d):
    """The first place of a keyword with 40 characters before and 60 after it."""
    t = F.lower("jd_text")
    rows = table(spark, d, "jobs").where(t.contains("remote"))
    return rows.select("doc_id", F.try_element_at(X.contexts_between(t, "remote", 40, 60, 2), F.lit(1)).alias("ctx"))


_W = "with w as (select doc_id, regexp_split_to_array(text, '[\\s\\x{0b}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+') ws from documents)"


@query(_W + ", u as (select doc_id, len(ws) n, unnest(range(0, len(ws))) i, unnest(ws) x from w), pay as (select doc_id, i from u where regexp_matches(x, '(?i)[£$€]|salary|compensation|pay|per annum|p\\.a\\.')), free as (select u.doc_id, u.i from u where u.i >= 300 and u.i < u.n - 200 and not exists (select 1 from pay where pay.doc_id = u.doc_id and u.i >= pay.i - 50 and u.i < pay.i + 50)), runs as (select doc_id, i - row_number() over (partition by doc_id order by i) g from free), best as (select doc_id, max(c) n from (select doc_id, g, count(*) c from runs group by 1, 2) r group by 1) select w.doc_id, len(ws)::int n_words, coalesce(best.n, 0)::int gap from w left join best using (doc_id)")
def longest_unprotected_run(spark, d):
    """The longest run of words that is neither head nor tail nor near a word about pay."""
    out = table(spark, d, "documents").select("doc_id", X.let(F.split("text", f"{X.BLANK}+"), lambda w: F.struct(F.size(w).alias("n_words"), E.longest_gap(w)["n"].alias("gap"))).alias("x"))
    return out.select("doc_id", "x.n_words", "x.gap")
