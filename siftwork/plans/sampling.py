"""Queries of samples, splits, builders and augmentation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftwork.functions import rules as R
from siftwork.functions import text as X
from siftwork.functions import tokens as T
from siftwork.operators import augment as G
from siftwork.operators import sampling as S
from siftwork.plans import fixtures as fx
from siftwork.plans.catalog import query
from siftwork.plans.fixtures import ctes, table

L = ctes("labelled")
ORDER = ["good_fit", "maybe", "bad_fit"]
SHUF = "md5('42|' || doc_id)"


def lab(spark, d):
    return table(spark, d, "labelled")


def _alloc_sql(equal: bool) -> str:
    """The allocation as a recursive query: start from shares, then move one at a time to the total."""
    ranks = "case label when 'good_fit' then 1 when 'maybe' then 2 else 3 end"
    if equal:
        return f"alloc as (select label, least(n, 100 // 3 + case when k <= 100 % 3 then 1 else 0 end) a from (select label, count(*) n, {ranks} k from labelled group by 1) x)"
    return f"""base as (select label, count(*) n, {ranks} k, least(count(*), greatest(1, floor(count(*)::double / (select count(*) from labelled) * 100 + 0.5)))::bigint a from labelled group by 1),
  off as (select sum(a)::bigint - 100 o from base), alloc as (select label, a - case when o > 0 and k = (select arg_max(k, a * 10 + k) from base) then o when o < 0 and k = (select arg_max(k, (n - a) * 10 + k) from base) then o else 0 end a from base, off)"""


def _take_sql() -> str:
    return f"select doc_id, l.label from (select *, row_number() over (partition by label order by {SHUF}) rn from labelled) l join alloc using (label) where rn <= a"


@query(L + ", " + _alloc_sql(False) + " " + _take_sql())
def stratified_sample(spark, d):
    return S.stratified(lab(spark, d), "label", ORDER, 100, 42, "doc_id").select("doc_id", "label")


@query(L + ", " + _alloc_sql(True) + " " + _take_sql())
def balanced_sample(spark, d):
    return S.stratified(lab(spark, d), "label", ORDER, 100, 42, "doc_id", equal=True).select("doc_id", "label")


@query(L + f"select doc_id from labelled order by {SHUF} limit 50")
def random_sample(spark, d):
    return lab(spark, d).orderBy(S.shuffled(42, "doc_id")).limit(50).select("doc_id")


RN = f"select *, row_number() over (partition by {{by}} order by {SHUF}) rn, count(*) over (partition by {{by}}) n from labelled"


@query(L + f"select doc_id, case when rn <= greatest(1, floor(n * 0.1 + 0.5)) then 'valid' else 'train' end part from ({RN.format(by='label')}) x")
def split_valid_pct(spark, d):
    return S.split(lab(spark, d), ["label"], 0.1, 42, "doc_id").select("doc_id", "part")


@query(L + f"select doc_id, case when n < 3 or rn <= floor(n * 0.6) then 'train' when rn <= floor(n * 0.6) + floor(n * 0.2) then 'valid' else 'test' end part from ({RN.format(by='loc, tech')}) x")
def split_60_20_20(spark, d):
    return S.split_three(lab(spark, d), ["loc", "tech"], 42, "doc_id").select("doc_id", "part")


@query(L + f"select doc_id, case when rn <= greatest(1, floor(n * 0.1)) then 'valid' else 'train' end part from (select *, row_number() over (order by {SHUF}) rn, count(*) over () n from labelled) x")
def split_global(spark, d):
    """The cut is one value of the shuffle's order, found by a top-k; rows compare with it where they are."""
    rows = lab(spark, d).withColumn("k", S.shuffled(42, "doc_id"))
    n = max(1, int(rows.count() * 0.1))
    cut = rows.orderBy("k").limit(n).agg(F.max("k").alias("cut"))
    return rows.crossJoin(F.broadcast(cut)).select("doc_id", F.when(F.col("k") <= F.col("cut"), "valid").otherwise("train").alias("part"))


@query(L + f", t as (select doc_id from labelled where {fx.u(20, 10)} = 0) select doc_id from labelled where doc_id not in (select doc_id from t)")
def split_complement(spark, d):
    rows = lab(spark, d)
    return rows.join(rows.where(F.expr(fx.u(20, 10)) == 0).select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query(L + f", v as (select label, count(*) n, floor(count(*) * 100.0 / (select count(*) from labelled) + 0.5) q from labelled group by 1) select doc_id, case when {fx.u(33, 4)} <> 0 and rn <= q then 'valid' else 'train' end part from (select *, row_number() over (partition by label, {fx.u(33, 4)} = 0 order by {SHUF}) rn from labelled) x join v using (label)")
def split_real_valid(spark, d):
    """The valid part has real rows only; made-up ones go to train."""
    synthetic = F.expr(fx.u(33, 4)) == 0
    rows = lab(spark, d).withColumn("syn", synthetic)
    size = rows.groupBy("label").agg(F.count("*").alias("n"))
    total = size.agg(F.sum("n").alias("total"))
    quota = size.crossJoin(F.broadcast(total)).select("label", F.floor(F.col("n") * 100.0 / F.col("total") + 0.5).alias("q"))
    r = S.hash_ranked(rows, ["label", "syn"], S.shuffled(42, "doc_id")).join(quota, "label")
    return r.select("doc_id", F.when(~F.col("syn") & (F.col("rn") <= F.col("q")), "valid").otherwise("train").alias("part"))


@query(L + f", r as (select *, row_number() over (partition by label order by {SHUF}) rn, count(*) over (partition by label) n from labelled) select doc_id, label, unnest(range(0, greatest(0, floor((700 - rn) / n))::bigint + 1)) copy from r")
def oversample_round_robin(spark, d):
    return S.oversampled(lab(spark, d), "label", 700, S.shuffled(42, "doc_id")).select("doc_id", "label", F.col("copy").cast("long").alias("copy"))


FNV = "list_reduce(list_prepend(2166136261::bigint, list_transform(string_split('7|' || job_id, ''), lambda x: ascii(x)::bigint)), lambda h, x: ((xor(h, x)::hugeint * 16777619) % 4294967296)::bigint)"
PRIO = "(case when score >= 30 then 4 else 0 end + case when score >= 40 then 2 else 0 end + case comp when 'RANGE_55_74K' then 3 when 'RANGE_75_99K' then 1 else 0 end + case when tech <> 'OOS' then 2 else 0 end + case when tech like '%AI_ML%' then 2 else 0 end + case when loc = 'IN_LONDON' then 1 else 0 end + case when arr in ('HYBRID', 'REMOTE') then 1 else 0 end)"


def priority():
    c = F.col
    return R.bad_priority(c("score"), c("comp"), F.split("tech", ","), c("loc"), c("arr"))


@query(L + f"select doc_id, source_file, prio from (select *, row_number() over (partition by source_file order by prio desc, fnv, doc_id) rn from (select *, {PRIO} prio, {FNV} fnv from labelled where label = 'bad_fit') x) y where rn <= case source_file when 'src0' then 5 when 'src1' then 8 else 12 end")
def rank_fnv_cap(spark, d):
    bad = lab(spark, d).where("label = 'bad_fit'").withColumn("prio", priority()).withColumn("fnv", X.fnv1a(F.concat(F.lit("7|"), "job_id")))
    return S.capped(bad, "source_file", {"src0": 5, "src1": 8}, 12, F.desc("prio"), F.asc("fnv"), F.asc("doc_id")).select("doc_id", "source_file", "prio")


@query(L + f"select doc_id, label from (select *, row_number() over (partition by label order by k) rn from (select *, row_number() over (partition by label, company order by k) one from (select doc_id, label, company, {SHUF} k from labelled) a) b where one = 1) c where rn <= 10")
def eval_select_company(spark, d):
    rows = lab(spark, d).withColumn("k", S.shuffled(42, "doc_id"))
    one = S.ranked(rows, ["label", "company"], F.col("k")).where("rn = 1").drop("rn")
    return S.ranked(one, ["label"], F.col("k")).where("rn <= 10").select("doc_id", "label")


@query(L + "select case when rn = 1 then base else base || '__v10_' || rn end id, doc_id from (select doc_id, base, row_number() over (partition by base order by doc_id) rn from (select doc_id, 'j' || doc_id % 300 base from labelled) x) y")
def unique_ids(spark, d):
    rows = lab(spark, d).select("doc_id", F.concat(F.lit("j"), (F.col("doc_id") % 300).cast("string")).alias("base"))
    r = S.ranked(rows, ["base"], F.col("doc_id"))
    return r.select(F.when(F.col("rn") == 1, F.col("base")).otherwise(F.concat("base", F.lit("__v10_"), F.col("rn").cast("string"))).alias("id"), "doc_id")


@query(L + "select doc_id from labelled where floor((line_no - 1) / ceil((select count(*) from labelled) / 7.0)) = 2")
def chunk_of_rows(spark, d):
    rows = lab(spark, d)
    size = -(-rows.count() // 7)
    return rows.where(F.floor((F.col("line_no") - 1) / size) == 2).select("doc_id")


@query(ctes("predictions") + "select job_index from predictions where p_label is not null and (p_label = g_label or (p_label <> 'bad_fit' and g_label <> 'bad_fit' and abs(p_score - g_score) <= 15))")
def teacher_filter(spark, d):
    c = F.col
    ok = (c("p_label") == c("g_label")) | ((c("p_label") != "bad_fit") & (c("g_label") != "bad_fit") & (F.abs(c("p_score") - c("g_score")) <= 15))
    return table(spark, d, "predictions").where(c("p_label").isNotNull() & ok).select("job_index")


@query(L + "select doc_id, case when jd_text like '%$120,000%' and jd_text not like '%£%' then 'NO_GBP' else comp end comp from labelled where not (jd_text like '%$120,000%' and jd_text not like '%£%' and loc = 'IN_LONDON')")
def currency_rule(spark, d):
    foreign = F.rlike("jd_text", F.lit(r"(?i)\busd\b|\beur\b|\$1|€")) & ~F.rlike("jd_text", F.lit(r"(?i)£|\bgbp\b"))
    return lab(spark, d).where(~(foreign & (F.col("loc") == "IN_LONDON"))).select("doc_id", F.when(foreign, "NO_GBP").otherwise(F.col("comp")).alias("comp"))


GOAL = {"good_fit": 60, "maybe": 90, "bad_fit": 150}
GOAL_SQL = "case label when 'good_fit' then 60 when 'maybe' then 90 else 150 end"


@query(L + f", one as (select * from (select *, row_number() over (partition by lower(title), lower(company), job_location order by doc_id) d from labelled) x where d = 1), capped as (select * from (select *, row_number() over (partition by label, source_file order by {PRIO} desc, {SHUF}) s from one) x where s <= 40), r as (select *, row_number() over (partition by label order by {PRIO} desc, {SHUF}) rn, count(*) over (partition by label) n from capped), top as (select * from r where rn <= {GOAL_SQL}) select job_id || case when copy = 0 then '' else '_dup_' || copy end job_id, label from (select *, unnest(range(0, greatest(0, floor(({GOAL_SQL} - rn) / least(n, {GOAL_SQL})))::bigint + 1)) copy from top) y")
def v10_build(spark, d):
    """Dedup by content, cap each source within a label, rank by priority, trim to the label's target, oversample to it."""
    from siftwork.operators.dedup import keep_first

    c = F.col
    rows = lab(spark, d)
    one = keep_first(rows, F.concat_ws("|", F.lower("title"), F.lower("company"), "job_location"), "doc_id").withColumn("prio", priority()).withColumn("k", S.shuffled(42, "doc_id"))
    capped = S.ranked(one, ["label", "source_file"], F.desc("prio"), c("k")).where("rn <= 40").drop("rn")
    goal = F.try_element_at(F.create_map(*[F.lit(x) for kv in GOAL.items() for x in kv]), c("label"))
    r = S.ranked(capped, ["label"], F.desc("prio"), c("k")).withColumn("n", F.count("*").over(Window.partitionBy("label"))).withColumn("goal", goal).where("rn <= goal")
    copies = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((c("goal") - c("rn")) / F.least("n", "goal"))).cast("int"))
    out = r.select("job_id", "label", F.explode(copies).alias("copy"))
    return out.select(F.when(c("copy") == 0, c("job_id")).otherwise(F.concat("job_id", F.lit("_dup_"), c("copy").cast("string"))).alias("job_id"), "label")


@query(L + f", x as (select *, {fx.score_sql('loc', 'sen', 'tech', 'nc')} ns from (select *, case when jd_text like '%£500 per day%' and comp <> 'NO_GBP' then 'NO_GBP' else comp end nc from labelled) y) select doc_id, nc comp, ns score, {fx.label_sql('ns')} label, nc <> comp corrected from x")
def v12_corrections(spark, d):
    c = F.col
    daily = F.rlike("jd_text", F.lit("£500 per day")) & (c("comp") != "NO_GBP")
    rows = lab(spark, d).withColumn("nc", F.when(daily, "NO_GBP").otherwise(c("comp")))
    s = T.scores(c("loc"), c("sen"), F.split("tech", ","), c("nc"))
    return rows.select("doc_id", c("nc").alias("comp"), s["score"].alias("score"), s["label"].alias("label"), (c("nc") != c("comp")).alias("corrected"))


GAPS = ["loc", "arr", "sen", "comp"]


def gap_quota(counts: dict[tuple, int], goals: dict[tuple[str, str], int], total: int) -> dict[tuple, int]:
    """How many rows of each token combination (GAPS) the greedy takes: the best gain first, ties by combination, until total
    rows are taken or the best gain is -50 or less."""
    left = dict(sorted(counts.items()))
    have: dict[tuple[str, str], int] = {}
    quota: dict[tuple, int] = {}

    def gain(combo: tuple) -> float:
        score, hard = 0.0, 0
        for f, t in zip(GAPS, combo, strict=True):
            gap = goals.get((f, t), 0) - have.get((f, t), 0)
            if f in ("loc", "comp"):
                score += gap * (1 + gap / max(goals.get((f, t), 0), 1)) if gap > 0 else -(30 + 3 * abs(gap))
                hard += gap <= 0
            else:
                score += 0.5 * gap if gap > 0 else -5
        return score - 150 * (hard >= 3)

    while left and sum(quota.values()) < total:
        best = max(left, key=gain)
        if gain(best) <= -50:
            break
        quota[best] = quota.get(best, 0) + 1
        left[best] -= 1
        if not left[best]:
            del left[best]
        for f, t in zip(GAPS, best, strict=True):
            have[f, t] = have.get((f, t), 0) + 1
    return quota


@query()
def gap_greedy_select(spark, d, total_target=1200):
    """Rows that fill gaps to the full target marginals best, total_target at most as in the reference. Token combinations,
    a bounded table, are chosen greedily on the driver with how many rows to take of each; rows take part through a rank
    within their combination."""
    goals = {(r.field, r.token): r.target for r in table(spark, d, "targets").collect()}
    rows = lab(spark, d)
    quota = gap_quota({tuple(r[f] for f in GAPS): r["n"] for r in rows.groupBy(*GAPS).agg(F.count("*").alias("n")).collect()}, goals, total_target)
    if not quota:
        return rows.limit(0).select("doc_id", *GAPS)
    plan = spark.createDataFrame([(*k, v) for k, v in quota.items()], "loc string, arr string, sen string, comp string, quota int")
    r = S.hash_ranked(rows, GAPS, S.shuffled(42, "doc_id"))
    return r.join(F.broadcast(plan), GAPS).where("rn <= quota").select("doc_id", *GAPS)


#: V11's caps as shares of the total.
CAPS = {
    "loc": {"OUTSIDE_UK": 0.2, "UNK": 0.08},
    "comp": {"NO_GBP": 0.15, "BELOW_45K": 0.18, "RANGE_55_74K": 0.35, "RANGE_75_99K": 0.35, "ABOVE_100K": 0.18},
}


@query()
def v11_build(spark, d):
    """Targets of 30 / 30 / 40 per cent by label with deficits handed on, then one pass in shuffled order that takes a row
    if its label, location and pay all have room; only rows taken use room."""
    rows = lab(spark, d)
    sizes = S.sizes_of(rows, "label", ORDER)
    total = sum(sizes.values()) // 2
    goal = {k: min(sizes[k], int(total * p)) for k, p in (("good_fit", 0.3), ("maybe", 0.3), ("bad_fit", 0.4))}
    cycle = ["maybe", "bad_fit", "good_fit"]
    short, i = total - sum(goal.values()), 0
    while short > 0 and any(goal[k] < sizes[k] for k in cycle):
        k = cycle[i % 3]
        if goal[k] < sizes[k]:
            goal[k] += 1
            short -= 1
        i += 1
    room = {"label": goal} | {f: {t: int(total * share) for t, share in of.items()} for f, of in CAPS.items()}
    return S.coupled(rows.where(F.col("label").isin(ORDER)), room, S.shuffled(42, "doc_id")).select("doc_id", "label")


J = ctes("jobs")


@query(J + "select job_id || '_sal_' || k job_id, job_id source_job_id, comp, case when h = 0 then said || chr(10) || jd_text else jd_text || chr(10) || said end jd_text, 'salary' kind from (select *, ('0x' || substr(md5(job_id || '|' || k), 1, 8))::bigint % 2 h from jobs cross join (values " + ", ".join(f"({i}, '{t}', 'Salary: £{a},000 - £{b},000 per annum.')" for i, (t, a, b) in enumerate(G.TIERS)) + ") t(k, comp, said)) x")
def augment_salary(spark, d):
    return G.salaries(table(spark, d, "jobs"))


@query(J + """select job_id || '_con_' || kind job_id, job_id source_job_id, kind, title, job_location, jd_text from (select job_id, 'loc' kind, title, case job_location when 'London, UK' then 'Manchester, England' when 'Manchester, England' then 'London, UK' when 'Remote' then 'Austin, TX' end job_location, jd_text from jobs where job_location in ('London, UK', 'Manchester, England', 'Remote')
  union all select job_id, 'title', regexp_replace(title, '^(Senior |Staff |Lead |Principal |Sr\\. )', ''), job_location, jd_text from jobs where regexp_matches(title, '^(Senior |Staff |Lead |Principal |Sr\\. )') union all select job_id, 'tech', title, job_location, replace(jd_text, 'Node.js', 'Java') from jobs where contains(jd_text, 'Node.js')) x""".replace("\\\\.", "\\."))
def contrastive_pairs(spark, d):
    return G.contrastive(table(spark, d, "jobs"))


@query(J + "select job_id || '_locvar_' || k job_id, job_id source_job_id, f job_location from jobs join (values " + ", ".join(f"('{k}', {i}, '{v}')" for k, vs in G.FORMS.items() for i, v in enumerate(vs)) + ") t(l, k, f) on job_location = l")
def location_variants(spark, d):
    return G.locations(table(spark, d, "jobs"))


@query(J + "select job_id || '_trunc' || pct job_id, job_id source_job_id, substr(jd_text, 1, (length(jd_text) * pct) // 100) || ' [truncated]' jd_text from jobs cross join (values (50), (25)) t(pct)")
def truncation_variants(spark, d):
    return G.truncations(table(spark, d, "jobs"))


@query(ctes("labelled", "targets") + ", counts as (select 'loc' field, loc token, count(*) n from labelled group by 2 union all select 'arr', arr, count(*) from labelled group by 2 union all select 'sen', sen, count(*) from labelled group by 2 union all select 'comp', comp, count(*) from labelled group by 2), need as (select field, token, unnest(range(1, target - coalesce(n, 0) + 1)) k from targets left join counts using (field, token) where target > coalesce(n, 0)), r as (select *, row_number() over (partition by field order by md5(token || '|' || k)) rn from need) select printf('gen_%04d', rn - 1) recipe, max(token) filter (field = 'loc') loc, max(token) filter (field = 'arr') arr, max(token) filter (field = 'sen') sen, max(token) filter (field = 'comp') comp from r group by rn")
def recipes(spark, d):
    from siftwork.plans.curation import gap_report

    return G.recipes(gap_report(spark, d), ["loc", "arr", "sen", "comp"])


@query("select vec_id, label from (select *, row_number() over (partition by label order by md5('42|' || vec_id)) rn from embeddings) x where rn <= 5")
def sample_per_group(spark, d):
    return S.ranked(table(spark, d, "embeddings"), ["label"], S.shuffled(42, "vec_id")).where("rn <= 5").select("vec_id", "label")
