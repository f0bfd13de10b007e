"""Queries over texts: classifiers, keys, sentences, chunks, token algebra and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import extract as E
from siftwork.functions import repair
from siftwork.functions import rules as R
from siftwork.functions import text as X
from siftwork.functions import tokens as T
from siftwork.plans import fixtures as fx
from siftwork.plans.catalog import query
from siftwork.plans.fixtures import ctes, table

J = ctes("jobs")
LAB = ctes("labelled")


def jobs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "jobs")


def loc_case(c: str = "job_location") -> str:
    return f"case {c} " + " ".join(f"when '{a}' then '{b}'" for a, b in zip(fx.LOCATIONS, fx.PLACES, strict=True)) + " end"


def sen_case(c: str = "title") -> str:
    return f"case {c} " + " ".join(f"when '{a}' then '{b}'" for a, b in zip(fx.TITLES, fx.SENIORITIES, strict=True)) + " end"


# what the injected phrases mean; the title "Sr. Node Developer" adds NODE
TECH_SQL = """case when title <> 'Sr. Node Developer' then x_tech when x_tech = 'OOS' then 'NODE' when x_tech like 'NODE%' then x_tech else 'NODE,' || x_tech end"""
RULED = f"select doc_id, {loc_case()} loc, x_arr arr, {sen_case()} sen, {TECH_SQL} tech, x_comp comp from jobs"
SCORED = f"select *, {fx.score_sql('loc', 'sen', 'tech', 'comp')} score from ({RULED}) r"


def ruled(df: DataFrame) -> DataFrame:
    out = df.select("*", R.location(F.col("job_location")).alias("loc"), R.arrangement(F.col("jd_text")).alias("arr"), R.seniority(F.col("title")).alias("sen"), R.stack(F.col("jd_text"), F.col("title")).alias("tech"), R.compensation(F.col("jd_text"), F.col("title")).alias("comp"))
    s = T.scores(F.col("loc"), F.col("sen"), F.col("tech"), F.col("comp"))
    return out.select("*", *[v.alias(k) for k, v in s.items()])


@query(J + f"select {fx.label_sql('score')} label, count(*) n, sum(score)::bigint score_sum from ({SCORED}) s group by 1")
def regex_label_dist(spark, d):
    return ruled(jobs(spark, d)).groupBy("label").agg(F.count("*").alias("n"), F.sum("score").alias("score_sum"))


@query(J + f"select loc, count(*) n from ({RULED}) r group by 1")
def classify_loc(spark, d):
    return jobs(spark, d).groupBy(R.location(F.col("job_location")).alias("loc")).agg(F.count("*").alias("n"))


@query(J + "select doc_id, x_arr arr from jobs")
def classify_arr(spark, d):
    return jobs(spark, d).select("doc_id", R.arrangement(F.col("jd_text")).alias("arr"))


@query(J + f"select doc_id, {sen_case()} sen, case when title in ('Senior Software Engineer', 'Sr. Node Developer') then 'LEVEL_2' when {sen_case()} = 'LEVEL_3' then 'LEVEL_3' else 'LEVEL_1' end sen_v12 from jobs")
def classify_sen(spark, d):
    t = F.col("title")
    return jobs(spark, d).select("doc_id", R.seniority(t).alias("sen"), R.seniority(t, "LEVEL_2", "LEVEL_1").alias("sen_v12"))


@query(J + f"select doc_id, {TECH_SQL} tech from jobs")
def classify_tech_full(spark, d):
    return jobs(spark, d).select("doc_id", F.array_join(R.stack(F.col("jd_text"), F.col("title")), ",").alias("tech"))


@query(J + "select doc_id, x_comp comp from jobs")
def classify_comp(spark, d):
    return jobs(spark, d).select("doc_id", R.compensation(F.col("jd_text"), F.col("title")).alias("comp"))


@query(J + f"select doc_id, loc, arr, sen, tech, comp, score, {fx.label_sql('score')} label from ({SCORED}) s")
def classify_job(spark, d):
    return ruled(jobs(spark, d)).select("doc_id", "loc", "arr", "sen", F.array_join("tech", ",").alias("tech"), "comp", "score", "label")


@query(J + r"""select doc_id, case when job_location = '' then 'UNKNOWN' when lower(job_location) like '%london%' then 'IN_LONDON' when job_location in ('Remote', 'Anywhere', 'Paris, France (Remote)') then 'FULLY_REMOTE'
  when job_location in ('Manchester, England', 'Belfast, Northern Ireland') then 'UK_OTHER' when job_location = 'Austin, TX' then 'OUTSIDE_UK' else 'UNSURE' end loc,
  case title when 'Product Manager' then 'OUT_OF_SCOPE' when 'Staff Data Scientist' then 'OUT_OF_SCOPE' when 'Junior QA Engineer' then 'OUT_OF_SCOPE' when 'Senior Software Engineer' then 'IN_SCOPE' when 'Backend Developer' then 'IN_SCOPE' else 'UNSURE' end scope,
  case when title in ('Senior Software Engineer', 'Staff Data Scientist', 'Sr. Node Developer') then 'LEVEL_3' when title = 'Backend Developer' then 'LEVEL_2' when title = 'Junior QA Engineer' then 'LEVEL_1' else 'LEVEL_2' end sen,
  case when jd_text like '%Node.js and TypeScript.%' then 'NODE_JS_TS' when jd_text like '%React Native%' then 'JS_TS' when jd_text like '%NestJS%' then 'JS_TS_AI_ML' when jd_text like '%PyTorch%' or jd_text like '%We use AI%' then 'AI_ML' else 'NONE' end tech from jobs""")
def estimators(spark, d):
    return jobs(spark, d).select("doc_id", R.estimate_location(F.col("job_location")).alias("loc"), R.estimate_scope(F.col("title")).alias("scope"), R.estimate_seniority(F.col("title")).alias("sen"), R.estimate_stack(F.col("jd_text"), F.col("title")).alias("tech"))


@query(J + r"""select doc_id, case when jd_text not like '%£%' then 'NO_GBP' when jd_text like '%£500 per day%' or jd_text like '%£90k%' or jd_text like '%£80k%' or jd_text like '%£45k%' or jd_text like '%£150k%' then 'UP_TO_ONLY'
  when jd_text like '%£60,000%' then 'RANGE_55_74K' when jd_text like '%£110,000%' then 'ABOVE_100K' end comp from jobs""")
def estimate_pay(spark, d):
    return jobs(spark, d).select("doc_id", R.estimate_pay(F.col("jd_text")).alias("comp"))


@query(J + f"""select doc_id, l.loc, role, tech, greatest(0, least(100, l.loc + role + tech)) total from (select doc_id, case {loc_case()} when 'IN_LONDON' then 25 when 'REMOTE' then 25 when 'UK_OTHER' then 10 when 'OUTSIDE_UK' then -50 else 0 end loc,
  case when {sen_case()} = 'LEVEL_3' then 25 else 15 end role, (case when x_tech like '%NODE%' or title like '%Node%' then 10 else 0 end) + (case when x_tech like '%REACT%' or x_tech like '%JS_TS%' then 5 else 0 end) + (case when x_tech like '%AI_ML%' then 10 else 0 end) tech from jobs) l""")
def numeric_scorer(spark, d):
    s = R.numeric_score(F.col("job_location"), F.col("title"), F.col("jd_text"))
    return jobs(spark, d).select("doc_id", *[v.alias(k) for k, v in s.items()])


@query(LAB + """select doc_id, list_aggregate(list_filter([case when title in ('Senior Software Engineer', 'Sr. Node Developer', 'Staff Data Scientist') and sen = 'LEVEL_1' then 'senior_title_level_1' end, case when title in ('Product Manager') and sen = 'LEVEL_3' then 'no_engineering_level_3' end,
  case when job_location in ('London, UK', 'Little London, UK') and loc <> 'IN_LONDON' then 'london_elsewhere' end, case when job_location in ('Remote', 'Paris, France (Remote)') and loc not in ('IN_LONDON', 'REMOTE') then 'remote_elsewhere' end,
  case when tech <> 'OOS' and title in ('Product Manager') then 'in_scope_no_engineering' end], lambda x: x is not null), 'string_agg', ',') issues from labelled""")
def suspicious_tokens(spark, d):
    c = F.col
    out = table(spark, d, "labelled").select("doc_id", F.array_join(R.suspicious(c("title"), c("job_location"), c("loc"), c("sen"), c("tech")), ",").alias("issues"))
    return out.select("doc_id", F.when(F.col("issues") != "", F.col("issues")).alias("issues"))


@query(LAB + f"select doc_id, score, label, loc_s + sen_s + comp_s raw_flat from (select doc_id, score, label, {fx._map('loc', fx.LOC_SCORE)} loc_s, {fx._map('sen', fx.SEN_SCORE)} sen_s, {fx._map('comp', fx.COMP_SCORE)} comp_s from labelled) x")
def score_v7(spark, d):
    c = F.col
    s = T.scores(c("loc"), c("sen"), F.split("tech", ","), c("comp"))
    return table(spark, d, "labelled").select("doc_id", s["score"].alias("score"), s["label"].alias("label"), (T.lookup(c("loc"), T.V7.loc) + T.lookup(c("sen"), T.V7.sen) + T.lookup(c("comp"), T.V7.comp)).alias("raw_flat"))


V5_SQL = """select doc_id, case when loc in ('IN_LONDON', 'REMOTE') then 'LONDON_OR_REMOTE' when loc = 'UNK' then 'MISSING' else loc end loc, case sen when 'LEVEL_3' then 'SENIOR_PLUS' when 'LEVEL_2' then 'MID_LEVEL' else 'NO_SENIORITY' end role,
  case tech when 'NODE,JS_TS' then 'NODE_JS_TS' when 'REACT,JS_TS' then 'JS_TS' when 'AI_ML' then 'AI_ML' when 'NODE,REACT,AI_ML' then 'NODE_JS_TS_AI_ML' else 'NONE' end tech, case when comp = 'RANGE_45_54K' then 'RANGE_55_74K' else comp end comp from labelled"""


@query(LAB + V5_SQL)
def convert_v7_to_v5(spark, d):
    c = F.col
    v = T.to_v5(c("loc"), c("sen"), F.split("tech", ","), c("comp"))
    return table(spark, d, "labelled").select("doc_id", *[x.alias(k) for k, x in v.items()])


@query(LAB + f"""select doc_id, score, {fx.label_sql('score')} label from (select doc_id, greatest(0, least(100, {fx._map('loc', T.V5.loc)} + {fx._map('role', T.V5.sen)} + {fx._map('tech', T.V5.tech)} + {fx._map('comp', T.V5.comp)})) score from ({V5_SQL}) v) s""")
def score_v5(spark, d):
    s = T.scores_flat(F.col("loc"), F.col("role"), F.col("tech"), F.col("comp"))
    return convert_v7_to_v5(spark, d).select("doc_id", *[v.alias(k) for k, v in s.items()])


@query(LAB + f"""select doc_id, greatest(0, least(100, case loc when 'IN_LONDON' then 25 when 'REMOTE' then 15 when 'UK_OTHER' then 10 when 'OUTSIDE_UK' then -50 else 0 end + case when tech = 'OOS' then 0 else {fx._map('sen', fx.SEN_SCORE)} + least(25, case tech when 'NODE,JS_TS' then 15 when 'REACT,JS_TS' then 5 when 'AI_ML' then 10 else 25 end) end + {fx._map('comp', fx.COMP_SCORE)})) score from labelled""")
def alternative_score(spark, d):
    c = F.col
    return table(spark, d, "labelled").select("doc_id", T.alternative_score(c("loc"), c("sen"), F.split("tech", ","), c("comp")).alias("score"))


@query(LAB + "select doc_id, case tech when 'OOS' then 'OUT_OF_SCOPE' else replace(tech, ',', '_') end combo from labelled")
def tech_combo_string(spark, d):
    return table(spark, d, "labelled").select("doc_id", T.combo(F.split("tech", ",")).alias("combo"))


@query(ctes("labelled") + "select doc_id, case score % 30 when 25 then 'ABOVE_100K' when 15 then 'RANGE_75_99K' when 5 then 'RANGE_55_74K' else 'NO_GBP' end first_token, case score % 30 when 25 then 'ABOVE_100K' when 15 then 'RANGE_75_99K' when 5 then 'RANGE_55_74K' when 0 then 'RANGE_45_54K' else 'NO_GBP' end last_token from labelled")
def numeric_to_tokens(spark, d):
    n = F.col("score") % 30
    return table(spark, d, "labelled").select("doc_id", T.from_number(n, T.V7.comp, "NO_GBP").alias("first_token"), T.from_number(n, T.V7.comp, "NO_GBP", first=False).alias("last_token"))


def _fuzzy_sql(col: str, names: list[str]) -> str:
    best = f"list_min([{', '.join(f'''levenshtein(upper(trim({col})), '{t}') * 100 + {i}''' for i, t in enumerate(names))}])"
    listed = ", ".join(f"'{t}'" for t in names)
    return f"case when {col} in ({listed}) then {col} when upper(trim({col})) in ({listed}) then upper(trim({col})) when {best} < 300 then ([{listed}])[({best} % 100)::int + 1] end"


@query(ctes("raw_tokens") + f"select doc_id, {_fuzzy_sql('loc', T.V7.names('loc'))} loc, {_fuzzy_sql('arr', T.V7.names('arr'))} arr, {_fuzzy_sql('sen', T.V7.names('sen'))} sen, {_fuzzy_sql('comp', T.V7.names('comp'))} comp from raw_tokens")
def fuzzy_token_match(spark, d):
    return table(spark, d, "raw_tokens").select("doc_id", *[T.fuzzy(F.col(f), T.V7.names(f)).alias(f) for f in ("loc", "arr", "sen", "comp")])


@query(
    ctes("raw_tokens")
    + f"""select doc_id, l is not null and a is not null and s is not null and c is not null valid, case when l is not null and a is not null and s is not null and c is not null then l end loc,
  case when l is not null and a is not null and s is not null and c is not null then (case when tech = '' then 'OOS' when upper(tech) = 'OOS,OOS' then 'OOS' when upper(tech) like 'OOS,%' then substr(upper(tech), 5) else upper(tech) end) end tech
  from (select doc_id, tech, {_fuzzy_sql('loc', T.V7.names('loc'))} l, {_fuzzy_sql('arr', T.V7.names('arr'))} a, {_fuzzy_sql('sen', T.V7.names('sen'))} s, {_fuzzy_sql('comp', T.V7.names('comp'))} c from raw_tokens) x"""
)
def validate_prediction(spark, d):
    c = F.col
    tech = F.when(c("tech") == "", F.array().cast("array<string>")).otherwise(F.split("tech", ","))
    v = T.validated(c("loc"), c("arr"), c("sen"), tech, c("comp"))
    return table(spark, d, "raw_tokens").select("doc_id", v["valid"].alias("valid"), v["loc"].alias("loc"), F.array_join(v["tech"], ",").alias("tech"))


BASE_ROW = "'\"loc\": \"' || loc || '\", \"arr\": \"' || arr || '\", \"sen\": \"' || sen || '\", \"tech\": [\"' || replace(tech, ',', '\", \"') || '\"'"


def raw_outputs(spark, d) -> DataFrame:
    """Model outputs in the ways that they go wrong: fences, unquoted keys, talk, a missing close, thought, garbage."""
    body = F.expr(BASE_ROW)
    k = F.expr(fx.u(31, 7))
    full = F.concat(F.lit("{"), body, F.lit("]}"))
    raw = (
        F.when(k == 0, full).when(k == 1, F.concat(F.lit("```json\n"), full, F.lit("\n```"))).when(k == 2, F.concat(F.lit('{loc": '), F.substr(full, F.lit(9)))).when(k == 3, F.concat(full, F.lit(" I hope this helps.")))
        .when(k == 4, F.concat(F.lit("{"), body)).when(k == 5, F.concat(F.lit("<think>{hm}</think>\n"), full)).otherwise(F.lit("no json at all"))
    )
    return table(spark, d, "labelled").select("doc_id", "loc", "sen", "tech", k.alias("k"), raw.alias("raw"))


@query(LAB + f"select doc_id, case when {fx.u(31, 7)} < 6 then loc end loc, case when {fx.u(31, 7)} < 6 then sen end sen, case when {fx.u(31, 7)} < 6 then tech end tech from labelled")
def json_repair(spark, d):
    got = repair.parsed(repair.without_thought(F.col("raw")))
    return raw_outputs(spark, d).select("doc_id", got.alias("p")).select("doc_id", "p.loc", "p.sen", F.array_join("p.tech", ",").alias("tech"))


@query(LAB + f"select doc_id, case when {fx.u(31, 7)} in (0, 1, 3, 5) then loc end loc, case when {fx.u(31, 7)} in (0, 1, 3, 5) then tech end tech from labelled")
def field_salvage(spark, d):
    got = repair.salvaged(F.col("raw"), ["loc", "arr", "sen"], closed=True)
    return raw_outputs(spark, d).where("k <> 2 or k = 2").select("doc_id", F.when(F.col("k") != 2, got).alias("p")).select("doc_id", "p.loc", F.array_join("p.tech", ",").alias("tech"))


@query(LAB + f"select doc_id, case when {fx.u(31, 7)} < 6 then loc end loc, case when {fx.u(31, 7)} < 6 then sen end sen, case when {fx.u(31, 7)} = 6 or tech = 'OOS' then case when {fx.u(31, 7)} = 6 then '' else 'OOS' end else tech end tech from labelled where loc <> 'REMOTE' and arr <> 'REMOTE'")
def vocabulary_salvage(spark, d):
    src = raw_outputs(spark, d).join(table(spark, d, "labelled").where("loc <> 'REMOTE' and arr <> 'REMOTE'").select("doc_id"), "doc_id", "left_semi")
    got = repair.by_vocabulary(F.col("raw"), {f: T.V7.names(f) for f in ("loc", "sen", "tech")})
    return src.select("doc_id", got["loc"].alias("loc"), got["sen"].alias("sen"), F.array_join(got["tech"], ",").alias("tech"))


# keys and normalisation

NORM = r"trim(regexp_replace(replace({}, chr(160), ' '), '[\s\x0b]+', ' ', 'g'))"
COMPANY = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(company), '\b(ltd|llc|inc|plc|limited|corp|corporation)\b', '', 'g'), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"


@query(J + rf"""select doc_id, {COMPANY} company_key, lower(trim(title)) || '||' || {COMPANY} pair_key, substr(sha256({NORM.format("lower(substr(jd_text, 1, 500))")}), 1, 16) fingerprint, substr(sha256(substr(jd_text, 1, 500)), 1, 16) fingerprint_raw,
  lower(title) || '|' || lower(company) || '|' || lower(job_location) content_key from jobs""")
def text_keys(spark, d):
    c = F.col
    return jobs(spark, d).select("doc_id", X.company_key(c("company")).alias("company_key"), X.pair_key(c("title"), c("company")).alias("pair_key"), X.fingerprint(c("jd_text")).alias("fingerprint"), X.fingerprint(c("jd_text"), False).alias("fingerprint_raw"), X.content_key(c("title"), c("company"), c("job_location")).alias("content_key"))


@query(r"""select doc_id, md5('t' || '||' || coalesce(lang, '') || '||' || regexp_replace(regexp_replace(trim(lower(substr(text, 1, 500))), '\s+', ' ', 'g'), '[^\p{L}\p{N}_\s]', '', 'g')) h from documents""")
def content_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", X.content_hash(F.lit("t"), F.coalesce("lang", F.lit("")), F.col("text")).alias("h"))


@query(J + r"select doc_id, regexp_replace(job_id || case doc_id % 5 when 0 then '_dup_' || doc_id when 1 then '_con_x' || doc_id when 2 then '_sal_3' when 3 then '_trunc50' else '' end, '(_dup_[0-9]+|_con_[0-9A-Za-z_]+|_sal_[0-9]+|_locvar_[0-9]+|_trunc_[0-9]+)$', '') family from jobs")
def family_ids(spark, d):
    made = F.expr("job_id || case doc_id % 5 when 0 then '_dup_' || doc_id when 1 then '_con_x' || doc_id when 2 then '_sal_3' when 3 then '_trunc50' else '' end")
    return jobs(spark, d).select("doc_id", X.family(made).alias("family"))


CUT = r"list_filter(list_transform(string_split(regexp_replace(replace(regexp_replace(trim(replace(text, chr(13), chr(10))), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(10), chr(1)), '', ''), chr(1)), lambda s: trim(regexp_replace(s, '[ \t\x0B\f]+', ' ', 'g'))), lambda s: s <> '')"


@query(f"select doc_id, len(list_distinct(s)) n_sentences, s[1] first_sentence from (select doc_id, {CUT} s from documents) x")
def sentences_distinct(spark, d):
    s = X.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.try_element_at("s", F.lit(1)).alias("first_sentence"))


@query(J + "select doc_id, case x_arr when 'HYBRID' then 'Hybrid role.' when 'REMOTE' then 'Fully remote.' when 'IN_OFFICE' then 'On-site only.' end evidence from jobs")
def evidence_first(spark, d):
    return jobs(spark, d).select("doc_id", X.first_sentence(F.col("jd_text"), r"(?i)\b(hybrid|remote)\b|\bon-site\b").alias("evidence"))


@query(J + r"select doc_id, length(jd_text) chars, ceil(length(jd_text) / 4)::bigint tokens, case when length(jd_text) <= 80 then jd_text else rtrim(substr(jd_text, 1, 77)) || '...' end head from jobs")
def token_estimate_and_cut(spark, d):
    c = F.col("jd_text")
    return jobs(spark, d).select("doc_id", F.length(c).alias("chars"), X.tokens_estimate(c).alias("tokens"), X.cut(c, 80).alias("head"))


@query(r"select page_id, regexp_matches(html, '(?i)&(amp|lt|gt|nbsp|quot|apos|#\d+);') or regexp_matches(html, '(?i)</?[a-z][\s\S]*?>') artifacts from pages")
def html_artifacts(spark, d):
    return table(spark, d, "pages").select("page_id", X.html_artifacts(F.col("html")).alias("artifacts"))


@query(r"select doc_id, len(list_distinct(list_transform(range(1, length(lower(substr(text, 1, 500))) - 1), lambda i: substr(lower(substr(text, 1, 500)), i, 3)))) n_grams from documents")
def ngram_set_size(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.grams(F.col("text"))).cast("long").alias("n_grams"))


@query(J + "select doc_id, list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(job_id, ''), lambda x: ascii(x)::bigint)), lambda h, x: ((xor(h, x)::hugeint * 16777619) % 4294967296)::bigint) fnv from jobs")
def fnv_hash(spark, d):
    return jobs(spark, d).select("doc_id", X.fnv1a(F.col("job_id")).alias("fnv"))


@query(J + "select doc_id, case job_location when '' then '' else job_location end place from jobs")
def clean_location(spark, d):
    return jobs(spark, d).select("doc_id", X.clean_location(F.concat("job_location", F.lit(" | 3 days ago"))).alias("place"))


@query(J + "select doc_id, list_aggregate(list_transform(list_filter(range(1, length(jd_text) + 1), lambda i: substr(jd_text, i, 1) = '£'), lambda i: substr(jd_text, greatest(1, i - 50)::int, (51 + least(i - 1, 50))::int)), 'string_agg', '~') contexts from jobs where jd_text like '%£%'")
def keyword_contexts(spark, d):
    return jobs(spark, d).where(F.col("jd_text").contains("£")).select("doc_id", F.array_join(X.contexts(F.col("jd_text"), "£", 50), "~").alias("contexts"))


CUT_JOB = CUT.replace("text", "jd_text")
ORDERED = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
HEAD = f"s as materialized (select doc_id, {CUT_JOB} s, list_filter(list_transform(string_split(jd_text, chr(10)), lambda x: trim(x)), lambda x: x <> '') lines from jobs)"
POINTS = r"""case when regexp_matches(c, '(?i)£|\bsalary\b|\bcompensation\b|\bpay\b|\bper annum\b|\bannum\b|\bp\.?a\.?\b|\bday rate\b') then 6 else 0 end
 + case when regexp_matches(c, '(?i)\bremote\b|\bhybrid\b|\bon[- ]?site\b|\bin[- ]?office\b|\blondon\b|\buk\b|\bunited kingdom\b|\blocation\b|\bbased in\b') then 5 else 0 end
 + case when regexp_matches(c, '(?i)\bnode(\.js|js)?\b|\breact(\.js|js)?\b|\btypescript\b|\bjavascript\b|\bai\b|\bmachine learning\b|\bml\b|\bbackend\b|\bfrontend\b|\bfull[- ]?stack\b') then 4 else 0 end
 + case when regexp_matches(c, '(?i)\bjunior\b|\bgraduate\b|\bentry[- ]?level\b|\bsenior\b|\blead\b|\bstaff\b|\bprincipal\b|\bmanager\b|\bintern(ship)?\b') then 3 else 0 end
 + case when regexp_matches(c, '(?i)\brequirements?\b|\bmust have\b|\bexperience with\b|\bwhat (you(''|’)ll|you will) bring\b|\bskills?\b|\bresponsibilit(y|ies)\b') then 2 else 0 end
 + case when regexp_matches(c, '^\s*[-*•]') then 1 else 0 end - case when length(c) < 24 then 1 else 0 end
 - case when regexp_matches(c, '(?i)\bequal opportunity\b|\bdiversity\b|\binclusion\b|\bprivacy policy\b|\bcookie(s)?\b|\bterms and conditions\b|\bhow to apply\b|\bapply now\b|\bour mission\b|\babout (the )?company\b|\bbenefits include\b|\bperks\b') then 8 else 0 end"""
BLANKS = "[\\s\\x{0b}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]+"
TIDY = f"list_filter(list_transform(PARTS, lambda x: trim(regexp_replace(x, '{BLANKS}', ' ', 'g'))), lambda x: x <> '')"
LINES = TIDY.replace("PARTS", "string_split(replace(jd_text, chr(13), ''), chr(10))")
CHUNKS = TIDY.replace("PARTS", f"string_split(regexp_replace(replace(jd_text, chr(13), ''), '([.!?]){BLANKS}', '\\1' || chr(1), 'g'), chr(1))")


@query(J + f", s as materialized (select doc_id, {LINES} lines, {CHUNKS} parts from jobs) select doc_id, len(p)::int n_chunks, list_max(p) best, list_min(p) worst from (select doc_id, list_transform(case when len(lines) >= 8 then lines else parts end, lambda c: {POINTS}) p from s) x")
def chunk_scores(spark, d):
    out = jobs(spark, d).select("doc_id", X.let(E.chunks(F.col("jd_text")), lambda cs: F.transform(cs, E.chunk_score)).alias("p"))
    return out.select("doc_id", F.size("p").alias("n_chunks"), F.array_max("p").alias("best"), F.array_min("p").alias("worst"))


@query()
def ranked_extract(spark, d):
    return jobs(spark, d).select("doc_id", E.ranked(F.col("jd_text")).alias("extract"))


@query()
def selective_extract(spark, d):
    return jobs(spark, d).select("doc_id", E.selective(F.col("jd_text"), most=1200).alias("extract"))


KEEP = "(?i)" + "|".join(f"(?:{p})" for p in X.KEEP_FACTS)
DROP = "(?i)" + "|".join(X.DROP_FACTS)


@query(J + f", {HEAD} select doc_id, array_to_string(list_filter({ORDERED.format('s')}, lambda x: not regexp_matches(x, '{DROP}') and regexp_matches(x, '{KEEP}'))[:28], chr(10)) facts from s")
def sentence_filter(spark, d):
    return jobs(spark, d).select("doc_id", X.facts(F.col("jd_text")).alias("facts"))


@query()
def preprocess_text(spark, d):
    return table(spark, d, "pages").select("page_id", repair.preprocessed(F.col("html")).alias("text"))


@query()
def smart_truncate(spark, d):
    return jobs(spark, d).select("doc_id", E.truncated(F.col("jd_text"), 300).alias("text"))
