"""Tables in the shape that curation and evaluation read, derived from the driver's tables.

Each is one SQL text that Spark and DuckDB both run, so an operator and its oracle start from equal rows. Names in braces
are the driver's tables. Choices are integer arithmetic on doc_id; nothing is random.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TITLES = ["Senior Software Engineer", "Backend Developer", "Engineering Manager", "Junior QA Engineer", "Staff Data Scientist", "Sr. Node Developer", "Product Manager"]
SENIORITIES = ["LEVEL_3", "LEVEL_2", "LEVEL_3", "LEVEL_2", "LEVEL_3", "LEVEL_3", "LEVEL_3"]
LOCATIONS = ["London, UK", "Remote", "Manchester, England", "Paris, France (Remote)", "Austin, TX", "Belfast, Northern Ireland", "", "Anywhere", "Little London, UK", "Londonderry"]
PLACES = ["IN_LONDON", "REMOTE", "UK_OTHER", "OUTSIDE_UK", "OUTSIDE_UK", "UK_OTHER", "UNK", "REMOTE", "UK_OTHER", "UNK"]
WAYS = ["Hybrid role.", "Fully remote.", "On-site only.", ""]
ARRANGEMENTS = ["HYBRID", "REMOTE", "IN_OFFICE", "UNK"]
STACKS = ["Node.js and TypeScript.", "React Native and JavaScript.", "Machine learning with PyTorch.", "Java, Spring, SQL.", "We use AI in our hiring process.", "NestJS, React, LLM fine-tuning."]
TECHS = ["NODE,JS_TS", "REACT,JS_TS", "AI_ML", "OOS", "OOS", "NODE,REACT,AI_ML"]
PAY = ["Salary £60,000 - £70,000 per annum.", "up to £90k", "between £80k and £100k", "£500 per day", "OTE £110,000", "$120,000", "£45k to £50k", "total compensation £150k", "£80k+", "Competitive."]
COMPS = ["RANGE_55_74K", "UP_TO_ONLY", "RANGE_75_99K", "NO_GBP", "NO_GBP", "NO_GBP", "RANGE_45_54K", "NO_GBP", "NO_GBP", "NO_GBP"]
SUFFIXES = [" Ltd", " Inc.", ""]


def u(salt: int, n: int) -> str:
    """A choice among n by doc_id."""
    return f"(((doc_id * 7919 + 104729) * ({salt} * 613 + 7) % 10007) % {n})"


def pick(values: list[str], salt: int) -> str:
    return f"case {u(salt, len(values))} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


def shifted(column: str, values: list[str]) -> str:
    return f"case {column} " + " ".join(f"when '{v}' then '{values[(i + 1) % len(values)]}'" for i, v in enumerate(values)) + " end"


LOCS = ["IN_LONDON", "REMOTE", "UK_OTHER", "OUTSIDE_UK", "UNK"]
ARRS = ["REMOTE", "HYBRID", "IN_OFFICE", "UNK"]
SENS = ["LEVEL_3", "LEVEL_2", "LEVEL_1"]
TECH_SETS = ["NODE,JS_TS", "REACT,JS_TS", "AI_ML", "OOS", "NODE,REACT,AI_ML"]
COMP_TOKENS = ["NO_GBP", "UP_TO_ONLY", "BELOW_45K", "RANGE_45_54K", "RANGE_55_74K", "RANGE_75_99K", "ABOVE_100K"]


def _map(column: str, scores: dict[str, int]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in scores.items()) + " else 0 end"


LOC_SCORE = {"IN_LONDON": 25, "REMOTE": 25, "UK_OTHER": 10, "OUTSIDE_UK": -50, "UNK": 0}
SEN_SCORE = {"LEVEL_3": 25, "LEVEL_2": 15, "LEVEL_1": 0}
TECH_SCORE = {"NODE": 10, "REACT": 5, "JS_TS": 5, "AI_ML": 10, "OOS": 0}
COMP_SCORE = {"NO_GBP": 0, "UP_TO_ONLY": 0, "BELOW_45K": -30, "RANGE_45_54K": 0, "RANGE_55_74K": 5, "RANGE_75_99K": 15, "ABOVE_100K": 25}


def score_sql(loc: str, sen: str, tech: str, comp: str) -> str:
    """A score from tokens, tech being a comma-joined text."""
    summed = " + ".join(f"(case when ',' || {tech} || ',' like '%,{t},%' then {s} else 0 end)" for t, s in TECH_SCORE.items() if s)
    oos = f"({tech} = '' or ',' || {tech} || ',' like '%,OOS,%')"
    return f"greatest(0, least(100, {_map(loc, LOC_SCORE)} + (case when {oos} then 0 else {_map(sen, SEN_SCORE)} + {summed} end) + {_map(comp, COMP_SCORE)}))"


def label_sql(score: str) -> str:
    return f"case when {score} >= 70 then 'good_fit' when {score} >= 50 then 'maybe' else 'bad_fit' end"


#: French texts hold the word "ai", which is no skill there.
BODY = "replace(replace(replace(replace(text, 'ai', 'ay'), 'Ai', 'Ay'), 'AI', 'AY'), 'aI', 'aY')"
JOBS = f"""
select doc_id, doc_id + 1 line_no, 'doc_' || doc_id job_id, {pick(TITLES, 1)} title, 'Acme ' || source || {pick(SUFFIXES, 6)} company,
  {pick(LOCATIONS, 2)} job_location, {pick(WAYS, 3)} || ' ' || {pick(STACKS, 4)} || ' ' || {pick(PAY, 5)} || chr(10) || {BODY} jd_text,
  {BODY} body, source source_file, lang,
  {pick(PLACES, 2)} x_loc, {pick(ARRANGEMENTS, 3)} x_arr, {pick(SENIORITIES, 1)} x_sen, {pick(TECHS, 4)} x_tech, {pick(COMPS, 5)} x_comp, {u(9, 20)} dent
from {{documents}}
"""
GOLD = f"""
select doc_id, line_no, job_id, title, company, job_location, jd_text, body, source_file, lang, loc, arr, sen, tech, comp, {score_sql('loc', 'sen', 'tech', 'comp')} score
from (select *, case when dent = 0 then {shifted('x_loc', LOCS)} else x_loc end loc, x_arr arr, case when dent = 1 then {shifted('x_sen', SENS)} else x_sen end sen,
  x_tech tech, case when dent = 2 then {shifted('x_comp', COMP_TOKENS)} else x_comp end comp from {{jobs}} j) g
"""
#: Labelled jobs: gold tokens, score and label.
LABELLED = f"select s.*, {label_sql('score')} label from {{gold}} s"
_PRED = f"""
select line_no job_index, doc_id, {u(11, 14)} = 0 parse_fail, {u(17, 25)} = 0 invalid_token, loc g_loc, arr g_arr, sen g_sen, tech g_tech, comp g_comp, score g_score, label g_label,
  case when {u(12, 8)} = 0 then {shifted('loc', LOCS)} else loc end p_loc, case when {u(13, 8)} = 0 then {shifted('arr', ARRS)} else arr end p_arr,
  case when {u(14, 8)} = 0 then {shifted('sen', SENS)} else sen end p_sen, case when {u(15, 8)} = 0 then {shifted('tech', TECH_SETS)} else tech end p_tech,
  case when {u(16, 8)} = 0 then {shifted('comp', COMP_TOKENS)} else comp end p_comp
from {{labelled}} l
"""
#: Predictions joined with gold: tokens are null where parsing failed or a token is invalid.
PREDICTIONS = f"""
select job_index, doc_id, parse_fail, invalid_token, g_loc, g_arr, g_sen, g_tech, g_comp, g_score, g_label,
  case when not (parse_fail or invalid_token) then p_loc end p_loc, case when not (parse_fail or invalid_token) then p_arr end p_arr, case when not (parse_fail or invalid_token) then p_sen end p_sen,
  case when not (parse_fail or invalid_token) then p_tech end p_tech, case when not (parse_fail or invalid_token) then p_comp end p_comp,
  case when not (parse_fail or invalid_token) then p_score end p_score, case when not (parse_fail or invalid_token) then {label_sql('p_score')} end p_label
from (select *, {score_sql('p_loc', 'p_sen', 'p_tech', 'p_comp')} p_score from {{drawn}} p) q
"""
#: A second model's predictions of the same rows, with its own errors and failures.
_PRED_B = _PRED.replace(u(11, 14), u(51, 9)).replace(u(17, 25), u(52, 20)).replace(u(12, 8), u(53, 6)).replace(u(16, 8), u(54, 5))
PREDICTIONS_B = PREDICTIONS.replace("{drawn}", "{drawn_b}")
#: Runs of models: a day of events is a run, an event type a model.
RUNS = "select cast(date_trunc('day', ts) as date) run, event_type model, cast(count(*) as bigint) n, sum(case when event_id % 3 <> 0 then 1 else 0 end) ok, sum(abs(value - 50)) abs_err from {events} group by 1, 2"
#: Tokens as a model spells them: lower case, typos of one to three letters, mixtures.
RAW_TOKENS = f"""
select doc_id, case {u(21, 5)} when 0 then lower(loc) when 1 then loc || 'X' when 2 then 'XX' || loc when 3 then loc || 'QZWK' else loc end loc,
  case {u(22, 4)} when 0 then lower(arr) when 1 then arr || 'Y' else arr end arr, case {u(23, 4)} when 0 then 'LEVEL3' when 1 then 'level_2' else sen end sen,
  case {u(24, 5)} when 0 then 'OOS,' || tech when 1 then '' when 2 then lower(tech) else tech end tech, case {u(25, 4)} when 0 then lower(comp) when 1 then substr(comp, 2) else comp end comp
from {{labelled}} l
"""
#: Target counts of tokens, as a distribution table has them.
TARGETS = "select * from (values ('loc','IN_LONDON',120),('loc','REMOTE',180),('loc','UK_OTHER',260),('loc','OUTSIDE_UK',240),('loc','UNK',150),('arr','REMOTE',200),('arr','HYBRID',260),('arr','IN_OFFICE',300),('arr','UNK',200),('sen','LEVEL_3',600),('sen','LEVEL_2',250),('sen','LEVEL_1',90),('comp','NO_GBP',500),('comp','UP_TO_ONLY',80),('comp','BELOW_45K',60),('comp','RANGE_45_54K',90),('comp','RANGE_55_74K',110),('comp','RANGE_75_99K',100),('comp','ABOVE_100K',70)) t(field, token, target)"

TABLES = {"jobs": JOBS, "gold": GOLD, "drawn": _PRED, "drawn_b": _PRED_B, "predictions_b": PREDICTIONS_B, "labelled": LABELLED, "predictions": PREDICTIONS, "runs": RUNS, "raw_tokens": RAW_TOKENS, "targets": TARGETS}
DRIVER = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver's table or a derived one. A derived table that another one reads is fenced by a generator, else Catalyst
    would write its CASE expressions out once for every use."""
    if name in DRIVER:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = TABLES[name]
    used = {t: table(spark, sf_dir, t) for t in [*DRIVER, *TABLES] if f"{{{t}}}" in sql}
    fenced = {t: f if t in DRIVER else f.select(F.explode(F.array(F.struct("*"))).alias("r")).select("r.*") for t, f in used.items()}
    return spark.sql(sql, **fenced)


def inlined(name: str) -> str:
    sql = TABLES[name]
    for t in TABLES:
        if f"{{{t}}}" in sql:
            sql = sql.replace(f"{{{t}}}", f"({inlined(t)})")
    for t in DRIVER:
        sql = sql.replace(f"{{{t}}}", t)
    return sql


def ctes(*names: str) -> str:
    """The derived tables as DuckDB's WITH list."""
    return "with recursive " + ", ".join(f"{n} as materialized ({inlined(n)})" for n in names) + " "
