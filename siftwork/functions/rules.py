"""Rule classifiers: ordered regex rules from an advert to tokens, as CASE expressions that stop at the first rule that holds.

One needs match positions and order (the first valid salary) and is an Arrow UDF over the texts that can matter at all;
everything else is an expression.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.functions.text import contexts, let, text_of

# Place names and patterns that decide tokens.
UK_CITIES = [
    "manchester", "birmingham", "bristol", "edinburgh", "glasgow", "leeds", "cambridge", "oxford", "liverpool", "newcastle",
    "sheffield", "nottingham", "cardiff", "belfast", "southampton", "brighton", "leicester", "coventry", "bath", "york",
    "aberdeen", "dundee", "swansea", "exeter", "norwich", "reading", "portsmouth", "warwick", "milton keynes", "chester",
    "derby", "stoke", "sunderland", "hull", "wolverhampton", "plymouth", "luton", "slough", "guildford", "basingstoke",
    "swindon", "cheltenham", "harrogate", "bournemouth", "ipswich", "peterborough", "northampton", "worcester", "stevenage",
    "watford", "crawley", "maidenhead",
]
ABROAD = [
    "united states", "usa", "india", "germany", "france", "australia", "canada", "netherlands", "ireland", "spain", "italy",
    "japan", "china", "brazil", "mexico", "israel", "switzerland", "austria", "sweden", "norway", "denmark", "finland",
    "poland", "portugal", "belgium", "czech", "romania", "hungary", "south korea", "korea", "singapore", "hong kong", "dubai",
    "uae", "united arab emirates", "qatar", "saudi", "egypt", "south africa", "nigeria", "kenya", "new zealand",
    "philippines", "vietnam", "thailand", "indonesia", "malaysia", "taiwan", "pakistan", "new york", "san francisco",
    "los angeles", "seattle", "chicago", "austin", "boston", "denver", "atlanta", "miami", "dallas", "houston", "phoenix",
    "san diego", "san jose", "portland", "minneapolis", "philadelphia", "detroit", "washington dc", "washington, dc",
    "virginia", "california", "texas", "florida", "colorado", "massachusetts", "georgia", "north carolina", "bay area",
    "silicon valley", "berlin", "munich", "hamburg", "paris", "amsterdam", "barcelona", "madrid", "rome", "milan", "zurich",
    "stockholm", "oslo", "copenhagen", "helsinki", "dublin", "lisbon", "prague", "warsaw", "budapest", "vienna", "brussels",
    "bangalore", "hyderabad", "mumbai", "delhi", "pune", "chennai", "kolkata", "noida", "gurgaon", "toronto", "vancouver",
    "montreal", "sydney", "melbourne", "tel aviv", "tokyo",
]
UK_WORDS = r"\b(uk|united kingdom|england|scotland|wales|britain)\b"
LEVEL_3 = r"\b(?:lead|principal|staff|director|head\s+of|vp|cto|chief|architect|manager|founding)\b"
SENIOR = r"\bsenior\b|\bsr\.|\bsr\s|\bsnr\b"
NODE = r"\bnode\.?js\b|\bnode\s+js\b|\bexpress\.?js\b|\bnest\.?js\b|\bkoa\.?js\b|\bfastify\b|\bnode\b|nodejavascri"
REACT = r"\breact\b|\breact\.?js\b|\breact\s*native\b"
JS_TS = r"\btypescript\b|\bjavascript\b|\bjs/ts\b|\bts/js\b|\bangular\b|\bsvelte\b|(?<!\.)(?<!\w)js(?:/|\s*,|\s+and\b)|nodejavascri"
AI_STRONG = r"\bmachine\s+learning\b|\bdeep\s+learning\b|\bartificial\s+intelligence\b|ai\s*/\s*ml|\bnatural\s+language\s+processing\b|\bcomputer\s+vision\b|\bneural\s+network\b|\bllm\b|\blarge\s+language\s+model\b|\btensorflow\b|\bpytorch\b|\bml\s+engineer\b|\bml\s+platform\b|\bfine[- ]?tun(?:e|ing)\b|\bprompt\s+engineering\b|\bnlp\b"
AI_WEAK = r"\b(?<!em)ai\b(?!\s*(?:r|m|ds))"
AI_TALK = [
    r"(?:may\s+)?use\s+(?:of\s+)?(?:artificial\s+intelligence|ai)\b.{0,50}(?:screen|hiring|recruit|assess)\b",
    r"ai[- ](?:powered|driven|generated)\s+(?:tool|screen|hiring|recruit|assess|version|due\s+diligence|risk)",
    r"(?:note|policy)\s+(?:on|about|regarding)\s+(?:using\s+)?ai",
    r"ai\s+(?:usage|tools?)\s+(?:polic|to\s+support)",
    r"(?:hiring|recruitment|screening|application)\s+(?:process|pipeline).*?ai",
    r"ai.*?(?:hiring|recruitment|screening|application)\s+(?:process|pipeline)",
    r"(?:cutting[- ]edge|global\s+player\s+in)\s+ai",
    r"ai[- ]driven\s+(?:due|risk|insight|solution|platform|product|intelligence)",
    r"ai\s+start[- ]?up",
    r"(?:embrace|advantages?\s+of)\s+(?:the\s+)?ai",
    r"\bin\s+ai[- ]driven\b",
    r"ai\s+(?:talent|agent|partner|recrui)",
    r"(?:is\s+the|are\s+(?:an?|the)|we\'?re\s+(?:an?|the))\s+ai\b",
    r"(?:our|the|its)\s+ai\s+(?:scribe|system|feature|model|tool|product|platform|solution|assistant)",
    r"\bunity\b.*?\bai\b|\bunreal\s+engine\b.*?\bai\b",
    r"\bweb\s+and\s+ai\s+products\b",
    r"\bbuild\s+(?:web\s+and\s+)?ai\s+(?:product|solution|platform|tool)",
]
AMOUNT = r"([\d,]+(?:\.\d+)?)\s*[kK]?"
SALARIES = [
    ("range", rf"between\s+£\s*{AMOUNT}\s+and\s+£?\s*{AMOUNT}", re.I),
    ("range", rf"£\s*{AMOUNT}\s*[-–—]\s*£?\s*{AMOUNT}", re.I),
    ("range", rf"£\s*{AMOUNT}\s+to\s+£?\s*{AMOUNT}", re.I),
    ("up_to", rf"(?:up\s+to|salary\s+(?:up\s+)?to|(?:salary|paying)[:\s]+to|\(to)\s+£\s*{AMOUNT}", re.I),
    ("single", rf"£\s*{AMOUNT}\+?", 0),
]
TOTAL_PAY = r"\btotal\s+comp(?:ensation)?\b|\btotal\s+package\b|\btc\b"
DAILY = r"per\s+day|/day|\bday\s+rate\b|\bp\.?d\.?\b"
TARGET_PAY = r"\bote\b|\bon[- ]target\s+earn"
BANDS = [(45_000, "BELOW_45K"), (55_000, "RANGE_45_54K"), (75_000, "RANGE_55_74K"), (100_000, "RANGE_75_99K")]
PLAUSIBLE = (15_000, 500_000)


def _any(words: list[str]) -> Column:
    return F.lit("|".join(re.escape(w).replace("\\ ", " ") for w in words))


def location(place: Column) -> Column:
    """London, then abroad before remote ("Paris (Remote)" is abroad), then remote, then the rest of the UK."""
    raw = text_of(place)
    loc = F.lower(F.trim(raw))
    has = lambda p: F.rlike(loc, F.lit(p))
    return (
        F.when(loc == "", "UNK")
        .when(has(r"\blondon\b") & ~loc.contains("little london"), "IN_LONDON")
        .when(loc.contains("northern ireland"), "UK_OTHER")
        .when(F.rlike(loc, _any(ABROAD)), "OUTSIDE_UK")
        .when(F.rlike(raw, F.lit(r",\s*[A-Z]{2}\s*$")), F.when(has(UK_WORDS), "UK_OTHER").otherwise("OUTSIDE_UK"))
        .when(has(r"\bremote\b") | loc.contains("anywhere"), "REMOTE")
        .when(F.rlike(loc, _any(UK_CITIES)) | has(UK_WORDS), "UK_OTHER")
        .otherwise("UNK")
    )


def arrangement(text: Column) -> Column:
    t = F.lower(text_of(text))
    return F.when(F.rlike(t, F.lit(r"\bhybrid\b")), "HYBRID").when(F.rlike(t, F.lit(r"\bon[- ]?site\b|\bin[- ]office\b")), "IN_OFFICE").when(F.rlike(t, F.lit(r"\bremote\b")), "REMOTE").otherwise("UNK")


def seniority(title: Column, senior: str = "LEVEL_3", default: str = "LEVEL_2") -> Column:
    """senior and default differ between versions of the rules."""
    t = F.lower(text_of(title))
    return F.when(F.rlike(t, F.lit(LEVEL_3)), "LEVEL_3").when(F.rlike(t, F.lit(SENIOR)), senior).otherwise(default)


def _work(t: Column, terms: str) -> Column:
    """Whether some term stands outside company talk, which shows within 80 characters of it."""
    talk = "(?d)" + "|".join(f"(?:{p})" for p in AI_TALK)
    return F.exists(contexts(t, terms, 80), lambda c: ~F.rlike(c, F.lit(talk)))


def ai_work(t: Column) -> Column:
    """Whether a lower-case text is about AI work: by its strong terms if it has any, else by its weak ones."""
    return F.when(F.rlike(t, F.lit(AI_STRONG)), _work(t, AI_STRONG)).when(F.rlike(t, F.lit(AI_WEAK)), _work(t, AI_WEAK)).otherwise(False)


def stack(text: Column, title: Column) -> Column:
    """NODE, REACT, JS_TS, AI_ML that hold, in this order, or OOS. The joined text and the tokens are made once."""
    has = lambda t, p, token: F.when(F.rlike(t, F.lit(p)), token)
    got = let(F.lower(F.concat_ws(" ", text_of(title), text_of(text))), lambda t: F.array_compact(F.array(has(t, NODE, "NODE"), has(t, REACT, "REACT"), has(t, JS_TS, "JS_TS"), F.when(ai_work(t), "AI_ML"))))
    return let(got, lambda x: F.when(F.size(x) == 0, F.array(F.lit("OOS"))).otherwise(x))


def amount(s: str) -> float | None:
    """A salary figure: k multiplies by 1000, and so does a bare figure under 1000 without a currency sign."""
    s = re.sub(r"[,\s]", "", s)
    signed, s = bool(re.search("[£$€]", s)), re.sub("[£$€]", "", s)
    m = re.fullmatch(r"(\d+(?:\.\d+)?)([kK]?)", s)
    if not m:
        return None
    v = float(m[1])
    return v * 1000 if m[2] or v < 1000 and not signed else v


def band(v: float) -> str:
    return next((name for top, name in BANDS if v < top), "ABOVE_100K")


def plausible(v: float | None) -> bool:
    return v is not None and PLAUSIBLE[0] <= v <= PLAUSIBLE[1]


def salary(text: str, title: str) -> str:
    """The first valid salary in reading order decides."""
    low = text.lower()
    if not re.search("£|gbp", low) and not re.search("£|gbp", title.lower()) or re.search(TOTAL_PAY, low):
        return "NO_GBP"
    found = sorted(((m.start(), k, kind, m) for k, (kind, p, flags) in enumerate(SALARIES) for m in re.finditer(p, text, flags)), key=lambda x: x[:2])
    for _, _, kind, m in found:
        if re.search(TARGET_PAY, low[max(0, m.start() - 30) : m.start()]):
            continue
        daily = re.search(DAILY, low[m.end() : m.end() + 30])
        if kind == "range":
            a, b = amount(m[1]), amount(m[2])
            if plausible(a) and plausible(b):
                return "NO_GBP" if daily else band((a + b) / 2)
        elif kind == "up_to":
            if plausible(amount(m[1])):
                return "NO_GBP" if daily else "UP_TO_ONLY"
        elif plausible(v := amount(m[0])):
            if re.search(r"up\s+to\s*$|(?:salary|paying|package)[:\s]*to\s*$|(?:wfh|remote|hybrid|home)\s+to\s*$|\(to\s*$", low[max(0, m.start() - 40) : m.start()]):
                return "UP_TO_ONLY"
            return "NO_GBP" if daily else band(v)
    m = re.search(rf"£\s*{AMOUNT}", title)
    return band(v) if m and plausible(v := amount(m[1])) else "NO_GBP"


@F.pandas_udf(T.StringType())
def _salary(texts: pd.Series, titles: pd.Series) -> pd.Series:
    return pd.Series([salary(t, s) for t, s in zip(texts, titles, strict=True)], dtype="object")


def compensation(text: Column, title: Column) -> Column:
    """Texts without a pound sign or GBP in text or title, and those of total pay, don't reach Python."""
    t, s = text_of(text), text_of(title)
    gbp = F.rlike(F.concat_ws(" ", t, s), F.lit("(?i)£|gbp")) & ~F.rlike(t, F.lit(f"(?i){TOTAL_PAY}"))
    return F.when(~gbp, "NO_GBP").otherwise(_salary(F.when(gbp, t).otherwise(""), F.when(gbp, s).otherwise("")))


# Estimators of the dataset builder and numeric scorers: simpler rules with UNSURE.
OUT_OF_SCOPE = r"\b(product\s+manager|project\s+manager|scrum\s+master|business\s+analyst|data\s+analyst|data\s+scientist|data\s+engineer|devops|sre|site\s+reliability|infrastructure|qa\s+engineer|test\s+engineer|quality\s+assurance|designer|ux|ui\s+designer|graphic|recruiter|hr|human\s+resources|talent|sales|marketing|account\s+manager|customer\s+success|support\s+engineer|it\s+support|helpdesk|help\s+desk|security\s+engineer|cybersecurity|penetration|network\s+engineer|systems\s+admin|database\s+admin)\b"
IN_SCOPE = r"\b(software\s+engineer|software\s+developer|full\s*stack|frontend|front[- ]end|backend|back[- ]end|web\s+developer|application\s+developer|app\s+developer|engineer)\b"
ESTIMATE_ABROAD = ["united states", "usa", "u.s.", "new york", "california", "san francisco", "seattle", "austin", "chicago", "boston", "berlin", "paris", "amsterdam", "dublin", "india", "germany", "france", "canada", "australia", "singapore", "israel", "spain", "italy", "netherlands", "sweden", "denmark", "norway", "switzerland", "japan", "china", "brazil", "poland", "warsaw", "czech", "romania", "portugal", "lisbon", ", ca", ", ny", ", tx", ", wa", ", ma", ", il", ", co"]
ESTIMATE_CITIES = [
    "manchester", "birmingham", "leeds", "bristol", "edinburgh", "glasgow", "cardiff", "cambridge", "oxford", "brighton",
    "nottingham", "liverpool", "sheffield", "newcastle", "southampton", "reading", "belfast", "bath", "exeter", "york",
    "coventry", "leicester", "aberdeen", "dundee", "swansea", "plymouth", "warwick", "norwich", "portsmouth", "swindon",
    "guildford",
]


def estimate_location(place: Column) -> Column:
    loc = F.lower(F.trim(text_of(place)))
    uk = _any([*ESTIMATE_CITIES, "united kingdom", "england", "wales", "scotland", "northern ireland", ", uk", "uk,", "uk "])
    return (
        F.when(loc.isin("", "n/a", "na", "not specified", "none"), "UNKNOWN")
        .when(loc.contains("london"), "IN_LONDON")
        .when(F.rlike(loc, F.lit("remote|anywhere|work from home|wfh|distributed")), "FULLY_REMOTE")
        .when(F.rlike(loc, uk), "UK_OTHER")
        .when(F.rlike(loc, _any(ESTIMATE_ABROAD)), "OUTSIDE_UK")
        .otherwise("UNSURE")
    )


def estimate_scope(title: Column) -> Column:
    t = F.lower(text_of(title))
    return F.when(F.rlike(t, F.lit(OUT_OF_SCOPE)), "OUT_OF_SCOPE").when(F.rlike(t, F.lit(IN_SCOPE)), "IN_SCOPE").otherwise("UNSURE")


def estimate_seniority(title: Column) -> Column:
    t = F.lower(text_of(title))
    return (
        F.when(F.rlike(t, F.lit(r"\b(senior|sr\.?|snr|lead|principal|staff|architect|head|vp|director|chief|founding|iii|iv)\b")), "LEVEL_3")
        .when(F.rlike(t, F.lit(r"\b(mid[- ]?level|intermediate|ii\b|software\s+engineer\b|developer\b|full\s*stack)")), "LEVEL_2")
        .when(F.rlike(t, F.lit(r"\b(junior|jr\.?|entry|intern|graduate|trainee|associate|apprentice|i\b)")), "LEVEL_1")
        .otherwise("LEVEL_2")
    )


def estimate_stack(text: Column, title: Column) -> Column:
    t = F.lower(F.concat_ws(" ", text_of(title), text_of(text)))
    has = lambda p: F.rlike(t, F.lit(p))
    joined = F.concat_ws("_", F.when(has(r"\bnode\.?js\b|\bnode\s+js\b"), "NODE"), F.when(has(r"\b(javascript|typescript|react|angular|vue|next\.?js)\b"), "JS_TS"), F.when(has(r"\b(machine\s+learning|deep\s+learning|artificial\s+intelligence|ai|ml|nlp|computer\s+vision|tensorflow|pytorch|llm|gpt|transformer)\b"), "AI_ML"))
    return F.when(joined == "", "NONE").otherwise(joined)


def estimate_pay(text: Column) -> Column:
    """Midpoint of all pound amounts over 1000; 45 to 55 thousand count as RANGE_55_74K here."""
    t = text_of(text)
    said = F.regexp_extract_all(t, F.lit(r"£\s?([\d,]+)"), F.lit(1))
    found = F.filter(F.transform(said, lambda x: F.regexp_replace(x, ",", "").try_cast("double")), lambda x: x > 1000)
    mid = F.when(F.size(found) >= 2, (F.array_min(found) + F.array_max(found)) / 2).otherwise(F.get(found, 0))
    return (
        F.when(F.size(said) == 0, "NO_GBP").when(F.size(found) == 0, "UP_TO_ONLY").when(F.rlike(F.lower(t), F.lit(r"up\s+to\s+£")), "UP_TO_ONLY")
        .when(mid < 45000, "BELOW_45K").when(mid < 75000, "RANGE_55_74K").when(mid < 100000, "RANGE_75_99K").otherwise("ABOVE_100K")
    )


def numeric_score(place: Column, title: Column, text: Column) -> dict[str, Column]:
    """The numeric scorer: place 25 / 10 / -50, role 25 / 15 / 0, stack up to 25, pay band; total 0 to 100."""
    loc, sen = location(place), seniority(title)
    t = F.lower(F.concat_ws(" ", text_of(title), text_of(text)))
    tech = F.when(F.rlike(t, F.lit(NODE)), 10).otherwise(0) + F.when(F.rlike(t, F.lit(f"{REACT}|{JS_TS}")), 5).otherwise(0) + F.when(F.rlike(t, F.lit(AI_STRONG)), 10).otherwise(0)
    parts = {
        "loc": F.when(loc.isin("IN_LONDON", "REMOTE"), 25).when(loc == "UK_OTHER", 10).when(loc == "OUTSIDE_UK", -50).otherwise(0),
        "role": F.when(sen == "LEVEL_3", 25).otherwise(15),
        "tech": tech,
    }
    return parts | {"total": F.greatest(F.lit(0), F.least(F.lit(100), parts["loc"] + parts["role"] + parts["tech"]))}


def suspicious(title: Column, place: Column, loc: Column, sen: Column, tech: Column) -> Column:
    """Names of token combinations that a title or raw place contradicts."""
    t, p = text_of(title), text_of(place)
    senior = F.rlike(t, F.lit(r"(?i)\b(senior|staff|principal|lead|leader|head|chief|director|vp|cto|founding|snr|sr|iii|distinguished)\b"))
    engineer = F.rlike(t, F.lit(r"(?i)\b(engineer|developer|programmer|architect|sre|devops|cto|data scientist|ml engineer|tech lead|team lead|technical lead)\b"))
    field = F.rlike(t, F.lit(r"(?i)\bengineering\b"))
    return F.array_compact(F.array(
        F.when(senior & engineer & (sen == "LEVEL_1"), "senior_title_level_1"),
        F.when(~engineer & ~field & (sen == "LEVEL_3"), "no_engineering_level_3"),
        F.when(F.rlike(p, F.lit(r"(?i)\blondon\b")) & (loc != "IN_LONDON"), "london_elsewhere"),
        F.when(F.rlike(p, F.lit(r"(?i)\bremote\b")) & ~loc.isin("IN_LONDON", "REMOTE"), "remote_elsewhere"),
        F.when((tech != "OOS") & ~engineer & ~field, "in_scope_no_engineering"),
    ))


def bad_priority(score: Column, comp: Column, tech: Column, loc: Column, arr: Column) -> Column:
    """How useful a bad fit is to learn from: near misses, paid roles and tracked stacks first."""
    one = lambda c, n: F.when(c, n).otherwise(0)
    return (
        one(score >= 30, 4) + one(score >= 40, 2) + one(comp == "RANGE_55_74K", 3) + one(comp == "RANGE_75_99K", 1)
        + one(F.arrays_overlap(tech, F.array(*[F.lit(x) for x in ("NODE", "REACT", "JS_TS", "AI_ML")])), 2) + one(F.array_contains(tech, "AI_ML"), 2)
        + one(loc == "IN_LONDON", 1) + one(arr.isin("HYBRID", "REMOTE"), 1)
    )
