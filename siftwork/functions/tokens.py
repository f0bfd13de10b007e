"""Token algebra: vocabularies as data, scores and labels, validation with fuzzy repair, conversions between vocabularies."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Vocabulary:
    """Tokens with scores for the scored fields; arrangement has none. Order breaks ties of fuzzy matches."""

    loc: dict[str, int]
    sen: dict[str, int]
    tech: dict[str, int]
    comp: dict[str, int]
    arr: list[str] = field(default_factory=lambda: ["REMOTE", "HYBRID", "IN_OFFICE", "UNK"])
    none: str = "OOS"

    def names(self, f: str) -> list[str]:
        return list(getattr(self, f))


#: Fixed values.
V7 = Vocabulary(
    loc={"IN_LONDON": 25, "REMOTE": 25, "UK_OTHER": 10, "OUTSIDE_UK": -50, "UNK": 0},
    sen={"LEVEL_3": 25, "LEVEL_2": 15, "LEVEL_1": 0},
    tech={"NODE": 10, "REACT": 5, "JS_TS": 5, "AI_ML": 10, "OOS": 0},
    comp={"NO_GBP": 0, "UP_TO_ONLY": 0, "BELOW_45K": -30, "RANGE_45_54K": 0, "RANGE_55_74K": 5, "RANGE_75_99K": 15, "ABOVE_100K": 25},
)
V5 = Vocabulary(
    loc={"LONDON_OR_REMOTE": 25, "UK_OTHER": 10, "OUTSIDE_UK": -50, "MISSING": 0},
    sen={"SENIOR_PLUS": 25, "MID_LEVEL": 15, "NO_SENIORITY": 0},
    tech={"NONE": 0, "JS_TS": 5, "NODE": 10, "NODE_JS_TS": 15, "AI_ML": 10, "JS_TS_AI_ML": 15, "NODE_AI_ML": 20, "NODE_JS_TS_AI_ML": 25},
    comp={"NO_GBP": 0, "UP_TO_ONLY": 0, "BELOW_45K": -30, "RANGE_55_74K": 5, "RANGE_75_99K": 15, "ABOVE_100K": 25},
    none="NONE",
)
FIELDS = ["loc", "arr", "sen", "tech", "comp"]
TECH_ORDER = ["NODE", "REACT", "JS_TS", "AI_ML"]


def lookup(c: Column, scores: dict[str, int]) -> Column:
    """A token's score, 0 where unknown."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in scores.items() for x in kv]), c), F.lit(0))


def label(score: Column) -> Column:
    return F.when(score >= 70, "good_fit").when(score >= 50, "maybe").otherwise("bad_fit")


def out_of_scope(tech: Column, none: str = "OOS") -> Column:
    return (F.size(tech) == 0) | F.array_contains(tech, none)


def scores(loc: Column, sen: Column, tech: Column, comp: Column, v: Vocabulary = V7) -> dict[str, Column]:
    """loc_score, role_score, tech_score, comp_score, score and label; a tech array out of scope zeroes tech and role."""
    gate = out_of_scope(tech, v.none)
    own = {
        "loc_score": lookup(loc, v.loc),
        "role_score": F.when(gate, 0).otherwise(lookup(sen, v.sen)),
        "tech_score": F.when(gate, 0).otherwise(F.aggregate(tech, F.lit(0), lambda a, t: a + lookup(t, v.tech))),
        "comp_score": lookup(comp, v.comp),
    }
    own["score"] = F.greatest(F.lit(0), F.least(F.lit(100), own["loc_score"] + own["role_score"] + own["tech_score"] + own["comp_score"]))
    return own | {"label": label(own["score"])}


def scores_flat(loc: Column, role: Column, tech: Column, comp: Column, v: Vocabulary = V5) -> dict[str, Column]:
    """The same for scalar tech tokens, without a gate."""
    s = F.greatest(F.lit(0), F.least(F.lit(100), lookup(loc, v.loc) + lookup(role, v.sen) + lookup(tech, v.tech) + lookup(comp, v.comp)))
    return {"score": s, "label": label(s)}


def alternative_score(loc: Column, sen: Column, tech: Column, comp: Column) -> Column:
    """A profile with remote at 15, JS_TS and REACT counted once, and tech capped at 25."""
    has = lambda t: F.array_contains(tech, t)
    stack = F.when(has("NODE"), 10).otherwise(0) + F.when(has("REACT") | has("JS_TS"), 5).otherwise(0) + F.when(has("AI_ML"), 10).otherwise(0)
    gate = out_of_scope(tech)
    total = lookup(loc, V7.loc | {"REMOTE": 15}) + F.when(gate, 0).otherwise(lookup(sen, V7.sen) + F.least(F.lit(25), stack)) + lookup(comp, V7.comp)
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def combo(tech: Column, order: list[str] = TECH_ORDER) -> Column:
    """A tech array as one token, in the canonical order; OUT_OF_SCOPE where none is left."""
    joined = F.array_join(F.filter(F.array(*[F.lit(t) for t in order]), lambda t: F.array_contains(tech, t)), "_")
    return F.when(joined == "", "OUT_OF_SCOPE").otherwise(joined)


def to_v5(loc: Column, sen: Column, tech: Column, comp: Column) -> dict[str, Column]:
    """V7 tokens in the V5 vocabulary; REACT counts as JS_TS there, and RANGE_45_54K, which V5 lacks, as RANGE_55_74K."""
    has = lambda *ts: F.arrays_overlap(tech, F.array(*[F.lit(t) for t in ts]))
    parts = F.concat_ws("_", F.when(has("NODE"), "NODE"), F.when(has("REACT", "JS_TS"), "JS_TS"), F.when(has("AI_ML"), "AI_ML"))
    return {
        "loc": F.when(loc.isin("IN_LONDON", "REMOTE"), "LONDON_OR_REMOTE").when(loc == "UNK", "MISSING").otherwise(loc),
        "role": F.when(sen == "LEVEL_3", "SENIOR_PLUS").when(sen == "LEVEL_2", "MID_LEVEL").otherwise("NO_SENIORITY"),
        "tech": F.when(parts == "", "NONE").otherwise(parts),
        "comp": F.when(comp == "RANGE_45_54K", "RANGE_55_74K").otherwise(comp),
    }


def from_number(n: Column, scores_of: dict[str, int], default: str, first: bool = True) -> Column:
    """The token of a score; where tokens share one, the first or the last of the vocabulary."""
    back: dict[int, str] = {}
    for k, v in scores_of.items():
        if first:
            back.setdefault(v, k)
        else:
            back[v] = k
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in back.items() for x in kv]), n), F.lit(default))


def fuzzy(c: Column, names: list[str], most: int = 2) -> Column:
    """The token as it is, in upper case, or the nearest within `most` edits (the earliest of equals); else null."""
    up = F.upper(F.trim(c))
    near = F.array_min(F.array(*[F.struct(F.levenshtein(up, F.lit(t)).alias("d"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(names)]))
    return F.when(c.isin(names), c).when(up.isin(names), up).when(near["d"] <= most, near["t"])


def validated(loc: Column, arr: Column, sen: Column, tech: Column, comp: Column, v: Vocabulary = V7) -> dict[str, Column]:
    """valid, errors, repairs and the corrected tokens (null unless valid). A null field is missing and nothing else is said then."""
    given = {"loc": loc, "arr": arr, "sen": sen, "comp": comp}
    missing = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(f"Missing field: {k}")) for k, c in (given | {"tech": tech}).items()]))
    fixed = {k: fuzzy(c, v.names(k)) for k, c in given.items()}
    each = F.transform(tech, lambda t: fuzzy(t, v.names("tech")))
    bad = [F.when(fixed[k].isNull(), F.concat(F.lit(f"Invalid {k}: "), c)) for k, c in given.items()]
    bad.append(F.when(F.exists(each, lambda t: t.isNull()), F.lit("Invalid tech")))
    errors = F.when(F.size(missing) > 0, missing).otherwise(F.array_compact(F.array(*bad)))
    kept = F.array_distinct(F.when(F.size(each) == 0, F.array(F.lit(v.none))).otherwise(each))
    kept = F.when(F.array_contains(kept, v.none) & (F.size(kept) > 1), F.array_remove(kept, v.none)).otherwise(kept)
    said = F.array_compact(F.array(*[F.when(fixed[k] != c, F.concat(F.lit(f'{k}: "'), c, F.lit('" -> "'), fixed[k], F.lit('"'))) for k, c in given.items()]))
    valid = F.size(errors) == 0
    return {"valid": valid, "errors": errors, "repairs": F.when(F.size(missing) > 0, F.array().cast("array<string>")).otherwise(said)} | {k: F.when(valid, c) for k, c in fixed.items()} | {"tech": F.when(valid, kept)}


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The score interval of a share; (0, 0) without cases."""
    p = hits / F.greatest(n, F.lit(1))
    d = 1 + z * z / F.greatest(n, F.lit(1))
    mid = (p + z * z / (2 * F.greatest(n, F.lit(1)))) / d
    half = z * F.sqrt((p * (1 - p) + z * z / (4 * F.greatest(n, F.lit(1)))) / F.greatest(n, F.lit(1))) / d
    none = n == 0
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), mid - half)), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), mid + half))
