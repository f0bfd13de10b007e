"""Repair of model outputs, text preprocessing and truncation around protected passages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.functions import tokens
from siftwork.functions.text import let

SHAPE = "loc string, arr string, sen string, tech array<string>, comp string, loc_raw string, arr_raw string, sen_raw string, tech_raw string, comp_raw string"


def without_thought(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>\s*", ""), r"^Thinking:.*\n", "")


def fixed_text(c: Column) -> Column:
    """Fences off; keys quoted after { and commas."""
    bare = F.trim(F.regexp_replace(F.trim(c), "```(?:json)?", ""))
    first = F.regexp_replace(F.regexp_replace(bare, r'\{\s*(\w+)":', r'{"$1":'), r"\{\s*(\w+):", r'{"$1":')
    return F.regexp_replace(first, r",\s*(\w+):", r',"$1":')


def closed(c: Column) -> Column:
    """A truncated object with its string, tech array and braces closed."""
    quotes = F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))
    one = F.when(quotes % 2 != 0, F.concat(c, F.lit('"'))).otherwise(c)
    tail = F.element_at(F.split(one, '"tech"'), -1)
    count = lambda ch: F.length(tail) - F.length(F.replace(tail, F.lit(ch), F.lit("")))
    two = F.when(one.contains('"tech"') & (count("[") > count("]")), F.concat(one, F.lit("]"))).otherwise(one)
    return F.concat(two, F.lit("}"))


def parsed(c: Column, shape: str = SHAPE) -> Column:
    """The first of three readings that is an object: as it stands, from the first to the last brace, closed. Else null."""
    whole = lambda x: F.when(F.try_parse_json(x).isNotNull() & F.rlike(x, F.lit(r"^\s*\{")), F.from_json(x, shape))

    def read(text: Column) -> Column:
        inner = F.regexp_extract(text, r"\{[\s\S]*\}", 0)
        rest = let(F.regexp_extract(text, r"\{[\s\S]*", 0), closed)
        return F.coalesce(let(text, whole), let(inner, whole), let(rest, whole))

    return let(fixed_text(c), read)


def salvaged(c: Column, fields: list[str], closed: bool = False) -> Column:
    """Fields by regex where the text is no JSON; null unless all are there."""
    got = {f: F.nullif(F.regexp_extract(c, rf'"{f}"\s*:\s*"([^"]*)"', 1), F.lit("")) for f in fields}
    listed = F.regexp_extract(c, r'"tech"\s*:\s*\[([^\]]*)' + (r"\]" if closed else ""), 1)
    tech = F.regexp_extract_all(listed, F.lit(r'"([^"]*)"'), F.lit(1))
    ok = F.size(tech) > 0
    for v in got.values():
        ok = ok & v.isNotNull()
    return F.when(ok, F.struct(*[v.alias(k) for k, v in got.items()], tech.alias("tech")))


def by_vocabulary(c: Column, names: dict[str, list[str]]) -> dict[str, Column]:
    """The first token of each vocabulary that the upper-case text contains; for tech all, OOS only alone."""
    up = F.upper(c)
    out = {}
    for f, vocab in names.items():
        held = F.filter(F.array(*[F.lit(t) for t in vocab]), lambda t: F.contains(up, t))
        out[f] = held if f == "tech" else F.try_element_at(held, F.lit(1))
    if "tech" in out:
        t = out["tech"]
        out["tech"] = F.when(F.size(t) > 1, F.array_remove(t, "OOS")).otherwise(t)
    return out


#: Headers of passages that say nothing about a job; they and all that follows go. Fixed values.
BOILERPLATE = [
    r"equal\s+opportunity\s+(?:employer|statement)",
    r"diversity\s+(?:and|&)\s+inclusion",
    r"(?:our\s+)?commitment\s+to\s+(?:diversity|inclusion|equity)",
    r"we\s+are\s+an?\s+equal\s+opportunity",
    r"cookie\s+(?:policy|notice|consent)",
    r"privacy\s+(?:policy|notice|statement)",
    r"data\s+(?:protection|privacy)\s+(?:notice|statement|policy)",
    r"a\s+note\s+on\s+(?:using\s+)?(?:ai|artificial\s+intelligence)",
    r"(?:use\s+of\s+)?artificial\s+intelligence\s+(?:in\s+(?:our|the)\s+)?(?:hiring|recruitment|application)",
]


@F.pandas_udf(T.StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    import html

    return texts.map(lambda t: None if t is None else html.unescape(t))


def preprocessed(c: Column) -> Column:
    """Entities decoded, odd blanks and zero-width characters out, boilerplate cut, white space tidied. Idempotent."""
    t = F.coalesce(F.when(c.contains("&"), _unescaped(c)).otherwise(c), F.lit(""))
    t = F.regexp_replace(F.translate(t, " ​‌‍﻿", " "), "\r\n?", "\n")
    t = F.regexp_replace(t, r"(?is)(?:^|\n)\s*(?:#{1,3}\s*)?(?:" + "|".join(BOILERPLATE) + ").*", "")
    t = F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), "[^\\S\n]+", " ")
    return F.trim(F.array_join(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), "\n"))


def cascade(df: DataFrame, raw_col: str) -> DataFrame:
    """df with status (ok, invalid_token, parse_fail) and the tokens of an output: parsed, or where that fails salvaged
    field by field; validated, or where that fails salvaged. Each step is a projection, so it is made once."""
    shape = "struct<loc: string, arr: string, sen: string, tech: array<string>, comp: string>"
    plain = lambda c: F.when(F.col(c).isNotNull(), F.struct(*[F.col(f"{c}.{f}").alias(f) for f in tokens.FIELDS]).cast(shape))

    def checked(c: str) -> Column:
        said = tokens.validated(*[F.col(f"{c}.{f}") for f in tokens.FIELDS])
        return F.struct(F.coalesce(said["valid"], F.lit(False)).alias("valid"), *[said[f].alias(f) for f in tokens.FIELDS])

    out = df.withColumn("_text", without_thought(F.col(raw_col)))
    out = out.withColumns({"_got": parsed(F.col("_text")), "_spare": salvaged(F.col("_text"), ["loc", "arr", "sen", "comp"])})
    out = out.withColumns({"_got": plain("_got"), "_spare": plain("_spare")})
    out = out.withColumns({"_first": F.coalesce("_got", "_spare")}).withColumns({"_own": checked("_first"), "_back": checked("_spare")})
    status = F.when(F.col("_first").isNull(), "parse_fail").when(F.col("_own.valid") | F.col("_back.valid"), "ok").otherwise("invalid_token")
    fields = {f: F.when(F.col("_own.valid"), F.col(f"_own.{f}")).when(F.col("_back.valid"), F.col(f"_back.{f}")) for f in tokens.FIELDS}
    return out.withColumns({"status": status, **fields}).drop("_text", "_got", "_spare", "_first", "_own", "_back")
