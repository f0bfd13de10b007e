"""Chat examples: templating, serialisation and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENS = ["loc_raw", "loc", "arr_raw", "arr", "sen_raw", "sen", "tech_raw", "tech", "comp_raw", "comp"]


def filled(template: str, values: dict[str, Column]) -> Column:
    """{{name}} replaced literally by a value; a null or missing value is empty."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{{" + k + "}}"), F.coalesce(v, F.lit("")))
    return F.regexp_replace(out, r"\{\{\w+\}\}", "") if not values else out


def serialised(fields: list[Column]) -> Column:
    """A JSON object in the order given, nulls kept."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def example(system: str, user: Column, assistant: Column) -> Column:
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", user), turn("assistant", assistant))


def message(messages: Column, role: str) -> Column:
    """The first message of a role."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(1))["content"]


def after_thought(text: Column) -> Column:
    return F.trim(F.element_at(F.split(text, "</think>"), -1))


def collected(turns: DataFrame) -> DataFrame:
    """Conversations as arrays of turns in order. A conversation is as long as its turns and is one row."""
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))


def variant(job_id: Column, share: float, seed: int) -> Column:
    """Whether a row falls into the share by hash."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), job_id)), 1, 8), 16, 10).cast("double") / 2.0**32 < share
