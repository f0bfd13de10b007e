"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Each rule is an expression on the text and what is derived from it once for all rules: its words and their number. A
sample of all partitions gives every rule's cost (time to evaluate it, less that of an empty rule) and selectivity (which
sample rows it rejects); the cascade tests rules by rejection per cost, each judged on the rows that those before it let
pass, and a rejected row skips the rest. The order moves cost only: the verdict is the conjunction of all rules whatever
the order. keep() evaluates nothing but the cascade; cascade() returns the counts of the base rules, so there only what
the counts don't give is left to skip.

Nulls count as empty texts, which the word-count rule rejects; extra columns are kept by keep() and ignored by measures().
Repeated rows get equal answers; an empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm._shared import scratched

GAP = "[\\x20\\x09-\\x0D]+"
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, although body may use it for every element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def repeated_words(ws: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of width words, a power of two, found twice or more in the same text."""

    def covered(starts: Column) -> Column:
        """Union of the windows at these starts (ascending)."""
        return F.aggregate(
            F.transform(starts, lambda p, k: F.when(k + 1 < F.size(starts), F.least(F.lit(width), F.get(starts, k + 1) - p)).otherwise(width)),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        )

    def doubles(pairs: Column) -> Column:
        same = lambda p, i: F.coalesce(F.get(pairs, i)["h"] == p["h"], F.lit(False))
        return let(F.sort_array(F.transform(F.filter(pairs, lambda p, i: ((i > 0) & same(p, F.greatest(i - 1, F.lit(0)))) | same(p, i + 1)), lambda p: p["i"])), covered)

    def of_windows(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), doubles))

    def doubled(h: Column, n: int) -> Column:
        """Of hashes of runs of n words, those of runs of 2 n; the last n are of the runs that the text's end cuts."""
        return F.zip_with(h, F.slice(h, n + 1, F.greatest(F.size(h) - n, F.lit(0))), lambda a, b: F.xxhash64(a, b))

    def of_hashes(h: Column, n: int = 1) -> Column:
        if n == width:
            return let(F.slice(h, 1, F.size(h) - width + 1), of_windows)
        return let(doubled(h, n), lambda x: of_hashes(x, 2 * n))

    return F.when(F.size(ws) < width, F.lit(0).cast("long")).otherwise(let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: of_hashes(h)))


def word_chars(text: Column) -> Column:
    return F.length(text) - F.regexp_count(text, F.lit("[\\x20\\x09-\\x0D]"))


def symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[#*$%&|<>]"))


def same_lines(text: Column) -> Column:
    own = lambda ls: let(F.filter(ls, lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]"))), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return let(F.split(text, "\n"), lambda ls: F.when(F.size(F.array_distinct(ls)) == F.size(ls), 0).otherwise(own(ls)))


def upper(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\\p{Lu}"))


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, words, and the counts that the base rules read, for every row; and the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = df.select(F.col(id_col).alias("doc_id"), text.alias("text"), words(text).alias("ws"))
    return split.select(
        "doc_id",
        "text",
        F.size("ws").cast("long").alias("n_words"),
        word_chars(F.col("text")).cast("long").alias("word_chars"),
        symbols(F.col("text")).cast("long").alias("n_symbols"),
        same_lines(F.col("text")).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("ws")).alias("n_repeat_words"),
    )


@dataclass(frozen=True)
class Rule:
    """rejects(t): t["text"], t["ws"] (words), t["n"] (their number) and the counts, to a Boolean."""

    name: str
    rejects: Callable[[dict[str, Column]], Column]


def base_rules() -> list[Rule]:
    return [
        Rule("few_words", lambda t: t["n"] < 20),
        Rule("repeats", lambda t: 100 * t["n_repeat_words"] > 30 * t["n"]),
    ]


def method_rules() -> list[Rule]:
    """Rules beside the two base ones; each names a kind of text that is not prose, far from what clean texts reach."""
    return [
        Rule("symbols", lambda t: 100 * t["n_symbols"] > 30 * t["n"]),
        Rule("shouting", lambda t: 100 * t["n_upper"] > 40 * t["word_chars"]),
        Rule("word_length", lambda t: (t["word_chars"] < 2 * t["n"]) | (t["word_chars"] > 25 * t["n"])),
        Rule("same_lines", lambda t: 100 * t["n_dup_lines"] > 30 * t["n"]),
    ]


class _Counts(dict):
    """The counts of a text, as expressions made when a rule asks for them."""

    def __missing__(self, name: str) -> Column:
        made = {"word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": same_lines, "n_upper": upper}
        self[name] = repeated_words(self["ws"]) if name == "n_repeat_words" else made[name](self["text"])
        return self[name]


def _verdict(text: Column, says: Callable[[_Counts], Column]) -> Column:
    """says of a text, its words split once."""
    return let(words(text), lambda ws: let(F.size(ws), lambda n: says(_Counts(text=text, ws=ws, n=n))))


#: Rows of the sample, about, and how often a rule is timed on it.
SAMPLE, TIMES = 1000, 2


def sampled(df: DataFrame, text_col: str = "text", rows: int = SAMPLE) -> DataFrame:
    """About `rows` texts from all partitions, as column text."""
    total = df.count()
    return df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).sample(False, min(1.0, rows / max(total, 1)), 11)


def ordered(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Rules by rejections per second on a sample (column text), best first, each on the rows that those before it let
    pass. It sets the order, so it moves the cost and never a verdict."""
    if not rules:
        return []
    with scratched(sample.sparkSession) as keep:
        texts = keep(sample.coalesce(1))

        def seconds(says: Callable[[_Counts], Column]) -> float:
            took = []
            for _ in range(TIMES):
                began = time.perf_counter()
                texts.agg(F.count(F.when(_verdict(F.col("text"), says), 1))).first()
                took.append(time.perf_counter() - began)
            return min(took)

        said = texts.select(*[F.coalesce(_verdict(F.col("text"), r.rejects), F.lit(False)).alias(r.name) for r in rules]).collect()
        none = seconds(lambda t: t["n"] < 0)
        cost = {r.name: max(seconds(r.rejects) - none, 1e-4) for r in rules}
    left, out, todo = said, [], sorted(rules, key=lambda r: (cost[r.name], r.name))
    while todo:
        best = max(todo, key=lambda r: sum(x[r.name] for x in left) / cost[r.name])
        out.append(best)
        todo.remove(best)
        left = [x for x in left if not x[best.name]]
    return out


def rejected(rules: list[Rule], t: dict[str, Column]) -> Column:
    """One CASE that stops at the first rule that rejects."""
    out = None
    for r in rules:
        hit = F.coalesce(r.rejects(t), F.lit(False))
        out = F.when(hit, True) if out is None else out.when(hit, True)
    return F.lit(False) if out is None else out.otherwise(False)


def cascade(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE) -> DataFrame:
    """measures() with base_failed and kept for every row."""
    order = ordered(sampled(df, text_col, rows), [*base_rules(), *method_rules()])
    counts = _Counts(text=F.col("text"), n=F.col("n_words"), **{c: F.col(c) for c in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")})
    return measures(df, id_col, text_col).select("*", rejected(base_rules(), counts).alias("base_failed"), (~rejected(order, counts)).alias("kept")).drop("text")


def keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE) -> DataFrame:
    """The rows of df that no rule rejects, columns as they came. No shuffle: the verdict is an expression on the row."""
    order = ordered(sampled(df, text_col, rows), [*base_rules(), *method_rules()])
    return df.where(~_verdict(F.coalesce(F.col(text_col), F.lit("")), lambda t: rejected(order, t)))
