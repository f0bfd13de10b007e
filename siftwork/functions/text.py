"""Text functions as Column expressions: keys, fingerprints, sentences, chunks, cuts and hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Company suffixes that keys leave out: the audit's list and the longer one of the evaluation sets. Fixed values.
SUFFIXES = "ltd|llc|inc|plc|limited|corp|corporation"
SUFFIXES_EVAL = "ltd|limited|llc|inc|plc|corp|corporation|gmbh"
#: White space as Unicode has it; the plain class of Java is ASCII. Fixed values.
BLANK = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
#: Suffixes that augmentation gives to ids. Fixed values.
FAMILY = "(_dup_\\d+|_con_\\w+|_sal_\\d+|_locvar_\\d+|_trunc_\\d+)$"
DROP_FACTS = ["equal opportunity", "diversity", "inclusion", "privacy policy", "cookies?", "terms and conditions", "how to apply", "apply now", "about the company", "benefits include", "perks", "vision and values"]
KEEP_FACTS = [
    r"£|€|\$|salary|compensation|per annum|p\.?.a\.?.",
    r"\bremote\b|\bhybrid\b|\bon[- ]?site\b|\bin[- ]?office\b",
    r"\blondon\b|\buk\b|\bunited kingdom\b|\bbased in\b",
    r"\bnode(\.js|js)?\b|\breact(\.js|js)?\b|\btypescript\b|\bjavascript\b|\bai\b|\bmachine learning\b|\bml\b",
    r"\bjunior\b|\bgraduate\b|\bentry[- ]?level\b|\bsenior\b|\blead\b|\bstaff\b|\bprincipal\b|\bmanager\b|\bintern(ship)?\b",
    r"\baws\b|\bpython\b|\bjava\b|\bdotnet\b|\bc\+\+\b|\bphp\b|\bruby\b|\bgo(lang)?\b|\bsnowflake\b|\bsql\b",
]


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def clean(c: Column) -> Column:
    """White space of any kind, non-breaking included, to single spaces; trimmed."""
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def key(c: Column) -> Column:
    return clean(F.lower(c))


def company_key(c: Column, suffixes: str = SUFFIXES, dots: bool = False) -> Column:
    dot = "\\.?" if dots else ""
    return clean(F.regexp_replace(F.regexp_replace(F.lower(c), f"\\b({suffixes})\\b{dot}", ""), "[^a-z0-9\\s]", ""))


def pair_key(title: Column, company: Column) -> Column:
    return F.concat_ws("||", F.trim(F.lower(title)), company_key(company))


def fingerprint(text: Column, normalised: bool = True) -> Column:
    head = F.substring(text, 1, 500)
    return F.substring(F.sha2(key(head) if normalised else head, 256), 1, 16)


def content_key(*parts: Column) -> Column:
    return F.concat_ws("|", *[key(p) for p in parts])


def content_hash(title: Column, location: Column, text: Column) -> Column:
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), "\\s+", " "), "[^\\p{L}\\p{N}_\\s]", "")
    return F.md5(F.concat_ws("||", bare(title), bare(location), bare(F.substring(text, 1, 500))))


def family(job_id: Column) -> Column:
    return F.regexp_replace(job_id, FAMILY, "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), "_+", "_"), "^_|_$", "")


def sentences(text: Column) -> Column:
    """Lines, cut after . ! or ? and white space; distinct, in order."""
    lines = F.split(F.trim(F.regexp_replace(text, "\r", "\n")), "\n")
    cut = F.flatten(F.transform(lines, lambda x: F.split(x, "(?<=[.!?])\\s+")))
    return F.array_distinct(F.filter(F.transform(cut, lambda s: F.trim(F.regexp_replace(s, "\\s+", " "))), lambda s: s != ""))


def is_fact(s: Column) -> Column:
    drop = F.rlike(s, F.lit("(?i)" + "|".join(DROP_FACTS)))
    return ~drop & F.rlike(s, F.lit("(?i)" + "|".join(f"(?:{p})" for p in KEEP_FACTS)))


def facts(text: Column, most: int = 28) -> Column:
    return F.array_join(F.slice(F.filter(sentences(text), is_fact), 1, most), "\n")


def first_sentence(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.filter(sentences(text), lambda s: F.rlike(s, F.lit(pattern))), F.lit(1))


def cut(c: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, n - len(mark))), F.lit(mark)))


def tokens_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / 4).cast("long")


def html_artifacts(c: Column) -> Column:
    return F.rlike(c, F.lit(r"(?i)&(amp|lt|gt|nbsp|quot|apos|#\d+);")) | F.rlike(c, F.lit(r"(?i)</?[a-z][\s\S]*?>"))


def letter_share(c: Column, head: int = 500) -> Column:
    """Letters among the first characters."""
    h = F.substring(c, 1, head)
    return F.length(F.regexp_replace(h, "[^\\p{L}]", "")) / F.greatest(F.length(h), F.lit(1))


def word_set(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), "\\s+", " "), "[^\\p{L}\\p{N}_\\s]", "")
    return F.array_distinct(F.filter(F.split(bare, " "), lambda w: w != ""))


def grams(c: Column, n: int = 3, head: int = 500) -> Column:
    h = F.lower(F.substring(c, 1, head))
    return F.when(F.length(h) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(h) - n + 1), lambda i: F.substr(h, i, F.lit(n)))))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _gram_codes(texts: pd.Series) -> pd.Series:
    def codes(t: str | None) -> np.ndarray | None:
        if t is None:
            return None
        c = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64)
        return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])

    return pd.Series([codes(t) for t in texts], dtype="object")


def gram_codes(c: Column) -> Column:
    """The distinct three-grams of the whole lower-case text, ascending; 21 bits a code point, so equal numbers are equal
    grams. In linear time, which substrings at every place of a long text don't have."""
    return _gram_codes(F.lower(c))


def jaccard(a: Column, b: Column) -> Column:
    """0 where either set is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over characters (code points below 2^16)."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, x: (F.bitwise_not(F.bitwise_not(h)).bitwiseXOR(x) * 16777619).bitwiseAND(4294967295))


def clean_location(c: Column) -> Column:
    """Before a pipe, at most three comma parts, at most 90 characters."""
    bare = F.regexp_replace(clean(F.element_at(F.split(c, "\\|"), 1)), "(?i)\\barea,", ",")
    return F.substring(F.array_join(F.slice(F.filter(F.transform(F.split(bare, ","), lambda p: F.trim(p)), lambda p: p != ""), 1, 3), ", "), 1, 90)


def contexts(c: Column, pattern: str, width: int = 50) -> Column:
    """Every match with up to width characters on either side; contexts of near matches overlap."""
    return contexts_between(c, pattern, width, width)


def contexts_between(c: Column, pattern: str, before: int, after: int, most: int | None = None) -> Column:
    """Matches, the first `most` or all, with up to so many characters before and after each."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,n:int>>").alias("out"))

    def step(acc, x):
        s = acc["at"] + F.length(x["p"])
        n = F.length(x["m"])
        return F.struct((s + n).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), n.alias("n")))).alias("out"))

    def placed(found: Column) -> Column:
        got = F.slice(found, 1, most) if most else found
        pieces = F.slice(F.split(c, pattern), 1, F.size(got))
        places = F.aggregate(F.zip_with(pieces, got, lambda p, m: F.struct(p.alias("p"), m.alias("m"))), start, step)["out"]
        return F.transform(places, lambda x: F.substr(c, F.greatest(F.lit(1), x["s"] + 1 - before), x["n"] + after + F.least(x["s"], F.lit(before))))

    return let(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), placed)
