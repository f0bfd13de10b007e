"""Deterministic sampling: shuffles by hash, stratified and balanced samples, splits, caps and oversampling.

A shuffle's order is md5(seed|id), equal on any cluster and any partitioning. Allocations are arithmetic on the small
table of strata; rows take part through a rank within their stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Leading digits of a hash by which a stratum is cut for ranking.
DIGITS = 3


def shuffled(seed: int, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))


def half_up(x: float) -> int:
    return int(x + 0.5)


def proportional(sizes: dict[str, int], count: int) -> dict[str, int]:
    """At least one each, in proportion, then moved by one at a time to the exact total."""
    total = sum(sizes.values())
    got = {k: min(n, max(1, half_up(n / total * count))) for k, n in sizes.items() if n}
    while sum(got.values()) > count:
        k = max(got, key=lambda x: (got[x], list(got).index(x)))
        if got[k] <= 1:
            break
        got[k] -= 1
    while sum(got.values()) < min(count, total):
        k = max(got, key=lambda x: (sizes[x] - got[x], list(got).index(x)))
        if sizes[k] <= got[k]:
            break
        got[k] += 1
    return got


def balanced(sizes: dict[str, int], count: int) -> dict[str, int]:
    """Equal shares, the remainder to the first strata; what a stratum lacks is not given to others."""
    base, extra = divmod(count, max(1, len(sizes)))
    return {k: min(n, base + (1 if i < extra else 0)) for i, (k, n) in enumerate(sizes.items())}


def sizes_of(df: DataFrame, stratum: str, order: list[str]) -> dict[str, int]:
    found = {r[0]: r[1] for r in df.where(F.col(stratum).isin(order)).groupBy(stratum).count().collect()}
    return {k: found.get(k, 0) for k in order}


def hash_ranked(df: DataFrame, by: list[str], key: Column, name: str = "rn", size: str | None = None) -> DataFrame:
    """df with each row's rank in its stratum by key, hex digits spread evenly; size, if given, names the stratum's size.

    Rows are counted by stratum and the key's first DIGITS digits, ranks begin after the counts of smaller digits, and only
    rows of equal digits are sorted together, so a stratum that holds most rows is many tasks' work. The table of counts
    has 16 ** DIGITS rows a stratum at most.
    """
    cut = df.withColumn("_key", key).withColumn("_cut", F.substring("_key", 1, DIGITS))
    counts = cut.groupBy(*by, "_cut").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*by).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(b).alias(f"_b_{k}") for k, b in enumerate(by)], F.col("_cut").alias("_d"), F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy(*by)).alias("_size"))
    same = F.col("_cut") == F.col("_d")
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_b_{k}"))
    own = F.row_number().over(Window.partitionBy(*by, "_cut").orderBy("_key"))
    out = cut.join(before, same).withColumn(name, (F.col("_before") + own).cast("int"))
    if size:
        out = out.withColumn(size, F.col("_size"))
    return out.drop("_key", "_cut", "_d", "_before", "_size", *[f"_b_{k}" for k in range(len(by))])


def ranked(df: DataFrame, by: list[str], *order: Column, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def take(df: DataFrame, stratum: str, quota: dict[str, int], *order: Column) -> DataFrame:
    """The first rows of each stratum, as many as its quota says. Rows beyond the largest quota leave before they are moved."""
    wanted = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in quota.items() for x in kv]), F.col(stratum)), F.lit(0))
    most = max(quota.values(), default=0)
    return ranked(df, [stratum], *order, name="_rn").where((F.col("_rn") <= most) & (F.col("_rn") <= wanted)).drop("_rn")


def stratified(df: DataFrame, stratum: str, order: list[str], count: int, seed: int, id_col: str, equal: bool = False) -> DataFrame:
    quota = (balanced if equal else proportional)(sizes_of(df, stratum, order), count)
    wanted = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in quota.items() for x in kv]), F.col(stratum)), F.lit(0))
    return hash_ranked(df, [stratum], shuffled(seed, id_col), "_rn").where(F.col("_rn") <= wanted).drop("_rn")


def split(df: DataFrame, by: list[str], share: float, seed: int, id_col: str) -> DataFrame:
    """part: valid for the first max(1, round(n * share)) of each stratum in shuffled order, else train."""
    r = hash_ranked(df, by, shuffled(seed, id_col), "rn", "_n")
    return r.withColumn("part", F.when(F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share + 0.5)), "valid").otherwise("train")).drop("rn", "_n")


def split_three(df: DataFrame, by: list[str], seed: int, id_col: str, train: float = 0.6, valid: float = 0.2) -> DataFrame:
    """60 / 20 / 20 in each stratum; strata of fewer than three rows go to train."""
    r = hash_ranked(df, by, shuffled(seed, id_col), "rn", "_n")
    n = F.col("_n")
    a = F.floor(n * train)
    b = a + F.floor(n * valid)
    return r.withColumn("part", F.when((n < 3) | (F.col("rn") <= a), "train").when(F.col("rn") <= b, "valid").otherwise("test")).drop("rn", "_n")


def oversampled(df: DataFrame, by: str, goal: int, key: Column) -> DataFrame:
    """Each stratum, in the order of key, hex digits spread evenly, repeated round-robin up to goal rows: copy counts from 0."""
    r = hash_ranked(df, [by], key, "rn", "_n")
    extra = F.floor((F.lit(goal) - F.col("rn")) / F.col("_n"))
    return r.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), extra).cast("int")))).drop("rn", "_n")


def capped(df: DataFrame, by: str, caps: dict[str, int], default: int, *order: Column) -> DataFrame:
    cap = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col(by)), F.lit(default)) if caps else F.lit(default)
    return ranked(df, [by], *order, name="_rn").where(F.col("_rn") <= cap).drop("_rn")


def coupled(df: DataFrame, room: dict[str, dict[str, int]], key: Column) -> DataFrame:
    """The rows that one pass in order of key, unique hex digits, takes: those whose capped tokens all have room left. Only
    rows taken use room; tokens that room[column] does not name are free.

    A token that is full stays full, so the pass comes down to a last key for each. The driver sees counts by combination
    and the key's first two digits, and the rows of a slice in which a token gets full: no more slices than capped tokens.
    """
    fields = list(room)
    keyed = df.select(*fields, key.alias("_k"))
    left = {(f, t): n for f in fields for t, n in room[f].items()}
    last = {x: "" for x, n in left.items() if n <= 0}
    slices: dict[str, list[tuple[tuple, int]]] = {}
    for r in keyed.groupBy(F.substring("_k", 1, 2).alias("_s"), *fields).agg(F.count("*").alias("_n")).collect():
        slices.setdefault(r["_s"], []).append(([(f, r[f]) for f in fields], r["_n"]))
    for s in sorted(slices):
        need: dict[tuple, int] = {}
        for tokens, n in slices[s]:
            if not any(x in last for x in tokens):
                for x in tokens:
                    need[x] = need.get(x, 0) + n
        if all(n < left[x] for x, n in need.items() if x in left):
            for x, n in need.items():
                if x in left:
                    left[x] -= n
            continue
        for r in sorted(keyed.where(F.col("_k").startswith(s)).collect(), key=lambda r: r["_k"]):
            tokens = [(f, r[f]) for f in fields]
            if any(x in last for x in tokens):
                continue
            for x in tokens:
                if x in left:
                    left[x] -= 1
                    if not left[x]:
                        last[x] = r["_k"]
    for (f, t), k in last.items():
        df = df.where(~F.col(f).eqNullSafe(F.lit(t)) | (key <= k))
    return df
