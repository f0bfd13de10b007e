"""Mixing sources to target weights by pivotal dependent rounding.

Sources, by code point with null last, weigh 1, 2, 3, 1, ... and share the words of all documents. A source's target stops
at CAP times its size; the excess is shared out by weight until none is above. Each document of a source is to be copied
target / size times: the whole part is taken, and the fractions are rounded by pairs. In a pair, words move from one
document's fraction to the other's, in a random direction with chances that keep both expectations, until one fraction is
0 or 1; the other goes on to the next document. A pair keeps the sum of its words, so a source misses its target by what
the last rounding moves, half a document at most.

Blocks of about BLOCK documents are rounded first, larger documents before smaller ones, and leave one residual each;
residuals meet in blocks again, FAN blocks in each, until a source has one: a reduction tree of tasks. Blocks and chances
come from hashes of ids and sizes, so reruns agree.

Nulls: a null text has size 0, a null source is a source, a null id is an id. Documents of size 0 are taken for the whole
part only. Rows of one id, source and size are rounded each on its own. Empty tables give empty results; other columns
are ignored by plan() and kept by mix().
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.llm._shared import mix as mixed_bits
from siftwork.llm._shared import cleared, settled

CAP = 3
WEIGHTS = (1, 2, 3)
BLOCK, FAN = 4096, 256
DRAWS = 32
SALTS = 16


def size_of(text: Column) -> Column:
    """Words between ASCII white space; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """For (source, size) rows: source, source_size, n, target. The driver sees sums only."""
    spark = sizes.sparkSession
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    in_order = per.sort(F.col("source").asc_nulls_last())
    schema = T.StructType([*in_order.schema.fields, T.StructField("weight", T.DoubleType())])
    ranked = settled(spark.createDataFrame(in_order.rdd.zipWithIndex().map(lambda x: (*x[0], float(WEIGHTS[x[1] % len(WEIGHTS)]))), schema))
    cap = F.col("source_size") * float(CAP)
    total, weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    share = total / weight if weight else 0.0
    while True:
        full = cap < F.col("weight") * share
        capped, free = ranked.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if not free or (new := (total - capped) / free) <= share * (1 + 1e-15):
            break
        share = new
    return ranked.select("source", "source_size", "n", F.least(cap, F.col("weight") * share).alias("target"))


def pivot(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> int | None:
    """Rounds p in place, in the order given, keeping sum(size * p). The position of the one that is left, if any."""
    tiny = 1e-9
    snap = lambda x: 0.0 if x < tiny else 1.0 if x > 1 - tiny else x
    chance = rng.random(len(p))
    held = None
    for j in range(len(p)):
        p[j] = snap(p[j])
        if p[j] in (0.0, 1.0):
            continue
        if held is None:
            held = j
            continue
        i = held
        up = min((1 - p[i]) * size[i], p[j] * size[j])
        down = min(p[i] * size[i], (1 - p[j]) * size[j])
        move = up if chance[j] * (up + down) < down else -down
        p[i] = snap(p[i] + move / size[i])
        p[j] = snap(p[j] - move / size[j])
        held = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else None
    return held


def _rounded(seed: int, level: int):
    """Rounds one block, drawing anew, up to DRAWS times, until the fraction that is left over is worth less than a
    thousandth of the block's words. Every block does, so a source's draws depend on no other source and no size."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tie = mixed_bits(rows["h"].to_numpy(np.int64).astype(np.uint64))
        order = np.lexsort((tie, -rows["size"].to_numpy()))
        rows = rows.iloc[order].reset_index(drop=True)
        size, given = rows["size"].to_numpy(float), rows["p"].to_numpy(float)
        rng = np.random.default_rng([seed, level, len(rows), *(int(x) & 0xFFFFFFFF for x in rows["h"].to_numpy()[:2])])
        best = None
        for _ in range(DRAWS):
            p = given.copy()
            held = pivot(size, p, rng)
            off = 0.0 if held is None else min(p[held], 1 - p[held]) * size[held]
            if best is None or off < best[0]:
                best = (off, p, held)
            if off <= size.sum() / 1000:
                break
        _, p, held = best
        left = np.zeros(len(rows), bool)
        if held is not None:
            left[held] = True
        rows["p"] = p
        rows["left"] = left
        return rows

    return run


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """A row for each row of df: id, source, size, source_size, target (its source's) and copies."""
    docs = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size"))
    docs = written = settled(docs)
    goal = targets(docs)
    goal_tables = [goal]
    salted = goal.select(F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("source").alias("s"), "source_size", "n", "target")
    h = F.xxhash64("id", "size", F.lit(seed))
    docs = docs.select("id", "source", "size", h.alias("h"), F.pmod(F.xxhash64("id", F.lit("salt")), F.lit(SALTS)).cast("int").alias("salt"))
    rows = docs.join(salted, (docs.salt == salted.salt) & docs.source.eqNullSafe(F.col("s"))).drop("salt", "s")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    part = wanted - F.floor(wanted)
    rows = rows.select(
        "id", "source", "size", "source_size", "target", "h", F.floor(wanted).cast("int").alias("whole"),
        F.when(F.col("size") > 0, part).otherwise(F.lit(0.0)).alias("p"),
        F.pmod(F.xxhash64("h"), F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK))).alias("block"),
    )
    schema = T.StructType([*rows.schema.fields, T.StructField("left", T.BooleanType())])
    most = goal.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    blocks, level, done, now = -(-most // BLOCK), 0, [], rows
    while True:
        out = settled(now.groupBy("source", "block").applyInPandas(_rounded(seed, level), schema))
        done.append(out.where("not left"))
        if blocks <= 1:
            break
        blocks, level = -(-blocks // FAN), level + 1
        now = out.where("left").withColumn("block", F.floor(F.col("block") / FAN).cast("long")).drop("left")
    done.append(out.where("left"))
    cleared(df.sparkSession, written, *goal_tables)
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    # what a source has left in the end, one document at most, goes to the nearer side
    return every.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("whole") + F.when(F.col("p") >= 0.5, 1).otherwise(0)).alias("copies"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """The mix: every row of df as often as plan() copies it, columns as they came."""
    got = plan(df, id_col, text_col, source_col, seed).groupBy(F.col(id_col).alias("_i"), F.col("source").alias("_s"), F.col("size").alias("_z")).agg(F.sum("copies").alias("_c"), F.count("*").alias("_n"))
    got = got.where("_c > 0")
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_src"), size_of(F.col(text_col)).alias("_size"))
    met = rows.join(got, F.col("_id").eqNullSafe(F.col("_i")) & F.col("_src").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")))
    single = F.col("_n") == 1
    turn = F.row_number().over(Window.partitionBy("_i", "_s", "_z").orderBy(F.xxhash64("_row")))
    copies = F.when(single, F.col("_c")).otherwise(F.floor(F.col("_c") / F.col("_n")) + F.when(turn <= F.col("_c") % F.col("_n"), 1).otherwise(0))
    return met.select("_row", copies.cast("int").alias("_k")).where("_k > 0").select(F.explode(F.array_repeat("_row", F.col("_k"))).alias("_row")).select("_row.*")


def digest(df: DataFrame) -> DataFrame:
    """The columns of query op3."""
    return plan(df).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
