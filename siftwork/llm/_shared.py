"""Helpers that the training-data operators share: input, shared scratch tables, byte hashing and connected components."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python hold at most this many bytes of text, so memory follows this and the longest text.
BATCH_BYTES = 4 << 20
U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def only(df: DataFrame, *cols: str, text: str | None = None) -> DataFrame:
    """The named columns alone (extra ones, clashing or not, go); a null text becomes the empty string."""
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c == text else F.col(c) for c in cols])


_left: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession) -> str:
    """A fresh path under the folder that the cluster shares, spark.checkpoint.dir. Where it is unset, a local session (as
    in tests) gets one of its own; a cluster's executors share no other folder, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df written once as a table in the shared folder and read back: its lineage is cut, and losing executors loses none of
    it. cleared() deletes it; what is left at the end of the session, results that were still to be read, goes then."""
    spark = df.sparkSession
    path = scratch(spark)
    _left.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cleared(spark: SparkSession, *frames: DataFrame) -> None:
    """Drops tables that settled() wrote, once nothing that is still to run reads them."""
    known = {path.rsplit("/", 1)[1]: k for k, (_, path) in enumerate(_left)}
    gone = set()
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            k = known.get(folder.rsplit("/", 1)[1])
            if k is not None:
                _delete(spark, _left[k][1])
                gone.add(k)
    _left[:] = [x for k, x in enumerate(_left) if k not in gone]


@contextmanager
def scratched(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """settled, whose tables all go at the end of the block, failed or not."""
    own: list[str] = []

    def write(df: DataFrame) -> DataFrame:
        before = len(_left)
        out = settled(df)
        own.extend(path for _, path in _left[before:])
        return out

    try:
        yield write
    finally:
        for path in own:
            if any(path == p for _, p in _left):
                _delete(spark, path)
        _left[:] = [x for x in _left if x[1] not in own]


@atexit.register
def _at_exit() -> None:
    for spark, path in _left:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


def released() -> None:
    """Gives memory that is free in this process back to the machine; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about so many bytes at most, a single longer row excepted."""
    for b in batches:
        n = max(1, b.num_rows * most // max(b.nbytes, most))
        for i in range(0, b.num_rows, n):
            yield b.slice(i, n)


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """fn over Arrow batches of bounded size."""

    def run(batches):
        for b in sliced(batches):
            out = fn(b)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes, joined, and the offsets of its rows (one more than rows); nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_ODD = U64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=U64) * _ODD)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(out, out=out)
    return out


def words_of(raw: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of every row, cut at ASCII white space: starts and ends in raw, 64-bit hashes, and each row's first word (one more than rows).

    A row's end cuts as white space does. Hashes are polynomials over randomised bytes, mixed with the length.
    """
    n = len(raw)
    gap = np.ones(n + 1, bool)
    gap[:n] = _SPACE[raw]
    before = np.ones(n + 1, bool)
    before[1:] = gap[:-1]
    before[at] = True  # a row's first byte follows a cut
    starts = np.flatnonzero(~gap & before)
    after = np.ones(n + 1, bool)
    after[:-1] = gap[1:]
    inner = at[(at > 0)] - 1
    after[inner] = True  # a row's last byte precedes one
    ends = np.flatnonzero(~gap & after) + 1
    return starts, ends, _word_hashes(raw, starts, ends, lower), np.searchsorted(starts, at)


_BASE = 0xD6E8FEB86659FD93
#: Bytes whose sums are held at once; a longer word is held whole.
_SPAN = 1 << 19
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + _SPAN, "right")))
        n = int(ends[j - 1]) - lo
        size = max(_SPAN, n)
        if size not in _powers:
            _powers.clear()
            _powers[size] = powers(size, _BASE), powers(size, pow(_BASE, -1, 1 << 64))
        up, down = _powers[size]
        part = raw[lo : lo + n]
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, U64)
            np.cumsum(_BYTE[_LOWER[part] if lower else part] * up[:n], out=sums[1:])
            a, b = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U64) * _ODD)
        i = j
    return out


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width consecutive hashes; runs over the end of a row are the caller's to leave out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, U64)
        for i in range(width):
            out *= U64(0xA0761D6478BD642F)
            out += hashes[i : i + n]
        return mix(out)


def whole_runs(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the n runs that rolled() makes lie within one row; first: each row's first item, one more than rows."""
    ok = np.zeros(max(0, n), bool)
    size = np.diff(first)
    for a, b in zip(first[:-1][size >= width], (first[1:] - width + 1)[size >= width], strict=True):
        ok[a:b] = True
    return ok


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the edges (a, b) reaches. Large-star and small-star, alternating
    until a round changes nothing, however many it takes. The result is a settled table.

    A node's least neighbour is a partial aggregate, written before it is joined with the node's edges: both sides of the
    join are then shuffled for it, and a hub's edges can be split among tasks. Every round is written to the shared folder.
    Self-links and nulls are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    with scratched(spark) as keep:
        now = keep(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        mark = None
        while True:
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
            large = keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
            cleared(spark, now, least)
            # each node's smaller neighbours and the node itself point to the smallest of them
            down = keep(large.groupBy("u").agg(F.min("v").alias("m")))
            now = keep(large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
            cleared(spark, large, down)
            found = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if found == mark:
                break
            mark = found
        ends = now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")))
        return settled(ends.groupBy("node").agg(F.min("label").alias("label")))


def _count_below(bounds: list, key) -> F.Column:
    """How many of the sorted bounds are at or below key; two levels, so a row looks at about twice their root."""
    if not bounds:
        return F.lit(0)
    g = max(1, int(len(bounds) ** 0.5))
    every = F.array(*[F.lit(b) for b in bounds])
    coarse = F.array(*[F.lit(b) for b in bounds[::g]])
    block = F.coalesce(F.size(F.filter(coarse, lambda b: b <= key)), F.lit(0))
    fine = F.size(F.filter(F.slice(every, F.greatest(block - 1, F.lit(0)) * g + 1, g), lambda b: b <= key))
    return F.when(key.isNull() | (block == 0), F.lit(0)).otherwise((block - 1) * g + fine)


#: Bytes of a slice, about, up to so many slices; beyond, slices grow, and tasks stream through them.
SLICE, SLICES = 4 << 20, 20_000


def sorted_slices(rows: DataFrame, text: str, n: int | None = None) -> DataFrame:
    """rows in contiguous slices by their column key (nulls first, rows of one key by text), each slice in order within one
    partition and with its neighbours at its ends: columns slice and edge before those of rows. edge is -1 for the last
    rows before the slice, 0 for its own and 1 for the first rows after it; the table is a ring, so the last slice is
    followed by the first. Rows of one key share a slice.

    Slices hold about SLICE bytes of text, so there are as many as the data need, and a task has a few. The borders come
    from a sample of about 50 keys a slice; they move rows between tasks and no result. The driver sees those keys and two
    more for each slice, of SLICES slices at most.
    """
    spark = rows.sparkSession
    keys = rows.select("key")
    total, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    n = n or max(2 * least, min(SLICES, -(-size // SLICE)))
    every = max(1, total // (50 * n))
    some = sorted(r.key for r in keys.where(F.col("key").isNotNull() & (F.pmod(F.xxhash64("key"), F.lit(every)) == 0)).distinct().collect())
    bounds = sorted({some[k * len(some) // n] for k in range(1, n)}) if len(some) > 1 else []
    own = _count_below(bounds, F.col("key"))
    k = F.struct(F.col("key").isNotNull().alias("has"), "key")
    ends = keys.select(own.alias("slice"), k.alias("k")).groupBy("slice").agg(F.min("k").alias("a"), F.max("k").alias("z")).orderBy("slice").collect()
    moved: dict = {}
    for j, x in enumerate(ends):
        moved.setdefault(x.a.key, []).append((ends[j - 1].slice, 1))
        moved.setdefault(x.z.key, []).append((ends[(j + 1) % len(ends)].slice, -1))
    kind = "array<struct<slice: int, edge: int>>"
    place = lambda pairs: F.array(*[F.struct(F.lit(s).cast("int").alias("slice"), F.lit(e).cast("int").alias("edge")) for s, e in pairs]).cast(kind)
    none = F.array().cast(kind)
    also = none
    if named := {key: p for key, p in moved.items() if key is not None}:
        # a map is searched in full for each row, so rows first look whether their key is near the end of a slice at all
        by_key = F.create_map(*[y for key, p in named.items() for y in (F.lit(key), place(p))])
        also = F.when(F.col("key").isin(list(named)), F.coalesce(F.try_element_at(by_key, F.col("key")), none)).otherwise(none)
    if None in moved:
        also = F.when(F.col("key").isNull(), place(moved[None])).otherwise(also)
    places = F.concat(F.array(F.struct(own.cast("int").alias("slice"), F.lit(0).alias("edge"))).cast(kind), also)
    return rows.select(F.explode(places).alias("_p"), "*").select("_p.slice", "_p.edge", *rows.columns).repartition(max(least, n // 2), "slice").sortWithinPartitions("slice", "edge", "key", text)
