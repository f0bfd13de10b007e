"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard on full shingle sets.

A document's set holds the hashes of its distinct runs of four words. Two permutations make the whole signature. The
first, mix() of the 64-bit hash and a constant, is a bijection of all shingles; its upper bits are the shingle's place in
UNIVERSE positions. The second, a table, circularly shifted by k, gives coordinate k. Shifts are contiguous in memory, so
all coordinates of a shingle are one slice of the table.

BANDS bands of ROWS coordinates make two sets of Jaccard 0.8 meet with a chance of 1 - (1 - 0.8^4)^28, or all but four in
ten million. Every two sets that share a band and that nothing else has linked are verified on full sets, and sets that
share none are not, however many others lie between them:

* first each member of a band with the band's smallest id, a row for each such pair. The members of a common hub are cut
  into parts of about CHUNK, each of which gets the hub's set, and all sets of a part meet, so that the members of a large
  group are linked to one another where few are near the hub;
* then, in bands of three or more members that these links leave in several components, all members of different ones.
  Members of the largest component meet the others only. Members are cut into blocks, of BLOCK sets or, if there are many,
  of four times the root of their number, and two blocks meet in one task, so a member is sent no more than a quarter of
  that root times. No cap, no pair list.

Both count intersections through an inverted index, in tasks of bounded size, and return a forest of links.

What travels are sets of hashes; texts are read once to sign them and once, where a band is shared, to write the sets.

Documents of one set are one class, represented by its smallest id; only representatives are banded and verified. Nulls
and texts without words have empty sets and link with nothing; fewer than four words are one shingle, the whole sequence.
Ids may be null or repeat: each row is a document of its own, whatever its id. near_groups() names a group by the smallest
id in it (null if none has one) and marks the rows of that id as kept; deduplicated() keeps one row of each group, of the
smallest id, then of the least digest, and loses no row that links with nothing. Other columns are ignored; empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm._shared import BATCH_BYTES, U64, buffer_of, cleared, components, mapped, mix, only, rolled, scratched, settled, sliced, words_of

SHINGLE = 4
BANDS, ROWS = 28, 4
UNIVERSE = 1 << 20
#: Members of a hub's part; members of a block at least; shingles of a block, about (a single longer document excepted).
CHUNK, BLOCK, BLOCK_SHINGLES = 64, 256, 1_000_000


@cache
def shifted() -> np.ndarray:
    """The second permutation, repeated past its end; row p of its sliding windows holds coordinates 0, 1, ... of position p."""
    second = np.random.default_rng(20).permutation(UNIVERSE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: BANDS * ROWS]]), BANDS * ROWS)


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """Each row's distinct shingle hashes, sorted."""
    _, _, words, first = words_of(raw, at, lower=True)
    runs = rolled(words, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            out.append(mix(rolled(words[a:b], b - a) + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The circulant signatures of nonempty sets, a row each."""
    table, k = shifted(), BANDS * ROWS
    out = np.empty((len(sets), k), np.uint32)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (n == 0 or n + len(sets[j]) <= 30_000):
            n += len(sets[j])
            j += 1
        if j == i + 1:
            for c in range(0, n, 30_000):
                least = table[_first(sets[i][c : c + 30_000])].min(axis=0)
                out[i] = np.minimum(out[i], least) if c else least
        else:
            sizes = np.array([len(s) for s in sets[i:j]])
            np.minimum.reduceat(table[_first(np.concatenate(sets[i:j]))], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0, out=out[i:j])
        i = j
    return out


def _first(shingles: np.ndarray) -> np.ndarray:
    """The first permutation: where a shingle stands in the universe."""
    return (mix(shingles ^ U64(0x5851F42D4C957F2D)) >> U64(44)).astype(np.int64)


def band_keys(sigs: np.ndarray) -> np.ndarray:
    s = sigs.astype(U64).reshape(len(sigs), BANDS, ROWS)
    with np.errstate(over="ignore"):
        h = np.zeros((len(sigs), BANDS), U64)
        for r in range(ROWS):
            h = mix(h * U64(0x9E3779B97F4A7C15) + s[:, :, r] + U64(r + 1))
        return mix(h + np.arange(1, BANDS + 1, dtype=U64)[None, :] * U64(0xD1B54A32D192ED03)).astype(np.int64)


def signed(df: DataFrame, width: int = SHINGLE) -> DataFrame:
    """id, n_shingles, k1 and k2 (a set's 128-bit name) and bands, for rows (id, text)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(*buffer_of(b.column(1)), width)
        full = [k for k, s in enumerate(sets) if len(s)]
        keys = band_keys(signatures([sets[k] for k in full])) if full else np.zeros((0, BANDS), np.int64)
        n = np.array([len(s) for s in sets], np.int64)
        name = [np.array([int(mix(s ^ U64(c)).sum(dtype=U64)) for s in sets], U64).astype(np.int64) for c in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)]
        ends = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(name[0]), pa.array(name[1]), bands], names=["id", "n_shingles", "k1", "k2", "bands"])

    return mapped(df, run, f"id {df.schema[0].dataType.simpleString()}, n_shingles long, k1 long, k2 long, bands array<long>")


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def links(sets: list[np.ndarray], label: list, side: list | None, percent: int) -> list[tuple[int, int]]:
    """A forest over the positions of sets that joins just what the pairs with 100 * |A & B| >= percent * |A | B| join, of
    pairs with different labels (those of one label are joined already).

    side: with two blocks, which one a set is of; only pairs across count. Work is by an inverted index, one set at a time.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    names = {x: k for k, x in enumerate(dict.fromkeys(label))}
    own = np.array([names[x] for x in label], np.int64)
    part = np.zeros(n, np.int64) if side is None else np.array([int(x == side[0]) for x in side], np.int64)
    token = np.concatenate(sets) if n else np.zeros(0, U64)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(token, kind="stable")
    owner_of, sorted_token = owner[order], token[order]
    begin = np.flatnonzero(np.concatenate([[True], sorted_token[1:] != sorted_token[:-1]])) if len(token) else np.zeros(0, np.int64)
    run = np.searchsorted(begin, np.arange(len(token)), "right") - 1
    end = np.append(begin[1:], len(token))
    place = np.empty(len(token), np.int64)
    place[order] = np.arange(len(token))
    first = np.concatenate([[0], np.cumsum(sizes)])
    forest, out = _Forest(n), []
    for x in range(n):
        spots = place[first[x] : first[x + 1]]
        tail = end[run[spots]] - spots - 1  # later owners of the same token
        spots, tail = spots[tail > 0], tail[tail > 0]
        if not len(spots):
            continue
        skip = np.repeat(spots + 1 - np.concatenate([[0], np.cumsum(tail)[:-1]]), tail)
        met = owner_of[skip + np.arange(int(tail.sum()))]
        both = np.bincount(met, minlength=n)
        near = (both > 0) & (own != own[x]) & (100 * both >= percent * (sizes[x] + sizes - both))
        if side is not None:
            near &= part != part[x]
        for y in np.flatnonzero(near).tolist():
            if forest.join(x, y):
                out.append((x, y))
    return out


def _set_of(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, U64)


def _edges(a: list, z: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(z, kind)], names=["a", "b"])


def _in_blocks(percent: int, kind: pa.DataType):
    """Rows (band, i, j, block, label, rep, set): links between the members of blocks i and j, or within one (i = j)."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, held = None, []
        for b in sliced(batches, BATCH_BYTES):
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if row[:3] != key:
                    if held:
                        yield key, held
                    key, held = row[:3], []
                held.append(row[3:])
        if held:
            yield key, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), held in tasks(batches):
            block, label, reps, packed = zip(*held, strict=True)
            found = links([_set_of(p) for p in packed], list(label), None if i == j else list(block), percent)
            if found:
                yield _edges([reps[x] for x, _ in found], [reps[y] for _, y in found], kind)

    return run


def _packed_sets(docs: DataFrame, width: int) -> DataFrame:
    """id, n and set (sorted 64-bit hashes) for rows (id, text)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(*buffer_of(b.column(1)), width)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set"])

    return mapped(docs, run, f"id {docs.schema[0].dataType.simpleString()}, set binary")


def _grouped(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """For every row of docs (id, text), ids neither null nor repeated: id, n_shingles and component, the smallest id that
    its links reach."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kind = to_arrow_type(docs.schema["id"].dataType)
    said = f"a {docs.schema['id'].dataType.simpleString()}, b {docs.schema['id'].dataType.simpleString()}"
    with scratched(spark) as keep:
        sig = keep(signed(docs, width))
        classes = keep(sig.where("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min("id").alias("rep")))
        members = keep(sig.join(classes, ["k1", "k2", "n_shingles"], "left").select("id", "n_shingles", "rep", F.when(F.col("id") == F.col("rep"), F.col("bands")).alias("bands")))
        cleared(spark, sig, classes)

        banded = members.where("bands is not null").select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
        shared = keep(banded.groupBy("band").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.count("*").alias("m")).where("m > 1").select("band", "least", "m"))
        met = keep(banded.join(shared, "band"))
        cleared(spark, shared)
        sets = keep(_packed_sets(docs.join(met.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", "text"), width))

        stars = keep(met.where("rep <> least").select("least", "rep").distinct())
        hubs = stars.groupBy("least").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
        spokes = stars.join(hubs, "least").select("least", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), "rep")
        centres = hubs.select("least", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("least").alias("rep"))
        alone = F.col("rep").alias("label")
        parts = spokes.unionByName(centres).join(sets.withColumnRenamed("id", "rep"), "rep").select("least", F.col("part").alias("i"), F.col("part").alias("j"), F.lit(0).alias("block"), alone, "rep", "set")
        near = keep(parts.repartition("least", "i").sortWithinPartitions("least", "i").mapInArrow(_in_blocks(percent, kind), said))
        cleared(spark, stars)

        # what bands of three or more members hold beyond their hubs' links
        first = components(near)
        crowd = met.where("m > 2").join(first.select(F.col("node").alias("rep"), "label"), "rep", "left").select("band", "rep", "n", F.coalesce("label", "rep").alias("label"))
        crowd = keep(crowd)
        cleared(spark, first, met)
        alike = crowd.groupBy("band").agg(F.min("label").alias("a"), F.max("label").alias("z"), F.count("*").alias("m"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who")).where("a < z")
        open_bands = keep(alike.groupBy("m", "who").agg(F.min("band").alias("band")).select("band"))
        rest = crowd.join(open_bands, "band")
        sizes = rest.groupBy("band", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
        most = sizes.groupBy("band").agg(F.max(F.struct("c", "label", "s")).alias("big"), F.sum("c").alias("c"), F.sum("s").alias("s"))
        blocks = lambda c, s: F.greatest(F.lit(1), F.ceil(c / F.greatest(F.lit(BLOCK), F.ceil(4 * F.sqrt(c)))), F.ceil(s / BLOCK_SHINGLES)).cast("int")
        cut = keep(most.select("band", F.col("big.label").alias("big"), blocks(F.col("big.c"), F.col("big.s")).alias("majors"), blocks(F.col("c") - F.col("big.c"), F.col("s") - F.col("big.s")).alias("minors")))
        placed = rest.join(cut, "band").withColumn("major", F.col("label") == F.col("big"))
        placed = placed.withColumn("block", F.when(F.col("major"), -1 - F.pmod(F.xxhash64("rep"), F.col("majors"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("minors"))).cast("int"))
        # blocks of the largest component have numbers below zero, and meet those of the others alone
        others = F.when(F.col("major"), F.sequence(F.lit(0), F.col("minors") - 1)).otherwise(F.concat(F.sequence(F.lit(0), F.col("minors") - 1), F.sequence(-F.col("majors"), F.lit(-1))))
        placed = placed.select("band", "rep", "label", "block", F.explode(others).alias("other"))
        placed = placed.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "label", "rep")
        tasks = placed.join(sets.withColumnRenamed("id", "rep"), "rep").select("band", "i", "j", "block", "label", "rep", "set")
        more = keep(tasks.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(_in_blocks(percent, kind), said))
        labels = components(near.unionByName(more))
        out = settled(members.select("id", "n_shingles", "rep").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("id", "n_shingles", F.coalesce("label", "rep", "id").alias("component")))
        cleared(spark, labels)
    return out


def _named(df: DataFrame, id_col: str) -> bool:
    """Whether every row has an id of its own."""
    ids = df.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n"))
    return ids.where("id is null or n > 1").select(F.lit(1)).isEmpty()


def _numbered(df: DataFrame) -> DataFrame:
    """df, written, with a number for each row."""
    return settled(df.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(c) for c in df.columns]).alias("_all")))


def near_groups(df: DataFrame, percent: int = 80, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of df: id, n_shingles, component_id (the smallest id that its links reach, null if none) and kept."""
    docs = only(df, id_col, text_col, text=text_col).toDF("id", "text")
    if _named(df, id_col):
        got = _grouped(docs, percent, width)
        return got.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
    rows = _numbered(docs)
    got = _grouped(rows.select(F.col("_row").alias("id"), "_all.text"), percent, width).join(rows.select(F.col("_row").alias("id"), F.col("_all.id").alias("name")), "id")
    least = settled(got.groupBy("component").agg(F.min("name").alias("least")))
    return got.join(least, "component").select(F.col("name").alias(id_col), "n_shingles", F.col("least").alias("component_id"), F.coalesce(F.col("name") == F.col("least"), F.lit(False)).alias("kept"))


def deduplicated(df: DataFrame, percent: int = 80, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, columns as they came: the row of the smallest id, of the least digest where ids don't tell."""
    if _named(df, id_col):
        kept = near_groups(df, percent, width, id_col, text_col).where("kept").select(F.col(id_col).alias("_kept"))
        return df.join(kept, F.col(id_col) == F.col("_kept"), "left_semi")
    rows = _numbered(df)
    got = _grouped(rows.select(F.col("_row").alias("id"), F.coalesce(F.col(f"_all.{text_col}"), F.lit("")).alias("text")), percent, width)
    place = rows.select(F.col("_row").alias("id"), F.struct(F.col(f"_all.{id_col}").isNull().alias("none"), F.col(f"_all.{id_col}").alias("name"), F.xxhash64("_all").alias("digest")).alias("place"))
    first = settled(got.join(place, "id").groupBy("component").agg(F.min_by("id", "place").alias("_first")))
    return rows.join(first, F.col("_row") == F.col("_first"), "left_semi").select("_all.*")
