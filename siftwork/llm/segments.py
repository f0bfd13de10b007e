"""Documents packed into segments, and questions that segments put to shards of a key space.

A segment is an Arrow batch's worth of documents, compressed, in a table bucketed by segment so that later joins on it
move answers and not texts. A segment asks by sending each shard the sorted keys that it holds there; the shard compares
the keys of all segments and answers each with one bit a key. Keys are unique within a segment, so a key that a third of
all documents share weighs one entry a segment, and shards are even.

A shard is read as a stream, row by row, and what it compares goes through a queue that keeps little in memory and the
rest in a file of the task's, so it may be larger than memory. Shards are many enough that each is small, unless rows
would hold fewer than LEAST_KEYS keys: then shards grow instead, so rows stay in proportion to keys at any size.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm._shared import BATCH_BYTES, U64, buffer_of, only, released, sliced
from siftwork.llm.induced import Limits, Queue, blank

#: Where rows without an id stand in the order of documents: last.
NO_ID = np.iinfo(np.int64).max


class Segment:
    """raw: the texts' bytes; at: each text's offset, one more than texts; ids in the same order."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, at: np.ndarray):
        self.ids, self.raw, self.at = ids, raw, at


def pack(df: DataFrame, id_col: str, text_col: str, most: int = BATCH_BYTES) -> tuple[DataFrame, str]:
    """The segments of df as a bucketed table (seg, ids, none, at, blob) in the warehouse, one file a bucket, and its name.
    A segment is named by its partition and its number there, so a task that runs again gives the same names."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        context = TaskContext.get()
        first = (context.partitionId() if context is not None else 0) << 32
        for k, b in enumerate(sliced(batches, most)):
            raw, at = buffer_of(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(object) if b.column(0).null_count else b.column(0).to_numpy()
            ids = np.array([NO_ID if x is None or x != x else int(x) for x in ids], np.int64) if ids.dtype == object else ids.astype(np.int64)
            none = np.flatnonzero(~np.asarray(b.column(0).is_valid())).astype(np.int32)
            row = [pa.array([first + k]), *[pa.array([x.tobytes()], pa.binary()) for x in (ids, none, at.astype(np.int64))], pa.array([squeeze.compress(raw.tobytes())], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, names=["seg", "ids", "none", "at", "blob"])

    rows = only(df, id_col, text_col, text=text_col).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    name = f"segments_{uuid.uuid4().hex}"
    rows.mapInArrow(run, "seg long, ids binary, none binary, at binary, blob binary").repartition(buckets, "seg").write.bucketBy(buckets, "seg").format("parquet").saveAsTable(name)
    return spark.table(name), name


def dropped(spark: SparkSession, name: str) -> None:
    spark.sql(f"drop table if exists {name}")


def unpack(b: pa.RecordBatch, k: int) -> Segment:
    at = np.frombuffer(b.column("at")[k].as_py(), np.int64)
    blob = zstandard.ZstdDecompressor().decompress(b.column("blob")[k].as_py(), max_output_size=max(1, int(at[-1])))
    return Segment(np.frombuffer(b.column("ids")[k].as_py(), np.int64), np.frombuffer(blob, np.uint8), at)


def planes(a: np.ndarray) -> bytes:
    """The bytes of an array, lowest bytes of all items first: equal high bytes then compress away. Items of more than
    eight bytes are texts, and compressed here."""
    if a.itemsize > 8:
        return zstandard.ZstdCompressor(level=3).compress(a.tobytes())
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unplaned(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if size > 8:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind) if raw else np.zeros(0, kind)


def shard_cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins in sorted 64-bit keys, one more than shards. Shards are equal ranges of the key space."""
    lows = np.array([((i << 32) // shards) << 32 for i in range(1, shards)], U64)
    return np.concatenate([[0], np.searchsorted(keys, lows), [len(keys)]])


#: Columns of one row of a shard, in the order of its keys.
Row = list[np.ndarray]


def ask(table: DataFrame, question: Callable[[Segment], tuple[np.ndarray, list[np.ndarray]]], shards: int, compare: Callable[[Iterator[Row]], Iterator[np.ndarray]], kinds: list[type], more: DataFrame | None = None) -> DataFrame:
    """One round of questions: for each segment (seg, answers), answers being (shard, bits).

    question(segment, bits...) gives sorted distinct 64-bit keys and the columns to send, one item for each key. compare
    reads the rows of all segments that have keys in one shard, and gives a Boolean array for each, in their order.
    more: answers of an earlier round; question then gets them, in the order of that round's keys, as second argument.
    """
    again = more is not None
    source = answered(table, more) if again else table

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                seg = unpack(b, k)
                keys, columns = question(seg, bits_of(b, k)) if again else question(seg)
                cuts = shard_cuts(keys, shards)
                full = np.flatnonzero(np.diff(cuts))
                if len(full):
                    spans = [(cuts[s], cuts[s + 1]) for s in full.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([b.column("seg")[k].as_py()] * len(full), pa.int64()), *[pa.array([planes(c[x:y]) for x, y in spans], pa.binary()) for c in columns]], names=["shard", "seg", *names])
                del keys, columns
                released()

    names = [f"c{i}" for i in range(len(kinds))]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for b in sliced(batches) for row in zip(*[b.column(c).to_pylist() for c in ("shard", "seg", *names)], strict=True))
        for shard, rows in groupby(every, key=lambda row: row[0]):
            segs: list[int] = []

            def held(rows=rows, segs=segs) -> Iterator[Row]:
                for row in rows:
                    segs.append(row[1])
                    yield [unplaned(x, kind) for x, kind in zip(row[2:], kinds, strict=True)]

            told, size = [], 0
            for k, x in enumerate(compare(held())):
                told.append((segs[k], shard, np.packbits(x).tobytes()))
                size += len(told[-1][2])
                if size > BATCH_BYTES:
                    yield _told(told)
                    told, size = [], 0
            if told:
                yield _told(told)
            released()

    sent = source.mapInArrow(send, "shard int, seg long, " + ", ".join(f"{n} binary" for n in names))
    return sent.repartition("shard").sortWithinPartitions("shard", "seg").mapInArrow(meet, "seg long, shard int, bits binary")


def _told(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["seg", "shard", "bits"])


def answered(table: DataFrame, answers: DataFrame) -> DataFrame:
    """The segments with their answers; segments that asked nothing have none."""
    own = answers.groupBy("seg").agg(F.sort_array(F.collect_list(F.struct("shard", "bits"))).alias("answers"))
    return table.join(own, "seg", "left")


def bits_of(b: pa.RecordBatch, k: int) -> Callable[[np.ndarray, int], np.ndarray]:
    """A function from the sorted keys that a segment asked with, and the number of shards, to the answers' bits, of which
    a key has width."""
    said = b.column("answers")[k].as_py() or []

    def of(keys: np.ndarray, shards: int, width: int = 1) -> np.ndarray:
        cuts = shard_cuts(keys, shards)
        out = np.zeros((len(keys), width), bool)
        for x in said:
            i, j = cuts[x["shard"]], cuts[x["shard"] + 1]
            out[i:j] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=(j - i) * width).reshape(-1, width).astype(bool)
        return out[:, 0] if width == 1 else out

    return of


#: Keys of one segment that a shard gets at least, on average.
LEAST_KEYS = 64


def shards_for(spark: SparkSession, items: int, segment: int, each: int = 2_000_000) -> int:
    """How many shards: a task each at least; as many as hold `each` items, but no more than leave a segment, of `segment`
    items, LEAST_KEYS keys for each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), min(-(-items // each), segment // LEAST_KEYS))


def distinct(keys: np.ndarray, kind: str | None = "stable") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the order that sorts all, and where each distinct key begins in it."""
    order = np.argsort(keys, kind=kind)
    s = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[begin], order, begin


def dealt(rows: Iterator[Row], bucket: Callable[[Row], np.ndarray], kinds: list, width: int, judge: Callable[[Row], np.ndarray], limits: Limits) -> Iterator[np.ndarray]:
    """Answers for rows, by way of a queue: bucket gives each item's bucket, 0 to 255, and judge sees the columns of one
    bucket's items at a time and says (items, width). The answers of each row follow, in order."""
    queue, sizes = Queue([*kinds, np.int64], limits.room, True), []
    n = 0
    for row in rows:
        m = len(row[0])
        queue.push(bucket(row), [*row, np.arange(n, n + m)])
        sizes.append(m)
        n += m
    out = blank(n * width, bool, limits.small).reshape(n, width)
    while (b := queue.next()) is not None:
        *columns, at = queue.pop(b)
        out[at] = judge(columns).reshape(-1, width)
    begin = 0
    for m in sizes:
        yield np.asarray(out[begin : begin + m]).ravel()
        begin += m


def met_elsewhere(rows: Iterator[Row], limits: Limits = Limits()) -> Iterator[np.ndarray]:
    """For columns of words (30 bits of key, then a flag that its segment has it twice, then one that an anchor has it):
    which keys stand in two places, one of them an anchor."""

    def judge(columns: Row) -> np.ndarray:
        (word,) = columns
        uniq, order, begin = distinct(word >> np.uint32(2))
        flags = np.bitwise_or.reduceat(word[order] & np.uint32(3), begin)
        count = np.diff(np.append(begin, len(word)))
        live = np.empty(len(word), bool)
        live[order] = np.repeat(((count > 1) | (flags & 2 > 0)) & (flags & 1 > 0), count)
        return live

    return dealt(rows, lambda row: ((row[0] >> np.uint32(2)) & np.uint32(255)).astype(np.uint8), [np.uint32], 1, judge, limits)


def held_earlier(rows: Iterator[Row], limits: Limits = Limits()) -> Iterator[np.ndarray]:
    """For columns (key, check, id, start), id and start being a segment's first place of a key: which keys another
    segment has at an earlier place."""

    def judge(columns: Row) -> np.ndarray:
        key, check, doc, start = columns
        order = np.lexsort((start, doc, check, key))
        k, c, d, s = key[order], check[order], doc[order], start[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
        first = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
        out = np.empty(len(k), bool)
        out[order] = (d > d[first]) | (s > s[first])
        return out

    return dealt(rows, lambda row: (row[0] & U64(255)).astype(np.uint8), [np.uint64, np.uint32, np.int64, np.int32], 1, judge, limits)


def spread(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in [s, s + length) for one of the starts."""
    mark = np.zeros(n, np.int32)
    mark[starts] = 1
    upto = np.cumsum(mark, dtype=np.int32)
    out = upto > 0
    out[length:] = upto[length:] > upto[:-length]
    return out
