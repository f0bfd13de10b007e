"""Substring dedup by fixed-block anchors.

Every document's words are cut into non-overlapping blocks of BLOCK words, which are indexed; every rolling run of BLOCK
words, of every document, probes the index. A window of WINDOW >= 2 * BLOCK - 1 words holds a whole block wherever it
starts, so two occurrences of one window hit each other's anchors. Hits are extended: all windows around a hit are
compared by 96 bits of hash, the earliest place of each is found, and windows that overlap join into maximal repeats.

Order is by id, then by start; rows without an id come last, as one document; rows of one id are one document's. Null
texts have no words. Other columns are ignored; empty tables give empty results. Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm import segments as sg
from siftwork.llm._shared import BATCH_BYTES, U64, rolled, scratched, settled, whole_runs, words_of

WINDOW, BLOCK = 20, 10


class _Words:
    """A segment's words and its runs of BLOCK words, those of documents too short for a window left out."""

    def __init__(self, seg: sg.Segment, window: int, block: int):
        _, _, self.hashes, self.first = words_of(seg.raw, seg.at)
        n = max(0, len(self.hashes) - block + 1)
        self.probes = rolled(self.hashes, block)
        size = np.diff(self.first)
        begin, end = self.first[:-1][size >= window], self.first[1:][size >= window]
        ok, anchor = np.zeros(n, bool), np.zeros(n, bool)
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            ok[a : b - block + 1] = True
            anchor[a : b - block + 1 : block] = True
        self.at = np.flatnonzero(ok)
        self.keys, self.order, self.begin = sg.distinct(self.probes[self.at])
        self.anchor = anchor[self.at]

    def sent(self) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(0, np.uint32)
        twice = np.diff(np.append(self.begin, len(self.at))) > 1
        anchored = np.logical_or.reduceat(self.anchor[self.order], self.begin)
        return ((self.keys & U64((1 << 30) - 1)) << U64(2)).astype(np.uint32) | (twice.astype(np.uint32) << np.uint32(1)) | anchored.astype(np.uint32)

    def live(self, bits: np.ndarray) -> np.ndarray:
        """Which word positions begin a run that hits."""
        out = np.zeros(len(self.hashes) + 1, bool)
        hit = np.empty(len(self.at), bool)
        hit[self.order] = np.repeat(bits, np.diff(np.append(self.begin, len(self.at))))
        out[self.at[hit]] = True
        return out


class _Windows:
    """The windows around hits: where they start, and by distinct key the first place of each."""

    def __init__(self, words: _Words, live: np.ndarray, ids: np.ndarray, window: int, block: int):
        n = len(words.hashes) - window + 1
        ok = whole_runs(words.first, window, n)
        sums = np.concatenate([[0], np.cumsum(live)])
        reach = window - block + 1
        near = sums[reach : reach + max(0, n)] - sums[: max(0, n)] > 0
        self.at = np.flatnonzero(ok & near)
        full = rolled(words.hashes, window)[self.at] if n > 0 else np.zeros(0, U64)
        check = (words.probes[self.at] >> U64(32)).astype(np.uint32)
        doc = np.searchsorted(words.first, self.at, "right") - 1
        start = (self.at - words.first[doc]).astype(np.int32)
        doc = ids[doc]
        self.order = np.lexsort((start, doc, check, full))
        f, c = full[self.order], check[self.order]
        self.begin = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (c[1:] != c[:-1])])) if len(f) else np.zeros(0, np.int64)
        self.keys, self.check = f[self.begin], c[self.begin]
        self.doc, self.start = doc[self.order][self.begin], start[self.order][self.begin]
        # places of a key after its first in this segment are repeats whatever others hold
        size = np.diff(np.append(self.begin, len(f)))
        self.later = (doc[self.order] > np.repeat(self.doc, size)) | (start[self.order] > np.repeat(self.start, size))
        self.size = size

    def removed(self, bits: np.ndarray) -> np.ndarray:
        return self.at[self.order[self.later | np.repeat(bits, self.size)]]


def repeats(df: DataFrame, window: int = WINDOW, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """A row for each row of df: id, n_words, n_removed, kept_sha256, spans (maximal removed runs of words, start and end)
    and, if asked for, kept (the words that stay, joined by one space)."""
    if window < 2 * block - 1:
        raise ValueError("a window must be sure to hold a whole block")
    spark = df.sparkSession
    table, name = sg.pack(df, id_col, text_col)
    shards = sg.shards_for(spark, int(df.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0]) // 6, BATCH_BYTES // 6)

    def probe(seg: sg.Segment):
        w = _Words(seg, window, block)
        return w.keys, [w.sent()]

    def extend(seg: sg.Segment, bits):
        w = _Words(seg, window, block)
        x = _Windows(w, w.live(bits(w.keys, shards)), seg.ids, window, block)
        return x.keys, [x.keys, x.check, x.doc, x.start]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                seg = sg.unpack(b, k)
                w = _Words(seg, window, block)
                first_bits = sg.bits_of(b.select(["hits"]).rename_columns(["answers"]), k)(w.keys, shards)
                x = _Windows(w, w.live(first_bits), seg.ids, window, block)
                gone = sg.spread(x.removed(sg.bits_of(b, k)(x.keys, shards)), window, len(w.hashes))
                whole, none = seg.raw.tobytes(), set(np.frombuffer(b.column("none")[k].as_py(), np.int32).tolist())
                out = []
                for d, (p, q, i, j) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), seg.at[:-1].tolist(), seg.at[1:].tolist(), strict=True)):
                    mask = gone[p:q]
                    lost = int(mask.sum())
                    said = whole[i:j].split()
                    kept = b" ".join(compress(said, (~mask).tolist()) if lost else said)
                    spans = []
                    if lost:
                        e = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
                        spans = [{"start": s, "end": t} for s, t in zip(np.flatnonzero(e == 1).tolist(), np.flatnonzero(e == -1).tolist(), strict=True)]
                    out.append((None if d in none else int(seg.ids[d]), q - p, lost, hashlib.sha256(kept).hexdigest(), spans, kept.decode() if texts else None))
                if out:
                    cols = list(zip(*out, strict=True))
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()]
                    arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays if texts else arrays[:5], names=["id", "n_words", "n_removed", "kept_sha256", "spans", "kept"][: 6 if texts else 5])

    try:
        with scratched(spark) as keep:
            hits = keep(sg.ask(table, probe, shards, sg.met_elsewhere, [np.uint32]))
            earlier = keep(sg.ask(table, extend, shards, sg.held_earlier, [np.uint64, np.uint32, np.int64, np.int32], hits))
            both = sg.answered(sg.answered(table, hits).withColumnRenamed("answers", "hits"), earlier)
            out = settled(both.mapInArrow(finish, f"id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: int, end: int>>{', kept string' if texts else ''}"))
    finally:
        sg.dropped(spark, name)
    return out.withColumnRenamed("id", id_col)


def digest(df: DataFrame) -> DataFrame:
    """The columns of query op5."""
    return repeats(df).drop("spans")
