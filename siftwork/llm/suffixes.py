"""Suffix-array dedup of bytes by external induced sorting.

A string of LENGTH bytes that two documents share holds the same minimizer (the least hash of its GRAM-byte grams) in
both. A first round finds minimizers that stand in two places. A second sends each of their occurrences, with all that
strings around it can cover, to the shard of its minimizer. Covers that are equal are one there, with the smallest id that
has it; a minimizer with one cover needs no more. Of other covers, what the longest matches to the left and to the right of
the gram with another cover of the gram leave out can be in no common string, so a cover is cut to these, and one that
then is too short for a string goes. The rest, one after another, each gram written as a number, is one string, whose
suffixes are sorted by external induced sorting (module induced): recursive, with queues on disk that carry places and
common prefixes. Neighbours with a common prefix as long as a string hold one string, and the smallest id among its
documents keeps it. Nothing in a shard need fit in memory: its rows are read as a stream, and covers, queues and lists are
files.

A minimizer that stands at more than MANY places of some segment, or in more than MANY segments, is hot, which the first
round tells every segment that has it: its occurrences are sent as single strings, each under a key of its own, so they
spread over all shards.

Only documents with a smaller id count, so repeats within a document, or between rows of one id, stay; rows without an id
come last. Null texts are empty. Other columns are ignored; empty tables give empty results. Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm import induced
from siftwork.llm import segments as sg
from siftwork.llm._shared import U64, mix, released, scratched, settled

LENGTH, GRAM = 50, 24
#: Strings of LENGTH around one gram, and the bytes that they cover.
STRINGS = LENGTH - GRAM + 1
COVER = LENGTH + STRINGS - 1
#: Bytes of a cover to either side of its gram.
SIDE = STRINGS - 1
#: A byte that UTF-8 never has; fills what lies beyond a document's ends.
BEYOND = 0xFF
#: Other bytes that UTF-8 never has, as digits of numbers.
_DIGITS = np.array([0xC0, 0xC1, *range(0xF5, 0xFF)], np.uint8)
#: Places of a minimizer in one segment, or segments that have it, beyond which it is hot. Strings take some twenty times
#: the room of covers, and copies of a document in one segment are one cover, so the number is well above that of copies.
MANY = 1024
SEGMENT = 2 << 20
_ODD = U64(0xC2B2AE3D27D4EB4F)


def _wide(raw: np.ndarray) -> np.ndarray:
    """The eight bytes at every place as one number."""
    return np.ndarray((max(0, len(raw) - 7),), "<u8", buffer=np.ascontiguousarray(raw), strides=(1,))


def gram_hashes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each of the places."""
    wide, out = _wide(raw), np.zeros(len(at), U64)
    with np.errstate(over="ignore"):
        for k in range(0, GRAM, 8):
            out = mix(out * _ODD + wide[at + k])
    return out


def minimizers(ranks: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Where the leftmost least gram of each valid string stands; ranks: 16 bits for the gram at each of at most 2^16
    places; valid: for each place, whether a string starts there."""
    v = (ranks.astype(np.uint32) << np.uint32(16)) | np.arange(len(ranks), dtype=np.uint32)
    span = 1
    while span * 2 <= STRINGS:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    if span < STRINGS:
        v = np.minimum(v[: len(v) - (STRINGS - span)], v[STRINGS - span :])
    mark = np.zeros(len(ranks), bool)
    mark[v[: len(valid)][valid] & np.uint32(0xFFFF)] = True
    return np.flatnonzero(mark)


def anchored(raw: np.ndarray, valid: np.ndarray, block: int = (1 << 16) - STRINGS + 1) -> np.ndarray:
    """The minimizers of all valid strings, block by block. Grams are ranked by a hash of their first eight bytes, which is
    all that choosing the same one in equal strings takes; keys are hashes of whole grams."""
    mark, wide = np.zeros(len(raw), bool), _wide(raw)
    for a in range(0, len(valid), block):
        ok = valid[a : a + block]
        if ok.any():
            with np.errstate(over="ignore"):
                ranks = ((wide[a : a + len(ok) + STRINGS - 1] * _ODD) >> U64(48)).astype(np.uint16)
            mark[minimizers(ranks, ok) + a] = True  # strings on both sides of a border can have one minimizer
    return np.flatnonzero(mark)


class _Bytes:
    """A segment's anchors, and their distinct keys in order."""

    def __init__(self, seg: sg.Segment):
        self.raw, self.ids = seg.raw, seg.ids
        n = max(0, len(seg.raw) - LENGTH + 1)
        valid = np.zeros(n, bool)
        size = np.diff(seg.at)
        for i, j in zip(seg.at[:-1][size >= LENGTH].tolist(), seg.at[1:][size >= LENGTH].tolist(), strict=True):
            valid[i : j - LENGTH + 1] = True
        self.at = anchored(seg.raw, valid)
        self.hash = gram_hashes(seg.raw, self.at)
        self.doc = np.searchsorted(seg.at, self.at, "right") - 1
        self.low, self.high = seg.at[self.doc], seg.at[self.doc + 1]
        self.keys, self.order, self.begin = sg.distinct(self.hash, None)

    def sent(self, many: int) -> np.ndarray:
        """A word for each key: 30 bits of it, then whether the segment has it twice, then whether at many places."""
        times = np.diff(np.append(self.begin, len(self.at)))
        return ((self.keys & U64((1 << 30) - 1)) << U64(2)).astype(np.uint32) | ((times > 1).astype(np.uint32) << np.uint32(1)) | (times > many).astype(np.uint32)

    def live(self, bits: np.ndarray) -> np.ndarray:
        hit = np.empty(len(self.at), bool)
        hit[self.order] = np.repeat(bits, np.diff(np.append(self.begin, len(self.at))))
        return hit


class _Covers:
    """What lies around the live anchors, distinct by bytes, with the smallest id that has it. A hot anchor has instead, for
    each string around it, a cover that begins and ends with the string."""

    def __init__(self, b: _Bytes, bits: np.ndarray):
        """bits: for each key, whether it is live and whether it is hot."""
        live, hot = b.live(bits[:, 0]), b.live(bits[:, 1])
        one, many = live & ~hot, live & hot
        starts = (b.at[many][:, None] - np.arange(STRINGS)).ravel()
        inside = (starts >= np.repeat(b.low[many], STRINGS)) & (starts + LENGTH <= np.repeat(b.high[many], STRINGS))
        # one string can hold a hot minimizer twice
        starts, first = np.unique(starts[inside], return_index=True)
        doc = np.repeat(b.doc[many], STRINGS)[inside][first]
        self.first = np.concatenate([b.at[one] - (STRINGS - 1), starts])
        self.low, self.high = np.concatenate([b.low[one], starts]), np.concatenate([b.high[one], starts + LENGTH])
        names = np.empty(len(self.first), U64)
        for i in range(0, len(names), _PART):
            part = slice(i, i + _PART)
            names[part] = _hashed(_texts(b.raw, self.first[part], self.low[part], self.high[part]))
        key = np.concatenate([b.hash[one], mix(names[int(one.sum()) :] ^ _ODD)])
        self.doc = b.ids[np.concatenate([b.doc[one], doc])]
        self.order = np.lexsort((self.doc, names, key))
        k, m = key[self.order], names[self.order]
        self.begin = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (m[1:] != m[:-1])])) if len(k) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.begin, len(k)))
        self.keys = k[self.begin]
        kept = self.order[self.begin]
        self.least = self.doc[kept]
        self.kept = (b.raw, self.first[kept], self.low[kept], self.high[kept])

    def text(self) -> np.ndarray:
        return _texts(*self.kept).view(f"V{COVER}").reshape(-1)


#: Covers that are hashed at once.
_PART = 1 << 14


def _texts(raw: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The bytes of covers that begin at first, BEYOND outside [low, high)."""
    out = np.full((len(first), COVER), BEYOND, np.uint8)
    whole = (first >= low) & (first + COVER <= high)
    if whole.any():
        every = np.ndarray((len(raw) - COVER + 1,), f"V{COVER}", buffer=np.ascontiguousarray(raw), strides=(1,))
        out.view(every.dtype)[whole, 0] = every[first[whole]]
    cut = np.flatnonzero(~whole)
    place = first[cut][:, None] + np.arange(COVER)
    inside = (place >= low[cut][:, None]) & (place < high[cut][:, None])
    edge = np.full(place.shape, BEYOND, np.uint8)
    edge[inside] = raw[place[inside]]
    out[cut] = edge
    return out


def met(many: int, limits: induced.Limits = induced.Limits()):
    """For columns of words, as _Bytes.sent() gives them: which keys stand in two places, and which are hot."""

    def judge(columns: sg.Row) -> np.ndarray:
        (word,) = columns
        _, order, begin = sg.distinct(word >> np.uint32(2), None)
        flags = np.bitwise_or.reduceat(word[order] & np.uint32(3), begin)
        count = np.diff(np.append(begin, len(word)))
        out = np.empty((len(word), 2), bool)
        out[order, 0] = np.repeat((count > 1) | (flags & 2 > 0), count)
        out[order, 1] = np.repeat((count > many) | (flags & 1 > 0), count)
        return out

    return lambda rows: sg.dealt(rows, lambda row: ((row[0] >> np.uint32(2)) & np.uint32(255)).astype(np.uint8), [np.uint32], 2, judge, limits)


def smaller_has(rows: Iterator[sg.Row], limits: induced.Limits = induced.Limits()) -> Iterator[np.ndarray]:
    """For covers and their documents, in rows: which of a cover's strings a smaller document's cover has, row by row."""
    texts, queue, sizes = induced.Growing(np.uint8, limits.small), induced.Queue([np.uint64, np.uint64, np.int64, np.int64], limits.room, True), []
    n = 0
    for cover, doc in rows:
        flat = cover.view(np.uint8).reshape(len(cover), COVER)
        gram, name = _hashed(flat[:, SIDE : SIDE + GRAM]), _hashed(flat)
        queue.push((gram >> U64(56)).astype(np.uint8), [gram, name, doc, np.arange(n, n + len(cover))])
        texts.add(flat.ravel())
        sizes.append(len(cover))
        n += len(cover)

    # equal covers are one class; those that reach as far as a string with another one of their gram are sorted
    every = texts.array().reshape(-1, COVER)
    later, number = induced.blank(n, bool, limits.small), induced.blank(n, np.int64, limits.small)
    chosen = _Chosen(limits.small)
    while (bucket := queue.next()) is not None:
        gram, name, doc, at = queue.pop(bucket)
        order = np.lexsort((at, doc, name, gram))
        g, m, d, at = gram[order], name[order], doc[order], at[order]
        new_gram = np.concatenate([[True], g[1:] != g[:-1]])
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (m[1:] != m[:-1])])
        kind = np.cumsum(new) - 1
        gram_of = np.cumsum(new_gram)[new] - 1
        several = np.flatnonzero(np.bincount(gram_of)[gram_of] > 1)
        left, right = _reaches(every, at[new][several], gram_of[several], limits.chunk)
        far = left.astype(np.int64) + right >= SIDE
        several = several[far]
        place = np.zeros(int(kind[-1]) + 1, np.int64)  # from 1; 0: not sorted
        place[several] = np.arange(1, len(several) + 1) + chosen.cover.n
        later[at] = d > d[new][kind]
        number[at] = place[kind]
        chosen.add(at[new][several], d[new][several], gram_of[several], left[far], right[far])

    bits = _strings(every, chosen, limits)
    begin = 0
    for m in sizes:
        k = np.asarray(number[begin : begin + m])
        told = np.where(k > 0, bits[np.maximum(k - 1, 0)], 0) if len(bits) else np.zeros(m, np.uint32)
        out = (told[:, None] >> np.arange(STRINGS, dtype=np.uint32)) & 1 > 0
        out[np.asarray(later[begin : begin + m])] = True
        yield out.ravel()
        begin += m


def _hashed(rows: np.ndarray) -> np.ndarray:
    n, width = rows.shape
    wide = np.zeros((n, -(-width // 8)), "<u8")
    wide.view(np.uint8)[:, :width] = rows
    out = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for j in range(wide.shape[1]):
            out = mix(out * _ODD + wide[:, j])
    return out


class _Chosen:
    """The covers that are sorted: which they are, their smallest documents, the numbers of their grams, and how many bytes
    to the left and to the right of the gram another cover can share."""

    def __init__(self, small: int):
        self.cover, self.least, self.gram = (induced.Growing(np.int64, small) for _ in range(3))
        self.left, self.right = (induced.Growing(np.uint8, small) for _ in range(2))
        self.grams = 0

    def add(self, cover: np.ndarray, least: np.ndarray, gram: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        """gram: ascending numbers, equal for equal grams."""
        if not len(cover):
            return
        new = np.concatenate([[True], gram[1:] != gram[:-1]])
        own = np.cumsum(new) - 1 + self.grams
        self.grams = int(own[-1]) + 1
        for to, x in zip((self.cover, self.least, self.gram, self.left, self.right), (cover, least, own, left, right), strict=True):
            to.add(x)


def _reaches(texts: np.ndarray, at: np.ndarray, gram: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For covers at `at`, by gram: the most bytes to the left of the gram, and to its right, that another cover of the gram
    shares. About `most` covers are compared at once; those of a gram that has more count as sharing all."""
    left, right = (np.full(len(at), SIDE, np.uint8) for _ in range(2))
    edges = np.append(np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])), len(at)) if len(at) else np.zeros(1, np.int64)
    k = 0
    while k < len(edges) - 1:
        last = max(k + 1, int(np.searchsorted(edges, edges[k] + most, "right")) - 1)
        i, j = int(edges[k]), int(edges[last])
        if j - i <= most:
            text = np.asarray(texts[at[i:j]])
            left[i:j] = _alike(text[:, SIDE - 1 :: -1], gram[i:j])
            right[i:j] = _alike(text[:, SIDE + GRAM :], gram[i:j])
        k = last
    return left, right


def _alike(side: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """The longest common prefix of each row with another row of its gram; BEYOND is like nothing."""
    wide = np.zeros((len(side), -(-SIDE // 8)), ">u8")
    wide.view(np.uint8)[:, :SIDE] = side
    order = np.lexsort((*wide.T[::-1], gram))
    a, g = side[order], gram[order]
    same = np.zeros((len(a) + 1, SIDE + 1), bool)
    same[1:-1, :SIDE] = (a[1:] == a[:-1]) & (a[1:] != BEYOND) & (g[1:] == g[:-1])[:, None]
    common = np.argmin(same, 1)
    out = np.empty(len(a), np.uint8)
    out[order] = np.maximum(common[1:], common[:-1])
    return out


def _strings(texts: np.ndarray, chosen: _Chosen, limits: induced.Limits) -> np.ndarray:
    """For the chosen covers, bit c: a cover of a smaller document has the string at column c.

    Of a cover only what another one can share is sorted, and its gram is written as a number, in bytes that no text has.
    """
    n = chosen.cover.n
    bits = induced.blank(n, np.uint32, limits.small)
    if not n:
        return bits
    digits = next(k for k in range(1, 99) if len(_DIGITS) ** k >= chosen.grams)
    whole, starts, at = induced.Growing(np.uint8, limits.small), induced.Growing(np.int64, limits.small), 0
    covers, least, grams, lefts, rights = (x.array() for x in (chosen.cover, chosen.least, chosen.gram, chosen.left, chosen.right))
    column = np.arange(2 * SIDE + digits + 1)
    step = max(1, limits.chunk // len(column))
    for i in range(0, n, step):
        text = np.asarray(texts[np.asarray(covers[i : i + step])])
        left, right, gram = (np.asarray(x[i : i + step]).astype(np.int64) for x in (lefts, rights, grams))
        part = np.empty((len(text), len(column)), np.uint8)
        part[:, :SIDE], part[:, SIDE + digits : -1] = text[:, :SIDE], text[:, SIDE + GRAM :]
        for k in range(digits):
            part[:, SIDE + k] = _DIGITS[gram // len(_DIGITS) ** k % len(_DIGITS)]
        end = SIDE + digits + right
        part[np.arange(len(part)), end] = BEYOND  # between covers
        whole.add(part[(column >= SIDE - left[:, None]) & (column <= end[:, None])])
        size = left + digits + right + 1
        starts.add(at + np.cumsum(size) - size)
        at += int(size.sum())
    begins = starts.array()

    def said(places: np.ndarray, sizes: np.ndarray) -> None:
        k = np.searchsorted(begins, places, "right") - 1
        column = places - begins[k] + SIDE - lefts[k]
        inside = column <= rights[k]  # else what is alike goes on beyond the cover
        group, k, column = np.repeat(np.arange(len(sizes)), sizes)[inside], k[inside], column[inside]
        if len(group):
            doc = np.asarray(least[k])
            cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            hit = doc > np.repeat(np.minimum.reduceat(doc, cut), np.diff(np.append(cut, len(group))))
            np.bitwise_or.at(bits, k[hit], np.uint32(1) << column[hit].astype(np.uint32))

    length = SIDE + digits
    held = np.zeros(0, np.int64)  # a group that a part cuts is kept back until it is whole
    for places, common in induced.suffixes(whole.array(), 255, replace(limits, deep=length), True):
        held = _groups(held, places.astype(np.int64), common, length, said)
    _groups(held, np.zeros(0, np.int64), np.zeros(0, np.uint8), length, said)
    return bits


def _groups(held: np.ndarray, places: np.ndarray, common: np.ndarray, length: int, said) -> np.ndarray:
    """Tells of every group of suffixes with a common prefix of `length` that is complete; the places of the last one."""
    start = np.flatnonzero(common < length)
    if len(places) and not len(start):
        return np.concatenate([held, places])
    whole = np.concatenate([held, places[: start[-1]]]) if len(start) else held
    cut = np.concatenate([[0], start[:-1] + len(held)]) if len(start) else np.zeros(1, np.int64)
    if len(whole):
        cut = cut[cut < len(whole)]
        cut = cut[np.concatenate([[True], cut[1:] != cut[:-1]])]
        size = np.diff(np.append(cut, len(whole)))
        said(whole[np.repeat(size > 1, size)], size[size > 1])
    return places[start[-1] :] if len(start) else places


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, many: int = MANY) -> DataFrame:
    """A row for each row of df: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (bytes)."""
    spark = df.sparkSession
    table, name = sg.pack(df, id_col, text_col, SEGMENT)
    shards = sg.shards_for(spark, int(df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]) // 14, SEGMENT // 14, 400_000)

    def anchors(seg: sg.Segment):
        b = _Bytes(seg)
        return b.keys, [b.sent(many)]

    def covers(seg: sg.Segment, bits):
        b = _Bytes(seg)
        c = _Covers(b, bits(b.keys, shards, 2))
        return c.keys, [c.text(), c.least]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                seg = sg.unpack(batch, k)
                b = _Bytes(seg)
                c = _Covers(b, sg.bits_of(batch.select(["found"]).rename_columns(["answers"]), k)(b.keys, shards, 2))
                gone = _gone(b, c, sg.bits_of(batch, k)(c.keys, shards, STRINGS))
                del b, c
                none = set(np.frombuffer(batch.column("none")[k].as_py(), np.int32).tolist())
                out = []
                for d, (i, j) in enumerate(zip(seg.at[:-1].tolist(), seg.at[1:].tolist(), strict=True)):
                    mask = gone[i:j]
                    lost = int(mask.sum())
                    spans = int((np.diff(np.concatenate([[0], mask.astype(np.int8)])) == 1).sum()) if lost else 0
                    kept = (seg.raw[i:j][~mask] if lost else seg.raw[i:j]).tobytes()
                    out.append((None if d in none else int(seg.ids[d]), j - i, lost, spans, hashlib.sha256(kept).hexdigest(), kept if texts else None))
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                    arrays = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays[: 6 if texts else 5], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if texts else 5])
                released()

    try:
        with scratched(spark) as keep:
            found = keep(sg.ask(table, anchors, shards, met(many), [np.uint32]))
            shared = keep(sg.ask(table, covers, shards, smaller_has, [f"V{COVER}", np.int64], found))
            both = sg.answered(sg.answered(table, found).withColumnRenamed("answers", "found"), shared)
            out = settled(both.mapInArrow(finish, f"id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{', kept binary' if texts else ''}"))
    finally:
        sg.dropped(spark, name)
    return out.withColumnRenamed("id", id_col)


def _gone(b: _Bytes, c: _Covers, bits: np.ndarray) -> np.ndarray:
    """Which bytes of a segment a repeated string covers."""
    if not len(c.keys):
        return np.zeros(len(b.raw), bool)
    cover = np.repeat(np.arange(len(c.keys)), c.size)
    later = c.doc[c.order] > c.least[cover]
    some = np.flatnonzero(later | bits.any(axis=1)[cover])
    cover, later, place = cover[some], later[some], c.order[some]
    first, low, high = c.first[place], c.low[place], c.high[place]
    mark = np.zeros(len(b.raw), bool)
    for j in range(STRINGS):
        at = first + j
        mark[at[(bits[cover, j] | later) & (at >= low) & (at + LENGTH <= high)]] = True
    return sg.spread(np.flatnonzero(mark), LENGTH, len(b.raw))


def digest(df: DataFrame) -> DataFrame:
    """The columns of query op7."""
    return repeats(df)
