"""External induced sorting: the suffixes of a string on disk in order, with common prefixes, in little memory.

A suffix is of type L if it is greater than the next one and of type S if it is smaller; an S after an L begins a block
(LMS). Sorted blocks give the order of all L suffixes, and these that of all S suffixes: a suffix that comes out of a
priority queue puts the one before it into the queue, under its first symbol, first in first out. The tuples in the queue
are places and, in the last round, common prefixes with the tuple of that symbol before: one more than the least common
prefix that came out since. To sort the blocks they are induced once from their first symbols alone, which orders them as
far as the next block; equal ones get one name, and the string of names, at most half as long, is sorted in the same way.
Recursion ends when all names differ, when names cover `deep` symbols, beyond which no order is asked for, or when the
names fit in `base` symbols; these are sorted in memory by doubling.

Queues keep `room` bytes in memory; the tuples that leave last go to a file of the task's own, which ends with it. The
string, its blocks, names and lists of suffixes are files too (in memory below SMALL bytes), read through memory maps.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Arrays below so many bytes stay in memory.
SMALL = 1 << 25
#: Common prefixes are counted up to here.
MOST = 255


@dataclass(frozen=True)
class Limits:
    """room: bytes of tuples that a queue holds; chunk: tuples that are worked on at once; base: names sorted in memory;
    deep: symbols beyond which order doesn't matter."""

    room: int = 64 << 20
    chunk: int = 1 << 18
    base: int = 4 << 20
    deep: int = 50
    small: int = SMALL


class Growing:
    """An array that grows at its end, on disk beyond `small` bytes."""

    def __init__(self, kind, small: int = SMALL):
        self.kind, self.small, self.n = np.dtype(kind), small, 0
        self.parts: list[np.ndarray] = []
        self.file = None

    def add(self, a: np.ndarray) -> None:
        a = np.ascontiguousarray(a, self.kind)
        self.n += len(a)
        if self.file is None and self.n * self.kind.itemsize <= self.small:
            self.parts.append(a)
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
            for p in self.parts:
                self.file.write(p)
            self.parts = []
        self.file.write(a)

    def array(self) -> np.ndarray:
        if self.file is None:
            whole = np.concatenate(self.parts) if self.parts else np.zeros(0, self.kind)
            self.parts = [whole]
            return whole
        self.file.flush()
        return np.memmap(self.file, self.kind, "r", shape=(self.n,))

    def back(self, chunk: int) -> Iterator[np.ndarray]:
        """The array from its end, in chunks, each reversed."""
        a = self.array()
        for i in range(self.n, 0, -chunk):
            yield np.asarray(a[max(0, i - chunk) : i])[::-1]


def blank(n: int, kind, small: int) -> np.ndarray:
    """n zeros, on disk beyond `small` bytes."""
    kind = np.dtype(kind)
    return np.zeros(n, kind) if n * kind.itemsize <= small else np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n,))


#: Bytes that a small array takes beside its content.
ARRAY = 128


class Queue:
    """Tuples by bucket, first in first out. Beyond `room` bytes the tuples of the buckets that leave last go to a file."""

    def __init__(self, kinds: list, room: int, upwards: bool):
        self.kinds, self.room, self.upwards = [np.dtype(k) for k in kinds], room, upwards
        self.blocks: dict[int, deque] = {}
        self.fresh: list[tuple[np.ndarray, list[np.ndarray]]] = []  # pushed, not dealt to buckets yet
        self.waiting = self.held = self.spilled = 0
        self.file = None

    def push(self, buckets: np.ndarray, columns: list[np.ndarray]) -> None:
        """Tuples in the order in which they come; buckets says where each goes."""
        if len(buckets):
            self.fresh.append((buckets, [c.astype(k, copy=False) for c, k in zip(columns, self.kinds, strict=True)]))
            self.waiting += sum(c.nbytes for c in self.fresh[-1][1])
            if self.waiting > self.room // 8:
                self._deal()

    def _deal(self) -> None:
        if not self.fresh:
            return
        buckets = np.concatenate([b for b, _ in self.fresh])
        columns = [np.concatenate(c) for c in zip(*[c for _, c in self.fresh], strict=True)]
        self.fresh, self.waiting = [], 0
        order = np.argsort(buckets, kind="stable")
        b = buckets[order]
        cut = np.flatnonzero(b[1:] != b[:-1]) + 1
        columns = [c[order] for c in columns]
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(b)], strict=True):
            block = [c[i:j].copy() for c in columns]  # so that what goes to the file leaves memory
            self.blocks.setdefault(int(b[i]), deque()).append(block)
            self.held += self._size(block)
        if self.held > self.room:
            self._spill()

    @staticmethod
    def _size(block: list[np.ndarray]) -> int:
        return sum(c.nbytes + ARRAY for c in block)

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for b in sorted(self.blocks, reverse=self.upwards):
            if self.held <= self.room // 2:
                break
            kept: deque = deque()
            row: list[list[np.ndarray]] = []
            for block in [*self.blocks[b], None]:
                if isinstance(block, list):
                    self.held -= self._size(block)
                    row.append(block)
                    continue
                if row:
                    where = self.file.seek(0, 2)
                    for c in zip(*row, strict=True):
                        whole = np.concatenate(c)
                        self.file.write(whole)
                        self.spilled += whole.nbytes
                    kept.append((where, sum(len(x[0]) for x in row)))
                    row = []
                if block is not None:
                    kept.append(block)
            self.blocks[b] = kept

    def _read(self, block) -> list[np.ndarray]:
        if isinstance(block, list):
            self.held -= self._size(block)
            return block
        self.file.seek(block[0])
        return [np.frombuffer(self.file.read(k.itemsize * block[1]), k) for k in self.kinds]

    def next(self) -> int | None:
        """The bucket that leaves next."""
        self._deal()
        if not self.blocks:
            return None
        return min(self.blocks) if self.upwards else max(self.blocks)

    def pop(self, bucket: int, most: int | None = None) -> list[np.ndarray] | None:
        """The oldest tuples of a bucket: about `most`, or all."""
        self._deal()
        blocks = self.blocks.get(bucket)
        if not blocks:
            return None
        got, n = [], 0
        while blocks and (most is None or n < most):
            got.append(self._read(blocks.popleft()))
            n += len(got[-1][0])
        if not blocks:
            del self.blocks[bucket]
        return [np.concatenate(c) for c in zip(*got, strict=True)]


def _range_least(values: np.ndarray):
    """A function to the least of values[i..j], both ends included, for arrays of i and j."""
    n = len(values)
    depth = n.bit_length()
    levels = np.empty((depth, n), values.dtype)
    levels[0] = values
    for k in range(1, depth):
        w = 1 << (k - 1)
        np.minimum(levels[k - 1, :-w], levels[k - 1, w:], out=levels[k, :-w])
    flat = levels.reshape(-1)

    def least(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        k = np.frexp((j - i + 1).astype(np.float32))[1].astype(np.int64) - 1
        base = k * n
        return np.minimum(flat[base + i], flat[base + j + 1 - (np.int64(1) << k)])

    return least


class _Carry:
    """Common prefixes of what is induced, for an alphabet of bytes."""

    def __init__(self):
        self.least, self.seen = np.full(256, MOST, np.uint8), np.zeros(256, bool)

    def grown(self, common: np.ndarray, into: np.ndarray, goes: np.ndarray) -> np.ndarray:
        """common: of each tuple that comes out with the one before it; goes: which of them induce, into: under which byte.
        The common prefix of each induced one with the one before it of the same byte."""
        if not len(common):
            return common
        at = np.flatnonzero(goes)
        b = into[at]
        order = np.argsort(b, kind="stable")
        sb, place = b[order], at[order]
        new = np.concatenate([[True], sb[1:] != sb[:-1]]) if len(sb) else np.zeros(0, bool)
        out = np.zeros(len(at), np.int16)
        inner = np.flatnonzero(~new)
        if len(inner):
            out[order[inner]] = 1 + _range_least(common)(place[inner - 1] + 1, place[inner]).astype(np.int16)
        upto = np.minimum.accumulate(common)
        lead = order[new]
        lb = b[lead]
        out[lead] = np.where(self.seen[lb], 1 + np.minimum(self.least[lb], upto[at[lead]]).astype(np.int16), 0)
        # the least common prefix since each byte's last tuple goes on to the next batch
        self.least = np.minimum(self.least, upto[-1])
        if len(sb):
            after = np.append(np.minimum.accumulate(common[::-1])[::-1][1:], MOST).astype(np.uint8)
            last = place[np.append(np.flatnonzero(new)[1:], len(place)) - 1]
            self.least[lb], self.seen[lb] = after[last], True
        return np.minimum(out, MOST).astype(np.uint8)


def _gather(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """x[at]; of a file in ascending order of places, so that it is read from one end to the other."""
    if not isinstance(x, np.memmap):
        return x[at]
    order = np.argsort(at)
    out = np.empty(len(at), x.dtype)
    out[order] = x[at[order]]
    return out


def blocks_of(x: np.ndarray, limits: Limits) -> np.ndarray:
    """Where blocks begin: each smaller than the suffix after it and after one that is greater than its next."""
    falling, out = Growing(np.int64, limits.small), Growing(np.int64, limits.small)
    n = len(x)
    ends = list(range(n, 0, -limits.chunk))
    last_s, nxt = False, None  # the type of the suffix at the end of the part, and its symbol; the empty suffix follows an L
    carried: list[tuple[int, bool]] = []
    for hi in ends:
        lo = max(0, hi - limits.chunk)
        part = np.asarray(x[lo:hi]).astype(np.int64)
        after = np.append(part[1:], nxt if nxt is not None else -1)
        cmp = np.sign(after - part)  # 1: S, -1: L, 0: as the next one
        k = np.arange(len(part))
        known = np.where(cmp != 0, k, len(part))
        ahead = np.minimum.accumulate(known[::-1])[::-1]
        s = np.where(ahead < len(part), cmp[np.minimum(ahead, len(part) - 1)] > 0, last_s)
        begins = s.copy()
        begins[1:] &= ~s[:-1]
        # whether the part's first suffix begins a block shows in the part before
        if carried and not s[-1] and carried[0][1]:
            falling.add(np.array([carried[0][0]]))
        carried = [(lo, bool(s[0]))]
        begins[0] = False
        falling.add((np.flatnonzero(begins) + lo)[::-1])
        last_s, nxt = bool(s[0]), int(part[0])
    for part in falling.back(limits.chunk):
        out.add(part)
    return out.array()


def _runs(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often the symbol at each place stands there in a row, up to MOST."""
    out = np.ones(len(at), np.int64)
    for k, i in enumerate(at.tolist()):
        row = np.asarray(x[i : i + MOST])
        other = np.flatnonzero(row != row[0])
        out[k] = other[0] if len(other) else len(row)
    return out


def _seam(x: np.ndarray, a: int, b: int) -> int:
    """The common prefix of an L and an S suffix of one symbol: the shorter run of it."""
    return int(_runs(x, np.array([a, b])).min())


class _Induction:
    """One round: from the places of blocks in order to all suffixes, the last first."""

    def __init__(self, x: np.ndarray, top: int, limits: Limits, common: bool):
        self.x, self.limits, self.common = x, limits, common
        self.place = np.uint32 if len(x) < 1 << 32 else np.int64
        # buckets are single symbols, or ranges of them where there are many
        self.shift = max(0, int(top).bit_length() - 8)
        self.kinds = [self.place, *([np.uint8] if common else []), *([np.int64] if self.shift else [])]

    def _push(self, queue: Queue, symbols: np.ndarray, places: np.ndarray, grown: np.ndarray | None) -> None:
        queue.push((symbols >> self.shift).astype(np.int64) if self.shift else symbols, [places, *([grown] if self.common else []), *([symbols] if self.shift else [])])

    def rising(self, seeds: Iterator[tuple[np.ndarray, np.ndarray | None]]) -> tuple[Growing, Growing | None]:
        """All L suffixes in order (and their common prefixes) from the blocks in order."""
        x, n = self.x, len(self.x)
        queue = Queue(self.kinds, self.limits.room, True)
        out, outc = Growing(self.place, self.limits.small), Growing(np.uint8, self.limits.small) if self.common else None
        if not n:
            return out, outc
        carry = _Carry() if self.common else None
        last = np.asarray(x[n - 1 :])
        if carry is not None:
            carry.seen[int(last[0])] = True
        self._push(queue, last, np.array([n - 1], self.place), np.zeros(1, np.uint8))
        stream = _Seeds(seeds, x, self.shift, self.common)

        def step(places, common, keys, seed: bool) -> None:
            """Tuples that come out together; none that they induce comes between them."""
            before = places.astype(np.int64) - 1
            p = _gather(x, np.maximum(before, 0))
            goes = (before >= 0) & (p >= keys)
            grown = carry.grown(common, p, goes) if carry is not None else None
            if not seed:
                out.add(places)
                if outc is not None:
                    outc.add(common)
            self._push(queue, p[goes], before[goes].astype(self.place), grown)

        while True:
            b, s = queue.next(), stream.bucket()
            if b is None and s is None:
                return out, outc
            if self.shift:
                now = s if b is None else b if s is None else min(b, s)
                self._window(queue, stream, now, step, True)
                continue
            if s is None or b is not None and b <= s:
                got = queue.pop(b, self.limits.chunk)
                step(got[0], got[1] if self.common else None, np.full(len(got[0]), b, x.dtype), False)
                continue
            places, common = stream.take(s, self.limits.chunk)
            if self.common and stream.fresh and out.n:
                end = int(out.array()[-1]) if out.file is None else int(np.asarray(out.array()[-1:])[0])
                if int(x[end]) == s:  # the first block of a symbol follows the last L of that symbol
                    common = common.copy()
                    common[0] = min(MOST, _seam(x, end, int(places[0])))
            stream.fresh = False
            step(places, common, np.full(len(places), s, x.dtype), True)

    def _window(self, queue: Queue, stream: _Seeds, bucket: int, step, up: bool) -> None:
        """A bucket of many symbols: its tuples in order, as many at once as induce nothing that belongs between them."""
        held = (np.zeros(0, self.place), np.zeros(0, self.x.dtype), np.zeros(0, bool))
        while True:
            got = queue.pop(bucket)
            if got is not None:
                held = _merged(held, (got[0], got[-1].astype(self.x.dtype), np.zeros(len(got[0]), bool)), up)
            if stream.bucket() == bucket:
                places, _ = stream.take(bucket, None)
                held = _merged(held, (places, _gather(self.x, places.astype(np.int64)), np.ones(len(places), bool)), up)
            places, keys, seed = held
            if not len(places):
                return
            before = places.astype(np.int64) - 1
            p = _gather(self.x, np.maximum(before, 0)).astype(np.int64)
            if up:
                induced = (before >= 0) & (p >= keys)
                far = np.minimum.accumulate(np.where(induced, p, np.iinfo(np.int64).max))[:-1]
                late = np.where(seed[1:], far <= keys[1:], far < keys[1:])
            else:
                induced = (before >= 0) & np.where(seed, p < keys, p <= keys)
                far = np.maximum.accumulate(np.where(induced, p, -1))[:-1]
                late = np.where(seed[1:], far >= keys[1:], far > keys[1:])
            k = int(np.argmax(late)) + 1 if late.any() else len(places)
            cut = np.flatnonzero(seed[1:k] != seed[: k - 1]) + 1
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), k], strict=True):
                step(places[i:j], None, keys[i:j], bool(seed[i]))
            held = (places[k:], keys[k:], seed[k:])

    def falling(self, ls: Growing, lc: Growing | None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """All suffixes from the last to the first, with common prefixes with the one that came before, from the L ones."""
        x = self.x
        queue = Queue(self.kinds, self.limits.room, False)
        carry = _Carry() if self.common else None
        outbox: list[tuple[np.ndarray, np.ndarray | None]] = []

        def step(places, common, keys, seed: bool) -> None:
            before = places.astype(np.int64) - 1
            p = _gather(x, np.maximum(before, 0))
            goes = (before >= 0) & (p < keys if seed else p <= keys)
            grown = carry.grown(common, p, goes) if carry is not None else None
            self._push(queue, p[goes], before[goes].astype(self.place), grown)
            outbox.append((places, common))

        def l_parts() -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
            if lc is None:
                for a in ls.back(self.limits.chunk):
                    yield a, None
                return
            held = np.zeros(1, np.uint8)
            for a, c in zip(ls.back(self.limits.chunk), lc.back(self.limits.chunk), strict=True):
                yield a, np.concatenate([held, c[:-1]])  # each common prefix moves to the smaller of its two
                held = c[-1:]

        stream = _Seeds(l_parts(), x, self.shift, self.common)
        end: np.ndarray | None = None  # the S suffix that came out last
        while True:
            b, s = queue.next(), stream.bucket()
            if b is None and s is None:
                return
            if self.shift:
                now = s if b is None else b if s is None else max(b, s)
                self._window(queue, stream, now, step, False)
            elif s is None or b is not None and b >= s:
                got = queue.pop(b, self.limits.chunk)
                end = got[0][-1:]
                step(got[0], got[1] if self.common else None, np.full(len(got[0]), b, x.dtype), False)
            else:
                places, common = stream.take(s, self.limits.chunk)
                if self.common and stream.fresh:
                    common = common.copy()
                    same = end is not None and int(x[int(end[0])]) == s
                    common[0] = min(MOST, _seam(x, int(places[0]), int(end[0]))) if same else 0
                stream.fresh = False
                step(places, common, np.full(len(places), s, x.dtype), True)
            yield from outbox
            outbox.clear()


def _merged(a: tuple, b: tuple, up: bool) -> tuple:
    """Tuples (place, symbol, is a seed) in the order in which they come out: by symbol, seeds after others, older first."""
    places, keys, seed = (np.concatenate([x, y]) for x, y in zip(a, b, strict=True))
    rank = keys.astype(np.int64) * 2 + seed if up else -keys.astype(np.int64) * 2 + seed
    order = np.argsort(rank, kind="stable")
    return places[order], keys[order], seed[order]


class _Seeds:
    """A stream of suffixes in order, taken bucket by bucket. fresh: the next one is the first of its bucket."""

    def __init__(self, parts: Iterator[tuple[np.ndarray, np.ndarray | None]], x: np.ndarray, shift: int, common: bool):
        self.parts, self.x, self.shift, self.common = parts, x, shift, common
        self.places = np.zeros(0, np.int64)
        self.lcp: np.ndarray | None = None
        self.cut: np.ndarray = np.zeros(0, np.int64)
        self.fresh, self.last = True, None
        self._fill()

    def _fill(self) -> None:
        while not len(self.places):
            part = next(self.parts, None)
            if part is None:
                return
            self.places, self.lcp = part
            self.cut = _gather(self.x, np.asarray(self.places, np.int64)) >> self.shift if len(self.places) else self.cut

    def bucket(self) -> int | None:
        return int(self.cut[0]) if len(self.places) else None

    def take(self, bucket: int, most: int | None) -> tuple[np.ndarray, np.ndarray | None]:
        """The next ones of a bucket, as many as are at hand; all if most is None."""
        got, lcp = [], []
        self.fresh = self.last != bucket
        self.last = bucket
        while len(self.places) and int(self.cut[0]) == bucket:
            other = np.flatnonzero(self.cut != bucket)
            k = int(other[0]) if len(other) else len(self.places)
            k = k if most is None else min(k, most)
            got.append(self.places[:k])
            if self.lcp is not None:
                lcp.append(self.lcp[:k])
                self.lcp = self.lcp[k:]
            self.places, self.cut = self.places[k:], self.cut[k:]
            self._fill()
            if most is not None:
                break
        return np.concatenate(got), np.concatenate(lcp) if lcp else None


def _common(x: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The common prefixes of the suffixes of bytes at a and b, up to `most`; eight bytes are compared at once."""
    out = np.zeros(len(a), np.int64)
    live, n, near = np.arange(len(a)), len(x), []
    wide = np.ndarray((max(0, n - 7),), "<u8", buffer=x, strides=(1,))
    for d in range(0, most, 8):
        i, j = a[live] + d, b[live] + d
        inside = np.maximum(i, j) <= n - 8
        near.append(live[~inside])  # the string's end comes before eight more bytes
        live = live[inside]
        if not len(live):
            break
        differ = _gather(wide, i[inside]) ^ _gather(wide, j[inside])
        low = np.log2(np.where(differ > 0, differ & (~differ + np.uint64(1)), np.uint64(1)).astype(np.float64)).astype(np.int64) // 8
        same = differ == 0
        out[live] = d + np.where(same, 8, low)
        live = live[same]
    for k in np.concatenate(near).tolist():
        while out[k] < most and max(a[k], b[k]) + out[k] < n and x[a[k] + out[k]] == x[b[k] + out[k]]:
            out[k] += 1
    return np.minimum(out, most)


def doubled(names: np.ndarray, steps: int) -> np.ndarray:
    """The order of a string's suffixes by their first 2 ** steps symbols, by doubling, in memory."""
    rank = names.astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    for k in range(steps):
        w = 1 << k
        if w >= len(rank):
            break
        second = np.zeros(len(rank), np.int64)
        second[:-w] = rank[w:]
        key = rank * (np.int64(len(rank)) + 2) + second if rank.max() < (1 << 62) // (len(rank) + 2) else None
        order = np.argsort(key, kind="stable") if key is not None else np.lexsort((second, rank))
        a, b = rank[order], second[order]
        new = np.ones(len(rank), np.int64)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        upto = np.cumsum(new)
        rank = np.empty(len(rank), np.int64)
        rank[order] = upto
        if upto[-1] == len(rank):
            break
    return order


def suffixes(x: np.ndarray, top: int, limits: Limits, common: bool = False, covered: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """The places of all suffixes of x, the greatest first, and, if asked for (x of bytes), common prefixes with the one
    that came before. Symbols are 0 to top; each covers `covered` symbols of the first string at least."""
    starts = blocks_of(x, limits)
    m = len(starts)
    ordered = _sorted_blocks(x, top, limits, starts, covered) if m else Growing(np.int64, limits.small)
    last = _Induction(x, top, limits, common)

    def seeds() -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        every, before = ordered.array(), None
        for i in range(0, m, limits.chunk):
            part = np.asarray(every[i : i + limits.chunk]).astype(np.int64)
            lcp = None
            if common:
                prior = np.concatenate([part[:1] if before is None else before, part[:-1]])
                lcp = _common(x, prior, part, min(MOST, limits.deep)).astype(np.uint8)
                if before is None:
                    lcp[0] = 0
            before = part[-1:]
            yield part.astype(last.place), lcp

    yield from last.falling(*last.rising(seeds()))


def _sorted_blocks(x: np.ndarray, top: int, limits: Limits, starts: np.ndarray, covered: int) -> Growing:
    """The places of blocks in the order of their suffixes."""
    m, n = len(starts), len(x)
    first = _Induction(x, top, limits, False)

    def by_symbol() -> Iterator[tuple[np.ndarray, None]]:
        queue = Queue([first.place, np.int64], limits.room, True)
        for i in range(0, m, limits.chunk):
            part = np.asarray(starts[i : i + limits.chunk])
            symbols = _gather(x, part).astype(np.int64)
            queue.push(symbols >> first.shift, [part, symbols])
        while (b := queue.next()) is not None:
            places, symbols = queue.pop(b)
            yield places[np.argsort(symbols, kind="stable")], None

    begins = blank(n, bool, limits.small)
    for i in range(0, m, limits.chunk):
        begins[np.asarray(starts[i : i + limits.chunk])] = True
    ends = Growing(np.int64, limits.small)  # the blocks in falling order, as far as the next block each
    for places, _ in first.falling(*first.rising(by_symbol())):
        at = places.astype(np.int64)
        ends.add(at[_gather(begins, at)])

    names = blank(m, np.int64, limits.small)
    count, before = 0, None
    for part in ends.back(limits.chunk):
        k = np.searchsorted(starts, part)
        follows = np.asarray(starts[np.minimum(k + 1, m - 1)])
        size = np.where(k + 1 < m, follows - part + 1, n + 1)  # the last block is like no other
        a = np.concatenate([part[:1] if before is None else before[0], part[:-1]])
        a_size = np.concatenate([size[:1] if before is None else before[1], size[:-1]])
        same = _same(x, a, part, a_size, size)
        if before is None:
            same[0] = False
        number = count + np.cumsum(~same) - 1
        names[k] = number
        count = int(number[-1]) + 1
        before = part[-1:], size[-1:]

    out = Growing(np.int64, limits.small)
    if count == m or covered >= limits.deep:
        for part in ends.back(limits.chunk):
            out.add(part)
    elif m <= limits.base:
        steps = max(1, int(np.ceil(np.log2(max(2, limits.deep / covered)))))
        out.add(np.asarray(starts)[doubled(np.asarray(names), steps)])
    else:
        falling = Growing(np.int64, limits.small)
        for places, _ in suffixes(names, count, limits, False, 2 * covered):
            falling.add(places.astype(np.int64))
        for part in falling.back(limits.chunk):
            out.add(_gather(starts, part))
    return out


def _same(x: np.ndarray, a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Which blocks at a and b are equal."""
    out = (a_size == b_size) & (b_size <= len(x))
    live = np.flatnonzero(out)
    d = 0
    while len(live):
        live = live[d < b_size[live]]
        differ = _gather(x, a[live] + d) != _gather(x, b[live] + d)
        out[live[differ]] = False
        live = live[~differ]
        d += 1
    return out
