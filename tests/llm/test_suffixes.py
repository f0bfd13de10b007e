"""Byte repeats against all strings, and the induced suffix orders against plain sorting."""

import hashlib
import itertools
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from siftwork.llm import induced
from siftwork.llm import suffixes as sx


def plain(rows, length=50):
    first, out = {}, {}
    docs = sorted((i, (t or "").encode()) for i, t in rows)
    for i, b in docs:
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], i)
    for i, b in docs:
        m = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                m[k : k + length] = b"\1" * length
        out[i] = (len(b), sum(m), sum(1 for k in range(len(m)) if m[k] and not (k and m[k - 1])), hashlib.sha256(bytes(x for x, y in zip(b, m, strict=True) if not y)).hexdigest())
    return out


def test_byte_repeats_match_all_strings(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé漢 ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [prose(rng.randint(5, 200)) for _ in range(40)]
    passage = prose(20)
    texts = base + base[:8] + [t[: len(t) // 2] + prose(5) + t[len(t) // 2 :] for t in base[:10]] + [prose(9) + passage + prose(3) for _ in range(15)]
    texts += ["a" * 400, "a" * 120, "ab" * 200, passage * 3, "x" * 49, "x" * 50, "x" * 50, "", None, prose(4000)]
    rng.shuffle(texts)
    rows = [(i * 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, seg string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in sx.digest(df).collect()}
    want = plain(rows)
    assert got == want and sum(x[1] for x in want.values()) > 2000
    assert sx.digest(df.limit(0)).collect() == []


def test_rows_without_ids_and_repeated_ids(spark):
    p = "0123456789" * 6 + "é"
    df = spark.createDataFrame([(4, p), (4, p), (None, "q" + p), (9, p + "r")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in sx.digest(df).collect())
    assert got == [(-1, 62), (4, 0), (4, 0), (9, 62)]


SMALL = induced.Limits(room=64, chunk=5, base=2, deep=10_000, small=16)
DISK = induced.Limits(room=2000, chunk=64, base=8, deep=sx.LENGTH, small=256)


def common_prefix(a, b):
    return next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


@pytest.mark.parametrize("limits", [induced.Limits(deep=10_000), SMALL])
def test_suffixes_come_out_in_order_with_common_prefixes(limits):
    rng = np.random.default_rng(4)
    cases = [rng.integers(97, 97 + k, n).astype(np.uint8) for k, n in [(1, 30), (2, 60), (2, 200), (4, 150), (26, 80), (1, 1), (2, 2)]]
    cases += [np.frombuffer(b, np.uint8) for b in (b"banana" * 9, b"mississippi" * 5 + b"m", b"abc" * 20 + b"zz" * 11 + b"a" * 17, bytes(range(40)), bytes(range(40, 0, -1)))]
    for x in cases:
        got = [(p, c) for a, b in induced.suffixes(x, 255, limits, True) for p, c in zip(a.tolist(), b.tolist(), strict=True)]
        text = x.tobytes()
        assert [p for p, _ in got] == sorted(range(len(x)), key=lambda i, text=text: text[i:], reverse=True)
        for (p, _), (q, c) in itertools.pairwise(got):
            assert c == common_prefix(text[p:], text[q:])


@pytest.mark.parametrize("limits", [induced.Limits(deep=10_000), SMALL])
def test_strings_of_many_symbols_are_sorted_too(limits):
    rng = np.random.default_rng(5)
    for n in (1, 2, 50, 300):
        x = rng.integers(0, 5000, n)
        x = np.concatenate([x, x[: n // 2], x])
        got = [p for a, _ in induced.suffixes(x, 5000, limits) for p in a.tolist()]
        assert got == sorted(range(len(x)), key=lambda i, x=x: x[i:].tolist(), reverse=True)


def test_queues_keep_order_on_disk():
    rng = np.random.default_rng(6)
    q, want = induced.Queue([np.int64], 200, True), {}
    for k in range(40):
        b = rng.integers(0, 9, 7)
        q.push(b, [np.arange(7) + 7 * k])
        for i, x in enumerate(b.tolist()):
            want.setdefault(x, []).append(i + 7 * k)
    assert q.spilled > 0
    got = {}
    while (b := q.next()) is not None:
        got.setdefault(b, []).extend(q.pop(b, 5)[0].tolist())
    assert got == want and list(got) == sorted(got)


@pytest.mark.parametrize("limits", [induced.Limits(deep=sx.LENGTH), DISK])
def test_smaller_has_is_exact(limits):
    rng = np.random.default_rng(9)
    base = rng.integers(97, 100, (6, sx.COVER)).astype(np.uint8)
    base[3:, sx.STRINGS - 1 : sx.STRINGS - 1 + sx.GRAM] = base[:3, sx.STRINGS - 1 : sx.STRINGS - 1 + sx.GRAM]
    rows = base[rng.integers(0, 6, 60)].copy()
    for r in rows:
        if rng.random() < 0.7:
            r[rng.choice([*range(sx.STRINGS - 1), *range(sx.STRINGS - 1 + sx.GRAM, sx.COVER)])] = 120
    doc = rng.integers(0, 20, 60)
    held = [(rows[i:j].copy().view(f"V{sx.COVER}").reshape(-1), doc[i:j]) for i, j in ((0, 25), (25, 26), (26, 60))]
    got = np.concatenate(list(sx.smaller_has(iter(held), limits))).reshape(60, sx.STRINGS)
    grams = [bytes(r[sx.STRINGS - 1 : sx.STRINGS - 1 + sx.GRAM]) for r in rows]
    for i in range(60):
        for c in range(sx.STRINGS):
            w = bytes(rows[i, c : c + sx.LENGTH])
            assert got[i, c] == any(doc[k] < doc[i] and grams[k] == grams[i] and bytes(rows[k, c : c + sx.LENGTH]) == w for k in range(60)), (i, c)


def test_a_shard_larger_than_queue_and_memory():
    """The covers alone exceed what the process may allocate; files take the rest."""
    code = f"""
import resource, sys
import numpy as np
sys.path.insert(0, {str(Path(sx.__file__).parents[2])!r})
from siftwork.llm import induced, suffixes as sx
limits = induced.Limits(room=1 << 20, chunk=1 << 14, base=1 << 15, deep=sx.LENGTH, small=1 << 18)
rng = np.random.default_rng(1)
base = rng.integers(97, 123, (500, sx.COVER)).astype(np.uint8)
def rows():
    for k in range(400):
        r = base.copy()
        r[np.arange(500), np.where(rng.random(500) < 0.5, 0, sx.COVER - 1)] = 65 + k % 57
        yield r.view(f"V{{sx.COVER}}").reshape(-1), np.full(500, k)
list(sx.smaller_has(iter([next(rows())]), limits))
used = next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("VmData")) << 10
resource.setrlimit(resource.RLIMIT_DATA, (used + {12 << 20}, -1))
try:
    np.ones({400 * 500 * sx.COVER}, np.uint8).sum()
    raise SystemExit("the limit doesn't hold")
except MemoryError:
    pass
n = sum(int(x.reshape(500, -1)[:, 1:sx.STRINGS - 1].all(axis=1).sum()) for x in sx.smaller_has(rows(), limits))
print(n)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split()[-1]) == 399 * 500


@pytest.mark.parametrize("many", [0, 2, 12])
def test_hot_minimizers_are_split(spark, many):
    rng = random.Random(7)
    common = "thequickbrownfoxjumpsoverthelazydog"
    side = ["".join(rng.choice("abc") for _ in range(14)) for _ in range(6)]
    rows = [(i, " ".join(rng.choice(side) + common + rng.choice(side) for _ in range(3))) for i in range(60)]
    rows += [(100 + i, " ".join(rng.choice(side) + common + rng.choice(side) for _ in range(i % 4))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id").sortWithinPartitions("doc_id")
    got = {r.doc_id: tuple(r)[1:] for r in sx.repeats(df, many=many).collect()}
    assert got == plain(rows)


def test_only_what_can_be_in_a_common_string_is_sorted(monkeypatch):
    """Covers of one gram that share less than a string are not sorted, others without what no other cover shares."""
    sizes, sort = [], induced.suffixes
    monkeypatch.setattr(induced, "suffixes", lambda x, *a: sizes.append(len(x)) or sort(x, *a))
    rng = np.random.default_rng(11)
    rows = np.tile(rng.integers(97, 123, sx.COVER).astype(np.uint8), (400, 1))
    side = sx.STRINGS - 1
    rows[:, : side - 9] = rng.integers(97, 123, (400, side - 9))
    rows[:, side + sx.GRAM + 9 :] = rng.integers(97, 123, (400, side - 9))
    told = lambda: np.concatenate(list(sx.smaller_has(iter([(rows.view(f"V{sx.COVER}").reshape(-1), np.arange(400))]))))
    assert not told().any() and sum(sizes) == 0
    rows[3, : side + sx.GRAM + 8] = rows[2, : side + sx.GRAM + 8]
    rows[3, side + sx.GRAM + 8 :] = 67
    sizes.clear()
    assert told().reshape(400, -1).sum(axis=1).tolist() == [0, 0, 0, 9, *[0] * 396] and sum(sizes) < 4 * sx.COVER


@pytest.mark.parametrize("chunk", [3, 40, 1 << 18])
def test_cut_covers_lose_and_add_no_string(chunk):
    """Grams with more covers than are compared at once, covers at the ends of texts, runs of one byte."""
    rng = np.random.default_rng(chunk)
    side, n = sx.STRINGS - 1, 300
    base = rng.integers(97, 99, (20, sx.COVER)).astype(np.uint8)
    base[:, side : side + sx.GRAM] = base[rng.integers(0, 3, 20)][:, side : side + sx.GRAM]
    base[5:8] = 97
    rows = base[rng.integers(0, 20, n)].copy()
    for r in rows:
        for _ in range(rng.integers(0, 3)):
            r[rng.choice([*range(side), *range(side + sx.GRAM, sx.COVER)])] = 120
        r[: rng.choice([0, 0, 7, side])] = sx.BEYOND
        r[sx.COVER - rng.choice([0, 0, 9, side]) :] = sx.BEYOND
    doc = rng.integers(0, 60, n)
    limits = induced.Limits(room=4000, chunk=chunk, base=8, small=256)
    got = np.concatenate(list(sx.smaller_has(iter([(rows.view(f"V{sx.COVER}").reshape(-1), doc)]), limits))).reshape(n, sx.STRINGS)
    grams, least = [bytes(r[side : side + sx.GRAM]) for r in rows], {}
    texts = [[bytes(r[c : c + sx.LENGTH]) for c in range(sx.STRINGS)] for r in rows]
    for i, c in itertools.product(range(n), range(sx.STRINGS)):
        k = grams[i], c, texts[i][c]
        least[k] = min(least.get(k, doc[i]), doc[i])
    inside = [(i, c) for i, c in itertools.product(range(n), range(sx.STRINGS)) if sx.BEYOND not in texts[i][c]]
    assert all(got[i, c] == (least[grams[i], c, texts[i][c]] < doc[i]) for i, c in inside) and 500 < sum(got[i, c] for i, c in inside) < len(inside)


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(12)
    for text in (rng.integers(97, 99, 70_000), rng.integers(97, 123, 140_000), np.full(66_000, 97)):
        raw = text.astype(np.uint8)
        valid = np.ones(len(raw) - sx.LENGTH + 1, bool)
        whole, rest = sx.anchored(raw, valid), sx.anchored(raw[41:].copy(), valid[41:])
        assert (np.diff(whole) <= sx.STRINGS).all() and set(rest + 41) <= set(whole) and set(whole[whole >= 41 + sx.STRINGS]) <= set(rest + 41)
        assert (sx.gram_hashes(raw, rest + 41) == sx.gram_hashes(raw[41:].copy(), rest)).all()
