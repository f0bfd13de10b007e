"""Rows that no earlier kept one resembles, against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siftwork.functions import text as X
from siftwork.operators import dedup
from siftwork.plans import catalog
from siftwork.plans.fixtures import table

catalog.load()


def plain(sets):
    """Of id: set those kept, in the order of ids; equal sets and empty ones are the caller's."""
    kept = []
    for i in sorted(sets):
        if all(len(sets[i] & sets[k]) / len(sets[i] | sets[k]) < 0.7 for k in kept):
            kept.append(i)
    return kept


def shuffled(doc_id):
    return f"{hashlib.md5(f'42|{doc_id}'.encode()).hexdigest()}|{doc_id}"


def test_downsampling_reads_whole_texts(spark, tmp_path):
    """Texts of one beginning of 500 characters and unlike ends, of unlike beginnings and one long end, and long copies."""
    rng = random.Random(5)
    some = lambda n: "".join(rng.choices("abcdefghijklmnoprstuvw ÄÉİ😀", k=n))
    head, end = some(500), some(9000)
    texts = [head + some(1500) if i % 3 == 0 else some(500) + end if i % 3 == 1 else head + end[: 3000 + i] for i in range(240)] + [head, head, "", "ab", "abc", None, None, some(60000)] * 6
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    scope = table(spark, str(tmp_path), "labelled").where("tech = 'OOS'").select("doc_id", F.lower("body").alias("t")).collect()
    sets, seen = {}, set()
    for r in sorted(scope, key=lambda r: shuffled(r.doc_id)):
        g = None if r.t is None else frozenset(r.t[i : i + 3] for i in range(len(r.t) - 2))
        if g not in seen:
            seen.add(g)
            sets[shuffled(r.doc_id), r.doc_id] = g
    want = [i for _, i in plain({k: g for k, g in sets.items() if g})] + [i for (_, i), g in sets.items() if not g]
    got = [r.doc_id for r in catalog.QUERIES["diversity_downsample"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and {None, frozenset()} <= seen
    assert sum(i < 240 and i % 3 == 0 for i in want) > 20  # they begin alike


def test_gram_codes_are_the_grams(spark):
    texts = ["", "ab", "aBc", "abcabc", "İxx", "😀é😀é😀", "a" * 100, None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).orderBy("i").select(X.gram_codes(F.col("t"))).collect()]
    chars = lambda g: "".join(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0))
    assert got[-1] is None
    for t, g in zip(texts[:-1], got[:-1], strict=True):
        low = t.lower()
        assert g == sorted(g) and sorted(map(chars, g)) == sorted({low[i : i + 3] for i in range(len(low) - 2)})


@pytest.mark.parametrize("block, part, own", [(1 << 14, 2048, 1 << 14), (300, 20, 1 << 14), (300, 20, 90), (1000, 1, 1)])
def test_greedy_unlike_is_the_plain_loop(spark, block, part, own):
    """Sets at the very threshold, of many sizes, in large groups; items with and without a bit of their own."""
    rng = random.Random(own)
    base = [rng.sample(range(3000), n) for n in (4, 10, 17, 60, 120, 300, 700, 1500) for _ in range(4)]
    sets = [set(b[k:]) | set(rng.sample(range(3000, 6000), k)) for b in base for k in (0, 1, len(b) * 3 // 17, len(b) * 3 // 17 + 1, len(b) // 3)]
    sets += [set(range(6000, 6017)), set(range(6003, 6020))]  # 14 of 20: 0.7
    sets += [set(rng.sample(range(7000, 7060), 50)) for _ in range(700)]
    rng.shuffle(sets)
    rows = {hashlib.md5(str(i).encode()).hexdigest(): s for i, s in enumerate(sets)}
    data = [(i, sorted(s), int(i[:8], 16) / 2**32) for i, s in rows.items()] + [("0" * 32, [], 0.0), ("f" * 32, None, 0.99)]
    df = dedup.written(spark.createDataFrame(data, "id string, g array<long>, place double").repartition(3))
    got = [r.id for r in dedup.greedy_unlike(df, 0.7, block, part, own).collect()]
    assert sorted(got) == sorted([*plain(rows), "0" * 32, "f" * 32])


def test_greedy_unlike_of_rows_without_items(spark):
    schema = "id string, g array<long>, place double"
    assert dedup.greedy_unlike(spark.createDataFrame([], schema), 0.7).collect() == []
    assert sorted(r.id for r in dedup.greedy_unlike(spark.createDataFrame([("a", [], 0.1), ("b", None, 0.9)], schema), 0.7).collect()) == ["a", "b"]
