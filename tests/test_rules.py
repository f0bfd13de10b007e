"""Edge cases of classifiers, repair, truncation and greedy selection."""

import hashlib
import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from siftwork import versions
from siftwork.functions import extract as E
from siftwork.functions import repair, rules
from siftwork.functions import text as X
from siftwork.functions import tokens as T
from siftwork.operators import dedup, label, sampling
from siftwork.sources import io
from siftwork.streaming import runlog


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "place,token",
    [(None, "UNK"), ("  ", "UNK"), ("Londonderry", "UNK"), ("Little London, UK", "UK_OTHER"), ("Greater London", "IN_LONDON"), ("Singapore (Remote)", "OUTSIDE_UK"), ("Belfast, Northern Ireland", "UK_OTHER"), ("Dublin", "OUTSIDE_UK"), ("Springfield, IL", "OUTSIDE_UK"), ("Anywhere", "REMOTE"), ("Indiana", "OUTSIDE_UK"), ("Leeds", "UK_OTHER")],
)
def test_locations(spark, place, token):
    assert one(spark, rules.location(F.col("p")), p=place) == token


@pytest.mark.parametrize(
    "text,token",
    [("£45,000", "RANGE_45_54K"), ("£100,000 - £100,000", "ABOVE_100K"), ("£90k–£110k", "ABOVE_100K"), ("£80k+", "NO_GBP"), ("a £1.4 trillion market", "NO_GBP"), ("OTE £60,000", "NO_GBP"), ("£400 - £500 per day", "NO_GBP"), ("TC £120k", "NO_GBP"), ("60k GBP", "NO_GBP"), ("between £30k and £40k", "BELOW_45K"), ("salary to £70k", "UP_TO_ONLY"), ("£70k to £60k", "RANGE_55_74K"), ("", "NO_GBP")],
)
def test_salaries(text, token):
    assert rules.salary(text, "") == token


def test_salary_in_the_title():
    assert rules.salary("nothing here", "Engineer £62k") == "RANGE_55_74K"


@pytest.mark.parametrize(
    "text,tokens",
    [("We need JS, and SQL", ["JS_TS"]), ("vue.js,", ["OOS"]), ("ai models", ["OOS"]), ("email us", ["OOS"]), ("an ai, please", ["AI_ML"]), ("we use AI in our hiring process", ["OOS"]), ("NodeJavaScript", ["NODE", "JS_TS"]), ("React.js and LLM", ["REACT", "AI_ML"]), (None, ["OOS"])],
)
def test_stacks(spark, text, tokens):
    assert one(spark, rules.stack(F.col("t"), F.lit("")), t=text) == tokens


def test_scores_gate_and_clamp(spark):
    df = spark.createDataFrame([("IN_LONDON", "LEVEL_3", ["NODE", "AI_ML"], "ABOVE_100K"), ("REMOTE", "LEVEL_3", ["OOS"], "NO_GBP"), ("OUTSIDE_UK", "LEVEL_2", [], "BELOW_45K"), ("UNK", "x", ["NODE", "NODE"], None)], "loc string, sen string, tech array<string>, comp string")
    s = T.scores(F.col("loc"), F.col("sen"), F.col("tech"), F.col("comp"))
    assert [(r.score, r.label) for r in df.select(s["score"].alias("score"), s["label"].alias("label")).collect()] == [(95, "good_fit"), (25, "bad_fit"), (0, "bad_fit"), (20, "bad_fit")]


def test_validation(spark):
    v = T.validated(F.col("loc"), F.lit("remote"), F.lit("LEVEL_3"), F.col("tech"), F.lit("NO_GBP"))
    get = lambda loc, tech: spark.createDataFrame([(loc, tech)], "loc string, tech array<string>").select(*[c.alias(k) for k, c in v.items()]).first()
    r = get("in_londn", ["OOS", "node", "NODE"])
    assert r.valid and r.loc == "IN_LONDON" and r.tech == ["NODE"] and len(r.repairs) == 2
    assert get("LONDINIUM", ["NODE"]).errors == ["Invalid loc: LONDINIUM"]
    assert get(None, ["NODE"]).errors == ["Missing field: loc"]
    assert get("UNK", []).tech == ["OOS"] and not get("UNK", ["COBOL-85"]).valid


@pytest.mark.parametrize("raw,loc", [('{"loc": "UNK", "tech": ["NODE"]}', "UNK"), ("```json\n{loc: \"UNK\", tech: [\"NODE\"]}\n```", "UNK"), ('{"loc": "UNK", "tech": ["NODE"', "UNK"), ('so: {"loc": "UNK"} done', "UNK"), ("none", None), ("", None), (None, None)])
def test_json_repair(spark, raw, loc):
    p = one(spark, repair.parsed(F.col("r")), r=raw)
    assert (p.loc if p else None) == loc


def test_preprocessing_is_idempotent(spark):
    text = "A &amp; B &#163;5​\r\n\r\n\r\n\r\n x \t y\n## Privacy policy\nlong talk"
    once = one(spark, repair.preprocessed(F.col("t")), t=text)
    assert once == "A & B £5\n\nx y" and one(spark, repair.preprocessed(F.col("t")), t=once) == once
    assert one(spark, repair.preprocessed(F.col("t")), t=None) == ""


def cut_plainly(text, most):
    """Truncation word by word, for comparison."""
    if -(-len(text) // 4) <= most:
        return text
    words = re.split(r"\s+", text)
    n = len(words)
    spared = set(range(min(300, n))) | set(range(max(0, n - 200), n))
    for i, w in enumerate(words):
        if re.search(r"[£$€]|salary|compensation|pay|per annum|p\.a\.", w, re.I):
            spared |= set(range(max(0, i - 50), min(n, i + 50)))
    runs = [(k, len(list(g))) for k, g in itertools.groupby(range(n), key=lambda i: i in spared)]
    at, best = 0, (0, 0)
    for kept, size in runs:
        if not kept and size > best[1]:
            best = (at, size)
        at += size
    if not best[1]:
        return text[: most * 4] + " [...]"
    gone = n - most * 4 // 6
    if gone <= 0:
        return text
    first = best[0] + (best[1] - gone) // 2
    return " ".join([*words[: max(0, first)], "[...]", *words[min(first + gone, sum(best)) :]])


def test_truncation_spares_head_tail_and_pay(spark):
    rng = random.Random(4)
    texts = ["short", "x" * 9000]
    for n in (400, 900, 2500, 4000):
        words = [f"w{i}" for i in range(n)]
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(n)] = rng.choice(["Salary", "£50k", "pay", "p.a."])
        texts += [" ".join(words), "\n".join(words)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for most in (200, 1000):
        got = {r.i: r.x for r in df.select("i", E.truncated(F.col("t"), most).alias("x")).collect()}
        assert got == {i: cut_plainly(t, most) for i, t in enumerate(texts)}


def chunks_plainly(text):
    """Chunks with scores and flags, the first of those that differ in case alone."""
    own = lambda s: re.sub(r"\s+", " ", s).strip()
    bare = text.replace("\r", "").strip()
    lines = [x for x in map(own, re.split("\n+", bare)) if x]
    parts = lines if len(lines) >= 8 else [x for x in map(own, re.split(r"(?<=[.!?])\s+", bare)) if x]
    out, seen = [], set()
    for i, c in enumerate(parts):
        if c.lower() not in seen:
            seen.add(c.lower())
            f = {k: any(re.search(p, c, re.I | re.A) for p in ps) for k, ps in E.FLAGS.items()}
            score = sum(n for k, n in E.POINTS.items() if f[k]) + bool(re.match(r"\s*[-*•]", c)) - (len(c) < 24)
            counter = f["abroad"] or f["other_tech"] or f["foreign_pay"]
            critical = counter or any(f[k] for k in ("salary", "place", "tech", "level", "need"))
            out.append({"i": i, "c": c, "score": score, "counter": counter, "critical": critical, "salience": score + 4 * counter + 2 * f["salary"] + f["place"] - 5 * (f["drop"] and not critical), **f})
    return out


def ranked_plainly(text, most, least=3):
    cs = chunks_plainly(text)
    if not cs:
        return re.sub(r"\s+", " ", text).strip()[:most]
    kept, used = [cs[0]], len(cs[0]["c"]) + 1
    for c in sorted((c for c in cs[1:] if c["score"] >= least), key=lambda c: (-c["score"], c["i"])):
        if used + len(c["c"]) + 1 <= most:
            kept.append(c)
            used += len(c["c"]) + 1
    return "\n".join(c["c"] for c in sorted(kept if len(kept) > 1 else cs, key=lambda c: c["i"]))[:most].strip()


def selective_plainly(text, most, least=3):
    cs = chunks_plainly(text)
    if not cs:
        return re.sub(r"\s+", " ", text).strip()[:most]
    kept, used = {}, 0

    def add(found, quota=None):
        nonlocal used
        n = 0
        for c in found:
            if (quota is None or n < quota) and c["i"] not in kept and used + len(c["c"]) + 1 <= most:
                kept[c["i"]], used, n = c, used + len(c["c"]) + 1, n + 1

    add(cs[:2])
    add([c for c in cs if c["counter"]], max(3, most // 900))
    add([c for c in cs[::-1] if c["critical"] or c["counter"]], 3)
    if not any(c["other_tech"] for c in kept.values()):
        add([c for c in cs if c["other_tech"]][:1])
    add([c for c in cs if c["salary"] and not c["foreign_pay"]][:1])
    add([c for c in cs if c["salary"] and c["foreign_pay"]][:1])
    add(sorted((c for c in cs if c["critical"] or c["score"] >= least or not c["drop"]), key=lambda c: (-c["salience"], c["i"])), max(8, most // 300))
    add([c for c in cs if not c["drop"] or c["critical"]])
    return "\n".join(c["c"] for c in (sorted(kept.values(), key=lambda c: c["i"]) if len(kept) > 1 else cs))[:most].strip()


SAID = ["Intro line here.", "Salary is £50k per annum in London!", "We use Python, SQL and AWS daily.", "Senior Node.js developer required?", "Equal opportunity and diversity matter.", "Apply now.", "- remote work", "Paid in $ and EUR.", "Based in Berlin or New York.", "What you'll bring: skills.", "filler words and more of them here.", "FILLER words and more of them here.", "Écran día plan.", "Our mission is our privacy policy."]


def test_extracts_are_what_a_plain_reading_gives(spark):
    rng = random.Random(6)
    texts = ["", " \n ", "one line"]
    for _ in range(60):
        some = [rng.choice(SAID) for _ in range(rng.randint(1, 25))]
        texts.append(rng.choice([" ", "\n", "\r\n"]).join(some))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for most in (60, 300, 2200):
        for own, plainly in ((E.ranked, ranked_plainly), (E.selective, selective_plainly)):
            got = {r.i: r.x for r in df.select("i", own(F.col("t"), most=most).alias("x")).collect()}
            assert got == {i: plainly(t, most) for i, t in enumerate(texts)}, (own.__name__, most)


def test_versions_inherit_and_name_a_default(spark, monkeypatch):
    assert versions.resolved("v13.1").senior == "LEVEL_3" and versions.resolved("v13.1").numeric is False and versions.resolved("v12").fallback == "LEVEL_1"
    monkeypatch.setenv("SIFTWORK_VERSION", "v12")
    assert one(spark, versions.resolved().seniority(F.col("t")), t="Senior Engineer") == "LEVEL_2"
    with pytest.raises(ValueError):
        versions.resolved("v99")


def test_labelling_tries_again_and_reports(spark):
    def model(text, attempt):
        if text == "bad" or text == "slow" and attempt < 3:
            raise TimeoutError("no")
        return text.upper()

    df = spark.createDataFrame([("a", "ok"), ("b", "slow"), ("c", "bad")], "job_id string, t string")
    done = label.labelled_by(df, model, "t")
    got = {r.job_id: (r.output, r.attempts, r.status) for r in label.outcomes(done, F.col("output") == "OK").collect()}
    assert got == {"a": ("OK", 1, "success"), "b": ("SLOW", 3, "inconsistency"), "c": (None, 3, "failure")}
    with pytest.raises(RuntimeError):
        label.checked(done, 0)


def test_ranks_by_hash_are_ranks(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else None, i % 2) for i in range(400)], "id long, s string, k int")
    rows = sampling.hash_ranked(df, ["s", "k"], sampling.shuffled(7, "id"), "rn", "n").collect()
    by = {}
    for r in rows:
        by.setdefault((r.s, r.k), []).append(r)
    for found in by.values():
        order = sorted(found, key=lambda r: hashlib.md5(f"7|{r.id}".encode()).hexdigest())
        assert [r.rn for r in order] == list(range(1, len(found) + 1)) and {r.n for r in found} == {len(found)}


def test_greedy_kept_follows_the_order(spark):
    ids = spark.createDataFrame([(i,) for i in range(6)], "id long")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (4, 5)], "a long, b long")
    assert sorted(r.id for r in dedup.greedy_kept(ids, pairs).collect()) == [0, 2, 4]
    assert sorted(r.id for r in dedup.greedy_kept(ids, pairs.limit(0)).collect()) == list(range(6))


def test_similar_pairs_are_all_pairs(spark):
    sets = {i: {f"t{(i * k) % 17}" for k in range(1, 7)} for i in range(1, 40)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()] + [(99, []), (98, None)], "id long, s array<string>")
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    assert want and {(r.a, r.b) for r in dedup.similar_pairs(df, "id", "s", 0.7).collect()} == want


@pytest.mark.parametrize("sizes,count", [({"a": 500, "b": 300, "c": 3}, 100), ({"a": 1, "b": 1, "c": 1000}, 10), ({"a": 5, "b": 5, "c": 5}, 100), ({"a": 0, "b": 7, "c": 7}, 3)])
def test_proportional_allocation(sizes, count):
    got = sampling.proportional(sizes, count)
    assert sum(got.values()) == min(count, sum(sizes.values())) and all(1 <= got[k] <= sizes[k] for k in got)


def test_wilson_without_cases_and_at_the_ends(spark):
    df = spark.createDataFrame([(0, 0), (5, 5), (0, 5)], "c long, n long")
    low, high = T.wilson(F.col("c"), F.col("n"))
    got = [(round(r.l, 3), round(r.h, 3)) for r in df.select(low.alias("l"), high.alias("h")).collect()]
    assert got[0] == (0.0, 0.0) and got[1][1] == 1.0 and got[2][0] == 0.0


def test_lines_csv_exports_and_manifest(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('# c\n\n{"id": "1", "n": 2}\n')
    assert [tuple(r) for r in io.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string, n long").collect()] == [("1", 2)]
    (tmp_path / "b.csv").write_text('﻿id,said\n1,"a ""b"",\nc"\n', encoding="utf-8")
    assert [tuple(r) for r in io.read_csv(spark, str(tmp_path / "b.csv")).collect()] == [("1", 'a "b",\nc')]
    for name, body in (("c", [{"id": "1"}]), ("d", {"jobs": [{"id": "1"}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
        assert [r.id for r in io.read_exports(spark, str(tmp_path / f"{name}.json"), "id string").collect()] == ["1"]
    df = spark.createDataFrame([(1, "x", None), (2, "y", "q"), (3, "x", "é")], "k long, label string, t string")
    io.write_jsonl(df, str(tmp_path / "out"))
    assert '{"k":1,"label":"x","t":null}' in [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        io.write_jsonl(df, str(tmp_path / "out"))
    a, b = (io.manifest(x, "label", "k").first() for x in (df, df.repartition(3)))
    assert a == b and a.n == 3 and a.by_label == {"x": 2, "y": 1}
    io.append_log(df.limit(1), str(tmp_path / "log"))
    assert len(io.golden_errors(df.selectExpr("cast(k as string) job_id", "label title", "label company", "t jd_text", "label", "1 score", "t reasoning")).collect()) == 9


def test_run_log_stream(spark, tmp_path):
    rows = [{"run": "r", "kind": "job", "ts": f"2026-01-01T00:0{i}:00Z", "ok": i % 3 == 0, "tokens": i} for i in range(8)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    q = runlog.counts(runlog.read(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("runlog").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.n, r.failed, r.tokens) for r in spark.table("runlog").collect()) == [(3, 2, 18), (5, 3, 10)]


@pytest.mark.parametrize("block", [7, 1000])
def test_sketched_pairs_are_all_pairs_and_few_others(spark, block, monkeypatch):
    """Items that all sets hold in turn, so every prefix meets every other one; sets at the very threshold; long and empty ones."""
    rng = random.Random(block)
    base = [rng.sample(range(400), 120) for _ in range(12)]
    sets = [[*b[k:], *rng.sample(range(400, 600), k)] for b in base for k in (0, 3, 21, 22)] + [[], [1], [1], list(range(5000)), list(range(900, 5900))]
    sets += [list(range(600, 617)), list(range(603, 620))]  # 14 of 20: 0.7
    df = spark.createDataFrame([(f"r{i:03}", [f"w{x}" for x in s]) for i, s in enumerate(sets)], "id string, s array<string>").repartition(3)
    alike = lambda a, b: a and b and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.7
    want = {(f"r{i:03}", f"r{k:03}") for i, k in itertools.combinations(range(len(sets)), 2) if alike(sets[i], sets[k])}
    met, confirmed = [], dedup._confirmed
    monkeypatch.setattr(dedup, "_confirmed", lambda pairs, *a: met.append(pairs) or confirmed(pairs, *a))
    got = [(r.a, r.b) for r in dedup.sketched_pairs(df, "id", "s", 0.7, block).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30
    assert met[0].count() < len(sets) ** 2 / 10
