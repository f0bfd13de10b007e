"""Selections that have no SQL, against plain versions."""

import hashlib
import random

from siftwork.operators import sampling as S
from siftwork.plans import catalog, sampling
from siftwork.plans.fixtures import table

SF = "/root/testdata/sf0.001"
catalog.load()


def plain_gaps(rows, goals, total):
    """The reference's loop: every row left is scored at each step."""
    fields, have, out, left = ["loc", "arr", "sen", "comp"], {}, {}, sorted(rows)
    while left and sum(out.values()) < total:
        scored = []
        for r in left:
            score, hard = 0.0, 0
            for f, t in zip(fields, r, strict=True):
                target = goals.get((f, t), 0)
                gap = target - have.get((f, t), 0)
                if f in ("loc", "comp"):
                    if gap > 0:
                        score += gap * (1 + gap / max(target, 1))
                    else:
                        score -= 30 + abs(gap) * 3
                        hard += 1
                else:
                    score += gap * 0.5 if gap > 0 else -5
            scored.append(score - (150 if hard >= 3 else 0))
        best = max(scored)
        if best <= -50:
            break
        r = left.pop(scored.index(best))
        out[r] = out.get(r, 0) + 1
        for f, t in zip(fields, r, strict=True):
            have[f, t] = have.get((f, t), 0) + 1
    return out


def test_gaps_are_filled_to_the_full_targets(spark):
    goals = {(r.field, r.token): r.target for r in table(spark, SF, "targets").collect()}
    rows = [tuple(r) for r in table(spark, SF, "labelled").select("loc", "arr", "sen", "comp").collect()]
    for total in (20, 1200):
        got = {}
        for r in sampling.gap_greedy_select(spark, SF, total).collect():
            got[tuple(r)[1:]] = got.get(tuple(r)[1:], 0) + 1
        assert got == plain_gaps(rows, goals, total)


def test_caps_count_only_rows_that_are_taken(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("xy"), rng.choice(["a", "b", None]), rng.choice("pqr")) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, label string, loc string, comp string").repartition(3)
    room = {"label": {"x": 500, "y": 300}, "loc": {"a": 210, "b": 0}, "comp": {"p": 150, "q": 90}}
    left, want = {(f, t): n for f in room for t, n in room[f].items()}, []
    for i, *tokens in sorted(rows, key=lambda r: hashlib.md5(f"42|{r[0]}".encode()).hexdigest()):
        at = [x for x in zip(room, tokens, strict=True) if x in left]
        if all(left[x] > 0 for x in at):
            want.append(i)
            for x in at:
                left[x] -= 1
    got = [r.doc_id for r in S.coupled(df, room, S.shuffled(42, "doc_id")).collect()]
    assert sorted(got) == sorted(want) and len(got) > 300


def test_whole_tables_are_taken(spark):
    n = table(spark, SF, "labelled").count()
    assert catalog.QUERIES["variant_grid"](spark, SF).count() == 4 * n
    jobs = table(spark, SF, "jobs")
    assert catalog.QUERIES["min_length"](spark, SF).count() == jobs.where("length(trim(body)) >= 30 and job_id <> ''").count()


def test_v11_build_is_one_coupled_pass(spark):
    rows = table(spark, SF, "labelled").select("doc_id", "label", "loc", "comp").collect()
    got = sampling.v11_build(spark, SF).collect()
    total = len(rows) // 2
    picked = {r.doc_id for r in got}
    caps = {t: int(total * share) for of in sampling.CAPS.values() for t, share in of.items()}
    size = {k: sum(r.label == k for r in got) for k in sampling.ORDER}
    used = {}
    for r in sorted(rows, key=lambda r: hashlib.md5(f"42|{r.doc_id}".encode()).hexdigest()):
        room = all(t not in caps or used.get(t, 0) < caps[t] for t in (r.loc, r.comp))
        if r.doc_id in picked:
            assert room
            for t in (r.label, r.loc, r.comp):
                used[t] = used.get(t, 0) + 1
        else:  # a row that its caps let through is refused only once its label is full
            assert not room or used.get(r.label, 0) == size[r.label]
