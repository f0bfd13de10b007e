"""Extracts of long texts: chunks with scores and flags, the best of them within a budget of characters, and truncation
around protected passages. Expressions; what several parts read is bound once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.functions.text import BLANK, let

# What chunks are scored and flagged by.
DROP = [r"\bequal opportunity\b", r"\bdiversity\b", r"\binclusion\b", r"\bprivacy policy\b", r"\bcookie(s)?\b", r"\bterms and conditions\b", r"\bhow to apply\b", r"\bapply now\b", r"\bour mission\b", r"\babout (the )?company\b", r"\bbenefits include\b", r"\bperks\b"]
SALARY = [r"£", r"\bsalary\b", r"\bcompensation\b", r"\bpay\b", r"\bper annum\b", r"\bannum\b", r"\bp\.?a\.?\b", r"\bday rate\b"]
FOREIGN_PAY = [r"\$", r"€", r"\busd\b", r"\beur\b", r"\bdollar(s)?\b", r"\beuro(s)?\b"]
PLACE = [r"\bremote\b", r"\bhybrid\b", r"\bon[- ]?site\b", r"\bin[- ]?office\b", r"\blondon\b", r"\buk\b", r"\bunited kingdom\b", r"\blocation\b", r"\bbased in\b"]
ABROAD = [
    r"\boutside (the )?uk\b",
    r"\b(united states|usa|u\.s\.a\.|canada|australia|germany|france|spain|italy|india|singapore|poland|netherlands|ireland)\b",
    r"\b(san francisco|new york|toronto|sydney|berlin|dublin|amsterdam|warsaw|bengaluru)\b",
]
TECH = [r"\bnode(\.js|js)?\b", r"\breact(\.js|js)?\b", r"\btypescript\b", r"\bjavascript\b", r"\bai\b", r"\bmachine learning\b", r"\bml\b", r"\bbackend\b", r"\bfrontend\b", r"\bfull[- ]?stack\b"]
OTHER_TECH = [r"\bpython\b", r"\bjava\b", r"\bc#\b", r"\bc\+\+\b", r"\bphp\b", r"\bruby\b", r"\bgolang\b", r"\bgo\b", r"\bdotnet\b", r"\b\.net\b", r"\bvue\b", r"\bangular\b", r"\baws\b", r"\bterraform\b", r"\bdocker\b", r"\bkubernetes\b", r"\bsql\b", r"\bsnowflake\b"]
LEVEL = [r"\bjunior\b", r"\bgraduate\b", r"\bentry[- ]?level\b", r"\bsenior\b", r"\blead\b", r"\bstaff\b", r"\bprincipal\b", r"\bmanager\b", r"\bintern(ship)?\b"]
NEED = [r"\brequirements?\b", r"\bmust have\b", r"\bexperience with\b", r"\bwhat (you('|’)ll|you will) bring\b", r"\bskills?\b", r"\bresponsibilit(y|ies)\b"]
FLAGS = {"salary": SALARY, "place": PLACE, "tech": TECH, "level": LEVEL, "need": NEED, "drop": DROP, "other_tech": OTHER_TECH, "abroad": ABROAD, "foreign_pay": FOREIGN_PAY}
POINTS = {"salary": 6, "place": 5, "tech": 4, "level": 3, "need": 2, "drop": -8}
BULLET = r"^\s*[-*•]"
PAY_WORD = r"(?i)[£$€]|salary|compensation|pay|per annum|p\.a\."
HEAD_WORDS, TAIL_WORDS, PAY_WORDS = 300, 200, 50


def plain(c: Column) -> Column:
    """c with letters that aren't ASCII as signs, so that the edges of words are those of ASCII letters and digits."""
    return F.regexp_replace(c, "[^\\x00-\\x7F£€’•]", "¤")


def any_of(c: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns is in c, which plain() made."""
    return F.rlike(c, F.lit("(?i)" + "|".join(f"(?:{p})" for p in patterns)))


def norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def chunks(text: Column) -> Column:
    """Lines where there are eight or more, else sentences; without white space around."""
    bare = F.regexp_replace(F.regexp_replace(text, "\r", ""), f"^{BLANK}+|{BLANK}+$", "")
    tidy = lambda parts: F.filter(F.transform(parts, norm), lambda x: x != "")
    return let(bare, lambda t: let(tidy(F.split(t, "\n+")), lambda lines: F.when(F.size(lines) >= 8, lines).otherwise(tidy(F.split(t, f"(?<=[.!?]){BLANK}+")))))


def _score(c: Column, flag) -> Column:
    total = F.when(F.rlike(c, F.lit(BULLET)), 1).otherwise(0) - F.when(F.length(norm(c)) < 24, 1).otherwise(0)
    for name, n in POINTS.items():
        total = total + F.when(flag(name), n).otherwise(0)
    return total


def chunk_score(c: Column) -> Column:
    """Pay 6, place 5, stack 4, seniority 3, requirement 2, bullet 1; company talk -8, very short -1."""
    return let(plain(c), lambda p: _score(c, lambda name: any_of(p, FLAGS[name])))


def scored(text: Column, flags: bool = False) -> Column:
    """The chunks of a text, the first of those that differ in case alone, as structs: i, c, score and, if asked for, the
    flags of FLAGS, counter, critical and salience."""

    def distinct(cs: Column) -> Column:
        low = F.transform(cs, F.lower)
        return let(low, lambda ls: F.filter(F.transform(cs, lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda x: F.array_position(ls, F.lower(x["c"])) == x["i"] + 1))

    def flagged(x: Column) -> Column:
        own = let(plain(x["c"]), lambda t: F.struct(*[any_of(t, p).alias(k) for k, p in FLAGS.items()]))

        def full(f: Column) -> Column:  # f: the flags
            counter = f["abroad"] | f["other_tech"] | f["foreign_pay"]
            critical = counter | f["salary"] | f["place"] | f["tech"] | f["level"] | f["need"]
            score = _score(x["c"], lambda name: f[name])
            one = lambda c, n: F.when(c, n).otherwise(0)
            salience = score + one(counter, 4) + one(f["salary"], 2) + one(f["place"], 1) + one(f["drop"] & ~critical, -5)
            return F.struct(x["i"].alias("i"), x["c"].alias("c"), score.alias("score"), f["drop"].alias("drop"), critical.alias("critical"), counter.alias("counter"), f["salary"].alias("salary"), f["foreign_pay"].alias("foreign_pay"), f["other_tech"].alias("other_tech"), salience.alias("salience"))

        return let(own, full)

    unflagged = lambda x: F.struct(x["i"].alias("i"), x["c"].alias("c"), chunk_score(x["c"]).alias("score"))
    return let(chunks(text), lambda cs: F.transform(distinct(cs), flagged if flags else unflagged))


def _rendered(kept: Column, most: int) -> Column:
    """Chunks in the order of the text, a line each."""
    return F.trim(F.substring(F.array_join(F.transform(F.array_sort(kept, lambda a, b: a["i"] - b["i"]), lambda x: x["c"]), "\n"), 1, most))


def ranked(text: Column, least: int = 3, most: int = 2200) -> Column:
    """The first chunk and the best others that fit a budget of characters; all chunks, cut, where no more than one is."""
    better = lambda a, b: F.when(a["score"] != b["score"], b["score"] - a["score"]).otherwise(a["i"] - b["i"])

    def chosen(all_: Column) -> Column:
        order = F.concat(F.slice(all_, 1, 1), F.array_sort(F.filter(F.slice(all_, 2, F.greatest(F.size(all_), F.lit(1))), lambda x: x["score"] >= least), better))
        small = F.transform(order, lambda x, k: F.struct(x["i"].alias("i"), x["c"].alias("c"), (k == 0).alias("first")))
        start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<i:int,c:string>>").alias("kept"))

        def step(acc, x):
            n = acc["used"] + F.length(x["c"]) + 1
            return F.when(x["first"] | (n <= most), F.struct(n.alias("used"), F.concat(acc["kept"], F.array(F.struct(x["i"].alias("i"), x["c"].alias("c")))).alias("kept"))).otherwise(acc)

        picked = F.aggregate(small, start, step)["kept"]
        return let(picked, lambda k: F.when(F.size(k) > 1, _rendered(k, most)).otherwise(_rendered(all_, most)))

    return let(scored(text), lambda s: F.when(F.size(s) == 0, F.substring(norm(text), 1, most)).otherwise(chosen(s)))


def selective(text: Column, least: int = 3, most: int = 2200) -> Column:
    """Chunks within a budget, by quotas in turn: the first two; those that speak against, the most of which is a 900th of
    the budget and three; three critical ones from the end; one of other techniques, if none is in; one with pay in pounds
    and one in other money; the most salient, a 300th of the budget and eight at most; then all that isn't mere company
    talk, in order. One that doesn't fit is passed over and counts for no quota."""
    counters, core, tails = max(3, most // 900), max(8, most // 300), 3
    salient = lambda a, b: F.when(a["salience"] != b["salience"], b["salience"] - a["salience"]).otherwise(a["i"] - b["i"])

    def chosen(all_: Column) -> Column:
        turn = lambda xs, k: F.transform(xs, lambda x: F.struct(F.lit(k).alias("turn"), x["i"].alias("i"), x["c"].alias("c"), x["other_tech"].alias("other")))
        of = lambda cond: F.filter(all_, cond)
        offers = F.concat(
            turn(F.slice(all_, 1, 2), 0),
            turn(of(lambda x: x["counter"]), 1),
            turn(F.reverse(of(lambda x: x["critical"] | x["counter"])), 2),
            turn(F.slice(of(lambda x: x["other_tech"]), 1, 1), 3),
            turn(F.slice(of(lambda x: x["salary"] & ~x["foreign_pay"]), 1, 1), 4),
            turn(F.slice(of(lambda x: x["salary"] & x["foreign_pay"]), 1, 1), 4),
            turn(F.array_sort(of(lambda x: x["critical"] | (x["score"] >= least) | ~x["drop"]), salient), 5),
            turn(of(lambda x: ~x["drop"] | x["critical"]), 6),
        )
        start = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<i:int,c:string>>").alias("kept"), F.lit(0).alias("n1"), F.lit(0).alias("n2"), F.lit(0).alias("n5"), F.lit(False).alias("other"))

        def step(acc, x):
            n = acc["used"] + F.length(x["c"]) + 1
            has = F.exists(acc["kept"], lambda k: k["i"] == x["i"])
            t = x["turn"]
            room = F.when(t == 1, acc["n1"] < counters).when(t == 2, acc["n2"] < tails).when(t == 3, ~acc["other"]).when(t == 5, acc["n5"] < core).otherwise(True)
            more = lambda k: (acc[f"n{k}"] + F.when(t == k, 1).otherwise(0)).alias(f"n{k}")
            taken = F.struct(n.alias("used"), F.concat(acc["kept"], F.array(F.struct(x["i"].alias("i"), x["c"].alias("c")))).alias("kept"), more(1), more(2), more(5), (acc["other"] | x["other"]).alias("other"))
            return F.when(~has & room & (n <= most), taken).otherwise(acc)

        return let(F.aggregate(offers, start, step)["kept"], lambda k: F.when(F.size(k) > 1, _rendered(k, most)).otherwise(_rendered(all_, most)))

    return let(scored(text, True), lambda s: F.when(F.size(s) == 0, F.substring(norm(text), 1, most)).otherwise(chosen(s)))


def protected_words(words: Column) -> Column:
    """Positions of words that truncation spares, as runs (a, z), z exclusive: the head, the tail, and those around pay."""
    n = F.size(words)
    near = F.filter(F.transform(words, lambda w, i: F.when(F.rlike(w, F.lit(PAY_WORD)), F.struct(F.greatest(F.lit(0), i - PAY_WORDS).alias("a"), F.least(n, i + PAY_WORDS).alias("z")))), lambda x: x.isNotNull())
    ends = F.array(F.struct(F.lit(0).alias("a"), F.least(F.lit(HEAD_WORDS), n).alias("z")), F.struct(F.greatest(F.lit(0), n - TAIL_WORDS).alias("a"), n.alias("z")))
    return F.array_sort(F.concat(ends, near), lambda x, y: F.when(x["a"] != y["a"], x["a"] - y["a"]).otherwise(x["z"] - y["z"]))


def longest_gap(words: Column) -> Column:
    """The first longest run of words that nothing protects: at, n (0 if there is none)."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("at"), F.lit(0).alias("n"))

    def step(acc, x):
        gap = x["a"] - acc["upto"]
        upto = F.greatest(acc["upto"], x["z"]).alias("upto")
        return F.when(gap > acc["n"], F.struct(upto, acc["upto"].alias("at"), gap.alias("n"))).otherwise(F.struct(upto, acc["at"].alias("at"), acc["n"].alias("n")))

    return F.aggregate(protected_words(words), start, step)


def truncated(c: Column, most: int) -> Column:
    """Text within about `most` tokens of four characters: words go from the middle of the longest run that isn't
    protected, as many as are beyond the goal or as the run has; without such a run the text is cut."""
    goal = most * 4 // 6

    def cut(words: Column, gap: Column) -> Column:
        gone = F.size(words) - goal
        first = gap["at"] + F.floor((gap["n"] - gone) / 2).cast("int")
        last = F.least(first + gone, gap["at"] + gap["n"])
        kept = F.concat(F.slice(words, 1, F.greatest(F.lit(0), first)), F.array(F.lit("[...]")), F.slice(words, last + 1, F.greatest(F.lit(0), F.size(words) - last)))
        return F.when(gap["n"] == 0, F.concat(F.substring(c, 1, most * 4), F.lit(" [...]"))).when(gone <= 0, c).otherwise(F.array_join(kept, " "))

    long = let(F.split(c, f"{BLANK}+"), lambda w: let(longest_gap(w), lambda g: cut(w, g)))
    return F.when(F.ceil(F.length(c) / 4) > most, long).otherwise(c)
