"""Mixing, near-duplicate groups, word repeats, page differencing and the pipeline against plain versions."""

import hashlib
import random
import re

import pytest

from siftwork.llm import blocks, htmltext, minhash, mixing

RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdefghé") for _ in range(RNG.randint(2, 6))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared passages, repeats within a text, short, empty and null texts, null columns, clashing names."""
    rng = random.Random(11)
    base = [prose(rng.randint(5, 120), rng) for _ in range(60)]
    passage = prose(30, rng)
    texts = list(base)
    for t in base[:25]:
        w = t.split()
        for _ in range(rng.randint(0, 4)):
            v = list(w)
            for _ in range(rng.randint(0, 4)):
                v[rng.randrange(len(v))] = rng.choice(VOCAB)
            texts.append(" ".join(v))
    texts += [prose(8, rng) + "\n" + passage + "\t" + prose(7, rng) for _ in range(12)]
    texts += [passage + " " + passage, "same " * 300, prose(3000, rng), "one two", "ONE Two", "one", "", None, " \n ", None]
    rng.shuffle(texts)
    rows = [(i * 3, t, ["a", "b", "é", None, "c"][min(4, i % 9)], i, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, id long, rep string, size int").repartition(5)


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda x: x[0])


def shingles(t, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def components_of(rows, width=4, percent=80):
    s = {i: shingles(t, width) for i, t in rows}
    label = {i: i for i in s}
    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = label[a], label[b]
                for i in label:
                    if label[i] == max(x, y):
                        label[i] = min(x, y)
    return s, label


@pytest.mark.parametrize("width", [4, 5])
def test_near_groups_are_all_links(corpus, width):
    s, label = components_of(rows_of(corpus), width)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_groups(corpus, width=width).collect()}
    assert got == {i: (len(s[i]), label[i], label[i] == i) for i in s}
    assert len({x for x in label.values()}) <= len(label) - 10


def test_blocks_of_a_large_group_meet(corpus, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 2)
    monkeypatch.setattr(minhash, "BLOCK", 2)
    s, label = components_of(rows_of(corpus))
    assert {r.doc_id: r.component_id for r in minhash.near_groups(corpus).collect()} == label


def test_near_groups_of_rows_without_ids_repeated_rows_and_none(spark):
    t = prose(40)
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (None, prose(30)), (2, prose(50))], "doc_id long, text string")
    got = sorted(map(str, minhash.near_groups(df).select("doc_id", "component_id", "kept").collect()))
    assert got == sorted(map(str, [f"Row(doc_id={a}, component_id={b}, kept={c})" for a, b, c in ((1, 1, True), (1, 1, True), (None, 1, False), (None, None, False), (2, 2, True))]))
    assert minhash.near_groups(df.limit(0)).collect() == []
    kept = minhash.deduplicated(df.where("doc_id is not null"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_rows_without_ids_are_deduplicated_among_themselves(spark):
    w = [prose(60).split() for _ in range(4)]
    near = lambda k, at: " ".join([*w[k][:at], "zzz", *w[k][at + 1 :]])
    full = [" ".join(x) for x in w]
    rows = [(5, full[0], "a"), (3, near(0, 59), "b"), (None, near(0, 0), "c")]  # 5 and 3 are near, and so is the third
    rows += [(None, full[1], "d"), (None, full[1], "d"), (None, near(1, 0), "e"), (None, full[2], "f"), (9, full[3], "g")]
    rows += [(None, None, "h"), (None, "", "i"), (None, " ", "j"), (None, " ", "j"), (4, "", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = minhash.deduplicated(df)
    assert out.columns == df.columns
    got = sorted((str(r.doc_id), r.source) for r in out.collect())
    group = [x for x in got if x[1] in "de"]
    assert len(group) == 1
    assert sorted(set(got) - set(group)) == [("3", "b"), ("4", "k"), ("9", "g"), ("None", "f"), ("None", "h"), ("None", "i"), ("None", "j")]
    assert got.count(("None", "j")) == 2 and len(got) == 9
    groups = minhash.near_groups(df).collect()
    assert len(groups) == len(rows) and sum(r.component_id == 3 for r in groups) == 3
    assert all(r.kept == (r.doc_id in (3, 4, 9)) for r in groups)


def test_a_chain_of_near_copies_is_one_group(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 3)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    w = prose(200).split()
    texts = [" ".join([*(f"z{j}" for j in range(k)), *w[k:]]) for k in range(0, 120, 6)]  # each is near the next ones only
    df = spark.createDataFrame([(len(texts) - k, t) for k, t in enumerate(texts)] + [(90 + k, prose(80)) for k in range(5)], "doc_id long, text string").repartition(3)
    _, label = components_of(rows_of(df))
    assert {r.doc_id: r.component_id for r in minhash.near_groups(df).collect()} == label and set(label.values()) == {1, *range(90, 95)}


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    a, b, c = (prose(60) for _ in range(3))
    df = spark.createDataFrame([(1, a, "x"), (None, b, "y"), (2, c, "z"), (2, prose(60), "z"), (2, c, "z"), (2, None, "n"), (None, None, "n")], "doc_id long, text string, _row string")
    out = minhash.deduplicated(df)
    assert out.columns == df.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == 6 and {(1, a), (None, b), (2, c), (2, None), (None, None)} <= set(got)
    assert len(minhash.near_groups(df).collect()) == 7


def test_a_row_without_an_id_links_two_rows_with_one(spark):
    w = prose(100).split()
    change = lambda *at: " ".join("zzz" if k in at else x for k, x in enumerate(w))
    df = spark.createDataFrame([(1, change(0, 20)), (None, " ".join(w)), (2, change(50, 80))], "doc_id long, text string")
    assert [r.component_id for r in minhash.near_groups(df).collect()] == [1, 1, 1]
    assert [r.doc_id for r in minhash.deduplicated(df).collect()] == [1]


def word_repeats(rows, window=20):
    first, out = {}, {}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), (i, k))
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] != (i, k) for j in range(window)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def test_word_repeats_match_all_windows(corpus):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in blocks.digest(corpus).collect()}
    want = word_repeats(rows_of(corpus))
    assert got == want and sum(x[1] for x in want.values()) > 300


def test_word_repeats_keep_texts_and_spans(spark):
    p = prose(25)
    df = spark.createDataFrame([(2, f"a {p} b"), (1, f"{p} c"), (None, f"d {p}"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in blocks.repeats(df, texts=True).collect()}
    assert got[2].kept == "a b" and got[2].spans[0].start == 1 and got[2].spans[0].end == 26
    assert got[None].kept == "d" and got[1].n_removed == 0 and got[5].n_words == 0
    assert blocks.repeats(df.limit(0)).collect() == []


def test_mix_comes_near_its_targets(corpus):
    rows = mixing.digest(corpus).collect()
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows_of(corpus)}
    assert {r.doc_id: r.size for r in rows} == sizes
    by = {}
    for r in rows:
        x = by.setdefault(r.source, [r.source_size, r.target, 0, 0, 0])
        x[2] += r.size
        x[3] += r.taken
        x[4] = max(x[4], r.size)
        assert r.taken <= 3 * r.size
    total = sum(sizes.values())
    order = sorted(by, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    want, full = {}, set()
    while True:
        left = total - sum(3 * by[s][0] for s in full)
        free = [s for s in order if s not in full]
        share = left / sum(weight[s] for s in free) if free else 0
        want = {s: 3.0 * by[s][0] if s in full else share * weight[s] for s in order}
        over = {s for s in free if want[s] > 3 * by[s][0]}
        if not over:
            break
        full |= over
    for s, (size, target, seen, taken, largest) in by.items():
        assert size == seen and target == pytest.approx(want[s])
        assert abs(taken - target) <= max(largest / 2, 1), s
    again = mixing.digest(corpus.repartition(2)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_targets_reshare_what_is_above_the_cap(spark):
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame([("a", 1), ("b", 100), ("c", 2), (None, 300)], "source string, size long")).collect()}
    assert got["a"] == 3 and got["c"] == 6 and sum(got.values()) == pytest.approx(403)
    assert got["b"] / got[None] == pytest.approx(2.0)


def test_residuals_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "FAN", 3)
    df = spark.createDataFrame([(i, "w " * (1 + i % 37), f"s{i % 2}") for i in range(600)], "doc_id long, text string, source string")
    for r in mixing.digest(df).groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 19


def test_small_sources_beside_a_hot_one_come_near_their_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 256)
    rows = [(i, "w " * (10 + i % 23), f"s{i % 8}") for i in range(1600)] + [(2000 + k, "w " * 300, f"s{k}") for k in range(8)]
    rows += [(3000 + i, "w " * (10 + i % 23), "z") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.digest(df).groupBy("source").agg({"taken": "sum", "target": "max", "source_size": "max"}).collect()
    assert len(got) == 9
    for r in got:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= r["max(source_size)"] / 1000 + 1, r


def test_mix_repeats_rows(corpus):
    out = mixing.mix(corpus)
    assert out.columns == corpus.columns
    want = {r.doc_id: r.copies for r in mixing.digest(corpus).collect() if r.copies}
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want
    one = corpus.where("length(text) > 200").orderBy("doc_id").first()
    same = corpus.sparkSession.createDataFrame([one] * 6, corpus.schema)
    assert mixing.mix(same).count() in (5, 6, 7)
    assert mixing.mix(corpus.limit(0)).count() == 0


PAGE = '<html><head><title>T</title><script>var t="</p><p>no</p>";</script></head><body><nav><ul><li>Menu</ul></nav><div class="ad">Buy</div>{}<div id="comments"><p>me too</p></div><footer>&copy; site</footer></body></html>'


def page_text(html, *around):
    return htmltext.main_text(htmltext.lines_of(html), [[x.hash for x in htmltext.lines_of(p)] for p in around])


def test_pages_lose_what_never_is_main_text():
    body = "<article><h1>A &amp;  b</h1><p>one<br>two\n three<p><b>four</b> &lt;five&gt;</article>"
    assert page_text(PAGE.format(body)) == "A & b\none two three\nfour <five>"
    assert page_text("") == "" and page_text("plain < text") == "plain < text"
    assert page_text("<p>cut &amp; off<!-- never closed") == "cut & off"


@pytest.mark.parametrize(
    "page,text",
    [
        ('<p>Main text <span class="share">Share this</span> goes on</p>', "Main text goes on"),
        ('<p>Main text <span class="ad">Buy</p><p>next</p>', "Main text\nnext"),
        ("<p><a href=it's>x</a> alpha beta</p><p>gamma</p>", "x alpha beta\ngamma"),
        ('<p><a title="a > b" href=\'c\'>x</a> y</p>', "x y"),
        ("<div hidden><p>no</p></div><div aria-hidden=true>no</div><p>yes</p>", "yes"),
        ("<i>one</b> two</i></p> three", "one two\nthree"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ('<div role="main"><p>in</p></div><p>out</p>', "in"),
    ],
)
def test_marks_apply_to_runs_of_text_and_quotes_to_values(page, text):
    assert page_text(page) == text


def test_differencing_decides_inside_marked_regions():
    body = "<main><div>By the staff</div><h1>{0}</h1><p>Quoted by all.</p><p>{0} one and much that is their own</p><p>{0} two</p><div>Share this story</div></main>"
    a, b, c = (body.format(x) for x in ("Ants", "Bees", "Cats"))
    want = "Ants\nQuoted by all.\nAnts one and much that is their own\nAnts two"
    assert page_text(a, b, c) == page_text(a, c) == want
    assert page_text(a) == "By the staff\n" + want + "\nShare this story"
    inner = "<article><p>{0} one</p><div>{1}</div><p>{0} two</p></article>"
    pages = [inner.format(x, "Our newsletter") for x in ("Ants", "Bees", "Cats")]
    assert page_text(*pages) == "Ants one\nAnts two"
    assert page_text(*pages[:2]) == "Ants one\nOur newsletter\nAnts two"
    assert page_text(a, a) == page_text(a) and page_text(a, a, b) == want  # a page with the same article tells nothing


def test_copies_at_neighbouring_urls_keep_their_text():
    page = "<div>Site</div><p>the same text on both pages</p>"
    other = "<div>Site</div><p>something else entirely here</p>"
    assert page_text(page, page) == "Site\nthe same text on both pages"
    assert page_text(page, page, other) == "the same text on both pages"


def test_parsing_is_linear_in_hostile_pages():
    import time

    for make in (lambda n: "<i>x" * n + "</b>" * n, lambda n: "<p><b>" * n, lambda n: "<li>" * n + "</i>" * n, lambda n: '<a b="' * n, lambda n: "<svg/>" * n, lambda n: "<" * n):
        took = []
        for n in (20_000, 80_000):
            began = time.process_time()
            htmltext.lines_of(make(n))
            took.append(time.process_time() - began)
        assert took[1] < 12 * max(took[0], 0.05)


def test_common_subsequences_are_longest():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = sorted(htmltext.shared(a, b))
        assert len(got) == best[-1][-1]
        it = iter(b)
        assert all(any(x == a[i] for x in it) for i in got)


def test_long_alignments_halve(monkeypatch):
    rng = random.Random(8)
    cases = [[[rng.randrange(5) for _ in range(rng.randrange(60))] for _ in range(2)] for _ in range(60)]
    whole = [len(htmltext.shared(a, b)) for a, b in cases]
    monkeypatch.setattr(htmltext, "CELLS", 8)
    for (a, b), n in zip(cases, whole, strict=True):
        got = sorted(htmltext.shared(a, b))
        it = iter(b)
        assert len(got) == n and all(any(x == a[i] for x in it) for i in got)


def test_unmarked_pages_lose_lines_that_the_nearest_page_has(spark):
    site = "<p>Welcome to the site</p>{}<p>All rights kept</p>"
    rows = [(k, f"https://h.example/{p}", site.format(f"<p>text {k}</p>"), 1) for k, p in enumerate(["a/1", "a/2", "b/1", "b/2"])]
    rows += [(8, "https://other.example/a/1", site.format("<p>alone</p>"), 1), (9, None, None, 1), (10, "https://h.example/a/1", "<main><p>Welcome to the site</p></main>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int").repartition(3)
    got = {r.page_id: r.text for r in htmltext.extract(df).collect()}
    assert got == {0: "text 0\nAll rights kept", 1: "text 1\nAll rights kept", 2: "text 2", 3: "text 3", 8: "Welcome to the site\nalone\nAll rights kept", 9: "", 10: "Welcome to the site"}
    assert htmltext.extract(df.limit(0)).collect() == []


def test_repeated_rows_of_a_page_agree(spark):
    site = "<p>Welcome to the site</p>{}<p>All rights kept</p>"
    rows = [(1, "https://h.example/a", site.format("<p>a text that is long enough</p>"))] + [(2, "https://h.example/b", site.format("<p>another text that is long enough</p>"))] * 3 + [(None, "https://h.example/c", None)] * 2
    got = [(r.page_id, r.text) for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, "a text that is long enough")] + [(2, "another text that is long enough")] * 3 + [(None, "")] * 2))


def test_the_pipeline_stage_by_stage(spark, corpus, tmp_path):
    import public_tokenizers
    import tiktoken

    import corpus_pipeline as cp
    from siftwork.llm import bpe, quality

    cols = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(r.doc_id, r.text, "en", r.source, None if r.text is None else len(r.text)) for r in corpus.collect()]
    rows += [(9001, "###&&& $$$ " * 40, "en", "a", 440), (9002, prose(60) + " token = abcdef123456", "en", "b", 10)]
    alone = prose(70)  # rows without an id, and two texts under one id
    rows += [(None, alone, "en", "c", None), (None, alone, None, None, None), (None, prose(55), "fr", "a", 1), (9003, prose(64), "en", "a", 1), (9003, prose(66), "en", None, 1)]
    docs = spark.createDataFrame(rows, cols)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for k, (_, stage) in enumerate(cp.STAGES):
        before, docs = docs, stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert sorted(docs.columns) == sorted(before.columns)
        was, now = before.collect(), docs.collect()
        ids = [r.doc_id for r in now]
        if k == 0:
            assert 9001 not in ids and 9002 in ids and len(ids) > 50 and ids.count(9003) == 2 and ids.count(None) == 3
            assert sorted(map(str, now)) == sorted(map(str, quality.keep(before).collect()))
        elif k == 1:
            _, label = components_of(list(enumerate(r.text for r in was)), 5)
            left = [r.text for r in now]
            assert len(now) == len(set(label.values()))
            for group in set(label.values()):
                assert sum(was[i].text in left for i in label if label[i] == group) >= 1
            named = {group: min((was[i].doc_id for i in label if label[i] == group and was[i].doc_id is not None), default=None) for group in set(label.values())}
            assert sorted(map(str, ids)) == sorted(map(str, named.values()))
        elif k == 2:
            assert "[secret]" in docs.where("doc_id = 9002").first().text and len(now) == len(was)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in now)
        elif k == 3:
            copies = {}
            for r in mixing.plan(before).collect():
                copies[r.doc_id, r.source, r.size] = copies.get((r.doc_id, r.source, r.size), 0) + r.copies
            got = {}
            for r in now:
                key = r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
                got[key] = got.get(key, 0) + 1
            assert got == {x: n for x, n in copies.items() if n} and {r.text for r in now} <= {r.text for r in was}
        elif k == 4:
            want = sorted((str(r.doc_id), len(x := theirs.encode_ordinary(r.text or "")), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in x)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in was)
            assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in now) == want
    assert sorted(map(str, cp.run(spark, str(tmp_path)).collect())) == sorted(map(str, now))


def test_near_groups_miss_nothing_on_the_smallest_tables(spark):
    """Recall against brute force over all pairs of a corpus with copies of all degrees."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    _, label = components_of(rows_of(docs))
    assert {r.doc_id: r.component_id for r in minhash.near_groups(docs).collect()} == label
