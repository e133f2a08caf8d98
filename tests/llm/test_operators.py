"""Each operator against a brute-force version, a round trip or held-out accuracy."""

import hashlib
import html
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomalign.llm import embedding_dedup, html_text, mixing, ngram_join, packing, quality_rules, substring_dedup, toxicity, url_rules
from loomalign.llm import induced
from loomalign.llm.induced import permuted_lcp, suffix_array
from loomalign.llm.queries import oracle_sql, queries
from tests.llm.conftest import BAD, is_held_out

W = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def components(ids, links):
    least = {i: i for i in ids}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        least[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("name", sorted(queries()))
def test_odd_and_empty_tables(spark, odd, empty, name):
    """Nulls, repeated rows, clashing names and empty tables: rows in, rows out."""
    table, rows = {"op2": ("pages", 4), "op9": ("embeddings", 4), "op10": ("pages", 4), "op11": ("embeddings", 0), "op12": ("embeddings", 6)}.get(name.split("_")[0], ("documents", 6))
    got = queries()[name](spark, odd).collect()
    assert len(got) == rows, table
    assert queries()[name](spark, empty).collect() == []


def test_suffix_array():
    r = np.random.default_rng(3)
    for _ in range(150):
        s = r.integers(0, r.integers(1, 5), r.integers(1, 80)).astype(np.uint8)
        raw = s.tobytes()
        sa = suffix_array(s)
        want = sorted(range(len(raw)), key=lambda i: raw[i:])
        assert sa.tolist() == want
        plcp, _ = permuted_lcp(s, sa)
        for a, b in zip(want[:-1], want[1:], strict=True):
            k = 0
            while max(a, b) + k < len(raw) and raw[a + k] == raw[b + k]:
                k += 1
            assert plcp[b] == k
    # The same by recursion throughout as with doubling for many names.
    many = r.integers(0, 200, 6000).astype(np.uint8)
    want, limit = suffix_array(many), induced.MAX_BUCKETS
    induced.MAX_BUCKETS = 1 << 30
    try:
        assert (suffix_array(many) == want).all()
    finally:
        induced.MAX_BUCKETS = limit
    big = np.frombuffer(b"abcde" * 2000 + b"x" * 3000, np.uint8)
    assert (np.sort(suffix_array(big)) == np.arange(len(big))).all()


def test_op1(spark, corpus, docs):
    got = queries()["op1_quality_rules"](spark, corpus).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        t = t or ""
        w = W.findall(t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        count = Counter(grams)
        covered = {p for k, g in enumerate(grams) if count[g] > 1 for p in range(k, k + 5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if W.search(line):
                dup += line in seen
                seen.add(line)
        r = got.loc[i]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), failed), i
        assert not (r.base_failed and r.kept)
    junk = docs.text.map(lambda t: t is not None and ("***" in t or "$$$" in t)).to_numpy()
    clean = ~got.base_failed.loc[docs.doc_id].to_numpy() & ~junk
    assert got.kept.loc[docs.doc_id][junk].mean() < 0.05 and got.kept.loc[docs.doc_id][clean].mean() > 0.97


def test_viterbi():
    f = quality_rules.LineField()
    r = np.random.default_rng(0)
    f.state = r.normal(size=f.state.shape)
    x = r.integers(0, quality_rules.WIDTH, (9, 10))
    doc = np.array([0, 0, 0, 0, 2, 2, 2, 3, 3])
    got = f.decode(x, doc, 5)
    emit = f.scores(x)
    for d in (0, 2, 3):
        own = np.flatnonzero(doc == d)
        best = max(np.ndindex(*[2] * len(own)), key=lambda y: f.first[y[0]] + sum(emit[k, y[i]] for i, k in enumerate(own)) + sum(f.pair[a, b] for a, b in zip(y[:-1], y[1:], strict=True)))
        assert got[own].tolist() == list(best)


def test_op2(spark, corpus):
    pages = pd.read_parquet(f"{corpus}/pages.parquet")
    got = queries()["op2_html_text"](spark, corpus).toPandas().set_index("page_id")
    assert len(got) == len(pages) and (got.n_chars == got.text.str.len()).all()
    for i, h in zip(pages.page_id[4:], pages.html[4:], strict=True):
        title, text = re.search(r"<h1>(.*?)</h1><p>(.*?)</p>", h).groups()
        assert got.text[i] == f"{html.unescape(title)}\n\n{text}"
    assert got.text[0] == got.text[1] == ""


@pytest.mark.parametrize(
    ("source", "blocks"),
    [
        ("<body><p>One <svg class=a />two<math/> three</p><p>Four</p>", ["One two three", "Four"]),
        ("<p>One <svg><g><svg/></g>drawn</svg>two <svg href=a/>drawn</svg>three", ["One two three"]),
        ("<head><title>T</title><meta name=a><script>x('<div>no</div>')</script><p>One<p>Two", ["One", "Two"]),
        ("<head><noscript><img src=x>no</noscript><link rel=y>One <b>two</b>", ["One two"]),
        ("<head><noscript>no</head><p>One", ["One"]),
        ("<html><head><title>T</title></head><body><p>One", ["One"]),
        ("<p>about <math><mi>x</mi></math> here and <button>press</button> more</p>", ["about x here and press more"]),
        ("<p>One<select><option>two<option>three</select><b>four</b></p>", ["One two three four"]),
        ("<p>One <object>two</object> <audio>three</audio><map><area>four</map></p>", ["One two threefour"]),
        ("<div><button>One<div>two</div></button><p>Three</p>", ["One", "two", "Three"]),
        ("<ul><li>One<select><option>two</li><li>Three</li></ul>", ["One two", "Three"]),
        ("<p>One</p><template>no<p>no</p></template><iframe>no</iframe>Two", ["One", "Two"]),
    ],
)
def test_html_open_elements(source, blocks):
    assert html_text.Page(source).block_text == blocks


def test_html_pages():
    m = html_text.fit()
    right = total = 0
    for seed in range(9000, 9080):
        page, y = html_text.labelled_page(seed)
        keep = html_text.decoded(page, m.logit(html_text.features(page)))
        assert all(keep[page.parent[v]] for v in range(1, len(keep)) if keep[v])
        for v in page.block_node:
            right += keep[v] == y[v]
            total += 1
    assert right / total > 0.98
    one = "<body><div class=cookie-notice><p>We use things. Accept all.</p></div><header><nav><ul><li><a href=/>Home</a></ul></nav></header><article><h1>A &lt;b&gt;\n title</h1><p>First  one.<br>Still one.<script>no()</script><p>Second &amp two.<div class=ad>Buy this now.</div><p>Third paragraph of text.</article><section id=comments><h3>Comments</h3><p>I disagree with this.</p></section><footer>Copyright</footer>"
    assert html_text.main_texts([one], m) == ["A <b> title\n\nFirst one. Still one.\n\nSecond & two.\n\nThird paragraph of text."]
    # Truncated markup, deep nesting, unclosed quotes.
    html_text.main_texts(["<p>a<p", "<div>" * 3000 + "x", '<a href="', "<p>&am", "<script>", "<!-- x"], m)


#: Pages that no generator wrote, in layouts unlike the generated ones, with the blocks of their main text.
OTHER_LAYOUTS = [
    (
        "<html><body><table width=100%><tr><td class=leftnav><a href=1>Start</a><br><a href=2>Products</a><br><a href=3>Contact us</a></td><td><h2>Repairing a bicycle wheel</h2><p>A wheel that wobbles is seldom beyond repair. First find the spoke that is loose, then turn its nipple a quarter at a time.</p><p>Check the rim after every turn, and stop as soon as it runs straight between the brakes.</p></td></tr></table><div class=footer>Copyright 2009 The Wheel Shop. All rights reserved.</div></body></html>",
        ["Repairing a bicycle wheel", "A wheel that wobbles is seldom beyond repair. First find the spoke that is loose, then turn its nipple a quarter at a time.", "Check the rim after every turn, and stop as soon as it runs straight between the brakes."],
    ),
    (
        "<body><div id=page><div class=masthead><span>The Daily Paper</span><ul class=menu><li><a href=/w>World</a><li><a href=/s>Sport</a><li><a href=/c>Culture</a></ul></div><div class=story-body><h1>Harbour bridge closes for a month</h1><p class=byline>By our reporter</p><p>The bridge over the harbour will be closed from Monday while its cables are replaced. Ferries run every ten minutes.</p><p>Work began last year after an inspection found rust in eleven of the cables, the council said.</p><blockquote>We would rather close it now than be sorry later.</blockquote><p>It opens again in June.</p></div><div class=related-links><h3>More stories</h3><ul><li><a href=1>Ferry timetable</a><li><a href=2>Council meets on roads</a></ul></div><div class=comments><h3>3 comments</h3><div class=comment><p>About time too, I say.</p></div></div></div></body>",
        ["Harbour bridge closes for a month", "By our reporter", "The bridge over the harbour will be closed from Monday while its cables are replaced. Ferries run every ten minutes.", "Work began last year after an inspection found rust in eleven of the cables, the council said.", "We would rather close it now than be sorry later.", "It opens again in June."],
    ),
    (
        "<!doctype html><nav class=toc><ol><li><a href=#a>Install</a></li><li><a href=#b>Configure</a></li></ol></nav><main><h1>Manual</h1><section id=a><h2>Install</h2><p>Unpack the archive and run the script as described below.</p><pre>tar xf tool.tar\nsh install.sh</pre></section><section id=b><h2>Configure</h2><p>Every setting has a default, so most files need three lines or fewer.</p><table><tr><th>Name</th><th>Meaning</th></tr><tr><td>depth</td><td>how far links are followed</td></tr></table></section></main><footer><a href=/imprint>Imprint</a></footer>",
        ["Manual", "Install", "Unpack the archive and run the script as described below.", "tar xf tool.tar sh install.sh", "Configure", "Every setting has a default, so most files need three lines or fewer.", "Name", "Meaning", "depth", "how far links are followed"],
    ),
    (
        "<body class=post-template><header role=banner><p>My garden diary</p></header><article class='post hentry'><h2 class=entry-title>Frost in May</h2><div class=entry-content><p>Three nights below zero, and the beans are gone. I had sown them far too early, as every year.</p><ul><li>Beans: lost, sown again on the tenth</li><li>Peas: unharmed under their fleece</li></ul><p>Next year I shall wait for the moon, as my neighbour does.</p></div></article><aside><h4>Archive</h4><ul><li><a href=a>April</a><li><a href=b>March</a></ul></aside><div id=cookie-bar>This site uses cookies. <button>Fine</button></div></body>",
        ["Frost in May", "Three nights below zero, and the beans are gone. I had sown them far too early, as every year.", "Beans: lost, sown again on the tenth", "Peas: unharmed under their fleece", "Next year I shall wait for the moon, as my neighbour does."],
    ),
    (
        "<body><form action=/s class=search><input name=q><button>Search</button></form><div><p>Tea is made from the leaves of one plant. What differs between green and black is how long the leaves are left to the air before they are dried.</p><p>White tea, the least treated of all, is made of buds alone, which are picked for a few days in spring and dried in the sun.</p><p>Water just off the boil suits black tea; the others want it cooler.</p></div><div class=sponsored><p>Order our teapots now and save!</p></div></body>",
        ["Tea is made from the leaves of one plant. What differs between green and black is how long the leaves are left to the air before they are dried.", "White tea, the least treated of all, is made of buds alone, which are picked for a few days in spring and dried in the sun.", "Water just off the boil suits black tea; the others want it cooler."],
    ),
]


def test_html_other_layouts():
    m = html_text.fit()
    right = total = 0
    for source, want in OTHER_LAYOUTS:
        got = html_text.main_texts([source], m)[0].split("\n\n")
        blocks = html_text.Page(source).block_text
        right += sum((b in got) == (b in want) for b in blocks)
        total += len(blocks)
    assert right / total > 0.9, (right, total)


def _brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        out.append((b, np.cumsum(cover[:-1]) > 0))
    return out


@pytest.mark.parametrize("shard", [1 << 20, 3000])
def test_op3(spark, corpus, docs, shard):
    few = docs[docs.text.map(lambda t: t is None or len(t) < 50_000)]
    source = spark.read.parquet(f"{corpus}/documents.parquet").where("text is null or length(text) < 50000")
    got = substring_dedup.report(source, shard_bytes=shard).toPandas().set_index("doc_id")
    assert len(got) == len(few)
    for i, (raw, gone) in zip(few.doc_id, _brute_repeats(few.text, 400), strict=True):
        r = got.loc[i]
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), gone.sum(), spans), i
        assert r.kept_sha256 == hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()
    assert got.n_removed.sum() > 0


def _thue_morse(k):
    x = "a"
    for _ in range(k):
        x += x.translate({97: 98, 98: 97})
    return x


def test_op3_rows_of_equal_ids(spark):
    """Texts are judged by themselves: equal and null ids neither mix them up nor leave them out."""
    import random

    r = random.Random(8)
    passage, other, mine = ("".join(r.choices("abcdefghij klm", k=n)) for n in (500, 600, 450))
    rows = [(1, "pp " + passage), (1, other), (2, passage + " q"), (None, mine + " x"), (None, "y " + mine), (3, None), (3, mine[:399])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ranges", F.lit("x")).withColumn("row", F.lit(1)).withColumn("ka", F.lit("k"))
    got = sorted((r.n_bytes, r.n_removed, r.n_spans) for r in substring_dedup.report(docs).collect())
    want = []
    for raw, gone in _brute_repeats([t for _, t in rows], 400):
        want.append((len(raw), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())))
    assert got == sorted(want) and sum(n for _, n, _ in want) == 2 * 500 + 2 * 450
    left = Counter((r.doc_id, r.text, r.ranges, r.row, r.ka) for r in substring_dedup.cleaned(docs).collect())
    assert left == Counter((i, t if t is None else t.replace(passage, "").replace(mine, ""), "x", 1, "k") for i, t in rows)


@pytest.mark.parametrize("shard", [1 << 20, 1500])
def test_op3_strings_that_sums_confuse(spark, shard):
    """Strings on which sums of powers collide are compared by bytes or by a strong digest."""
    x = _thue_morse(11)
    y = x.translate({97: 98, 98: 97})
    rows = [(1, x[:1024] + "0"), (2, y[:1024] + "1"), (3, "z" + x[:1024])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.report(docs, shard_bytes=shard).collect()}
    assert got == {i: int(gone.sum()) for (i, _), (_, gone) in zip(rows, _brute_repeats([t for _, t in rows], 400), strict=True)}


@pytest.mark.parametrize("k", [10, 11, 12])
def test_equality_of_strings_that_sums_confuse(spark, k):
    x = _thue_morse(k)
    y = x.translate({97: 98, 98: 97})
    docs = spark.createDataFrame([(1, f"{x}\n{y}\n{x}"), (2, x), (3, y), (4, " ".join([x, y, x, x, y] + [y, x, y, y, x]))], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.judged(docs, quality_rules.LineField()).collect()}
    assert got[1].n_dup_lines == 1 and got[4].n_repeat_words == 0
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_op3_texts(spark, corpus, docs):
    source = spark.read.parquet(f"{corpus}/documents.parquet").where("text is null or length(text) < 50000")
    got = substring_dedup.cleaned(source)
    assert got.columns == source.columns
    rows = {r.doc_id: r.text for r in got.collect()}
    few = docs[docs.text.map(lambda t: t is None or len(t) < 50_000)]
    for i, t, (raw, gone) in zip(few.doc_id, few.text, _brute_repeats(few.text, 400), strict=True):
        assert rows[i] == (None if t is None else np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore"))


def test_op4(spark, corpus, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary()[0])
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4") for i, x in zip(docs.doc_id, docs.text, strict=True)}
    got = queries()["op4_packing"](spark, corpus).toPandas()
    assert set(got.doc_id) == set(ids)
    for r in got.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for i, g in got.sort_values("piece").groupby("doc_id"):
        assert g.length.sum() == len(ids[i]) and (g.start == g.length.cumsum() - g.length).all() and (g.length[1:] == 2048).all() and g.piece.tolist() == list(range(len(g)))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 2048 and (g.offset == g.length.cumsum() - g.length).all()
    bound = -(-sum(map(len, ids.values())) // 2048)
    assert got.sequence_id.nunique() <= bound + 2
    many = packing.packed(spark.createDataFrame(got.drop(columns=["sequence_id", "offset"])), shard_pieces=30).toPandas()
    assert many.groupby("sequence_id").length.sum().max() <= 2048 and len(many) == len(got)
    for _, g in many.sort_values("offset").groupby("sequence_id"):
        assert (g.offset == g.length.cumsum() - g.length).all()


def test_packing_capacities(spark):
    where = packing.best_fit([4, 3, 3, 2, 2, 1], [1] * 6, [16, 9, 9, 4, 4, 1], (6, 2, 20))
    load = {}
    for n, b in zip([4, 3, 3, 2, 2, 1], where, strict=True):
        load.setdefault(b, []).append(n)
    assert all(sum(v) <= 6 and len(v) <= 2 and sum(x * x for x in v) <= 20 for v in load.values())
    assert packing.cuts(2048, 2048) == [(0, 2048)] and packing.cuts(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)]


def test_special_token(spark):
    from tokenizers import Tokenizer

    text = "before <|endoftext|> after"
    df = packing.pieces(spark.createDataFrame([(1, text)], "doc_id long, text string"), *packing.vocabulary(), with_ids=True)
    want = Tokenizer.from_file(packing.vocabulary()[0]).encode(text, add_special_tokens=False).ids + [0]
    assert df.first().ids == want
    assert packing.sequences(packing.packed(df)).first().ids == want


def _accuracy(spark, corpus, name, label):
    got = queries()[name](spark, corpus).toPandas()
    assert ((got.score >= 0) & (got.score <= 1)).all() and (got.held_out == got.doc_id.map(is_held_out)).all()
    m = got.merge(pd.read_parquet(f"{corpus}/labels.parquet"), on="doc_id")
    m = m[m.held_out]
    return (m.predicted == m[label]).mean(), got


def test_op5(spark, corpus):
    right, got = _accuracy(spark, corpus, "op5_toxicity", "toxic")
    assert right > 0.9 and (got.predicted == (got.score >= 0.3)).all()


def test_op5_learns_words():
    toxic, plain = toxicity.train([f"some words {b} here" for b in BAD] * 20, ["some words and more here"] * 100)
    assert len(toxic) == len(plain) and all(b.encode() in toxic and b.encode() not in plain for b in BAD)
    assert toxicity.features("scum trash idiot clown moron", (toxic, plain))[0] > toxicity.features("words here and some more", (toxic, plain))[0]
    assert len(toxicity.features(None, (toxic, plain))) == len(toxicity.features("a b", (toxic, plain)))


def test_op5_ordinary_dictionary_is_ordinary_text():
    toxic, plain = toxicity.train([f"some words {b} here" for b in BAD] * 20, ["some words and more here", "calm rivers and hills here"] * 100)
    own = plain.decode().split()[: sum(len(b) + 1 for b in BAD) // 2]
    assert {"calm", "rivers", "hills"} & set(own) and not set(plain.decode().split()) & set(BAD)
    assert toxicity.features("rivers hills", (toxic, plain))[0] < 0


def test_op5_wide_vocabulary(spark, tmp_path):
    """More significant words than the least size holds: all are used where that tells texts apart."""
    import random

    import pandas as pd

    r = random.Random(3)
    name = lambda: "".join(r.choice("bcdfghklmnprstvwz") + r.choice("aeiou") for _ in range(5))
    slurs, usual = [name() for _ in range(200)], [name() for _ in range(600)]
    rows = [(i, " ".join(r.choices(usual, k=26) + (r.choices(slurs, k=4) if i % 2 else r.choices(usual, k=4))), i % 2) for i in range(3000)]
    pd.DataFrame(rows, columns=["doc_id", "text", "toxic"])[["doc_id", "text"]].to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame([(i, 1, y) for i, _, y in rows], columns=["doc_id", "quality", "toxic"]).to_parquet(tmp_path / "labels.parquet")
    model = toxicity.fit(spark, str(tmp_path))
    own = [f" {w} ".encode() in model[0][0] and f" {w} ".encode() not in model[0][1] for w in slurs]
    assert sum(own) > 150
    held = [(t, y) for i, t, y in rows if is_held_out(i)]
    score = model[1](np.array([toxicity.features(t, model[0]) for t, _ in held]))
    assert toxicity.auc(score, np.array([y for _, y in held])) > 0.95


def test_op1_expectations():
    """Probabilities of lines and pairs of the field, against all label sequences one by one."""
    r = np.random.default_rng(2)
    f = quality_rules.LineField()
    f.pair, f.first = r.normal(size=(2, 2)), r.normal(size=2)
    lengths = [4, 3, 3, 1]
    emit = r.normal(size=(4, 4, 2))
    live = [sum(n > k for n in lengths) for k in range(4)]
    p, pairs = f.expected(emit, live)
    want_pairs = np.zeros((2, 2))
    for d, n in enumerate(lengths):
        every = list(np.ndindex(*[2] * n))
        weight = np.array([np.exp(f.first[y[0]] + sum(emit[d, k, v] for k, v in enumerate(y)) + sum(f.pair[a, b] for a, b in zip(y[:-1], y[1:], strict=True))) for y in every])
        weight /= weight.sum()
        for k in range(n):
            assert np.allclose(p[d, k, 1], sum(w for w, y in zip(weight, every, strict=True) if y[k]))
        for w, y in zip(weight, every, strict=True):
            for a, b in zip(y[:-1], y[1:], strict=True):
                want_pairs[a, b] += w
    assert np.allclose(pairs, want_pairs)


def test_op7_neighbours():
    """Scores against sums over sorted neighbours, one pair at a time; ties by place, and batches change nothing."""
    import pyarrow as pa

    from loomalign.llm.quality_knn import Neighbours

    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choice(words, 30)) for _ in range(50)]
    texts += texts[:10]  # equal vectors: equal cosines
    y = np.array([i % 3 == 0 for i in range(60)], np.int64)
    m = Neighbours(texts, y, np.ones(4096), 60, 0.4)
    asked = [" ".join(r.choice(words, 25)) for _ in range(20)] + texts[:5] + ["", None]
    batch = pa.RecordBatch.from_arrays([pa.array(asked, pa.string())], ["text"])
    got = m.score(batch, 7)
    latent = m.latent(m.weighted(batch))
    for i, t in enumerate(asked):
        if not t:
            assert got[i] == 0
            continue
        cosines = [round(sum(a * b for a, b in zip(latent[i], v, strict=True)) * 1e9) / 1e9 for v in m.vectors]
        near = sorted(range(60), key=lambda k: (-cosines[k], k))[:7]
        votes = [max(cosines[k], 1e-6) ** 8 * m.weight[k] for k in near]
        assert abs(got[i] - sum(v * y[k] for v, k in zip(votes, near, strict=True)) / sum(votes)) < 1e-6
    one_by_one = np.concatenate([m.score(batch.slice(i, 1), 7) for i in range(len(asked))])
    assert (one_by_one == got).all()


def test_op7(spark, corpus, docs):
    right, got = _accuracy(spark, corpus, "op7_quality_knn", "quality")
    assert right > 0.95 and (got.predicted == (got.score >= 0.7)).all()
    blank = docs.doc_id[docs.text.map(lambda t: t is None or not t.strip())]
    assert (got.set_index("doc_id").score[blank] == 0).all()


def test_op6(spark, corpus, docs):
    import duckdb

    got = queries()["op6_mixing"](spark, corpus).toPandas()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{corpus}/documents.parquet'")
    want = c.sql(oracle_sql()["op6_mixing"]).df()
    pd.testing.assert_frame_equal(got.sort_values("doc_id").reset_index(drop=True), want.sort_values("doc_id").reset_index(drop=True), check_dtype=False)
    m = got.merge(docs, on="doc_id")
    assert (m["size"] == [len(W.findall(t or "")) for t in m.text]).all() and (m.taken <= 2 * m["size"]).all()
    s = m.assign(source=m.source.fillna("~")).groupby("source").agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(s.target.sum() - 1.5 * s["size"].sum()) < 1e-6 and (s.target <= 2 * s["size"] + 1e-9).all()
    assert ((s.taken - s.target).abs() <= 80 + 0.01 * s.target).all()
    drawn = mixing.drawn(spark.read.parquet(f"{corpus}/documents.parquet"))
    assert drawn.columns == list(docs.columns)
    times = drawn.groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    for r in got.itertuples():
        assert times.get(r.doc_id, 0) == (int(r.taken / r.size + 0.5) if r.size else 0)


def test_op6_schedule_is_even(spark, corpus):
    sizes = mixing.sized(spark.read.parquet(f"{corpus}/documents.parquet"))
    planned = mixing.plan(mixing.targets(sizes)).cache()
    slots = mixing.schedule(spark, planned).toPandas().sort_values("slot")
    share = {r.skey: (r.top - (r.top - r.e)) / r.all_e for r in planned.collect()}
    for part in (slots[:200], slots[100:400]):
        for k, p in share.items():
            assert abs((part.skey == k).sum() - p * len(part)) <= 6


@pytest.mark.parametrize("sizes", [[40_000_000, 20_000_000] + [7_000, 1_000, 300, 41, 3] * 12, [20] * 3000, [5_000_000] + [2] * 1500])
def test_op6_tail_of_sources(spark, sizes):
    """Tiny sources beside hot ones, and more sources than their blocks can share, get their target."""
    # Texts of up to 100,000 words; two to a small source.
    rows = [(k, min(100_000, n - a)) for k, n in enumerate(sizes) for a in range(0, n, 100_000)]
    rows = [(k, x) for k, n in rows for x in ((n - n // 2, n // 2) if n < 100_000 else (n,))]
    docs = spark.createDataFrame([(i, f"s{k:05d}", n) for i, (k, n) in enumerate(rows)], "doc_id long, source string, n int")
    docs = docs.selectExpr("doc_id", "source", "repeat('w ', n) AS text")
    got = mixing.mixed(docs).toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    s = got.assign(source=[rows[i][0] for i in got.doc_id]).groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert (s["size"] == sizes).all() and abs(s.target.sum() - 1.5 * sum(sizes)) < 1e-3
    assert ((s.taken - s.target).abs() <= 0.5 + mixing.MISS * s.target).all()
    assert abs(s.taken.sum() - 1.5 * sum(sizes)) <= len(sizes) / 2 + mixing.MISS * 1.5 * sum(sizes)


@pytest.mark.parametrize(("few", "tile"), [(16, 128), (1, 4)])
def test_op8(spark, corpus, docs, few, tile):
    sets = {}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        w = W.findall(lower(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = ngram_join.near_duplicates(spark.read.parquet(f"{corpus}/documents.parquet"), few=few, tile=tile).collect()
    assert len(got) == len(sets)
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]), r
    assert sum(want[i] != i for i in want) > 20


@pytest.mark.parametrize(("few", "tile"), [(16, 512), (1, 8), (3, 8)])
def test_op8_verifies_a_pair_once(spark, corpus, few, tile):
    trace = {}
    ngram_join.near_duplicates(spark.read.parquet(f"{corpus}/documents.parquet"), few=few, tile=tile, trace=trace)
    pairs = [tuple(r) for ways in trace.values() for r in ways.collect()]
    assert len(pairs) == len(set(pairs)) > 30 and all(a < b for a, b in pairs)
    assert few == 16 or "tiles" in trace


def test_op8_equal_ids(spark):
    a, b, c = ("one two three four five six seven", "red blue green white black pink", "one two three four five six seven")
    docs = spark.createDataFrame([(5, a), (5, b), (2, b), (9, c), (None, a)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.near_duplicates(docs).collect())
    assert got == [(0, 3, 0), (2, 2, 2), (5, 2, 2), (5, 3, 5), (9, 3, 5)]


def test_op8_plan_splits_hot_tokens(spark, corpus):
    """What is dealt by token is joined with stored sizes or has a bounded part of a token: no window or whole group of a token."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("doc_id is not null")
    levels = ngram_join.frequency_levels(docs, 5)
    nodes = ngram_join.different_sets(ngram_join.sketches(docs.select("doc_id", "text"), 5, 80, levels))
    postings = ngram_join.shared_postings(nodes)
    plan = ngram_join.chained_pairs(postings, 80)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(token" in plan and ", part" in plan
    sizes = postings.groupBy("token").agg(F.count("*").alias("n"), F.max("size").alias("size")).collect()
    assert sizes and all(r.n == r.size for r in sizes)


def test_op9(spark, corpus):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{corpus}/embeddings.parquet").to_pydict()
    good = [i for i, (v, lab) in enumerate(zip(t["embedding"], t["label"], strict=True)) if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = []
    for a in good:
        for b in good:
            x, y = np.array(t["embedding"][a]), np.array(t["embedding"][b])
            if a < b and t["label"][a] == t["label"][b] and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                links.append((a, b))
    want, count = components(range(300), links), Counter(i for p in links for i in p)
    for tile in (1024, 7):
        got = embedding_dedup.near_duplicates(spark.read.parquet(f"{corpus}/embeddings.parquet"), tile=tile).collect()
        assert len(got) == 300
        for r in got:
            assert (r.n_links, r.component_id, r.kept) == (count[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id), r
    assert len(links) > 1000


def test_op10(spark, corpus):
    pages = pd.read_parquet(f"{corpus}/pages.parquet")
    got = queries()["op10_url_rules"](spark, corpus).toPandas().set_index("page_id")
    rules = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "block"), ("example.net/de/8", "allow"), ("org/es/", "block")]
    assert len(got) == len(pages)
    for i, u in zip(pages.page_id, pages.url, strict=True):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = lower(re.match(r"[^/?#]*", rest)[0])
            path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(k), k, v) for k, v in rules if (host == (h := k.split("/")[0]) or host.endswith("." + h)) and path.startswith(k[len(h) :])]
        r = got.loc[i]
        assert (r.host, r.path) == (host, path), u
        if fits:
            assert (r["rule"], r.verdict) == max(fits)[1:]
        else:
            assert r["rule"] is None and r.verdict in ("allow", "block")


def test_op10_mining(spark):
    rows = [(["host=a", "path=x"], True)] * 30 + [(["host=a", "path=y"], False)] * 30 + [(["host=b", "path=x"], False)] * 30 + [(["host=c", "path=z"], True)] * 10
    df = spark.createDataFrame(rows, "tokens array<string>, blocked boolean")
    mined = url_rules.shortest(url_rules.mined(df, 0.01, 0.9, 1.0, 1, 0.0).cache())
    got = {tuple(r.antecedent): r.urls for r in mined.collect()}
    assert got == {("host=a", "path=x"): 30, ("host=c",): 10, ("path=z",): 10}
    hits = url_rules.matched(df, mined).collect()
    assert {tuple(r.tokens) for r in hits} == {("host=a", "path=x"), ("host=c", "path=z")}
    wider = df.union(spark.createDataFrame([(["host=c"], False)] * 31, df.schema))
    assert {tuple(r.antecedent) for r in url_rules.representative(mined, wider, 0.25).collect()} == {("host=a", "path=x"), ("path=z",)}


def _url_tokens(u):
    host = path = query = scheme = ""
    if u and "://" in u:
        scheme, rest = u.split("://", 1)
        scheme = scheme.lower()
        host, path, query = lower(re.match(r"[^/?#]*", rest)[0]), re.match(r"[^/?#]*([^?#]*)", rest)[1], (re.match(r"[^?#]*\?([^#]*)", rest) or ["", ""])[1]
    labels = [x for x in host.split(".") if x]
    out = {f"scheme={scheme}"} if scheme else set()
    out |= {f"end={host.rsplit('.', 1)[-1]}"} | {f"host={x}" for x in labels[:-1]}
    out |= {f"word={w}" for x in labels[:-1] if "-" in x for w in x.split("-") if w}
    out |= {f"path={re.sub('[0-9]+', '0', x)}" for x in path.split("/") if x} | {f"query={x.split('=', 1)[0]}" for x in query.split("&") if x}
    return frozenset(out)


@pytest.mark.parametrize("limits", [{}, {"support": 0.02, "confidence": 0.8, "conviction": 1.2, "least": 3, "beyond": 1.0, "coverage": 0.1}, {"least": 2, "beyond": 0.5, "coverage": 0.0}])
def test_op10_mined_verdicts(spark, limits):
    """Every verdict that the list does not give, against all combinations of tokens counted one by one."""
    import itertools
    import random

    r = random.Random(6)
    hosts = ["a.example.com", "EXAMPLE.net", "b.example.org", "x.org", "win-now.example.com", "m.example.net"]
    urls = [f"{r.choice(['http', 'https'])}://{r.choice(hosts)}/{r.choice(['en', 'de', 'es', 'fr'])}/{r.randint(1, 99)}{r.choice(['', '?q=1&r', '#top', '.html'])}" for _ in range(700)] + [None, "", "plain", "http://", "://h"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {x.page_id: x for x in url_rules.judged(pages, **limits).collect()}
    p = {"support": url_rules.SUPPORT, "confidence": url_rules.CONFIDENCE, "conviction": url_rules.CONVICTION, "least": url_rules.LEAST, "beyond": url_rules.BEYOND, "coverage": url_rules.COVERAGE} | limits
    sets = [_url_tokens(u) for u in urls]
    named = {i: x.verdict for i, x in got.items() if x["rule"]}
    n, share = len(named), sum(v == "block" for v in named.values()) / len(named)
    count, block, everywhere = Counter(), Counter(), Counter()
    for i, t in enumerate(sets):
        for k in range(1, len(t) + 1):
            for c in itertools.combinations(sorted(t), k):
                everywhere[c] += 1
                if i in named:
                    count[c] += 1
                    block[c] += named[i] == "block"
    least = max(p["support"] * n, p["least"])
    rules = [c for c in count if block[c] >= least - 1e-9 and (q := block[c] / count[c]) >= p["confidence"] and (1 - q) * p["conviction"] <= 1 - share and (q - share) * count[c] ** 0.5 >= p["beyond"] * (share * (1 - share)) ** 0.5 and count[c] >= p["coverage"] * everywhere[c]]
    blocked = 0
    for i, t in enumerate(sets):
        if i not in named:
            want = any(t >= set(c) for c in rules)
            assert (got[i].verdict == "block") == want == (got[i].mined_confidence is not None), (urls[i], t)
            blocked += want
    assert blocked > 0 or not limits


def test_what_tasks_get_is_small():
    """What a process has computed for itself is not sent along with functions."""
    from pyspark import cloudpickle

    from loomalign.llm import common

    common.powers(1 << 18)
    assert len(cloudpickle.dumps(common.tidy(lambda batches: batches))) < 10_000
    common.give_back()
    assert not common._POWERS


def test_filters_and_sums(spark):
    from loomalign.llm import common

    keys = spark.range(0, 1000, 7).select("id")
    table = common.key_filter(keys, 12)
    assert common.may_have(table, np.arange(0, 1000, 7)).all() and not common.may_have(table, np.arange(1, 1000, 7)).all()
    rows = spark.range(100).select(F.col("id").alias("k"))
    assert common.thinned(rows, "k", table).count() + common.thinned(rows, "k", table, False).count() == 100
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (300, 200)], "a long, b long")
    got = {r.id: r.component_id for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}


@pytest.mark.parametrize("kind", ["path", "star", "random"])
def test_components_in_many_tasks(spark, kind):
    """Rounds of contraction, with a hub in every task, end in the components."""
    import random

    from loomalign.llm import common

    r = random.Random(4)
    links = {"path": [(i, i + 1) for i in range(300)], "star": [(500, i) for i in range(400)] + [(i, i + 1000) for i in range(0, 400, 7)], "random": [(r.randrange(400), r.randrange(400)) for _ in range(260)]}[kind]
    want = {i: c for i, c in components(range(2000), links).items() if any(i in e for e in links if e[0] != e[1])}
    df = spark.createDataFrame(links, "a long, b long").repartition(8)
    assert {r.id: r.component_id for r in common.components(df, task_links=40).collect()} == want
