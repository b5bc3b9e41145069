import random
import time
from collections import Counter
from itertools import product

import numpy as np
import pytest

from prosemill.llm import html, toxicity, warc

CLEAN = "the river moves past some old trees while people walk home from work and talk about dinner plans quietly".split()
BAD = ["idiot", "moron", "stupid"]


def labelled(n=600):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(CLEAN) for _ in range(r.randint(5, 40))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, [*labels, (None, 1, 1), (5000, 1, 1), (3, 1, None)]


@pytest.fixture(scope="module")
def scorer(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame([*rows, (None, "river"), (900, None), (901, "")], "doc_id long, text string")
    return toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), docs


def test_held_out_accuracy(scorer):
    got = {r.doc_id: r for r in toxicity.score(scorer[1], scorer[0]).collect()}
    held = [r for r in got.values() if r.held_out]
    assert len(held) > 80
    assert sum(r.predicted == (r.doc_id % 4 == 0 and r.doc_id < 600) for r in held) / len(held) > 0.97
    assert got[900].predicted == got[901].predicted == got[None].predicted == 0 and not got[None].held_out


@pytest.mark.parametrize("word", ["1d1ot", "m0r0n", "stupiiiid", "s t u p i d", "m.o.r.o.n", "$tup1d!", "st*pid", "MORON"])
def test_disguised_words(scorer, word):
    s = scorer[0]
    s.start()
    assert s.score(f"the river moves {word} past home".encode()) >= 0.5
    assert s.score(b"the 1st river moves past 24 trees, ok! really...") < 0.5


def test_viterbi_against_all_paths():
    r = random.Random(8)
    costs = np.random.default_rng(3).random((toxicity.CLASSES,) * 3).astype(np.float32) * 5

    def cost(path):
        text, total = "".join(x for x, _ in path), sum(e for _, e in path)
        p = q = 0
        for c in text:
            k = 0 if c == " " else toxicity._CLASS.get(c, toxicity.CLASSES - 1)
            total += float(costs[p, q, k])
            p, q = q, k
        return total + float(costs[p, q, 0])

    for _ in range(150):
        token = "".join(r.choice("abeé1$@!*0x") * r.choice([1, 1, 1, 3]) for _ in range(r.randint(1, 4)))
        steps = toxicity.lattice(token)
        for k in range(r.randint(0, 2)):
            steps.insert(r.randint(0, len(steps)), [("", 0.0), (" ", 0.5 * k)])
        best = min(cost(path) for path in product(*steps))
        got = toxicity.likeliest(steps, costs)
        assert any("".join(x for x, _ in path) == got and abs(cost(path) - best) < 1e-4 for path in product(*steps))


def test_gaps_join_or_part(scorer):
    s = scorer[0]
    assert toxicity.spread_words("he said i d i o t twice", s.costs) == ["idiot"]
    assert "stupid" in toxicity.spread_words("r i v e r  s t u p i d", s.costs) and toxicity.spread_words("it is on us to go", s.costs) == []


def test_rare_words_count_on_both_sides(spark):
    """Three toxic texts are enough for a feature, and words of clean texts speak for them."""
    rows = [(k, ("grump words here " if k < 4 else "kind words there ") + f"w{k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    s = toxicity.train(docs, spark.createDataFrame([(k, int(k < 4)) for k in range(60)], "doc_id long, toxic int"))
    assert s.weights[s.number["grump$"]] > 0 > s.weights[s.number["kind$"]]
    assert len(s.number) == len([f for f in s.number if f[0] in "grumphkindte"])


def test_too_few_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    s = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.doc_id for r in toxicity.score(docs, s).collect()] == [1]


PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><ul><li><a>Home</a></ul></nav>
<div class="cookie-notice">We use cookies. Accept them all.</div><div class=sidebar><p>Read this other long story, please.</p></div>
<article><h1>Real &amp; title</h1><p><b>One<br>two</b>   three.<p>Short.</p><script>var a="</p>";</script><form><label>Mail</label><input></form>
<div class="comments"><p>Great article, thank you very much!</p></div></article><footer>&copy; us</footer></body>"""


def test_main_text():
    assert html.main_text(PAGE) == "Real & title\nOne two three.\nShort."
    assert html.main_text("") == html.main_text("<nav>Home</nav>") == ""


def test_minimum_cut_against_all_labellings():
    r = random.Random(2)
    for _ in range(400):
        n = r.randint(1, 9)
        costs = [r.uniform(-2, 2) for _ in range(n)]
        ties = {(j - 1, j): r.uniform(0, 2) for j in range(1, n)}
        for j in range(2, n):
            ties[r.randrange(j - 1), j] = r.uniform(0, 1)

        def energy(labels, costs=costs, ties=ties):
            return sum(max(0, c) if not x else max(0, -c) for c, x in zip(costs, labels, strict=True)) + sum(t for (i, j), t in ties.items() if labels[i] != labels[j])

        best = min(energy([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert abs(energy(html.minimum_cut(costs, ties)) - best) < 1e-9


def test_pages_cut_off_or_strange_take_linear_time():
    began = time.perf_counter()
    assert html.main_text("<p>Kept text, long enough.</p><img " + " ".join(f'a{k}="v"' for k in range(10_000))) == "Kept text, long enough."
    for odd in ("<a " * 100_000, '<p a="' * 50_000, "='" * 200_000, '"' * 1_000_000, "<!--" * 100_000, "<" * 100_000, "</b>" * 50_000, "<div>" * 2000 + "x"):
        html.main_text("<article>" + odd)
    assert len(html.main_text("<article>" + "<p>One more line.</p>" * 20_000 + "</article>")) == 20_000 * 15 - 1
    assert time.perf_counter() - began < 20


def test_what_is_text():
    assert html.main_text("<article><p>a < b &lt;c&gt; and 3<4.</p><p hidden>Still text.</p><p style='display:none' aria-hidden=true>This too.</p></article>") == "a < b <c> and 3<4.\nStill text.\nThis too."
    assert html.main_text('<article><p title="a > b">One.</p><p a=\'"\'>Two.</p><p a="x>Three.</p></article>') == "One.\nTwo.\nThree."


def _labelled_pages():
    """Pages of several habits, (html, main text)."""
    a = ["The council met on Tuesday to talk about the new bridge, and most members were in favour of it.", "Work will start in spring. It should be done before the first frost of the year arrives.", "Local shops, some of them closed since March, hope that visitors come back."]
    b = ["How to bake bread", "Mix flour, water and salt in a bowl and leave it alone for an hour.", "Fold the dough twice.", "Flour: 500 g", "Water: 350 g", "Bake it for forty minutes until the crust sounds hollow."]
    p = lambda xs: "".join(f"<p>{x}</p>" for x in xs)
    nav = "<nav><ul>" + "".join(f"<li><a href=/{k}>{k}</a></li>" for k in ("Home", "News", "Sport", "Contact")) + "</ul></nav>"
    foot = "<footer><p>Copyright 2020 by the publisher. All rights reserved.</p></footer>"
    links = "<ul>" + "".join(f'<li><a href="/{k}">{k} stories of the week</a></li>' for k in ("Ten", "Nine", "Eight")) + "</ul>"
    yield f"<html><body>{nav}<article><h1>Bridge</h1>{p(a)}</article><aside><h2>Read on</h2>{links}</aside>{foot}</body></html>", ["Bridge", *a]
    yield f'<body><div id="header">The Daily Paper</div><div class="menu">{links}</div><div id="content"><h1>Bridge</h1>{p(a)}</div><div id="footer">Imprint</div></body>', ["Bridge", *a]
    yield f'<body>{nav}<div class="search-results content">{p(a)}</div>{foot}</body>', a
    yield f'<body><div class="post-share-content">{p(a)}</div><div class="share"><a href=#>Share this</a></div>{foot}</body>', a
    yield f'<body>{nav}<main><h2>{b[0]}</h2><p>{b[1]}</p><p>{b[2]}</p><ul><li>{b[3]}</li><li>{b[4]}</li></ul><p>{b[5]}</p></main><form><label>Mail</label><button>Send it now</button></form>{foot}', b
    yield f'<body><div class="cookie-banner"><p>We use cookies to make this site better for all of our readers.</p></div><div><div>{p(a)}</div></div><section id="comments"><h3>Comments</h3><p>I liked this story a lot, thanks for writing it!</p></section>', a
    yield f"<table><tr><td>{nav}</td><td>{p(a)}</td></tr></table>", a
    yield f'<body><p>{a[0]}</p><div class="ad">Buy two lamps and get a third one for half of the price today.</div><p>{a[1]}</p><p>{a[2]}</p>{links}', a
    yield f'<main><article><header><h1>Bridge</h1></header>{p(a)}<blockquote>It was never easy.</blockquote><footer>Share, print</footer></article><section class="related">{links}<p>More stories that you may like to read today.</p></section></main>', ["Bridge", *a, "It was never easy."]
    yield f'<body><div class="newsletter-signup"><p>Get our best stories every week, straight to your inbox.</p></div><div role="main">{p(a)}<pre>x = 1</pre></div>', [*a, "x = 1"]


def test_precision_and_recall_of_labelled_pages():
    kept = right = there = 0
    for page, want in _labelled_pages():
        got, words = Counter(html.main_text(page).split()), Counter(" ".join(want).split())
        kept, there, right = kept + got.total(), there + words.total(), right + (got & words).total()
    assert right / kept >= 0.9 and right / there >= 0.9, (right / kept, right / there)


def test_extract(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", "<p>A plain page without any article around it, but long.</p>"), (1, "u", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "'x' AS n_chars", "0 AS id")
    got = html.extract(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 53), (1, 34), (1, 34), (2, 0)]


def test_warc_round_trip(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/ b\n", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "c", fake), (4, "d", None), (5, "e", ""), (6, "f", "x\r\n\r\n" + fake * 3), (7, "g", "é" * 1000), (8, "h", "<p>same</p>")]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert len(got) == len(rows)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", i), i)
    for i, _, h in rows:
        payload, r = (h or "").encode(), got[i]
        first = last[h or ""] == i
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(payload), warc.payload_digest(payload), "response" if first else "revisit", None if first else last[h or ""])
        assert (bytes(r.payload) if first else r.payload) == (payload if first else None)


def test_unreached_records_are_dropped():
    one = warc.record(1, "u", b"abc", "D", None, False)
    assert len(list(warc.parse(one * 3))) == 3
    assert len(list(warc.parse(one + b"junk" + one))) == 0 or len(list(warc.parse(one + b"junk" + one))) == 1
    assert list(warc.parse(b"junk" + one)) == []


def test_empty_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract(none).count() == 0
    assert warc.round_trip(none).count() == 0


def test_self_closed_and_embedded_elements():
    article = "<article>%s</article>"
    assert html.main_text(article % '<p>one <svg class="i"/> two</p><p>three</p>') == "one two\nthree"
    assert html.main_text(article % "<p>one <svg/><math/> two</p><p>three <svg a='/'><text>x1</text></svg> four</p>") == "one two\nthree x1 four"
    assert html.main_text(article % "<p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><object data=a><p>Shown instead.</p></object><p>End.</p>") == "If x=2 holds.\nShown instead.\nEnd."


def test_header_of_any_length():
    urls = ["http://a/", "http://b/" + "é" * 180_000, "http://c/"]
    one = [warc.record(k, u, b"abc WARC/1. WARC/1.", "D", None, False) for k, u in enumerate(urls)]
    assert len(one[1]) > 1 << 20
    assert [r[1] for r in warc.parse(b"".join(one))] == [0, 1, 2]
