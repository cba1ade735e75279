import html
import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.llm.op9_html_mincut import FEATURES, FIT_BLOCKS, FIT_WEIGHT, LABELLING, PRIOR, blocks_of, extracted, fit, fitted, graph, main_text, marked, min_cut

SCHEMA = "page_id long, url string, html string"


def article(page):
    """The text of the test data's article element: paragraphs may be unclosed, references are decoded."""
    body = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"</?(?:p|br|h1)\b[^>]*>", " ", re.sub(r"</?b>", "", body))).split())


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r.page_id: r for r in df.collect()}
    out = extracted(df).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.url == rows[r.page_id].url and r.text == article(rows[r.page_id].html) and r.n_chars == len(r.text)


TEXT = "The quick brown fox jumps over the lazy dog, and then it does so once more for good measure."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<nav>Home</nav><main><h1>Title</h1><p>{TEXT}</p></main><footer>(c)</footer>", f"Title {TEXT}"),
        (f"<body><div class='sidebar'><p>{TEXT}</p></div><div id=content><h2>T</h2><p>{TEXT}<p>Short.<p>{TEXT}</div>", f"T {TEXT} Short. {TEXT}"),
        (f"<article><p>{TEXT}</p><section class='comments'><h3>Comments</h3><p>{TEXT} {TEXT}</p></section></article>", TEXT),
        (f"<article><p>a&amp;b &lt;i&gt; caf&eacute; &#8212; x&nbsp;y</p><p>{TEXT}</p></article>", f"a&b <i> café — x y {TEXT}"),
        (f"<script>if (a<b) x='<p>{TEXT}</p>';</script><article><p>{TEXT}</p></article><style>p{{}}</style><!-- <p>{TEXT}</p>", TEXT),
        (f"<article><p>{TEXT}</p><div class='cookie-notice'>We use cookies. {TEXT}</div><form><p>{TEXT}</p><input></form><p>{TEXT}</p></article>", f"{TEXT} {TEXT}"),
        (f"<ul><li><a href=x>{TEXT}</a><li><a href=y>{TEXT}</a></ul><div><p>{TEXT}</p><p>{TEXT}</p></div>", f"{TEXT} {TEXT}"),
        (f"<article><p>one <b>tw</b>o <a href=q>three</a>\n\t four</p><p>{TEXT}</p>", f"one two three four {TEXT}"),
        (f"<article><p>{TEXT}</p><p hidden>no</p><aside>{TEXT}</aside><div style='display: none'>{TEXT}</div></article>", TEXT),
        (f"<article><h1>T</h1><p class=byline>By A. Author</p><p>{TEXT}</p><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", f"T By A. Author {TEXT} one two x y"),
        (f"<div id=leftsidebar><p>{TEXT}</p></div><div class='post-body'><p>{TEXT}</p><p>ok</p></div><div id='comments'><h3>3 comments</h3><div class='comment'><p>{TEXT}</p></div></div>", f"{TEXT} ok"),
        (f"<main><div class='alert notice' role=alert>{TEXT}</div><section><h2>A</h2><p>{TEXT}</p></section><section class=related><h2>More</h2><ul><li><a href=z>{TEXT}</a></ul></section></main>", f"A {TEXT}"),
        (f"<ARTICLE><P TITLE=\"a > b\">{TEXT}</P></ARTICLE", TEXT),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


def test_min_cut_is_least():
    rnd = random.Random(6)
    for _ in range(200):
        n = rnd.randrange(1, 8)
        costs = [rnd.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rnd.uniform(0, 1.5)) for a, b in itertools.combinations(range(n), 2) if rnd.random() < 0.6]
        price = lambda keep: sum(abs(c) for c, k in zip(costs, keep, strict=True) if (c > 0) != k) + sum(w for a, b, w in edges if keep[a] != keep[b])  # noqa: B023, E731
        best = min(price(keep) for keep in itertools.product((False, True), repeat=n))
        assert abs(price(min_cut(costs, edges)) - best) < 1e-9


def test_nulls_empty_and_clashing_columns(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain words without any element at all, but long enough"), (None, "u", "<p>"), (5, "u", "<" * 50), (5, "u", "<" * 50)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.page_id or 0, r.text) for r in extracted(df).collect())
    assert got[0] == (0, "") and got[1] == (1, "") and got[3][1].startswith("plain words") and len(got) == 6
    assert extracted(df.limit(0)).collect() == []
    assert extracted(df.withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))).count() == 6


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<article><p title=it's>{TEXT}</p></article>", TEXT),
        (f"<article><p>{TEXT}</p><a href=\"x>leak</p><p>{TEXT}</article>", TEXT),
        (f"<article><p>{TEXT}</p><p class='y>{TEXT}", TEXT),
        (f"<article><p>{TEXT}</p><p data-x=a\"b>{TEXT}</p></article>", f"{TEXT} {TEXT}"),
        (f"<article><p>{TEXT}</p><p class=", TEXT),
        (f"<article><p>{TEXT}</p><!--><p>{TEXT}</p><!-- a > b --!><p>ok then.</p></article>", f"{TEXT} {TEXT} ok then."),
        (f"<article><p>{TEXT}</p><p data-class=comment data-hidden>{TEXT}</p></article>", f"{TEXT} {TEXT}"),
        (f"<article><p>5 < 6 and a <= b</p><p>{TEXT}</p></article>", f"5 < 6 and a <= b {TEXT}"),
        (f"<div class='has-sidebar'><article><p>{TEXT}</p><p>{TEXT}</p></article></div>", f"{TEXT} {TEXT}"),
        (f"<article><p>{TEXT}</p><div class=comments><div class=body><p>{TEXT}</p><p>{TEXT}</p></div></div></article>", TEXT),
    ],
)
def test_broken_markup_and_nested_names(page, want):
    assert main_text(page) == want


def plain_page(rnd):
    """A page of bare div elements without a telling name: (html, its prose)."""
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    prose, body = [], []
    for _ in range(rnd.randrange(5, 15)):
        kind = rnd.random()
        text = words(rnd.randrange(25, 80)) + "." if kind < 0.6 else words(rnd.randrange(1, 4)) if kind < 0.8 else words(rnd.randrange(4, 9))
        tag = "p" if kind < 0.6 else "div"
        prose.append(text)
        body.append(f"<{tag}>{text}</{tag}>" if kind < 0.8 else f"<div><a href=x>{text}</a></div>")
    aside = []
    for _ in range(rnd.randrange(5, 12)):
        aside.append(f"<li><a href=x>{words(rnd.randrange(1, 6))}</a></li>" if rnd.random() < 0.85 else f"<li>{words(6)}.</li>")
    menu = " ".join(f"<div><a href=x>{words(1)}</a></div>" for _ in range(6))
    return f"<div><div>{menu}</div></div><div><div>{''.join(body)}</div></div><div><div><ul>{''.join(aside)}</ul></div></div><div><div>© {words(3)}</div></div>", prose


def test_the_cut_decides_and_is_right():
    rnd = random.Random(12)
    changed = right = blocks = by_cut = by_sign = 0
    for _ in range(200):
        page, prose = plain_page(rnd)
        found = blocks_of(page)
        costs, edges = graph(found, np.array(PRIOR))
        want = set(prose)
        for b, c, keep in zip(found, costs, min_cut(costs, edges), strict=True):
            truth = b.text in want
            blocks += 1
            by_cut += keep == truth
            by_sign += (c > 0) == truth
            changed += keep != (c > 0)
            right += keep != (c > 0) and keep == truth
    print(f"{blocks} blocks, changed {changed / blocks:.3f}, right of these {right / changed:.3f}, by sign {by_sign / blocks:.3f}, by cut {by_cut / blocks:.3f}")
    assert changed > 0.1 * blocks and right > 0.95 * changed
    assert by_cut > by_sign + 0.1 * blocks and by_cut > 0.9 * blocks


def test_fit():
    rnd = random.Random(5)
    pages = []
    for _ in range(100):
        links = "".join(f"<li><a href=x>menu entry {rnd.randrange(9)}</a></li>" for _ in range(9))
        pages.append(f"<nav>{links}<div class=promo>Sign up now! It is free.</div></nav><article><h1>On it</h1>{f'<p>{TEXT}</p>' * rnd.randrange(1, 9)}<p>Yes.</p></article>")
    x, y = zip(*(marked(p) for p in pages), strict=True)
    x, y = np.concatenate([np.array(v) for v in x]), np.concatenate([np.array(v) for v in y])
    w = fitted(x, y)
    assert (x[:, [FEATURES.index(f) for f in LABELLING]] == 0).all()
    assert all(w[k] == PRIOR[k] for k, f in enumerate(FEATURES) if f in LABELLING)

    def loss(v):
        p = 1 / (1 + np.exp(-x @ v))
        return -FIT_WEIGHT * (0.5 * np.log(p[y]).mean() + 0.5 * np.log(1 - p[~y]).mean()) + ((v - np.array(PRIOR)) ** 2).sum() / 2

    assert all(loss(w) <= loss(w + step) for step in np.random.default_rng(1).normal(0, 0.05, (200, len(w))))
    assert (fitted(x[y], y[y]) == np.array(PRIOR)).all() and (fitted(x[:0], y[:0]) == np.array(PRIOR)).all()
    assert len(marked("<article>" + f"<p>{TEXT}</p>" * 500 + "</article>")[1]) == FIT_BLOCKS


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 200_000 + TEXT + "</div>" * 200_000,
        "".join(f"<div>{k % 7}" for k in range(100_000)) + "</div>" * 100_000,
        "<b>" * 100_000 + "<div>x</div>" * 100_000,
        "<div>" * 100_000 + "</b>" * 100_000 + TEXT,
        "<li><a href=x>y</a></li>" * 50_000 + f"<p>{TEXT}</p>" * 2_000,
        "<p>ab</p><div><a href=x>y</a></div>" * 20_000,
        "<" * 500_000,
        "<a " * 200_000,
        "<a b='" * 100_000,
    ],
    ids=["deep", "deep text", "inline", "unmatched", "links and prose", "alternating", "open", "tags", "quotes"],
)
def test_huge_pages_are_linear(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 15


def test_copies_weigh_once_and_reruns_agree(spark):
    rows = [(k, "u", f"<nav><a href=x>home {k}</a></nav><article><p>{TEXT} {k}</p></article>") for k in range(40)]
    once, often = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows + [rows[0]] * 60, SCHEMA)
    assert (fit(once) == fit(often.repartition(7))).all() and (fit(once) != np.array(PRIOR)).any()
    assert (fit(once.limit(0)) == np.array(PRIOR)).all()
