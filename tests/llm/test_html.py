"""Main text of pages: parsing, the field against plain enumeration, and results on whole tables."""

import itertools
import random

import numpy as np
import pytest
from brute import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from admeter.llm import html_crf as hc

PAGES = [r["html"] for r in rows("/root/testdata/sf0.01", "pages")]
MODEL = hc.fit(hc.training_pages(PAGES[:60]))


def texts(html):
    return [b.text for b in hc.blocks(html)]


def marked_text(html):
    """What a page's own markup gives as its article."""
    return "\n".join(b.text for b in hc.blocks(hc.labelled(html)) if b.label)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", []),
        ("plain", ["plain"]),
        ("a < b &lt; c &amp d &am &copy; &#65;&nbsp;&#x42;", ["a < b < c & d &am © A B"]),
        ("<p>one<p>two <b>bold<br>line<p>three", ["one", "two bold line", "three"]),
        ("<script>if (a</p>b) '</script x>'</script>t", ["'t"]),
        ("x<script>never closed <p>y", ["x"]),
        ("x<!-- never closed <p>y", ["x"]),
        ("x<!--a--!>y<!-->z<!doctype html><?php 1 ?>", ["xyz"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<a title='x>y'>in</a> <img alt=\"<p>\">out", ["in out"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("<p>a</div>b</section></p>c", ["a", "b", "c"]),
        ("<div>" * 3000 + "deep" + "</div>" * 3000 + "out", ["deep", "out"]),
        ("text<a href", ["text"]),
        ("<textarea><p>no</textarea><button>go<p></button>yes", ["yes"]),
    ],
)
def test_blocks(html, want):
    assert texts(html) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"<>/!-\"'=& ;pab\n", "<p>", "</p>", "<li>", "<script>", "</script>", "&amp;", "<!--", "-->"]), max_size=60))
def test_any_markup_is_read(parts):
    for t in texts("".join(parts)):
        assert t == " ".join(t.split()) and t


def total(model, page, states):
    f = [sum(model.weights.get(x, 0.0) for x in [*b.ancestors, *own]) for b, own in zip(page, hc.features(page), strict=True)]
    kinds = hc.edges(page)
    score = model.start[states[0]] + f[0] * states[0]
    for t in range(1, len(page)):
        score += model.moves[kinds[t], states[t - 1], states[t]] + f[t] * states[t]
    return score


def short_pages():
    found = [hc.blocks(h) for h in PAGES[:40]]
    return [p[:9] for p in found if p]


def test_viterbi_finds_the_best_of_all_sequences():
    for page in short_pages()[:15]:
        best = max(itertools.product((0, 1), repeat=len(page)), key=lambda s: total(MODEL, page, s))
        assert total(MODEL, page, MODEL.decode(page, {})) == pytest.approx(total(MODEL, page, best))


def likelihood(data_pages, names, at):
    model = hc.Field(dict(zip(names, at[0], strict=True)), at[1], at[2])
    out = 0.0
    for page in data_pages:
        each = [total(model, page, s) for s in itertools.product((0, 1), repeat=len(page))]
        out += total(model, page, [b.label for b in page]) - np.logaddexp.reduce(each)
    return out / len(data_pages)


def test_gradient_is_that_of_the_likelihood_over_all_sequences():
    pages = [hc.blocks(hc.labelled(h))[i : i + n] for h, i, n in zip(PAGES[:6], (0, 5, 4, 6, 3, 6), (6, 5, 4, 6, 1, 2), strict=True)]
    data = hc.Sequences(pages)
    rnd = np.random.default_rng(1)
    at = [rnd.normal(size=len(data.names)), rnd.normal(size=2), rnd.normal(size=(2, 2, 2))]
    grads = data.gradient(*at)
    for k in range(3):
        for i in list(np.ndindex(at[k].shape))[:12]:
            up, down = [x.copy() for x in at], [x.copy() for x in at]
            up[k][i] += 1e-5
            down[k][i] -= 1e-5
            slope = (likelihood(pages, data.names, up) - likelihood(pages, data.names, down)) / 2e-5
            assert grads[k][i] == pytest.approx(slope, abs=1e-6)


def test_whole_table_gives_the_article_of_every_page(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: r for r in hc.op11_html_crf(spark, sf).collect()}
    pages = rows(sf, "pages")
    assert len(got) == len(pages)
    right = sum(got[p["page_id"]]["text"] == marked_text(p["html"]) for p in pages)
    assert right >= 0.99 * len(pages)
    assert all(r["n_chars"] == len(r["text"]) and r["url"] is not None for r in got.values())


def test_held_out_pages_without_telling_tags():
    rnd, right, n = random.Random(5), 0, 0
    for h in PAGES[60:200]:
        page = hc.blocks(hc.renamed(hc.labelled(h), rnd, bare=True))
        right += sum(a == b.label for a, b in zip(MODEL.decode(page, {}), page, strict=True))
        n += len(page)
    assert right / n > 0.97


def test_held_out_layouts():
    rnd, right, n = random.Random(1234), 0, 0
    articles = [[b.text for b in hc.blocks(hc.labelled(h)) if b.label] for h in PAGES[100:]]
    for _ in range(150):
        page = hc.blocks(hc.laid_out(rnd, articles))
        right += sum(a == b.label for a, b in zip(MODEL.decode(page, {}), page, strict=True))
        n += len(page)
    assert right / n > 0.97


HAND_WRITTEN = """<!doctype html><html><head><title>T</title></head><body class="home">
<header class="site-header"><a href="/">The Paper</a><nav><a href="/a">World</a> <a href="/b">Sport</a></nav></header>
<div class="cookie-banner"><p>We use cookies on this site. <a href="/p">Privacy policy</a></p></div>
<div class="container"><div class="sidebar"><h3>Most read</h3><ul><li><a href="/1">One headline about a thing</a></li></ul></div>
<article><h1>A bridge opens in the old harbour</h1>
<p>The new bridge over the harbour was opened on Monday, three years after work on it began.</p>
<div class="advertisement"><p>Buy two shoes, get one free!</p></div>
<p>Engineers said the span, which can be lifted for tall ships, is the longest of its kind.</p>
<p>Traffic is expected to double within the first year.</p>
<section class="comments"><h3>2 comments</h3><div class="comment"><p>I think the bridge is far too expensive for us all.</p></div></section>
</article>
<form class="newsletter"><label>Your email address</label><input name=e><p>Subscribe to our newsletter</p></form></div>
<footer><p>© 2021 The Paper. All rights reserved.</p></footer></body></html>"""


def test_a_page_written_by_hand():
    assert MODEL.text(HAND_WRITTEN, {}).split("\n") == [
        "A bridge opens in the old harbour",
        "The new bridge over the harbour was opened on Monday, three years after work on it began.",
        "Engineers said the span, which can be lifted for tall ships, is the longest of its kind.",
        "Traffic is expected to double within the first year.",
    ]


def test_odd_rows_and_empty_tables(spark, tmp_path):
    schema = "page_id long, url string, html string, text string, n_chars int"
    odd = [(1, "u", None, "t", 1), (1, "u", None, "t", 1), (2, None, "", None, None), (None, "v", HAND_WRITTEN, "x", 2),
           (3, "w", "<p>" + "A long sentence. " * 200_000 + "</p>", "x", 3), (4, "z", "<<<>>>&&&", None, 0)]
    spark.createDataFrame(odd, schema).write.parquet(f"{tmp_path}/odd/pages.parquet")
    got = hc.op11_html_crf(spark, f"{tmp_path}/odd").collect()
    assert len(got) == len(odd)
    assert [r["text"] for r in got if r["page_id"] in (1, 2)] == ["", "", ""]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/empty/pages.parquet")
    assert hc.op11_html_crf(spark, f"{tmp_path}/empty").count() == 0
