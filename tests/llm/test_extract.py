import random

import pytest
from helpers import PAGES

from kgspark.llm.extract import best_region, extract, fit_weights, main_text
from kgspark.llm.labelled_pages import PAGES as LABELLED

WEIGHTS = fit_weights()


def text_of(html):
    return main_text(html, WEIGHTS)[0]


def test_weights_have_the_signs_of_the_method():
    assert WEIGHTS["word:plain"] > 0 > WEIGHTS["word:aside"]
    assert all(w <= 0 for k, w in WEIGHTS.items() if k.startswith("tag"))


def test_best_region_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        s = [rng.choice([-2, -1, 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        first, end, score = best_region(s)
        best = max([sum(s[a:b]) for a in range(len(s) + 1) for b in range(a, len(s) + 1)])
        assert score == max(best, 0) == sum(s[first:end])


def test_labelled_pages():
    lines = [text_of(p).split("\n") for p in LABELLED]
    assert [x[0] for x in lines[:3]] == ["Harvest begins early", "Mending a leaking tap", "Why the moon shows one face"]
    whole = "\n".join(map("\n".join, lines))
    for out in ("apples", "cookies", "plumber", "Newsletter", "yearbook", "rights reserved", "Most read", "Search", "Archive"):
        assert out not in whole


def test_self_closed_drawings_hold_nothing():
    page = "<header>%s</header><article><h1>A title</h1><p>one two three four five six</p>%s<p>seven eight nine ten eleven twelve</p></article>"
    want = "A title\none two three four five six\nseven eight nine ten eleven twelve"
    for icon in ("<svg/>", '<svg class="icon" aria-label="a > b" />', "<MATH />", "<svg><path d='x'/><title>no</title></svg>", '<svg title="/>">no</svg>'):
        assert text_of(page % (icon, "")) == text_of(page % ("", icon)) == text_of(page % (icon, "<svg><text>no</text></svg>")) == want


def test_blocks_references_and_white_space():
    html = "<nav><a href=/>x</a></nav><article><h1> A&amp;B &#8364;</h1><p>one\n\n two<br>three &lt;b&gt;<p>four <b>fi</b>ve<script>no()</script></article><footer>end of it</footer>"
    assert text_of(html) == "A&B €\none two three <b>\nfour five"
    inner = "<article><p>" + "word " * 30 + "</p><aside><p>" + "other " * 90 + "</p></aside><div class='newsletter form'>join</div><p>tail stays</p></article>"
    assert text_of(inner) == ("word " * 30).strip() + "\ntail stays"


BODY = "one two three four five six seven eight nine ten eleven twelve"


@pytest.mark.parametrize("page", [
    '<div class="layout with-sidebar"><p>{0}</p></div>', '<div id="page" class="has-sticky-menu"><p>{0}</p></div>', '<div data-u="?id=comment"><p>{0}</p></div>',
    "<div title='a class=\"menu\" b' data-x=id=ad><p>{0}</p></div>", '<article class="post comments-open"><p>{0}</p></article>', "<table><tr><td class=menu>Home<td><p>{0}</table>",
    "<div><p class=promo>Buy now<p>{0}</div>", "<div><p class=promo>Buy <b>now<div>{0}</div></div>", "<ul><li class=ad>Buy now<li>{0}</ul>", "<table><tr class=nav><td>a<td>b<tr><td>{0}</table>",
    "<dl><dt class=ad>Buy<dd>{0}</dl>",
])
def test_the_article_stays_whatever_stands_beside_it(page):
    assert text_of(page.replace("{0}", BODY)) == BODY


@pytest.mark.parametrize("mark", ["class=kommentare", "id=responses", 'class="entry-comments"', 'class="comment-content"', "class='article comments'", "id=commentaires"])
def test_what_readers_wrote_stays_out(mark):
    assert text_of(f"<article><p>{BODY}</p></article><div {mark}><p>I agree with every word of this article</p></div>") == BODY
    assert text_of(f"<article><p>{BODY}</p><section {mark}><p>I agree with every word of this</p></section></article>") == BODY


def test_elements_that_end_by_themselves():
    nested = "<ul><li>one<ul><li class=ad>buy</ul><li>two three four</ul>"
    assert text_of(f"<article><p>{BODY}</p>{nested}</article>") == f"{BODY}\none\ntwo three four"
    table = "<table><tr><td class=ad><table><tr><td>x</table>y<td>z stays</table>"
    assert text_of(f"<article><p>{BODY}</p>{table}</article>") == f"{BODY}\nz stays"


@pytest.mark.parametrize("html", ["", "   ", "<", "<div", "<!-- never closed", "<script>x", "</p></p>", "<a b='", "<nav>a b c</nav>"])
def test_odd_pages_have_no_text_but_a_result(html):
    assert text_of(html) in ("", "<")


def test_table(spark):
    long = "<article>" + "<div>" * 3000 + "<p>" + "wort " * 60_000 + "</p>" + "</div>" * 3000 + "</article>"
    rows = [(1, "u", "<article><p>Hi there, you.</p></article>"), (1, "u", "<article><p>Hi there, you.</p></article>"), (2, None, None), (None, "v", ""), (3, "w", long)]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], PAGES + ", text string, n_chars int")
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in extract(df).collect()), key=repr)
    want = [(1, "u", "Hi there, you.", 14)] * 2 + [(2, None, "", 0), (None, "v", "", 0), (3, "w", ("wort " * 60_000).strip(), 299_999)]
    assert got == sorted(want, key=repr)
    assert extract(spark.createDataFrame([], PAGES)).count() == 0
