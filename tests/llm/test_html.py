import itertools
import random
import time

import pytest

from loomwork.llm import html

PAGES = [
    ('<html><body class="x"><div id="header"><a href=/>Home</a> Site</div><div class="cookie-banner">We use cookies. Accept all of them please.</div><div id="wrap"><div class="content"><h1>A title of things</h1><p>First paragraph of the story, with words. It goes on.</p><ul><li>item one</li></ul><p>Another &eacute;t&eacute; paragraph<br>broken here &amp; with <a href=x>a link</a> in it.</p></div><div class="sidebar"><p>Other teaser which is quite long and has many words, too.</p></div><div id="comments"><p>Great article, I loved it so much.</p></div></div><form><label>Your name</label></form><div class="footer">Copyright</div></body></html>', "A title of things\nFirst paragraph of the story, with words. It goes on.\nitem one\nAnother été paragraph broken here & with a link in it."),
    ("<nav><a href=1>One</a></nav><article><header><h1>Head</h1><p>By Jo</p></header><p>Body\n text.<aside>Ad</aside><p>More.<footer>Tags</footer></article><footer>f</footer>", "Head\nBody text.\nMore."),
    ("<article><p>x<script>var a='</p>'</script><style>p{}</style><!-- no --> y</article>", "x y"),
    ("<p>plain <b>bold<p>next <spa", "plain bold\nnext"), ("just text", "just text"), ("", ""), ("<div></div>", ""), ("<article><p>a &am", "a &am"), ("<!-- open", ""),
    ("<main><p>One.</p><noscript>n</noscript><p hidden>h</p><table><tr><td>c1<td>c2</table></main>", "One.\nc1\nc2"),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_pages(page, want):
    assert html.main_text(page) == want


def test_min_cut_against_all_cuts():
    r = random.Random(1)
    for _ in range(60):
        n = r.randint(1, 7)
        costs = [r.randint(-9, 9) for _ in range(n)]
        edges = [(a, b, r.randint(0, 6)) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.5]
        value = lambda side: sum(c for c, s in zip(costs, side, strict=True) if c > 0 and not s) - sum(c for c, s in zip(costs, side, strict=True) if c < 0 and s) + sum(w for a, b, w in edges if side[a] != side[b])  # noqa: E731,B023
        assert value(html.min_cut(costs, edges)) == min(value(s) for s in itertools.product([False, True], repeat=n))


def test_table(spark):
    df = spark.createDataFrame([(1, "u", PAGES[1][0], 3), (2, None, None, 3), (2, None, None, 3)], "page_id long, url string, html string, Text int")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html.extract(df, html.fit(df)).collect())
    assert got == [(1, PAGES[1][1], len(PAGES[1][1])), (2, "", 0), (2, "", 0)]
    assert html.extract(df.limit(0)).count() == 0 and (html.fit(df.limit(0)) == html.PRIOR).all()


def test_long_page_ends():
    page = "<article>" + "<p>word and more.</p>" * 20_000 + "</article>"
    assert html.main_text(page).count("\n") == 19_999


def alone(page):
    """What the costs alone would keep."""
    blocks = html.blocks_of(page)
    return "\n".join(b.text for b, c in zip(blocks, html.costs_of(blocks), strict=True) if c > 0)


def test_the_cut_corrects_a_wrong_mark():
    """A paragraph that a word of its class calls boilerplate stays in the article that it stands in."""
    said = "The board said on Monday that it would go on with its plans for the year, whatever the others thought of them."
    parts = [f"{said} {i}." for i in range(5)]
    body = "".join(f"<p class='{'share-price' if i == 2 else 'x'}'>{t}</p>" for i, t in enumerate(parts))
    page = f"<div class='content'>{body}</div><div class='footer'><p>{said}</p></div>"
    assert parts[2] not in alone(page) and html.main_text(page) == "\n".join(parts)
    advert = page.replace(f"<p class='share-price'>{parts[2]}</p>", "<p class='advert'>Buy now</p>")
    assert html.main_text(advert) == "\n".join(p for i, p in enumerate(parts) if i != 2)


def test_the_cut_takes_a_sentence_out_of_an_unmarked_menu():
    menu = "<ul>" + "".join(f"<li>{'Here you find all that was said of it before, in order.' if i == 4 else f'<a href=x>Part {i}</a>'}</li>" for i in range(9)) + "</ul>"
    page = f"<main><p>One paragraph of the story. It goes on.</p></main>{menu}"
    assert "Here you find" in alone(page) and html.main_text(page) == "One paragraph of the story. It goes on."


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x y z.", "<div>" * 50_000 + "</span>" * 50_000 + "<p>a b.", "<div><p>t one.</p>" * 20_000, "<i>" * 50_000 + "x"])
def test_deep_pages_take_time_in_proportion(page):
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 2
