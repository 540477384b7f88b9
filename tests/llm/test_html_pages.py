"""Main text of pages without article elements, or with more than one body."""

import pytest

from porelake.llm import html


def page(body):
    return f"<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav>{body}<footer>(c) someone</footer></body></html>"


@pytest.mark.parametrize("usual, long", [(300, 10_000), (300, 6_000), (150, 3_000)])
@pytest.mark.parametrize("wrap", ["<div>{}</div>", "{}"])
def test_one_long_paragraph_sets_no_bar(usual, long, wrap):
    texts = [f"{i:02d}" + "x" * ((long if i == 20 else usual) - 2) for i in range(40)]
    assert html.main_text(page(wrap.format("".join(f"<p>{t}</p>" for t in texts)))) == " ".join(texts)


def test_siblings_stay_up_to_boilerplate():
    long = "A paragraph of the body that goes on for a good while. " * 5
    div = f"<div><h1>Head</h1><p>{long}</p><p>Yes.</p><ul><li>One.</li></ul><p>{long}</p></div><div class=ads><p>Buy {long}</p></div>"
    want = " ".join(f"Head {long} Yes. One. {long}".split())
    assert html.main_text(page(div)) == want
    links = "".join(f"<div><a href=x>Menu {i}</a></div>" for i in range(8))
    assert html.main_text(page(links + div)) == want


def test_a_body_beside_articles_stays():
    long = "Words of the main body that no article element holds at all. " * 4
    card = "A teaser card with enough words in it to be read as content by its ratio."
    got = html.main_text(page(f"<article><p>{card}</p></article><div><p>{long}</p><p>{long}</p></div><article><p>Short.</p></article>"))
    assert got.startswith(" ".join(f"{card} {long} {long}".split())) and got.endswith("Short.")


ONE = "A paragraph that is long enough to be read as content by anyone who counts. "


def test_the_ratio_decides_on_menus_and_weak_marks():
    menu = "<nav>" + "".join(f"<li><a href=x>Item {i}</a></li>" for i in range(5)) + "</nav><div>" + "".join(f"<div><a href=x>Plain {i}</a></div>" for i in range(5)) + "</div>"
    body = f"<article><h1>Head</h1><p>{ONE * 3}</p><p class=share>{ONE * 2}</p><div class=share><a href=x>Tweet</a> <a href=x>Pin it</a></div><section id=related><p>{ONE * 4}</p></section><p>End.</p></article>"
    got = html.main_text(f"<body>{menu}{body}</body>")
    assert got == " ".join(f"Head {ONE * 3}{ONE * 2}{ONE * 4}End.".split())
    without = html.main_text(f"<body>{menu}{body}</body>", ratio=lambda chars, tags: 1.0)
    assert "Item 1" in without and "Tweet" in without


@pytest.mark.parametrize("tag", ["article", "main", "div", "section"])
def test_no_element_is_content_by_its_name(tag):
    body = f"<{tag}><h1>Head</h1><section><h2>One</h2><p>{ONE * 5}</p></section><section><h2>Two</h2><p>Yes.</p></section></{tag}>"
    assert html.main_text(page(body)) == " ".join(f"Head One {ONE * 5} Two Yes.".split())


def test_class_words_around_the_heading_mask_nothing():
    assert html.main_text(f"<body><div class='has-sidebar sidebar'><h1>Head</h1><p>{ONE}</p><div class=sidebar><p>{ONE} aside</p></div></div></body>") == f"Head {ONE.strip()}"
    assert html.main_text(page(f"<div class=ad>{ONE * 9}</div><article><p>Short article.</p></article>")) == "Short article."


def test_pages_of_the_table_with_renamed_articles():
    """Recall of words against the pages as they are, whose articles are marked as such."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    cut = lambda p: p[p.index("<article>") + 9 : p.rindex("</article>")]
    for text in pages:
        want = html.main_text(f"<article>{cut(text)}</article>")
        for name in ("article", "div"):
            assert html.main_text(text.replace("<article>", f"<{name}>").replace("</article>", f"</{name}>")) == want
        assert "</a>" not in cut(text) and len(want.split()) >= 0.9 * len(" ".join(__import__("re").sub("<[^>]*>", " ", cut(text)).split()).split())


def test_odd_pages(spark):
    rows = [(1, "u", None, 1), (2, "u", "", 1), (2, "u", "", 1), (None, None, f"<p>{ONE}", 2), (3, "v", "<p>" + "x " * 500_000, 3), (4, "w", "<nav><a>a</a></nav>", 4), (5, "w", "plain text without a tag", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html.extract(pages).collect()}
    assert html.extract(pages).count() == len(rows)
    assert got[1, "u"] == got[2, "u"] == got[4, "w"] == ("", 0) and got[None, None][0] == ONE.strip()
    assert got[3, "v"][1] == 999_999 and got[5, "w"][0] == "plain text without a tag"
