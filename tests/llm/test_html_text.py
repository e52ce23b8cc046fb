import math
import random
import time

import pytest

from tideline.llm.html_text import Page, densities, extract, main_text

TEXT = "A long enough paragraph of the article, with several words in it, and a few more. "
PARTS = "".join(f"<p>{TEXT * 3}{i}</p>" for i in range(4))
WANT = [f"{TEXT * 3}{i}" for i in range(4)]
ASIDES = {
    "menu": '<nav><ul><li><a href="/x">Home</a></li><li><a href="/y">News</a></li></ul></nav>',
    "header": "<header><p>Site name and its motto</p></header>",
    "header class": '<div id="header">Site name and its motto</div>',
    "footer": "<footer>&copy; 2020 someone. All rights reserved, and so on and on.</footer>",
    "sidebar": '<div class="right-sidebar"><p>Popular texts of this week and of last week</p></div>',
    "notice": '<div class="cookie-notice">We use cookies to make this site better for you.</div>',
    "advert": '<div class="ad">Buy now, only today, at half the price of tomorrow!</div>',
    "form": "<form><label>Mail</label><input><button>Send it</button></form>",
    "script": '<script>var t="</p><p>not text</p>";</script><style>p{margin:0}</style>',
    "comments": '<section id="comments"><p>' + "I liked this text a lot, thank you. " * 4 + "</p></section>",
    "links": '<div><a href="1">one link</a> <a href="2">two links</a> <a href="3">three links</a></div>',
    "comment": "<!-- <p>nothing</p> -->",
}


@pytest.mark.parametrize("name", ASIDES)
@pytest.mark.parametrize("holder", ["<article>{}</article>", "<div class='post'>{}</div>", "<main><div>{}</div></main>"])
@pytest.mark.parametrize("before", [True, False])
def test_asides_go(name, holder, before):
    body = holder.format("<h1>The title</h1>" + PARTS)
    page = f"<html><head><title>No</title></head><body>{ASIDES[name] if before else ''}{body}{'' if before else ASIDES[name]}</body></html>"
    assert main_text(page).split("\n\n") == ["The title", *(" ".join(w.split()) for w in WANT)]


def test_article_in_two_parts_and_short_blocks():
    page = f"<body><div><div><h2>Part</h2>{PARTS}<p>Short.</p></div><div>{PARTS}</div></div><div id='sidebar'>x y z</div></body>"
    got = main_text(page).split("\n\n")
    assert got[0] == "Part" and got[5] == "Short." and len(got) == 10


def test_white_space_references_and_broken_markup():
    page = "<article><p><b>A&amp;B &lt;tag&gt;\n\t &nbsp; c<br>d<p>e &eacute; &#233;<p title='a>b'>f</article>"
    assert main_text(page) == "A&B <tag> c d\n\ne é é\n\nf"


@pytest.mark.parametrize("page", [None, "", "   ", "<p", "<!-- x", "<script>x", "<a href='x>y", "</p></div>", "<>", "<body><nav>a</nav>"])
def test_pages_without_text(page):
    assert main_text(page) in ("", "y", "<>")


def test_only_asides_by_name_still_gives_the_text():
    assert main_text(f"<body><div class='comment-page'>{PARTS}</div></body>").count("\n\n") == 3
    assert main_text(f"<body class='has-sidebar'><div class='no-sidebar'>{PARTS}</div></body>").count("\n\n") == 3


def test_any_markup_is_read_to_its_end():
    rng = random.Random(1)
    pieces = ["<p>", "</p>", "<div class='ad'>", "</div>", "<b", ">", "'", '"', "text ", "&amp;", "<!--", "-->", "<li>", "<table><tr><td>", "<script>", "</script>"]
    for _ in range(300):
        main_text("".join(rng.choice(pieces) for _ in range(40)))


def test_deep_and_long_pages():
    assert main_text("<div>" * 3000 + "x" + "</div>" * 3000) == "x"
    assert len(main_text("<article>" + "<p>" + "word " * 200_000 + "</article>")) == 999_999


def test_table(spark):
    rows = [(1, "u", f"<article>{PARTS}</article>", 1), (1, "u", f"<article>{PARTS}</article>", 1), (2, None, None, 2), (None, "v", "", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((str(r.page_id), r.n_chars) for r in extract(pages).collect())
    n = len("\n\n".join(" ".join(w.split()) for w in WANT))
    assert got == [("1", n), ("1", n), ("2", 0), ("None", 0)]
    assert extract(pages.limit(0)).count() == 0


def test_a_slash_does_not_end_a_script():
    assert main_text(f'<script src="a.js"/>var leaked=1;</script><article>{PARTS}</article>').count("\n\n") == 3
    assert "leaked" not in main_text(f"<style/>p{{leaked:1}}</style><article>{PARTS}<svg/><p>after</p></article>")
    assert main_text(f"<article>{PARTS}<svg/><p>after</p></article>").endswith("after")


@pytest.mark.parametrize(
    "part",
    ['<p class="alert-level">Named text.</p>', '<div class="related-work"><p>Named text.</p></div>', "<label>Named text.</label>",
     "<p><math><mi>Named</mi></math> text.</p>", '<h2 class="notice">Named text.</h2>', '<div class="search-results-study">Named text.</div>'],
)
def test_names_do_not_take_out_paragraphs(part):
    assert "Named text." in main_text(f"<body><article>{PARTS}{part}{PARTS}</article></body>").split("\n\n")


def test_stray_end_tags_take_linear_time():
    page = "<article>" + "<div>" * 30_000 + "</span>" * 60_000 + PARTS + "</article>"
    assert len(page) > 500_000
    start = time.process_time()
    assert main_text(page).count("\n\n") == 3
    assert time.process_time() - start < 2


def plain_densities(page):
    """Densities from the formula, each element's numbers counted anew over its whole subtree."""
    n = len(page.tag)
    under = lambda i, j: i == j or (j > 0 and under(i, page.parent[j]))
    linked = lambda j: j > 0 and (page.tag[j] == "a" or linked(page.parent[j]))

    def numbers(i):
        inside = [j for j in range(n) if under(i, j) and not page.aside[j]]
        texts = [(j, len(t.strip())) for j, t, _ in page.runs if j in inside]
        return sum(s for _, s in texts), len(inside) - 1, sum(s for j, s in texts if linked(j)), sum(page.tag[j] == "a" for j in inside if j != i)

    body = page.tag.index("body")
    c, _, lc, _ = numbers(body)
    share = lc / max(c, 1)
    own = []
    for i in range(n):
        c, t, lc, lt = numbers(i)
        t, lt = max(t, 1), max(lt, 1)
        if not c or page.aside[i]:
            own.append(0.0)
            continue
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        ratio = max(c / max(lc, 1) * t / lt, 1.0)
        own.append(c / t * (math.log(ratio) / math.log(base) if base > 1.0001 else math.log(ratio + 1)))
    return own, [sum(own[j] for j in range(1, n) if page.parent[j] == i) for i in range(n)]


def test_densities_equal_a_plain_count():
    rng = random.Random(3)
    for _ in range(25):
        pieces = ["<div>", "</div>", "<p>", "</p>", "<a href=x>", "</a>", "some words ", "more ", "<b>", "</b>", "<nav>", "</nav>"]
        page = Page("<html><body>" + "".join(rng.choice(pieces) for _ in range(60)) + "</body></html>")
        for got, want in zip(densities(page), plain_densities(page)):
            assert got == pytest.approx(want)
