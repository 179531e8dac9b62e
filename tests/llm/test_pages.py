"""Main text of pages: tags by the standard's states, doubtful elements by learned parts, time in proportion to the page."""

import time

import pytest

from vocalgrid.llm import html_text, queries

SF = "/root/testdata/sf0.001"
BODY = " ".join(f"word{k}" for k in range(40))
COMMENTS = ["comment-list", "comments-area", "post-comments", "CommentThread", "reader_comments", "disqus-thread"]
INSERTS = ["cookie-banner", "sidebar-left", "ad-slot", "newsletter-signup", "social-share", "site-header", "AdBox", "relatedPosts", "login_form", "promo"]
WRAPPERS = ["content has-sidebar", "with-header", "page no-menu widget", "site-content hasComments", "entry-content"]


@pytest.fixture(scope="module")
def learned(spark):
    return html_text.fitted(spark.read.parquet(f"{SF}/pages.parquet"))


@pytest.fixture(params=["prior", "learned"])
def shares(request, learned):
    return {} if request.param == "prior" else learned


@pytest.mark.parametrize("page,text", [
    ("<article><p data-x=it's>He said it's fine and good today</p></article>", "He said it's fine and good today"),
    ("<article><p d'x a\"b>One two three four</p></article>", "One two three four"),
    ("<article><p title='a>b' alt=\"c'd>\">One two three four</p></article>", "One two three four"),
    ("<article><p title=\"never ends>One two three four</p></article>", "One two three four"),
    ("<article><p a = 'x' b=\"\" c= d>One two three four five six seven <b e='>eight nine ten</b></p></article>", "One two three four five six seven eight nine ten"),
    ("<article><p>One<!--> two --> three four<!-- <b>no</b> --></article>", "One two --> three four"),
    ("<article><p>1 &lt; 2 < 3 &am", "1 < 2 < 3 &am"),
    ("<ARTICLE><P>One two three four<B/> five</P></ARTICLE>", "One two three four five"),
])
def test_tags_by_the_standard(shares, page, text):
    assert html_text.main_text(page, shares) == text


@pytest.mark.parametrize("name", COMMENTS)
@pytest.mark.parametrize("mark", ["<article><p>%s</p></article>", "<div class='content has-sidebar'><p>%s</p></div>", "<div><p>%s</p></div>"])
@pytest.mark.parametrize("attribute", ["class", "id"])
def test_reader_comments_go(shares, name, mark, attribute):
    page = f"<nav>Home Away</nav>{mark % BODY}<section {attribute}='{name}'><p>{'Reader words here. ' * 60}</p></section><footer>Imprint</footer>"
    assert html_text.main_text(page, shares) == BODY


@pytest.mark.parametrize("name", INSERTS)
def test_inserts_go(shares, name):
    page = f"<article><p>{BODY}</p><div class='{name} big'><p>Other words</p></div><p>{BODY}</p></article>"
    assert html_text.main_text(page, shares) == f"{BODY} {BODY}"


@pytest.mark.parametrize("name", WRAPPERS)
@pytest.mark.parametrize("mark", ["<article>%s</article>", "%s"])
def test_wrappers_stay(shares, name, mark):
    inner = mark % f"<p>{BODY}</p><div class='ad'>Buy</div><p>{BODY}</p>"
    assert html_text.main_text(f"<nav>Away</nav><div class='{name}'>{inner}</div><footer>Imprint</footer>", shares) == f"{BODY} {BODY}"


def test_own_headers_stay_and_site_headers_go(shares):
    page = f"<header>Site name</header><div class=post><div class='post-header'><h1>{BODY}</h1></div><p>{BODY}</p></div>"
    assert html_text.main_text(page, shares) == f"{BODY} {BODY}"


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + "text " + "</div>" * 50_000 + "</p>" * 100_000, "<div class=ad>" * 50_000 + "a<b> " * 50_000 + "</i>" * 50_000, "<p a='" * 100_000, "<p a=\"x" * 99_999,
    "<textarea>" * 100_000, "<!--" * 100_000, "<p " + "a=b " * 100_000, "<" * 300_000, "&amp;" * 100_000, "<p a" + " " * 200_000 + "<p",
])
def test_time_follows_the_length(page):
    start = time.time()
    html_text.main_text(page, {})
    assert time.time() - start < 15


def test_weights_are_learned():
    own = f"<article>{'<div class=widget><p>' + BODY + '</p></div>'}</article><nav>a b c</nav>"
    counts = html_text.observed(own)
    assert counts["has:widget", True] == 40 and counts["is:nav", False] == 3
    assert html_text.main_text(f"<p>{BODY}</p><div class=widget><p>{BODY}</p></div>", {"has:widget": 0.9}) == f"{BODY} {BODY}"
    assert html_text.main_text(f"<p>{BODY}</p><div class=widget><p>{BODY}</p></div>", {}) == BODY


def test_query_cases(spark):
    names = "page_id long, url string, html string, text string, n_chars long"
    rows = [(1, "u", f"<article><p>{BODY}</p></article>", "x", 1), (None, None, None, "x", 1), (2, "v", "", None, None), (1, "u", f"<article><p>{BODY}</p></article>", "x", 1)]
    df = spark.createDataFrame(rows, names)
    made = html_text.extracted(df, html_text.fitted(df)).collect()
    assert sorted((r["text"], r["n_chars"]) for r in made) == [("", 0), ("", 0), (BODY, len(BODY)), (BODY, len(BODY))]
    assert html_text.extracted(df.limit(0), html_text.fitted(df.limit(0))).collect() == []
    assert queries.QUERIES["op7_html_text"](spark, SF).columns == ["page_id", "url", "text", "n_chars"]
