import random

from barloom.llm import htmltext

PAGES = "page_id long, url string, html string"


def length(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_longest_common_subsequence():
    own = random.Random(1)
    for _ in range(800):
        a, b = ([own.randrange(4) for _ in range(own.randrange(10))] for _ in range(2))
        got = htmltext.shared_lines(a, b)
        assert len(got) == length(a, b) and got == sorted(set(got))
        rest = iter(b)
        assert all(any(a[k] == y for y in rest) for k in got)


def text(page):
    lines, marked = htmltext.blocks(page)
    return [line for line, m in zip(lines, marked) if m] if any(marked) else lines


def test_markup():
    page = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";x(0);</script></head><body>'
            '<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div><article><h1>Head &amp; tail</h1>'
            '<p><b>One<br><p>Two   <i>th</i>ree&nbsp;&#233;</p><div class="cookie-notice">no <div>no</div></div><form>f<p>x</p></form>'
            '<section id="comments"><p>no</p></section>End</article><footer>&copy; f</footer></body></html>')
    assert text(page) == ["Head & tail", "One", "Two three é", "End"]
    assert text("") == [] and text("plain") == ["plain"] and text("a < b") == ["a < b"]
    assert text("<script>never closed <p>x") == [] and text("<p>a<aside>b") == ["a"]
    assert text('<p title="a>b">c</p>') == ["c"] and text("<body class=has-sidebar><p>x</p>") == ["x"]


def test_template_lines_go_where_no_article_is_marked(spark):
    def page(own):
        return f"<body><p>Site title</p><p>{own}</p><p>All rights reserved</p></body>"

    rows = [(i, f"http://a.org/x/{i:02d}", page(f"Story {i}")) for i in range(12)]
    rows += [(50, "http://alone.org/1", page("Only one")), (51, None, None), (52, "u", ""),
             (53, "http://a.org/x/03", page("Story 3")), (3, "http://a.org/x/03", page("Story 3"))]
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"])
           for r in htmltext.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    for i in (*range(3), *range(5, 12)):
        assert got[i, f"http://a.org/x/{i:02d}"] == (f"Story {i}", len(f"Story {i}"))
    assert got[50, "http://alone.org/1"][0] == "Site title Only one All rights reserved"
    assert got[51, None] == ("", 0) and got[52, "u"] == ("", 0)
    assert htmltext.main_text(spark.createDataFrame(rows, PAGES)).count() == len(rows)


def test_marked_articles_keep_shared_lines(spark):
    rows = [(i, f"http://a.org/{i}", f"<nav>m</nav><article><p>Same</p><p>Own {i}</p></article>") for i in range(3)]
    frame = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS lines", "2 AS shared", "3 AS host", "4 AS _row")
    assert [r["text"] for r in htmltext.main_text(frame).orderBy("page_id").collect()] == [f"Same Own {i}" for i in range(3)]


def test_empty_table_and_partitions(spark):
    assert htmltext.main_text(spark.createDataFrame([], PAGES)).count() == 0
    rows = [(i, f"http://a.org/x/{i:03d}", f"<p>Top {i // 3}</p><p>Own {i}</p><p>End</p>") for i in range(60)]
    seen = set()
    for parts in ("1", "5", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        seen.add(tuple(r["text"] for r in htmltext.main_text(spark.createDataFrame(rows, PAGES)).orderBy("page_id").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(seen) == 1


def test_unwanted_elements_without_end_tag():
    article = "<article><p>One<p>Two</article>"
    for open_ in ('<p class="notice">x', '<ul><li class="menu">x', "<aside>x", "<form>x<p>y", '<div class="ad">x<div>y</div>',
                  "<div><aside>x</div>", '<div><p>y</p><span class="ad">x<p>z</div>'):
        assert text(open_ + article) == ["One", "Two"], open_
    assert text('<p class="notice">x<p>a') == ["a"] and text('<ul><li class="menu">x<li>a</ul><p>b') == ["a", "b"]
    assert text("<div><aside>x<p>y</div><p>a") == ["a"] and text("<div>a<nav>x</div>b") == ["a", "b"]
    assert text('<div class="ad"><b>x<div>y</b>z</div>w</div>a') == ["a"] and text("<p>a<aside>b") == ["a"]
    assert text(article + '<section class="comments"><article>no</article></section><p>no') == ["One", "Two"]
    assert text("<nav>a</nav>b<nav>c</nav>d") == ["b", "d"]


def test_raw_names_are_whole_and_may_close_themselves():
    assert text('<p>a<svg width="1"/><p>b') == ["a", "b"] and text("<p>a<svg/>b") == ["ab"]
    assert text("<select-box>a</select-box><p>b") == ["a", "b"] and text("<title-bar>a</title-bar>") == ["a"]
    assert text("<script src=/a/>no</script>b") == ["b"] and text("<svg><path/><text>no</text></svg>b") == ["b"]


def test_article_content_is_kept():
    page = ('<p class="alert">no</p><article><h2 class="section-header">Head</h2><p class="related">One</p>'
            '<figure class="wide"><table><tr><td>T</td></tr></table><figcaption>Caption</figcaption></figure>'
            '<p>x <math><mi>y</mi></math></p><blockquote id="reply">Quote</blockquote><div class="share">no</div>'
            '<p hidden>no</p><aside>no</aside></article><figure>out</figure>')
    assert text(page) == ["Head", "One", "T", "Caption", "x y", "Quote"]
    assert text('<h2 class="header">no</h2><p>a<figure>b</figure>') == ["a", "b"]


def test_marked_pages_are_neighbours_of_unmarked_ones(spark):
    rows = [(1, "http://a.org/x/1", "<p>Site title</p><article><p>Own 1</p></article><p>All rights</p>"),
            (2, "http://a.org/x/2", "<p>Site title</p><p>Own 2</p><p>All rights</p>")]
    got = [r["text"] for r in htmltext.main_text(spark.createDataFrame(rows, PAGES)).orderBy("page_id").collect()]
    assert got == ["Own 1", "Own 2"]


def test_class_words_say_what_a_part_is():
    for kept in ("main-menu-page", "ad-free-content", "social-science", "market-share-table", "has-sidebar"):
        assert text(f'<div class="{kept}"><p>Story</p></div>') == ["Story"], kept
    for gone in ("ad", "ad-box", "cookie-notice", "sidebar-left", "related-posts", "comment-list", "x share_buttons", "ad-300x250"):
        assert text(f'<div class="{gone}"><p>no</p></div><p>Story') == ["Story"], gone


def test_titles_of_articles_stay_and_comments_marked_as_articles_go():
    page = ('<header>no</header><article><header><h1>Title</h1></header><p>One</p></article>'
            '<article class="reply"><p>no</p></article><article id="comment-7"><p>no</p></article>')
    assert text(page) == ["Title", "One"]
    assert text('<article class="post social"><p>One</p></article>') == ["One"]


def test_broken_markup():
    assert text("<p>a</p><!-- b") == ["a"] and text("<p>a</p><!-- b <p>c") == ["a"] and text("<p>a</p>b <c") == ["a", "b <c"]
    assert text("<p>a<![CDATA[ x <p>") == ["a"] and text("<p>a<script>x</p> y") == ["a"] and text("<p>a<!-- x --> b") == ["a b"]
    assert text("<p>a<script>x</script> b") == ["a b"] and text("<!doctype html>a") == ["a"] and text("<p>a<svg/> b") == ["a b"]


def test_time_grows_with_the_page():
    import time

    big = 200_000
    pages = ["<a " * big, "<!" * big, "<a '\"" * big, "<script " * big, "<!--" * big, "<p>" + "<a <b " * big + ">", "<" * big, "<svg " * big + ">",
             "<nav>" + "<b>" * big + "<p>" * big, "<nav><i><div>" + "<b>" * big + "</i>" * big, '<div class="' * big, "<aside>" * big]
    for page in pages:
        started = time.perf_counter()
        htmltext.blocks(page)
        assert time.perf_counter() - started < 15, page[:20]
