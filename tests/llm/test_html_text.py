"""Main texts of pages."""

import html
import random
import re
import time

import pytest

from tidelog.llm import html_text


def text_of(source):
    return "\n\n".join(html_text.content_blocks(source)[0])


@pytest.mark.parametrize(
    "source, expected",
    [
        (None, ""),
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>a<p>b<br>c<div>d</div>e", "a\n\nb c\n\nd\n\ne"),
        ("<article><p><b>x<br><p>y</article>z", "x\n\ny"),
        ("<nav>m</nav><main><h1>T</h1>a &amp; b &#233;&nbsp;c<footer>f</footer></main>out", "T\n\na & b é c"),
        ("<body><header>h</header><div class='side-bar sidebar'>s</div><p>t<form>f</form><footer>x</footer>", "t"),
        ("<article><header><h1>Title</h1></header><p>t</p><div id='comments'><p>c</p></div></article>", "Title\n\nt"),
        ("<article>a</article><article class='comment'>c</article><article>b</article>", "a\n\nb"),
        ("<p>a<script>var x = '</p>';</script>b<style>p{}</style>c<!-- <p>d --><textarea><p>e</textarea>", "abc"),
        ("<p hidden>a</p><p style='display: none'>b</p><div role=navigation>c</div><p>d", "d"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a\n\nb\n\nc\n\nd\n\ne"),
        ("<p>a < b and c</i> d</p></div>e", "a < b and c d\n\ne"),
        ("<p title='x > y'>a<img alt='b'>c<span>d</span>", "a cd"),
        ("<!DOCTYPE html><html><head><title>t</title></head><body>b", "b"),
        ("<div class='advice header-note'>a</div><div class='ad'>b</div>", ""),
        ("<p>unclosed <a href='x", "unclosed"),
        ("<article><p>" + "long " * 5000 + "</article>", ("long " * 5000).strip()),
    ],
)
def test_blocks(source, expected):
    assert text_of(source) == expected


@pytest.mark.parametrize(
    "source, expected",
    [
        ("<div class='layout has-sidebar'><p>a</p></div><div class='no-sidebar'>b</div>", "a\n\nb"),
        ("<article class='hentry comments-open'><p>a</p></article>", "a"),
        ("<article><h2 id='related-work'>a</h2><section id='share-price'>b</section><p id='ad-hoc-methods'>c</p></article>", "a\n\nb\n\nc"),
        ("<h2 id='comments'>a</h2><div class='cheader subheader-text'>b</div><h3 class='entry-header'>c</h3>", "a\n\nb\n\nc"),
        ("<div class='site-header'>x</div><div class='Header'>x</div><p>a</p><div class='related_posts'>x</div>", "a"),
        # What holds the content is not dropped, whatever its name.
        ("<div class='sidebar widget'><main><p>a</p></main></div><div>z</div>", "a"),
        ("<form id='f'><div class='share'><article><p>the story</p></article></div></form><p>z</p>", "the story"),
        ("<p>a long story</p><aside><article>card</article></aside>", "a long story"),
        ("<article>a</article><div id='comments'><article>c c c c</article></div>", "a"),
        ("<p>a post</p><div id='comments'><article>a long, long comment</article></div>", "a post"),
        # Cards beside the text of main.
        ("<main><h1>T</h1><p>a long story</p><article>card</article></main><article>out</article>", "T\n\na long story\n\ncard"),
        ("<main><p>by</p><article>a long story</article></main>", "a long story"),
    ],
)
def test_names_and_marks_leave_content(source, expected):
    assert text_of(source) == expected


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, templates string").repartition(3)


def test_site_templates_are_removed(spark):
    share = "<div><a href='/s'>share this</a> <a href='/t'>tell a friend</a></div>"
    rows = []
    for i in range(12):
        top = "<div><p>Acme news, every day</p></div>"
        rows.append((i, f"https://Acme.org:80/{i}", f"{top}<div><p>story {i}</p></div><div><p>legal text</p></div>", "x", "y"))
        shared = "<p>a passage that all pages quote</p>"
        rows.append((100 + i, f"http://news.org/{i}", f"<article><p>item {i}</p>{shared}{share}</article>", "x", "y"))
    rows += [(200, None, "<p>alone</p>", None, None), (201, "no url", None, None, None), (0, rows[0][1], rows[0][2], "x", "y")]
    got = {r.page_id: r for r in html_text.main_texts(pages_of(spark, rows)).collect()}
    assert {got[i].text for i in range(12)} == {f"story {i}" for i in range(12)}
    assert {got[100 + i].text for i in range(12)} == {f"item {i}\n\na passage that all pages quote" for i in range(12)}
    assert (got[200].text, got[201].text, got[201].n_chars) == ("alone", "", 0)
    assert html_text.main_texts(pages_of(spark, rows)).count() == len(rows)
    # The same subtree on too few pages stays.
    few = [r for r in rows if r[0] in (1, 2)]
    assert html_text.main_texts(pages_of(spark, few)).first().text.startswith("Acme news, every day\n\nstory")


@pytest.mark.parametrize("copies", [4, 1000])
def test_copies_of_a_page_are_no_template(spark, copies):
    """Copies count once, though their markup differs; what different pages share still goes."""
    links = "<ul><li><a href='/s'>source one</a><li><a href='/t'>source two</a></ul>"
    rows = []
    for i in range(copies):
        rows.append((i, None, f"<div data-n='{i % 3}'><p>only page</p></div><div><p>its end</p></div>", "x", "y"))
        rows.append((10000 + i, "http://c.org/", f"<article><p>story</p>{links}</article>", "x", "y"))
    for i in range(8):
        rows += [(20000 + i, f"http://d.org/{i}", f"<div><p>part {i}</p></div><div><p>legal</p></div>", "x", "y")] * 2
    got = html_text.main_texts(pages_of(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id < 10000:
            assert r.text == "only page\n\nits end"
        elif r.page_id < 20000:
            assert r.text == "story\n\nsource one\n\nsource two"
        else:
            assert r.text == f"part {r.page_id - 20000}"


def test_empty_table(spark):
    assert html_text.main_texts(pages_of(spark, [])).count() == 0


def test_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in html_text.main_texts(pages).collect()}
    for page in pages.collect():
        body = re.search("<article>(.*?)</article>", page.html, re.DOTALL).group(1)
        marked = re.sub("</?(?:h1|p)>", "\x00", body).replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in marked.split("\x00")]
        expected = "\n\n".join(b for b in blocks if b)
        assert got[page.page_id].text == expected and got[page.page_id].n_chars == len(expected)


@pytest.mark.parametrize(
    "source, expected",
    [
        ("<article><p>See <a href=/it's>the report</a> of the <b>day</b>.</p><p>It's out.</p><p>End</p></article>", "See the report of the day.|It's out.|End"),
        ("<article><p title='a > b' class=x>one</p><p title=\"it's > \" >two</p></article>", "one|two"),
        ("<article><p data-x= 'q' y=a=b' z>one</p>it's<p>two</p></article>", "one|it's|two"),
        ("<article><p x= >one</p><p don't>two isn't</p></article>", "one|two isn't"),
        ("<article><p>one</p><p class=\"never closed>two</p></article>", "one|two"),
    ],
)
def test_quotes_open_values_only_behind_an_equals_sign(source, expected):
    assert text_of(source) == expected.replace("|", "\n\n")


@pytest.mark.parametrize("start, end", [("<div>x", ""), ("<ul><li>x", ""), ("<b>x<p>", "</i></section>"), ("<section><h2>x</h2>", "</p>")])
def test_deep_pages_take_linear_time(start, end):
    def seconds(n):
        begin = time.process_time()
        texts, own, hashes, around = html_text.content_blocks(start * n + "end" + end * n)
        html_text.subtree_hashes(start * n + end * n)
        assert len(texts) >= n and len(hashes) == len(around) and max(own) < len(hashes)
        assert all(outer < place for place, outer in enumerate(around))
        return time.process_time() - begin

    small = max(seconds(10_000), 0.2)
    assert seconds(100_000) < 40 * small


def test_templates_of_random_pages_equal_a_plain_count(spark):
    """Subtrees are counted over different pages and taken out by a plain reading of the tree."""
    rng = random.Random(4)
    menus = [f"<div><p>menu {i}</p><ul><li>a {i}</li><li>b {i}</li></ul></div>" for i in range(6)]
    bodies = [[rng.choice(menus) for _ in range(3)] + [f"<div><p>own {i}</p></div>"] for i in range(60)]
    for body in bodies:
        rng.shuffle(body)
    rows = [(i, f"http://h{i % 2}.example/{i}", "".join(body)) for i, body in enumerate(bodies)]
    rows += [(100 + i, "http://h0.example/copy", rows[0][2]) for i in range(30)]
    expected = {}
    for number, url, source in rows:
        host = url.split("/")[2]
        same = {r[2] for r in rows if r[1].split("/")[2] == host}
        kept = []
        for piece in source.replace("</div>", "</div>|").split("|")[:-1]:
            n = sum(piece in other for other in same)
            if not (n >= html_text.LEAST_PAGES and n >= html_text.LEAST_SHARE * len(same)):
                kept += [p for p in re.sub("<[^>]*>", "|", piece).split("|") if p]
        expected[number] = "\n\n".join(kept)
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_text.main_texts(pages).collect()}
    assert got == expected and any("menu" not in t for t in got.values())
