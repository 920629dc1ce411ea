"""Style trees: importance against a plain count, and the text of odd pages."""

import math
from collections import Counter

import pytest

from sluice.llm import html_tree

MENU = "<nav><ul><li><a href='/'>Home</a></li><li>About</li></ul></nav>"


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "html, text",
    [
        (page(f"{MENU}<article><h1>Head &amp; <b>all</b></h1><p>One\n two<br>three<p>four &eacute;&#233;&nbsp;x</article><footer>&copy; me</footer>"), "Head & all\nOne two three\nfour éé x"),
        (page('<div class="ad">buy</div><main><header><h2>In</h2></header><p>a</p><aside>side</aside><form><p>mail</p></form><div id="comments"><p>first!</p></div></main>'), "In\na"),
        (page("<p>no landmarks</p><div>but text</div>"), "no landmarks\nbut text"),
        ("<article><p>cut off in the mid &am", "cut off in the mid &am"),
        ("<article>a<!-- <p>no</p> -->b<script>x<p></script>c</article>", "abc"),
        ('<article><p title="a > b">q</p><td>x<tr></article>', "q\nx"),
        ("plain text only", "plain text only"), ("", ""), ("<nav>x</nav>", ""), ("<article><ul><li>1<li>2<ul><li>3</ul></ul></article>", "1\n2\n3"),
        ("<ARTICLE><P>Big</P></ARTICLE>", "Big"),
        ("<article><p title=it's>a</p><p class = 'x' data-id=\"ad\">b</p><p title=\"class=ad >\">c</p><p class=ad>d</p></article>", "a\nb\nc"),
        ("<div role=main class=\"has-sidebar\">in<article class=\"comment\">no</article></div><div class=main>out</div>", "in"),
        ("<article>a" + "<p x='" * 5000 + "</article>", "a"), ("<article>x<b title=\"open>y</b></article>", "xy"), ("<article>1 < 2 & 3</article>", "1 < 2 & 3"),
    ],
)
def test_marks_alone(html, text):
    assert html_tree.main_text(html, {}) == text


def site(n):
    return [page(f"<div>Welcome to our site</div><div><p>own text number {i}</p><p>and more of {i}</p></div><table><tr><td>All rights</td></tr></table>") for i in range(n)]


def test_importance_is_what_counting_gives(spark):
    pages = [(i, f"http://a.example/{i}", h) for i, h in enumerate(site(8))] + [(100, "https://u@b.example:80/x", site(1)[0]), (101, None, "<p>x</p>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {(r.host, r.node): (r.pages, r.importance) for r in html_tree.node_importance(html_tree.style_counts(frame)).collect()}
    seen = {}
    for _, url, h in pages:
        host = "" if url is None else "b.example" if "b." in url else "a.example"
        blocks, children = html_tree.parse(h)
        for n, kids in children.items():
            m, styles, texts = seen.setdefault((host, n), [0, Counter(), Counter()])
            seen[host, n][0] += 1
            if kids:
                styles["|".join(kids)] += 1
            texts.update({b.text for b in blocks if n in b.nodes})
    assert set(got) == set(seen)
    for key, (m, styles, texts) in seen.items():
        worth = html_tree.NEUTRAL
        if m > 1:
            s, t = sum(styles.values()), sum(texts.values())
            look = -sum(c / s * math.log(c / s, m) for c in styles.values()) if s else 0.0
            said = 1 - sum(c * math.log(c, m) for c in texts.values()) / t if t else 0.0
            worth += (max(said, look / 2) - worth) * m / (m + html_tree.PRIOR_PAGES)
        assert got[key][0] == m and abs(got[key][1] - worth) < 1e-9


def test_unmarked_boilerplate_falls(spark):
    pages = [(i, f"http://a.example/{i}", h) for i, h in enumerate(site(30))] + [(50, None, None), (51, "odd", "<article>x</article>"), (51, "odd", "<article>x</article>")]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    rows = html_tree.extract(frame).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == 33 and got[50] == "" and got[51] == "x"
    assert got[3] == "Welcome to our site\nown text number 3\nand more of 3" or got[3] == "own text number 3\nand more of 3"
    assert "All rights" not in got[3]
    assert html_tree.extract(frame.limit(0)).collect() == []


def test_a_join_gives_what_a_broadcast_gives(spark, monkeypatch):
    frame = spark.createDataFrame([(i, f"http://h{i % 3}.example/", h) for i, h in enumerate(site(24))], "page_id long, url string, html string")
    usual = sorted(map(tuple, html_tree.extract(frame).collect()))
    monkeypatch.setattr(html_tree, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, html_tree.extract(frame).collect())) == usual


def test_importance_decides_in_and_out_of_landmarks(spark):
    said = "<p class='legal'>Terms apply to all</p>"
    pages = [(i, f"http://a.example/{i}", page(f"<div class='story'><p>story {i} of its own</p></div><div class='tail'>Same tail</div><article><p>piece {i}</p>{said}</article><div class='ad'>buy {i}</div>")) for i in range(12)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_tree.extract(frame).collect()}
    assert got == {i: f"story {i} of its own\npiece {i}" for i in range(12)}


@pytest.mark.parametrize("n", [4, 5, 1000])
def test_copies_keep_their_text(spark, n):
    copy, own = page("<div><p>The same story</p><p>on each</p></div>"), [page(f"<div><p>story {i}</p></div>") for i in range(6)]
    pages = [(i, f"http://a.example/{i}", copy) for i in range(n)] + [(n + i, f"http://b.example/{i}", copy) for i in range(n)]
    pages += [(2 * n + i, f"http://b.example/own{i}", h) for i, h in enumerate(own)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_tree.extract(frame).collect()}
    assert got == {i: "The same story\non each" for i in range(2 * n)} | {2 * n + i: f"story {i}" for i in range(6)}
    assert {r.pages for r in html_tree.node_importance(html_tree.style_counts(frame)).filter("node = %d" % html_tree.node_id("")).collect()} == {1, 7}


def test_a_tree_never_takes_all_of_a_page(spark):
    nearly = [page(f"<script>track({i})</script><p>One story for all</p><nav>menu</nav>") for i in range(9)]
    frame = spark.createDataFrame([(i, "http://a.example/", h) for i, h in enumerate(nearly)], "page_id long, url string, html string")
    assert {r.text for r in html_tree.extract(frame).collect()} == {"One story for all"}


WRAPPERS = [("<body class='has-sidebar'>", "</body>"), ("<body id=no-sidebar>", "</body>"), ("<div id='page' class='cookie-consent'>", "</div>"), ("<form>", "</form>"), ("<div class='comments-open'>", "</div>"), ("<html class=popup><body class=nav>", "</body></html>")]


@pytest.mark.parametrize("start, end", WRAPPERS)
@pytest.mark.parametrize(
    "html, text",
    [
        ("<nav>menu</nav><article><h1>Head</h1><p>all of the text</p></article><div class='ad'>a longer advert than all of the text</div><footer>me</footer>", "Head\nall of the text"),
        ("<nav>menu</nav><div class=related>an article elsewhere, of many words</div><main>in</main>", "in"),
        ("<nav>menu</nav><p>plain text of the page</p><div class='ad'>buy</div>", "plain text of the page"),
    ],
)
def test_names_of_wrappers_are_no_marks(start, end, html, text):
    assert html_tree.main_text(f"{start}{html}{end}", {}) == text


def test_names_that_stay_marks():
    said = "<article>the main text of it</article>"
    assert html_tree.main_text(f"<aside><article>no</article></aside><div class=related><article>nor</article></div><form>mail</form>{said}", {}) == "the main text of it"
    assert html_tree.main_text(f"<div class=wide-promo>{said}</div><div id=comments><article>first!</article></div>", {}) == "the main text of it"
    assert html_tree.main_text("".join(f"<div class='x-widget'><p>part {i}</p></div>" for i in range(3)) + "<nav>menu</nav>", {}) == "part 0\npart 1\npart 2"
    assert html_tree.main_text("".join(f"<div class='x-widget'><article>part {i}</article></div>" for i in range(3)) + "<p>credits</p>", {}) == "part 0\npart 1\npart 2"


@pytest.mark.parametrize(
    "html, text",
    [
        ('<article><p>of the article</p><section class="related-work"><p>Related work text</p></section></article>', "of the article\nRelated work text"),
        ('<article><div class="notice-board"><p>pinned</p></div><p>x</p></article>', "pinned\nx"), ('<article><p class="ad-lib">spoken</p><div class="social-history">of a town</div></article>', "spoken\nof a town"),
        ('<article><table class="menu"><tr><td>soup</td></tr></table></article>', "soup"), ('<article><p>x</p><div class="ad-slot">buy</div><div class="share buttons">tell</div><ul class="related posts"><li>more</li></ul></article>', "x"),
        ('<div class="post"><p>short text</p></div><div id="comments"><p>a far longer comment than all of the text</p></div>', "short text"),
        ('<article><p>x</p><div class="comment-list"><p>a far longer comment than all of the text</p></div></article>', "x"), ('<article class="no-comments"><p>x</p></article>', "x"),
        ('<div class="reader-comments"><p>all that there is</p></div>', "all that there is"),
    ],
)
def test_names_inside_articles_and_comments(html, text):
    assert html_tree.main_text(html, {}) == text


def test_the_cut_of_a_host_alone(spark):
    """Without a mark, texts of a menu that are other ones on most pages are told from articles by where their host parts."""
    pages = []
    for host in ("a", "b", "one"):
        for i in range(40 if host != "one" else 1):
            menu = f"<ul><li>menu {i % (9 if host == 'a' else 25)}</li></ul>"
            pages.append((len(pages), f"http://{host}.example/{i}", page(f"{menu}<div><p>story {host} {i}</p><p>goes on {i}</p></div>")))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_tree.extract(frame, marks=False).collect()}
    for k, url, _ in pages[:80]:
        host, i = url[7], url.rsplit("/", 1)[1]
        assert got[k] == f"story {host} {i}\ngoes on {i}"
    assert got[80].endswith("story one 0\ngoes on 0")  # a host of one page has no cut
    cuts = {r.host: r.importance for r in html_tree.host_cuts(html_tree.node_importance(html_tree.style_counts(frame))).collect()}
    assert set(cuts) == {"a.example", "b.example"} and cuts["a.example"] < cuts["b.example"] < 1


def test_few_pages_weigh_little_and_no_number_is_a_switch(spark):
    said = "<p class='legal'>Terms apply to all</p>"
    for n in (1, 2, 4, 6, 12):
        pages = [(i, f"http://a.example/{i}", page(f"<article><p>piece {i}</p>{said}</article>")) for i in range(n)]
        frame = spark.createDataFrame(pages, "page_id long, url string, html string")
        worth = [r.importance for r in html_tree.node_importance(html_tree.style_counts(frame)).collect()]
        assert all(abs(w - html_tree.NEUTRAL) <= n / (n + html_tree.PRIOR_PAGES) / 2 + 1e-9 for w in worth)
        assert {("Terms" in r.text) for r in html_tree.extract(frame).collect()} == {n <= 4}
