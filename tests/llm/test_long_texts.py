"""Texts of a megabyte and more, ties and odd tables through the operators."""

import re
import time

import numpy as np
import pytest

from sluice.llm import chat, decontam, gam, html_tree, licenses, quality_rules, simhash, toxicity

RNG = np.random.default_rng(7)
PLAIN = " ".join(f"w{i}" for i in RNG.integers(0, 50_000, 250_000))  # about 1.5 MB


@pytest.fixture(scope="module")
def docs(spark):
    mid = len(PLAIN) // 2
    said = PLAIN[:mid] + " released under the MIT License. " + PLAIN[mid:] + "\nalpha beta gamma delta epsilon zeta eta theta iota kappa"
    return spark.createDataFrame([(1, said, "h"), (2, said, "h"), (3, "short", "h")], "doc_id long, text string, source string")


def test_licenses_without_end(spark):
    # Over a million matches in one text: work must grow with the text alone.
    docs = spark.range(1).selectExpr("id AS doc_id", "concat(repeat('mit license ', 800000), 'x apache license version 2 0') AS text")
    begun = time.monotonic()
    (row,) = licenses.scan(docs).collect()
    assert time.monotonic() - begun < 120
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == (1_600_006, 800_001, 0, 1_600_001)
    assert row.labels == ["apache", "apache-2.0", "mit"]


def test_license(docs):
    rows = {r.doc_id: r for r in licenses.scan(docs).collect()}
    text = docs.filter("doc_id = 1").first().text
    words = re.findall("[0-9a-z]+", text.lower())
    assert rows[1].n_words == len(words) and rows[1].first_word == words.index("mit") == rows[1].last_word
    assert rows[1].labels == ["mit"] == rows[2].labels and rows[3].labels == []


def test_quality_rules(docs):
    rows = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    text = docs.filter("doc_id = 1").first().text
    assert (rows[1].n_words, rows[1].word_chars, rows[1].n_repeat_words) == (len(text.split()), len("".join(text.split())), 0)
    assert rows[1].kept and not rows[3].kept


def test_leaks(spark, docs):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontam.find_leaks(docs, bench).collect()}
    text = docs.filter("doc_id = 1").first().text
    assert rows[1].n_hit == 10 and text[rows[1].spans[0].start : rows[1].spans[0].end] == "alpha beta gamma delta epsilon zeta eta theta iota kappa" and rows[3].n_hit == 0


def test_near_copies(docs):
    rows = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert rows[1] == rows[2] and rows[1][1] == 1 and rows[3][1] == 3


def test_classifiers(docs):
    net = toxicity.Network([])
    rows = {r.doc_id: r.score for r in toxicity.score(docs, net).collect()}
    words = toxicity.words_of(docs.filter("doc_id = 1").first().text)
    logits, counts, _ = toxicity._document_logits(net, [words])
    assert abs(rows[1] - net.chances(logits, counts)[0]) < 1e-5 and rows[1] == rows[2]
    x = np.array([gam.measure(docs.filter("doc_id = 1").first().text.encode())] * 50 + [gam.measure(b"x y z")] * 50)
    model = gam.Gam().fit(x, np.array([1] * 50 + [0] * 50), np.ones(100))
    scored = {r.doc_id: r.score for r in gam.score(docs, model).collect()}
    assert scored[1] == scored[2] > 0.5 > scored[3]


def test_page(spark):
    body = "".join(f"<p>{PLAIN[i : i + 2000]}</p>" for i in range(0, len(PLAIN), 2000))
    pages = spark.createDataFrame([(i, "http://a.example/", f"<html><body><nav>menu</nav><article>{body}</article></body></html>") for i in (1, 2)], "page_id long, url string, html string")
    said = "\n".join(" ".join(PLAIN[i : i + 2000].split()) for i in range(0, len(PLAIN), 2000))
    assert [r.text for r in html_tree.extract(pages).collect()] == [said, said]


def test_conversation(spark):
    rows = [(1, 0, "user", PLAIN), (1, 1, "assistant", PLAIN), (1, 1, "assistant", PLAIN)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (got,) = chat.conversation_digests(frame).collect()
    assert (got.n_turns, got.loss_chars) == (3, 2 * len(PLAIN)) and got.formatted_chars == 3 * len(PLAIN) + 13 + 14


def test_a_name_that_holds_the_hosts_text_is_overruled(spark):
    """The article stands in a branch called widget that is under half of some pages, as a long copy of all pages stands beside it."""
    tail = "".join(f"<p>all pages say this line {k} and then some more of the same</p>" for k in range(12))
    pages = [(i, "http://a.example/", f"<html><body><div class=widget><p>story {i} is told on this page alone, {i * 7919}</p></div><div>{tail}</div></body></html>") for i in range(20)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_tree.extract(frame).collect()}
    assert got == {i: f"story {i} is told on this page alone, {i * 7919}" for i in range(20)}


@pytest.mark.parametrize(
    "html, text",
    [
        ("<body class='has-sidebar'><article><p>kept</p></article></body>", "kept"), ("<body class='page no-comments'><h1>kept</h1><p>too</p></body>", "kept\ntoo"),
        ("<div class='search-page'><main>kept</main></div>", "kept"), ("<article><p>one of the text</p><p>and two of it</p></article><footer>no</footer>", "one of the text\nand two of it"),
    ],
)
def test_pages_keep_their_text(html, text):
    assert html_tree.main_text(html, {}) == text
