import html
import re

from tessera.llm.html_extract import extract, extract_text, learn_weights
from tests.conftest import SF01

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def page(body, head="<title>T t</title><script>if(a<b){x('</p>')}</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_article_of_the_given_pages(spark):
    pages = spark.read.parquet(f"{SF01}/pages.parquet")
    got = {r.page_id: r for r in extract_text(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        body = re.sub(r"</?(?:p|h1|br)\b[^>]*>", "\n", body)
        want = " ".join(html.unescape(re.sub(r"</?b>", "", body)).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_unmarked_pages_keep_the_article_and_drop_the_rest(spark):
    learned = learn_weights(spark.read.parquet(f"{SF01}/pages.parquet"))
    main = [f"{WORDS} one.", f"{WORDS} <b>two</b>&amp;three.", f"caf&eacute;&nbsp;&#8212; {WORDS}"]
    body = "<header>Site name</header><nav><ul>" + "<li><a href='/x'>menu item</a></li>" * 8 + "</ul></nav>" \
        "<aside>side words here</aside><div class='ad'>Buy now!</div><div id='content'><h1>Title</h1><p>" \
        + "</p><div class='share-bar'><a href=#>share</a></div><p>".join(main) + "</p></div>" \
        "<form><input name=q><button>Send</button></form><div class='cookie-notice'>We use cookies</div>" \
        "<section class='comments'><p>reader one says a lot of words about all of this</p></section>" \
        "<!-- hidden --><footer>&copy; us</footer>"
    want = f"Title {WORDS} one. {WORDS} two&three. café — {WORDS}"
    assert extract(page(body), learned) == want
    assert extract(page(body.replace("<div id='content'>", "<article>")
                        .replace("</p></div><form>", "</p></article><form>")), learned) == want
    assert extract(page(body), {}) == want  # defaults alone


def test_class_words():
    from tessera.llm.html_extract import noisy
    for attr, want in (("class='ad'", True), ('class="post-comments x"', True), ("id=sidebar-left", True), ("class='grid no-sidebar'", False),
                       ("class='entry-header'", False), ("class='advice shadow'", False), ("role='navigation'", True)):
        assert noisy("div", attr) is want, attr
    assert not noisy("body", "class='sidebar'") and noisy("nav", "")


def test_edges(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "plain words", "x"), (4, "u", "<p>a<p>b", "x"),
            (5, "u", "<nav>unclosed <li>menu <article><p>kept text</article>", "x"), (6, "u", "<script>var a", "x"),
            (7, "u", "<p>5 < 6 & 7 > 2</p>", "x"), (8, "u", "<p>" + "long " * 50_000, "x"), (8, "u", "<!-- x", "x"),
            (9, "u", "<" * 5000 + "a" + "<p " * 2000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in extract_text(df).where("page_id <> 8 or n_chars > 0").collect()}
    assert got[1] == got[2] == got[6] == "" and got[None] == "plain words" and got[4] == "a b"
    assert got[5] == "kept text" and got[7] == "5 < 6 & 7 > 2" and len(got[8]) == 5 * 50_000 - 1
    assert extract_text(df).count() == len(rows)
    assert extract_text(df.where("false")).count() == 0


def test_no_article_is_lost_to_a_class_word():
    text = " ".join([WORDS] * 6)
    for attr in ("class='popular-science'", "class='legal-analysis'", "class='search-results-explained'", "id='comments'",
                 "class='sidebar'", "class='legal'"):
        body = f"<nav>menu words</nav><div {attr}><h1>Head</h1><p>{text}</p></div><footer>foot</footer>"
        assert extract(page(body), {}) == f"Head {text}", attr
    # nested frames, and a real sidebar beside the article
    body = f"<div class='widget'><div class='legal'><p>{text}</p></div></div><div class='sidebar'><p>side words</p></div>"
    assert extract(page(body), {}) == text


def test_region_is_the_best_of_all():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tessera.llm.html_extract import best_region

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.integers(-5, 5), max_size=12))
    def check(scores):
        start, end = best_region([float(x) for x in scores])
        every = [sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        assert sum(scores[start:end]) == max([0, *every])

    check()


def test_bad_markup_takes_linear_time():
    import time
    from tessera.llm.html_extract import page_runs

    def seconds(n, part):
        text = part * n
        return min(_timed(lambda: page_runs(text)) for _ in range(3))

    def _timed(f):
        t = time.perf_counter()
        f()
        return time.perf_counter() - t

    for part in ("</b>", "<b>", "<i><b>w</i>", "<p>x<span>", "<div class=ad>", "<td><p>"):
        assert seconds(16_000, part) < 12 * seconds(4_000, part) + 0.05, part


def test_deep_links_and_paragraphs():
    deep = "<a href=x>" + "<span>" * 9 + "linked words " * 9 + "</span>" * 9 + "</a>"
    from tessera.llm.html_extract import runs
    assert [r.key.split()[1] for r in runs(deep) if r.words] == ["link"]
    seq = [r for r in runs("<p>a<b><i><u><s>b<p>c<table><tr><td>d<p>e") if r.words]
    assert len({r.block for r in seq}) == 5 - 1  # a and b are one block
    assert extract(page("<p>" + WORDS + "<b><i><u><s>" + WORDS + "<p>" + WORDS), {}) == f"{WORDS}{WORDS} {WORDS}"
