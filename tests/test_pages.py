"""Links, article extraction and chunking on hand-made pages."""

import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quaero.functions import html as H
from quaero.functions.text import sentences, strip, token_count, tokens
from quaero.operators import chunk as C
from quaero.operators import links as L
from quaero.operators.extract import (
    SITE_RULES, Rule, apply_rule, extract_articles, extract_plain_articles, split_rejected,
)
from quaero.params import Params
from quaero.plans.corpus import build_corpus
from quaero.plans.frontier import url_frontier


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)],
                                 "page_id long, url string, html string")


LINKS = """<a href="/a/">a</a><a href="/a/">again</a><a href="https://x.org/b">b</a>
<a href="//cdn.org/c">c</a><a>no target</a><a href="#top">t</a><a class="k" href="/one.pdf">p</a>
<a href="/two.pdf">p</a><a href="/gallery/">g</a><a href="/go?to=http">h</a>
<script>'<a href="/fake/">'</script>"""


def test_links_follow_the_relative_link_rules(spark):
    df = pages(spark, ("https://s.org/sitemap/", LINKS), ("https://s.org/blog/", LINKS))
    got = {r.url for r in L.distinct_links(df).collect()}
    assert got == {"https://s.org/" + p for p in ("a/", "one.pdf", "two.pdf", "gallery/")}
    assert L.page_links(df).count() == 10


def test_frontier_drops_all_pdfs_and_blocked_pages(spark):
    df = pages(spark, ("https://s.org/sitemap/", LINKS))
    got = url_frontier(df, L.site_blocklist(spark, "https://s.org")).collect()
    assert [r.url for r in got] == ["https://s.org/a/"]
    assert url_frontier(df, base="https://t.org").count() == 2


def test_union_of_frontiers_is_a_set(spark):
    df = pages(spark, ("https://s.org/sitemap/", LINKS))
    urls = L.distinct_links(df)
    assert L.union_frontiers(urls, urls, urls).count() == 4


PAGE = """<html><body><div id="page"><main><article class="x"><h1>T</h1>
<div class="c-lower_links"><div>inner</div></div><p>keep<br>me</p><div id="opencampus">gone</div>
<script>var s = "</article>";</script><div class="p-work_books_article__body">
<div class="p-work_books__opencampus">gone</div><div><div class="p-work_books__opencampus">stays
</div></div></div></article><article>second</article></main></div></body></html>"""


def test_general_rule_cuts_nested_boilerplate():
    got = apply_rule(PAGE, SITE_RULES[0])
    assert got.startswith('<article class="x">') and got.endswith("</article>")
    assert "inner" not in got and "gone" not in got and "second" not in got
    assert "keep<br>me" in got and "stays" in got and 's = "</article>"' in got


def test_fallback_rules_by_url(spark):
    side = ('<div id="page"><div class="l-contents"><div class="l-main"><article>A'
            '<p class="p-different_course">1</p><p class="p-different_course">2</p>'
            '<p class="p-different_opencampus">3</p></article></div></div></div>')
    lead = ('<div id="page"><main><div class="p-opencampus_leading">L</div>'
            '<div class="p-myschool_point">M</div><div class="c-common_section">C</div>'
            '</main></div>')
    df = pages(spark, ("https://s/features/different/", side),
               ("https://s/features/strengths/", side), ("https://s/myschool/", lead),
               ("https://s/web_opencampus/", lead), ("https://s/other/", lead),
               ("https://s/plain/", PAGE))
    articles = extract_articles(df)
    got = {r.url[10:]: r.text for r in articles.collect()}
    assert got["features/different/"] == '<article>A<p class="p-different_course">2</p></article>'
    assert "1</p>" in got["features/strengths/"]
    assert re.sub("<[^>]*>", "", got["myschool/"]) == "LM"
    assert re.sub("<[^>]*>", "", got["web_opencampus/"]) == "LC"
    assert got["other/"] is None
    good, bad = split_rejected(articles)
    assert good.count() == 5 and [r.url for r in bad.collect()] == ["https://s/other/"]


def test_unclosed_tags_do_not_swallow_the_page():
    text = "<article><p><b>one<p>two</article><footer>x</footer>"
    assert apply_rule(text, Rule(".*", ("article",))) == "<article><p><b>one<p>two</article>"
    assert apply_rule("<main><article>open", Rule(".*", ("main > article",))) == "<article>open"
    assert apply_rule("<main></main>", Rule(".*", ("article",))) is None


def test_plain_extraction_ignores_decoys_and_resolves_entities(spark):
    html = ('<title>A &amp; B</title><script>"</article>"</script><!-- <article> --><article>'
            "<p>x &lt;y&gt;&nbsp;z<p>w &eacute; &#233; &amp;lt;</article>")
    df = extract_plain_articles(pages(spark, ("u", html), ("v", "<p>none</p>")))
    rows = {r.url: r for r in df.select(
        "url", "title", H.visible_text(H.decode_rare_entities("text")).alias("t")).collect()}
    assert rows["u"].title == "A & B"
    assert rows["u"].t == "x <y> z\nw é é &lt;"
    assert rows["v"].t is None


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


def h2_page(*sections, before=""):
    return "<article>" + before + "".join(f"<h2>{h}</h2><p>{b}</p>" for h, b in sections) + "</article>"


def chunks(spark, html, params=Params()):
    df = spark.createDataFrame([("u", "T", html)], "url string, title string, text string")
    return [(r.chunk_no, r.content, r.n_chunks, r.page_contents)
            for r in C.chunk_articles(df, params).orderBy("chunk_no").collect()]


def test_sections_keep_heading_body_and_text_before_the_first_heading(spark):
    html = h2_page(("One", "a"), ("Two", "b"), before="<p>intro</p>")
    df = spark.createDataFrame([(html,)], "text string")
    got = df.select(H.split_sections("text", "h2").alias("s")).first().s
    assert [(s.heading, s.body) for s in got] == [("", "intro"), ("One", "a"), ("Two", "b")]
    assert df.select(C.page_text(H.split_sections("text", "h2"))).first()[0] == "introab"


@pytest.mark.parametrize("second, expected", [(126, 1), (127, 2)])
def test_merge_limit_is_inclusive(spark, second, expected):
    # 128 + 1 heading + 126 + 1 heading = 256 tokens
    got = chunks(spark, h2_page(("h", words(128)), ("h", words(second))))
    assert len(got) == expected
    assert sum(len(re.findall(r"\w+", c[1])) for c in got) == 128 + second + 2


@pytest.mark.parametrize("n, expected", [(19, 0), (20, 1)])
def test_chunks_must_exceed_the_minimum(spark, n, expected):
    assert len(chunks(spark, h2_page(("h", words(n))))) == expected


def test_long_section_becomes_its_own_buffer_and_is_cut_with_overlap(spark):
    got = chunks(spark, h2_page(("a", words(30)), ("b", words(700)), ("c", words(40))))
    assert [c[0] for c in got] == list(range(1, len(got) + 1))
    assert got[0][1] == "a\n" + words(30)
    assert got[1][1].startswith("b\nw0 ")
    sizes = [len(re.findall(r"\w+", c[1])) for c in got]
    assert max(sizes) == 512 and sizes[2] == 701 - 512 + 50
    assert got[2][1].split()[:50] == got[1][1].split()[-50:]
    assert got[-1][1] == "c\n" + words(40)
    assert {c[3] for c in got} == {words(30) + words(700) + words(40)}


def test_merge_limit_and_split_size_are_separate(spark):
    html = h2_page(("a", words(30)), ("b", words(30)))
    assert len(chunks(spark, html, Params(merge_tokens=40))) == 2
    assert len(chunks(spark, html, Params(merge_tokens=256, chunk_tokens=40, overlap_tokens=0))) == 2


def test_tokens_count_each_cjk_character(spark):
    rows = [("AI入学2024年です", 2 + 2 + 2 + 1), ("プログラマとは?", 7), ("two words, 3", 3), ("", 0)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    assert [r[0] for r in df.select(token_count("t")).collect()] == [n for _, n in rows]
    assert df.select(tokens("t")).first()[0] == ["AI", "入", "学", "2024", "年", "で", "す"]


def test_tokens_are_the_same_by_script_for_every_character(spark):
    """The expression asks for plain letters first and for scripts where they can be; this is the plain definition."""
    cjk = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
    plain = F.lit(rf"[\p{{L}}\p{{N}}&&[^{cjk}]]+|[{cjk}]")
    c = F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')")
    texts = spark.range(0x110000).where("id < 55296 or id > 57343").select(F.concat(F.lit("aé"), c, c, F.lit("9")).alias("t"))
    assert texts.where(tokens("t") != F.regexp_extract_all("t", plain, F.lit(0))).count() == 0
    assert texts.where(token_count("t") != F.regexp_count("t", plain)).count() == 0


def test_strip_and_sentences(spark):
    df = spark.createDataFrame([(" 　\n a b \t",), ("..One. . two!? 三。四\n\n.five",)], "t string")
    assert df.select(strip("t")).first()[0] == "a b"
    assert df.select(sentences("t")).collect()[1][0] == ["One.", ".", "two!?", "三。", "四", "five"]


def split(spark, texts, size, overlap):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", C.recursive_split("t", size, overlap).alias("c")).collect()
    return {r.i: r.c for r in rows}


TOKEN = re.compile(r"[぀-ヿ一-鿿]|[^\W_぀-ヿ一-鿿]+")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1 .\n。日本"), max_size=120), min_size=20, max_size=20))
def test_recursive_split_is_whole_and_bounded(spark, texts):
    for i, got in split(spark, texts, 8, 3).items():
        assert all(len(TOKEN.findall(c)) <= 8 for c in got)
        squeezed = [re.sub(r"\s", "", c) for c in got]
        rest = re.sub(r"\s", "", texts[i])
        # Each chunk goes on where the one before it ended, at most with a repetition.
        at = 0
        for c in squeezed:
            start = rest.find(c, max(0, at - len(c)))
            assert 0 <= start <= at
            at = max(at, start + len(c))
        assert at == len(rest)


def test_fixed_windows_restore_the_token_list(spark):
    sizes = (0, 1, 50, 511, 512, 513, 974, 975, 2000)
    df = spark.createDataFrame([(n, words(n)) for n in sizes], "n int, t string")
    for r in df.select("n", C.fixed_windows("t", 512, 50).alias("w")).collect():
        joined = r.w[0] + [t for w in r.w[1:] for t in w[50:]]
        assert joined == words(r.n).split()
        assert all(len(w) <= 512 for w in r.w)


def test_corpus_puts_context_on_page_chunks_only(spark):
    df = pages(spark, ("u", "<title>Title</title>" + h2_page(("a", words(300)), ("b", words(30)))),
               ("v", "no article"))
    custom = spark.createDataFrame([("", "custom text", "")],
                                   "url string, content string, page_contents string")
    rules = (Rule(".*", ("article",)),)
    rows = build_corpus(df, rules, custom=custom.union(custom)).orderBy("url", "chunk_no").collect()
    assert [(r.url, r.chunk_no) for r in rows] == [("", 0), ("u", 1), ("u", 2)]
    assert rows[0].content == "custom text"
    assert rows[1].content.startswith("Title › a › part 1 of 2: w0 w1")
    assert rows[2].content.endswith("\n\nb\n" + words(30))
    assert len({r.id for r in rows}) == 3
    again = {r.id for r in build_corpus(df, None, custom=custom).collect()}
    assert again == {r.id for r in rows}
