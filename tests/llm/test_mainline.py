import random

import numpy as np
import pytest

from quaero.llm import mainline
from quaero.llm.mainline import LineParams, article_lines, main_text

from samples import prose

PAGES = "page_id long, url string, html string"


def paragraphs(seed, n=8):
    r = random.Random(seed)
    return [prose(seed * 100 + i, r.choice((1, 2, 30, 60, 90))) + "." for i in range(n - 1)] + [prose(seed, 40) + "."]


def layouts(title, body):
    """One article in many pages; what must come out is the title and the paragraphs."""
    ps = "".join(f"<p>{p}</p>" for p in body)
    loose = "".join(f"<p><b>{p}<br>" for p in body)
    menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in "home news about contact".split())
    note = "We keep small files in your browser to make this site work, as described in our long policy."
    talk = "".join(f"<div><p>{prose(900 + i, 25)}</p></div>" for i in range(4))
    return {
        "semantic": f"<html><head><title>x</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul>{menu}</ul></nav>"
                    f"<!-- ad --><div class='ad'>{note}</div><article><h1>{title}</h1>{ps}</article><footer>&copy; {note}</footer></body></html>",
        "unclosed": f"<body><nav><ul>{menu}</ul></nav><div class=ad>{note}</div><article><h1>{title}</h1>{loose}</article><footer>&copy; {note}",
        "advert inside": f"<body><main><h1>{title}</h1><p>{body[0]}</p><div class='ad-box'>{note}</div>"
                         + "".join(f"<p>{p}</p>" for p in body[1:]) + f"<form><p>{note}</p><input></form></main></body>",
        "named parts": f"<body><div id='site-header'>{note}</div><div class='menu'>{menu}</div><div class='cookie-notice'>{note}</div>"
                       f"<div class='post has-sidebar'><h1>{title}</h1>{ps}</div><div id=sidebar><p>{note}</p></div>"
                       f"<section class='comments'><article>{talk}</article></section><div class=\"siteFooter\">{note}</div></body>",
        "bare": f"<body><ul>{menu}</ul><div><div><h1>{title}</h1>{ps}</div></div><ul>{menu}</ul><div><div>{'short line'}</div></div></body>",
        "menu never closed": f"<body><nav><ul>{menu}</ul><article><h1>{title}</h1>{ps}</article></body>",
        "remarks": f"<body><article><h1>{title}</h1>{ps}</article><article class='comment'><p>{note}</p></article><aside>{note}</aside></body>",
        "own header": f"<body><header>{note}</header><article><header><h1><a href='/x'>{title}</a></h1></header>{ps}</article></body>",
        "shouting": f"<BODY><NAV>{menu}</NAV><ARTICLE><H1>{title}</H1>{ps.upper().replace('<P>', '<P CLASS=x>')}</ARTICLE></BODY>",
    }


@pytest.mark.parametrize("seed", range(4))
def test_every_layout_gives_the_article_whole(seed):
    title, body = prose(seed + 50, 9), paragraphs(seed)
    want = " ".join([title, *body])
    for name, page in layouts(title, body).items():
        assert main_text(page) == (want if name != "shouting" else " ".join([title, *(p.upper() for p in body)])), name


def test_text_of_a_line():
    long = prose(1, 40)
    assert main_text(f"<p>a &amp;&amp; b &lt;i&gt; &#233;&eacute;\n\t c&nbsp;d <b>e</b>f {long}</p>") == f"a && b <i> éé c d ef {long}"
    assert main_text(f"<p>1 < 2 and 3 > 2 {long}<p>x<br/>y") == f"1 < 2 and 3 > 2 {long} x y"
    assert main_text("<p title=\"a > b\">" + long) == long
    assert main_text("no markup at all") == "no markup at all"
    assert main_text("<p>tiny</p>") == "tiny"
    for none in (None, "", " \n", "<script>x</script>", "<nav><p>" + long + "</p></nav>", "<", "<p", "<!-- " + long):
        assert main_text(none) in ("", none and none.strip())


def brute_article_lines(lengths, p):
    """Windows summed one by one."""
    n, w = len(lengths), p.window
    get = lambda i: lengths[i] if 0 <= i < n else 0
    gap = set()
    for start in range(1 - w, n):
        if not any(get(start + k) for k in range(w)):
            gap |= {start + k for k in range(w)}
    runs, run = [], []
    for i in range(n + 1):
        if i < n and i not in gap:
            run.append(i)
        elif run:
            runs.append(run)
            run = []
    mass = [sum(lengths[i] for i in r) for r in runs]
    peak = [max(sum(get(s + k) for k in range(w)) for s in range(r[0] - w + 1, r[-1] + 1)) for r in runs]
    some = [i for i in range(len(runs)) if peak[i] >= p.surge and mass[i] >= p.share * max(mass)]
    if runs and not some:
        some = [mass.index(max(mass))]
    return {i for s in some for i in runs[s]} if any(lengths) else set()


def test_surges_and_dives_match_windows_summed_one_by_one():
    r = random.Random(4)
    for _ in range(400):
        lengths = [r.choice((0, 0, 0, 5, 30, 90, 400)) for _ in range(r.randint(0, 25))]
        p = LineParams(window=r.randint(1, 4))
        assert set(np.flatnonzero(article_lines(np.array(lengths, np.int64), p)).tolist()) == brute_article_lines(lengths, p)


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    body = prose(3, 200_000)
    rows = [(1, "u", f"<article><p>{prose(2, 50)}</p></article>"), (1, "u", f"<article><p>{prose(2, 50)}</p></article>"),
            (2, None, None), (None, "v", ""), (3, "w", f"<body><p>{body}</p></body>"), (4, "x", "<nav><a href='/'>a</a></nav>")]
    pages = spark.createDataFrame(rows, PAGES).select("*", *[F.lit("z").alias(c) for c in ("key", "text", "n_chars", "page")])
    want = [(1, "u", prose(2, 50))] * 2 + [(2, None, ""), (None, "v", ""), (3, "w", body), (4, "x", "")]
    got = mainline.extract_articles(pages).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text) for r in got)
    assert mainline.extract_articles(spark.createDataFrame([], PAGES)).count() == 0
