"""Main text of pages: real tables against a cut at their known markup, pages by hand, held-out layouts."""
import html
import re

import duckdb
import numpy as np
import pytest

from wardline.llm import blocks as scan
from wardline.llm import html_text

LONG = "The council met on Tuesday evening to discuss the new bridge, which has been closed since the storm of last winter."
LONGER = LONG + " Engineers said that repairs would take at least eight months, and that traffic would be led over the old road."
ARTICLE = ["Bridge stays closed", LONG, "Why?", LONGER, "Costs", "Two million euros.", "One more line here", LONG + " End."]


def article(wrap="p"):
    h, a, b, c, h2, d, e, f = ARTICLE
    return f"<h1>{h}</h1><p>{a}</p><p>{b}</p><p>{c}</p><h2>{h2}</h2><ul><li>{d}</li><li>{e}</li></ul><p>{f}</p>"


MENU = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in ("Home", "World", "Sports", "Opinion and Letters", "Contact"))
PAGES = {
    "semantic": f"<!doctype html><html><head><title>T | Site</title><style>p{{}}</style></head><body><header><h1>Daily Site</h1><p>News you can use every single day of the year</p></header><nav><ul>{MENU}</ul></nav>"
                f"<main><article><header>{article()[:28]}</header>{article()[28:]}<aside><p>{LONG}</p></aside><div class='share-buttons'>Share this</div></article><section id=comments><h2>2 Comments</h2><article><p>{LONGER}</p></article></section></main>"
                f"<aside><h3>Related</h3><p>{LONG}</p></aside><footer><p>© 2024 Daily Site. {LONG}</p></footer></body></html>",
    "classes": f"<body class='has-sidebar no-nav'><div class=topbar><a href=/>Login</a></div><div id=siteHeader><div>Daily Site</div></div><div class='mainMenu'><ul>{MENU}</ul></div>"
               f"<div class='page with-sidebar'><div class='col'><div class='entry-content post'>{article()}<div class=advertisement><p>{LONG}</p></div></div>"
               f"<div class='commentlist'><div class=comment-body><p>{LONGER}</p></div></div></div><div class='sidebar'><p>{LONG}</p></div></div><div class='cookieBanner'><p>{LONG}</p></div>"
               f"<form class=x action=/s><p>{LONG}</p><input type=text value=q><button>Send it now please</button></form></body>",
    "wrapped form": f"<form id=aspnetForm><div id=nav><ul>{MENU}</ul></div><article>{article()}</article><div role=contentinfo>{LONG}</div></form>",
    "roles": f"<div role=banner><p>{LONG}</p></div><div role=navigation><ul>{MENU}</ul></div><div role=main>{article()}</div><div role=complementary><p>{LONG}</p></div><div role=alert><p>{LONG}</p></div>",
    "main": f"<div class=banner>{LONG}</div><main id=content>{article()}<section class='reader-comments'><p>{LONGER}</p></section></main><div>Imprint</div>",
    "hidden": f"<article>{article()}<p hidden>{LONG}</p><div style='display: none'><p>{LONG}</p></div><template><p>{LONG}</p></template><noscript><p>{LONG}</p></noscript><svg><text>x</text></svg><iframe src=x>{LONG}</iframe></article>",
    "title of comments": f"<article>{article()}<h3>Comments (3)</h3><div><p>{LONGER}</p></div><p>{LONG}</p></article>",
}


@pytest.fixture(scope="module")
def tree():
    return html_text.fit(*html_text.labelled(html_text.labelled_pages()))


def text_of(tree, page):
    found = scan.blocks(page)
    return "\n".join(b.text for b, k in zip(found, tree.keeps(html_text.features([found]))) if k)


@pytest.mark.parametrize("name", PAGES)
def test_pages(tree, name):
    assert text_of(tree, PAGES[name]) == "\n".join(ARTICLE)


def test_unmarked_page(tree):
    page = (f"<body><div>Daily Site</div><ul>{MENU}</ul><h1>Bridge stays closed</h1><p>{LONG}</p><p>{LONGER}</p><p>{LONG}</p>"
            f"<ul>{MENU}</ul><div>Copyright 2024</div></body>")
    assert text_of(tree, page) == "\n".join(["Bridge stays closed", LONG, LONGER, LONG])


def test_markup(tree):
    def article_text(s):
        return text_of(tree, f"<nav>{MENU}</nav><article>{s}</article><footer>x</footer>")

    assert article_text("<p>a&nbsp;&amp;&lt;p&gt; &#233;&#x1F600;&eacute &amp;amp;</p>") == "a &<p> é😀é &amp;"
    assert article_text("<p>a<b>b</b>c <i>d</i>\n\t e<br>f<br/>g</p>") == "abc d e f g"
    assert article_text("<p>one<p>two<div>three</div>four<li>five<li>six") == "one\ntwo\nthree\nfour\nfive\nsix"
    assert article_text("<table><tr><td>a b<td>c<tr><th>d</table>") == "a b\nc\nd"
    assert article_text("<p>1 < 2 and 3 > 2 <3 </p><!-- <p>no</p> --><!--><p>yes</p><!doctype x><?php no ?></ no><p>end") == "1 < 2 and 3 > 2 <3\nyes\nend"
    assert article_text('<p title="a > b" data-x=\'<p>\' class=it\'s>in</p><P CLASS=X>OUT</P>') == "in\nOUT"
    assert article_text("<script>if (a < b) document.write('<p>no</p>')</script><p>yes</p><STYLE>p{}</Style >ok") == "yes\nok"
    assert article_text("<p>open <a href=x>link</p><p>after</p>") == "open link\nafter"
    assert article_text("<b><p>bold</b> rest</p>") == "bold rest"
    assert article_text("<p>kept</p><!-- never closed <p>no</p>") == "kept"
    assert article_text("<p>kept</p><a href='x") == "kept"
    assert article_text("<p>日本語の記事です</p><p>　ok </p>") == "日本語の記事です\nok"
    assert scan.blocks("") == scan.blocks("  \n<p></p>") == scan.blocks("<") [:0]
    assert [b.text for b in scan.blocks("plain only")] == ["plain only"]


@pytest.mark.parametrize("piece", ["<div>", "<p>", "<b>", "<a href=x>", "<li>", "<!--", "<a b='", '="', "</div>", "<div><p><table><td>", "&", "<h1>", "<form><h1>", "<header>", "<x-y>", "</b>", "<article class=comment>", "< ", "<script>"])
def test_linear_time(piece):
    """Broken and deep markup costs time in proportion to its length."""
    import time

    def cost(n):
        t = time.process_time()
        scan.blocks(piece * n + "<p>x")
        return time.process_time() - t

    cost(200)
    assert cost(20_000) < max(0.3, 40 * cost(2_000))


def known(page):
    """The article of a page of the tables, whose only markup inside it is h1, p, b and br."""
    inner = page[page.index("<article>") + 9:page.index("</article>")]
    parts = (" ".join(html.unescape(x.replace("<b>", "").replace("<br>", " ")).split()) for x in re.split("</?p>|</?h1>", inner))
    return "\n".join(x for x in parts if x)


def test_tables(spark):
    folder = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{folder}/pages.parquet'").fetchall()
    want = {i: (u, known(h), len(known(h))) for i, u, h in rows}
    got = html_text.extract(spark.read.parquet(f"{folder}/pages.parquet")).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want and len(got) == len(rows)


def test_rows(spark, tree):
    rows = [(1, "u", PAGES["semantic"]), (1, "u", PAGES["semantic"]), (2, None, None), (None, "v", ""), (3, "w", "<nav>x</nav>"),
            (4, "x", "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>")]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, n_chars int, text string").repartition(2)
    got = sorted((str(r[0]), r[2], r[3]) for r in html_text.extract(df, tree).collect())
    want = ["\n".join(ARTICLE)] * 2 + ["", "", "", "\n".join([LONG] * 20_000)]
    assert got == sorted((str(r[0]), w, len(w)) for r, w in zip(rows, want))
    assert html_text.extract(df.where("page_id > 9"), tree).count() == 0


def test_held_out_layouts(tree):
    x, y = html_text.labelled(html_text.labelled_pages(300, 99))
    assert (tree.keeps(x) == (y > 0.5)).mean() > 0.99


def test_tree_against_all_splits():
    """Every split is the best of all (feature, cut) pairs, by a plain search."""
    rng = np.random.RandomState(4)
    x = rng.randint(0, 6, (120, 4)).astype(float)
    y = ((x[:, 0] + 2 * x[:, 2] + rng.randint(0, 4, 120)) > 9).astype(float)
    tree = html_text.fit(x, y, depth=4, least=3)

    def gini(v):
        return 2 * v.mean() * (1 - v.mean())

    def check(node, rows):
        if tree.feature[node] < 0:
            return
        best = min((len(a) * gini(y[a]) + len(b) * gini(y[b])) / len(rows)
                   for f in range(4) for c in np.unique(x[rows, f]) for go in [x[rows, f] <= c] for a, b in [(rows[go], rows[~go])] if min(len(a), len(b)) >= 3)
        go = x[rows, tree.feature[node]] <= tree.cut[node]
        a, b = rows[go], rows[~go]
        assert abs((len(a) * gini(y[a]) + len(b) * gini(y[b])) / len(rows) - best) < 1e-9
        check(tree.left[node], a)
        check(tree.right[node], b)

    check(0, np.arange(120))
    assert tree.feature[0] >= 0
    leaves = [tree.share[0]] * len(x)
    for i, row in enumerate(x):
        node = 0
        while tree.feature[node] >= 0:
            node = tree.left[node] if row[tree.feature[node]] <= tree.cut[node] else tree.right[node]
        leaves[i] = tree.share[node]
    assert (tree.keeps(x) == (np.array(leaves) > 0.5)).all()
