import html
import re

from seqspark.llm import html_text, queries
from seqspark.llm.html_text import Page

SCHEMA = "page_id long, url string, html string, text string, host string, n_pages int"


def text(source, templates=()):
    return Page(source).text(frozenset(templates))


def test_markup():
    assert text("") == "" and text("plain  &amp; text") == "plain & text"
    assert text("<article><h1>A</h1><p><b>one\n two<br><p>th<i>re</i>e</p></article>") == "A one two three"
    assert text('<body><nav>menu</nav><header>top</header><article>x<script>var a="</p>";</script><!-- c --><div class="comments"><p>reader</p></div>y</article><footer>f</footer>') == "x y"
    assert text("<article>a<ul><li>b<li>c</ul>d</article>") == "a b c d"
    assert text('<article>1 < 2 <a href="x>y">z</a> &eacute;&#233;</article>') == "1 < 2 z éé"
    assert text("<article>a</b>c<p>d</article>tail") == "ac d"
    assert text("<main><p>m</p></main><p>n</p>") == "m"
    assert text("<body><ul><li><a href=a>x</a></li><li><a href=b>y</a></li></ul><p>body text here</p></body>") == "body text here"
    assert text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"
    assert text("<article>open <b>tag <i unclosed") == "open tag <i unclosed"


def test_all_articles_and_blocks_that_only_look_like_a_menu():
    assert text("<body><article>one</article><div class=related>r</div><article>two <article>three</article></article></body>") == "one two three"
    assert text('<article><div class="search-results">found</div><p class="notice">cookies</p><section class="related">more</section>x</article>') == "found more x"
    assert text('<main><div class="search-results">found</div>x</main>') == "x"


def test_templates_by_recurrence(spark):
    page = lambda i, extra="": f'<html><body><div><p>Same line on the site</p><span>x</span></div><p>own text {i}</p>{extra}</body></html>'
    art = lambda i: f"<article><div><div>Share this page</div></div><p>Shared passage</p><p>story {i}</p></article>"
    rows = [(i, "http://a.example/x", page(i)) for i in range(12)] + [(100 + i, "https://u@B.example?q", art(i)) for i in range(9)]
    rows += [(200, "http://c.example", page(1)), (201, None, None), (202, "http://a.example/y", ""), (202, "http://a.example/y", "")]
    df = spark.createDataFrame([(*r, "t", "h", 1) for r in rows], SCHEMA)
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got[3] == "own text 3" and got[104] == "Shared passage story 4"
    assert got[200] == "Same line on the site x own text 1" and got[201] == "" and got[202] == ""
    assert html_text.extract(df).count() == len(rows) and html_text.extract(df.limit(0)).count() == 0


def test_query_against_the_articles(spark):
    sf = "/root/testdata/sf0.01"
    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op4_html_text(spark, sf).collect()
    assert len(got) == len(source)
    for r in got:
        inner = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", re.sub(r"</?b>", "", inner))).split()) and r.n_chars == len(r.text)
