import html
import re

from pyspark.sql import functions as F

from tarnflow.llm import site_style
from tests.oracle import assert_same


def text_of(page):
    """The page alone, elements named as no main text left out."""
    blocks = [b for b in site_style.read_page(page) if b[2] < site_style.ALL]
    want = site_style.ARTICLE if any(b[1] == site_style.ARTICLE for b in blocks) else site_style.OTHER
    return " ".join(b[5] for b in blocks if b[1] == want)


def extracted(spark, pages):
    rows = [(i, url, page) for i, (url, page) in enumerate(pages)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    return [r.text for r in sorted(site_style.extract_text(table).collect(), key=lambda r: r.page_id)]


def brute(page):
    """For the tables' pages: the one article, tags cut away."""
    body = page[page.index("<article>") + 9 : page.index("</article>")]
    body = re.sub(r"</?(?:p|br|h1|li|ul|div)[^>]*>", " ", body)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", body)).split())


def test_registered_query(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    want = {r.page_id: (r.url, brute(r.html)) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = site_style.op10_site_style(spark, sf_dir).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r.url, r.text) == want[r.page_id]
        assert r.n_chars == len(r.text)


def test_markup():
    assert text_of("<p>a<b>b</b>c<p>d &amp; e<br>f&#233;<!-- x --><script>if (a<b) '</p>'</script>g") == "abc d & e fég"
    assert text_of("<article><p>in<p class=ad>out</p>side</article><p>after") == "in side"
    assert text_of("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>") == "a b 1 2 3"
    assert text_of("<div role=navigation>x</div><div id='cookie-notice'>x</div><main><h1>T</h1><div class='comments'><p>no</p></div>yes</main><footer>f") == "T yes"
    assert text_of("plain < text & more") == "plain < text & more"
    assert text_of("<title>t</title><form><p>x</p></form><header>h</header>body") == "body"
    assert text_of("") == ""
    assert text_of("<article><p title='a > b'>x&nbsp;y</p></article") == "x y"
    assert text_of("<p>one<span hidden>no</span> two</div></p></b>three") == "one two three"
    assert text_of("<a href='x'>a</a><style>p{}</style><textarea>x</textarea>b") == "a b"


def test_tree_removes_templates(spark):
    """Without any naming, a block that is the same on all pages of a host goes; what differs stays."""
    page = "<body><div class=q1>Buy this now</div><div class=q2>text {0} of page {0}</div><p>more {0}</p></body>"
    rows = [(i, f"http://www.a.example/{i}", page.format(i), 1) for i in range(20)] + [(100, "http://b.example/", page.format("b"), 1)]
    copies = "<body><article><h1 class=t>Same title</h1><p>same text</p></article></body>"
    rows += [(200 + i, "http://c.example/x", copies, 1) for i in range(20)]
    inside = "<body><article><div class=k>Read our other pages</div><p>story {0}</p></article></body>"
    rows += [(300 + i, f"//d.example:80/{i}", inside.format(i), 1) for i in range(20)]
    rows += [(400, None, None, 1), (401, "http://a.example/z", "", 1), (None, "x", "<p>y", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = {r.page_id: r.text for r in site_style.extract_text(pages).collect()}
    assert got[3] == "text 3 of page 3 more 3"
    assert got[100] == "Buy this now text b of page b more b"
    assert got[205] == "Same title same text"
    assert got[307] == "story 7"
    assert (got[400], got[401], got[None]) == ("", "", "y")


def test_names_are_only_priors(spark):
    """One word of a class doesn't drop an element; a class that is nothing but such words does, unless it holds the page."""
    kept = '<article><p class="share-price">price text</p><section class="related-work">work</section><div id="search-algorithms">search text</div></article>'
    advert = '<article><p>one <span class="ad">x <span>y</span> ADVERT TAIL</span> two</p><div class="ad-box"><div>deep</div> advert</div><button>b <b>c</b></button></article>'
    shared = '<article><p>text</p><div class="share-this"><a href="a">on that</a> <a href="b">and this</a></div><div class="share-price">price</div></article>'
    page = "<body><div class=sidebar>" + "<p>a long story of this page</p>" * 60 + '</div><div class="cookie-notice">we use cookies</div><p>a <a href="x">word</a> here</p></body>'
    got = extracted(spark, [("http://a.example/", kept), ("http://b.example/", advert), ("http://c.example/", shared), ("http://d.example/", page), ("http://e.example/", '<div class="ad">advert alone</div><footer>f</footer>')])
    assert got == ["price text work search text", "one two", "text price", " ".join(["a long story of this page"] * 60 + ["a word here"]), ""]


def test_unnamed_templates_without_article(spark):
    """Menus that differ by page are links, a footer is alike on all pages; the stories stay, also repeated links in them."""
    page = "<body><div class=m><ul>{links}</ul></div><div class=c><h1>Title {0}</h1><p>Story {0} tells of {0} and <a href=s>more</a> at length.</p></div><div class=z>All rights reserved by the house</div></body>"
    links = lambda i: "".join(f"<li><a href='/{i}/{j}'>Topic {i * 7 + j}</a></li>" for j in range(6))
    got = extracted(spark, [(f"https://news.example/{i}", page.format(i, links=links(i))) for i in range(12)])
    assert got == [f"Title {i} Story {i} tells of {i} and more at length." for i in range(12)]


def test_templates_inside_articles(spark):
    """A container that is alike in all articles of a host goes, plain headings that recur stay."""
    page = "<article><h2>Summary</h2><p>Text {0} of {0}.</p><div><p>Written by our house</p></div><aside>x</aside></article>"
    assert extracted(spark, [(f"https://h.example/{i}", page.format(i)) for i in range(10)]) == [f"Summary Text {i} of {i}." for i in range(10)]


def test_child_sequences_are_whole():
    """Elements that differ only in their first of many children are told apart."""
    of = lambda first: {b[3] for b in site_style.read_page(f"<div><{first}>a</{first}>" + "<p>b</p>" * 40 + "end</div>") if b[0] == "/div"}
    assert len(of("p") | of("h3")) == 2 and of("p") == of("p")


def test_branches_that_the_tree_removes_on_the_tables(spark, sf_dir):
    """The tables' pages with all names of menus, adverts, footers and articles taken out of their markup: the menus go."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    bare = F.regexp_replace(F.regexp_replace("html", "<(/?)(?:nav|article|footer)>", "<$1div>"), '<div class="ad">', "<div>")
    parsed = site_style.parse_pages(pages.withColumn("html", bare))
    assert parsed.filter("has_article").count() == 0
    low = {(r.host, r.path) for r in site_style.low_paths(parsed).collect()}
    hosts = {r.host for r in parsed.select("host").distinct().collect()}
    assert hosts and all((host, "/html/body/div/ul/li") in low for host in hosts)
    rows = {r.page_id: r.text for r in site_style.extract_text(pages.withColumn("html", bare)).collect()}
    for r in pages.collect():
        assert brute(r.html) in rows[r.page_id]  # nothing of any article goes


def test_an_article_beside_the_text_is_a_teaser(spark):
    """Where the page's text lies outside its article, the text stays and the teaser goes, on one page or on a host of such pages."""
    long = "A long main text that goes on for a while about {0}. " * 8
    page = '<div id="content"><h1>Heading {0}</h1><p>' + long + '</p></div><article class="teaser"><p>Read next</p></article>'
    story = "<article><h1>Story {0}</h1><p>" + long + "</p></article><div class=x><p>Short words beside {0}</p></div>"
    rows = [("http://one.example/", page.format("it"))] + [(f"http://many.example/{i}", page.format(i)) for i in range(12)] + [(f"http://story.example/{i}", story.format(i)) for i in range(12)]
    got = extracted(spark, rows)
    assert got[0] == "Heading it " + long.format("it").strip()
    assert got[1:13] == [f"Heading {i} " + long.format(i).strip() for i in range(12)]
    assert got[13:] == [f"Story {i} " + long.format(i).strip() for i in range(12)]


def test_numbers_in_names_make_no_style(spark):
    """An id of its own on each page is one branch for all, so that templates under it are seen as such."""
    page = '<body><div id="post-{0}"><p>text {0} of {0}</p><div class="k-100{0}">The same on all pages</div></div></body>'
    rows = [(f"http://a.example/{i}", page.format(i)) for i in range(12)]
    assert len({b[0] for _, html in rows for b in site_style.read_page(html)}) == 2
    assert extracted(spark, rows) == [f"text {i} of {i}" for i in range(12)]


def test_large_hosts_beyond_a_broadcast(spark, monkeypatch):
    page = "<body><div class=q1>Buy this now</div><div class=q2>text {0} of page {0}</div></body>"
    rows = [(f"http://a.example/{i}", page.format(i)) for i in range(40)] + [("http://b.example/", page.format("b"))] + [(None, "<p>alone")]
    want = extracted(spark, rows)
    assert want[7] == "text 7 of page 7" and want[40:] == ["Buy this now text b of page b", "alone"]
    for hosts, branches in ((0, 10), (1, 0)):
        monkeypatch.setattr(site_style, "BROADCAST_HOSTS", hosts)
        monkeypatch.setattr(site_style, "BROADCAST_BRANCHES", branches)
        monkeypatch.setattr(site_style, "HOST_PAGES", 3)
        assert extracted(spark, rows) == want


def test_empty_table(spark):
    assert site_style.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_long_page():
    page = "<article>" + "<p>word one</p>" * 50_000 + "<div>" * 2000 + "deep" + "</article>"
    assert text_of(page) == "word one " * 50_000 + "deep"


def test_oracle(spark, sf_dir):
    assert_same(site_style.op10_site_style(spark, sf_dir), site_style.ORACLES["op10_site_style"], sf_dir)
