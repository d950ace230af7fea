"""Operator 10: main text of web pages by a site style tree.

Each page is read once into blocks of text, each with its style path (the tags, ids and classes of the block elements
that hold it). The pages of a host are merged into a tree of these paths by grouped aggregation. A branch's content
importance is the entropy of its texts over the host's pages, its presentation importance the entropy of the child
sequences of the element that holds it, both scaled to 0..1. The tree also gives a branch's share of text inside links,
its share of the host's text and its text a page. These and priors from the markup add up to its worth, and branches
without worth are removed from each page, inside articles too.

The priors: text inside an article or main element that holds the page's text is worth most, text outside it least, since a
host's menus and adverts may differ on every page, which entropy alone takes for content. How far an article is the page's is
its share of the page's text outside named elements, averaged over the pages of a branch: where articles are but teasers
beside the text, they lose what the text gains. No element is kept or dropped for being inside or outside of one alone. An
element whose class or id is wholly made of words for menus, adverts and the like (``cookie-notice``) is taken for one unless most of the host's text
lies in it; a single such word among others (``share-price``) only lowers its worth, so links or repetition decide.
Elements that are no text of the page by tag, role or ``hidden`` (scripts, forms, navigation ...) go outright. Where all
pages of a host hold copies of one article, repetition inside articles says nothing and isn't counted; nor is it for a
plain heading, paragraph or item inside an article.

Defined results: a null or empty html gives the empty text and 0 characters; a null url is a host of its own; repeated
rows each give a row; broken markup is read as browsers do in the main (implied and missing end tags); an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import is_small, map_arrow, materialize, table, text_bytes

#: A branch's repetition counts where at least so many pages have it, below this importance, and inside articles if at least
#: this share of the host's articles differ.
MIN_PAGES, LOW_IMPORTANCE, MIN_VARIETY = 8, 0.4, 0.5
#: Weight of content against presentation.
CONTENT_WEIGHT = 0.9
#: What a branch is worth: inside an article that holds all of the page's text, on pages without one, outside of such an
#: article, inside one that holds nearly none of it; by its names (some, all of a class or id); what it loses when wholly
#: inside links and when alike on all pages; what it gains from holding all of the host's text, if that is so many
#: characters a page. Below 0 it is removed.
IN_ARTICLE, NO_ARTICLE, OUTSIDE, TEASER = 1.0, 0.5, -2.0, -0.3
SOME_NAME, ALL_NAMES, ALL_LINKS, ALL_ALIKE, ALL_TEXT, LONG_TEXT = -0.45, -1.5, -0.6, -1.2, 1.7, 1000
#: Low branches, 8 bytes each, and their hosts that a broadcast may hold: 12 MB at most. More are joined by a shuffle, with so many
#: pages of a host in a task.
BROADCAST_BRANCHES, BROADCAST_HOSTS, HOST_PAGES = 1_000_000, 50_000, 2_000

# Elements by their role in HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe template svg math select object xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_NEVER = frozenset("aside button dialog footer form head menu nav".split())
_ENDS_P = _BLOCK - {"br", "body", "html", "head", "caption", "legend", "td", "th", "tr", "tbody", "thead", "tfoot"}
_ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}
_HOLDS = frozenset("ul ol menu dir dl table tbody thead tfoot div section article main body".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_NAMES = frozenset(
    "nav navbar navigation menu menubar header masthead footer sidebar aside ad ads adv advert adverts advertisement adbox banner sponsor sponsored promo "
    "cookie cookies consent notice notices popup modal overlay newsletter subscribe signup login breadcrumb breadcrumbs pagination pager "
    "comment comments respond replies disqus share sharing social related recommended widget toolbar search".split()
)
_CONTENT_NAMES = frozenset("article content main post entry story body text".split())
_PLAIN_NAMES = frozenset("area bar block bottom box btn button buttons center col column container desktop group inner item items left link links list mobile outer page panel right row section site slot social space top unit user wrap wrapper".split())
#: Text of an article's own headings, paragraphs, lists and tables, without any container or style of its own.
_PLAIN_PATH = r"/(?:article|main)[^/]*(?:/(?:section|ul|ol|dl|table|tbody|tr|h[1-6]|p|li|dt|dd|td|th|blockquote|pre|figure|figcaption))*$"

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NUMBER, _LONG_NUMBER = re.compile(r"\d+"), re.compile(r"\d{3,}")
_HOST = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")

ARTICLE, OTHER = 1, 2
PLAIN, SOME, ALL, OUTRIGHT = 0, 1, 2, 3


def _named(value: str) -> int:
    """How far the words of a class or id name what is no main text: in no part, one among others, or a whole token."""
    found = PLAIN
    for token in value.split():
        words = {w for w in re.split(r"[-_]+", token) if w and not w.isdigit()}
        if words & _NAMES and not words & _CONTENT_NAMES:
            found = max(found, ALL if words <= _NAMES | _PLAIN_NAMES else SOME)
    return found


def _judge(tag: str, rest: str, in_article: bool) -> tuple[str, int]:
    """The style of an element, and how far its markup says that it is no main text."""
    style, named = tag, OUTRIGHT if tag in _NEVER or (tag == "header" and not in_article) else PLAIN
    if "=" in rest or "hidden" in rest:
        for name, *values in _ATTRIBUTE.findall(rest):
            value, name = "".join(values).strip().lower(), name.lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in _ROLES):
                named = OUTRIGHT
            elif name in ("class", "id") and value:
                style += "." + ".".join(sorted(_LONG_NUMBER.sub("", value).split())) if name == "class" else "#" + _NUMBER.sub("", value)  # post-123 is one style for all posts
                if tag not in ("body", "html", "article", "main"):
                    named = max(named, _named(value))
    return style, named


def _end_of(page: str, tag: str, at: int) -> int | None:
    """Where the element ``tag`` that is open at ``at`` ends, with those of its name that it holds; None if it doesn't."""
    depth = 1
    for found in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        depth += -1 if found[1] else 0 if found[0].endswith("/>") else 1
        if not depth:
            return found.end()
    return None


def read_page(page: str) -> list[tuple[str, int, int, int, int, str]]:
    """Blocks ``(path, kind, named, children, links, text)`` of a page in order.

    ``children`` stands for the sequence of tags that the holding element has, ``links`` is the number of characters inside links.
    """
    stack: list[list] = [["#page", "", PLAIN, False, [0]]]  # tag, path, named, in article, children
    blocks: list[tuple] = []
    pieces: list[str] = []
    linked = [0, False]  # characters inside links of this block, and whether a link is open

    def flush() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                _, path, named, article, children = stack[-1]
                blocks.append((path, ARTICLE if article else OTHER, named, children, min(linked[0], len(text)), text))
            linked[0] = 0

    def add(text: str) -> None:
        pieces.append(text)
        if linked[1]:
            linked[0] += len(text.strip())

    def close(at: int) -> None:
        flush()
        del stack[at:]

    at, length = 0, len(page)
    while at < length:
        found = _TOKEN.search(page, at)
        if found is None:
            add(page[at:])
            break
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        tag = found["tag"]
        if tag is None:
            if found["cdata"]:
                add(found["cdata"].replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if found["end"]:
            if tag == "a":
                linked[1] = False
            if tag in _BLOCK:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
                    if tag in ("p", "li", "dt", "dd") and stack[i][0] in _HOLDS:
                        break
                flush()
            continue
        if tag in _RAW and not found["rest"].endswith("/"):
            end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(page, at)
            at = length if end is None else page.find(">", end.start()) + 1 or length
            if tag in ("title", "textarea", "xmp"):
                flush()
            continue
        if tag not in _BLOCK:
            if tag == "button" or (tag not in _VOID and ("=" in found["rest"] or "hidden" in found["rest"]) and not found["rest"].endswith("/") and _judge(tag, found["rest"], True)[1] >= ALL):
                at = _end_of(page, tag, at) or at  # an inline element that is no main text: its text goes, up to its own end
            elif tag == "a":
                linked[1] = not found["rest"].endswith("/")
            continue
        flush()
        if tag in _ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in _HOLDS:
                    break
        for other in _ENDED_BY.get(tag, ()):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == other:
                    close(i)
                    break
                if stack[i][0] in _HOLDS and not (tag in ("td", "th") and stack[i][0] == "tr"):
                    break
        parent = stack[-1]
        parent[4][0] = (parent[4][0] * 1_000_003 + zlib.crc32(tag.encode())) % (1 << 61)
        if tag in _VOID:
            continue
        style, named = _judge(tag, found["rest"], parent[3])
        stack.append([tag, f"{parent[1]}/{style}", max(named, parent[2]), parent[3] or tag in ("article", "main"), [0]])
    flush()
    return [(path, kind, named, children[0], links, text) for path, kind, named, children, links, text in blocks]


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower().removeprefix("www.") if found else ""


_FIELDS = ("path", "kind", "named", "children", "links", "text")
_SCHEMA = "page_id long, url string, host string, has_article boolean, blocks array<struct<path:string,kind:int,named:int,children:long,links:int,text:string>>"
_BLOCKS = pa.list_(pa.struct(list(zip(_FIELDS, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string()), strict=True))))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        urls = batch.column(1).to_pylist()
        rows, held, start = [], 0, 0
        for i, page in enumerate(batch.column(2)):
            rows.append([dict(zip(_FIELDS, b, strict=True)) for b in read_page(str(page.as_py() or b"", "utf-8", "replace"))])
            held += len(page.as_py() or b"")
            if held > 4_000_000 or i + 1 == len(urls):
                end = i + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, end - start),
                        batch.column(1).slice(start, end - start),
                        pa.array([host_of(u) for u in urls[start:end]], pa.string()),
                        pa.array([any(b["kind"] == ARTICLE and b["named"] < OUTRIGHT for b in r) for r in rows], pa.bool_()),
                        pa.array(rows, _BLOCKS),
                    ],
                    names=["page_id", "url", "host", "has_article", "blocks"],
                )
                rows, held, start = [], 0, end


def parse_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_bytes(html_col).alias("html"))
    return map_arrow(source, _parsed, _SCHEMA)


def _scaled_entropy(of: str) -> F.Column:
    """Entropy of the counts ``of`` over the log of their sum: 0 all alike, 1 all different."""
    n = F.sum(of)
    return F.when(n > 1, 1 - F.sum(F.col(of) * F.log(of)) / (n * F.log(n))).otherwise(F.lit(1.0))


def style_tree(parsed: DataFrame) -> DataFrame:
    """``(host, path, pages, content, presentation, importance, in_article, held, named, links, share, length)`` of each node that
    holds text; ``held`` is the share of its pages' text that articles hold, null where no page has one."""
    said = lambda b: (b["named"] < ALL)
    size = lambda rule: F.aggregate(F.filter("blocks", rule), F.lit(0), lambda n, b: n + F.length(b["text"]))
    article = size(lambda b: said(b) & (b["kind"] == ARTICLE)) / F.greatest(size(said), F.lit(1))
    rows = parsed.withColumn("held", F.when(F.col("has_article"), article)).select("host", "page_id", "held", F.explode("blocks").alias("b")).filter(F.col("b.named") < OUTRIGHT)
    rows = rows.select("host", "page_id", "held", "b.path", F.xxhash64("b.text").alias("text"), "b.children", (F.col("b.kind") == ARTICLE).alias("in_article"), "b.named", "b.links", F.length("b.text").alias("chars"))
    of_page = rows.groupBy("host", "path", "page_id").agg(F.max("in_article").alias("in_article"), F.max("named").alias("named"), F.sum("links").alias("links"), F.sum("chars").alias("chars"), F.max("held").alias("held"))
    pages = of_page.groupBy("host", "path").agg(F.count("*").alias("pages"), F.max("in_article").alias("in_article"), F.avg("held").alias("held"), F.max("named").alias("named"), (F.sum("links") / F.sum("chars")).alias("links"), F.sum("chars").alias("chars"))
    whole = pages.groupBy("host").agg(F.sum("chars").alias("whole"))
    content = rows.groupBy("host", "path", "text").agg(F.count("*").cast("double").alias("n")).groupBy("host", "path").agg(_scaled_entropy("n").alias("content"))
    style = rows.groupBy("host", "path", "children").agg(F.count("*").cast("double").alias("n")).groupBy("host", "path").agg(_scaled_entropy("n").alias("presentation"))
    node = pages.join(content, ["host", "path"]).join(style, ["host", "path"]).join(whole, "host")
    node = node.withColumn("importance", CONTENT_WEIGHT * F.col("content") + (1 - CONTENT_WEIGHT) * F.col("presentation"))
    return node.withColumn("share", F.col("chars") / F.col("whole")).withColumn("length", F.col("chars") / F.col("pages"))


def worth(tree: DataFrame) -> DataFrame:
    """``tree`` (with the ``variety`` of its host's articles) and what each branch is worth."""
    between = lambda high, low: F.col("held") * high + (1 - F.col("held")) * low
    place = F.when(F.col("held").isNull(), NO_ARTICLE).when(F.col("in_article"), between(IN_ARTICLE, TEASER)).otherwise(between(OUTSIDE, NO_ARTICLE))
    name = F.when(F.col("named") == ALL, ALL_NAMES).when(F.col("named") == SOME, SOME_NAME).otherwise(0.0)
    plain = F.col("path").rlike(_PLAIN_PATH)
    counts = (F.col("pages") >= MIN_PAGES) & (~F.col("in_article") | (~plain & (F.coalesce("variety", F.lit(1.0)) >= MIN_VARIETY)))
    alike = F.when(counts, F.greatest(F.lit(0.0), 1 - F.col("importance") / LOW_IMPORTANCE)).otherwise(0.0)
    mass = F.greatest(F.lit(0.0), 2 * F.col("share") - 1) * F.least(F.lit(1.0), F.col("length") / LONG_TEXT)
    return tree.withColumn("worth", place + name + ALL_LINKS * F.col("links") + ALL_ALIKE * alike + ALL_TEXT * mass)


def low_paths(parsed: DataFrame) -> DataFrame:
    """``(host, path)`` of the branches that are removed from a host's pages."""
    own = lambda b: (b["kind"] == ARTICLE) & (b["named"] < ALL)
    variety = parsed.filter("has_article").select("host", F.xxhash64(F.to_json(F.filter("blocks", own).getField("text"))).alias("article"))
    variety = variety.groupBy("host", "article").agg(F.count("*").alias("n")).groupBy("host").agg((F.count("*") / F.sum("n")).alias("variety"))
    return worth(style_tree(parsed).join(variety, "host", "left")).filter(F.col("worth") < 0).select("host", "path")


def low_branches(parsed: DataFrame) -> DataFrame:
    """``(host, low, n)``: hashes of the removed paths of each host that has such paths, and their number."""
    low = low_paths(parsed).groupBy("host").agg(F.collect_set(F.xxhash64("path")).alias("low"))  # a host's templates: styles without numbers, not pages
    return low.withColumn("n", F.size("low"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` -> ``(page_id, url, text, n_chars)``, a row for each page."""
    parsed = materialize(parse_pages(pages, id_col, url_col, html_col), "parsed")
    low = materialize(low_branches(parsed), "low")
    size = low.agg(F.count("*").alias("hosts"), F.coalesce(F.sum("n"), F.lit(0)).alias("branches")).first()
    if size["hosts"] <= BROADCAST_HOSTS and size["branches"] <= BROADCAST_BRANCHES:
        joined = parsed.join(F.broadcast(low), "host", "left")
    else:
        parts = parsed.groupBy("host").agg(F.ceil(F.count("*") / HOST_PAGES).cast("int").alias("parts")).filter("parts > 1")
        large = F.broadcast(parts) if is_small(parts, BROADCAST_HOSTS) else parts
        place = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
        dealt = low.join(large, "host", "left").select("host", "low", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        joined = parsed.join(large, "host", "left").select("*", place).join(dealt, ["host", "part"], "left")
    main = lambda b: (b["named"] < OUTRIGHT) & ~F.coalesce(F.array_contains("low", F.xxhash64(b["path"])), F.lit(False))
    text = F.array_join(F.filter("blocks", main).getField("text"), " ")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op10_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_text(table(spark, sf_dir, "pages"))


#: The same text for pages with one plain article and the named references that occur in the tables.
_ORACLE = """
SELECT page_id, url, text, length(text) AS n_chars FROM (
  SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(
    regexp_extract(coalesce(html, ''), '<article>((?s:.*))</article>', 1), '</?(?:p|br|h[1-6]|li|ul|ol|div|section|td|tr|table)(?:\\s[^>]*)?>', ' ', 'g'), '<[^>]*>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&#39;', chr(39)), '&middot;', '·'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages)
"""

QUERIES = {"op10_site_style": op10_site_style}
ORACLES = {"op10_site_style": _ORACLE}
