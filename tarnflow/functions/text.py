"""Column functions on text: counts, signals, headings, images, links and titles. All built-in, none looks at other rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and patterns of the manuals' and guides' markup.
IMAGE = r"!\[[^\]]*\]\(([^)]+)\)"
IMAGE_URL = r"(?i)(https?://[^\s)]+\.(?:png|jpg|jpeg|gif|webp|svg))"
NOISY_HEADING = r"(?i)^(?:Page$|Page\s+\d+|\(Illustration\s+#?\d+\)|Illustration\s+#?\d+|Figure\s+#?\d+$|Table\s+#?\d+$|English Original Instructions|Original Instructions)"
LINK_OF_THREE = r"\[[^|\]]+\|[^|\]]*\|([^|\]]+)\]"
NAMESPACE_URL = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
#: All characters of Unicode white space.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def either(patterns: list[str], flags: str = "") -> str:
    """One pattern for any of ``patterns``."""
    return "|".join(f"(?:{flags}{p})" for p in patterns)


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def token_estimate(c: Column, mode: str = "chars4") -> Column:
    """``chars4``: a quarter of the characters; ``words13``: 1.3 for a word, rounded down; ``words``."""
    if mode == "chars4":
        return F.floor(F.length(F.coalesce(c, F.lit(""))) / 4).cast("int")
    n = word_count(c)
    return F.floor(n * 13 / 10).cast("int") if mode == "words13" else n


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def _count_of(text: Column, kind: str) -> Column:
    """Characters of a kind: what is gone when its runs are, which is faster than a match for each."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{kind}+", ""))


def content_signals(c: Column, image_urls: Column) -> Column:
    """Words, sentences, shares of letters and digits, share of lines in columns, and whether there are images."""
    in_columns = lambda x: x.rlike(r"\S+\s{3,}\S+\s{3,}\S+") | x.contains("\t") | x.contains("|")

    def counted(text: Column) -> Column:
        return F.struct(
            word_count(text).alias("n"), F.length(text).alias("chars"), F.regexp_count(text, F.lit(r"[.!?]+")).alias("ends"), _count_of(text, r"\p{L}").alias("letters"),
            _count_of(text, r"\p{Nd}").alias("digits"), let(F.split(text, "\n"), lambda x: F.struct(F.size(x).alias("all"), F.size(F.filter(x, in_columns)).alias("columns"))).alias("lines"),
        )

    def shares(m: Column) -> Column:
        share = lambda k: F.when(m["chars"] > 0, m[k] / m["chars"]).otherwise(F.lit(0.0))
        return F.struct(
            m["n"].alias("word_count"), F.when((m["ends"] == 0) & (m["n"] > 0), F.lit(1)).otherwise(m["ends"]).alias("sentence_count"), share("letters").alias("alpha_ratio"), share("digits").alias("numeric_ratio"),
            F.when(m["lines"]["all"] < 2, F.lit(0.0)).otherwise(m["lines"]["columns"] / m["lines"]["all"]).alias("table_density"), (F.size(image_urls) > 0).alias("has_images"),
        )

    return let(let(F.coalesce(c, F.lit("")), counted), shares)


def content_type(signals: Column, c: Column) -> Column:
    """The first rule that fits: image_only, table, reference, narrative, else reference."""

    def kind(x: Column) -> Column:
        s, low = x["s"], x["low"]
        dated = low.contains("issue") & low.rlike(r"\d{4}") & (s["word_count"] < 50)
        reference = (s["numeric_ratio"] > 0.3) | low.contains("...") | low.contains(". . .") | dated | low.contains("copyright") | low.contains("©") | ((s["word_count"] < 30) & (s["sentence_count"] < 2)) | (s["alpha_ratio"] < 0.5)
        narrative = (s["sentence_count"] >= 2) & (s["alpha_ratio"] >= 0.65) & (s["numeric_ratio"] <= 0.3)
        return F.when(s["has_images"] & (s["word_count"] < 20), "image_only").when(s["table_density"] >= 0.4, "table").when(reference, "reference").when(narrative, "narrative").otherwise("reference")

    return let(F.struct(signals.alias("s"), F.lower(c).alias("low")), kind)


def should_embed(signals: Column, kind: Column) -> Column:
    def judged(x: Column) -> Column:
        s = x["s"]
        prose = (s["sentence_count"] >= 2) & (s["alpha_ratio"] >= 0.6) & (s["numeric_ratio"] <= 0.4)
        long = (s["word_count"] >= 50) & (s["alpha_ratio"] >= 0.7) & (s["sentence_count"] >= 1)
        return ~x["kind"].isin("table", "reference", "image_only") & (s["word_count"] >= 20) & (prose | long)

    return let(F.struct(signals.alias("s"), kind.alias("kind")), judged)


def content_type_light(c: Column) -> Column:
    lines = F.filter(F.split(c, "\n"), lambda x: strip(x) != "")
    bullets = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[•\-*■●]")))
    many = (F.regexp_count(c, F.lit(r"\|")) > 5) | (F.regexp_count(c, F.lit("\t")) > 5)
    digits = _count_of(c, r"\p{Nd}") > 0.3 * F.length(c)
    return F.when(many, "table").when((F.size(lines) > 0) & (bullets > 0.5 * F.size(lines)), "list").when(digits, "reference").otherwise("narrative")


def is_table_block(c: Column) -> Column:
    """Whether a block of lines is a flattened table: a header and numbers, one-word lines, or a number in every third line."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")
    number = lambda x: x.rlike(r"^[\d.,%\-+/ ]+$")
    n = F.size(lines)
    numbers = F.size(F.filter(lines, number))
    header = F.size(F.filter(F.slice(lines, 1, 5), lambda x: x.rlike(r"(?i)\b(?:item|qty|quantity|part|description|no|number|unit|price|total)\b"))) >= 2
    single = F.size(F.filter(lines, lambda x: ~x.rlike(r"\s")))
    at = F.slice(F.filter(F.transform(lines, lambda x, i: F.when(number(x), i)), lambda i: i.isNotNull()), 1, 3)
    third = (F.size(at) == 3) & F.forall(at, lambda i: i % 3 == 2) & (n >= 6)
    return (n >= 4) & ((header & (numbers >= 0.3 * n)) | (single >= 0.6 * n) | third)


def heading_level(size: Column) -> Column:
    return F.when(size >= 18, "# ").when(size >= 14, "## ").when(size >= 12, "### ").otherwise("")


def image_urls(c: Column) -> Column:
    """Distinct http image links of a text in order; failed uploads don't count."""
    found = F.concat(F.regexp_extract_all(c, F.lit(IMAGE), F.lit(1)), F.regexp_extract_all(c, F.lit(IMAGE_URL), F.lit(1)))
    return F.array_sort(F.array_distinct(F.filter(found, lambda u: u.startswith("http") & ~u.contains("UPLOAD_FAILED"))))


def without_images(c: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(c, IMAGE, ""), IMAGE_URL, "")
    return strip(F.regexp_replace(text, r"(?i)\[UPLOAD_FAILED[^\]]*\]|\[\s*image:\s*\d+[^\]]*\]", ""))


def normalize_heading(h: Column) -> Column:
    name = strip(F.regexp_replace(strip(h), r"^#+", ""))
    return F.when(name.rlike(NOISY_HEADING) | (F.length(name) < 3), F.lit(None)).otherwise(name)


def display_heading(heading: Column, body: Column) -> Column:
    """``Step N`` gives way to the first line of the body that says something."""
    lines = F.transform(F.split(body, "\n"), strip)
    said = F.filter(F.transform(F.filter(lines, lambda x: (x != "") & ~x.startswith(">")), lambda x: F.regexp_replace(x, r"^[-*•]\s*", "")), lambda x: x != "")
    return F.when(heading.rlike(r"(?i)^step\s*\d+$"), F.coalesce(F.left(F.get(said, F.lit(0)), F.lit(80)), heading)).otherwise(heading)


def clean_guide_body(c: Column) -> Column:
    lines = F.array_join(F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n")
    return strip(F.regexp_replace(F.regexp_replace(lines, LINK_OF_THREE, "$1"), r"\n{3,}", "\n\n"))


def normalize_whitespace(c: Column, mode: str = "universal") -> Column:
    if mode == "query":
        return strip(F.regexp_replace(c, r"(?U)\s+", " "))
    if mode == "light":
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[ \t]+", " "), r"\n{4,}", "\n\n\n")
    return F.regexp_replace(F.regexp_replace(c, r"\n\s*\n\s*\n+", "\n\n"), r" +", " ")


def prepare_embedding_text(content: Column, heading: Column, has_steps: Column, has_table: Column) -> Column:
    prefix = F.concat(F.when(heading.isNotNull(), F.concat(F.lit("[Section: "), heading, F.lit("] "))).otherwise(""), F.when(has_steps, "[Procedure/Instructions] ").otherwise(""), F.when(has_table, "[Table/Data] ").otherwise(""))
    return F.concat(prefix, normalize_whitespace(content, "query"))


def split_sentences(c: Column) -> Column:
    """Paragraphs; lists by line, others after an end mark that a capital follows."""
    paragraphs = F.filter(F.transform(F.split(c, r"\n\s*\n"), strip), lambda p: p != "")
    is_list = lambda p: p.rlike(r"(?m)^\s*(?:[•\-*■●]|\d+\.)\s")
    parts = lambda p: F.when(is_list(p), F.split(p, "\n")).otherwise(F.split(p, r"(?<=[.!?])\s+(?=[A-Z])"))
    return F.filter(F.transform(F.flatten(F.transform(paragraphs, parts)), strip), lambda s: s != "")


def normalize_url(c: Column, base: str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(None)).when(c.startswith("/") & ~c.startswith("//"), F.concat(F.lit(base), c)).otherwise(c)


def split_manufacturer(title: Column) -> Column:
    return F.struct(F.when(title.contains(" "), F.split(title, " ")[0]).alias("manufacturer"), title.alias("model_number"))


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """The version-5 UUID of a name: the same on every run and task."""
    h = F.lower(F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8"))))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def sanitize_vector(v: Column, dims: int) -> Column:
    """Components that aren't finite become 0; a vector of another size is null."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(F.size(v) == dims, F.transform(v, lambda x: F.when(bad(x), F.lit(0.0).cast("float")).otherwise(x)))


def vector_literal(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def mock_embedding(c: Column, dims: int = 1536) -> Column:
    """``((md5 of the text as a number + i) mod 1000) / 1000``; 16 hexadecimal digits at a time."""
    h = F.md5(c)
    high, low = F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)"), F.conv(F.substring(h, 17, 16), 16, 10).cast("decimal(20,0)")
    base = ((high % 1000) * (2**64 % 1000) + low % 1000) % 1000
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: ((base.cast("int") + i) % 1000) / 1000.0)


def fallback_title(c: Column, has_images: Column, limit: int = 50) -> Column:
    text = F.trim(F.coalesce(c, F.lit("")))
    kept = limit if limit == 50 else limit - 3
    return F.when(text == "", F.when(has_images, "Image Analysis").otherwise("New Chat")).when(F.length(text) > limit, F.concat(F.left(text, F.lit(kept)), F.lit("..."))).otherwise(text)


def prefix_document_title(content: Column, identifier: Column) -> Column:
    return F.when(F.coalesce(identifier, F.lit("")) == "", content).otherwise(F.concat(F.lit("[Document: "), identifier, F.lit("]\n\n"), content))
