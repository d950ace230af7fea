"""The whole chunkers against plain loops over each document, written from the rules."""

import math

import pytest
import regex

from tarnflow.operators import chunks as C
from tarnflow.operators import lines as L
from tarnflow.operators import retrieval as R
from tarnflow.sources.adapters import view


def hits(patterns, s, flags=""):
    return any(regex.search(flags + p, s) for p in patterns)


def clean(text):
    found = regex.findall(r"!\[[^\]]*\]\(([^)]+)\)", text) + regex.findall(r"(?i)(https?://[^\s)]+\.(?:png|jpg|jpeg|gif|webp|svg))", text)
    text = regex.sub(r"(?i)(https?://[^\s)]+\.(?:png|jpg|jpeg|gif|webp|svg))", "", regex.sub(r"!\[[^\]]*\]\(([^)]+)\)", "", text))
    text = regex.sub(r"(?i)\[UPLOAD_FAILED[^\]]*\]|\[\s*image:\s*\d+[^\]]*\]", "", text)
    return text.strip(), sorted({u for u in found if u.startswith("http") and "UPLOAD_FAILED" not in u})


def merge(lines, stops):
    out = []
    before = None
    for line in lines:
        s = line.strip()
        if s and before and before[-1] not in stops and s[0] != s[0].upper():
            out[-1] = out[-1].rstrip(" ") + " " + s
        else:
            out.append(line)
        before = s
    return out


def upper(s):
    return s == s.upper() and s != s.lower()


def capital(w):
    return w[0] == w[0].upper() and w[0] != w[0].lower()


def light_heading(s, following):
    if not s or len(s) > 100 or (". " in s and len(s) > 50):
        return False
    return hits(L.HEADINGS_LIGHT, s) or (upper(s) and 3 <= len(s) <= 60) or (len(s) < 40 and capital(s) and s[-1] not in ".!?,;:" and len(following) > len(s))


def universal_heading(s, following):
    if len(s) < 2:
        return False
    words = s.split()
    title = len(s) < 60 and s[-1] not in ".,;:!?" and capital(s) and len(words) >= 2 and sum(map(capital, words)) >= len(words) * 0.6 and following != ""
    return s.startswith("#") or (upper(s) and len(s) >= 3 and " " in s) or bool(regex.search(r"^(\d+\.)+\s+[A-Z]", s)) or bool(regex.search(r"^[A-Z]\.\d+\s+", s)) or title


def sections(lines, rule):
    out, heading, body = [], None, []
    for i, line in enumerate(lines):
        if rule(line.strip(), lines[i + 1].strip() if i + 1 < len(lines) else ""):
            out.append((heading, "\n".join(body).strip()))
            heading, body = line.strip(), []
        else:
            body.append(line)
    return [*out, (heading, "\n".join(body).strip())]


def sentences(text):
    out = []
    for p in (p.strip() for p in regex.split(r"\n\s*\n", text)):
        out += p.split("\n") if regex.search(r"(?m)^\s*(?:[•\-*■●]|\d+\.)\s", p) else regex.split(r"(?<=[.!?])\s+(?=[A-Z])", p)
    return [s.strip() for s in out if s.strip()]


def tokens(s):
    return math.floor(len(s.split()) * 13 / 10)


def light(text):
    text, _ = clean(regex.sub(r"\r\n?", "\n", text))
    lines = [regex.sub(r"[ \t]+", " ", x) for x in text.split("\n") if not x.strip() or not hits(L.NOISE_LIGHT, x.strip(), "(?i)")]
    found = [(h, c if h is None else f"{h}\n\n{c}") for h, c in sections(merge(lines, ".!?:;)"), light_heading) if len(c) >= 5]
    packed = []
    for heading, content in found:
        if tokens(content) <= 600:
            packed.append((heading, content))
            continue
        parts = [[]]
        for s in sentences(content):
            if parts[-1] and sum(map(tokens, parts[-1])) + tokens(s) > 350:
                parts.append(parts[-1][-2:])
            parts[-1].append(s)
        packed += [(heading if not i or heading is None else f"{heading} (continued)", "\n".join(p)) for i, p in enumerate(parts)]
    out = []
    for heading, content in packed:
        if out and tokens(content) < 80 and tokens(out[-1][1]) + tokens(content) <= 600:
            out[-1] = (out[-1][0], f"{out[-1][1]}\n\n{content}")
        else:
            out.append((heading, content))
    return out


def foreign(line):
    low = line.lower()
    return sum(w for w, patterns in L.FOREIGN.items() for p in patterns if regex.search(p, low)) > 3


def universal(text):
    text, images = clean(text)
    kept, inside = [], False
    for line in text.split("\n"):
        s = line.strip()
        if len(s) >= 3 and foreign(line):
            continue
        if s and hits(L.CONTENTS, s):
            inside = True
        elif s and ((upper(s) and len(s) > 3) or regex.search(r"^\d+\.\s+[A-Z]", s) or s.startswith("#")):
            inside = False
        toc = "..." in s or ". . ." in s or regex.search(r"^.{5,50}\s{3,}\d{1,4}\s*$", s) or (regex.search(r"^[A-Za-z].+\s+\d{1,3}\s*$", s) and len(s) < 80)
        if not s or not (inside or hits(L.NOISE, s) or toc):
            kept.append(regex.sub(" +", " ", line))
    lines = []
    for s in (x.strip() for x in merge(kept, ".!?:;")):
        junk = s and (hits(L.JUNK, s) or (regex.search(r"^[\d\s\-\(\)]+$", s) and len(s) < 15))
        if not junk and (s or (lines and lines[-1])):
            lines.append(s)
    lines = [regex.sub(r"(?i)\burl:\s*", "", s) for s in lines]
    found = [(h, c) for h, c in sections(lines, universal_heading) if c]
    if len(found) <= 1:
        paragraphs = [p.strip() for p in regex.split(r"\n\s*\n", "\n".join(lines)) if p.strip()]
        found = [(None, "\n\n".join(paragraphs[i : i + 4])) for i in range(0, len(paragraphs), 4)]
    units = []
    for h, c in found:
        name = None if h is None else regex.sub("^#+", "", h).strip()
        noisy = name is None or len(name) < 3 or regex.search(r"(?i)^(?:Page$|Page\s+\d+|\(Illustration\s+#?\d+\)|Illustration\s+#?\d+|Figure\s+#?\d+$|Table\s+#?\d+$|English Original Instructions|Original Instructions)", name)
        if len(c) >= 10:
            units.append([None if noisy else name, c, images if not units else []])
    sized = []
    for h, c, pictures in units:
        if len(c) // 4 <= 700:
            sized.append([h, c, pictures])
            continue
        parts = [[]]
        for p in (p.strip() for p in regex.split(r"\n\s*\n", c) if p.strip()):
            if parts[-1] and sum(len(x) // 4 for x in parts[-1]) + len(p) // 4 > 700:
                parts.append([])
            parts[-1].append(p)
        sized += [[h, "\n\n".join(p), pictures if not i else []] for i, p in enumerate(parts)]
    while True:
        out, i = [], 0
        while i < len(sized):
            h, c, pictures = sized[i]
            n = len(c) // 4
            if n < 80 and i + 1 < len(sized) and (sized[i + 1][0] == h or (n < 40 and len(sized[i + 1][1]) // 4 < 80)):
                out.append([h, f"{c}\n\n{sized[i + 1][1]}", sorted({*pictures, *sized[i + 1][2]})])
                i += 2
            elif n < 80 and out and (out[-1][0] == h or n < 40):
                out[-1] = [out[-1][0], f"{out[-1][1]}\n\n{c}", sorted({*out[-1][2], *pictures})]
                i += 1
            else:
                out.append([h, c, pictures])
                i += 1
        if len(out) == len(sized):
            break
        sized = out
    done = []
    for i, (h, c, pictures) in enumerate(sized):
        if i:
            head, before = sized[i - 1][:2]
            n = int(len(before) // 4 * 0.15)
            if n > 0 and len(before) > n * 4:
                tail = before[-n * 4 :]
                stop, space = tail.find(". "), tail.find(" ")
                if 0 <= stop < len(tail) // 2 and stop + 2 < len(tail):
                    tail = tail[stop + 2 :]
                elif 0 < space < len(tail) // 3:
                    tail = tail[space + 1 :]
                if tail.strip():
                    c = f"{tail.strip()}\n\n{c}"
                    h = f"Continued: {head}" if (h is None and head is not None) or (h is not None and h == head) else h
        done.append((h, c, tuple(pictures)))
    return done


@pytest.mark.parametrize("name", ["v_sources", "v_manuals"])
def test_light(spark, sf_dir, name):
    key = "source_id" if name == "v_sources" else "doc_id"
    docs = view(spark, sf_dir, name)
    got = {}
    for r in C.chunk_documents(docs, id_col=key).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.heading, r.content))
        assert r.token_count == tokens(r.content)
    for r in docs.collect():
        assert got.get(r[key], []) == light(r.raw_content), r[key]


def test_universal(spark, sf_dir):
    docs = view(spark, sf_dir, "v_manuals")
    extra = [(-1, "Plain words of a first paragraph here.\n\nA second one follows it now.\n\nThird words.\n\nFourth words.\n\nFifth words stand for themselves, all alone.\n![x](http://h.example/a.png) http://h.example/b.JPG"), (-2, "# First title\n" + "Words of one very long text that goes on. " * 200 + "\n\n" + "More words for this to be split apart. " * 200 + "\n# Page 4\nShort words.\n# Other Name\nShort as well."), (-3, "")]
    docs = docs.select("doc_id", "raw_content").unionByName(spark.createDataFrame(extra, "doc_id long, raw_content string"))
    got = {}
    for r in C.chunk_documents(docs, "universal").orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.heading, r.content, tuple(r.image_urls)))
    for r in docs.collect():
        assert got.get(r.doc_id, []) == universal(r.raw_content), r.doc_id
    assert got[-1][0][2] == ("http://h.example/a.png", "http://h.example/b.JPG") and len(got[-2]) > 1


def test_no_shuffle(spark, sf_dir):
    for mode in ("light", "universal", "final"):
        plan = C.chunk_documents(view(spark, sf_dir, "v_manuals"), mode)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan


def test_top_k_in_small_blocks_with_ties(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK_VECTORS", 3)
    vectors = [(i, i // 5, [float(i % 4 + 1), 1.0]) for i in range(40)]
    chunks = spark.createDataFrame(vectors, "chunk_id long, source_id long, embedding array<float>").repartition(3)
    sources = spark.createDataFrame([(i, None if i % 2 else 7) for i in range(8)], "source_id long, user_id long")
    queries = spark.createDataFrame([(1, 7, [1.0, 1.0]), (2, 9, [4.0, 1.0]), (2, 9, [4.0, 1.0]), (3, 7, None)], "query_id long, user_id long, embedding array<float>")
    got = {}
    for r in R.cosine_top_k(queries.dropDuplicates(["query_id"]), chunks, sources, 4, 0.9).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.chunk_id
    assert got[1] == {1: 0, 2: 4, 3: 8, 4: 12}
    assert got[2] == dict(enumerate([i for i in range(40) if i % 4 == 3 and i // 5 % 2][:4], 1))
