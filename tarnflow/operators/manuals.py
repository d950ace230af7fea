"""Sections of extracted manuals, a document at a time: the line rules of ``lines`` with compiled patterns, for the chunkers.

The line operators say these rules over tables of lines and over arrays; here they run in the same Arrow pass that packs the
sections, as the patterns of a line are many and an interpreted expression for each is slow. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

from ..functions import text as T
from . import lines as L
from .pieces import Piece


def _any(patterns: Iterable[str], flags: str = "") -> Callable[[str], re.Match | None]:
    """One search for any of ``patterns``; their flags stand in front, which is where Python wants them."""
    parts = [f"(?{p[2:4].strip(')')}:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for p in patterns]
    return re.compile("|".join(parts), re.I if flags else 0).search


def _words(patterns: list[str]) -> list[str]:
    """Borders of words as Python has them; one border before all patterns that begin with one, as most places have none."""
    plain = [p.replace(L._E, r"(?:$|\W)") for p in patterns]
    inner = "|".join(p.removeprefix(L._B) for p in plain if p.startswith(L._B))
    return [rf"(?:^|\W)(?:{inner})"] * bool(inner) + [p for p in plain if not p.startswith(L._B)]


_noise, _noise_light, _junk, _contents, _light = _any(L.NOISE), _any(L.NOISE_LIGHT, "i"), _any(L.JUNK), _any(L.CONTENTS), _any(L.HEADINGS_LIGHT)
_foreign, _some_foreign, _weak = _any(_words(L.FOREIGN[5])), _any(_words(L.FOREIGN[3])), [_any(_words([p])) for p in L.FOREIGN[3]]
_contents_line = _any([r"\.\.\.", r"\. \. \.", r"^.{5,50}\s{3,}\d{1,4}\s*$"])
_ends_in_number = re.compile(r"^[A-Za-z].+\s+\d{1,3}\s*$").search
_few_digits = re.compile(r"^[\d\s\-()]+$").search
_numbered, _numbered_deep = re.compile(r"^\d+\.\s+[A-Z]").search, _any([r"^(?:\d+\.)+\s+[A-Z]", r"^[A-Z]\.\d+\s+"])
_image, _image_url = re.compile(T.IMAGE), re.compile(T.IMAGE_URL)
_broken_image = re.compile(r"(?i)\[UPLOAD_FAILED[^\]]*\]|\[\s*image:\s*\d+[^\]]*\]")
_noisy_heading = re.compile(T.NOISY_HEADING).search
_url_mark, _spaces, _blanks, _paragraph = re.compile(L.URL_MARK), re.compile(" +"), re.compile(r"[ \t]+"), re.compile(r"\n\s*\n")


def is_foreign(line: str) -> bool:
    low = line.lower()
    return bool(_foreign(low)) or (bool(_some_foreign(low)) and sum(1 for p in _weak if p(low)) > 1)


def is_upper(s: str) -> bool:
    return s == s.upper() and s != s.lower()


def starts_capital(s: str) -> bool:
    return s[0] == s[0].upper() and s[0] != s[0].lower()


def without_images(text: str) -> str:
    return _broken_image.sub("", _image_url.sub("", _image.sub("", text))).strip()


def image_urls(text: str) -> tuple[str, ...]:
    return tuple(sorted({u for u in _image.findall(text) + _image_url.findall(text) if u.startswith("http") and "UPLOAD_FAILED" not in u}))


def outside_contents(lines: Iterable[str]) -> Iterator[str]:
    """Lines outside of contents sections that aren't noise; blank ones stay."""
    inside = False
    for line in lines:
        s = line.strip()
        if not s:
            yield line
            continue
        if _contents(s):
            inside = True
        elif s[0] == "#" or (len(s) > 3 and is_upper(s)) or _numbered(s):
            inside = False
        if not (inside or _noise(s) or _contents_line(s) or (len(s) < 80 and _ends_in_number(s))):
            yield line


def unwrapped(lines: Iterable[str], stops: str) -> list[str]:
    """A line that begins in lower case goes to the end of one that isn't blank and doesn't end in one of ``stops``."""
    out: list[list[str]] = []
    before = ""
    for line in lines:
        s = line.strip()
        if s and before and before[-1] not in stops and s[0] != s[0].upper():
            out[-1][-1] = out[-1][-1].rstrip(" ")
            out[-1].append(s)
        else:
            out.append([line])
        before = s
    return [" ".join(parts) for parts in out]


def without_junk(lines: Iterable[str]) -> list[str]:
    """Stripped lines without junk; at most one blank in a row, none at the beginning."""
    out: list[str] = []
    for s in map(str.strip, lines):
        if s:
            if not (_junk(s) or (len(s) < 15 and _few_digits(s))):
                out.append(s)
        elif out and out[-1]:
            out.append(s)
    return [_url_mark.sub("", s) for s in out]


def is_light_heading(s: str, following: str) -> bool:
    if not s or len(s) > 100 or (len(s) > 50 and ". " in s):
        return False
    short = len(s) < 40 and len(following) > len(s) and s[-1] not in ".!?,;:" and starts_capital(s)
    return short or bool(_light(s)) or (3 <= len(s) <= 60 and is_upper(s))


def is_universal_heading(s: str, following: str) -> bool:
    if len(s) < 2:
        return False
    if s[0] == "#" or (len(s) >= 3 and " " in s and is_upper(s)) or _numbered_deep(s):
        return True
    if len(s) >= 60 or not following or s[-1] in ".,;:!?" or not starts_capital(s):
        return False
    words = s.split()
    return len(words) >= 2 and sum(map(starts_capital, words)) >= 0.6 * len(words)


def parted(lines: list[str], is_heading: Callable[[str, str], bool]) -> Iterator[tuple[str | None, str]]:
    """``(heading, content)`` of each section; what stands before the first heading has none."""
    stripped = [*map(str.strip, lines), ""]
    starts = [i for i in range(len(lines)) if is_heading(stripped[i], stripped[i + 1])]
    yield None, "\n".join(lines[: starts[0]] if starts else lines).strip()
    for a, b in pairwise([*starts, len(lines)]):
        yield stripped[a], "\n".join(lines[a + 1 : b]).strip()


def paragraphs_by(lines: list[str], n: int = 4) -> list[str]:
    found = [p for p in map(str.strip, _paragraph.split("\n".join(lines))) if p]
    return ["\n\n".join(found[i : i + n]) for i in range(0, len(found), n)]


def heading_name(heading: str | None) -> str | None:
    name = (heading or "").strip().lstrip("#").strip()
    return None if len(name) < 3 or _noisy_heading(name) else name


def universal_pieces(text: str) -> list[Piece]:
    """English lines without contents sections, noise, wraps and junk, by heading; without headings by paragraphs. The links of
    all images are with the first piece."""
    lines = (x for x in without_images(text).split("\n") if len(x.strip()) < 3 or not is_foreign(x))
    clean = without_junk(unwrapped((_spaces.sub(" ", x) for x in outside_contents(lines)), ".!?:;"))
    found = [(heading, content) for heading, content in parted(clean, is_universal_heading) if content]
    if len(found) <= 1:
        found = [(None, content) for content in paragraphs_by(clean)]
    pieces = [Piece(heading_name(heading), content) for heading, content in found if len(content) >= 10]
    return [Piece(pieces[0].heading, pieces[0].content, image_urls(text)), *pieces[1:]] if pieces else []


def light_pieces(text: str) -> list[Piece]:
    """Lines without noise and wraps by heading, each heading also in front of its content."""
    lines = (x for x in without_images(re.sub(r"\r\n?", "\n", text)).split("\n") if not (s := x.strip()) or not _noise_light(s))
    joined = unwrapped((_blanks.sub(" ", x) for x in lines), ".!?:;)")
    return [Piece(heading, content if heading is None else f"{heading}\n\n{content}") for heading, content in parted(joined, is_light_heading) if len(content) >= 5]
