"""Parsers of single source files: bytes to reading units and outline entries.

Each parser yields units (title, level, text, locator); a unit begins at a heading of level 1 or 2
and holds what follows up to the next.  They run inside tasks, a file at a time.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffixes and the formats they stand for.
SUFFIXES = {".pdf": "pdf", ".epub": "epub", ".html": "html", ".htm": "html", ".xhtml": "html", ".txt": "txt", ".md": "txt", ".doc": "doc", ".docx": "docx", ".mobi": "kindle", ".azw3": "kindle"}
# Elements that end a line, and those whose content is dropped.
BLOCKS = frozenset("p div section article header footer li ul ol table tr td th blockquote pre br hr h1 h2 h3 h4 h5 h6 title dt dd figcaption".split())
DROPPED = frozenset("script style svg nav noscript template".split())


class SourceError(ValueError):
    """A source that cannot be read as its format."""


@dataclass
class Unit:
    title: str
    level: int
    lines: list[str] = field(default_factory=list)
    locator: dict = field(default_factory=dict)
    #: Deeper headings inside the unit: (level, title).
    heads: list[tuple[int, str]] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "\n\n".join(self.lines)


def nested(heads: list[tuple[int, str]]) -> list[tuple[int | None, list[str]]]:
    """(parent, breadcrumb) of headings (level, title) in order: the parent is the number, from 1, of the nearest
    earlier heading of a lower level, the breadcrumb the titles down to the heading itself."""
    out: list[tuple[int | None, list[str]]] = []
    above: list[tuple[int, int]] = []
    for number, (level, title) in enumerate(heads, 1):
        while above and above[-1][0] >= level:
            above.pop()
        parent = above[-1][1] if above else None
        out.append((parent, [*(out[parent - 1][1] if parent else []), title]))
        above.append((level, number))
    return out


def detect(path: str, override: str | None = None) -> str:
    """The format of a path by its suffix, or ``override`` if it names one."""
    known = set(SUFFIXES.values())
    if override:
        if override.lower() not in known:
            raise SourceError(f"unknown format: {override}")
        return override.lower()
    suffix = posixpath.splitext(path.lower())[1]
    if suffix not in SUFFIXES:
        raise SourceError(f"unknown suffix: {suffix or path}")
    return SUFFIXES[suffix]


def decode(data: bytes) -> str:
    """Text of unknown encoding: UTF-8, then GB 18030 if it reads cleanly as mostly Han, then cp1252."""
    for encoding in ("utf-8-sig", "utf-8"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    try:
        text = data.decode("gb18030")
        high = [c for c in text if c > "\x7f"]
        if high and sum("一" <= c <= "鿿" or "　" <= c <= "〿" or "＀" <= c <= "￯" for c in high) >= 0.8 * len(high):
            return text
    except UnicodeDecodeError:
        pass
    try:
        return data.decode("cp1252")
    except UnicodeDecodeError:
        return data.decode("latin-1")


class _Blocks(HTMLParser):
    """(tag, anchor, text) of the block elements of a page, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str | None, str]] = []
        self.meta: dict[str, str] = {}
        self.held: list[str] = []
        self.tag, self.anchor, self.dropped = "p", None, 0

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            self.blocks.append((self.tag, self.anchor, text))
            self.anchor = None
        self.held = []

    def handle_starttag(self, tag, attributes):
        values = dict(attributes)
        if tag in DROPPED:
            self.dropped += 1
        elif tag == "meta" and values.get("name") and values.get("content"):
            self.meta[values["name"].lower()] = values["content"]
        if tag in BLOCKS and not self.dropped:
            self.flush()
            self.tag = tag
        if values.get("id") and not self.dropped:
            self.anchor = values["id"]

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
        elif tag in BLOCKS and not self.dropped:
            self.flush()
            self.tag = "p"

    def handle_data(self, data):
        if not self.dropped:
            self.held.append(data)


def html_blocks(value: str) -> tuple[list[tuple[str, str | None, str]], dict[str, str]]:
    parser = _Blocks()
    parser.feed(value)
    parser.close()
    parser.flush()
    return parser.blocks, parser.meta


def html_text(value: str) -> str:
    """The text of a page: one paragraph for each block, blank lines between."""
    return "\n\n".join(text for tag, _, text in html_blocks(value)[0] if tag != "title")


def html_text_column(page: Column) -> Column:
    """``html_text`` of a column of pages, null for null."""

    @F.pandas_udf("string")
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: None if x is None else html_text(x))

    return read(page)


def _level(tag: str) -> int:
    return int(tag[1]) if re.fullmatch(r"h[1-6]", tag) else 0


def parse_html(data: bytes, href: str = "") -> list[Unit]:
    blocks, _ = html_blocks(decode(data))
    units, named = [], next((t for tag, _, t in blocks if tag == "title"), "")
    for number, (tag, anchor, text) in enumerate((b for b in blocks if b[0] != "title"), 1):
        level = _level(tag)
        if 0 < level <= 2:
            units.append(Unit(text, level, [], {"href": href, "fragment": anchor, "line_start": number}))
        else:
            if not units:
                units.append(Unit(named or "Front Matter", 1, [], {"href": href, "fragment": None, "line_start": number}))
            units[-1].lines.append(text)
            if level:
                units[-1].heads.append((level, text))
        units[-1].locator["line_end"] = number
    return units


_HEAD = re.compile(r"^(#{1,6})\s+(.+?)\s*#*$")
_NAMED = re.compile(r"^(?:chapter|part|section|appendix)\s+(?:\d+|[ivxlc]+)\b.{0,80}$|^第\s*[0-9一二三四五六七八九十百零〇]+\s*[章节回部卷].{0,60}$", re.IGNORECASE)


_NUMBERED = re.compile(r"^(\d{1,2}(?:\.\d{1,2}){1,3})\.?\s+\S.{0,78}[^.。!！?？:：,，;；]$")
_COUNTED = re.compile(r"^[一二三四五六七八九十]{1,3}、\s*\S.{0,40}[^。！？，；：]$")


def heading(line: str, following: str = "") -> tuple[int, str] | None:
    """(level, title) of a line that is a heading: hashes, underlined, a named chapter, or numbered (1.2, 一、)."""
    text = line.strip()
    if found := _HEAD.match(text):
        return len(found.group(1)), found.group(2)
    if text and re.fullmatch(r"={3,}", following.strip()):
        return 1, text
    if text and re.fullmatch(r"-{3,}", following.strip()):
        return 2, text
    if found := _NUMBERED.match(text):
        return found.group(1).count(".") + 1, text
    if _COUNTED.match(text):
        return 2, text
    return (1, text) if _NAMED.match(text) else None


def parse_text(data: bytes) -> list[Unit]:
    lines = decode(data).replace("\r\n", "\n").replace("\r", "\n").split("\n")
    units, held, skip = [], [], False

    def close(end: int) -> None:
        if held:
            if not units:
                units.append(Unit("Front Matter", 1, [], {"line_start": end - len(held) + 1}))
            units[-1].lines.append("\n".join(held))
            held.clear()
        if units:
            units[-1].locator["line_end"] = end

    for number, line in enumerate(lines, 1):
        if skip:
            skip = False
            continue
        found = heading(line, lines[number] if number < len(lines) else "")
        if found:
            close(number - 1)
            skip = not line.strip().startswith("#") and number < len(lines) and bool(re.fullmatch(r"[=-]{3,}", lines[number].strip()))
            units.append(Unit(found[1], found[0], [], {"line_start": number, "line_end": number}))
        elif line.strip():
            held.append(line)
        else:
            close(number - 1)
    close(len(lines))
    return units


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    try:
        return ElementTree.fromstring(archive.read(name))
    except (KeyError, ElementTree.ParseError) as error:
        raise SourceError(f"{name}: {error}") from error


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _contents(archive: zipfile.ZipFile, base: str, items: dict[str, str]) -> dict[str, str]:
    """The title that a book's table of contents gives to each of its files, the first where it names several."""
    found: dict[str, str] = {}
    for href in items.values():
        name = posixpath.normpath(posixpath.join(base, href or ""))
        if not (name.endswith(".ncx") or posixpath.basename(name).startswith("nav")) or name not in archive.namelist():
            continue
        for element in _xml(archive, name).iter():
            link, text = None, ""
            if _local(element) == "navPoint":
                link = next((e.get("src") for e in element if _local(e) == "content"), None)
                text = next(("".join(e.itertext()) for e in element if _local(e) == "navLabel"), "")
            elif _local(element) == "a":
                link, text = element.get("href"), "".join(element.itertext())
            if link and text.strip():
                target = posixpath.normpath(posixpath.join(posixpath.dirname(name), link.partition("#")[0]))
                found.setdefault(target, " ".join(text.split()))
    return found


#: Words below which the first document of an EPUB counts as a cover.
COVER_WORDS = 40


def parse_epub(data: bytes, keep_front_matter: bool = False) -> list[Unit]:
    """The spine's documents in order, units split at headings.

    A first document of fewer than ``COVER_WORDS`` words is a cover and left out, unless ``keep_front_matter``.
    Titles of the table of contents (EPUB 3's nav or EPUB 2's NCX) stand in for documents without a heading."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as error:
        raise SourceError("not an EPUB archive") from error
    with archive:
        roots = [e.get("full-path") for e in _xml(archive, "META-INF/container.xml").iter() if _local(e) == "rootfile"]
        if not roots or not roots[0]:
            raise SourceError("EPUB without a package file")
        package, base = _xml(archive, roots[0]), posixpath.dirname(roots[0])
        items = {e.get("id"): e.get("href") for e in package.iter() if _local(e) == "item"}
        spine = [e.get("idref") for e in package.iter() if _local(e) == "itemref"]
        named = _contents(archive, base, items)
        units: list[Unit] = []
        for place, idref in enumerate(spine):
            name = posixpath.normpath(posixpath.join(base, items.get(idref) or ""))
            if name not in archive.namelist():
                continue
            found = parse_html(archive.read(name), name)
            words = sum(len(u.text.split()) for u in found)
            if place == 0 and words < COVER_WORDS and len(spine) > 1 and not keep_front_matter:
                continue
            if found and name in named and found[0].title in ("Front Matter", ""):
                found[0].title = named[name]
            for unit in found:
                unit.locator |= {"spine_id": idref, "spine_index": place}
            units += found
        return units


def parse_docx(data: bytes) -> list[Unit]:
    """Paragraphs and tables in order; cells are joined by bars, heading styles begin units."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as error:
        raise SourceError("not a DOCX archive") from error
    with archive:
        body = next((e for e in _xml(archive, "word/document.xml") if _local(e) == "body"), None)
    units: list[Unit] = []
    said = lambda e: "".join(x.text or "" for x in e.iter() if _local(x) == "t").strip()
    for number, element in enumerate(body if body is not None else [], 1):
        if _local(element) == "tbl":
            rows = [e for e in element.iter() if _local(e) == "tr"]
            text, level = "\n".join(" | ".join(said(c) for c in row if _local(c) == "tc") for row in rows), 0
        else:
            style = next((x.get(k) for x in element.iter() if _local(x) == "pStyle" for k in x.attrib if k.endswith("val")), "") or ""
            found = re.search(r"(\d)$", style) if style.lower().startswith("heading") else None
            text, level = said(element), int(found.group(1)) if found else 0
        if not text:
            continue
        if 0 < level <= 2 or not units:
            units.append(Unit(text if level else "Front Matter", level or 1, [] if level else [text], {"line_start": number, "line_end": number}))
        else:
            units[-1].lines.append(text)
        units[-1].locator["line_end"] = number
    return units


PARSERS = {"html": parse_html, "txt": parse_text, "epub": parse_epub, "docx": parse_docx}
