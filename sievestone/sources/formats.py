"""Text of office documents, e-books, notebooks and RTF. Every reader takes bytes and may raise on broken files."""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree as ET

from .decode import decode


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attr(node: ET.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _name(k) == name), None)


def _xml(archive: zipfile.ZipFile, name: str) -> ET.Element:
    return ET.fromstring(archive.read(name))


def by_number(names: list[str]) -> list[str]:
    """In the order of the numbers that their stems end in, then by name."""

    def key(name: str):
        stem = posixpath.splitext(posixpath.basename(name))[0]
        digits = re.search(r"\d+$", stem)
        return (0, int(digits[0]), name) if digits else (1, 0, name)

    return sorted(names, key=key)


def squeeze(line: str) -> str:
    """One space for runs of spaces, none beside tabs or at the ends."""
    return re.sub(" *(\t) *", r"\1", re.sub("[ \r]+", " ", line)).lstrip(" ").rstrip(" \t")


def collapse(text: str) -> str:
    return "\n".join(x for x in map(squeeze, text.split("\n")) if x)


def tidy(text: str) -> str:
    return "\n".join(x.rstrip() for x in text.split("\n")).strip()


def docx(data: bytes) -> str:
    out: list[str] = []
    root = _xml(zipfile.ZipFile(io.BytesIO(data)), "word/document.xml")

    def visit(node: ET.Element, in_run: bool) -> None:
        tag = _name(node.tag)
        if tag == "t":
            out.append(node.text or "")
        elif in_run and tag in ("tab", "br", "cr"):
            out.append("\t" if tag == "tab" else "\n")
        for child in node:
            visit(child, in_run or tag == "r")
        if tag in ("p", "tr"):
            out.append("\n")

    visit(root, False)
    return "".join(out).strip()


def opendocument(data: bytes) -> str:
    """Text, sheets and slides: paragraphs are lines, cells end in a tab, paragraphs of one cell are joined by a space."""
    out: list[str] = []
    root = _xml(zipfile.ZipFile(io.BytesIO(data)), "content.xml")

    def inline(node: ET.Element) -> str:
        parts = [node.text or ""]
        for child in node:
            tag = _name(child.tag)
            if tag == "s":
                parts.append(" " * int(_attr(child, "c") or 1))
            elif tag == "tab":
                parts.append("\t")
            elif tag == "line-break":
                parts.append("\n")
            else:
                parts.append(inline(child))
            parts.append(child.tail or "")
        return "".join(parts)

    def visit(node: ET.Element) -> None:
        tag = _name(node.tag)
        if tag in ("p", "h"):
            out.append(inline(node) + "\n")
        elif tag == "table-cell":
            own = [inline(x) for x in node.iter() if _name(x.tag) in ("p", "h")]
            out.append(" ".join(x for x in own if x) + "\t")
        else:
            for child in node:
                visit(child)
            if tag in ("table-row", "page"):
                out.append("\n")

    visit(root)
    return tidy("".join(out))


def xlsx(data: bytes) -> str:
    z = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if _name(t.tag) == "t") for si in _xml(z, "xl/sharedStrings.xml") if _name(si.tag) == "si"]

    def value(cell: ET.Element) -> str:
        kind = cell.get("t")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in cell.iter() if _name(t.tag) == "t")
        v = next((x.text or "" for x in cell if _name(x.tag) == "v"), "")
        if kind == "s":
            return shared[int(v)] if v.isdigit() and int(v) < len(shared) else ""
        return v

    def column(cell: ET.Element, default: int) -> int:
        letters = re.match("[A-Z]+", cell.get("r") or "")
        if not letters:
            return default
        n = 0
        for c in letters[0]:
            n = n * 26 + ord(c) - 64
        return n - 1

    sheets = []
    for name in by_number([n for n in z.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)]):
        lines = []
        for row in (x for x in _xml(z, name).iter() if _name(x.tag) == "row"):
            cells: list[str] = []
            for cell in (x for x in row if _name(x.tag) == "c"):
                k = column(cell, len(cells))
                cells += [""] * (k - len(cells)) + [value(cell)]
            line = "\t".join(cells).rstrip()
            if line.strip():
                lines.append(line)
        if lines:
            sheets.append("\n".join(lines))
    return "\n\n".join(sheets)


def pptx(data: bytes) -> str:
    z = zipfile.ZipFile(io.BytesIO(data))

    def slide(root: ET.Element) -> str:
        out: list[str] = []

        def visit(node: ET.Element, in_cell: bool) -> None:
            tag = _name(node.tag)
            if tag == "t":
                out.append(node.text or "")
            elif tag == "br":
                out.append("\n")
            for child in node:
                visit(child, in_cell or tag == "tc")
            if tag == "p":
                out.append(" " if in_cell else "\n")
            elif tag in ("tc", "tr"):
                out.append("\t" if tag == "tc" else "\n")

        visit(root, False)
        return collapse("".join(out))

    names = by_number([n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide[^/]*\.xml", n)])
    return "\n\n".join(x for x in (slide(_xml(z, n)) for n in names) if x)


#: RTF groups that aren't text, code pages, and control words for white space.
RTF_SKIPPED = "fonttbl colortbl stylesheet info pict object header headerl headerr headerf footer footerl footerr footerf footnote listtable listoverridetable themedata".split()
RTF_PAGES = {437: "cp437", 850: "cp850", 852: "cp852", 866: "cp866", 874: "cp874", 1250: "cp1250", 1251: "cp1251", 1252: "cp1252", 1253: "cp1253", 1254: "cp1254", 1255: "cp1255", 1256: "cp1256", 1257: "cp1257"}
RTF_BREAKS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "column": "\n", "row": "\n", "tab": "\t", "cell": "\t"}
_RTF = re.compile(rb"\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)? ?|\\(.)|([{}])|([^\\{}]+)", re.DOTALL)


def rtf(data: bytes) -> str:
    if not data.lstrip().startswith(b"{\\rtf"):
        raise ValueError("not RTF")
    out, stack, page, skip, uc, owed, at = [], [], "cp1252", False, 1, 0, 0
    while m := _RTF.match(data, at):
        at = m.end()
        hex_, word, number, symbol, brace, plain = m.groups()
        if brace:
            owed = 0
            if brace == b"{":
                stack.append((skip, uc))
            elif stack:
                skip, uc = stack.pop()
        elif hex_ or plain:
            raw = bytes([int(hex_, 16)]) if hex_ else plain.replace(b"\r", b"").replace(b"\n", b"")
            cut = min(owed, len(raw))
            owed, raw = owed - cut, raw[cut:]
            if not skip:
                out.append(raw.decode(page, "replace"))
        elif symbol:
            if symbol == b"*":
                skip = True
            elif not skip and symbol in b"\\{}~-_\n\r":
                out.append({b"~": " ", b"-": "", b"_": "-", b"\n": "\n", b"\r": "\n"}.get(symbol, symbol.decode()))
        else:
            name, n = word.decode(), int(number) if number else None
            if name == "ansicpg":
                page = RTF_PAGES.get(n, "cp1252")
            elif name == "uc":
                uc = n or 0
            elif name == "bin":
                at += max(0, n or 0)
            elif name in RTF_SKIPPED:
                skip = True
            elif name == "u" and n is not None and not skip:
                out.append(chr(n % 65536))
                owed = uc
            elif name in RTF_BREAKS and not skip:
                out.append(RTF_BREAKS[name])
    text = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return tidy(text)


FB2_LINES = set("p v subtitle text-author th td empty-line".split())


def fb2(data: bytes) -> str:
    got = None
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        got = decode(re.sub(rb"^\s*<\?xml[^>]*\?>", b"", data))
        if got is None:
            raise
        root = ET.fromstring(got[0])
    out: list[str] = []

    def visit(node: ET.Element) -> None:
        out.append(node.text or "")
        for child in node:
            visit(child)
            out.append(child.tail or "")
        if _name(node.tag) in FB2_LINES:
            out.append("\n")

    for body in (x for x in root if _name(x.tag) == "body"):
        visit(body)
    return collapse("".join(out))


def ipynb(data: bytes) -> str:
    cells = json.loads(data.decode("utf-8-sig")).get("cells", [])
    sources = ["".join(s) if isinstance(s := c.get("source", ""), list) else s for c in cells if c.get("cell_type") != "raw"]
    return "\n\n".join(s for s in sources if s.strip())


class _Page(HTMLParser):
    """Text of lenient XHTML: blocks are lines, cells end in tabs, head, scripts and styles are left out."""

    SKIPPED = set("head script style".split())
    BLOCKS = set("p div br h1 h2 h3 h4 h5 h6 li ul ol tr table blockquote section article header footer pre hr dt dd dl figure figcaption aside nav body title caption thead tbody".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.deep = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED:
            self.deep += 1
        elif tag in self.BLOCKS:
            self.out.append("\n")

    def handle_startendtag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self.SKIPPED:
            self.deep = max(0, self.deep - 1)
        elif tag in self.BLOCKS:
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append("\t")

    def handle_data(self, data):
        if not self.deep:
            self.out.append(re.sub(r"[\n\t\r]", " ", data))


def html_text(page: str) -> str:
    parser = _Page()
    parser.feed(page)
    parser.close()
    return collapse("".join(parser.out))


def epub(data: bytes) -> str:
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    opf = next(_attr(x, "full-path") for x in _xml(z, "META-INF/container.xml").iter() if _name(x.tag) == "rootfile")
    package, base, out = _xml(z, opf), posixpath.dirname(opf), []
    items = {x.get("id"): x for x in package.iter() if _name(x.tag) == "item"}
    for ref in (x for x in package.iter() if _name(x.tag) == "itemref"):
        item = items.get(ref.get("idref"))
        if item is None or "nav" in (item.get("properties") or "").split() or "ncx" in (item.get("media-type") or ""):
            continue
        name = posixpath.normpath(posixpath.join(base, unquote((item.get("href") or "").split("#")[0])))
        if name in names and (got := decode(z.read(name))):
            text = html_text(got[0])
            if text:
                out.append(text)
    return "\n\n".join(out)


READERS = {".docx": docx, ".odt": opendocument, ".ods": opendocument, ".odp": opendocument, ".xlsx": xlsx, ".pptx": pptx, ".rtf": rtf, ".fb2": fb2, ".ipynb": ipynb, ".epub": epub}


def supports(path: str) -> bool:
    return posixpath.splitext(path)[1].lower() in READERS


def extract(path: str, data: bytes) -> str:
    return READERS[posixpath.splitext(path)[1].lower()](data)
