"""The text layer of PDF files as Markdown, without any external program.

Objects are found by their marks (and inside object streams), pages by the page tree. A page's content
is read operator by operator; the font's table to Unicode, or else the usual Latin encoding, decodes
its strings; shown pieces become lines by their place, lines paragraphs by the readable view's rules.
Larger type makes headings. Scanned pages have no text layer: the file then has no text.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from statistics import median

from ..operators.readable import paragraphs

#: Bytes that one stream may inflate to; share of the usual type size from which a line is a heading.
MAX_STREAM, HEADING = 128 << 20, 1.2
#: In thousandths of the type size: a step inside a line that stands for a space.
SPACE_STEP = -180
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\([^()]*\))*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]*|[^\s/<>\[\]()]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _inflated(head: bytes, raw: bytes) -> bytes:
    if b"/ASCIIHexDecode" in head:
        raw = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", raw.split(b">")[0]).decode())
    if b"/FlateDecode" in head:
        try:
            return zlib.decompressobj().decompress(raw, MAX_STREAM)
        except zlib.error:
            return b""
    return raw


class _File:
    """A file's objects by number: the bytes of each, and those of its stream."""

    def __init__(self, data: bytes):
        if not data[:1024].lstrip().startswith(b"%PDF"):
            raise ValueError("pdf_unreadable")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("pdf_encrypted")
        self.objects: dict[int, bytes] = {}
        self.streams: dict[int, bytes] = {}
        for m in re.finditer(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S):
            number, body = int(m[1]), m[2]
            head, found, rest = body.partition(b"stream")
            self.objects[number] = head
            if found:
                raw = rest[2:] if rest.startswith(b"\r\n") else rest[1:]
                self.streams[number] = _inflated(head, raw.rpartition(b"endstream")[0])
        for number in [n for n, h in self.objects.items() if re.search(rb"/Type\s*/ObjStm", h)]:
            head, body = self.objects[number], self.streams.get(number, b"")
            n, first = (int(x[1]) if (x := re.search(p, head)) else 0 for p in (rb"/N\s+(\d+)", rb"/First\s+(\d+)"))
            places = list(map(int, re.findall(rb"\d+", body[:first])))[: 2 * n]
            ends = [*places[3::2], len(body) - first]
            for k, at, end in zip(places[::2], places[1::2], ends, strict=False):
                self.objects.setdefault(k, body[first + at : first + end])

    def entry(self, head: bytes, name: bytes) -> bytes:
        """A dictionary's entry: a nested dictionary or array, or what a reference names, or one value."""
        m = re.search(rb"/" + name + rb"(?![A-Za-z])\s*", head)
        if not m:
            return b""
        rest = head[m.end() :]
        if r := re.match(rb"(\d+)\s+\d+\s+R", rest):
            return self.objects.get(int(r[1]), b"")
        for a, b in ((b"<<", b">>"), (b"[", b"]")):
            if rest.startswith(a):
                depth = 0
                for t in re.finditer(re.escape(a) + b"|" + re.escape(b), rest):
                    depth += 1 if t[0] == a else -1
                    if not depth:
                        return rest[: t.end()]
        return re.match(rb"/?[^\s/<>\[\]]*", rest)[0]

    @staticmethod
    def references(value: bytes) -> list[int]:
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", value)]

    def pages(self) -> list[tuple[bytes, bytes]]:
        """(page, resources) of every page, in the tree's order; resources may come from above."""
        out, seen = [], set()

        def walk(number: int, resources: bytes) -> None:
            if number in seen:
                return
            seen.add(number)
            head = self.objects.get(number, b"")
            resources = self.entry(head, b"Resources") or resources
            kids = self.entry(head, b"Kids")
            if kids:
                for k in self.references(kids):
                    walk(k, resources)
            elif re.search(rb"/Type\s*/Page(?![a-zA-Z])", head):
                out.append((head, resources))

        for number, head in self.objects.items():
            if re.search(rb"/Type\s*/Catalog", head):
                for k in self.references(re.search(rb"/Pages\s+\d+\s+\d+\s+R|$", head)[0]):
                    walk(k, b"")
        return out or [(h, self.entry(h, b"Resources")) for h in self.objects.values() if re.search(rb"/Type\s*/Page(?![a-zA-Z])", h)]

    def content(self, page: bytes) -> bytes:
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        return b"\n".join(self.streams.get(k, b"") for k in self.references(m[1] if m else b""))


class _Font:
    """How a font's codes read."""

    def __init__(self, table: bytes):
        self.width, self.code = 1, {}
        if w := re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", table):
            self.width = max(1, len(w[1]) // 2)
        text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", table, re.S):
            self.code.update((int(a, 16), text(b)) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block))
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", table, re.S):
            for a, b, to, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", block):
                low, high = int(a, 16), min(int(b, 16), int(a, 16) + 65_535)
                each = re.findall(rb"<([0-9A-Fa-f]+)>", many)
                for i in range(low, high + 1):
                    if many:
                        if i - low < len(each):
                            self.code[i] = text(each[i - low])
                    else:
                        start = text(to)
                        self.code[i] = start[:-1] + chr(ord(start[-1]) + i - low)

    def read(self, raw: bytes) -> str:
        if not self.code:
            return raw.decode("cp1252", "replace")
        w = self.width
        return "".join(self.code.get(int.from_bytes(raw[i : i + w], "big"), "") for i in range(0, len(raw), w))


def _string(token: bytes) -> bytes:
    if token.startswith(b"<"):
        h = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((h + b"0" * (len(h) % 2)).decode())

    def plain(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else _ESCAPES.get(x, b"" if x in (b"\n", b"\r\n") else x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, token[1:-1], flags=re.S)


@dataclass
class Line:
    y: float
    size: float
    text: str


def page_lines(content: bytes, fonts: dict[bytes, _Font]) -> list[Line]:
    """The lines that a page's content shows, in the order it shows them."""
    out: list[Line] = []
    font, size, lead, scale, x, y, start = _Font(b""), 1.0, 0.0, 1.0, 0.0, 0.0, 0.0
    stack: list[bytes | list[bytes]] = []
    array: list[bytes] | None = None

    def num(i: int) -> float:
        try:
            return float(stack[i])
        except (ValueError, TypeError, IndexError):
            return 0.0

    def show(pieces: list[bytes]) -> None:
        text = ""
        for p in pieces:
            if p[:1] in (b"(", b"<"):
                text += font.read(_string(p))
            elif re.fullmatch(rb"[-+]?[0-9.]+", p) and float(p) < SPACE_STEP and not text.endswith(" "):
                text += " "
        if not text:
            return
        if out and abs(out[-1].y - y) < 0.4 * max(size * scale, 1):
            gap = "" if out[-1].text.endswith(" ") or text.startswith(" ") or not moved else " "
            out[-1].text += gap + text
        else:
            out.append(Line(y, size * scale, text))

    moved = False
    for m in _TOKEN.finditer(content):
        t = m[0]
        if t == b"[":
            array = []
        elif t == b"]":
            stack.append(array or [])
            array = None
        elif array is not None:
            array.append(t)
        elif t[:1] in b"(</" or re.fullmatch(rb"[-+]?[0-9]*\.?[0-9]+", t) or re.fullmatch(rb"[-+]?[0-9]+\.", t):
            stack.append(t)
        else:
            if t == b"BT":
                x = y = start = 0.0
                scale, moved = 1.0, True
            elif t == b"Tf" and len(stack) > 1:
                font, size = fonts.get(bytes(stack[-2]), font), num(-1)
            elif t == b"TL":
                lead = num(-1)
            elif t in (b"Td", b"TD"):
                start, y, moved = start + num(-2) * scale, y + num(-1) * scale, True
                if t == b"TD":
                    lead = -num(-1)
            elif t == b"Tm":
                scale, start, y, moved = abs(num(-3)) or 1.0, num(-2), num(-1), True
            elif t in (b"T*", b"'", b'"'):
                y, moved = y - (lead or size) * scale, True
            if t in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], bytes):
                show([stack[-1]])
                moved = False
            elif t == b"TJ" and stack and isinstance(stack[-1], list):
                show(stack[-1])
                moved = False
            stack = []
    return out


def pages(data: bytes) -> list[list[Line]]:
    """The lines of every page."""
    f = _File(data)
    tables: dict[int, _Font] = {}
    out = []
    for page, resources in f.pages():
        fonts = {}
        for name, number in re.findall(rb"(/[^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", f.entry(resources, b"Font")):
            k = int(number)
            if k not in tables:
                to = f.references(re.search(rb"/ToUnicode\s+\d+\s+\d+\s+R|$", f.objects.get(k, b""))[0])
                tables[k] = _Font(f.streams.get(to[0], b"") if to else b"")
            fonts[name] = tables[k]
        out.append(page_lines(f.content(page), fonts))
    return out


def pdf_markdown(data: bytes) -> str:
    """The text layer as Markdown; ValueError if the file cannot be read or has none."""
    found = pages(data)
    sizes = [x.size for p in found for x in p if x.text.strip()]
    if not sizes:
        raise ValueError("pdf_no_text_layer")
    usual, parts = median(sizes), []
    for p in found:
        lines = []
        for x in p:
            t = " ".join(x.text.split())
            t = re.sub(r"^[•●▪◦·]\s*", "- ", t)
            if x.size >= HEADING * usual and len(t) <= 90 and re.search(r"\w", t):
                t = f"{'#' if x.size >= 1.6 * usual else '##'} {t}"
            lines.append(t)
        parts.append("\n\n".join(x for x in paragraphs(lines) if x))
    return "\n\n".join(x for x in parts if x) + "\n"
