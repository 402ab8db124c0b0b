"""Word documents as Markdown: headings, numbered and other lists, links, notes, formulas, images and tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

NO_NUMBER = ("bullet", "none")


def name_of(e) -> str:
    return e.tag.rpartition("}")[2]


def attr(e, name: str, default: str = "") -> str:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), default) if e is not None else default


def first(e, name: str):
    return next((x for x in e.iter() if name_of(x) == name), None) if e is not None else None


def children(e, name: str) -> list:
    return [x for x in e if name_of(x) == name] if e is not None else []


def table_markdown(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    cell = lambda c: c.replace("|", "\\|").replace("\n", "<br>").strip()
    lines = [f"| {' | '.join(cell(c) for c in r + [''] * (width - len(r)))} |" for r in rows]
    return "\n".join([*lines[:1], f"| {' | '.join(['---'] * width)} |", *lines[1:]]) if lines else ""


def formula(e) -> str:
    """An Office formula in TeX: fractions, roots, powers and indices; other parts as their text."""
    inner = lambda x, part: "".join(map(formula, children(x, part)))
    kind = name_of(e)
    if kind == "t":
        return e.text or ""
    if kind == "f":
        return rf"\frac{{{inner(e, 'num')}}}{{{inner(e, 'den')}}}"
    if kind == "rad":
        degree = inner(e, "deg")
        return rf"\sqrt{f'[{degree}]' if degree else ''}{{{inner(e, 'e')}}}"
    if kind in ("sSup", "sSub", "sSubSup"):
        low, high = inner(e, "sub"), inner(e, "sup")
        return inner(e, "e") + (f"_{{{low}}}" if low else "") + (f"^{{{high}}}" if high else "")
    return "".join(map(formula, e))


@dataclass
class Document:
    """What a document's parts say: link and media targets, list formats by (list, level), and notes."""

    part: Callable
    targets: dict[str, str] = field(default_factory=dict)
    lists: dict[tuple[str, str], tuple[str, int]] = field(default_factory=dict)
    styles: dict[str, str] = field(default_factory=dict)
    counts: dict[tuple[str, int], int] = field(default_factory=dict)
    notes: dict[str, None] = field(default_factory=dict)

    def __post_init__(self):
        rels = self.part("word/_rels/document.xml.rels")
        self.targets = {attr(r, "Id"): attr(r, "Target") for r in (rels if rels is not None else ())}
        numbering = self.part("word/numbering.xml")
        levels = {
            attr(a, "abstractNumId"): {attr(x, "ilvl"): (attr(first(x, "numFmt"), "val", "bullet"), int(attr(first(x, "start"), "val", "1"))) for x in children(a, "lvl")}
            for a in children(numbering, "abstractNum")
        }
        for n in children(numbering, "num"):
            for level, how in levels.get(attr(first(n, "abstractNumId"), "val"), {}).items():
                self.lists[attr(n, "numId"), level] = how
        for s in children(self.part("word/styles.xml"), "style"):
            self.styles[attr(s, "styleId")] = attr(first(s, "name"), "val")

    def inline(self, e) -> str:
        """The text of what a paragraph holds, in order."""
        out = []
        for x in e:
            kind = name_of(x)
            if kind == "hyperlink":
                text, target = self.inline(x), self.targets.get(attr(x, "id"), "")
                out.append(f"[{text}]({target})" if text.strip() and target else text)
            elif kind == "oMath":
                out.append(f"${formula(x).strip()}$")
            elif kind in ("t", "delText"):
                out.append((x.text or "") if kind == "t" else "")
            elif kind == "tab":
                out.append("\t")
            elif kind in ("br", "cr"):
                out.append("\n")
            elif kind in ("footnoteReference", "endnoteReference"):
                mark = f"{kind.removesuffix('Reference')}-{attr(x, 'id')}"
                self.notes[mark] = None
                out.append(f"[^{mark}]")
            elif kind in ("drawing", "pict", "object"):
                seen = first(x, "blip")
                target = self.targets.get(attr(seen, "embed") or attr(first(x, "imagedata"), "id"), "")
                out.append(f"![Word image](<{target}>)" if target else "![Embedded image omitted](image)" if seen is not None else "")
            elif kind not in ("pPr", "rPr", "del", "instrText"):
                out.append(self.inline(x))
        return "".join(out)

    def paragraph(self, p) -> str:
        shape = first(p, "oMathPara")
        text = self.inline(p)
        if shape is not None and not "".join(t.text or "" for t in p.iter() if name_of(t) == "t" and "math" not in t.tag).strip():
            return f"$$\n{formula(shape).strip()}\n$$"
        style = attr(first(p, "pStyle"), "val")
        level = next((m for s in (style, self.styles.get(style, "")) if (m := re.match(r"(?i)heading\s*([1-6])", s))), None)
        if not text.strip():
            return ""
        if level:
            return f"{'#' * int(level[1])} {text.strip()}"
        number = first(p, "numPr")
        if number is None:
            return text
        return self.item(attr(first(number, "numId"), "val"), int(attr(first(number, "ilvl"), "val", "0") or 0), text.strip())

    def item(self, which: str, level: int, text: str) -> str:
        how, start = self.lists.get((which, str(level)), ("bullet", 1))
        for deeper in [k for k in self.counts if k[0] == which and k[1] > level]:
            del self.counts[deeper]
        if how in NO_NUMBER:
            return f"{'  ' * level}- {text}"
        n = self.counts[which, level] = self.counts.get((which, level), start - 1) + 1
        return f"{'  ' * level}{n}. {text}"

    def table(self, t) -> str:
        rows = []
        for r in children(t, "tr"):
            cells = []
            for c in children(r, "tc"):
                cells.append("\n".join(filter(None, (self.paragraph(p) for p in c.iter() if name_of(p) == "p"))))
                cells += [""] * (int(attr(first(c, "gridSpan"), "val", "1") or 1) - 1)
            rows.append(cells)
        return table_markdown(rows)

    def markdown(self) -> str:
        body = first(self.part("word/document.xml"), "body")
        out = [self.paragraph(e) if name_of(e) == "p" else self.table(e) if name_of(e) == "tbl" else "" for e in (body if body is not None else ())]
        told = []
        for kind in ("footnote", "endnote"):
            for note in children(self.part(f"word/{kind}s.xml"), kind):
                mark = f"{kind}-{attr(note, 'id')}"
                if mark in self.notes:
                    told.append(f"[^{mark}]: " + " ".join(" ".join(self.inline(p) for p in children(note, "p")).split()))
        return re.sub(r"\n{3,}", "\n\n", "\n\n".join([*out, *told])).strip() + "\n"
