"""DOCX to paragraphs: runs with their effective format, styles by inheritance, numbering, tables, notes and images.

Every style's properties are resolved once, when it is first met, from those of the style it is based on.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from xml.etree.ElementTree import Element

from docblocks import schemas as S
from docblocks.readers.container import Container, Unreadable, image_size
from docblocks.readers.html import safe_link
from docblocks.readers.model import BODY, CELL, WARNING, Para, Run, joined, stripped

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
#: Wrappers whose content is shown; deletions aren't among them.
WRAPPERS = frozenset(f"{W}{t}" for t in ("ins", "moveTo", "fldSimple", "smartTag", "customXml", "sdtContent", "sdt"))
ALIGN = {"center": "center", "right": "right", "end": "right", "left": "left", "start": "left", "both": "justify", "distribute": "justify"}
IMAGE_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "svg": "image/svg+xml", "emf": "image/x-emf", "wmf": "image/x-wmf"}
# Messages (fixed values).
NOTES_MOVED = "As notas de rodapé foram para o fim do texto, na seção Notas, com a chamada entre colchetes ([1], [2]). Confira antes de colar."
ENDNOTES = "O documento tem notas de fim que não foram incorporadas. Confira o original antes de colar."
TEXT_BOX = "O documento tem caixa de texto que pode não aparecer no HTML. Confira o original antes de colar."


def val(node: Element | None, path: str) -> str | None:
    found = node.find("/".join(W + p for p in path.split("/"))) if node is not None else None
    return None if found is None else found.get(f"{W}val")


def switch(props: Element | None, name: str) -> bool | None:
    """An on/off property: None where it isn't said."""
    found = props.find(W + name) if props is not None else None
    return None if found is None else found.get(f"{W}val", "true") not in ("0", "false", "off", "none")


def number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d+", text) else None


def run_props(props: Element | None) -> dict:
    """What a run's or a style's properties say; what they don't say is missing."""
    size = number(val(props, "sz"))
    line = val(props, "u")
    said = {
        "bold": switch(props, "b"),
        "italic": switch(props, "i"),
        "strike": switch(props, "strike"),
        "caps": switch(props, "caps"),
        "underline": None if line is None else line != "none",
        "size": None if size is None else size / 2,
    }
    return {k: v for k, v in said.items() if v is not None}


def par_props(props: Element | None) -> dict:
    indent = props.find(f"{W}ind") if props is not None else None
    shade = props.find(f"{W}shd") if props is not None else None
    left = None if indent is None else indent.get(f"{W}left") or indent.get(f"{W}start")
    first = None if indent is None else number(indent.get(f"{W}firstLine"))
    said = {
        "indent": None if left is None else (number(left) or 0) / S.TWIPS_PER_CM,
        "fill": None if shade is None else (shade.get(f"{W}fill") or "").lower(),
        "first": None if first is None else first / 20,
    }
    return {k: v for k, v in said.items() if v is not None}


def is_grey(fill: str | None) -> bool:
    """Grey, neither white nor black: the three parts close to each other and of middle height."""
    if not fill or not re.fullmatch(r"[0-9a-f]{6}", fill):
        return False
    parts = bytes.fromhex(fill)
    return max(parts) - min(parts) <= 16 and 128 <= sum(parts) / 3 <= 245


class Styles:
    def __init__(self, root: Element | None):
        self.nodes: dict[tuple[str, str], Element] = {}
        self.default: dict[str, str] = {}
        self.resolved: dict[tuple[str, str | None], tuple[str | None, str | None, dict, dict]] = {}
        for style in root.iter(f"{W}style") if root is not None else ():
            kind, key = style.get(f"{W}type", ""), style.get(f"{W}styleId", "")
            self.nodes.setdefault((kind, key), style)
            if style.get(f"{W}default") in ("1", "true", "on"):
                self.default.setdefault(kind, key)
        defaults = root.find(f"{W}docDefaults/{W}rPrDefault/{W}rPr") if root is not None else None
        self.size = run_props(defaults).get("size")

    def of(self, kind: str, key: str | None) -> tuple[str | None, str | None, dict, dict]:
        """(name, own alignment, paragraph properties, run properties) of a style, with what it inherits."""
        if (kind, key or "") not in self.nodes:
            key = self.default.get(kind)
        if (kind, key) not in self.resolved:
            chain, at = [], key
            while at is not None and (kind, at) in self.nodes and len(chain) < S.INHERITANCE_DEPTH:
                chain.append(self.nodes[kind, at])
                at = val(chain[-1], "basedOn")
            par: dict = {}
            run: dict = {}
            for style in reversed(chain):
                par |= par_props(style.find(f"{W}pPr"))
                run |= run_props(style.find(f"{W}rPr"))
            name = val(chain[0], "name") if chain else None
            align = ALIGN.get(val(chain[0], "pPr/jc") or "") if chain else None
            self.resolved[kind, key] = (name, align, par, run)
        return self.resolved[kind, key]


class Document:
    def __init__(self, raw: bytes):
        self.zip = Container(raw)
        body = self.zip.required("word/document.xml").find(f"{W}body")
        if body is None:
            raise Unreadable("part", "no body")
        self.body = body
        self.styles = Styles(self.zip.xml("word/styles.xml"))
        self.formats = self._numbering(self.zip.xml("word/numbering.xml"))
        links = self.zip.xml("word/_rels/document.xml.rels")
        self.targets = {r.get("Id", ""): r.get("Target", "") for r in links} if links is not None else {}
        noted = [r.get("Target", "") for r in links if r.get("Type", "").endswith("/footnotes")] if links is not None else []
        self.notes_part = f"word/{noted[0].removeprefix('/word/')}" if noted else "word/footnotes.xml"
        self.notes = self._notes()
        page = body.findall(f".//{W}sectPr")[-1:]
        size, margin = (page[0].find(f"{W}pgSz"), page[0].find(f"{W}pgMar")) if page else (None, None)
        sides = [number(n.get(W + k)) for n, k in ((size, "w"), (margin, "left"), (margin, "right")) if n is not None]
        self.area = sides[0] - sides[1] - sides[2] if len(sides) == 3 and None not in sides else None
        self.tables = 0

    def _numbering(self, root: Element | None) -> dict[tuple[str, str], str]:
        """(number, level) to the format of its abstract list's level."""
        if root is None:
            return {}
        kinds = {a.get(f"{W}abstractNumId"): {lvl.get(f"{W}ilvl", "0"): val(lvl, "numFmt") for lvl in a.findall(f"{W}lvl")} for a in root.findall(f"{W}abstractNum")}
        lists = [(n.get(f"{W}numId", ""), kinds.get(val(n, "abstractNumId"), {})) for n in root.findall(f"{W}num")]
        return {(key, level): fmt for key, levels in reversed(lists) for level, fmt in levels.items() if fmt}

    def _notes(self) -> dict[str, tuple[int, str]]:
        """Footnotes by their id, numbered as they are first called in the text."""
        root = self.zip.xml(self.notes_part)
        if root is None:
            return {}
        texts = {}
        for note in root.findall(f"{W}footnote"):
            if note.get(f"{W}type") in (None, "normal"):
                lines = (" ".join("".join(x.text or "" if x.tag == f"{W}t" else " " for x in p.iter() if x.tag in (f"{W}t", f"{W}tab", f"{W}br")).split()) for p in note.iter(f"{W}p"))
                texts[note.get(f"{W}id", "")] = " / ".join(x for x in lines if x)
        called = dict.fromkeys(c.get(f"{W}id", "") for c in self.body.iter(f"{W}footnoteReference"))
        return {key: (n, texts[key]) for n, key in enumerate((k for k in called if k in texts), 1)}

    def shown(self, node: Element, tags: tuple[str, ...]) -> Iterator[Element]:
        """Children with these tags, also inside wrappers that show their content."""
        for child in node:
            if child.tag in tags:
                yield child
            elif child.tag in WRAPPERS:
                yield from self.shown(child, tags)

    # inline

    def run_text(self, run: Element) -> str:
        text = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}
        return "".join(x.text or "" if x.tag == f"{W}t" else text.get(x.tag, "") for x in run)

    def images(self, run: Element) -> Iterator[Run]:
        for drawing in run.iter():
            if drawing.tag not in (f"{WP}inline", f"{WP}anchor"):
                continue
            extent = drawing.find(f"{WP}extent")
            shape = tuple(number(extent.get(k)) or 0 for k in ("cx", "cy")) if extent is not None else (0, 0)
            for blip in drawing.iter(f"{A}blip"):
                target = self.targets.get(blip.get(f"{R}embed", ""), "")
                blob = self.zip.blob("word/" + target.removeprefix("/word/").removeprefix("./")) if target else None
                if blob is not None:
                    size = self.image_pixels(blob, *shape)
                    kind = IMAGE_TYPES.get(target.rsplit(".", 1)[-1].lower(), "application/octet-stream")
                    measure = f'width="{size[0]}" height="{size[1]}" ' if size else ""
                    yield Run(image=f'<img alt="" {measure}src="data:{kind};base64,{base64.b64encode(blob).decode()}" style="max-width:100%;" />')

    def image_pixels(self, blob: bytes, cx: int, cy: int) -> tuple[int, int] | None:
        """Shown size: the share of the text area that the image takes in Word, of a page of so many pixels, never enlarged."""
        own = image_size(blob)
        if cx > 0 and cy > 0:
            width, shape = round(S.PAGE_PIXELS * (min(1.0, cx / (self.area * S.EMU_PER_TWIP)) if self.area else 1.0)), cy / cx
        elif own:
            width, shape = S.PAGE_PIXELS, own[1] / own[0]
        else:
            return None
        width = max(1, min(width, own[0]) if own else width)
        return width, max(1, round(width * shape))

    def runs(self, p: Element, style: dict) -> tuple[list[Run], list[dict]]:
        """(runs as they are shown, effective properties of those with text)."""
        out: list[Run] = []
        seen: list[dict] = []
        for node in self.shown(p, (f"{W}r", f"{W}hyperlink")):
            link = node.tag == f"{W}hyperlink"
            target = self.targets.get(node.get(f"{R}id", "")) if link else None
            href = safe_link(target) if target else None
            for run in node.findall(f"{W}r") if link else [node]:
                props = run.find(f"{W}rPr")
                key = val(props, "rStyle")
                direct = (self.styles.of("character", key)[3] if key else {}) | run_props(props)
                effective = style | direct
                out += self.images(run)
                for call in run.findall(f"{W}footnoteReference"):
                    if call.get(f"{W}id", "") in self.notes:
                        out.append(Run(f"[{self.notes[call.get(f'{W}id', '')][0]}]", href=href))
                text = self.run_text(run)
                color = (val(props, "color") or "auto") if not link else "auto"
                out.append(
                    Run(
                        text,
                        href=href,
                        bold=direct.get("bold", False),
                        italic=direct.get("italic", False),
                        strike=effective.get("strike", False),
                        underline=direct.get("underline", False) and not link,
                        color=None if color.lower() in ("auto", "000000") else color,
                        vertical={"superscript": "sup", "subscript": "sub"}.get(val(props, "vertAlign") or ""),
                    )
                )
                if text.strip():
                    seen.append(effective | {"spaced": (number(val(props, "spacing")) or 0) > 0})
        return out, seen

    # blocks

    def paragraph(self, p: Element, kind: str) -> Para:
        props = p.find(f"{W}pPr")
        name, style_align, par, run = self.styles.of("paragraph", val(props, "pStyle"))
        runs, seen = self.runs(p, run)
        effective = par | par_props(props)
        sizes = [s.get("size") if kind == CELL else s.get("size", self.styles.size) for s in seen]
        key, level = val(props, "numPr/numId"), val(props, "numPr/ilvl") or "0"
        numbered = key is not None and key != "0"
        every = lambda flag: bool(seen) and all(s.get(flag, False) for s in seen)
        return Para(
            kind,
            joined(runs),
            style=name,
            align=ALIGN.get(val(props, "jc") or "") or style_align,
            size=max(sizes) if sizes and None not in sizes else None,
            bold=every("bold"),
            caps=every("caps"),
            strike=every("strike"),
            grey=bool(seen) and is_grey(effective.get("fill")),
            spaced=every("spaced"),
            indent_cm=effective.get("indent", 0.0),
            first_pt=par_props(props).get("first"),
            num_format=self.formats.get((key, level), "decimal") if numbered else None,
            level=int(level) if numbered and level.isdigit() else None,
        )

    def table(self, table: Element) -> Iterator[Para]:
        """Cells in order, a row for each paragraph; nested tables give their paragraphs to the cell."""
        widths = [number(c.get(f"{W}w")) or 0 for c in table.findall(f"{W}tblGrid/{W}gridCol")]
        total = sum(widths)
        grid = [round(100 * w / (total or 1), 1) for w in widths]
        if grid:
            grid[-1] = round(100 - sum(grid[:-1]), 1)
        this, self.tables = self.tables, self.tables + 1
        width = self.table_width(table.find(f"{W}tblPr/{W}tblW"), total)
        for r, row in enumerate(self.shown(table, (f"{W}tr",))):
            for c, cell in enumerate(self.shown(row, (f"{W}tc",))):
                merge = cell.find(f"{W}tcPr/{W}vMerge")
                place = {"table_no": this, "row": r, "cell": c, "span": number(val(cell, "tcPr/gridSpan")) or 1, "continues": merge is not None and merge.get(f"{W}val", "continue") != "restart", "grid": grid, "fixed_grid": False, "table_width": width}
                paragraphs = [] if place["continues"] else [self.paragraph(p, CELL) for p in self.cell_paragraphs(cell)]
                for para in [p for p in paragraphs if stripped(p.runs)] or [Para(CELL)]:
                    for k, v in place.items():
                        setattr(para, k, v)
                    yield para

    def cell_paragraphs(self, cell: Element) -> Iterator[Element]:
        for child in self.shown(cell, (f"{W}p", f"{W}tbl")):
            if child.tag == f"{W}p":
                yield child
            else:
                for row in self.shown(child, (f"{W}tr",)):
                    for inner in self.shown(row, (f"{W}tc",)):
                        yield from self.cell_paragraphs(inner)

    def table_width(self, node: Element | None, grid: int) -> int:
        """Per cent of the text area: as the table says, or as its grid does."""
        low, high = S.TABLE_WIDTHS
        if not self.area:
            return high
        kind, text = (node.get(f"{W}type"), node.get(f"{W}w") or "") if node is not None else (None, "")
        if kind == "pct" and re.fullmatch(r"\d+(\.\d+)?%|\d+", text):
            share = float(text[:-1]) if text.endswith("%") else int(text) / 50
        elif kind == "dxa" and (number(text) or 0) > 0:
            share = 100 * int(text) / self.area
        else:
            share = 100 * grid / self.area if grid else high
        return max(low, min(high, round(share)))

    def paragraphs(self) -> Iterator[Para]:
        if self.notes:
            yield Para(WARNING, message=NOTES_MOVED)
        if next(self.body.iter(f"{W}endnoteReference"), None) is not None:
            yield Para(WARNING, message=ENDNOTES)
        if next(self.body.iter(f"{W}txbxContent"), None) is not None:
            yield Para(WARNING, message=TEXT_BOX)
        for block in self.shown(self.body, (f"{W}p", f"{W}tbl")):
            if block.tag == f"{W}tbl":
                yield from self.table(block)
            else:
                yield self.paragraph(block, BODY)
        notes = [(n, text) for n, text in self.notes.values() if text]
        if self.notes:
            yield Para(BODY, [Run("Notas", bold=True)], explicit="Texto_Centralizado")
        for n, text in notes:
            yield Para(BODY, [Run(f"Nota {n}: {text}")], explicit="Texto_Justificado")


def paragraphs(raw: bytes) -> Iterator[Para]:
    return Document(raw).paragraphs()
