"""Markdown and plain text to paragraphs: one pass over the lines, blocks that span lines looked up ahead."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from docblocks import schemas as S
from docblocks.readers import inline
from docblocks.readers.model import BULLET, CELL, CELL_LOOK, CODE, WARNING, Para, Run, joined, stripped

# Messages (fixed values).
NO_IMAGES = "Imagens indicadas no Markdown não foram incorporadas. Insira-as no SEI após a conversão."
NO_NOTES = "Notas de rodapé do Markdown ficaram como texto. Confira as chamadas e o conteúdo das notas."
_TITLE = "Texto_Centralizado_Maiusculas_Negrito"


def known_class(name: str | None) -> str | None:
    """The catalogue class that a name is, with spaces or underscores."""
    return next((n for n in (name, (name or "").replace(" ", "_")) if n in S.CLASSES), None)


def numbered_start(text: str) -> bool:
    """The text starts with the number of an item, marks of emphasis aside."""
    return re.match(r"\s*(\d+(\.\d+)+\.?|\d+\.)\s+\S", inline.unescape(text).lstrip("*~ ")) is not None


def fence_end(lines: list[str], at: int) -> int | None:
    """The line that closes the code block which starts here, None if none starts or it never closes."""
    opening = lines[at].strip()
    ticks = len(opening) - len(opening.lstrip("`"))
    if ticks < 3 or "`" in opening[ticks:]:
        return None
    return next((k for k in range(at + 1, len(lines)) if (x := lines[k].strip()) and not x.strip("`") and len(x) >= ticks), None)


def classed(line: str) -> tuple[str, str] | None:
    """(class, Markdown) of a line that is one paragraph tag with a class."""
    found = re.match(r"""(?is)<p\s+class=(["'])(?P<name>[^"']+)["']>(?P<body>.*)</p>\Z""", line)
    if not found or "</p>" in found["body"].lower():
        return None
    body = re.sub(r"(?i)<br\s*/?>", "\n", found["body"])
    for tag, mark in (("strong", "**"), ("em", "*")):
        body = re.sub(rf"(?is)<{tag}>(.*?)</{tag}>", rf"{mark}\1{mark}", body)
    return found["name"], html.unescape(re.sub(r"<[^>]+>", "", body)).strip()


def plain_text(line: str) -> str:
    """A line of plain text whose marks are escaped: backslashes and tildes, and quotes and fences at its start."""
    line = line.replace("\\", "\\\\").replace("~", "\\~")
    body = line.lstrip()
    return line[: len(line) - len(body)] + "\\" + body if body.startswith((">", "```")) else line


def cells_of(line: str) -> list[str]:
    """Cells of a line of a pipe table; an escaped pipe is content."""
    parts, last = [], 0
    for m in re.finditer(r"\\.|\|", line, re.DOTALL):
        if m.group() == "|":
            parts.append(line[last : m.start()])
            last = m.end()
    parts.append(line[last:])
    return [p.strip() for p in parts[1:-1]]


def heading(text: str, level: int, extracted: bool) -> Para:
    """A heading: numbered ones keep their place, others are centred, and a document's own title has a class."""
    bold = [Run(**{**vars(r), "bold": True, "italic": False}) for r in inline.runs(text)]
    numbered = numbered_start(text)
    para = Para(runs=stripped(bold), align=None if numbered else "center", level=min(level, 4))
    if level == 1 and not numbered and not extracted:
        para.explicit = _TITLE
    return para


def table(rows: list[list[str]], number: int, spans: list[list[int]] | None = None, table_width: int = 100, grid: list[float] | None = None) -> Iterator[Para]:
    """Cells of a table of Markdown texts; the first row is centred, a classed cell looks like its class."""
    width = max(sum(spans[r]) if spans else len(row) for r, row in enumerate(rows))
    chosen = grid is not None and len(grid) == width
    grid = grid if chosen else [round(100 / width, 1)] * width
    for r, row in enumerate(rows):
        at = 0
        for c, text in enumerate(row):
            span = spans[r][c] if spans else 1
            own = classed(text)
            align, size = CELL_LOOK.get(known_class(own[0]) or "", (None, None)) if own else (None, None)
            yield Para(CELL, stripped(inline.runs(own[1] if own else text)), align=align or ("center" if r == 0 else "justify"), size=size, table_no=number, row=r, cell=c, span=span, grid=grid, fixed_grid=chosen, table_width=table_width)
            at += span
        if at < width:
            for c in range(len(row), len(row) + width - at):
                yield Para(CELL, [], align="center" if r == 0 else "justify", table_no=number, row=r, cell=c, span=1, grid=grid, fixed_grid=chosen, table_width=table_width)


def without_images(lines: list[str]) -> tuple[list[str], list[str]]:
    """(lines with a phrase in place of each image, warnings); code blocks stay as they are."""
    out, images, notes, i = [], False, False, 0
    while i < len(lines):
        end = fence_end(lines, i)
        if end is not None:
            out += lines[i : end + 1]
            i = end + 1
            continue
        notes = notes or re.match(r" {0,3}\[\^[^\]\s]+\]:", lines[i]) is not None
        line, n = re.subn(r"!\[([^\]]*)\]\([^)]+\)", lambda m: f"Imagem não incorporada ({escape(m.group(1).strip() or 'sem descrição')})", lines[i])
        images = images or n > 0
        out.append(line)
        i += 1
    return out, [m for m, yes in ((NO_IMAGES, images), (NO_NOTES, notes)) if yes]


def escape(text: str) -> str:
    """Marks of the inline grammar escaped, and a mark that would open a block."""
    return re.sub(r"^(?=[#>|+-])", r"\\", re.sub(r"(?=[\\*\[\]`~])", r"\\", text))


def paragraphs(text: str, markdown: bool = True, extracted: bool = False) -> Iterator[Para]:
    """Paragraphs of a text; ``extracted`` text came out of another format and has no title of its own."""
    lines = re.split(r"\r\n|\r|\n", text)
    if markdown and not extracted:
        lines, warnings = without_images(lines)
        for message in warnings:
            yield Para(WARNING, message=message)
    if not markdown:
        lines = [plain_text(line) for line in lines]
    dashes = "-–—*_~" if markdown else "-–—*_"
    number, i = 0, 0
    while i < len(lines):
        line = lines[i].strip()
        i += 1
        if not line:
            continue
        end = fence_end(lines, i - 1)
        if end is not None:
            code = "\n".join(x.rstrip() for x in lines[i:end]).strip("\n")
            i = end + 1
            if code:
                yield Para(CODE, [Run(code)], explicit="Texto_Mono_Espaçado", align="justify")
            continue
        shown = inline.unescape(line)
        if len(shown) >= 3 and not shown.strip(dashes):
            continue
        if line.startswith("<red>"):
            region = [lines[i - 1]]
            while "</red>" not in region[-1] and i < len(lines):
                region.append(lines[i])
                i += 1
            body = "\n".join(region).replace("<red>", "").replace("</red>", "")
            for part in re.split(r"\n\s*\n", body):
                if part.strip():
                    yield Para(runs=stripped(inline.runs(f"<red>{part.strip()}</red>")), align="justify")
            continue
        own = classed(line)
        if own:
            name = known_class(own[0])
            align = "center" if "Texto_Centralizado" in own[0] else "left" if "Texto_Alinhado_Esquerda" in own[0] else "justify"
            yield Para(runs=stripped(inline.runs(own[1])), explicit=name, align=align)
        elif line.startswith(">"):
            quoted = re.sub(r"^(?:>\s?)+", "", line).strip()
            if quoted:
                yield Para(runs=stripped(inline.runs(quoted)), explicit="Citação", align="justify")
        elif inline.struck_whole(line) and not numbered_start(line):
            yield Para(runs=stripped(inline.runs(line.replace("~~", ""))), explicit="Tachado", align="justify")
        elif line.startswith("#"):
            body = line.lstrip("#")
            para = heading(body.strip(), len(line) - len(body), extracted)
            if para.runs:
                yield para
        elif line[:2] in ("- ", "* ", "+ "):
            body = line[2:].strip()
            task = re.match(r"\[([ xX])\]\s*(.*)\Z", body, re.DOTALL)
            if task:
                body = f"{'Pendente' if task.group(1) == ' ' else 'Concluído'}: {task.group(2)}"
            indent = len(lines[i - 1]) - len(lines[i - 1].lstrip(" \t"))
            yield Para(BULLET, stripped(inline.runs(body)), level=min((indent + 1) // 2, 3), align="justify")
        elif line.startswith("|"):
            rows = [line]
            while i < len(lines) and lines[i].strip().startswith("|"):
                rows.append(lines[i].strip())
                i += 1
            cells = [c for x in rows if not (len(x) > 2 and x.endswith("|") and not x.strip(" \t:-|+")) and (c := cells_of(x))]
            if cells:
                yield from table(cells, number)
                number += 1
            elif not any(cells_of(x) for x in rows):
                yield Para(runs=stripped(inline.runs(line)), align="justify")
        else:
            yield Para(runs=joined(inline.runs(line)), align="justify")
