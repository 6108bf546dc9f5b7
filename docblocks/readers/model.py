"""What every reader gives: paragraphs of a document in order, as typed rows.

Marks never travel inside the text. Inline formatting is an array of runs, a cell knows its table,
row and span, and what the reader has to say to the user is a row of its own (``warning``, ``error``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa

#: Kinds of rows.
BODY, BULLET, CODE, CELL, WARNING, ERROR = "p", "bullet", "code", "cell", "warning", "error"
#: Alignment and size that a cell's class stands for.
CELL_LOOK = {"Tabela_Texto_Centralizado": ("center", None), "Tabela_Texto_Alinhado_Direita": ("right", None), "Tabela_Texto_Alinhado_Esquerda": ("left", None), "Tabela_Texto_10": ("center", 10.0), "Tabela_Texto_8": ("left", 8.0)}


@dataclass
class Run:
    """A stretch of text of one format; ``href`` makes it part of a link, ``image`` is a whole <img>."""

    text: str = ""
    href: str | None = None
    bold: bool = False
    italic: bool = False
    strike: bool = False
    underline: bool = False
    color: str | None = None
    vertical: str | None = None
    image: str | None = None

    def with_text(self, text: str) -> Run:
        """The same format around another text; a plain copy, since there is one for every stretch of every page."""
        made = object.__new__(Run)
        made.__dict__ = {**self.__dict__, "text": text}
        return made

    def alike(self, other: Run) -> bool:
        mine, theirs = vars(self), vars(other)
        return self.image is None and other.image is None and all(mine[k] == theirs[k] for k in mine if k != "text")


@dataclass
class Para:
    """A paragraph with what the reader knows of it; None is unknown and fires no rule."""

    kind: str = BODY
    runs: list[Run] = field(default_factory=list)
    explicit: str | None = None
    literal: bool = False  # a number at the start is text, not an item's
    style: str | None = None
    level: int | None = None
    align: str | None = None
    size: float | None = None
    bold: bool | None = None
    caps: bool | None = None
    strike: bool | None = None
    grey: bool | None = None
    spaced: bool | None = None
    indent_cm: float | None = None
    first_pt: float | None = None
    num_format: str | None = None
    table_no: int | None = None
    row: int | None = None
    cell: int | None = None
    span: int | None = None
    continues: bool | None = None  # a cell that goes on from the row above
    grid: list[float] | None = None
    fixed_grid: bool | None = None  # widths somebody chose: not to be measured by content
    table_width: int | None = None
    message: str | None = None
    breaks: bool | None = None  # no quotation goes on over it

    @property
    def text(self) -> str:
        return "".join(r.text for r in self.runs)


def joined(runs: list[Run]) -> list[Run]:
    """Neighbouring runs of equal format made one; runs without text or image go."""
    out: list[Run] = []
    for run in runs:
        if not run.text and run.image is None:
            continue
        if out and out[-1].alike(run):
            out[-1].text += run.text
        else:
            out.append(run.with_text(run.text))
    return out


def stripped(runs: list[Run]) -> list[Run]:
    """Runs without white space at both ends."""
    out = joined(runs)
    while out and out[0].image is None:
        out[0].text = out[0].text.lstrip()
        if out[0].text:
            break
        del out[0]
    while out and out[-1].image is None:
        out[-1].text = out[-1].text.rstrip()
        if out[-1].text:
            break
        del out[-1]
    return out


def marked_all(runs: list[Run], flag: str) -> bool:
    """True if every run with visible text has the flag, and there is one."""
    seen = [getattr(r, flag) for r in runs if r.text.strip()]
    return bool(seen) and all(seen)


_RUN = pa.struct([("text", pa.string()), ("href", pa.string()), ("bold", pa.bool_()), ("italic", pa.bool_()), ("strike", pa.bool_()), ("underline", pa.bool_()), ("color", pa.string()), ("vertical", pa.string()), ("image", pa.string())])
_KINDS = {
    "kind": pa.string(), "runs": pa.list_(_RUN), "explicit": pa.string(), "literal": pa.bool_(), "style": pa.string(), "level": pa.int32(), "align": pa.string(), "size": pa.float64(),
    "bold": pa.bool_(), "caps": pa.bool_(), "strike": pa.bool_(), "grey": pa.bool_(), "spaced": pa.bool_(), "indent_cm": pa.float64(), "first_pt": pa.float64(), "num_format": pa.string(),
    "table_no": pa.int32(), "row": pa.int32(), "cell": pa.int32(), "span": pa.int32(), "continues": pa.bool_(), "grid": pa.list_(pa.float64()), "fixed_grid": pa.bool_(), "table_width": pa.int32(), "message": pa.string(), "breaks": pa.bool_(),
}
FIELDS = list(_KINDS)
RUN_DDL = "struct<text:string,href:string,bold:boolean,italic:boolean,strike:boolean,underline:boolean,color:string,vertical:string,image:string>"
_DDL = {pa.string(): "string", pa.bool_(): "boolean", pa.int32(): "int", pa.float64(): "double", pa.list_(pa.float64()): "array<double>", pa.list_(_RUN): f"array<{RUN_DDL}>"}
#: Columns of a paragraph after its document's id, as a Spark schema.
PARAGRAPH_DDL = "pos int, " + ", ".join(f"{n} {_DDL[k]}" for n, k in _KINDS.items())


def record_batch(id_name: str, ids: pa.Array, rows: list[tuple[int, int, Para]]) -> pa.RecordBatch:
    """Rows (index of the document, position, paragraph) as a batch of PARAGRAPH_DDL."""
    who = pa.array([r[0] for r in rows], pa.int64())
    columns = [ids.take(who), pa.array([r[1] for r in rows], pa.int32())]
    for name, kind in _KINDS.items():
        values = [getattr(p, name) for _, _, p in rows]
        if name == "runs":
            values = [[vars(run) for run in v] for v in values]
        columns.append(pa.array(values, kind))
    return pa.RecordBatch.from_arrays(columns, [id_name, "pos", *FIELDS])
