"""Text of which parts are held back: an array of tokens, and the text with one placeholder for each.

The n-th placeholder stands for the n-th token. A placeholder that the text had already is a token as well, so every
text comes back as it was, whatever characters it is made of, and what is done in between can't mistake a token for text.

Typed marks inside a text (columns of a cell, widths of a table, underlined or raised text) work alike: texts are shielded
first, so that a mark is never read where nobody wrote one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The placeholder, and the second one for tokens within text that has the first.
PLACE, SECOND = "\ue000", "\ue001"
#: A backslash and what it escapes.
ESCAPE = r"\\[!-/:-@\[-`{-~]"


def hold(text: Column, pattern: str, place: str = PLACE) -> tuple[Column, Column]:
    """(tokens, the text with a placeholder for each): all matches of a pattern without groups of its own, and placeholders."""
    either = f"(?s)({pattern}|[{PLACE}{SECOND}])"
    return F.regexp_extract_all(text, F.lit(either), F.lit(1)), F.regexp_replace(text, either, place)


def restore(bare: Column, tokens: Column, first: Column | None = None, place: str = PLACE) -> Column:
    """``bare`` with its placeholders replaced by the tokens from index ``first`` (0) on."""
    parts = F.split(bare, place, -1)
    token = lambda i: F.get(tokens, i - 1 if first is None else first + i - 1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(token(i), p))), "")


def places(text: Column, place: str = PLACE) -> Column:
    """How many placeholders a text has."""
    return F.length(text) - F.length(F.replace(text, F.lit(place), F.lit("")))


#: Marks of the types below, and the shield: it stands before a digit that says which of them, or the shield, was meant.
CELL, CELL_END, GRID, GRID_END, FORMAT, FORMAT_TEXT, FORMAT_END, SHIELD = (chr(0xE010 + i) for i in range(8))
_SHIELDED = (SHIELD, CELL, CELL_END, GRID, GRID_END, FORMAT, FORMAT_TEXT, FORMAT_END)
VERTICAL = ("", "sup", "sub")


def shield(text: Column) -> Column:
    """A text in which no character is a mark."""
    for i, mark in enumerate(_SHIELDED):
        text = F.replace(text, F.lit(mark), F.lit(f"{SHIELD}{i}"))
    return text


def unshield(text: Column) -> Column:
    for i, mark in reversed(list(enumerate(_SHIELDED))):
        text = F.replace(text, F.lit(f"{SHIELD}{i}"), F.lit(mark))
    return text


def with_columns(text: Column, columns: Column) -> Column:
    """A shielded cell's text that says over how many columns it goes; one column goes without saying."""
    return F.when(columns > 1, F.concat(F.lit(CELL), columns.cast("string"), F.lit(CELL_END), text)).otherwise(text)


def columns_of(cell: Column) -> tuple[Column, Column]:
    """(columns, text) of a cell."""
    head = F.regexp_extract(cell, f"^{CELL}(\\d+){CELL_END}", 1)
    return F.when(head != "", head.cast("int")).otherwise(1), F.when(head != "", F.substr(cell, F.length(head) + 3)).otherwise(cell)


def with_widths(width: Column, columns: Column) -> Column:
    """The line that stands before a table: its width and those of its columns, in percent."""
    return F.concat(F.lit(GRID), width.cast("string"), F.lit(";"), F.array_join(columns.cast("array<string>"), ","), F.lit(GRID_END))


def widths_of(line: Column) -> tuple[Column, Column]:
    """(width, widths of the columns) that a line says, null if it says none."""
    found = lambda i: F.regexp_extract(line, f"^{GRID}(\\d+(?:\\.\\d+)?);([\\d.,]*){GRID_END}$", i)
    widths = F.when(found(2) == "", F.array().cast("array<double>")).otherwise(F.split(found(2), ",").cast("array<double>"))
    return F.when(found(1) != "", found(1).cast("double")), F.when(found(1) != "", widths)


def with_format(text: Column, underline: Column, vertical: Column) -> Column:
    """Shielded text with what Markdown has no marks for: underlined, raised ("sup") or lowered ("sub")."""
    place = F.when(vertical == "sup", "1").when(vertical == "sub", "2").otherwise("0")
    marked = F.concat(F.lit(FORMAT), F.when(underline, "1").otherwise("0"), place, F.lit(FORMAT_TEXT), text, F.lit(FORMAT_END))
    return F.when(underline | (place != "0"), marked).otherwise(text)


def formats_of(text: Column) -> Column:
    """Stretches (text, underline, vertical) of a text with formats, in order."""
    mark = f"{FORMAT}[01][012]{FORMAT_TEXT}"
    pieces = F.regexp_extract_all(text, F.lit(f"(?s)({mark}.*?{FORMAT_END}|[^{FORMAT}]+|{FORMAT})"), F.lit(1))

    def stretch(piece: Column) -> Column:
        marked = piece.rlike(f"(?s)^{mark}.*{FORMAT_END}$")
        plain = F.when(marked, F.substr(piece, F.lit(5), F.length(piece) - 5)).otherwise(piece)
        vertical = F.when(marked, F.get(F.array(*[F.lit(v) for v in VERTICAL]), F.substring(piece, 3, 1).cast("int"))).otherwise("")
        return F.struct(plain.alias("text"), (marked & (F.substring(piece, 2, 1) == "1")).alias("underline"), vertical.alias("vertical"))

    return F.transform(pieces, stretch)
