"""Bytes to text: byte-order marks, UTF-16 without one (plain text), UTF-8, then the Western code page (plain text and pages).

Valid UTF-8 never leaves the JVM; the built-in decoder refuses the Western code page, so the other
files go through an Arrow function. What can't be read is an error in the result, never an exception.
"""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Messages (fixed values).
LOST = "Alguns caracteres do texto não puderam ser lidos e aparecem como \ufffd. Confira esses trechos ou salve o arquivo como UTF-8 e converta de novo."
CONTROLS = "O texto contém caracteres de controle. Salve o arquivo como UTF-8 e tente novamente."
UNKNOWN = "Não foi possível identificar a codificação. Salve o texto como UTF-8."
#: Names that pages declare for the Western code page (fixed values).
ALIASES = {"iso-8859-1": "cp1252", "iso8859-1": "cp1252", "latin1": "cp1252", "us-ascii": "cp1252"}
_MARKS = (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)
#: Bytes of a page in which a declared charset counts.
HEAD = 4096


def mostly_utf8(raw: bytes) -> bool:
    """Most of the bytes above ASCII belong to well-formed sequences: a tolerant decoder leaves the others as lone surrogates."""
    tolerant = raw.decode("utf-8", "surrogateescape")
    stray = sum(tolerant.count(chr(0xDC00 + b)) for b in range(0x80, 0x100)) if not tolerant.isascii() else 0
    above = len(raw) - len(raw.translate(None, bytes(range(0x80, 0x100))))
    return above - stray > stray


def _silent_halves(raw: bytes) -> str | None:
    """UTF-16 by its zero bytes: one half of the pairs has many, the other none."""
    pairs = len(raw) // 2
    low, high = raw[0::2].count(0), raw[1::2].count(0)
    if pairs and not low and 3 * high > pairs:
        return "utf-16-le"
    if pairs and not high and 3 * low > pairs:
        return "utf-16-be"
    return None


def decode(raw: bytes | None, markdown: bool = False) -> tuple[str | None, str | None, list[str], str | None]:
    """(text, encoding, warnings, error) of a file's bytes. Markdown is UTF-8 or UTF-16 with a mark, whatever its bytes."""
    if raw is None:
        return None, None, [], None
    if raw[:2] in _MARKS:
        return raw.decode("utf-16", "replace"), "utf-16", [], None
    if not markdown and b"\0" in raw:
        name = _silent_halves(raw)
        return (raw.decode(name, "replace"), name, [], None) if name else (None, None, [], CONTROLS)
    try:
        return raw.decode("utf-8-sig"), "utf-8", [], None
    except UnicodeDecodeError:
        pass
    if markdown or mostly_utf8(raw):
        return raw.decode("utf-8-sig", "replace"), "utf-8", [LOST], None
    try:
        return raw.decode("cp1252"), "cp1252", [], None
    except UnicodeDecodeError:
        return None, None, [], UNKNOWN


def charset_in(head: str) -> str:
    """The charset that a <meta> of a page's head declares, lower case, empty if there is none."""
    for tag in re.findall(r"(?is)<meta\b[^>]*>", head):
        name = re.search(r"(?i)\bcharset\s*=[\s\"']*([\w.:-]+)", tag, re.ASCII)
        if name:
            return name.group(1).lower()
    return ""


def decode_html(raw: bytes | None) -> tuple[str | None, str | None, list[str], str | None]:
    """As ``decode``, but a charset that the page's head declares comes first; UTF-16 can't be declared that way."""
    if raw is not None and raw[:2] not in _MARKS and raw[:3] != codecs.BOM_UTF8:
        name = charset_in(raw[:HEAD].decode("latin-1"))
        try:
            codec = codecs.lookup(ALIASES.get(name, name)).name if name else ""
            if codec and not codec.startswith("utf-16"):
                return raw.decode(codec), codec, [], None
        except (LookupError, UnicodeDecodeError):
            pass
    return decode(raw)


_TYPE = "text string, encoding string, warnings array<string>, error string"


def decoded(content: Column, html: bool = False, markdown: bool = False) -> Column:
    """Struct (text, encoding, warnings, error) of a binary column; only what isn't plain UTF-8 goes to the worker."""

    @F.pandas_udf(_TYPE)
    def run(raws: pd.Series) -> pd.DataFrame:
        rows = [decode_html(None if r is None else bytes(r)) if html else decode(None if r is None else bytes(r), markdown) for r in raws]
        return pd.DataFrame(rows, columns=["text", "encoding", "warnings", "error"])

    plain = F.is_valid_utf8(content) & ~F.contains(content, F.lit(b"\0")) & ~F.startswith(content, F.lit(codecs.BOM_UTF8))
    if html:
        plain = plain & (declared_charset(F.decode(content, "UTF-8")).isin("", "utf-8"))
    plain = F.coalesce(plain, F.lit(False))
    none = F.lit(None).cast("string")
    own = F.struct(F.decode(content, "UTF-8").alias("text"), F.lit("utf-8").alias("encoding"), F.array().cast("array<string>").alias("warnings"), none.alias("error"))
    return F.when(plain, own).otherwise(run(F.when(~plain, content)))


def declared_charset(html: Column) -> Column:
    """The charset in the head of a page, lower case, empty if there is none."""
    tags = F.regexp_extract_all(F.substring(html, 1, HEAD), F.lit(r"(?is)(<meta\b[^>]*>)"), F.lit(1))
    names = F.filter(F.transform(tags, lambda t: F.lower(F.regexp_extract(t, r"(?i)\bcharset\s*=[\s\"']*([\w.:-]+)", 1))), lambda n: n != "")
    return F.coalesce(F.get(names, F.lit(0)), F.lit(""))
