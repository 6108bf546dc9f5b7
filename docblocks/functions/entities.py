"""Character references of HTML as Columns: all names of the standard, longest match where no semicolon ends them, and numbers.

The names come with Python; they are one literal map, by first letter, that the optimizer builds once for a plan.
"""

from __future__ import annotations

import json
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A reference: decimal, hexadecimal, or a name of up to 32 characters; the semicolon may be missing.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Names that need no semicolon, and how long and short they are.
OPEN = {name: text for name, text in html5.items() if not name.endswith(";")}
LONGEST, SHORTEST = max(map(len, OPEN)), min(map(len, OPEN))
LAST = 0x10FFFF


@lru_cache
def _by_letter(open_only: bool) -> str:
    """The names as JSON, each under its first letter."""
    out: dict[str, dict[str, str]] = {}
    for name, text in (OPEN if open_only else html5).items():
        out.setdefault(name[0], {})[name] = text
    return json.dumps(out, ensure_ascii=False)


def _named(name: Column, open_only: bool = False) -> Column:
    names = F.from_json(F.lit(_by_letter(open_only)), "map<string,map<string,string>>")
    return F.try_element_at(F.try_element_at(names, F.substring(name, 1, 1)), name)


def _character(code: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


@lru_cache
def _western() -> tuple[str, ...]:
    """What the codes 128 to 159 stand for: the characters of Windows, and where it has none the codes themselves."""
    return tuple(bytes([c]).decode("cp1252", "replace").replace("\ufffd", chr(c)) for c in range(0x80, 0xA0))


def _numbered(digits: Column, base: int) -> Column:
    """The character of a number, its replacement where the standard has one, nothing for what is no character."""
    bare = F.regexp_replace(digits, "^0+(?=.)", "")
    code = F.when(F.length(bare) > 7, F.lit(LAST + 1)).otherwise(F.conv(bare, base, 10).cast("long"))
    control = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127)
    nothing = control | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    western = F.element_at(F.array(*[F.lit(c) for c in _western()]), (code - 0x7F).cast("int"))
    return (
        F.when((code == 0) | (code > LAST) | code.between(0xD800, 0xDFFF), "\ufffd")
        .when(code.between(0x80, 0x9F), western)
        .when(nothing, "")
        .otherwise(_character(code))
    )


def _resolved(token: Column) -> Column:
    """A token's text; what is no reference stays as it is."""
    body = F.substr(token, F.lit(2))
    bare = F.rtrim(body, F.lit(";"))
    number = F.when(F.lower(F.substring(body, 1, 2)) == "#x", _numbered(F.substr(bare, F.lit(3)), 16)).otherwise(_numbered(F.substr(bare, F.lit(2)), 10))
    # the longest name that the token begins with
    prefixes = [F.when(_named(F.substring(body, 1, n), True).isNotNull(), F.concat(_named(F.substring(body, 1, n), True), F.substr(body, F.lit(n + 1)))) for n in range(LONGEST, SHORTEST - 1, -1)]
    return F.when(~token.startswith("&") | (body == ""), token).when(body.startswith("#"), number).otherwise(F.coalesce(_named(body), *prefixes, token))


def unescape(text: Column) -> Column:
    """``text`` with all its character references resolved, as the standard says."""
    tokens = F.regexp_extract_all(text, F.lit(rf"(?s)({REFERENCE}|[^&]+|&)"), F.lit(1))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(tokens, _resolved), "")).otherwise(text)
