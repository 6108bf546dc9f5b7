"""Inline Markdown: links, emphasis (one mark inside another), struck text, red text and escapes, as runs."""

from __future__ import annotations

import re
from dataclasses import replace
from itertools import groupby

from docblocks import schemas as S
from docblocks.readers.model import Run

#: Marks and what they switch on; a longer one is tried first (fixed values).
MARKS = (("***", {"bold": True, "italic": True}), ("**", {"bold": True}), ("~~", {"strike": True}), ("*", {"italic": True}))
_RED_OPEN, _RED_CLOSE = "<red>", "</red>"
_ESCAPABLE = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_NEUTRAL = "\0"
#: Where a line has more than plain characters.
_SPECIAL, _MARK = re.compile(r"[\\\[]"), re.compile(r"[*~]")


class _Tokens:
    """Characters and links of a line, with a shadow in which escaped characters and links look neutral."""

    def __init__(self, text: str):
        self.items: list[str | tuple[str, str]] = []
        shadow: list[str] = []
        i = 0
        while i < len(text):
            found = _SPECIAL.search(text, i)
            until = found.start() if found else len(text)
            if until > i:
                self.items += text[i:until]
                shadow.append(text[i:until])
                i = until
                continue
            if text[i] == "\\" and i + 1 < len(text) and text[i + 1] in _ESCAPABLE:
                self.items.append(text[i + 1])
                shadow.append(_NEUTRAL)
                i += 2
                continue
            link = _link_at(text, i) if text[i] == "[" else None
            if link:
                label, url, end = link
                self.items.append((label.strip() or url, url))
                shadow.append(_NEUTRAL)
                i = end
                continue
            self.items.append(text[i])
            shadow.append(text[i])
            i += 1
        self.shadow = "".join(shadow)


def _link_at(text: str, at: int) -> tuple[str, str, int] | None:
    """(label, address, end) of the link that starts here; the address may hold one level of parentheses."""
    close = text.find("]", at)
    if close < 0 or text[close + 1 : close + 2] != "(":
        return None
    depth, i = 1, close + 2
    while i < len(text) and depth:
        if text[i] == "(":
            depth += 1
            if depth > 2:
                return None
        elif text[i] == ")":
            depth -= 1
        i += 1
    url = text[close + 2 : i - 1]
    return None if depth or not url else (text[at + 1 : close], url, i)


def unescape(text: str) -> str:
    return re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text)


def _emphasis(tokens: _Tokens, low: int, high: int, style: Run, out: list[Run]) -> None:
    plain = low

    def text(until: int) -> None:
        for linked, items in groupby(tokens.items[plain:until], key=lambda item: isinstance(item, tuple)):
            if linked:
                out.extend(replace(style, text=unescape(label), href=unescape(url)) for label, url in items)
            else:
                out.append(replace(style, text="".join(items)))

    i = low
    while i < high:
        found = _MARK.search(tokens.shadow, i, high)
        if not found:
            break
        i = found.start()
        for mark, switch in MARKS:
            if not tokens.shadow.startswith(mark, i, high):
                continue
            inner = i + len(mark)
            end = tokens.shadow.find(mark, inner + (mark == "***"), high)
            if end < 0 or "\n" in tokens.shadow[inner:end]:
                continue
            if mark == "~~" and end == inner:  # four tildes are text
                i = end + len(mark)
                break
            text(i)
            _emphasis(tokens, inner, end, replace(style, **switch), out)
            i = plain = end + len(mark)
            break
        else:
            i += 1
    text(high)


def runs(text: str) -> list[Run]:
    """Runs of a line of Markdown; a struck whole line strikes its links too."""
    style = Run()
    if struck_whole(text):
        text, style = text.replace("~~", ""), Run(strike=True)
    out: list[Run] = []
    rest = text
    while rest:
        a = rest.find(_RED_OPEN)
        b = rest.find(_RED_CLOSE, a + len(_RED_OPEN)) if a >= 0 else -1
        if b < 0:
            out += _of(rest, style)
            break
        out += _of(rest[:a], style) + _of(rest[a + len(_RED_OPEN) : b], replace(style, color=S.RED))
        rest = rest[b + len(_RED_CLOSE) :]
    return out


def _of(text: str, style: Run) -> list[Run]:
    out: list[Run] = []
    tokens = _Tokens(text)
    _emphasis(tokens, 0, len(tokens.items), style, out)
    return out


def struck_whole(text: str) -> bool:
    """All of the text stands between pairs of ~~."""
    parts = text.split("~~")
    return len(parts) >= 3 and len(parts) % 2 == 1 and not any(p.strip() for p in parts[::2]) and all(parts[1::2])
