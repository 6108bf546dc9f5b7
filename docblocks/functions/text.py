"""Scalar text functions as Column expressions: no Python runs on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docblocks import schemas as S


def unused(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores behind as it takes to differ from all ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named: Spark writes a Column out again for every use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: What Unicode calls white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """White space of any kind gone from both ends."""
    return F.btrim(text, F.lit(WHITE))


def words(text: Column) -> Column:
    """Words between white space of any kind; none for a blank text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape_html(text: Column) -> Column:
    """The entities that this engine writes, and the non-breaking space."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def excerpt(text: Column, limit: int = S.EXCERPT_WORDS) -> Column:
    """The first words, with an ellipsis if there are more."""
    w = words(text)
    return F.concat(F.array_join(F.slice(w, 1, limit), " "), F.when(F.size(w) > limit, "…").otherwise(""))


def block_excerpt(html: Column) -> Column:
    """Excerpt of a block without its tags."""
    return excerpt(unescape_html(F.regexp_replace(html, "<[^>]+>", " ")))


def roman(n: Column) -> Column:
    """Roman numeral of 1 to 3999."""
    table = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in S.ROMANS])
    start = F.struct(n.cast("int").alias("rest"), F.lit("").alias("out"))
    return F.aggregate(
        table,
        start,
        lambda acc, r: F.struct((acc["rest"] % r["v"]).cast("int").alias("rest"), F.concat(acc["out"], F.repeat(r["s"], F.floor(acc["rest"] / r["v"]).cast("int"))).alias("out")),
        lambda acc: acc["out"],
    )


def letters(n: Column) -> Column:
    """a, b, ... z, aa, ab, ...: bijective base 26, up to six letters."""
    start = F.struct(n.cast("int").alias("rest"), F.lit("").alias("out"))
    step = lambda acc, _: F.struct(
        F.when(acc["rest"] > 0, F.floor((acc["rest"] - 1) / 26)).otherwise(0).cast("int").alias("rest"),
        F.when(acc["rest"] > 0, F.concat(F.char(97 + (acc["rest"] - 1) % 26), acc["out"])).otherwise(acc["out"]).alias("out"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(6)), start, step, lambda acc: acc["out"])


def list_number(n: Column, kind: Column) -> Column:
    """Number of a list item by the list's type: 1, a, A, i or I."""
    text = n.cast("string")
    return F.when(n <= 0, text).when(kind == "a", letters(n)).when(kind == "A", F.upper(letters(n))).when(kind == "i", F.lower(roman(n))).when(kind == "I", roman(n)).otherwise(text)


def item_number(n: Column, kind: Column) -> Column:
    """The number with its punctuation: 1. a) A) i - I -"""
    number = list_number(n, kind)
    return F.when(kind.isin("a", "A"), F.concat(number, F.lit(")"))).when(kind.isin("i", "I"), F.concat(number, F.lit(" -"))).otherwise(F.concat(number, F.lit(".")))


def safe_url(href: Column) -> Column:
    """The address without white space around it; null if it is empty or its scheme isn't allowed; one without a scheme stays.

    Browsers don't see control characters and spaces in a scheme, so the scheme is read without them; the address keeps them.
    """
    bare = strip(href)
    scheme = F.lower(F.regexp_extract(F.regexp_replace(bare, r"[\x00-\x20]+", ""), r"^([A-Za-z][A-Za-z\d+.-]*):", 1))
    return F.when((bare != "") & ((scheme == "") | scheme.isin(S.SCHEMES)), bare)


def link_target(href: Column) -> Column:
    """A safe address for a link in Markdown; anchors give none, spaces and parentheses are encoded."""
    url = safe_url(href)
    shown = F.replace(F.replace(F.replace(url, F.lit(" "), F.lit("%20")), F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))
    return F.when(~url.startswith("#"), shown)


#: Inline tags whose empty pairs say nothing.
EMPTY_TAGS = ("strong", "em", "u", "s", "span")


def drop_empty_tags(html: Column) -> Column:
    """Empty inline pairs gone, however deep they are nested.

    A pair can only be empty where a tag is followed by a closing one, so as many rounds as there are
    such places reach the end; most texts have none.
    """

    def once(text: Column, _: Column) -> Column:
        for tag in EMPTY_TAGS:
            text = F.regexp_replace(text, f"<{tag}(?: [^<>]*)?></{tag}>", "")
        return text

    places = F.size(F.split(html, "></")) - 1
    rounds = F.when(places > 0, F.sequence(F.lit(1), places)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, html, once)


#: Parts of typed numbers: a number of one or more levels, the dash that may follow, a sign that ends a letter or a numeral.
NUMBER, DASHES = r"\d+(?:\.\d+)*", "-–—"


def number_prefix(text: Column, family: Column) -> Column:
    """The typed number at a text's start with the space after it, empty if there is none; ``family``: decimal, roman or letter."""
    decimal = F.regexp_extract(text, rf"^\s*{NUMBER}\.?\s*[{DASHES}]?\s+", 0)
    roman_ = F.regexp_extract(text, rf"^\s*[IVXLCDM]+\s*[{DASHES}.)]\s+", 0)
    letter = F.regexp_extract(text, r"^\s*[a-z]\s*[.)]\s+", 0)
    return F.when(family == "decimal", decimal).when(family == "roman", roman_).when(family == "letter", letter).otherwise("")


def strip_decimal(text: Column) -> Column:
    return F.substr(text, F.length(number_prefix(text, F.lit("decimal"))) + 1)


def strip_roman(text: Column) -> Column:
    return F.substr(text, F.length(number_prefix(text, F.lit("roman"))) + 1)


def strip_letter(text: Column) -> Column:
    return F.substr(text, F.length(number_prefix(text, F.lit("letter"))) + 1)


def number_family(class_name: Column, depth: Column) -> Column:
    """What kind of typed number a paragraph of this class loses, since its class counts; null for none."""
    return (
        F.when(class_name.startswith("Item_Nivel") | class_name.startswith("Paragrafo_Numerado") | (depth > 0), "decimal")
        .when(class_name == "Item_Inciso_Romano", "roman")
        .when(class_name == "Item_Alinea_Letra", "letter")
    )


def strip_number(text: Column, class_name: Column) -> Column:
    """The typed number gone, by the family of the class."""
    return F.when(class_name == "Item_Inciso_Romano", strip_roman(text)).when(class_name == "Item_Alinea_Letra", strip_decimal(strip_letter(text))).when(class_name.rlike("^(Item_Nivel|Paragrafo_Numerado)"), strip_decimal(text)).otherwise(text)


def upper_outside_tags(html: Column) -> Column:
    """Upper case, but for tags and entities."""
    tokens = F.regexp_extract_all(html, F.lit(r"(<[^>]*>|&[#A-Za-z0-9]+;|[^<&]+|[<&])"), F.lit(1))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^(<|&[#A-Za-z0-9]+;)"), t).otherwise(F.upper(t))), "")


def is_caps(text: Column) -> Column:
    """At least three letters that have a case, all of them upper case."""
    return (text == F.upper(text)) & (F.length(F.regexp_replace(text, r"\P{Lu}+", "")) >= S.CAPS_LETTERS)


def escape_markdown(text: Column) -> Column:
    """Marks of the inline grammar escaped, and a mark that would open a block."""
    return F.regexp_replace(F.regexp_replace(text, r"([\\*\[\]`~])", r"\\$1"), r"^([#>|+-])", r"\\$1")


def unescape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([!-/:-@\[-`{-~])", "$1")


#: Marks of emphasis, the longest first.
EMPHASIS = ("***", "**", "*", "~~")


def visible_text(text: Column) -> Column:
    """A Markdown line without links, emphasis, strikes and red marks."""
    inner = r"[^()]+"
    text = F.regexp_replace(text, rf"\[([^\]]*)\]\((?:{inner}|\({inner}\)|\(\))+\)", "$1")
    for tag in ("<red>", "</red>"):
        text = F.replace(text, F.lit(tag), F.lit(""))
    for mark in EMPHASIS:
        text = F.regexp_replace(text, rf"\Q{mark}\E(.+?)\Q{mark}\E", "$1")
    return text


def class_line(line: Column) -> tuple[Column, Column]:
    """(class, text) of a line that is one paragraph with a class, else empty strings."""
    opening = F.regexp_extract(line, r"(?i)^<p\s+class=([\"'])([^\"']+)[\"']>", 0)
    whole = (opening != "") & F.lower(F.right(line, F.lit(4))).eqNullSafe(F.lit("</p>"))
    body = F.substr(line, F.length(opening) + 1, F.length(line) - F.length(opening) - 4)
    name = F.regexp_extract(opening, r"([^\"']+)[\"']>$", 1)
    return F.when(whole, name).otherwise(""), F.when(whole, body).otherwise("")


def strike_whole(text: Column) -> Column:
    """The whole paragraph struck, without marks inside of marks."""
    return F.concat(F.lit("~~"), F.replace(text, F.lit("~~"), F.lit("")), F.lit("~~"))


def is_whole_struck(text: Column) -> Column:
    """All of the text stands in struck passages, one or more."""
    return F.contains(text, F.lit("~~")) & (strip(F.regexp_replace(text, "~~(.+?)~~", "")) == "")


def starts_with_item(text: Column) -> Column:
    """Markdown that begins with an item's number, whatever marks of emphasis stand before it."""
    return item_depth(F.ltrim(unescape_markdown(text), F.lit("*~ "))) > 0


def typed_item(text: Column, style: Column) -> Column:
    """Depth of an item's typed number, 0 where the style says that the number is text."""
    return F.when(style.eqNullSafe(F.lit(S.LITERAL_NUMBER)), 0).otherwise(item_depth(text))


def is_struck(line: Column) -> Column:
    """A line that is a struck paragraph; a struck item stays an item, for the sake of the numbers after it."""
    return is_whole_struck(line) & ~starts_with_item(line)


def wrap(text: Column, opens: str, closes: str) -> Column:
    """Marks around the text, its edge spaces outside; blank texts stay."""
    head, body, tail = (F.regexp_extract(text, r"(?s)^(\s*)(.*?)(\s*)$", i) for i in (1, 2, 3))
    return F.when(body == "", text).otherwise(F.concat(head, F.lit(opens), body, F.lit(closes), tail))


def run_html(run: Column) -> Column:
    """Inline HTML of a run, nested in a fixed order from inside: sup or sub, s, u, em, strong, colour; an image stands before its text."""
    html = F.replace(escape_html(F.coalesce(run["text"], F.lit(""))), F.lit("\n"), F.lit("<br />"))
    flags = [(run["vertical"] == "sup", "sup"), (run["vertical"] == "sub", "sub"), (run["strike"], "s"), (run["underline"], "u"), (run["italic"], "em"), (run["bold"], "strong")]
    tags = F.array_compact(F.array(*[F.when(flag, F.lit(tag)) for flag, tag in flags]))
    html = F.aggregate(tags, html, lambda h, t: F.concat(F.lit("<"), t, F.lit(">"), h, F.lit("</"), t, F.lit(">")))
    html = F.when(run["color"].isNotNull(), F.concat(F.lit('<span style="color:#'), run["color"], F.lit('">'), html, F.lit("</span>"))).otherwise(html)
    return F.concat(F.coalesce(run["image"], F.lit("")), F.when(F.coalesce(run["text"], F.lit("")) == "", "").otherwise(html))


def runs_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.coalesce(r["text"], F.lit(""))), "")


def runs_html(runs: Column) -> Column:
    """Inline HTML of a paragraph: neighbouring runs of one safe address share a link; an unsafe address leaves its text."""
    start = F.struct(F.lit("").alias("out"), F.lit(None).cast("string").alias("href"))
    quoted = lambda h: F.replace(F.replace(escape_html(h), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))

    def step(acc: Column, run: Column) -> Column:
        href = F.when(run["href"].isNotNull() & (run["href"] != ""), safe_url(run["href"]))
        same = href.eqNullSafe(acc["href"])
        closes = F.when(~same & acc["href"].isNotNull(), "</a>").otherwise("")
        opens = F.when(~same & href.isNotNull(), F.concat(F.lit('<a href="'), quoted(href), F.lit('">'))).otherwise("")
        return F.struct(F.concat(acc["out"], closes, opens, run_html(run)).alias("out"), href.alias("href"))

    return F.aggregate(runs, start, step, lambda acc: F.concat(acc["out"], F.when(acc["href"].isNotNull(), "</a>").otherwise("")))


def runs_from(runs: Column, skip: Column) -> Column:
    """Runs without the first ``skip`` characters of their text; runs that this empties go."""
    empty = F.slice(runs, 1, 0)
    start = F.struct(skip.cast("int").alias("left"), empty.alias("out"))

    def step(acc: Column, run: Column) -> Column:
        n = F.length(run["text"])
        kept = run.withField("text", F.substr(run["text"], acc["left"] + 1))
        gone = (acc["left"] > 0) & (acc["left"] >= n) & run["image"].isNull()
        return F.struct(F.greatest(acc["left"] - n, F.lit(0)).alias("left"), F.when(gone, acc["out"]).otherwise(F.concat(acc["out"], F.array(kept))).alias("out"))

    return F.when(skip > 0, F.aggregate(runs, start, step, lambda acc: acc["out"])).otherwise(runs)


def centimetres(length: Column) -> Column:
    """A length with its unit in centimetres, null if it isn't one."""
    bare = strip(length)
    number = F.regexp_extract(bare, r"^-?\d+(?:\.\d+)?", 0)
    unit = F.ltrim(F.substr(bare, F.length(number) + 1))
    factors = F.create_map(*[F.lit(x) for pair in S.UNIT_CM.items() for x in pair])
    return F.when(number != "", number.cast("double") * F.try_element_at(factors, unit))


def style_value(style: Column, name: str) -> Column:
    """A property of a style attribute, lower case, null if absent."""
    found = F.regexp_extract(F.lower(style), rf"(?:^|;)\s*{name}\s*:\s*([^;]+)", 1)
    return F.when(found != "", strip(found))


def odf_style_name(name: Column) -> Column:
    """Style name as its author sees it: two hexadecimal digits between underscores are a character's code."""
    code = "_[0-9a-fA-F]{2}_"
    tokens = F.regexp_extract_all(name, F.lit(f"({code}|[^_]+|_)"), F.lit(1))
    char = lambda t: F.decode(F.concat(F.unhex(F.lit("00")), F.unhex(F.substring(t, 2, 2))), "UTF-16BE")
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(f"^{code}$"), char(t)).otherwise(t)), "")


def file_name(path: Column) -> Column:
    """Last part of a path of either slash; null for empty, . and .. names."""
    name = strip(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1))
    return F.when(~name.isin("", ".", ".."), name)


def suffix(name: Column) -> Column:
    """Lower-case suffix with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(name, r"[^.](\.[^./]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"([^.])\.[^./]+$", "$1")


def output_name(name: Column, body_only: bool = False) -> Column:
    """Name of the converted file."""
    base = stem(name)
    rest = F.regexp_replace(base, "^Nota_Tecnica_(Revisada_)?", "")
    out = F.when(base.startswith("Nota_Tecnica_"), F.concat(F.lit("Nota_Tecnica_SEI_"), rest)).otherwise(F.concat(base, F.lit("_SEI")))
    return F.concat(out, F.lit("_corpo.html" if body_only else ".html"))


def is_own_output(name: Column) -> Column:
    """A name that ``output_name`` gives, with or without the number of a part."""
    page = suffix(name).isin(".html", ".htm")
    base = F.lower(stem(name))
    base = F.regexp_replace(F.regexp_replace(base, r"_parte\d+$", ""), "_corpo$", "")
    return page & (base.endswith("_sei") | base.startswith("nota_tecnica_sei_"))


def in_scan(name: Column) -> Column:
    """A file that a scan takes: known suffix, not hidden or a lock file, not an output."""
    return suffix(name).isin(S.SUPPORTED + S.RETIRED) & ~name.rlike(r"^(~\$|\.)") & ~is_own_output(name)


def png_size(blob: Column) -> tuple[Column, Column]:
    """(width, height) in a PNG header, null for anything else."""
    is_png = F.hex(F.substring(blob, 1, 8)) == "89504E470D0A1A0A"
    read = lambda at: F.when(is_png, F.conv(F.hex(F.substring(blob, at, 4)), 16, 10).cast("int"))
    return read(17), read(21)


def shown_size(width: Column, height: Column, fraction: Column, page: int = S.PAGE_PIXELS) -> tuple[Column, Column]:
    """Pixels of an image that takes a fraction of the page's width: never enlarged, at least one."""
    w = F.greatest(F.lit(1), F.least(width, F.bround(F.least(fraction, F.lit(1.0)) * page).cast("int")))
    return w, F.greatest(F.lit(1), F.bround(height * w / width).cast("int"))


def crc16(text: Column) -> Column:
    """CRC-16/CCITT (start FFFF) of an ASCII text, four hex digits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    bits = F.sequence(F.lit(1), F.lit(8))
    turn = lambda crc, _: F.when(crc.bitwiseAND(0x8000) != 0, F.shiftleft(crc, 1).bitwiseXOR(F.lit(0x1021)).bitwiseAND(0xFFFF)).otherwise(F.shiftleft(crc, 1).bitwiseAND(0xFFFF)).cast("int")
    crc = F.aggregate(codes, F.lit(0xFFFF), lambda acc, c: F.aggregate(bits, acc.bitwiseXOR(F.shiftleft(c, 8)).cast("int"), turn).cast("int"))
    return F.lpad(F.hex(crc), 4, "0")


def item_depth(text: Column) -> Column:
    """Depth of a typed number (1. is 1, 1.1 is 2), 0 for none; a bare integer is no item."""
    number = F.regexp_extract(text, rf"^\s*({NUMBER}\.?)\s+\S", 1)
    depth = F.size(F.filter(F.split(number, r"\."), lambda x: x != ""))
    return F.when((number == "") | ~F.contains(number, F.lit(".")), 0).otherwise(depth)


def is_prose(text: Column) -> Column:
    """Running text rather than a title, by length and punctuation after the number."""
    body = strip(strip_decimal(strip(text)))
    caps = (body == F.upper(body)) & body.rlike(r"\p{Lu}")
    n = F.size(words(body))
    return F.when((body == "") | caps, False).when(n > S.TITLE_WORDS, True).when(body.endswith("."), body.contains(",") | body.contains(";") | (n > S.SENTENCE_WORDS)).otherwise(False)


def is_caps_heading(line: Column) -> Column:
    """A short line of capitals, spaces, points and hyphens that begins with a letter: a section's title or a name."""
    return F.length(line).between(3, S.HEADING_CHARS) & line.rlike(r"^\p{Lu}[\p{Lu}\s.-]*$")


def is_signature_mark(line: Column) -> Column:
    """"Assinado eletronicamente" by itself, in brackets or not, with a full stop or not."""
    bare = F.lower(F.regexp_replace(line, r"^[\[(]\s*|\s*[\])]?\.?$", ""))
    # the word is looked for first: most lines need no pattern
    return F.coalesce(F.lower(line).contains("assinad") & F.regexp_replace(bare, r"\s+", " ").isin("assinado eletronicamente", "assinada eletronicamente"), F.lit(False))


def clean_boilerplate(text: Column) -> Column:
    """Text of a signed document without signature and authenticity notes, page footers and lines that the platform wrote.

    A footer goes with the blank lines around it, so that a sentence which the page cut goes on; any other such line leaves a blank one.
    """
    for opening, ending in S.NOTES:
        text = F.regexp_replace(text, rf"(?is){opening}.*?(?:{S.NOTE_CODE}|{ending})", "")
    lines = F.transform(F.split(text, "\n"), strip)
    joined = F.regexp_replace(F.array_join(lines, "\n"), rf"(?i)\n+[^\n]*?{S.FOOTER}\n*", "\n")

    def leftover(plain: Column) -> Column:
        kind, number = F.regexp_extract(plain, r"^(.*) \d{6,8}$", 1), plain.rlike(r" \d{6,8}$")
        mark = plain.rlike(r"^[\[(] ?(?:assinatura eletronica|assinado eletronicamente) ?[\])]$")
        return mark | plain.rlike("^referencia: ?(?:caso responda|processo n[º°])") | plain.rlike(rf"(?i)^{S.FOOTER}$") | (number & kind.isin(*S.DOCUMENT_TYPES))

    plain = lambda line: F.lower(F.translate(F.regexp_replace(line, r"\s+", " "), S.ACCENTED, S.UNACCENTED))
    # only lines that begin or end like one of those are looked at closely
    likely = lambda bare: bare.rlike(r"^[\[(rRsS]|\d$")
    kept = F.transform(F.split(joined, "\n"), lambda line: let(strip(line), lambda bare: F.when(likely(bare) & let(plain(bare), leftover), "").otherwise(bare)))
    return F.concat(strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n")), F.lit("\n"))


def body_of(html: Column) -> Column:
    """What stands between the body tags; the whole text if there are none."""
    found = F.regexp_extract(html, r"(?is)<body[^>]*>(.*)</body>", 1)
    return F.when(html.rlike(r"(?is)<body[^>]*>.*</body>"), found).otherwise(html)


def pasted_kind(html: Column, text: Column) -> Column:
    """Format of clipboard content: structured HTML, Markdown marks, plain text, then any HTML."""
    structured = html.rlike(r"(?i)<(table|ul|ol|h[1-6]|blockquote|strong|em|b|i)\b")
    marked = text.rlike(r"(?m)^(#{1,6}\s|[-*+]\s|>\s|\|.*\||```)|\*\*[^*]+\*\*")
    return F.when(F.coalesce(structured, F.lit(False)), "html").when(F.coalesce(marked, F.lit(False)), "md").when(F.coalesce(strip(text) != "", F.lit(False)), "txt").when(F.coalesce(strip(html) != "", F.lit(False)), "html")
