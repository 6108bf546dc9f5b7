"""The inline grammar of Markdown as runs, in Columns: red passages, links, emphasis of any depth, escapes.

Every step takes from the text what the next must not read. Escaped characters are held back first, then red passages are
cut out, then links are held back, and what is left is divided at marks of emphasis, again and again inside of them,
until no piece has a pair. At the end links and escaped characters come back from their tokens, which their placeholders
number: nothing is counted or joined up from run to run, so the work grows with the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docblocks import schemas as S
from docblocks.functions import text as T
from docblocks.functions import tokens as K

RUN = "struct<text:string,href:string,color:string,bold:boolean,italic:boolean,strike:boolean>"
_PIECE = "struct<text:string,bold:boolean,italic:boolean,strike:boolean,open:boolean>"
#: A label, and an address with one level of parentheses.
LINK = r"\[[^\]]*\]\((?:[^()]|\([^()]*\))+\)"
#: Pairs of marks, the longest first; the next pieces are what no pair begins with.
_PAIRS = r"(\*\*\*.+?\*\*\*|\*\*.*?\*\*|~~.*?~~|\*.*?\*|[^*~]+|[*~])"


def _passages(bare: Column) -> Column:
    """Stretches (red, text) of a text, neighbours of one colour together."""
    whole = "(?s)<red>.*?</red>"
    reds = F.transform(F.regexp_extract_all(bare, F.lit(whole), F.lit(0)), lambda x: F.substr(x, F.lit(6), F.length(x) - 11))
    part = lambda red, text: F.struct(F.lit(red).alias("red"), text.alias("text"))
    both = F.transform(F.split(bare, whole, -1), lambda text, i: F.array(part(False, text), part(True, F.get(reds, i))))
    one = F.array(part(False, bare))
    return F.when(F.contains(bare, F.lit("<red>")), F.filter(F.flatten(both), lambda p: F.coalesce(p["text"], F.lit("")) != "")).otherwise(one)


def _divide(piece: Column) -> Column:
    """A piece as the pieces that its outermost pairs make of it."""

    def marked(text: Column) -> Column:
        # which pair a match is, found once: 3 both, 2 bold, 4 struck, 1 italic, 0 plain
        kind = F.when(~(text.startswith("*") | text.startswith("~")), 0).when(text.rlike(r"^\*\*\*.+\*\*\*$"), 3).when(text.rlike(r"^\*\*.*\*\*$") & (F.length(text) >= 4), 2)
        return F.struct(text.alias("text"), kind.when(text.rlike("^~~.+~~$"), 4).when(text.rlike(r"^\*.*\*$") & (F.length(text) >= 2), 1).otherwise(0).alias("kind"))

    def part(x: Column) -> Column:
        text, kind = x["text"], x["kind"]
        edge = F.least(kind, 6 - kind)
        inner = F.when(kind == 0, text).otherwise(F.substr(text, edge + 1, F.length(text) - 2 * edge))
        return F.struct(inner.alias("text"), (piece["bold"] | kind.isin(2, 3)).alias("bold"), (piece["italic"] | kind.isin(1, 3)).alias("italic"), (piece["strike"] | (kind == 4)).alias("strike"), (kind > 0).alias("open"))

    found = F.transform(F.transform(F.regexp_extract_all(piece["text"], F.lit(_PAIRS), F.lit(1)), marked), part)
    return F.when(piece["open"], F.filter(found, lambda p: p["text"] != "")).otherwise(F.array(piece))


def emphasis(text: Column) -> Column:
    """Pieces (text, bold, italic, strike) of a text by its marks of emphasis, one inside another as deep as they go."""
    no = F.lit(False)
    whole = F.array(F.struct(text.alias("text"), no.alias("bold"), no.alias("italic"), no.alias("strike"), F.lit(True).alias("open")).cast(_PIECE))
    # a pair has two marks, so there are no more depths than half the marks; once no piece is open, the rounds left look at nothing
    marks = F.length(text) - F.length(F.translate(text, "*~", ""))
    rounds = F.when(marks > 1, F.sequence(F.lit(1), F.floor(marks / 2).cast("int") + 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct(whole.alias("pieces"), F.lit(True).alias("more"))

    def again(done: Column, _: Column) -> Column:
        pieces = done["pieces"]
        open_ = F.exists(pieces, lambda p: p["open"])
        divided = F.flatten(F.transform(pieces, _divide)).cast(f"array<{_PIECE}>")
        step = F.struct(F.when(open_, divided).otherwise(pieces).alias("pieces"), open_.alias("more"))
        return F.when(done["more"], step).otherwise(done).cast(f"struct<pieces:array<{_PIECE}>,more:boolean>")

    return F.filter(F.aggregate(rounds, start, again, lambda done: done["pieces"]), lambda p: p["text"] != "")


def _numbered(text: Column, place: str) -> Column:
    """``text`` with each placeholder's number (from 0) behind it, and the placeholder again: it can be named wherever it comes to stand."""
    return F.array_join(F.transform(F.split(text, place, -1), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(place), (i - 1).cast("string"), F.lit(place), p))), "")


def _restored(text: Column, tokens: Column) -> Column:
    """``text`` with its numbered placeholders replaced by the tokens."""
    parts = F.transform(F.split(text, K.PLACE, -1), lambda p, i: F.when(i % 2 == 0, p).otherwise(F.get(tokens, p.try_cast("int"))))
    return F.when(F.contains(text, F.lit(K.PLACE)), F.array_join(parts, "")).otherwise(text)


def _linked(passage: Column) -> Column:
    """Runs of a passage (red, text, links, pieces), its links back in their places, escaped characters still held."""
    links = passage["links"]

    def run(text: Column, href: Column, piece: Column) -> Column:
        color = F.when(passage["red"], S.RED)
        return F.struct(text.alias("text"), href.alias("href"), color.alias("color"), piece["bold"].alias("bold"), piece["italic"].alias("italic"), piece["strike"].alias("strike")).cast(RUN)

    def of(piece: Column) -> Column:
        def part(text: Column, i: Column) -> Column:
            link = F.get(links, text.try_cast("int"))
            label, href = F.regexp_extract(link, r"(?s)^\[([^\]]*)\]", 1), F.regexp_extract(link, r"(?s)^\[[^\]]*\]\((.*)\)$", 1)
            shown = F.when(T.strip(label) == "", href).otherwise(T.strip(label))
            return F.when(i % 2 == 0, run(text, F.lit(None).cast("string"), piece)).otherwise(run(shown, href, piece))

        return F.filter(F.transform(F.split(piece["text"], K.SECOND, -1), part), lambda r: (r["text"] != "") | r["href"].isNotNull())

    return F.flatten(F.transform(passage["pieces"], of))


def runs(frame: DataFrame, text: str, out: str = "runs") -> DataFrame:
    """``frame`` with the runs of a column of Markdown; null for null.

    A link's label keeps its marks as text; an empty one is the address. What a text holds of the placeholders is text like any other.
    """
    step = [T.unused(n, [*frame.columns, out]) for n in ("tokens", "bare", "passages", "linked")]
    tokens, bare, passages, linked = step
    held = K.hold(F.col(f"`{text}`"), K.ESCAPE)
    rows = frame.withColumns({tokens: held[0], bare: _numbered(held[1], K.PLACE)}).withColumn(passages, _passages(F.col(bare)))

    def open_links(p: Column) -> Column:
        body = _numbered(F.regexp_replace(p["text"], LINK, K.SECOND), K.SECOND)
        return F.struct(p["red"].alias("red"), F.regexp_extract_all(p["text"], F.lit(f"({LINK})"), F.lit(1)).alias("links"), emphasis(body).alias("pieces"))

    rows = rows.withColumn(passages, F.transform(passages, open_links))
    rows = rows.withColumn(linked, F.flatten(F.transform(passages, _linked)))
    rows = rows.withColumn(tokens, F.transform(F.col(tokens), lambda t: F.regexp_replace(t, r"^\\", "")))

    def back(r: Column) -> Column:
        return r.withField("text", _restored(r["text"], F.col(tokens))).withField("href", _restored(r["href"], F.col(tokens))).cast(RUN)

    found = F.when(F.col(f"`{text}`").isNotNull(), F.transform(linked, back))
    return rows.withColumn(out, found).drop(*step)


def visible(runs_col: Column) -> Column:
    """What a reader sees of runs; the emphasis of a link's label is read, too."""
    seen = lambda r: F.when(r["href"].isNull(), r["text"]).otherwise(F.array_join(F.transform(emphasis(r["text"]), lambda p: p["text"]), ""))
    return F.array_join(F.transform(runs_col, seen), "")
