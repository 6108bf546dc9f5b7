"""Width and height in the headers of PNG, GIF and JPEG images, as Columns over their bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docblocks.functions import text as T

#: Frame markers of JPEG that are no frames: tables of codes, an extension, arithmetic conditions.
NO_FRAMES = (0xC4, 0xC8, 0xCC)


def _hex(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("int")


def _number(digits: Column, at: int, length: int, little: bool = False) -> Column:
    """The unsigned number of ``length`` bytes from position ``at``, which counts from 0, of a text of hexadecimal digits."""
    found = F.substring(digits, 2 * at + 1, 2 * length)
    return F.conv(F.array_join(F.reverse(F.regexp_extract_all(found, F.lit("(..)"), F.lit(1))), "") if little else found, 16, 10).cast("long")


def _jpeg(digits: Column) -> Column:
    """(width, height) from the first frame: a walk from marker to marker, each of which says how long its segment is.

    Every step stands at a byte FF, so there are no more steps than the image has such bytes; the walk ends at the frame,
    at a byte that is no marker, or with fewer than ten bytes left. ``at`` is -1 where it has ended.
    """
    steps = F.size(F.split(digits, "FF"))
    last = F.length(digits) - 18
    none = F.lit(None).cast("struct<width:int,height:int>")
    ended = lambda found: F.struct(F.lit(-1).alias("at"), found.alias("size"))
    frame = f"^FF(?!{'|'.join(f'{m:02X}' for m in NO_FRAMES)})C"

    def look(at: Column, here: Column) -> Column:
        """What the nine bytes at a place say: no marker, a frame, a padding byte or a segment."""
        pair = F.struct(_hex(F.substring(here, 15, 4)).alias("width"), _hex(F.substring(here, 11, 4)).alias("height"))
        found = T.let(pair, lambda p: F.when((p["width"] > 0) & (p["height"] > 0), p))
        onward = F.when(here.startswith("FFFF"), at + 2).otherwise(at + 4 + 2 * _hex(F.substring(here, 5, 4)))
        return F.when(~here.startswith("FF"), ended(none)).when(here.rlike(frame), ended(found)).otherwise(F.struct(onward.alias("at"), none.alias("size")))

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"]
        return F.when(at < 0, acc).when(at >= last, ended(none)).otherwise(T.let(F.substr(digits, at + 1, F.lit(18)), lambda here: look(at, here)))

    return F.aggregate(F.sequence(F.lit(1), steps), F.struct(F.lit(4).alias("at"), none.alias("size")), step, lambda acc: acc["size"])


def size(blob: Column) -> Column:
    """struct(width, height) of an image; null for another format and for a header that is cut short or says nothing."""
    pair = lambda w, h: F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))

    def read(digits: Column) -> Column:
        length = F.length(digits) / 2
        return (
            F.when(digits.startswith("89504E470D0A1A0A") & (length >= 24), pair(_number(digits, 16, 4), _number(digits, 20, 4)))
            .when((digits.startswith("474946383761") | digits.startswith("474946383961")) & (length >= 10), pair(_number(digits, 6, 2, True), _number(digits, 8, 2, True)))
            .when(digits.startswith("FFD8"), _jpeg(digits))
        )

    return T.let(F.hex(blob), read)
