"""What styles inherit: many attributes at once along chains of parents, by pointer doubling over maps that merge.

A style's row holds the attributes that it sets itself. After k rounds it holds the merged attributes of 2**k links of
its chain, the nearest value of every attribute, and knows the link after them; a bound of n links is put together from
the powers of two in n. So ten links take five joins of the table with itself, however many styles, documents or
attributes there are. Merging is idempotent, so a chain that runs in a circle only meets what it has already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docblocks import schemas as S
from docblocks.functions import text as T

_MAP = "map<string,string>"


def nearest(near: Column, far: Column) -> Column:
    """Two maps as one; where both know an attribute, the nearer one counts."""
    return F.map_zip_with(near, F.coalesce(far, F.create_map().cast(_MAP)), lambda _, a, b: F.coalesce(a, b))


def first_of_each(styles: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the definitions of one style, the first counts."""
    n = T.unused("n", styles.columns)
    return styles.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col(n) == 1).drop(n)


def _follow(rows: DataFrame, at: str, links: DataFrame, within: list[str]) -> DataFrame:
    """``rows`` with what ``links`` (key, up, own) knows of the style that their column ``at`` names: ``up_`` and ``own_``."""
    names = {w: f"{w}_k" for w in [*within, "key"]}
    other = links.select(*[F.col(w).alias(n) for w, n in names.items()], F.col("up").alias("up_"), F.col("own").alias("own_"))
    same = F.col(at) == F.col("key_k")
    for w in within:
        same &= F.col(w).eqNullSafe(F.col(names[w]))
    return rows.join(other, same, "left").drop(*names.values())


def inherited(styles: DataFrame, within: list[str], key: str, parent: str, attributes: list[str], links: int = S.STYLE_LINKS) -> DataFrame:
    """(within, key, attributes): every attribute from the nearest of ``links`` styles of the chain that sets it, the style itself included.

    ``styles`` has one row for each style; ``within`` are the columns of its document. Values come back as strings, null where none is set.
    """
    place = {w: f"w{i}" for i, w in enumerate(within)}
    docs = list(place.values())
    own = F.map_filter(F.map_from_arrays(F.array(*[F.lit(a) for a in attributes]), F.array(*[F.col(f"`{a}`").cast("string") for a in attributes])), lambda _, v: v.isNotNull())
    level = styles.select(*[F.col(f"`{w}`").alias(p) for w, p in place.items()], F.col(f"`{key}`").alias("key"), F.col(f"`{parent}`").alias("up"), own.alias("own"))
    done = level.select(*docs, "key", F.col("key").alias("next"), F.create_map().cast(_MAP).alias("known"))
    left = links
    while left:
        if left & 1:
            step = _follow(done, "next", level, docs)
            done = step.select(*docs, "key", F.col("up_").alias("next"), nearest(F.col("known"), F.col("own_")).alias("known"))
        left >>= 1
        if left:
            level = _follow(level, "up", level, docs).select(*docs, "key", F.col("up_").alias("up"), nearest(F.col("own"), F.col("own_")).alias("own"))
    return done.select(*[F.col(p).alias(w) for w, p in place.items()], F.col("key").alias(key), *[F.try_element_at("known", F.lit(a)).alias(a) for a in attributes])


#: Values that mean what they say, and what a struck line isn't (fixed values).
BOLD, ITALIC, CAPITALS, NOT_STRUCK = "bold", "italic", "uppercase", "none"
ALIGNMENTS = {"center": "center", "end": "right", "right": "right", "justify": "justify", "start": "left", "left": "left"}


def effective(resolved: DataFrame, default_size: Column | None = None) -> DataFrame:
    """Resolved ODF attributes as the format of paragraphs: align, size (points), indent (centimetres) and flags, beside the keys.

    Attributes by their names: font-weight, font-style, text-line-through-style, text-transform, text-align, font-size, margin-left.
    """
    col = lambda n: F.col(f"`{n}`")
    yes = lambda c: F.coalesce(c, F.lit(False))
    align = F.create_map(*[F.lit(x) for pair in ALIGNMENTS.items() for x in pair])
    size = F.round(T.centimetres(col("font-size")) * S.POINTS_PER_CM, 2)
    used = {"font-weight", "font-style", "text-line-through-style", "text-transform", "text-align", "font-size", "margin-left"}
    return resolved.select(
        *[F.col(f"`{c}`") for c in resolved.columns if c not in used],
        F.try_element_at(align, col("text-align")).alias("align"),
        (size if default_size is None else F.coalesce(size, default_size)).alias("size"),
        F.coalesce(T.centimetres(col("margin-left")), F.lit(0.0)).alias("indent_cm"),
        yes(col("font-weight") == BOLD).alias("bold"),
        yes(col("font-style") == ITALIC).alias("italic"),
        yes(col("text-transform") == CAPITALS).alias("caps"),
        (col("text-line-through-style").isNotNull() & (col("text-line-through-style") != NOT_STRUCK)).alias("strike"),
    )
