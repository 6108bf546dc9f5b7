"""Which file a path names: one identity for all the ways to write it, as a Column to compare, join and group by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of either case are one: the collation of file systems that don't tell them apart.
COLLATION = "UTF8_LCASE"


def resolved(path: Column) -> Column:
    """A path with slashes only, without its file: scheme, without empty and . parts, and with .. parts taken back.

    A .. at the root of an absolute path stays there; at the start of a relative one it is kept. A slash at the end goes.
    """
    slashed = F.replace(F.regexp_replace(path, "^file:/*", "/"), F.lit("\\"), F.lit("/"))
    absolute = slashed.startswith("/")
    parts = F.filter(F.split(slashed, "/"), lambda p: ~p.isin("", "."))
    none = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        up = (part == "..") & last.isNotNull() & (last != "..")
        stays = (part == "..") & last.isNull() & absolute
        return F.when(up, F.slice(done, 1, F.size(done) - 1)).when(stays, done).otherwise(F.concat(done, F.array(part)))

    return F.concat(F.when(absolute, "/").otherwise(""), F.array_join(F.aggregate(parts, none, step), "/"))


def identity(path: Column, collation: str = COLLATION) -> Column:
    """The resolved path under a collation: equal, grouped and joined as the file system would."""
    return F.collate(resolved(path), collation)


def key(path: Column) -> Column:
    """The same identity as a plain string, for what compares bytes, such as a state store."""
    return F.lower(resolved(path))
