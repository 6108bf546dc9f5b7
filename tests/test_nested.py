"""Styles with many attributes, lists inside lists, and quotations among titles and lists, against readings by loops."""

import random

import pytest
from pyspark.sql import functions as F

from docblocks.operators import nested as N
from docblocks.operators import styles as Y
from docblocks.plans import reference

from .conftest import SF

NAMES = ["weight", "size", "key"]


def brute(styles, links):
    """(doc, key) to attributes, by walking the chain."""
    known = {(d, k): (p, v) for d, k, p, v in styles}
    out = {}
    for d, k in known:
        found, at = dict.fromkeys(NAMES), k
        for _ in range(links):
            if (d, at) not in known:
                break
            at_parent, values = known[d, at]
            for n in NAMES:
                if found[n] is None:
                    found[n] = values.get(n)
            at = at_parent
        out[d, k] = tuple(found[n] for n in NAMES)
    return out


@pytest.mark.parametrize("links", [1, 2, 5, 10, 16])
def test_inherited(spark, links):
    rng = random.Random(links)
    styles = []
    for d in (1, 2, None):
        keys = [f"s{i}" for i in range(40)]
        for i, k in enumerate(keys):
            parent = rng.choice([None, "nowhere", keys[i - 1], keys[i - 1], keys[i - 1], rng.choice(keys), k])
            styles.append((d, k, parent, {n: f"{n}{i}" for n in NAMES if rng.random() < 0.15}))
    frame = spark.createDataFrame([(d, k, p, *[v.get(n) for n in NAMES]) for d, k, p, v in styles], "doc int, name string, up string, weight string, size string, key string")
    got = Y.inherited(frame, ["doc"], "name", "up", NAMES, links)
    assert got.columns == ["doc", "name", *NAMES]
    assert {(r["doc"], r["name"]): tuple(r)[2:] for r in got.collect()} == brute(styles, links)
    assert got.count() == len(styles)


def test_first_definition_counts(spark):
    frame = spark.createDataFrame([(1, "a", 2, "late"), (1, "a", 1, "first"), (1, "b", 1, "b")], "doc int, key string, n int, v string")
    assert {(r["key"], r["v"]) for r in Y.first_of_each(frame, ["doc", "key"], "n").collect()} == {("a", "first"), ("b", "b")}


def test_effective_formats(spark):
    rows = [("bold", "italic", "none", "uppercase", "end", "12pt", "1.5cm"), ("normal", None, "solid", None, "justify", "1cm", "x"), (None,) * 7, ("bold", "normal", "solid", "none", "odd", "2em", "-1cm")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, `font-weight` string, `font-style` string, `text-line-through-style` string, `text-transform` string, `text-align` string, `font-size` string, `margin-left` string")
    got = [tuple(r)[1:] for r in Y.effective(frame, F.lit(10.0)).orderBy("i").collect()]
    assert got == [("right", 12.0, 1.5, True, True, True, False), ("justify", 28.35, 0.0, False, False, False, True), (None, 10.0, 0.0, False, False, False, False), (None, 10.0, -1.0, True, False, False, True)]


# lists
def tree(rng, deepest, doc):
    """(nodes, expected): a list with lists in its items, walked as a reader would."""
    nodes, expected, count = [], {}, iter(range(10**6))
    specs = {("s1", 1): ("1", None, ".", 1), ("s1", 2): ("a", "(", ")", 3), ("s2", 2): ("I", None, " -", 1), ("s2", 3): ("A", "", ")", 26), ("s2", 9): ("i", None, None, 9)}

    def add(parent, kind, style=None, start=None):
        n = next(count)
        nodes.append((doc, n, parent, n, kind, style, start))
        return n

    def walk(parent, level, outer):
        style = rng.choice([None, None, "s1", "s2", "odd"])
        here = add(parent, N.LIST, style)
        style = style or outer
        spec = specs.get((style, level + 1))
        at = spec[3] if spec else 1
        for _ in range(rng.randint(0, 4)):
            header = rng.random() < 0.2
            start = rng.choice([None, None, None, rng.randint(0, 60)])
            item = add(here, N.HEADER if header else N.ITEM, start=start)
            at = at if start is None else start
            number = at if spec and not header else None
            expected[doc, item] = (level, number)
            at += number is not None
            for _ in range(rng.choice([0, 0, 1, 1, 0]) if level < deepest else 0):
                walk(item, level + 1, style)

    walk(None, 0, None)
    return nodes, expected, specs


def test_items(spark):
    nodes, expected = [], {}
    for doc in [*range(25), None]:
        more, found, specs = tree(random.Random(f"t{doc}"), 12, doc)
        if doc == 3:  # one path far deeper than any rounds that are fixed
            base = 10**6
            for i in range(70):
                more += [(doc, base + 2 * i, base + 2 * i - 1 if i else None, base + 2 * i, N.LIST, "s2" if i == 0 else None, None), (doc, base + 2 * i + 1, base + 2 * i, base + 2 * i + 1, N.ITEM, None, None)]
                spec = specs.get(("s2", i + 1))
                found[doc, base + 2 * i + 1] = (i, spec[3] if spec else None)
        nodes += more
        expected |= found
    frame = spark.createDataFrame(nodes, "doc_id int, node long, parent long, pos long, kind string, style string, start int").repartition(4)
    table = spark.createDataFrame([(s, n, *v) for (s, n), v in specs.items()], "list_style string, level int, num_type string, prefix string, suffix string, first int")
    got = N.items(frame, table).collect()
    assert {(r["doc_id"], r["node"]): (r["level"], r["number"]) for r in got} == expected and len(got) == len(expected)
    labels = {r["label"] for r in got}
    assert None in labels and {x for x in labels if x and x.startswith("(")} and all((r["label"] is None) == (r["number"] is None) for r in got)


def test_lists_whose_outer_list_is_known(spark):
    nodes = [row for doc in [*range(12), None] for row in tree(random.Random(f"o{doc}"), 12, doc)[0]]
    over = {(doc, n): parent for doc, n, parent, *_ in nodes}
    known = [(doc, n, kind, style, over.get((doc, parent))) for doc, n, parent, _, kind, style, _ in nodes if kind == N.LIST] + [(1, 10**6, N.LIST, "s1", 10**7)]
    frame = spark.createDataFrame(nodes, "doc_id int, node long, parent long, pos long, kind string, style string, start int")
    found = N.around(spark.createDataFrame(known, "doc_id int, node long, kind string, style string, outer long"), outer="outer").collect()
    assert sorted(map(str, found)) == sorted([*map(str, N.around(frame).collect()), "Row(doc_id=1, node=1000000, list_style='s1', level=1)"])


def test_lines_are_dealt_out_once(spark):
    plan = reference.queries()["nested_items"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2  # the lines by their order, and their lists


def test_labels(spark):
    nodes = [(1, 0, None, 0, N.LIST, "s", None), *[(1, i, 0, i, N.ITEM, None, s) for i, s in ((1, None), (2, None), (3, 27), (4, None))]]
    frame = spark.createDataFrame(nodes, "doc_id int, node long, parent long, pos long, kind string, style string, start int")
    table = spark.createDataFrame([("s", 1, "a", "(", ")", 2)], "list_style string, level int, num_type string, prefix string, suffix string, first int")
    assert [r["label"] for r in N.items(frame, table).orderBy("pos").collect()] == ["(b)", "(c)", "(aa)", "(ab)"]


def test_items_without_a_place_come_last(spark):
    rows = spark.createDataFrame([(1, 1, N.ITEM, None, "s", 0), (1, None, N.ITEM, None, "s", 0), (1, 2, N.ITEM, None, "s", 0)], "list int, pos int, kind string, start int, list_style string, level int")
    table = spark.createDataFrame([("s", 1, "1", None, ".", 1)], "list_style string, level int, num_type string, prefix string, suffix string, first int")
    assert {r["pos"]: r["label"] for r in N.numbered(rows, table, ["list"]).collect()} == {1: "1.", 2: "2.", None: "3."}


def test_no_lists(spark):
    none = spark.createDataFrame([], "doc_id int, node long, parent long, pos long, kind string, style string, start int")
    table = spark.createDataFrame([], "list_style string, level int, num_type string, prefix string, suffix string, first int")
    assert N.items(none, table).collect() == []


@pytest.mark.parametrize(
    ("elements", "out"),
    [
        ([("p", "“abre"), ("p", "segue"), ("p", "fecha”.")], [0, 1, 2]), ([("p", "“abre"), ("title", "TÍTULO"), ("p", "fecha”.")], []), ([("p", "“abre"), ("list", None), ("p", "fecha”.")], []), ([("p", "“abre"), ("table", None), ("p", "fecha”.")], []),
        ([("p", "“abre"), ("title", "  "), ("p", ""), ("p", "fecha”.")], [0, 3]), ([("title", "“abre"), ("p", "fecha”."), ("p", "“a"), ("p", "b”")], [2, 3]), ([], []),
    ],
)
def test_quotations_among_titles(spark, elements, out):
    frame = spark.createDataFrame([(7, i, k, t) for i, (k, t) in enumerate(elements)], "doc_id int, pos int, kind string, text string")
    assert sorted(r["pos"] for r in N.quotations(frame).collect()) == out
