"""Every query of the document operators runs; those with SQL give DuckDB's rows."""

import math

import duckdb
import pytest

from docblocks.plans import reference

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = reference.queries(), reference.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    got = frame.collect()
    if name not in ORACLES:
        assert got
        return
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows_of(frame.columns, got) == rows_of(names, result.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_column_widths_see_every_line(spark, tmp_path):
    """A long line beyond the first four makes its column wide, as if the cells above it were not there."""
    short = ["a b", "a b", "a b", "a b"]
    texts = [(1, "\n".join(short)), (2, "\n".join([*short, "a", "word " * 20, "a"])), (3, "a b\n" + "word " * 20 + "\na b\na b"), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["col"]): r["width"] for r in QUERIES["column_widths"](spark, str(tmp_path)).collect()}
    assert [got[1, k] for k in range(4)] == [25.0] * 4
    assert [got[2, k] for k in range(4)] == [got[3, k] for k in range(4)]
    assert got[2, 1] > 25.0 and len(got) == 12


BODY_LINES = "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_quantity DOUBLE"


def body_sizes(spark, folder, rows, files):
    """The query's and its SQL's (order, size) of ``rows`` dealt in turn to ``files``; the SQL on one thread, as more of them settle its ties at random."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE TABLE given ({BODY_LINES}, nth INTEGER)")
    con.executemany("INSERT INTO given VALUES (?, ?, ?, ?, ?, ?)", [(*row, i) for i, row in enumerate(rows)])
    (folder / "lineitem.parquet").mkdir(parents=True)
    for i, name in enumerate(files):
        con.execute(f"COPY (SELECT * EXCLUDE (nth) FROM given WHERE nth % {len(files)} = {i} ORDER BY nth) TO '{folder}/lineitem.parquet/{name}.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["body_font"](spark, str(folder)).collect()]
    return sorted(got, key=repr), sorted(con.execute(ORACLES["body_font"]).fetchall(), key=repr)


def test_body_font_takes_the_first_size_of_one_place(spark, tmp_path):
    """Two sizes of one weight that begin at one place: the one whose line lies first in the files, by their names, is taken."""
    sizes = [(k, (k * 7 + k // 5) % 5, (k * 7 + k // 5 + 1 + k % 4) % 5) for k in range(60)]
    first, second = [(k, 8, 1, 2, a + 5.0) for k, a, _ in sizes], [(k, 8, 1, 2, b + 5.0) for k, _, b in sizes]
    got, wanted = body_sizes(spark, tmp_path / "one", first + second, ["a"])
    assert got == wanted == sorted([(k, a + 8) for k, a, _ in sizes], key=repr)
    # every second row is of the second file, which comes first by its name
    got, wanted = body_sizes(spark, tmp_path / "two", [row for pair in zip(first, second, strict=True) for row in pair], ["b 1", "a 2"])
    assert got == wanted == sorted([(k, b + 8) for k, _, b in sizes], key=repr)


def test_body_font_on_odd_lines(spark, tmp_path):
    """Sizes are rounded, halves to the even one; an order without a size or a place keeps its row, one without lines that count has none."""
    rows = [(1, 1, 1, 1, 2.6), (2, 1, 1, 1, 2.5), (3, 1, 1, 1, 3.5), (4, 1, 1, 1, None), (5, 1, 1, None, 6.0), (6, 6, 1, 1, None), (6, 1, 1, 2, 6.0), (7, 6, 1, None, 6.0), (7, 1, 1, 2, 7.0), (8, 1, 9, 1, 6.0), (9, 7, 1, 1, 6.0), (10, 1, None, 1, 6.0)]
    rows += [(11, 1, 1, 1, 2.7), (11, 1, 1, 2, 3.2), (11, 1, 1, 3, 9.0), (None, 1, 1, 1, 9.0)]
    got, wanted = body_sizes(spark, tmp_path, rows, ["a"])
    assert got == wanted == sorted([(1, 11), (2, 10), (3, 12), (4, None), (5, None), (6, 9), (7, 10), (11, 11), (None, 12)], key=repr)
