import io

import pytest

from larkspur import shell
from larkspur.functions.types import EngineError, schema
from larkspur.session import Session
from larkspur.sources.catalog import Catalog
from larkspur.sources.tables import compact
from larkspur.sources.text import read_text, write_text

COLUMNS = "suppkey INT, name STRING, address STRING, nationkey INT, phone STRING, acctbal DOUBLE, comment STRING"
LINES = [
    "2|North Mill|Quay 4|5|15-555-0101|4032.680000|opens late, ships early|",
    "10000|South Mill||19|29-555-0102|8968.420000|#|",
    '7|say "x"||19||-1.500000||',
]


@pytest.fixture
def session(spark, tmp_path):
    (tmp_path / "s.tbl").write_text("\n".join(LINES[:2]) + "\r\n" + LINES[2] + "\n")
    return Session(spark, str(tmp_path / "tables"), str(tmp_path / "catalog.json"))


def test_load_dump_and_reload(session, tmp_path):
    session.sql(f"CREATE TABLE s ({COLUMNS});")
    assert session.table("s").collect() == [] and session.catalog.table("s").tuple_count == 0
    assert session.load("s", str(tmp_path / "s.tbl")) == 3
    session.dump("s", str(tmp_path / "out"))
    assert sorted(x for p in (tmp_path / "out").glob("part*") for x in p.read_text().splitlines()) == sorted(LINES)
    assert session.load("s", str(tmp_path / "out")) == 3  # replaces
    info = session.catalog.table("s")
    assert info.distinct_counts["nationkey"] == 2 and info.file_type == "heap"
    again = Session(session.spark, session.directory, session.catalog.path)
    assert again.catalog.table("s") == info and again.table("s").count() == 3
    with pytest.raises(EngineError, match="exists"):
        session.sql(f"CREATE TABLE s ({COLUMNS})")


@pytest.mark.parametrize("line", ["1|a|", "1|a|2.5", "x|a|2.5|", "1|a|b|", "1|a|2.5|more|"])
def test_bad_lines_fail_the_read(spark, tmp_path, line):
    (tmp_path / "bad.tbl").write_text(line + "\n")
    with pytest.raises(Exception, match="not 3 fields|no int|no double"):
        read_text(spark, str(tmp_path / "bad.tbl"), schema(("a", "int"), ("b", "string"), ("c", "double"))).collect()


def test_a_load_that_fails_leaves_the_table(session, tmp_path):
    session.sql("CREATE TABLE t (k INT, v STRING)")
    (tmp_path / "good.tbl").write_text("1|a|\n2|b|\n")
    (tmp_path / "bad.tbl").write_text("3|c|\nx|d|\n")
    session.load("t", str(tmp_path / "good.tbl"))
    with pytest.raises(Exception, match="no int"):
        session.load("t", str(tmp_path / "bad.tbl"))
    assert sorted(r["k"] for r in session.table("t").collect()) == [1, 2] and session.catalog.table("t").tuple_count == 2
    # A crash between the renames: the old rows are found beside.
    (tmp_path / "tables/t").rename(tmp_path / "tables/t.old")
    assert session.table("t").count() == 2
    session.append("t", session.spark.createDataFrame([(3, "c")], "k int, v string"))
    assert session.table("t").count() == 3
    session.load("t", str(tmp_path / "good.tbl"))
    assert session.table("t").count() == 2


def test_compact_and_layout(session):
    session.sql("CREATE TABLE o (k INT, v STRING) AS BPLUSTREE ON k")
    session.sql("CREATE TABLE h (k INT, v STRING)")
    rows = session.spark.range(100).selectExpr("cast(id as int) AS k", "cast(id as string) AS v")
    for name in ("o", "h"):
        session.append(name, rows)
        session.append(name, rows)
        session.compact(name)
        assert session.table(name).count() == 200
    files = session.layout("o").collect()
    assert sum(f["rows"] for f in files) == 200 and all(a["high"] <= b["low"] for a, b in zip(files[:-1], files[1:]))
    assert session.tables(["o", "h"]).count() == 400


def test_catalog_in_a_file_system_of_the_session(spark, tmp_path):
    path = f"file://{tmp_path}/catalog.json"
    s = Session(spark, f"file://{tmp_path}/tables", path)
    s.sql("CREATE TABLE t (k INT)")
    s.append("t", spark.range(1500).selectExpr("cast(id % 700 as int) AS k"))
    again = Session(spark, s.directory, path)
    assert again.catalog.table("t").distinct_counts == {"k": 700} and again.table("t").count() == 1500


def test_bools_in_text(spark, tmp_path):
    df = spark.createDataFrame([(True,), (False,)], "b boolean")
    write_text(df, str(tmp_path / "b"))
    assert sorted(r["b"] for r in read_text(spark, str(tmp_path / "b"), schema(("b", "bool"))).collect()) == [False, True]
    with pytest.raises(EngineError):
        write_text(spark.sql("SELECT array(1) AS a"), str(tmp_path / "c"))


def test_ordered_tables(session, tmp_path):
    session.sql("CREATE TABLE o (k INT, v STRING) AS BPLUSTREE ON k")
    session.append("o", session.spark.range(1000).selectExpr("cast(999 - id as int)", "cast(id as string)"))
    session.append("o", session.spark.createDataFrame([(500, "x")], "k int, v string"))
    assert session.catalog.table("o").tuple_count == 1001 and session.catalog.table("o").file_type == "ordered"
    compact(session.spark, session.catalog.table("o"))
    parts = session.table("o").rdd.glom().map(lambda p: [r["k"] for r in p]).collect()
    assert all(p == sorted(p) for p in parts) and sum(map(len, parts)) == 1001
    assert session.sql("SELECT o.v FROM o AS o WHERE o.k = 500").count() == 2
    with pytest.raises(EngineError, match="ordered by"):
        session.sql("CREATE TABLE p (k INT) AS BPLUSTREE ON q")
    with pytest.raises(EngineError, match="columns"):
        session.append("o", session.spark.range(1))


def test_catalog_values(tmp_path):
    c = Catalog(str(tmp_path / "c.json"))
    c.put("a", "text")
    c.put("b", ["x", "y#|"])
    c.put("n", 5)
    c.save()
    again = Catalog.open(c.path)
    assert (again.get_string("a"), again.get_strings("b"), again.get_int("n"), again.get_int("none")) == ("text", ["x", "y#|"], 5, None)
    with pytest.raises(EngineError):
        again.get_int("a")


def test_shell(session, tmp_path):
    out = io.StringIO()
    source = f"create table s (\n {COLUMNS}); dropped\nLoad s From {tmp_path}/s.tbl;\nSELECT s.name, s.acctbal + 1 FROM s AS s WHERE s.suppkey = 7;\nSELECT nonsense;\nload q from x;\nquit;\nSELECT s.name FROM s AS s;\n"
    shell.run(session, io.StringIO(source), out)
    text = out.getvalue()
    assert "table created" in text and "3 rows loaded" in text and 'say "x"|-0.500000|' in text
    assert "error at line 1: syntax error" in text and "no table 'q'" in text and text.count(shell.PROMPT) == 6
