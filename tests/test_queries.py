"""Every registered query that has SQL gives what DuckDB gives on the smallest test data."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from lumberline.plans import catalogue

DATA = Path("/root/testdata/sf0.001")


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, float):
            return round(v, 6)
        return v

    df = df[sorted(df.columns)]
    out = [tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_as_sql(spark, db, name):
    got = catalogue.QUERIES[name](spark, str(DATA)).toPandas()
    want = db.execute(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_names_with_replacement_characters(spark, tmp_path):
    """Names that have U+FFFD themselves, of any share and length, come out as in SQL."""
    names = [None, "", "a", "\ufffd", "\ufffd\ufffd", "\ufffd" * 3, "\ufffd" * 40, "\ufffd" * 12 + " (0).log.1", "gr\ufffd\ufffde.json", "a\ufffd\ufffd", "世界\ufffd", "😀\ufffd😀", "app.log"]
    files = pd.DataFrame({"id": range(len(names)), "original_name": pd.Series(names, dtype="str")})
    pd.concat([files, files]).to_parquet(tmp_path / "files.parquet")
    got = catalogue.QUERIES["prj_decode_name"](spark, str(tmp_path)).toPandas()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW files AS SELECT * FROM '{tmp_path}/files.parquet'")
    assert rows(got) == rows(c.execute(catalogue.ORACLE["prj_decode_name"]).df()) and len(got) == len(names)


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).columns == ["id", "file", "line", "content", "timestamp", "level"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_archives_walk_all_levels(spark):
    got = {r.virtual_path: (r.depth, r.problem) for r in catalogue.QUERIES["src_nested"](spark, str(DATA)).collect()}
    assert got["outer.zip/inner.zip/part-0.log"] == (2, None)
    assert got["outer.zip/logs/deep.tar.gz/x/in.zip/part-2.log"] == (3, None)
    assert got["outer.zip/../evil.log"] == (1, "unsafe name")
    assert {r.problem for r in catalogue.QUERIES["src_7z"](spark, str(DATA)).collect()} == {"7z is not supported"}


def test_links_are_left_out(spark):
    got = {r.virtual_path: r.problem for r in catalogue.QUERIES["flt_symlink"](spark, str(DATA)).collect()}
    assert got == {"a.tar/a.log": None, "l.tar/l.log": "link"}


def test_tail_continues_whole_lines(spark):
    got = sorted(catalogue.QUERIES["st_tail"](spark, str(DATA)).collect())
    assert [(r.line, r.content, r.level) for r in got] == [(1, "2024-01-01 10:00:00 [INFO] one", "info"), (2, "two", "debug"), (3, "partly three", "debug"), (4, "[ERROR] four", "error")]


@pytest.mark.parametrize(("name", "packed"), [("g_risk", 500), ("a_compression", 1000)])
def test_risk_at_any_depth(spark, db, name, packed):
    """Every file of known size comes out, whatever its depth, in the SQL too; deep powers agree relatively."""
    got = {r["id"]: r for r in catalogue.QUERIES[name](spark, str(DATA)).collect()}
    want = db.execute("SELECT DISTINCT id, size, depth_level FROM files WHERE size >= 0").fetchall()
    assert len(got) == len(want) and {i for i, *_ in want} == set(got)
    assert {n is None for *_, n in want} == {True, False} and max(n for *_, n in want if n is not None) > 3
    for i, size, depth in want:
        risk = 0.0 if size == 0 else None if depth is None else (size / packed) ** (depth or 1)
        assert got[i]["risk"] == (risk if risk is None else pytest.approx(risk, rel=1e-9))
    rows_of_sql = db.execute(catalogue.ORACLE[name]).df()
    assert len(rows_of_sql) == len(got)
    for r in rows_of_sql.itertuples():
        assert got[r.id]["risk"] is None if math.isnan(r.risk) else got[r.id]["risk"] == pytest.approx(r.risk, rel=1e-9)
