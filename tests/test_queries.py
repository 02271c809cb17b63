"""Every query against its SQL in DuckDB, over whole small tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query(spark, duck, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert rows or name.startswith("op")
        return
    got = duck.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(rows, df.columns) == plain(got.fetchall(), names)


def test_every_line_is_rated_as_a_heading_or_not(spark):
    rows = E.queries()["l5_line_headings"](spark, SF).groupBy("corpus", "level").count().collect()
    n = {(r["corpus"], r["level"]): r["count"] for r in rows}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert n["documents", 0] == sum(r.text.count("\n") + 1 for r in docs.where("text is not null").collect())
    assert n["markers", 1] == 3 * spark.read.parquet(f"{SF}/customer.parquet").count() and {k for c, k in n if c == "legal"} >= {0, 2}


def test_entry(spark):
    assert E.entry(spark).count() == 4


def test_all_works_without_the_training_data_operators(tmp_path):
    import shutil

    root = Path(E.__file__).parent
    shutil.copytree(root / "folioflow", tmp_path / "folioflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
