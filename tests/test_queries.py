"""Every library query that has SQL, against DuckDB on the same tables; the others give rows, and the same ones each time."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from lodestream.plans import matching_queries, report_queries  # noqa: F401  register their queries
from lodestream.plans.queries import ORACLE_SQL, QUERIES

from .conftest import DATA, ROOT

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19].replace("T00:00:00", "")
    if hasattr(value, "__float__"):
        return f"{float(value) + 0.0:.6g}"
    return str(value)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    out = QUERIES[name](spark, DATA)
    found = [tuple(r) for r in out.collect()]
    if name not in ORACLE_SQL:
        assert canon(out.columns, found) == canon(out.columns, [tuple(r) for r in QUERIES[name](spark, DATA).collect()])
        return
    got = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(out.columns)
    assert canon(out.columns, found) == canon(columns, got.fetchall())


@pytest.mark.parametrize("left", ["nothing", "an empty folder", "the pipeline alone"])
def test_entry_imports_without_a_session_and_without_the_llm_folder(tmp_path, left):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/lodestream", tmp_path / "lodestream", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if left == "an empty folder":
        (tmp_path / "lodestream" / "llm").mkdir()
    if left == "the pipeline alone":
        (tmp_path / "corpus_pipeline.py").write_text("from lodestream.llm import bpe\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 130 and 'pipeline' not in q and not any(k.startswith('op1_') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
