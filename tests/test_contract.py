import subprocess
import sys

from conftest import ROOT


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and all(any(k.startswith(f"p{n}_") for k in q) for n in (2, 4, 5))


def test_entry(spark):
    import os

    import __spark_entry__ as e

    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() > 0


def test_core_works_without_llm(tmp_path):
    import os
    import shutil

    for name in ("laserloom", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "laserloom" / "llm", ignore_errors=True)
    code = "import importlib, pkgutil, laserloom, __spark_entry__ as e\nfor m in pkgutil.walk_packages(laserloom.__path__, 'laserloom.'): importlib.import_module(m.name)\nassert 'p2_found' in e.queries() and 'p1_found' not in e.queries()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env)
