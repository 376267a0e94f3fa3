"""The registry loads whatever the layout of pyspark and the working folder."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code, **env):
    return subprocess.run([sys.executable, "-c", code], cwd="/tmp", capture_output=True, text=True,
                          env=os.environ | env, timeout=300)


def test_loads_from_another_folder_and_from_the_zip():
    import pyspark

    code = f"import sys; sys.path.insert(0, {ROOT!r}); import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()))"
    plain = run(code)
    assert plain.returncode == 0, plain.stderr
    zipped = os.path.join(os.path.dirname(pyspark.__file__), "python", "lib", "pyspark.zip")
    if not os.path.exists(zipped):
        zipped = next((p for p in sys.path if p.endswith("pyspark.zip")), None)
    if zipped is None:
        pytest.skip("no pyspark.zip here")
    other = run(code, PYTHONPATH=zipped)
    assert other.returncode == 0 and other.stdout == plain.stdout, other.stderr


def test_workers_need_no_copy_of_the_package():
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from corpuslens.session import local_session
import __spark_entry__ as E
s = local_session(2, app="elsewhere")
for name in ("user_function_counts", "row_importance"):
    assert E.queries()[name](s, "/root/testdata/sf0.001").count() > 0
print("fine")
"""
    done = run(code)
    assert "fine" in done.stdout, done.stderr[-2000:]


def test_cluster_needs_a_shared_folder(monkeypatch):
    from corpuslens import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())
