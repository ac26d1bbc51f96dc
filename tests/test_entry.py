"""The driver contract: entry() runs on sf0.001 with a stable schema, and every
oracle key names a registered query."""

import __spark_entry__ as entry


def test_entry_rows_and_stable_schema(spark):
    a = entry.entry(spark)
    rows = a.collect()
    assert len(rows) > 0
    assert entry.entry(spark).schema == a.schema
    assert {"event_id", "max_abs_z", "status"} <= set(a.columns)
    assert all(r.status == "Critical" for r in rows)


def test_oracle_keys_are_queries():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 70


def test_python_functions_run_from_another_folder(tmp_path):
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.abspath(entry.__file__))
    script = tmp_path / "elsewhere.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {repo!r})
from ohmflow.operators import isoforest
from ohmflow.session import build_session, ship_package
spark = build_session("local[2]", 2)
ship_package(spark)
ship_package(spark)
df = spark.range(50).selectExpr("id", "sin(id) as a")
print("nodes", isoforest.fit(df, ["a"], "id", trees=2).count())
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env["OHMFLOW_DRIVER_MEMORY"] = "1g"
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("nodes")[1]) > 2
