import os
import subprocess
import sys
from pathlib import Path

PROGRAM = """
import sys
sys.path.insert(0, {repo!r})
from turnsift.session import build_session, ship_package
from turnsift.operators.dedup import dedup_window_role
spark = build_session("ship", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2",
                      "spark.checkpoint.dir": {shared!r}}})
ship_package(spark)
rows = spark.createDataFrame([("c", i, float(i), "p", "user", "x") for i in range(3)],
                             "convo_id string, seq long, t double, platform string, role string, content string")
rows = rows.selectExpr("*", "timestamp_micros(cast(t * 1000000 as long)) ts")
print("KEPT", dedup_window_role(rows).where("kept").count())
"""


def test_package_reaches_executors(tmp_path):
    """A query in another working directory, with workers that do not find the package by themselves."""
    repo = str(Path(__file__).parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    program = PROGRAM.format(repo=repo, shared=str(tmp_path / "shared"))
    done = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "KEPT 1" in done.stdout, done.stderr[-2000:]
