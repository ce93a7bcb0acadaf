"""The package reaches Python workers that were started in another folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from quayside.session import build, configure
from quayside.operators.neighbours import nearest_neighbours
spark = build("away", "local[2]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": sys.argv[2]})
spark.sparkContext.setLogLevel("ERROR")
configure(configure(spark))
rows = spark.createDataFrame([(i, [float(i * i), 1.0]) for i in range(5)], "id long, x array<double>")
print("FOUND", sorted(tuple(r)[:2] for r in nearest_neighbours(rows, "id", "x").collect()))
"""


def test_tasks_import_the_package_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    command = [sys.executable, "-c", SCRIPT, ROOT, str(tmp_path / "shared")]
    done = subprocess.run(command, cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "FOUND [(0, 1), (1, 0), (2, 1), (3, 2), (4, 3)]" in done.stdout, done.stderr[-2000:]
