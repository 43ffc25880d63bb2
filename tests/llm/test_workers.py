"""Queries whose workers cannot import the package: functions and data reach them by value."""

from __future__ import annotations

import pathlib
import subprocess
import sys

REPO = pathlib.Path(__file__).resolve().parent.parent.parent
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate())
sys.path.insert(0, sys.argv[1])
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
for name in sys.argv[3:]:
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_need_no_package(tmp_path):
    # The package is on the driver's path alone, and only once the workers' path is fixed.
    names = ["op2_mixing", "op3_quality_votes", "op4_bpe", "op9_toxicity", "op13_fill_middle"]
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, str(REPO), str(tmp_path / "shared"), *names],
        cwd=tmp_path, capture_output=True, text=True, timeout=900,
    )
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.split() == [w for n in names for w in (n, "200")]
