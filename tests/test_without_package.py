"""Executors need not have the package: queries with code of their own run in a session whose workers cannot import it."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = ["srv7_cox_newton", "srv9_concordance_age", "srv13_aft_scores", "cau12_data_subset_weighting", "cau12_data_subset_matching", "cau13_bootstrap", "opt4_violations", "txt11_index_recall"]
CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import functions as F
import __spark_entry__ as entry_points
from tenura.operators import forest
from tenura.session import local_session
spark = local_session("4", "no package")
sys.path.remove({repo!r})
for name in {names!r}:
    print(name, entry_points.queries()[name](spark, "/root/testdata/sf0.001").count(), flush=True)
df = spark.range(600).select(F.col("id").alias("member_id"), (F.col("id") % 13 / 13.0).alias("a"), F.sin(F.col("id")).alias("rt"), F.cos(F.col("id")).alias("ry"))
print("forest", forest.grow_forest(df, "member_id", ["a"], trees=3, depth=2, min_leaf=15).predict(df).count(), flush=True)
"""


def test_queries_run_on_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    extra = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != REPO]
    if extra:
        env["PYTHONPATH"] = os.pathsep.join(extra)
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=REPO, names=NAMES)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert "forest 600" in done.stdout and len(done.stdout.split()) == 2 * len(NAMES) + 2
