"""Executors need not have the package: all queries run in a session whose workers cannot import it."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
sys.path.insert(0, {repo!r})
from tenura.session import local_session
from tenura.llm import queries
spark = local_session("4", "no package")
found = spark.range(4, numPartitions=2).mapInArrow(lambda bs: (__import__("pyarrow").RecordBatch.from_pydict({{"x": [__import__("importlib.util").util.find_spec("tenura") is not None]}}) for b in bs), "x boolean").collect()
assert not any(r["x"] for r in found), "the workers see the package"
for name, query in queries.QUERIES.items():
    print(name, query(spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_queries_run_on_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    extra = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != REPO]
    if extra:
        env["PYTHONPATH"] = os.pathsep.join(extra)
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.split()) >= 26
