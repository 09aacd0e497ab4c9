"""Python workers that cannot import this package: every operator's functions and broadcasts travel whole."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", {scratch!r}).getOrCreate())
import __spark_entry__ as contract
queries = contract.queries()
for name in {names!r}:
    assert queries[name](spark, "/root/testdata/sf0.001").count() > 0, name
    print("done", name)
"""
NAMES = ["op2_embedding_dedup", "op4_toxicity", "op5_language_id", "op11_conversation_trie", "op12_importance_resampling", "op13_exact_top_k", "pipeline"]


def test_queries_run_from_any_folder(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(repo=REPO, scratch=str(tmp_path / "scratch"), names=NAMES))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ended = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert ended.returncode == 0, ended.stderr[-3000:]
    assert [line.split()[1] for line in ended.stdout.splitlines() if line.startswith("done")] == NAMES
