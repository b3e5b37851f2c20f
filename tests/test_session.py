"""The session: checkpoint folder with and without a setting, package on the workers, guarded entry."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

FROM_ELSEWHERE = """
import sys
sys.path.insert(0, {repo!r})
from pressroom.session import checkpoint_dir, get_spark, scratch_path
from pyspark.sql import functions as F
extra = {{"spark.ui.enabled": "false"}}
if {folder!r}:
    extra["spark.checkpoint.dir"] = {folder!r}
spark = get_spark("local[2]", shuffle_partitions=2, extra=extra)
assert spark.conf.get("spark.checkpoint.dir", None) == ({folder!r} or None)
first = checkpoint_dir(spark)
assert checkpoint_dir(spark) == first and scratch_path(spark, "x").startswith(first)
assert {folder!r} in first
assert spark.range(3).checkpoint().count() == 3
from pressroom.sources.profiles import NEWS_PROFILES

def run(batches):
    from pressroom.functions.vectors import units
    for b in batches:
        yield b

assert spark.range(4).mapInArrow(run, "id long").count() == 4
print("fine")
"""


def _run(tmp_path, folder):
    code = FROM_ELSEWHERE.format(repo=REPO, folder=folder)
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_CONF_DIR")}
    (tmp_path / "conf").mkdir()
    env["SPARK_CONF_DIR"] = str(tmp_path / "conf")
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in out.stdout, out.stderr[-3000:]


def test_without_a_setting(tmp_path):
    _run(tmp_path, "")


def test_with_a_setting(tmp_path):
    _run(tmp_path, str(tmp_path))


def test_entry_without_a_library_of_the_training_operators(tmp_path):
    code = """
import sys
sys.modules["ahocorasick"] = None
import __spark_entry__ as E
names = E.queries()
assert "listing_flagship" in names and "pipeline" not in names and not any(n.startswith("op1") for n in names)
assert set(E.oracle_sql()) <= set(names)
print("fine")
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert "fine" in out.stdout, out.stderr[-3000:]
