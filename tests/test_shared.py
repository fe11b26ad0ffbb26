"""The folder for intermediate tables where no checkpoint folder is set."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
from pyspark.sql import SparkSession
from tessella.sources.shared import new_folder, shared_root
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", "{path}/house").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", None)
root = shared_root(spark)
assert root.startswith("file:{path}/house/") or root.startswith("{path}/house/"), root
assert shared_root(spark) == root and new_folder(spark, "a") != new_folder(spark, "a")
spark.range(3).write.parquet(new_folder(spark, "a"))
print("written")
spark.stop()
"""


def test_a_folder_in_the_warehouse_that_goes_with_the_session(tmp_path):
    out = subprocess.run([sys.executable, "-c", CODE.format(path=tmp_path)], cwd=ROOT, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and "written" in out.stdout, out.stderr[-2000:]
    assert not list((tmp_path / "house").glob("_shared-*"))


def test_a_checkpoint_folder_that_is_set_is_used(spark):
    from tessella.sources.shared import shared_root

    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
