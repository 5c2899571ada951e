import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from fringework.llm import common

CODE = """
import os, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", "file://" + sys.argv[1]).config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from fringework.llm import common, simhash
docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "x y")], "doc_id bigint, text string")
out = simhash.classes(docs)
own = [x for x in os.listdir(sys.argv[1]) if x.startswith("fringework-")]
print("LEFT", *sorted(os.listdir(f"{sys.argv[1]}/{own[0]}")))
print("ROWS", out.count())
common.release(spark)
print("RELEASED", [x for x in os.listdir(sys.argv[1]) if x.startswith("fringework-")])
simhash.classes(docs)
"""


def test_folders_go(tmp_path):
    """A query leaves what its lazy result reads and no more; release() takes that too, and so does the driver's end."""
    got = subprocess.run([sys.executable, "-c", CODE, str(tmp_path)], capture_output=True, text=True, timeout=300)
    said = dict(line.split(" ", 1) for line in got.stdout.splitlines() if line.split(" ")[0] in ("LEFT", "ROWS", "RELEASED"))
    assert said["LEFT"].split() == ["classes", "fingerprints"] and said["ROWS"] == "3" and said["RELEASED"] == "[]"
    assert not [x for x in os.listdir(tmp_path) if x.startswith("fringework-")]


def test_no_machine_local_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda *_: None)
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        spark = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master=master))
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_dir(spark)
