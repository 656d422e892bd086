"""Workers that have no copy of this package, and samples of ids that share many rows."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from starfold.llm.arrow import at_most

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = """
import sys
sys.path.insert(0, {root!r})
from starfold.session import local_session
from starfold.llm.queries import QUERIES
spark = local_session("4", 4)
assert spark.sparkContext.parallelize([0]).map(lambda _: __import__("importlib.util").util.find_spec("starfold") is None).first()
for name in sys.argv[1:]:
    assert QUERIES[name](spark, {sf!r}).count() >= 0
    print("ran", name)
"""


def test_workers_without_the_package(tmp_path, sf_dir):
    names = ["op1_byte_bpe", "op3_toxicity", "op6_latent_retrieval", "op8_co_training", "op11_prefix_trie", "op12_permutation_index", "op13_filter_audit"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", RUN.format(root=ROOT, sf=sf_dir), *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.stdout.split("ran ")[1:] == [f"{n}\n" for n in names], done.stderr[-3000:]


def test_a_sample_is_bounded_by_rows(spark):
    rows = spark.range(4000).select(F.lit(7).alias("id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    assert 0 < at_most(rows, 100).count() < 200
    same = spark.range(4000).select(F.lit(7).alias("id"), F.lit("one").alias("text"))
    assert at_most(same, 100).count() <= 1 and at_most(rows.limit(150), 100).count() == 150
