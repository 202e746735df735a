"""Cases of the third round: shuffle files on disk, memory of workers."""

import glob
import time

from pyspark.sql import functions as F

from tidemark.llm import common, suffix_dedup


def test_released_files_of_the_last_query_go(spark, tmp_path):
    disks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in disks for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    before = files()
    common.written(spark.range(20_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.collect_list("id").alias("x")), "released")
    own = files() - before
    assert own
    common.release(spark)
    end = time.time() + 20
    while own & files() and time.time() < end:
        time.sleep(0.1)
    assert not own & files()


def test_groups_of_suffixes_give_memory_back(spark, monkeypatch):
    named, trimmed = [], suffix_dedup.trimmed
    monkeypatch.setattr(suffix_dedup, "trimmed", lambda owner, f: named.append((owner, f.__name__)) or trimmed(owner, f))
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more")], "doc_id long, text string")
    got = {r["row"]: [tuple(x) for x in r["removed"]] for r in suffix_dedup.repeated_passages(docs).collect()}
    assert sorted(got.values()) == [[], [(0, 60)]]
    assert {f for o, f in named if o == "suffix"} == {"equal", "extended", "gather"}
