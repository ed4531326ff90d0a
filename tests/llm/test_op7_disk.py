"""op7: the shuffles of finished steps leave the disk before the next step writes."""

import time

from folio.llm import op7_substrings as op7
from folio.llm.common import forget


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().endswith(".data")}


def test_counts_go_before_windows_are_written(spark, monkeypatch):
    texts = spark.createDataFrame([(i, " ".join(f"w{i % 3}x{j}" for j in range(120))) for i in range(9)], "tid long, text string")
    forget(texts, keep=True)
    time.sleep(2)
    before, left, write = shuffle_files(spark), [], op7.saved

    def saved(df):
        end = time.time() + 8
        while time.time() < end and shuffle_files(spark) - before:
            time.sleep(0.2)
        left.append(shuffle_files(spark) - before)
        return write(df)

    monkeypatch.setattr(op7, "saved", saved)
    assert op7.shared_windows(texts).count()
    assert left == [set()]
