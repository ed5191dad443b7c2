"""Levels of common shingles come from all texts."""

import numpy as np
from pyspark.sql import functions as F

from farandole.llm import simhash


def test_levels_count_every_text(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LOAD", 1e-4)  # as a large table: a share of it was counted once
    told = spark.range(64).select("id", F.encode(F.lit("one two three four five"), "utf-8").alias("text"))
    texts = spark.createDataFrame([(12_600,)], "bytes long")  # a load of 10
    levels = np.frombuffer(simhash._common(told.where("id % 10 != 0").unionByName(told.where("id % 10 != 0")), texts, 5), np.uint8)
    assert levels.max() == 3  # 114 texts over a load of 10
