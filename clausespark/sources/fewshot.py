"""Question-answer examples from JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausespark import constants as K
from clausespark.functions import text as X


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Array-of-objects files; entries that are not objects come out null and fall away in cleaning."""
    return spark.read.schema("question string, answer string").json(path, multiLine=True)


def clean_examples(raw: DataFrame) -> DataFrame:
    """Repaired, apostrophe-folded examples; blank ones and those still damaged are dropped."""
    tidy = lambda name: X.squeeze(X.fold_apostrophes(X.repair_mojibake(name)))
    df = raw.withColumn("question", tidy("question")).withColumn("answer", tidy("answer"))
    good = lambda name: (F.col(name) != "") & ~F.col(name).rlike(K.APOSTROPHE_MOJIBAKE)
    return df.where(good("question") & good("answer"))
