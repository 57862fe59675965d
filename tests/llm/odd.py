"""Tables with every awkward row: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that operators use inside.
CLASHING = "row key f k score p bucket draw copy n_copies rate component_id kept_key id code label part range extra order".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

PLAIN = "The river runs to the sea and the road follows it over the hills."
LONG = " ".join(f"word{i % 977} again" for i in range(40_000))


def rows() -> list[tuple]:
    return [
        (1, PLAIN, "en", "a", 66),
        (1, PLAIN, "en", "a", 66),
        (2, PLAIN, "en", "a", 66),
        (3, PLAIN + " Yes.", None, "b", 71),
        (4, "", "en", "b", 0),
        (5, None, "en", None, None),
        (6, " \t\n ", "de", None, 4),
        (7, LONG, "en", "a", len(LONG)),
        (8, LONG + " end", "en", "a", len(LONG) + 4),
        (9, "日本語 テスト 😀 İß", "ja", "c", 12),
        (10, "123 456 !!", "en", "c", 10),
        (None, PLAIN, "en", "a", 66),
        (None, "no id here", "en", None, 10),
        (None, "no id here", "en", None, 10),
        (None, None, None, None, None),
        (-5, "negative id", "en", "b", 11),
    ]


def documents(spark: SparkSession, empty: bool = False) -> DataFrame:
    df = spark.createDataFrame([] if empty else rows(), SCHEMA)
    return df.withColumns({name: F.lit(name) for name in CLASHING})


def labels(spark: SparkSession, empty: bool = False) -> DataFrame:
    found = [(1, 1, 0), (1, 0, None), (2, 0, 1), (3, 1, 0), (4, None, 1), (None, 1, 1), (7, 1, 0), (8, 0, 1), (99, 1, 1), (10, 0, 0)]
    return spark.createDataFrame([] if empty else found, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
