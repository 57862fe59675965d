"""Label comparison: tolerant match, canonical key and binary reading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from abstain_eval.functions.text import normalised, strip


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _integer(c: Column, pattern: str) -> Column:
    text = strip(c)
    return F.when(text.rlike(pattern), F.replace(text, F.lit("_"), F.lit("")).try_cast("decimal(38,0)"))


def labels_match(prediction, truth) -> Column:
    """Equal as integers when both are integers, else equal as trimmed lower-case text.

    Integers may have a sign, and single underscores between digits.
    """
    prediction, truth = _col(prediction), _col(truth)
    signed = r"^[+-]?[0-9]+(_[0-9]+)*$"
    as_number = _integer(prediction, signed) == _integer(truth, signed)
    as_text = normalised(prediction) == normalised(truth)
    return F.coalesce(as_number, F.lit(False)) | F.coalesce(as_text, F.lit(False))


def label_key(c) -> Column:
    """Class key of a label. Unlike labels_match a plus sign makes it text."""
    c = _col(c)
    number = _integer(c, r"^-?[0-9]+$").cast("string")
    return F.coalesce(F.concat(F.lit("int:"), number), F.concat(F.lit("str:"), normalised(c)))


def binary_label(c) -> Column:
    """0 or 1, null for anything else."""
    text = strip(_col(c))
    return F.when(text == "0", 0).when(text == "1", 1)
