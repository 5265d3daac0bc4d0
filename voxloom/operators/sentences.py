"""Sentences: where a word ends one, as a Column and as a plain function."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Abbreviations that end no sentence.
ABBREVIATIONS = ("mr.", "mrs.", "dr.", "st.", "vs.", "no.")
_STAYS = rf"^(?:[0-9]+[.]|{'|'.join(a.replace('.', '[.]') for a in ABBREVIATIONS)})$"


def ends_sentence(word: str) -> bool:
    return word[-1:] in (".", "?", "!") and not re.search(_STAYS, word.lower())


def ends(word: Column) -> Column:
    return word.rlike("[.?!]$") & ~F.lower(word).rlike(_STAYS)


def split(words: DataFrame, key: str = "id", pos: str = "pos", word: str = "word") -> DataFrame:
    """``words`` with ``sentence``, numbered from 0: how many words before ended one."""
    before = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return words.withColumn("sentence", F.coalesce(F.sum(ends(F.col(word)).cast("int")).over(before), F.lit(0)))
