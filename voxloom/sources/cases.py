"""Evaluation cases, vectors and embeddings' files, with strict checks."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a case may say.
TAGS, MODES, SORTS = ("exact", "paraphrase", "jargon", "filter", "negative", "collapse"), ("exact", "related", "smart"), ("relevance", "newest", "oldest")
ITEM = "ord int, episode bigint, at_s bigint, more_in_episode bigint, cards bigint, absent boolean"
CASE = f"case_id string, query string, tag string, modes array<string>, sort string, smoke boolean, items array<struct<{ITEM.replace(' ', ': ').replace(',:', ',')}>>"


class CaseError(ValueError):
    """What is wrong with a case file, and where."""


def _checked(where: str, given: dict, known: dict[str, Callable[[object], bool]], needed: tuple[str, ...]) -> None:
    if not isinstance(given, dict):
        raise CaseError(f"{where}: a mapping is needed")
    for name in needed:
        if name not in given:
            raise CaseError(f"{where}: {name} is missing")
    for name, value in given.items():
        if name not in known:
            raise CaseError(f"{where}: unknown key {name!r}")
        if not known[name](value):
            raise CaseError(f"{where}: {name} cannot be {value!r}")


def _count(least: int) -> Callable[[object], bool]:
    return lambda v: isinstance(v, int) and not isinstance(v, bool) and v >= least


def _time(value) -> int | None:
    if value is None or (isinstance(value, int) and not isinstance(value, bool) and value >= 0):
        return value
    parts = str(value).split(":")
    if not 2 <= len(parts) <= 3 or not all(p.isdigit() for p in parts) or any(int(p) > 59 for p in parts[1:]):
        raise CaseError(f"not a time: {value!r}")
    total = 0
    for p in parts:
        total = total * 60 + int(p)
    return total


def checked_case(raw: dict, where: str) -> tuple:
    text = lambda v: isinstance(v, str) and bool(v.strip())
    items = {"episode": _count(1), "at": lambda v: True, "more_in_episode": _count(0), "cards": _count(1)}
    _checked(where, raw, {
        "id": text, "query": text, "tag": lambda v: v in TAGS, "modes": lambda v: isinstance(v, list) and v and all(m in MODES for m in v), "sort": lambda v: v in SORTS,
        "expect": lambda v: isinstance(v, list), "expect_absent": lambda v: isinstance(v, list), "smoke": lambda v: isinstance(v, bool),
    }, ("id", "query", "tag"))
    if not raw.get("expect") and not raw.get("expect_absent"):
        raise CaseError(f"{where}: nothing is expected")
    found = []
    for name in ("expect", "expect_absent"):
        for k, item in enumerate(raw.get(name) or []):
            _checked(f"{where}, {name} {k + 1}", item, items, ("episode",))
            found.append((k, item["episode"], _time(item.get("at")), item.get("more_in_episode"), item.get("cards"), name == "expect_absent"))
    return raw["id"], raw["query"], raw["tag"], list(raw.get("modes") or ["exact", "related"]), raw.get("sort", SORTS[0]), bool(raw.get("smoke", False)), found


def read_cases(spark: SparkSession, texts: dict[str, str], load: Callable[[str], object] = json.loads) -> DataFrame:
    """Cases of files (name to text), one row a case; ids must not repeat.  ``load`` reads the text, JSON unless told otherwise."""
    rows, seen = [], set()
    for name, text in texts.items():
        raw = load(text)
        if not isinstance(raw, list):
            raise CaseError(f"{name}: a list of cases is needed")
        for k, case in enumerate(raw):
            row = checked_case(case, f"{name}, case {k + 1}")
            if row[0] in seen:
                raise CaseError(f"{name}: the id {row[0]!r} repeats")
            seen.add(row[0])
            rows.append(row)
    return spark.createDataFrame(rows, CASE)


def items_of(cases: DataFrame) -> DataFrame:
    rows = cases.select("case_id", F.explode("items").alias("i")).select("case_id", "i.*")
    return rows.withColumn("at_ms", F.col("at_s") * 1000)


def with_case(cases: DataFrame, items: DataFrame, query: str, episode: int, at_s: int | None, near_s: int = 45) -> DataFrame:
    """Ids of cases that already expect, or rule out, this passage for the same words: none means the case is new."""
    same = cases.where(F.lower(F.regexp_replace(F.trim("query"), r"\s+", " ")) == " ".join(query.lower().split())).select("case_id")
    close = F.lit(True) if at_s is None else F.col("at_s").isNull() | (F.abs(F.col("at_s") - at_s) <= near_s)
    return items.where((F.col("episode") == episode) & close).join(same, "case_id", "left_semi").select("case_id").distinct()


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """Rows (chunk_id, text_sha, embedding) of ``.npz`` files with arrays chunk_ids, text_sha and vectors, a file a task."""

    def run(batches):
        import io

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for blob in batch.column("content").to_pylist():
                with np.load(io.BytesIO(blob), allow_pickle=False) as z:
                    v = z["vectors"].astype(np.float32)
                    flat = pa.FixedSizeListArray.from_arrays(pa.array(v.reshape(-1)), v.shape[1]) if len(v) else pa.array([], pa.list_(pa.float32()))
                    sha = [str(s) for s in z["text_sha"]] if "text_sha" in z else [None] * len(v)
                    yield pa.RecordBatch.from_arrays([pa.array(z["chunk_ids"].astype(np.int64)), pa.array(sha, pa.string()), flat.cast(pa.list_(pa.float32()))], names=["chunk_id", "text_sha", "embedding"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "chunk_id bigint, text_sha string, embedding array<float>")
