"""Reviewed cases and recorded baselines as files."""

from __future__ import annotations

import datetime
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.schemas import GOLDEN_SET
from gneiss.sources.store import write_json


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(cases with qid in file order, the ticker they were written for)."""
    whole = spark.read.schema(GOLDEN_SET).json(path, multiLine=True)
    home = whole.select(F.coalesce("corpus.ticker", F.lit(""))).first()[0]
    rows = whole.select(F.posexplode("cases").alias("pos", "c")).select(F.format_string("q%04d", "pos").alias("qid"), "c.*")
    return rows, home


def select_cases(cases: DataFrame, home: str, ticker: str | None = None, only_checkable: bool = False) -> tuple[DataFrame, bool]:
    """(cases to run, whether the company is the one they were written for).

    Another company is scored on portable cases only; checkable ones have a recorded fact.
    """
    at_home = not ticker or ticker.upper() == home
    rows = cases if at_home else cases.where(F.coalesce("portable", F.lit(False)))
    if only_checkable:
        rows = rows.where(F.size(F.coalesce("expect_answer_contains", F.array().cast("array<string>"))) > 0)
    return rows, at_home


def read_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """The one row of counts of a recorded run; None where there is no file."""
    if not Path(path).is_file():
        return None
    stats = json.loads(Path(path).read_text())["stats"]
    return spark.createDataFrame([tuple(stats.values())], ", ".join(f"{name} long" for name in stats))


def write_baseline(path: str, stats: DataFrame, mode: str, complete: bool) -> None:
    """Record a run; only a complete one, at home, is comparable."""
    if not complete:
        raise ValueError("only a run of all cases on their own company is recorded")
    recorded = {"recorded": datetime.date.today().isoformat(), "mode": mode, "stats": stats.first().asDict()}
    write_json(path, json.dumps(recorded, indent=2))
