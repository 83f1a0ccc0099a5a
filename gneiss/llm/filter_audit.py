"""Interaction audit of filters: what each removes in every order of application.

The orders are the paths of a trie, walked depth first. A node holds the rows that survive the filters on its
path, as a persisted DataFrame made of its parent's by one more filter. Nodes whose paths have the same
filters have the same survivors, so a node is made once for each set of filters (2^n of them in place of n! paths)
and its counts are kept. One job a node counts what every filter that is left removes from its survivors; a node's rows are given
back when its subtree is done, so at most n of them are held at a time.

Texts are read once: what persists is a row of flags for each document, written to the shared folder, from which lost
partitions are made again. Everything that is told of an order comes from the counted edges: what a filter finds
first removes all that fail it; last, those that fail it alone; and each edge lies on |S|! (n - 1 - |S|)! orders.

Defined results: null texts are empty; a null language is the part of the empty string; a document without a label is
neither good nor toxic, one with several labels is what any of them says; rows that repeat a doc_id count each, and a
text's rows of the smallest doc_id are no repeats of it; rows without doc_id have no smaller one and are none's smaller; an empty table
gives no rows; texts of any length are read whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import durable, tidy, with_ids

#: White space of the contracts, as trim takes it, and as a class of expressions.
WHITE, WHITE_RUN = " \t\n\x0b\f\r", r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_RUN))


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at a text alone, each true where the text fails it."""
    words = _words(text)
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals.cast("long") > 3 * F.char_length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


@tidy
def flags(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, str]:
    """(part, good, toxic and a flag for each filter) of every document, and the filters' names.

    Repeats (E) are found by SHA-256 of the texts: digests alone shuffle, pre-aggregated, and only those that repeat are
    joined back, a join of written tables whose large keys Spark splits.
    """
    docs, labels = with_ids(docs, "doc_id"), with_ids(labels, "doc_id")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(c.alias(n) for n, c in text_failures(F.col("text")).items()))
    rows = durable(rows)
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    repeated = durable(groups.where("n > 1").select("digest", "first_id"))
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    rows = rows.join(repeated, "digest", "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)))
    told = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    rows = rows.join(durable(marks), "doc_id", "left")
    return durable(rows.select("part", told("good").alias("good"), told("bad").alias("toxic"), *"ABCDE")), "ABCDE"


def _edges(survivors: DataFrame, done: int, left: list[int], names: str) -> DataFrame:
    """(part, done, filter, present, removed, good_lost, toxic_lost) of the edges that leave a node; ``done`` has a bit a filter."""
    fails = {i: F.col(names[i]) for i in left}
    counts = survivors.groupBy("part").agg(
        F.count(F.lit(1)).alias("present"),
        *(F.count_if(fails[i]).alias(f"removed{i}") for i in left),
        *(F.count_if(fails[i] & F.col("good")).alias(f"good{i}") for i in left),
        *(F.count_if(fails[i] & F.col("toxic")).alias(f"toxic{i}") for i in left),
    )
    each = F.array(*(F.struct(F.lit(i).alias("filter"), *(F.col(f"{c}{i}").alias(n) for c, n in (("removed", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost")))) for i in left))
    return counts.select("part", F.lit(done).alias("done"), "present", F.inline(each))


def walk(rows: DataFrame, names: str, told: Callable[[DataFrame], None]) -> None:
    """Walk the trie of all orders of the filters ``names`` (boolean columns, true where a row fails) depth first and
    give ``told`` the counts of the edges of each node, once for each set of filters."""
    met: set[int] = set()

    def visit(survivors: DataFrame, done: int) -> None:
        met.add(done)
        left = [i for i in range(len(names)) if not done >> i & 1]
        held = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        told(_edges(held, done, left, names))
        for i in left:
            after = done | 1 << i
            if len(left) > 1 and after not in met:
                visit(held.where(~F.col(names[i])), after)
        held.unpersist()

    visit(rows, 0)


def audit(rows: DataFrame, names: str) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``rows`` has part, good, toxic and a boolean for each filter, true where the row fails it; ``names`` has a letter a filter.
    """
    counted: list[DataFrame] = []
    walk(rows, names, lambda edges: counted.append(durable(edges)))
    spark, n, full = rows.sparkSession, len(names), (1 << len(names)) - 1
    edges = counted[0]
    for more in counted[1:]:
        edges = edges.unionByName(more)
    # Parts that nothing of is left at a node have no row there: zeros.
    nodes = [(done, i) for done in range(full) for i in range(n) if not done >> i & 1]
    every = F.from_json(F.lit(json.dumps([{"done": d, "filter": i} for d, i in nodes])), "array<struct<done: int, filter: int>>")
    parts = counted[0].where("done = 0 and filter = 0").select("part", F.inline(every))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    edges = parts.join(edges, ["part", "done", "filter"], "left").select("part", "done", "filter", *map(zero, ("present", "removed", "good_lost", "toxic_lost")))
    orders = [
        ("".join(names[i] for i in order), step + 1, sum(1 << i for i in order[:step]), order[step])
        for order in itertools.permutations(range(n)) for step in range(n)
    ]
    weight = F.element_at(F.array(*(F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n))), F.bit_count("done") + 1)
    own = Window.partitionBy("part", "filter")  # 2^(n-1) rows
    at = lambda where: F.max(F.when(where, F.col("removed"))).over(own)
    edges = edges.select(
        "part", "done", "filter", (F.col("present") - F.col("removed")).alias("kept"), "removed", (at(F.col("done") == 0) - F.col("removed")).alias("redundant"),
        at(F.bit_count("done") == n - 1).alias("unique_fails"), "good_lost", "toxic_lost", F.sum(F.col("removed") * weight).over(own).alias("shapley"),
    )
    orders = pa.table(dict(zip(("filter_order", "step", "done", "filter"), map(list, zip(*orders, strict=True)), strict=True)))
    paths = F.broadcast(spark.createDataFrame(orders).select("filter_order", *(F.col(c).cast("int") for c in ("step", "done", "filter"))))  # n * n! rows
    return edges.join(paths, ["done", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


@tidy
def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit`` of the five filters of ``flags`` over documents (doc_id, text, lang) and labels (doc_id, quality, toxic)."""
    return audit(*flags(docs, labels))
