"""Scoring of answers against reviewed cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Compared with the recorded baseline: what it is called, its metric, its total.
COMPARED = (
    ("overall", "correct", "cases"),
    ("declined when it should", "declined_when_expected", "declined_total"),
    ("cited expected section", "section_hits", "section_checked"),
    ("answer states the fact", "fact_hits", "fact_checked"),
)


def fact_hit(wanted: Column, home: Column, supported: Column, answer: Column) -> Column:
    """Whether the answer states one of the facts, in any case; null where there is nothing to check."""
    lower = F.lower(F.coalesce(answer, F.lit("")))
    checked = (F.size(F.coalesce(wanted, F.array().cast("array<string>"))) > 0) & home & supported
    return F.when(checked, F.exists(wanted, lambda f: F.coalesce(lower.contains(F.lower(f)), F.lit(False))))


def section_hit(wanted: Column, supported: Column, sections: Column) -> Column:
    """Whether a cited section contains the wanted text, case for case; null where there is nothing to check."""
    checked = (F.coalesce(wanted, F.lit("")) != "") & supported
    return F.when(checked, F.exists(sections, lambda s: F.coalesce(s.contains(wanted), F.lit(False))))


def score_cases(cases: DataFrame, answers: DataFrame, home: bool = True) -> DataFrame:
    """One row for each case (qid, golden columns) with its answer's outcome."""
    have = set(answers.columns)
    rejected = F.size("rejected_citations") if "rejected_citations" in have else F.lit(0)
    rows = cases.drop("question").join(answers, "qid")
    expected = F.col("expect") == "supported"
    sections = F.transform("evidence", lambda e: e["section"])
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.select(
        "qid", "question", expected.alias("expected"), F.col("supported").alias("answered"),
        (F.col("supported") == expected).alias("correct"), flag("known_gap").alias("known_gap"),
        F.coalesce("gap_class", F.lit("")).alias("gap_class"), (F.size("citations") > 0).alias("cited"), sections.alias("sections"),
        F.col("expect_section_contains").alias("wanted_section"),
        section_hit(F.col("expect_section_contains"), F.col("supported"), sections).alias("section_hit"),
        flag("section_known_gap").alias("section_known_gap"),
        fact_hit(F.col("expect_answer_contains"), F.lit(home), F.col("supported"), F.col("answer")).alias("fact_hit"),
        "generation_error", F.greatest(rejected, F.lit(0)).alias("rejected_quotes"), "generated",
    )


def scorecard(rows: DataFrame) -> DataFrame:
    """Sixteen counts over scored cases, in one aggregate."""
    n = lambda condition: F.count_if(F.coalesce(condition, F.lit(False)))
    c = F.col
    return rows.agg(
        F.count(F.lit(1)).alias("cases"),
        n(c("expected") & c("correct")).alias("answered_when_expected"), n(c("expected")).alias("answered_total"),
        n(~c("expected") & c("correct")).alias("declined_when_expected"), n(~c("expected")).alias("declined_total"),
        n(c("correct")).alias("correct"), n(c("answered") & c("cited")).alias("cited_when_answered"), n(c("answered")).alias("answers"),
        n(c("section_hit")).alias("section_hits"), n(c("section_hit").isNotNull()).alias("section_checked"),
        n(c("fact_hit")).alias("fact_hits"), n(c("fact_hit").isNotNull()).alias("fact_checked"),
        n(c("generated")).alias("reached_model"), F.coalesce(F.sum("rejected_quotes"), F.lit(0)).cast("long").alias("rejected_quotes"),
        n(c("known_gap") & ~c("correct")).alias("open_gaps"), n(c("known_gap")).alias("gaps_recorded"),
    )


def unpivoted(stats: DataFrame) -> DataFrame:
    """(metric, value) rows of a one-row scorecard."""
    names = [n for n, kind in stats.dtypes if kind in ("bigint", "int")]
    return stats.unpivot([], [F.col(n).cast("long").alias(n) for n in names], "metric", "value")


def baseline_delta(stats: DataFrame, baseline: DataFrame) -> DataFrame:
    """(label, was, now, delta, arrow) for the compared metrics that the baseline has."""
    spark = stats.sparkSession
    labels = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(COMPARED)], "position int, label string, metric string")
    now, was = unpivoted(stats).withColumnRenamed("value", "now"), unpivoted(baseline).withColumnRenamed("value", "was")
    rows = labels.join(now, "metric").join(was, "metric")
    delta = F.col("now") - F.col("was")
    arrow = F.when(delta == 0, "same").when(delta > 0, F.concat(F.lit("+"), delta.cast("string"))).otherwise(delta.cast("string"))
    return rows.select("position", "label", "metric", "was", "now", delta.alias("delta"), arrow.alias("arrow"))


def is_partial_run(reached: Column, cases: Column, errors: Column) -> Column:
    """Whether figures mix written and excerpted answers."""
    return ((reached > 0) | (errors > 0)) & (reached < cases)


def failure_reasons(rows: DataFrame) -> DataFrame:
    return rows.agg(F.sort_array(F.collect_set(F.nullif("generation_error", F.lit("")))).alias("reasons"))


def token_totals(usage: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("long")
    return usage.agg(total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"))


def contrast(expected: DataFrame, lexical: DataFrame, hybrid: DataFrame) -> DataFrame:
    """Per question (qid, expected): whether keywords alone and hybrid retrieval answer, and are right."""
    answered = lambda rows, name: rows.select("qid").distinct().withColumn(name, F.lit(True))
    rows = expected.join(answered(lexical, "keyword"), "qid", "left").join(answered(hybrid, "hybrid"), "qid", "left")
    rows = rows.select("qid", "expected", *(F.coalesce(n, F.lit(False)).alias(n) for n in ("keyword", "hybrid")))
    return rows.select(
        "*", (F.col("keyword") == F.col("expected")).alias("keyword_correct"), (F.col("hybrid") == F.col("expected")).alias("hybrid_correct"),
        (F.col("keyword") != F.col("hybrid")).alias("disagree"),
    )


def _share(part: int, whole: int) -> str:
    return f"{part / whole * 100:5.0f}%" if whole else "   n/a"


def report(rows: DataFrame, baseline: DataFrame | None = None, mode: str = "") -> str:
    """A readable report over scored cases (at most some hundreds, brought to the driver)."""
    s = scorecard(rows).first()
    out = [f"{mode}".strip(), f"answered when it should  {s.answered_when_expected:>3}/{s.answered_total:<3}{_share(s.answered_when_expected, s.answered_total)}"]
    for label, part, whole in (
        ("declined when it should", s.declined_when_expected, s.declined_total), ("overall", s.correct, s.cases), ("cites evidence", s.cited_when_answered, s.answers),
        ("cites expected section", s.section_hits, s.section_checked), ("states the fact", s.fact_hits, s.fact_checked),
    ):
        out.append(f"{label:<25}{part:>3}/{whole:<3}{_share(part, whole)}")
    reasons = failure_reasons(rows.where("not generated")).first().reasons
    errors = rows.where("generation_error <> ''").count()
    if (s.reached_model or errors) and s.reached_model < s.cases:
        out.append(f"PARTIAL RUN: generation reached {s.reached_model}/{s.cases} cases; these figures mix two modes and measure neither")
        out += [f"  cause: {reason}" for reason in reasons]
    if s.reached_model:
        out.append(f"quotes rejected as not found in the cited evidence: {s.rejected_quotes}")
    for r in rows.where("not correct").orderBy("qid").collect():
        out.append(f"  {'[' + (r.gap_class or 'new') + ']':<20} should {'answer' if r.expected else 'decline'}: {r.question[:44]}")
    unknown = rows.where("not correct and not known_gap").count()
    if unknown:
        out.append(f"{unknown} failure(s) are not recorded as known gaps")
    for r in rows.where("known_gap and correct").orderBy("qid").collect():
        out.append(f"  closed gap: {r.question[:60]}")
    if baseline is not None:
        for r in baseline_delta(scorecard(rows), baseline).orderBy("position").collect():
            out.append(f"  {r.label:<26} {r.was:>3} -> {r.now:<3}  {r.arrow}")
    return "\n".join(line for line in out if line)
