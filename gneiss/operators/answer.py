"""From evidence to answers: an excerpt, a written answer with verified quotes, or an honest no."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.config import DEFAULTS, Settings
from gneiss.functions import text as T
from gneiss.schemas import EVIDENCE, USAGE

Generator = Callable[[str, list[dict]], dict]
# Fixed value: how a prompt ends.
ONLY_EVIDENCE = "Answer only from the evidence above, or set supported = false."


def reference(section: Column, form: Column, date: Column, url: Column) -> Column:
    return F.concat(section, F.lit(" | "), form, F.lit(" | "), date, F.lit(" | "), url)


def _filled(chunks: DataFrame) -> DataFrame:
    """Chunks with the columns that answers show, empty where a chunk has none."""
    shown = ("section", "form", "filing_date", "period_of_report", "source_url", "text")
    have = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in chunks.columns else F.lit("").alias(c) for c in shown]
    return chunks.select("chunk_id", *have)


def gathered(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, found): each question's chunks as an array of structs in rank order."""
    rows = evidence.join(_filled(chunks), "chunk_id").select("qid", F.struct("rank", "chunk_id", "section", "form", "filing_date", "period_of_report", "source_url", "text").alias("c"))
    return rows.groupBy("qid").agg(F.array_sort(F.collect_list("c")).alias("found"))  # at most Settings.evidence


def extractive(questions: DataFrame, evidence: DataFrame, chunks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One row for each question: the best chunk excerpted, with citations, or a declined answer."""
    rows = questions.select("qid", "question").join(gathered(evidence, chunks), "qid", "left")
    supported = F.col("found").isNotNull()
    best = F.col("found")[0]
    top = F.slice("found", 1, settings.evidence)
    said = F.concat(
        F.lit("Based on "), best["section"], F.lit(" and related filing text, the company states: "),
        F.substring(best["text"], 1, settings.answer_chars),
    )
    cited = F.transform(top, lambda c: reference(c["section"], c["form"], c["filing_date"], c["source_url"]))
    shown = F.transform(
        top,
        lambda c: F.struct(
            c["section"].alias("section"), c["form"].alias("form"), c["filing_date"].alias("filing_date"),
            F.substring(c["text"], 1, settings.excerpt_chars).alias("excerpt"), c["source_url"].alias("source_url"),
        ),
    )
    return rows.select(
        "qid", "question",
        F.when(supported, said).otherwise(T.UNSUPPORTED_ANSWER).alias("answer"),
        supported.alias("supported"),
        F.when(supported, cited).otherwise(F.array().cast("array<string>")).alias("citations"),
        F.when(supported, shown).otherwise(F.array().cast(f"array<{EVIDENCE}>")).alias("evidence"),
        F.when(supported, T.why_it_matters(best["section"], F.col("question"))).otherwise(T.TRY_BROADER).alias("why_it_matters"),
        F.lit(False).alias("generated"),
        F.lit("").alias("generation_error"),
    )


WRITTEN = (
    f"qid string, wrote boolean, failed string, w_supported boolean, w_answer string, w_citations array<struct<chunk_id: string, quote: string>>, "
    f"w_reason string, w_usage {USAGE}"
)


def write_answers(questions: DataFrame, evidence: DataFrame, chunks: DataFrame, generator: Generator) -> DataFrame:
    """What ``generator(question, evidence)`` returned or how it failed, for questions with evidence only.

    The generator answers {supported, answer, citations: [{chunk_id, quote}], reason, usage}. It is
    called on the driver, once a question and one after the other, when this function is called: a
    call may be paid for and paced, so no task that Spark repeats may make it. What comes to the driver
    is a batch of questions and at most ``Settings.evidence`` chunks of each, a partition at a time.
    """
    rows = questions.select("qid", "question").join(gathered(evidence, chunks), "qid")
    out = []
    for row in rows.select("qid", "question", "found").toLocalIterator():
        try:
            said = generator(row.question, [c.asDict() for c in row.found])
        except Exception as error:  # any failure of a service falls back to the excerpt
            logging.getLogger(__name__).warning("generation failed: %s", error)
            out.append((row.qid, False, str(error), None, None, None, None, None))
        else:
            cited = [(c.get("chunk_id"), c.get("quote")) for c in said.get("citations") or []]
            usage = tuple((said.get("usage") or {}).get(name) for name in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "model"))
            used = usage if any(u is not None for u in usage) else None
            out.append((row.qid, True, None, bool(said.get("supported")), said.get("answer") or "", cited, said.get("reason") or "", used))
    return questions.sparkSession.createDataFrame(out, WRITTEN)


def generated(questions: DataFrame, evidence: DataFrame, chunks: DataFrame, written: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Answers out of ``written`` rows: quotes verified, unverifiable support declined, failures excerpted.

    A supported answer of which no quote is verified is declined, and so is one without citations.
    """
    from gneiss.operators.verify import verify

    offered = written.where("w_supported").select("qid", F.posexplode("w_citations").alias("pos", "c"))
    checked = verify(offered.select("qid", "pos", F.col("c.chunk_id").alias("chunk_id"), F.col("c.quote").alias("quote")), evidence.select("qid", "chunk_id"), chunks)
    item = F.struct("pos", "chunk_id", "quote", "section", "form", "filing_date", "period_of_report", "source_url", "reason")
    gathered_ = checked.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("all"))
    base = extractive(questions, evidence, chunks, settings)
    rows = base.join(written, "qid", "left").join(gathered_, "qid", "left")
    every = F.coalesce("all", F.array().cast(f"array<struct<pos: int, chunk_id: string, quote: string, section: string, form: string, filing_date: string, period_of_report: string, source_url: string, reason: string>>"))
    good, bad = F.filter(every, lambda c: c["reason"].isNull()), F.filter(every, lambda c: c["reason"].isNotNull())
    wrote = F.coalesce("wrote", F.lit(False))
    stands = wrote & F.col("w_supported") & (F.size(good) > 0)
    reason = F.coalesce(F.nullif("w_reason", F.lit("")), F.lit(T.NOT_ANSWERED))
    pick = lambda yes, declined, fallback: F.when(stands, yes).when(wrote, declined).otherwise(fallback)
    return rows.select(
        "qid", "question",
        pick(F.col("w_answer"), F.lit(T.UNSUPPORTED_ANSWER), F.col("answer")).alias("answer"),
        pick(F.lit(True), F.lit(False), F.col("supported")).alias("supported"),
        pick(F.transform(good, lambda c: reference(c["section"], c["form"], c["filing_date"], c["source_url"])), F.array().cast("array<string>"), F.col("citations")).alias("citations"),
        pick(
            F.transform(good, lambda c: F.struct(c["section"].alias("section"), c["form"].alias("form"), c["filing_date"].alias("filing_date"), c["quote"].alias("excerpt"), c["source_url"].alias("source_url"))),
            F.array().cast(f"array<{EVIDENCE}>"), F.col("evidence"),
        ).alias("evidence"),
        pick(T.why_it_matters(F.get(good, F.lit(0))["section"], F.col("question")), reason, F.col("why_it_matters")).alias("why_it_matters"),
        wrote.alias("generated"),
        F.when(F.col("failed").isNotNull(), T.describe_failure(F.col("failed"))).otherwise("").alias("generation_error"),
        F.transform(bad, lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["quote"].alias("quote"), c["reason"].alias("reason"))).alias("rejected_citations"),
        F.when(wrote, F.col("w_usage")).alias("usage"),
    )


def format_evidence(chunk_id: Column, form: Column, section: Column, period: Column, text: Column) -> Column:
    """A chunk as a labelled block that can be cited by its id."""
    return F.concat(
        F.lit('<evidence id="'), chunk_id, F.lit('" form="'), form, F.lit('" section="'), section, F.lit('" period="'),
        period, F.lit('">\n'), text, F.lit("\n</evidence>"),
    )


def prompt_of(question: str, evidence: list[dict]) -> str:
    """The prompt of one question in plain Python, as ``prompts`` makes it."""
    block = '<evidence id="{chunk_id}" form="{form}" section="{section}" period="{period_of_report}">\n{text}\n</evidence>'
    shown = "\n\n".join(block.format(**{k: c.get(k) or "" for k in ("chunk_id", "form", "section", "period_of_report", "text")}) for c in evidence)
    return f"{shown}\n\nQuestion: {question}\n\n{ONLY_EVIDENCE}"


def prompts(questions: DataFrame, evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, prompt) for questions with evidence."""
    blocks = F.transform("found", lambda c: format_evidence(c["chunk_id"], c["form"], c["section"], c["period_of_report"], c["text"]))
    tail = F.concat(F.lit("\n\nQuestion: "), F.col("question"), F.lit(f"\n\n{ONLY_EVIDENCE}"))
    rows = questions.select("qid", "question").join(gathered(evidence, chunks), "qid")
    return rows.select("qid", F.concat(F.array_join(blocks, "\n\n"), tail).alias("prompt"))


def cost(input_tokens: Column, output_tokens: Column, input_rate: Column, output_rate: Column) -> Column:
    return input_tokens * input_rate + output_tokens * output_rate


def format_cost(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """``usage`` (input_tokens, output_tokens, model) with cost and a line that tells it.

    ``rates`` has prefix, input_rate and output_rate in dollars a token; a model is priced by the
    longest prefix it begins with.
    """
    rows = usage.withColumn("_row", F.monotonically_increasing_id())
    priced = rows.join(rates, F.col("model").startswith(F.col("prefix")), "left")
    best = priced.groupBy("_row").agg(F.max_by(F.struct(*priced.columns), F.coalesce(F.length("prefix"), F.lit(0))).alias("r")).select("r.*")
    dollars = cost(F.col("input_tokens"), F.col("output_tokens"), F.col("input_rate"), F.col("output_rate"))
    tokens = F.concat(F.format_number("input_tokens", 0), F.lit(" in / "), F.format_number("output_tokens", 0), F.lit(" out tokens on "), F.col("model"))
    price = F.when(F.col("prefix").isNull(), "").when(dollars == 0, " - free tier").otherwise(F.concat(F.lit(" - about $"), F.format_string("%.4f", dollars)))
    return best.withColumn("cost", dollars).withColumn("line", F.concat(tokens, price)).drop("_row", "prefix", "input_rate", "output_rate")


def parse_answer(text: str) -> dict:
    """A generator's JSON reply, all four fields required."""
    said = json.loads(text)
    missing = {"supported", "answer", "citations", "reason_if_unsupported"} - set(said)
    if missing:
        raise ValueError(f"the reply lacks {sorted(missing)}")
    return {"supported": said["supported"], "answer": said["answer"], "citations": said["citations"], "reason": said["reason_if_unsupported"]}
