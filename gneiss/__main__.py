"""``python -m gneiss``: ingest, build, ask, evaluate, serve."""

from __future__ import annotations

import argparse
import os
import sys
import textwrap
from collections.abc import Callable, Iterator, Mapping
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import evaluate as E
from gneiss.operators import generation
from gneiss.operators.latent import LatentTerms, fit
from gneiss.operators.vector import Embedder, HashedTerms, SentenceModel
from gneiss.plans import api, serve
from gneiss.sources import filings, golden
from gneiss.sources.store import Store

WIDTH = 96


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="gneiss", description=__doc__)
    out.add_argument("--data", default="data", help="folder of saved filings and the store")
    out.add_argument("--vectors", default="none", help="none, hashed (terms, no model), latent (fitted on the first build or a reset) or the name of a sentence model; the same for building and asking")
    commands = out.add_subparsers(dest="command", required=True)
    load = commands.add_parser("ingest", help="download, chunk and store a company's filings")
    load.add_argument("ticker")
    load.add_argument("--user-agent", required=True)
    load.add_argument("--limit", type=int, default=2)
    load.add_argument("--again", action="store_true", help="also where the company is in the store")
    build = commands.add_parser("build", help="chunk and store all saved filings")
    build.add_argument("--reset", action="store_true")
    build.add_argument("--probe", metavar="QUESTION", help="then show the nearest chunks to a question")
    ask = commands.add_parser("ask", help="answer a question and show each stage")
    ask.add_argument("question")
    ask.add_argument("--ticker", default="", help="may be left out where the store has one company")
    ask.add_argument("--no-generator", action="store_true")
    score = commands.add_parser("evaluate", help="score reviewed cases")
    score.add_argument("cases")
    score.add_argument("--ticker")
    score.add_argument("--only-checkable", action="store_true")
    score.add_argument("--no-generator", action="store_true")
    score.add_argument("--baseline")
    score.add_argument("--save-baseline", action="store_true")
    front = commands.add_parser("serve", help="answer over HTTP")
    front.add_argument("--port", type=int, default=8000)
    front.add_argument("--user-agent", help="a contact address; without it companies cannot be added")
    commands.add_parser("models", help="list the models that the configured service offers")
    return out


def embedder_of(args: argparse.Namespace, spark: SparkSession) -> Embedder | None:
    if args.vectors == "latent":
        return latent_of(args, spark)
    return {"none": None, "hashed": HashedTerms()}.get(args.vectors) if args.vectors in ("none", "hashed") else SentenceModel(args.vectors)


def latent_of(args: argparse.Namespace, spark: SparkSession) -> LatentTerms:
    """What was fitted on the saved filings; a build fits where nothing was yet, or the store is begun anew."""
    kept = Path(args.data, "latent")
    if args.command == "build" and (args.reset or not kept.exists()):
        fit(filings.load_corpus(spark, args.data)).save(spark, str(kept))
    elif not kept.exists():
        raise SystemExit("nothing is fitted: build with --vectors latent first")
    return LatentTerms.load(spark, str(kept))


def company_of(store: Store, wanted: str) -> str:
    """The company that is asked about: the one wanted, or the only one there is."""
    have = [row.ticker for row in store.companies().orderBy("ticker").collect()]
    if wanted.upper() in have:
        return wanted.upper()
    if not wanted and len(have) == 1:
        return have[0]
    if not have:
        raise SystemExit("the store is empty: ingest a company or build from saved filings first")
    raise SystemExit(f"{wanted.upper() + ' is not in the store' if wanted else 'name a company with --ticker'}; there are {', '.join(have)}")


def traced(question: str, retrieved: DataFrame, row: Row) -> Iterator[str]:
    """The stages of one answer: what was retrieved, what was answered, on what, what was rejected, what it took."""
    shown = partial(textwrap.fill, width=WIDTH, initial_indent="  ", subsequent_indent="  ")
    found = retrieved.orderBy("rank").collect()
    yield f"{question}\n\nretrieved: {len(found)} chunk(s)" + ("" if found else ", as nothing passed the gates")
    for c in found:
        yield f"  {c.rank}. {'table' if c.chunk_type == 'table' else 'prose'}  {c.section[:58]}  ({c.form} {c.filing_date})"
    how = "written" if row.generated else "excerpted"
    yield f"\nanswer ({how})" if row.supported else "\nno answer"
    yield shown(row.answer)
    if not row.supported:
        yield shown(f"Why: {row.why_it_matters}")
    if row.generation_error:
        yield f"  not written: {row.generation_error}"
    for e in row.evidence:
        yield f"\n{'quote' if row.generated else 'excerpt'}: {e.section[:66]}, {e.form} filed {e.filing_date}\n{shown(e.excerpt)}\n  {e.source_url}"
    told = row.asDict()
    for r in told.get("rejected_citations") or []:
        yield f"\nrejected quote of {r.chunk_id}: {r.reason}\n{shown(r.quote[:200])}"
    if used := told.get("usage"):
        cached = f" ({used.cache_read_tokens:,} from a cache)" if used.cache_read_tokens else ""
        yield f"\n{used.input_tokens:,} in / {used.output_tokens:,} out tokens on {used.model}{cached}"


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, out: Callable = print, environment: Mapping[str, str] = os.environ) -> int:
    args = parser().parse_args(arguments)
    backend = None if getattr(args, "no_generator", False) else generation.from_environment(environment)
    if args.command == "models":
        out("\n".join(backend.models()) if backend else generation.describe(None))
        return 0
    spark = spark or SparkSession.builder.appName("gneiss").getOrCreate()
    store = Store(spark, str(Path(args.data, "store")), getattr(args, "reset", False), embedder_of(args, spark))
    writer = generation.as_generator(backend)
    return COMMANDS[args.command](args, spark, store, backend, writer, out)


def _ingest(args, spark, store, backend, writer, out) -> int:
    told = filings.ingest(
        spark, filings.Client(args.user_agent), args.ticker, args.data, store, limit=args.limit, again=args.again, progress=lambda m, p: out(f"{p:3}% {m}")
    )
    out(told)
    return 0


def _build(args, spark, store, backend, writer, out) -> int:
    chunks = filings.load_corpus(spark, args.data)
    total = store.upsert(chunks.withColumn("seq", F.struct("source_url", "block_seq")).drop("block_seq"))
    if not total:
        raise SystemExit(f"no saved filings in {args.data}: ingest a company first")
    out({"chunks": total} | store.stats().first().asDict() | store.table_counts().first().asDict())
    if args.probe and store.embedder is None:
        out("there are no vectors to probe: build with --vectors")
    elif args.probe:
        asked = spark.createDataFrame([("q", args.probe, "")], "qid string, question string, ticker string")
        near = api.search(asked, store.scan(), store.embedder, scoped=False).where("vec_rank <= 3").join(store.scan(), "chunk_id")
        for hit in near.orderBy("vec_rank").collect():
            out(f"  [{hit.distance:.3f}] {hit.form} {hit.filing_date} | {hit.section}\n      {hit.text[:160].strip()}")
    return 0


def _ask(args, spark, store, backend, writer, out) -> int:
    ticker = company_of(store, args.ticker)
    asked = spark.createDataFrame([("q", args.question, ticker)], "qid string, question string, ticker string")
    chunks = store.scan(ticker)
    retrieved = api.retrieve(asked, chunks, embedder=store.embedder, stored=store.index()).join(chunks, "chunk_id")
    row = api.answer(asked, chunks, generator=writer, embedder=store.embedder, stored=store.index()).first()
    for line in traced(args.question, retrieved, row):
        out(line)
    return 0


def _evaluate(args, spark, store, backend, writer, out) -> int:
    cases, home = golden.read_cases(spark, args.cases)
    rows, at_home = golden.select_cases(cases, home, args.ticker, args.only_checkable)
    ticker = (args.ticker or home).upper()
    asked = rows.select("qid", "question", F.lit(ticker).alias("ticker"))
    answers = api.answer(asked, store.scan(ticker), generator=writer, embedder=store.embedder, stored=store.index())
    scored = E.score_cases(rows, answers, at_home).persist()
    complete = at_home and not args.only_checkable
    old = golden.read_baseline(spark, args.baseline) if args.baseline and complete else None
    mode = f"{ticker} - {'hybrid' if store.embedder else 'lexical'} retrieval, {generation.describe(backend)}"
    out(E.report(scored, old, mode))
    if args.save_baseline:
        golden.write_baseline(args.baseline, E.scorecard(scored), mode, complete)
    scored.unpersist()
    return 0


def _serve(args, spark, store, backend, writer, out) -> int:
    loader = None
    if args.user_agent:
        client = filings.Client(args.user_agent)
        loader = serve.Loader(lambda ticker, tell: filings.ingest(spark, client, ticker, args.data, store, again=True, progress=tell))
    with serve.server(serve.App(spark, store, loader, writer, generation.describe(backend)), args.port) as running:
        out(f"http://127.0.0.1:{args.port}")
        running.serve_forever()
    return 0


COMMANDS = {"ingest": _ingest, "build": _build, "ask": _ask, "evaluate": _evaluate, "serve": _serve}


if __name__ == "__main__":
    sys.exit(main())
