"""Index, scoring, gates, fusion and answers on small corpora with known outcomes."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gneiss.config import DEFAULTS, Settings
from gneiss.operators import answer, evaluate, hybrid, index, lexical, vector, verify
from gneiss.plans import api

COLUMNS = "chunk_id string, ticker string, form string, filing_date string, section string, text string, source_url string, corpus_pos long"


def corpus(spark, rows):
    full = [(c, t, f, "2026-02-01", s, x, f"https://x/{c}", i) for i, (c, t, f, s, x) in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS)


def ask(spark, *texts, ticker="AAAA"):
    return spark.createDataFrame([(f"q{i}", t, ticker) for i, t in enumerate(texts)], "qid string, question string, ticker string")


def found_hits(spark, rows):
    return spark.createDataFrame([(q, c, d, i + 1) for i, (q, c, d) in enumerate(rows)], "qid string, chunk_id string, distance double, vec_rank int")


ROWS = [
    ("a:liquidity:0", "AAAA", "10-Q", "Item 2. Liquidity", "Cash and equivalents fund operations into 2027. Cash is held in banks."),
    ("a:business:0", "AAAA", "10-K", "Item 1. Business", "The business develops medicines for rare diseases and sells products."),
    ("a:market:0", "AAAA", "10-K", "Item 7A. Market Risk", "Interest rate risks and currency risks affect the market value of securities."),
    ("a:empty:0", "AAAA", "10-K", "Item 9. Other", ""),
    ("b:market:0", "BBBB", "10-K", "Item 7A. Market Risk", "Interest rate risks and currency risks affect the market value of securities."),
]


def scores_by_hand(question, rows, s=DEFAULTS):
    """BM25 with gate and coverage in plain Python over one company's chunks."""
    terms = lambda t: [w for w in (x[:-1] if x.endswith("s") and not x.endswith("ss") else x for x in "".join(c if c.isalnum() else " " for c in t.lower()).split()) if len(w) > 2]
    tf = [terms(x) for *_, x in rows]
    n, avg = len(rows), sum(map(len, tf)) / len(rows)
    out = {}
    for (cid, _, _, section, _), own in zip(rows, tf, strict=True):
        wanted = set(terms(question))
        hit, head = wanted & set(own), wanted & set(terms(section))
        if hit | head:
            total = 2.0 * len(head)
            for w in hit:
                df = sum(w in t for t in tf)
                f = own.count(w)
                total += math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * (s.k1 + 1) / (f + s.k1 * (1 - s.b + s.b * max(len(own), 1) / avg))
            out[cid] = (round(total, 6), len(hit) + 2 * len(head), len(hit | head) / len(wanted))
    return out


def test_scores(spark):
    rows = [(c, t, f, s, x.replace(" and ", " ").replace(" the ", " ").replace(" into ", " ").replace(" is ", " ").replace(" of ", " ").replace("The ", "")) for c, t, f, s, x in ROWS[:4]]
    question = "currency risks market securities cash"
    found = lexical.score(api.asked(ask(spark, question), True), index.build(corpus(spark, rows)))
    got = {r.chunk_id: (round(r.relevance, 6), r.gate, r.coverage) for r in found.collect()}
    want = scores_by_hand(question, rows)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=2e-6)
    assert [r.chunk_id for r in found.orderBy("lex_rank").collect()][0] == "a:market:0"


def test_scope_ticker_and_empty_questions(spark):
    chunks = corpus(spark, ROWS)
    batch = api.asked(ask(spark, "What market risks does AAAA disclose?", "AAAA", "of the", "  "), True)
    found = lexical.score(batch, index.build(chunks)).collect()
    assert {(r.qid, r.chunk_id) for r in found} == {("q0", "a:market:0")} and found[0].coverage == 2 / 3
    stats = {r.scope: (r.n_docs, r.avg_len) for r in index.corpus_stats(index.chunk_lengths(chunks)).collect()}
    assert stats["AAAA"][0] == 4 and stats["BBBB"][0] == 1
    both = lexical.score(api.asked(ask(spark, "market risks"), False), index.build(chunks, None)).collect()
    assert {r.chunk_id for r in both} == {"a:market:0", "b:market:0"}


def test_limit_comes_before_the_gate_in_the_lexical_path(spark):
    rows = [(f"c{i}", "AAAA", "10-K", "Other", "currency currency currency currency") for i in range(3)] + [("d", "AAAA", "10-K", "Other", "currency market risk " + "word " * 60)]
    batch = api.asked(ask(spark, "currency market risk"), True)
    built = index.build(corpus(spark, rows))
    assert lexical.score(batch, built).where(lexical.passes_gate()).count() == 1
    ranked = lexical.score(batch, built).orderBy("lex_rank").collect()
    limit = [r.chunk_id for r in ranked].index("d")
    if limit:
        assert lexical.retrieve(batch, built, limit).count() == 0
    assert lexical.retrieve(batch, built, 4).count() == 1


@settings(max_examples=10, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 12))
def test_nearest_is_exact(spark, seed, limit):
    rng = np.random.default_rng(seed)
    base, asked = rng.normal(size=(30, 8)), rng.normal(size=(4, 8))
    rows = spark.createDataFrame([(f"c{i}", i, "A" if i % 3 else "B", v.tolist()) for i, v in enumerate(base)], "chunk_id string, corpus_pos long, scope string, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", "A", v.tolist()) for i, v in enumerate(asked)], "qid string, scope string, embedding array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    distance = 1 - unit(asked) @ unit(base).T
    for scoped in (False, True):
        found = vector.nearest(queries, rows, limit, scoped).collect()
        for q in range(4):
            allowed = [i for i in range(30) if not scoped or i % 3]
            want = sorted(allowed, key=lambda i: distance[q, i])[:limit]
            assert [r.chunk_id for r in sorted((r for r in found if r.qid == f"q{q}"), key=lambda r: r.vec_rank)] == [f"c{i}" for i in want]


def test_expression_distance_agrees(spark):
    row = spark.createDataFrame([([1.0, 2.0, 0.5], [0.3, -1.0, 2.0])], "a array<double>, b array<double>")
    a, b = np.array([1, 2, 0.5]), np.array([0.3, -1, 2])
    found = row.select(vector.cosine_distance(F.col("a"), F.col("b")).alias("d")).first().d
    assert found == pytest.approx(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def greedy(items, limit, cap):
    picked, over, used = [], [], {}
    for rank, group in items:
        if used.get(group, 0) < cap:
            used[group] = used.get(group, 0) + 1
            picked.append(rank)
        else:
            over.append(rank)
    return (picked + over)[:limit]


def test_variety(spark):
    rng = random.Random(4)
    lists = {f"q{k}": [(r, rng.choice("abc")) for r in range(1, rng.randrange(2, 9))] for k in range(40)}
    rows = spark.createDataFrame([(q, r, "10-K", g) for q, items in lists.items() for r, g in items], "qid string, rank int, form string, section string").withColumn("was", F.col("rank"))
    found = hybrid.diversify(rows, 4).orderBy("qid", "rank").collect()
    for q, items in lists.items():
        assert [r.was for r in found if r.qid == q] == greedy(items, 4, DEFAULTS.per_section)


def test_fusion_order_and_ties(spark):
    lex = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "qid string, chunk_id string, rank int")
    vec = spark.createDataFrame([("q", "c", 1), ("q", "d", 2)], "qid string, chunk_id string, rank int")
    found = {r.chunk_id: r.rrf for r in hybrid.fuse(lex, vec).collect()}
    assert found["c"] == pytest.approx(1 / 63 + 1 / 61) and found["b"] == found["d"] == pytest.approx(1 / 62)


VETO = [("a:properties:0", "AAAA", "10-K", "Item 2. Properties", "The forecast for sites in New Jersey.")]


@pytest.mark.parametrize("question,hits,supported", [
    ("weather forecast New Jersey", [("q0", "x", 0.82)], False),  # far from every hit
    ("weather forecast New Jersey", [("q0", "a:properties:0", 0.82)], False),
    ("weather forecast New Jersey", [("q0", "a:properties:0", 0.45)], True),
    ("weather forecast New Jersey", [], True),  # nothing was searched
    ("properties forecast Jersey", [("q0", "x", 0.82)], True),  # names the section
])
def test_veto(spark, question, hits, supported):
    chunks = corpus(spark, VETO)
    (r,) = api.answer(ask(spark, question), chunks, found_hits(spark, hits)).collect()
    assert r.supported == supported


def test_answers(spark):
    chunks = corpus(spark, ROWS)
    rows = {r.qid: r for r in api.answer(ask(spark, "interest rate market risks", "favourite colour of penguins"), chunks).collect()}
    yes, no = rows["q0"], rows["q1"]
    assert yes.supported and yes.answer.startswith("Based on Item 7A. Market Risk and related filing text, the company states: Interest")
    assert yes.citations == ["Item 7A. Market Risk | 10-K | 2026-02-01 | https://x/a:market:0"] and yes.why_it_matters.startswith("Risks")
    assert not no.supported and no.citations == [] and no.evidence == [] and "don't see this" in no.answer
    # A near vector hit alone is evidence; one past the floor is not.
    paraphrase = ask(spark, "how much runway remains")
    assert api.answer(paraphrase, chunks, found_hits(spark, [("q0", "a:liquidity:0", 0.31)])).first().supported
    assert not api.answer(paraphrase, chunks, found_hits(spark, [("q0", "a:liquidity:0", 0.94)])).first().supported


def test_the_plan_of_scoring_runs_no_python(spark):
    found = lexical.score(api.asked(ask(spark, "market risks"), True), index.build(corpus(spark, ROWS)))
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def test_verification(spark):
    chunks = corpus(spark, ROWS)
    cited = [("q", 0, "a:market:0", "  interest RATE risks"), ("q", 1, "a:market:0", "made up"), ("q", 2, "b:market:0", "Interest"), ("q", 3, "zzz", "x"), ("q", 4, "a:market:0", "")]
    given_ = spark.createDataFrame([("q", "a:market:0")], "qid string, chunk_id string")
    rows = verify.verify(spark.createDataFrame(cited, "qid string, pos int, chunk_id string, quote string"), given_, chunks).orderBy("pos").collect()
    assert [r.reason for r in rows] == [None, verify.NOT_THERE, verify.NOT_PROVIDED, verify.NOT_PROVIDED, None]
    assert rows[0].quote == "interest RATE risks" and rows[0].section == "Item 7A. Market Risk"


def generators():
    """Made inside a function, so that they travel to the workers whole."""

    def good(question, evidence):
        cited = [{"chunk_id": evidence[0]["chunk_id"], "quote": evidence[0]["text"][:10]}, {"chunk_id": "no", "quote": "x"}]
        return {"supported": True, "answer": "It does.", "citations": cited, "usage": {"input_tokens": 5, "output_tokens": 2, "model": "m"}}

    def failing(question, evidence):
        raise RuntimeError("429 RESOURCE_EXHAUSTED")

    return {
        "good": good,
        "failing": failing,
        "declines": lambda q, e: {"supported": False, "reason": "not said"},
        "cites nothing": lambda q, e: {"supported": True, "answer": "x", "citations": []},
        "makes up": lambda q, e: {"supported": True, "answer": "x", "citations": [{"chunk_id": e[0]["chunk_id"], "quote": "never said"}]},
    }


@pytest.mark.parametrize("name,supported,generated,error", [
    ("good", True, True, ""), ("failing", True, False, "rate limited"), ("declines", False, True, ""), ("cites nothing", False, True, ""), ("makes up", False, True, ""),
])
def test_generated_answers_can_only_narrow(spark, name, supported, generated, error):
    rows = {r.qid: r for r in api.answer(ask(spark, "interest rate market risks", "penguins colour"), corpus(spark, ROWS), generator=generators()[name]).collect()}
    r = rows["q0"]
    assert (r.supported, r.generated, r.generation_error) == (supported, generated, error)
    assert not rows["q1"].supported and not rows["q1"].generated
    if name == "good":
        assert r.answer == "It does." and len(r.evidence) == 1 and len(r.rejected_citations) == 1 and r.usage.input_tokens == 5


def test_prompts_and_costs(spark):
    batch, chunks = api.asked(ask(spark, "interest rate market risks"), True), corpus(spark, ROWS)
    text = answer.prompts(batch, hybrid.retrieve(batch, index.build(chunks)), chunks).first().prompt
    assert text.startswith('<evidence id="a:market:0" form="10-K" section="Item 7A. Market Risk" period="">\nInterest') and text.endswith("or set supported = false.")
    usage = spark.createDataFrame([(3120, 210, "big-1"), (10, 1, "free-2"), (1, 1, "other")], "input_tokens long, output_tokens long, model string")
    rates = spark.createDataFrame([("big", 5e-6, 25e-6), ("free", 0.0, 0.0)], "prefix string, input_rate double, output_rate double")
    lines = {r.model: r.line for r in answer.format_cost(usage, rates).collect()}
    assert lines == {"big-1": "3,120 in / 210 out tokens on big-1 - about $0.0209", "free-2": "10 in / 1 out tokens on free-2 - free tier", "other": "1 in / 1 out tokens on other"}
    assert answer.parse_answer('{"supported": true, "answer": "a", "citations": [], "reason_if_unsupported": ""}')["answer"] == "a"
    with pytest.raises(ValueError):
        answer.parse_answer('{"supported": true}')


def test_scorecard(spark):
    cases = spark.createDataFrame(
        [("q0", "supported", "Market", ["currency"], None), ("q1", "abstain", None, None, True), ("q2", "supported", "market", ["dollars"], None)],
        "qid string, expect string, expect_section_contains string, expect_answer_contains array<string>, known_gap boolean",
    ).withColumns({"question": F.lit("x"), "gap_class": F.lit(None).cast("string"), "section_known_gap": F.lit(None).cast("boolean")})
    answers = api.answer(ask(spark, "currency rate market risks", "interest rate market", "interest rate risks market"), corpus(spark, ROWS))
    rows = evaluate.score_cases(cases, answers)
    by = {r.qid: r for r in rows.collect()}
    assert by["q0"].section_hit is True and by["q0"].fact_hit is True and by["q2"].section_hit is False and by["q2"].fact_hit is False
    assert by["q1"].section_hit is None and by["q1"].fact_hit is None and not by["q1"].correct
    s = evaluate.scorecard(rows).first()
    assert (s.cases, s.answered_when_expected, s.declined_when_expected, s.correct, s.section_hits, s.section_checked, s.fact_hits, s.fact_checked, s.open_gaps) == (3, 2, 0, 2, 1, 2, 1, 2, 1)
    delta = evaluate.baseline_delta(evaluate.scorecard(rows), evaluate.scorecard(rows.where("qid = 'q0'"))).orderBy("position").collect()
    assert [(d.label, d.was, d.now, d.arrow) for d in delta][0] == ("overall", 1, 2, "+1")
    assert evaluate.failure_reasons(rows).first().reasons == []


def test_settings_are_frozen():
    with pytest.raises(AttributeError):
        Settings().max_distance = 1
