"""Pacing, golden sets, the command line and the HTTP front."""

import json
import threading
import time
import urllib.error
import urllib.request

import numpy as np
import pytest

from gneiss.__main__ import main
from gneiss.functions.optional import require
from gneiss.operators import backends
from gneiss.operators import generation as g
from gneiss.plans import api, serve
from gneiss.sources import filings, golden
from gneiss.sources.store import Store
from tests.test_sources import filing, rows_of


def test_what_follows_from_failures():
    policy = g.Policy()
    assert policy.rest("503 UNAVAILABLE") == 8 and policy.rest("429") == 30 and policy.rest("504 DEADLINE_EXCEEDED") == 30
    assert policy.rest("429 please retry in 5.5s") == 6.5 and policy.rest("429 Retry in 900s") == 120
    assert policy.rest("429 PerDay") is None and policy.rest("429 quota PER DAY") is None and policy.rest("401") is None
    assert policy.wait(["503"] * 3, 10) == 24 and policy.wait(["503"] * 5, 0) is None and policy.wait(["429"] * 2, 31) is None


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds


def paced(errors, **how):
    clock, left = Clock(), list(errors)

    def request():
        if left:
            raise RuntimeError(left.pop(0))
        return {"ok": True}

    pace = g.Pace(clock=lambda: clock.now, sleep=clock.sleep, **how)
    try:
        return pace.call(request), clock.slept
    except RuntimeError as error:
        return str(error), clock.slept


def test_pace():
    assert paced([]) == ({"ok": True}, [])
    result, slept = paced(["503", "429 retry in 4s"], interval=0)
    assert result == {"ok": True} and slept == [8, 10]
    assert paced(["401"])[0] == "401" and paced(["429 per day"]) == ("429 per day", [])
    result, slept = paced(["429"] * 9, interval=0)
    assert result == "429" and sum(slept) <= 90  # a wait that would pass the budget is not begun
    clock = Clock()
    pace = g.Pace(interval=13, clock=lambda: clock.now, sleep=clock.sleep)
    for _ in range(3):
        pace.call(dict)
    assert clock.slept == [13, 13]


class Fake:
    def __init__(self, name, ready):
        self.name, self._ready = name, ready

    def available(self):
        return self._ready

    def generate(self, question, evidence):
        return {"supported": False, "reason": self.name}

    def models(self):
        return ["m1", "m2"]


def test_choice_of_backend(monkeypatch):
    a, b = Fake("a", False), Fake("b", True)
    assert g.choose([a, b]) is b and g.choose([a, b], "a") is None and g.choose([a, b], "off") is None and g.available([a, b]) == ["b"]
    assert g.from_environment({"GNEISS_BACKEND": " B "}, [a, b]) is b and g.from_environment({"GNEISS_BACKEND": "none"}, [a, b]) is None
    assert g.as_generator(None) is None and g.as_generator(b)("q", [])["reason"] == "b"
    assert g.as_generator(b, g.Pace(interval=0))("q", [])["reason"] == "b"
    assert "b" in g.describe(b) and "off" in g.describe(None)
    said = []
    monkeypatch.setattr(g, "from_environment", lambda _: b)
    assert main(["models"], None, said.append, {}) == 0 and said == ["m1\nm2"]


ANSWER = {"supported": True, "answer": "It is 5.", "citations": [{"chunk_id": "c", "quote": "five"}], "reason_if_unsupported": ""}
EVIDENCE = [{"chunk_id": "c", "form": "10-K", "section": "S", "period_of_report": None, "text": "five"}]


def test_services_ask_and_read_replies():
    seen = []

    def messages(url, headers, body=None):
        seen.append((url, headers, body))
        if body is None:
            return {"data": [{"id": "two"}, {"id": "one"}]}
        if "decline" in body["messages"][0]["content"]:
            return {"stop_reason": "refusal", "usage": {"input_tokens": 3}}
        given = {} if "nothing" in body["messages"][0]["content"] else ANSWER
        return {"content": [{"type": "text"}, {"type": "tool_use", "input": given}], "usage": {"input_tokens": 7, "cache_read_input_tokens": 4}}

    a = backends.MessagesService("key", "m", exchange=messages)
    reply = a.generate("q?", EVIDENCE)
    assert reply["supported"] and reply["citations"] == ANSWER["citations"] and reply["usage"] == {"input_tokens": 7, "output_tokens": 0, "cache_read_tokens": 4, "cache_write_tokens": 0, "model": "m"}
    assert seen[0][1]["x-api-key"] == "key" and seen[0][2]["messages"][0]["content"].startswith('<evidence id="c" form="10-K" section="S" period="">\nfive\n</evidence>')
    assert a.generate("decline", EVIDENCE)["reason"] == backends.DECLINED and a.generate("nothing", EVIDENCE)["reason"] == backends.UNUSABLE
    assert a.models() == ["one", "two"]

    def contents(url, headers, body=None):
        if body is None:
            return {"models": [{"name": "models/z"}, {"name": "models/e", "supportedGenerationMethods": ["embed"]}]}
        assert body["generationConfig"]["temperature"] == 0 and url.endswith("/models/m:generateContent")
        early = "long" in body["contents"][0]["parts"][0]["text"]
        return {"candidates": [{"finishReason": "MAX_TOKENS" if early else "STOP", "content": {"parts": [{"text": json.dumps(ANSWER)}]}}], "usageMetadata": {"promptTokenCount": 2}}

    b = backends.ContentService("key", "m", None, exchange=contents)
    assert b.generate("q", EVIDENCE)["supported"] and "MAX_TOKENS" in b.generate("long", EVIDENCE)["reason"] and b.models() == ["z"]
    with_key = backends.known({"GOOGLE_API_KEY": "k", "GNEISS_CONTENT_MODEL": "m"})
    assert g.available(with_key) == ["gemini"] and g.available(backends.known({"ANTHROPIC_API_KEY": "k"})) == []


def test_a_missing_library_says_what_it_is_for():
    with pytest.raises(ImportError, match="embedding texts.*nowhere_to_be_found"):
        require("nowhere_to_be_found.part", "embedding texts")
    assert require("json", "x") is json


def test_a_generator_is_called_once_a_question_and_on_the_driver(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.upsert(rows_of(spark, ("a", "AAAA", "10-K", "x", "Interest rate and currency risks affect the market.")))
    asked = spark.createDataFrame([("1", "currency rate market", "AAAA"), ("2", "nothing known zebra", "AAAA")], "qid string, question string, ticker string")
    calls = []

    def generator(question, evidence):
        calls.append((question, [e["chunk_id"] for e in evidence]))
        return {"supported": True, "answer": "Yes.", "citations": [{"chunk_id": "a", "quote": "interest RATE"}, {"chunk_id": "a", "quote": "made up"}], "usage": {"input_tokens": 5, "model": "m"}}

    answers = api.answer(asked, store.scan(), generator=generator)
    for _ in range(2):
        rows = {r.qid: r for r in answers.collect()}
    assert calls == [("currency rate market", ["a"])]
    assert rows["1"].answer == "Yes." and rows["1"].generated and [c.quote for c in rows["1"].rejected_citations] == ["made up"] and rows["1"].usage.input_tokens == 5
    assert not rows["2"].supported and not rows["2"].generated


CASES = {
    "corpus": {"ticker": "AAAA", "forms": ["10-K"]},
    "cases": [
        {"question": "currency rate market risks", "expect": "supported", "why": "w", "portable": True, "expect_section_contains": "Market", "expect_answer_contains": ["CURRENCY"]},
        {"question": "favourite colour of penguins", "expect": "abstain", "why": "w"},
        {"question": "currency rate market", "expect": "abstain", "why": "w", "known_gap": True, "gap_class": "fact_not_stated"},
    ],
}


def test_golden_cases_and_command_line(spark, tmp_path):
    path, base = tmp_path / "golden.json", tmp_path / "base.json"
    path.write_text(json.dumps(CASES))
    cases, home = golden.read_cases(spark, str(path))
    assert home == "AAAA" and cases.count() == 3
    assert golden.select_cases(cases, home, "BBBB")[0].count() == 1 and golden.select_cases(cases, home, None, True)[0].count() == 1
    store = Store(spark, str(tmp_path / "store"))
    store.upsert(rows_of(spark, ("a:market:0", "AAAA", "10-K", "x", "Interest rate and currency risks affect the market."), ("a:other:0", "AAAA", "10-K", "x", "Nothing else.")))
    said = []
    for _ in range(2):
        main(["--data", str(tmp_path), "evaluate", str(path), "--baseline", str(base), "--save-baseline"], spark, said.append)
    assert "overall                    2/3     67%" in said[0] and "[fact_not_stated]" in said[0] and "same" not in said[0]
    assert "same" in said[1] and json.loads(base.read_text())["stats"]["correct"] == 2 and base.read_text().endswith("}\n")
    with pytest.raises(ValueError):
        main(["--data", str(tmp_path), "evaluate", str(path), "--baseline", str(base), "--save-baseline", "--ticker", "BBBB"], spark, said.append)
    main(["--data", str(tmp_path), "ask", "currency rate market"], spark, said.append)
    assert any("retrieved: 1 chunk(s)" in s for s in said) and any("answer (excerpted)" in s for s in said) and any("Based on" in s for s in said)
    main(["--data", str(tmp_path), "ask", "favourite colour of penguins", "--ticker", "aaaa"], spark, said.append)
    assert any("nothing passed the gates" in s for s in said) and "\nno answer" in said
    for ticker, why in (("ZZ", "ZZ is not in the store; there are AAAA"),):
        with pytest.raises(SystemExit, match=why):
            main(["--data", str(tmp_path), "ask", "x", "--ticker", ticker], spark, said.append)
    with pytest.raises(SystemExit, match="empty"):
        main(["--data", str(tmp_path / "none"), "ask", "x"], spark, said.append)


def test_build_from_saved_filings(spark, tmp_path):
    page = filing("<h1>Item 1. Business</h1><p>We make things.</p>")
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "f.htm").write_text(page["html"])
    row = {k: page[k] for k in ("ticker", "form", "filing_date", "accession_number", "source_url")}
    (tmp_path / "EXMP_filings.json").write_text(json.dumps([row | {"local_path": "raw/f.htm"}, row | {"local_path": "raw/missing.htm"}]))
    said = []
    main(["--data", str(tmp_path), "build", "--reset", "--probe", "things"], spark, said.append)
    assert said[0]["chunks"] == 1 and said[0]["tickers"] == ["EXMP"] and (said[0]["tables"], said[0]["prose"]) == (0, 1) and "no vectors" in said[1]
    with pytest.raises(SystemExit, match="nothing is fitted"):
        main(["--data", str(tmp_path), "--vectors", "latent", "ask", "what?"], spark, said.append)
    main(["--data", str(tmp_path), "--vectors", "latent", "build", "--reset"], spark, said.append)
    assert said[-1]["chunks"] == 1 and (tmp_path / "latent").exists()
    main(["--data", str(tmp_path), "--vectors", "hashed", "build", "--reset", "--probe", "we make things."], spark, said.append)
    assert said[-1].startswith("  [0.000] 10-K") and "We make things." in said[-1]


def call(port, path, body=None):
    request = urllib.request.Request(f"http://127.0.0.1:{port}{path}", data=None if body is None else json.dumps(body).encode())
    try:
        with urllib.request.urlopen(request, timeout=60) as reply:
            return reply.status, reply.read()
    except urllib.error.HTTPError as error:
        return error.code, error.read()


def test_http(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.upsert(rows_of(spark, ("a", "AAAA", "10-K", "x", "Interest rate and currency risks affect the market.")))
    go = threading.Event()

    def load(ticker, progress):
        progress("half", 50)
        assert go.wait(30)
        if ticker == "BAD":
            raise ValueError("no such company")

    app = serve.App(spark, store, serve.Loader(load))
    with serve.server(app, port=0) as running:
        port = running.server_address[1]
        threading.Thread(target=running.serve_forever, daemon=True).start()
        assert call(port, "/")[0] == 200 and call(port, "/nope")[0] == 404 and call(port, "/api/nope", {})[0] == 404
        known = json.loads(call(port, "/api/companies")[1])
        assert known["companies"][0]["ticker"] == "AAAA" and "off" in known["mode"] and known["can_load"]
        assert call(port, "/api/answer", {"ticker": "AAAA"})[0] == 400 and call(port, "/api/answer", {"ticker": "ZZ", "question": "x"})[0] == 400
        assert call(port, "/api/answer", [1])[0] == 400 and app.reply("POST", "/api/answer", b"{").status == 400
        status, body = call(port, "/api/answer", {"ticker": "aaaa", "question": "currency rate market"})
        assert status == 200 and json.loads(body)["supported"] is True
        assert call(port, "/api/company", {"ticker": ""})[0] == 400
        assert call(port, "/api/company", {"ticker": "bad"})[0] == 202 and call(port, "/api/company", {"ticker": "x"})[0] == 409
        go.set()
        for _ in range(100):
            state = json.loads(call(port, "/api/company/status")[1])
            if state["done"]:
                break
            time.sleep(0.05)
        assert state["error"] == "no such company" and state["ticker"] == "BAD"
        running.shutdown()
    assert serve.App(spark, store).reply("POST", "/api/company", b'{"ticker": "x"}').status == 400


class Axes:
    """Texts that speak of the market lie along one axis, all others along the other; so does a question that says 'far'."""

    def embed(self, texts):
        return np.array([[1.0, 0.0] if "market" in t.lower() and "far" not in t else [0.0, 1.0] for t in texts], np.float32)


def test_the_veto_changes_an_answer_over_http(spark, tmp_path):
    rows = [("a:risk:0", "AAAA", "10-K", "x", "Interest rate and currency risks affect the market."), ("a:other:0", "AAAA", "10-K", "y", "Nothing of the kind.")]
    plain, hybrid = Store(spark, str(tmp_path / "p")), Store(spark, str(tmp_path / "h"), embedder=Axes())
    for store in (plain, hybrid):
        store.upsert(rows_of(spark, *rows))
    assert [list(r.embedding) for r in hybrid.scan().orderBy("corpus_pos").collect()] == [[1, 0], [0, 1]]
    ask = lambda store, question: json.loads(serve.App(spark, store).reply("POST", "/api/answer", json.dumps({"ticker": "AAAA", "question": question}).encode()).encoded())
    near, far = "currency rate market", "currency rate market far"
    assert ask(plain, near)["supported"] and ask(plain, far)["supported"] and ask(hybrid, near)["supported"]
    answer = ask(hybrid, far)
    assert "Nothing of the kind" in answer["answer"]  # the keyword match is vetoed, what is near by its vector remains


def test_ingest_leaves_a_known_company_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.upsert(rows_of(spark, ("a", "AAAA", "10-K", "x", "Some text of it.")))
    told = filings.ingest(spark, None, " aaaa ", str(tmp_path), store, again=False)
    assert told == {"ticker": "AAAA", "filings": 0, "failed": [], "chunks": 1, "tables": 0}
