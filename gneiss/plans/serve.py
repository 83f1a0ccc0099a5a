"""A thin HTTP front: companies, loading one, its progress, and answers, as JSON.

Requests are values and so are replies: a table of routes gives each to a function of an
``App``, which knows nothing of sockets. Answers are Spark jobs on the shared session; one company loads at a
time, in the background, and what is told of it is one record that is replaced as a whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import NamedTuple

from pyspark.sql import SparkSession

from gneiss.operators.answer import Generator
from gneiss.operators.generation import describe
from gneiss.plans import api
from gneiss.sources.store import Store

PAGE = """<!doctype html><meta charset="utf-8"><title>Filings</title><form><input id="t" placeholder="ticker"><input id="q" size="60"
placeholder="question"><button>Ask</button></form><pre id="a"></pre><script>document.forms[0].onsubmit=async e=>{e.preventDefault();
const r=await fetch('/api/answer',{method:'POST',body:JSON.stringify({ticker:t.value,question:q.value})});a.textContent=JSON.stringify(await r.json(),null,1)}</script>"""


class Reply(NamedTuple):
    status: int
    body: object
    kind: str = "application/json"

    def encoded(self) -> bytes:
        return (self.body if isinstance(self.body, str) else json.dumps(self.body)).encode()


class Refused(ValueError):
    """A request that cannot be met as it is, and the status that says so."""

    def __init__(self, why: str, status: int = 400):
        super().__init__(why)
        self.status = status


@dataclass(frozen=True)
class Load:
    """What is known of a load: a company, what it does now, how far it is, and how it ended."""

    ticker: str | None = None
    message: str = ""
    percent: int = 0
    done: bool = True
    error: str | None = None


@dataclass
class Loader:
    """Loads one company after the other by ``load(ticker, tell)``, where ``tell`` takes a message and a percentage."""

    load: Callable[[str, Callable[[str, int], None]], object]
    state: Load = Load()
    _worker: ThreadPoolExecutor = field(default_factory=lambda: ThreadPoolExecutor(1, "loader"))
    _running: Future | None = None

    def start(self, ticker: str) -> Load:
        # The worker's one place is the lock: whoever finds it taken is refused.
        if self._running is not None and not self._running.done():
            raise Refused(f"{self.state.ticker} is being loaded; wait until that is done", 409)
        self.state = Load(ticker, "Starting", 0, False)
        self._running = self._worker.submit(self._work, ticker)
        return self.state

    def _work(self, ticker: str) -> None:
        def tell(message: str, percent: int) -> None:
            self.state = replace(self.state, message=message, percent=percent)

        try:
            self.load(ticker, tell)
        except Exception as error:  # noqa: BLE001 - whatever went wrong is for the reader of the state
            self.state = Load(ticker, error=str(error))
        else:
            self.state = Load(ticker, f"{ticker} can be asked about now", 100)


@dataclass
class App:
    spark: SparkSession
    store: Store
    loader: Loader | None = None
    generator: Generator | None = None
    mode: str | None = None  # how answers are written, as the page tells it

    def page(self, _: dict) -> Reply:
        return Reply(200, PAGE, "text/html; charset=utf-8")

    def companies(self, _: dict) -> Reply:
        found = [row.asDict() for row in self.store.companies().orderBy("ticker").collect()]
        return Reply(200, {"companies": found, "mode": self.mode or describe(None), "can_load": self.loader is not None})

    def progress(self, _: dict) -> Reply:
        return Reply(200, asdict(self.loader.state if self.loader else Load()))

    def add(self, asked: dict) -> Reply:
        ticker = _wanted(asked, "ticker", "name a ticker").upper()
        if self.loader is None:
            raise Refused("this server cannot load companies: it was started without a contact address")
        return Reply(202, asdict(self.loader.start(ticker)))

    def answer(self, asked: dict) -> Reply:
        question, ticker = _wanted(asked, "question", "ask a question"), _wanted(asked, "ticker", "name a company").upper()
        chunks = self.store.scan(ticker)
        if chunks.isEmpty():
            raise Refused(f"nothing of {ticker} is in the store")
        batch = self.spark.createDataFrame([("q", question, ticker)], "qid string, question string, ticker string")
        found = api.answer(batch, chunks, generator=self.generator, embedder=self.store.embedder, stored=self.store.index())
        return Reply(200, found.first().asDict(recursive=True))

    def reply(self, method: str, path: str, body: bytes) -> Reply:
        do = ROUTES.get((method, path.partition("?")[0]))
        if do is None:
            return Reply(404, {"error": f"there is no {method} {path}"})
        try:
            asked = json.loads(body or b"{}")
            if not isinstance(asked, dict):
                raise Refused("the body must be a JSON object")
            return do(self, asked)
        except Refused as refused:
            return Reply(refused.status, {"error": str(refused)})
        except ValueError as error:
            return Reply(400, {"error": str(error)})


def _wanted(asked: dict, name: str, else_say: str) -> str:
    value = str(asked.get(name) or "").strip()
    if not value:
        raise Refused(else_say)
    return value


ROUTES: dict[tuple[str, str], Callable[[App, dict], Reply]] = {
    ("GET", "/"): App.page,
    ("GET", "/api/companies"): App.companies,
    ("GET", "/api/company/status"): App.progress,
    ("POST", "/api/company"): App.add,
    ("POST", "/api/answer"): App.answer,
}


def server(app: App, port: int = 8000) -> ThreadingHTTPServer:
    class Wire(BaseHTTPRequestHandler):
        def _pass(self):
            reply = app.reply(self.command, self.path, self.rfile.read(int(self.headers.get("Content-Length", 0))))
            data = reply.encoded()
            self.send_response(reply.status)
            for header in (("Content-Type", reply.kind), ("Content-Length", str(len(data)))):
                self.send_header(*header)
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _pass  # noqa: N815

        def log_message(self, *args):
            return None

    return ThreadingHTTPServer(("127.0.0.1", port), Wire)
