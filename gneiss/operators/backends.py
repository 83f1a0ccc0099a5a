"""Two hosted services that write answers, over their public HTTP interfaces.

Both get the same instructions, prompt and answer schema, and both give the same reply; quotes are
verified afterwards by the plan, not here. A service is available if its key and its model are
set. ``post`` and ``get`` can be given, so that nothing here needs a network to be tested.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from gneiss.operators.answer import parse_answer, prompt_of
from gneiss.operators.generation import Pace

INSTRUCTIONS = (
    "You answer questions about companies from excerpts of their filings. Use nothing but the evidence given. "
    "Quote word for word, from the evidence you cite by its id, every passage that your answer rests on. "
    "If the evidence does not answer the question, set supported to false and say what is missing. "
    "Give no advice on investments."
)
SCHEMA = {
    "type": "object",
    "properties": {
        "supported": {"type": "boolean"},
        "answer": {"type": "string"},
        "citations": {
            "type": "array",
            "items": {"type": "object", "properties": {"chunk_id": {"type": "string"}, "quote": {"type": "string"}}, "required": ["chunk_id", "quote"]},
        },
        "reason_if_unsupported": {"type": "string"},
    },
    "required": ["supported", "answer", "citations", "reason_if_unsupported"],
}
MOST_TOKENS, TIMEOUT = 4000, 25.0
DECLINED, UNUSABLE = "The service declined to answer this question.", "The service returned no usable answer."


def _exchange(url: str, headers: Mapping[str, str], body: dict | None = None) -> dict:
    data = None if body is None else json.dumps(body).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT) as reply:
            return json.load(reply)
    except urllib.error.HTTPError as error:
        raise RuntimeError(f"{error.code} {error.read().decode(errors='replace')[:2000]}") from error
    except (urllib.error.URLError, TimeoutError) as error:
        raise RuntimeError(f"503 {error}") from error


def _unsupported(reason: str, usage: dict) -> dict:
    return {"supported": False, "answer": "", "citations": [], "reason": reason, "usage": usage}


@dataclass
class MessagesService:
    """A service of messages and tools; the answer is the input of a tool that it must call."""

    key: str = ""
    model: str = ""
    name: str = "claude"
    base: str = "https://api.anthropic.com/v1"
    exchange: Callable[..., dict] = _exchange

    def available(self) -> bool:
        return bool(self.key and self.model)

    def _headers(self) -> dict[str, str]:
        return {"x-api-key": self.key, "anthropic-version": "2023-06-01"}

    def generate(self, question: str, evidence: list[dict]) -> dict:
        said = self.exchange(f"{self.base}/messages", self._headers(), {
            "model": self.model, "max_tokens": MOST_TOKENS,
            # The same with every question and first, so that it can be cached.
            "system": [{"type": "text", "text": INSTRUCTIONS, "cache_control": {"type": "ephemeral"}}],
            "messages": [{"role": "user", "content": prompt_of(question, evidence)}],
            "tools": [{"name": "give_answer", "description": "Give the answer.", "input_schema": SCHEMA}],
            "tool_choice": {"type": "tool", "name": "give_answer"},
        })
        used = said.get("usage") or {}
        count = lambda name: int(used.get(name) or 0)
        usage = {
            "input_tokens": count("input_tokens"), "output_tokens": count("output_tokens"),
            "cache_read_tokens": count("cache_read_input_tokens"), "cache_write_tokens": count("cache_creation_input_tokens"), "model": self.model,
        }
        if said.get("stop_reason") == "refusal":
            return _unsupported(DECLINED, usage)
        given = next((part["input"] for part in said.get("content") or [] if part.get("type") == "tool_use"), None)
        return _reply(given, usage)

    def models(self) -> list[str]:
        return sorted(m["id"] for m in self.exchange(f"{self.base}/models", self._headers()).get("data", []))


@dataclass
class ContentService:
    """A service of contents and candidates; the answer is JSON of a schema, at temperature 0."""

    key: str = ""
    model: str = ""
    pace: Pace | None = field(default_factory=Pace)
    name: str = "gemini"
    base: str = "https://generativelanguage.googleapis.com/v1beta"
    exchange: Callable[..., dict] = _exchange

    def available(self) -> bool:
        return bool(self.key and self.model)

    def generate(self, question: str, evidence: list[dict]) -> dict:
        said = self.exchange(f"{self.base}/models/{self.model}:generateContent", {"x-goog-api-key": self.key}, {
            "systemInstruction": {"parts": [{"text": INSTRUCTIONS}]},
            "contents": [{"role": "user", "parts": [{"text": prompt_of(question, evidence)}]}],
            "generationConfig": {
                "temperature": 0, "maxOutputTokens": MOST_TOKENS, "responseMimeType": "application/json", "responseSchema": SCHEMA,
            },
        })
        used = said.get("usageMetadata") or {}
        count = lambda name: int(used.get(name) or 0)
        usage = {
            "input_tokens": count("promptTokenCount"), "output_tokens": count("candidatesTokenCount"),
            "cache_read_tokens": count("cachedContentTokenCount"), "cache_write_tokens": 0, "model": self.model,
        }
        first = next(iter(said.get("candidates") or []), {})
        if first.get("finishReason", "STOP") not in ("STOP", "FINISH_REASON_UNSPECIFIED"):
            return _unsupported(f"The service stopped early ({first['finishReason']}).", usage)
        return _reply("".join(part.get("text", "") for part in first.get("content", {}).get("parts", [])) or None, usage)

    def models(self) -> list[str]:
        """Models that can write answers; some may be listed and yet not be open to a key."""
        listed = self.exchange(f"{self.base}/models", {"x-goog-api-key": self.key}).get("models", [])
        return sorted(m["name"].removeprefix("models/") for m in listed if "generateContent" in (m.get("supportedGenerationMethods") or ["generateContent"]))


def _reply(given: dict | str | None, usage: dict) -> dict:
    try:
        return parse_answer(given if isinstance(given, str) else json.dumps(given)) | {"usage": usage}
    except (TypeError, ValueError):
        return _unsupported(UNUSABLE, usage)


def known(environment: Mapping[str, str]) -> list[MessagesService | ContentService]:
    """The services in order of preference, with keys and models from the environment."""
    pace = Pace(interval=float(environment.get("GNEISS_INTERVAL", "13")))
    return [
        MessagesService(environment.get("ANTHROPIC_API_KEY", ""), environment.get("GNEISS_MESSAGES_MODEL", "")),
        ContentService(environment.get("GEMINI_API_KEY") or environment.get("GOOGLE_API_KEY", ""), environment.get("GNEISS_CONTENT_MODEL", ""), pace),
    ]
