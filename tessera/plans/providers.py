"""Language-model providers: who has a key, in which order they are asked, and how failures are taken.

Three public HTTP interfaces are described as data (where to post, what, and where the text of the reply
is); ``post`` does the request and is what tests replace.  A model or provider that fails is left
alone for a while by all callers of the process.
"""

from __future__ import annotations

import json
import os
import random
import threading
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from tessera.config import Config
from tessera.plans.answering import Answer

# Seconds that a failing model or provider is left alone, and the longest wait in a call.
REST = {404: 3600.0, 429: 60.0}
REST_PROVIDER, LONGEST_SLEEP, JITTER = 60.0, 30.0, 1.5


class GenerationError(RuntimeError):
    """No provider gave a valid answer."""


class ApiError(RuntimeError):
    """A request that failed with a status, and how long the server asks to wait."""

    def __init__(self, status: int, text: str = "", retry_after: float | None = None):
        super().__init__(f"{status} {text}")
        self.status, self.retry_after = status, retry_after


class Cooldowns:
    """Deadlines by key, shared by the threads of a process."""

    def __init__(self, clock: Callable[[], float] = time.monotonic, cap: float = Config.cooldown_cap_seconds):
        self.clock, self.cap, self._until, self._lock = clock, cap, {}, threading.Lock()

    def set(self, key: str, seconds: float) -> None:
        with self._lock:
            self._until[key] = self.clock() + min(seconds, self.cap)

    def usable(self, keys: list[str]) -> list[str]:
        """Those that are not left alone just now; all if every one is."""
        now = self.clock()
        with self._lock:
            return [k for k in keys if self._until.get(k, now) <= now] or list(keys)

    def reset(self) -> None:
        with self._lock:
            self._until.clear()


def secret(*names: str) -> str | None:
    """The first of the environment's values that is not blank, without white space around it."""
    return next((v for n in names if (v := (os.environ.get(n) or "").strip())), None)


@dataclass
class Provider:
    """A public chat interface.  ``body(model, system, prompt, as_json)`` makes the request, ``text(reply)`` reads it."""

    name: str
    keys: tuple[str, ...]
    models: list[str]
    url: Callable[[str, str], str]
    headers: Callable[[str], dict[str, str]]
    body: Callable[[str, str, str, bool], dict]
    text: Callable[[dict], str | None]

    def key(self) -> str | None:
        return secret(*self.keys)


def _chat_body(model: str, system: str, prompt: str, as_json: bool) -> dict:
    turns = [{"role": "system", "content": system}, {"role": "user", "content": prompt}]
    return {"model": model, "messages": turns} | ({"response_format": {"type": "json_object"}} if as_json else {})


def _first(rows, *path):
    for p in path:
        rows = rows[p] if isinstance(p, int) and isinstance(rows, list) and len(rows) > p else rows.get(p) if isinstance(rows, dict) else None
    return rows


def chat_completions(base: str, models: list[str], keys: tuple[str, ...] = ("OPENAI_COMPAT_API_KEY",)) -> Provider:
    if not base.startswith(("http://", "https://")):
        raise GenerationError(f"the base of a provider is a full url, not {base!r}")
    return Provider("chat-completions", keys, models, lambda model, key: f"{base.rstrip('/')}/chat/completions", lambda key: {"Authorization": f"Bearer {key}"}, _chat_body, lambda r: _first(r, "choices", 0, "message", "content"))


def messages_api(models: list[str], base: str = "https://api.anthropic.com", keys: tuple[str, ...] = ("ANTHROPIC_API_KEY",)) -> Provider:
    body = lambda model, system, prompt, as_json: {"model": model, "max_tokens": 4096, "system": system, "messages": [{"role": "user", "content": prompt}]}
    text = lambda r: "".join(b.get("text", "") for b in r.get("content") or [] if b.get("type") == "text") or None
    return Provider("messages", keys, models, lambda model, key: f"{base}/v1/messages", lambda key: {"x-api-key": key, "anthropic-version": "2023-06-01"}, body, text)


def generate_content(models: list[str], base: str = "https://generativelanguage.googleapis.com", keys: tuple[str, ...] = ("GEMINI_API_KEY", "GEMINI", "GOOGLE_API_KEY")) -> Provider:
    body = lambda model, system, prompt, as_json: {"systemInstruction": {"parts": [{"text": system}]}, "contents": [{"role": "user", "parts": [{"text": prompt}]}]} | ({"generationConfig": {"responseMimeType": "application/json"}} if as_json else {})
    return Provider("generate-content", keys, models, lambda model, key: f"{base}/v1beta/models/{model}:generateContent", lambda key: {"x-goog-api-key": key}, body, lambda r: _first(r, "candidates", 0, "content", "parts", 0, "text"))


def post(url: str, headers: dict[str, str], body: dict, timeout: float = 60.0) -> dict:
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    request = Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())
    except HTTPError as e:
        raise ApiError(e.code, e.reason or "", wait_asked(e.headers.get("Retry-After"))) from e


def wait_asked(value: str | None) -> float | None:
    """Seconds of a ``Retry-After`` header; a date or nonsense gives None."""
    try:
        return None if value is None else float(value)
    except ValueError:
        return None


def configured(providers: Iterable[Provider]) -> list[Provider]:
    return [p for p in providers if p.key()]


def chain(providers: list[Provider], preferred: str | None = None) -> list[Provider]:
    """Those with a key in their order, the preferred one first."""
    return sorted(configured(providers), key=lambda p: p.name != preferred)


def pause(attempt: int, asked: float | None, limited: bool) -> float:
    """Seconds before the next attempt: what the server asks, else growing ones, with jitter where many callers
    were turned away at once."""
    if not limited:
        return 2.0**attempt
    return (20.0 * (attempt + 1) if asked is None else asked) + random.uniform(0, JITTER)


class Models:
    """Completions over the models of providers in turn."""

    def __init__(self, providers: list[Provider], preferred: str | None = None, tries: int = 3, post: Callable[..., dict] = post, wait: Callable[[float], None] = time.sleep, cooldowns: Cooldowns | None = None):
        self.providers, self.preferred, self.tries, self.post, self.wait = providers, preferred, tries, post, wait
        self.cooldowns = cooldowns or Cooldowns()

    def complete(self, prompt: str, system: str = "", as_json: bool = False) -> str:
        """The reply of the first provider that gives one."""
        ready = {p.name: p for p in chain(self.providers, self.preferred)}
        last: Exception | None = None
        for name in (k.removeprefix("provider:") for k in self.cooldowns.usable([f"provider:{n}" for n in ready])):
            try:
                return self._of(ready[name], prompt, system, as_json)
            except Exception as e:
                last = e
                self.cooldowns.set(f"provider:{name}", REST_PROVIDER)
        raise GenerationError(f"no provider answered ({', '.join(ready) or 'none has a key'}): {last}")

    def _of(self, provider: Provider, prompt: str, system: str, as_json: bool) -> str:
        last: Exception | None = None
        for model in (k.removeprefix("model:") for k in self.cooldowns.usable([f"model:{m}" for m in provider.models])):
            for attempt in range(self.tries):
                try:
                    key = provider.key() or ""
                    reply = provider.text(self.post(provider.url(model, key), provider.headers(key), provider.body(model, system, prompt, as_json)))
                    if reply:
                        return reply
                    last = GenerationError(f"{model} gave no text")
                except ApiError as e:
                    last = e
                    final = attempt + 1 == self.tries
                    if e.status == 404 or (e.status == 429 and (final or (e.retry_after or 0) > LONGEST_SLEEP)):
                        self.cooldowns.set(f"model:{model}", REST[e.status] if e.status == 404 or e.retry_after is None else e.retry_after)
                        break
                    if as_json and e.status in (400, 422):
                        as_json = False  # this host takes no such option; the prompt asks for JSON all the same
                    elif not final:
                        self.wait(pause(attempt, e.retry_after, e.status == 429))
        raise GenerationError(f"{provider.name}: {last}")

    def answer(self, question: str, context: str, system: str) -> Answer:
        """A structured answer; a malformed reply is sent back once with what is wrong with it."""
        prompt = f"{context}\n\nQuestion: {question}\nReply with one JSON object."
        fault = ""
        for _ in range(2):
            reply = self.complete(prompt + (f"\n\nYour last reply was not valid: {fault}" if fault else ""), system, True)
            try:
                return parsed_answer(reply)
            except ValueError as e:
                fault = str(e)
        raise GenerationError(f"no valid answer: {fault}")


def parsed_answer(reply: str) -> Answer:
    """The answer in a reply's outermost JSON object; raises where a field has another shape."""
    a, b = reply.find("{"), reply.rfind("}")
    if a < 0 or b < a:
        raise ValueError("no JSON object")
    found = json.loads(reply[a : b + 1])
    if not isinstance(found.get("answer_md"), str):
        raise ValueError("answer_md is no text")
    out = Answer(found["answer_md"], version=str(found.get("version") or ""))
    for name, known in (("citations", ("url", "anchor", "title")), ("referrals", ("url", "reason"))):
        rows = found.get(name) or []
        if not isinstance(rows, list) or not all(isinstance(r, dict) and isinstance(r.get("url"), str) for r in rows):
            raise ValueError(f"{name} is no list of objects with a url")
        setattr(out, name, [{k: str(r.get(k) or "") for k in known} for r in rows])
    symbols = found.get("symbols_used") or []
    if not isinstance(symbols, list) or not all(isinstance(s, str) for s in symbols):
        raise ValueError("symbols_used is no list of texts")
    out.symbols_used = symbols
    return out
