"""A question service on the driver: bounded workers and queue, throttle, progress lines, probes, HTTP."""

from __future__ import annotations

import json
import queue
import threading
import time
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from tessera.config import Config

BUSY = "Too many questions at once; please try again in a moment."
FAILED = "Something went wrong with that question. Please try again in a moment."
#: (question, progress) to markdown.
Ask = Callable[[str, Callable[[str], None]], str]


class Throttle:
    """At most ``limit`` accepted calls a client within ``window`` seconds; refused ones do not count."""

    def __init__(self, limit: int = Config.rate_limit, window: float = Config.rate_window_seconds, clock: Callable[[], float] = time.monotonic):
        self.limit, self.window, self.clock, self._seen, self._lock = limit, window, clock, defaultdict(deque), threading.Lock()

    def accepts(self, client: str) -> bool:
        now = self.clock()
        with self._lock:
            own = self._seen[client]
            while own and now - own[0] > self.window:
                own.popleft()
            if self.limit > 0 and len(own) >= self.limit:
                return False
            own.append(now)
            return True


class Service:
    """Answers questions with ``workers`` at once and at most ``waiting`` behind them."""

    def __init__(self, ask: Ask, workers: int = 16, waiting: int = 64, throttle: Throttle | None = None, guard: Callable[[str], str] = lambda question: ""):
        self.ask, self.guard, self.throttle = ask, guard, throttle or Throttle()
        self._pool, self._room = ThreadPoolExecutor(workers), threading.BoundedSemaphore(workers + waiting)

    def warm_up(self, question: str = "warm up") -> bool:
        """Load models and compile plans before the first real question; a failure is no reason not to serve."""
        try:
            self.ask(question, lambda line: None)
            return True
        except Exception:
            return False

    def stream(self, question: str, client: str = "", tick: float = 0.6) -> Iterator[tuple[str, str]]:
        """("step", line) as they come, ("wait", "") when nothing came for a tick, then ("answer", markdown)."""
        question = (question or "").strip()
        if not question:
            yield "answer", "Please ask a question."
            return
        if client and not self.throttle.accepts(client):
            yield "answer", BUSY
            return
        refusal = self.guard(question)
        if refusal:
            yield "answer", refusal
            return
        if not self._room.acquire(blocking=False):
            yield "answer", BUSY
            return
        lines: queue.Queue[tuple[str, str]] = queue.Queue()

        def work() -> None:
            try:
                lines.put(("answer", self.ask(question, lambda line: lines.put(("step", line)))))
            except Exception:  # what went wrong may name hosts and keys, so it is not shown
                lines.put(("answer", FAILED))
            finally:
                self._room.release()

        self._pool.submit(work)
        while True:
            try:
                kind, text = lines.get(timeout=tick)
            except queue.Empty:
                yield "wait", ""
                continue
            yield kind, text
            if kind == "answer":
                return

    def answer(self, question: str, client: str = "") -> str:
        return next(text for kind, text in self.stream(question, client) if kind == "answer")

    def close(self) -> None:
        self._pool.shutdown()


def probes(**checks: Callable[[], bool]) -> dict[str, str]:
    """``ok`` or what is wrong, for each named check."""
    out = {}
    for name, check in checks.items():
        try:
            out[name] = "ok" if check() else "failed"
        except Exception as e:
            out[name] = f"{type(e).__name__}: {e}"
    return out


def http_server(service: Service, host: str = "127.0.0.1", port: int = 0, health: Callable[[], dict[str, str]] = dict):
    """A server for ``/ask?q=...`` (lines of JSON, one an event) and ``/health``; not started."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlsplit

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            where = urlsplit(self.path)
            if where.path not in ("/ask", "/health"):
                self.send_error(404)
                return
            self.send_response(200)
            self.send_header("Content-Type", "application/x-ndjson")
            self.end_headers()
            if where.path == "/health":
                self.wfile.write(json.dumps(health()).encode() + b"\n")
                return
            for kind, text in service.stream(parse_qs(where.query).get("q", [""])[0], self.client_address[0]):
                self.wfile.write(json.dumps({kind: text}).encode() + b"\n")

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
