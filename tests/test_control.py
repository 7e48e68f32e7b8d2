"""Planner states, providers, the service, enrichment runs, the command line."""

import json
import subprocess
import threading
import time
import urllib.request

import pytest
from pyspark.sql import functions as F

from tessera import __main__ as command
from tessera.plans import answering, enrichment, providers, service
from tessera.sources import snapshot


def section(url):
    return {"url": url, "anchor": "", "heading_path": f"A > {url[-1]}", "content": "text"}


def tools(searched):
    read = lambda url: {"url": url, "anchor": "", "heading_path": "P", "content": "page"} if "ok" in url else {"outline": "A, B"}
    return answering.Tools(lambda q, lib, kind: searched.append((q, lib, kind)) or [section(f"https://x/{len(searched)}")], read, lambda q: [{"url": "https://s", "reason": q}])


def test_states_and_budgets():
    replies = iter(
        ['{"action": "search_docs", "query": "two", "library": "l", "kind": "api"}', 'so: {"action": "read_page", "url": "a heading"}', '{"action": "read_page", "url": "https://x/ok"}', '{"action": "read_page", "url": "https://x/ok"}']
        + ['{"action": "ask_source", "question": "how"}'] * 2
        + ['{"action": "answer"}']
    )
    searched, lines = [], []
    seen = [(s.node, dict(s.left)) for s in answering.states("one", tools(searched), lambda q, log, left: next(replies), lambda c, q: answering.Answer(c))]
    assert searched == [("one", None, None), ("two", "l", "api")]
    assert [n for n, _ in seen][:3] == ["plan", "tool", "plan"] and [n for n, _ in seen][-2:] == ["generate", "end"]
    assert seen[-1][1] == {"search_docs": 4, "read_page": 0, "ask_source": 0}
    again = iter(['{"action": "search_docs"}'] * 50)
    answering.agentic("q", tools(searched), lambda *a: next(again), lambda c, q: answering.Answer("a"), lines.append)
    assert sum("no budget left" in x for x in lines) == answering.MAX_STEPS - 5 and lines[-1] == "writing the answer"
    assert lines[0] == "search_docs 'q': 3"

    def broken(*a):
        raise OSError

    assert answering.agentic("q", tools([]), broken, lambda c, q: answering.Answer("still")).answer_md == "still"
    found = answering.extractive(answering.context([section("https://x/1"), section("https://x/2")]), "q")
    assert found.answer_md == "text" and found.citations == [{"title": "A > 1", "url": "https://x/1", "anchor": ""}]


# providers


def chat(monkeypatch, models=("m1", "m2"), name="KEY_A"):
    monkeypatch.setenv(name, " secret\n")
    return providers.chat_completions("https://h/v1", list(models), (name,))


def reply(text):
    return {"choices": [{"message": {"content": text}}]}


def test_models_in_turn(monkeypatch):
    calls, waits = [], []

    def post(url, headers, body, timeout=60.0):
        calls.append(body["model"])
        if body["model"] == "m1":
            raise providers.ApiError(404)
        if len(calls) < 4:
            raise providers.ApiError(429, retry_after=2.0)
        assert headers == {"Authorization": "Bearer secret"} and url == "https://h/v1/chat/completions"
        return reply("done")

    models = providers.Models([chat(monkeypatch)], post=post, wait=waits.append)
    assert models.complete("p", "s") == "done" and calls == ["m1", "m2", "m2", "m2"]
    assert len(waits) == 2 and all(2.0 <= w <= 3.5 for w in waits)
    assert models.complete("p") == "done" and calls[-1] == "m2"  # m1 is left alone


def test_a_long_wait_goes_to_the_next_model_and_provider(monkeypatch):
    def post(url, headers, body, timeout=60.0):
        if "messages" in url and "v1/messages" in url:
            return {"content": [{"type": "text", "text": "other"}]}
        raise providers.ApiError(429, retry_after=900.0)

    monkeypatch.setenv("KEY_B", "k")
    clock = [0.0]
    cool = providers.Cooldowns(lambda: clock[0])
    both = [chat(monkeypatch), providers.messages_api(["c"], keys=("KEY_B",))]
    models = providers.Models(both, post=post, wait=lambda s: pytest.fail("no wait"), cooldowns=cool)
    assert models.complete("p") == "other"
    assert cool.usable(["provider:chat-completions", "provider:messages"]) == ["provider:messages"]
    clock[0] = 61.0
    assert len(cool.usable(["provider:chat-completions", "provider:messages"])) == 2
    cool.set("a", 10_000)
    clock[0] += 901
    assert cool.usable(["a", "b"]) == ["a", "b"]
    cool.set("a", 5), cool.set("b", 5)
    assert cool.usable(["a", "b"]) == ["a", "b"]  # all are left alone, so all are asked
    cool.reset()


def test_chain_and_errors(monkeypatch):
    for name in ("KEY_A", "KEY_B", "KEY_C"):
        monkeypatch.delenv(name, raising=False)
    every = [chat(monkeypatch), providers.messages_api(["c"], keys=("KEY_B",)), providers.generate_content(["g"], keys=("KEY_C", "KEY_D"))]
    monkeypatch.setenv("KEY_D", "d")
    assert [p.name for p in providers.chain(every)] == ["chat-completions", "generate-content"]
    assert [p.name for p in providers.chain(every, "generate-content")][0] == "generate-content"
    assert every[2].text({"candidates": []}) is None and every[2].text({"candidates": [{"content": {"parts": [{"text": "x"}]}}]}) == "x"
    with pytest.raises(providers.GenerationError):
        providers.chat_completions("no url", [])
    with pytest.raises(providers.GenerationError):
        providers.Models([], post=None).complete("p")
    assert providers.wait_asked("3.5") == 3.5 and providers.wait_asked("Wed, 21 Oct") is None and providers.wait_asked(None) is None
    assert providers.pause(2, None, False) == 4.0 and 40.0 <= providers.pause(1, None, True) <= 41.5


def test_one_repair_round(monkeypatch):
    prompts = []

    def post(url, headers, body, timeout=60.0):
        if "response_format" in body:
            raise providers.ApiError(422)
        prompts.append(body["messages"][1]["content"])
        return reply('no' if len(prompts) == 1 else 'x {"answer_md": "yes", "citations": [{"url": "u"}], "symbols_used": ["s"]} y')

    found = providers.Models([chat(monkeypatch)], post=post, wait=lambda s: None).answer("q", "ctx", "sys")
    assert (found.answer_md, found.citations, found.symbols_used) == ("yes", [{"url": "u", "anchor": "", "title": ""}], ["s"])
    assert "not valid" in prompts[1]
    for bad in ("", "{}", '{"answer_md": "a", "citations": [1]}', '{"answer_md": "a", "symbols_used": [1]}'):
        with pytest.raises(ValueError):
            providers.parsed_answer(bad)


# service


def test_service_bounds_and_streams():
    gate, clock = threading.Event(), [0.0]

    def ask(question, progress):
        progress("a step")
        if question == "slow":
            gate.wait(10)
        if question == "bad":
            raise RuntimeError("host secret")
        return f"answer to {question}"

    s = service.Service(ask, workers=1, waiting=1, throttle=service.Throttle(3, 60.0, lambda: clock[0]), guard=lambda q: "no" if q == "off" else "")
    assert list(s.stream("q", "c", 5.0)) == [("step", "a step"), ("answer", "answer to q")]
    assert s.answer("bad") == service.FAILED and s.answer(" ") == "Please ask a question." and s.answer("off") == "no"
    assert s.answer("1", "c") and s.answer("2", "c") and s.answer("3", "c") == service.BUSY
    clock[0] = 61.0
    assert s.answer("4", "c") == "answer to 4"
    time.sleep(0.1)
    waiting = [s.stream("slow", "", 0.01) for _ in range(2)]
    assert [next(w)[0] for w in waiting] in (["step", "wait"], ["wait", "wait"])
    assert s.answer("third") == service.BUSY
    gate.set()
    assert all(list(w)[-1] == ("answer", "answer to slow") for w in waiting)
    assert s.warm_up() and service.probes(a=lambda: True, b=lambda: False, c=lambda: 1 / 0) == {"a": "ok", "b": "failed", "c": "ZeroDivisionError: division by zero"}
    server = service.http_server(s, health=lambda: {"store": "ok"})
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    lines = [json.loads(x) for x in urllib.request.urlopen(f"{base}/ask?q=hi")]
    assert lines[-1] == {"answer": "answer to hi"} and json.loads(urllib.request.urlopen(f"{base}/health").read()) == {"store": "ok"}
    server.shutdown()
    s.close()


# enrichment


def test_enrichment_goes_on_where_it_stopped(spark, tmp_path):
    pages = spark.createDataFrame([(f"u{i}", f"excerpt {i}") for i in range(10)], "url string, excerpt string").coalesce(1)
    path, asked, marks = f"file://{tmp_path}/out", [], []

    def ask(prompt):
        asked.append(prompt)
        if len(asked) == 2:
            raise OSError
        n = prompt.count("excerpt")
        return json.dumps([{"i": i, "gloss": f" gloss of {prompt.split('[%d] ' % i)[1].split(chr(10))[0]} "} for i in range(n - 1)])

    first = enrichment.enrich(pages, path, ask, "gloss", 4, 12, checkpoint=marks.append)
    assert first["failed_batches"] == 1 and marks and marks[-1] == first["done"]
    got = {r.url: r.gloss for r in snapshot.read_glosses(spark, path).collect()}
    assert len(got) == first["done"] and all(g == f"gloss of {u}"[:12] for u, g in got.items())
    n = len(asked)
    second = enrichment.enrich(pages, path, lambda p: ask(p), "gloss", 4, 12)
    assert "excerpt" in asked[n] and not any(f"] {u}\n" in p for p in asked[n:] for u in got)
    assert snapshot.read_glosses(spark, path).count() == first["done"] + second["done"]
    stopped = enrichment.enrich(pages, f"file://{tmp_path}/none", lambda p: "nothing", "gloss", 1, 12)
    assert stopped == {"done": 0, "failed_batches": enrichment.STOP_AFTER}
    lists = enrichment.enrich(pages.limit(2), f"file://{tmp_path}/qs", lambda p: '[{"i": 0, "questions": ["a?", 3, "b?", "c?"]}]', "questions", 4, 12, most=2)
    assert lists["done"] == 1 and snapshot.read_questions(spark, f"file://{tmp_path}/qs").first().questions == ["a?", "b?"]


def test_git_checkpoint(tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / "a.jsonl").write_text("{}\n")
    assert enrichment.git_checkpoint(str(tmp_path), "first") and not enrichment.git_checkpoint(str(tmp_path), "nothing new")
    assert "first" in subprocess.run(["git", "-C", str(tmp_path), "log", "--oneline"], capture_output=True, text=True).stdout


# command line


def test_command_line(spark, tmp_path, capsys):
    body = "# Widgets\n\nA widget turns inputs into outputs in one step.\n\n## Gears\n\nGears drive the widget.\n"
    pages = spark.createDataFrame([(f"https://x.org/docs/p{i}.html", f"P{i}", "core", body + f"\nnumber {i}") for i in range(3)], "url string, title string, library string, body string")
    snapshot.write_page_files(pages.withColumns({"content_hash": F.sha2("body", 256), "crawled_at": F.lit("2024-01-01")}), f"file://{tmp_path}/snap")
    index = ["--index", f"file://{tmp_path}/index"]
    assert command.main(["smoke", *index], spark) == 1  # no chunks yet
    assert command.main(["build", *index, "--snapshot", f"file://{tmp_path}/snap"], spark) == 0
    assert "'total': 6" in capsys.readouterr().out
    assert command.main(["search", *index, "-k", "3", "gears drive"], spark) == 0
    assert "Widgets > Gears" in capsys.readouterr().out
    assert command.main(["ask", *index, "What drives the widget gears?"], spark) == 0
    out = capsys.readouterr().out
    assert "Gears drive the widget." in out and "https://x.org/docs/p" in out
    assert command.main(["smoke", *index], spark) == 0
