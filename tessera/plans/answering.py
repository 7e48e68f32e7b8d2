"""Answering on the driver around the batched operators: tools, a budgeted planner, routing, citations.

Language models are behind two callables; everything else is data.  The planner is a state machine of
three nodes (plan, tool, generate): ``advance`` makes one transition, ``states`` all of them, and
``agentic`` runs it to the answer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from tessera.config import KINDS, Config

#: Tool budgets, the most steps of a question, what ends the planning.
BUDGETS = {"search_docs": 6, "read_page": 2, "ask_source": 1}
MAX_STEPS = sum(BUDGETS.values()) + 2
ANSWER = "answer"


@dataclass
class Answer:
    answer_md: str
    citations: list[dict] = field(default_factory=list)
    symbols_used: list[str] = field(default_factory=list)
    referrals: list[dict] = field(default_factory=list)
    version: str = ""


@dataclass
class Tools:
    """search(query, library, kind) gives sections (url, anchor, heading_path, content); read(url) one such
    section, or a dict with ``outline`` or ``error``, or None; refer(question) links (url, reason)."""

    search: Callable[[str, str | None, str | None], list[dict]]
    read: Callable[[str], dict | None]
    refer: Callable[[str], list[dict]] = lambda question: []


#: (context, question) to an answer.
Generate = Callable[[str, str], Answer]
#: (question, transcript, budgets left) to a reply with a JSON action; an error means to answer now.
Plan = Callable[[str, list[str], dict[str, int]], str]
#: Takes a line about each step.
Progress = Callable[[str], None]


def action_of(reply: str) -> dict:
    """The JSON action of a planner's reply; anything else means to answer now."""
    hit = re.search(r"\{.*\}", reply or "", re.S)
    try:
        found = json.loads(hit[0]) if hit else {}
    except ValueError:
        found = {}
    return found if isinstance(found, dict) and found.get("action") in BUDGETS else {"action": ANSWER}


def context(sections: list[dict], limit: int = Config.section_chars) -> str:
    cut = lambda t: t if len(t) <= limit else t[:limit] + "\n[... truncated]"
    return "\n\n---\n\n".join(f"[{i}] {s['heading_path']} ({s['url']}#{s.get('anchor', '')})\n{cut(s['content'])}" for i, s in enumerate(sections, 1))


def grounded(question: str, sections: list[dict], generate: Generate, tools: Tools, failures: Callable[[Answer], int] = lambda a: 0) -> Answer:
    """An answer whose citations are all in the context; a failing one is made once more, and the cleaner one stays.

    Without sections there is a referral and no answer.
    """
    if not sections:
        return Answer("", referrals=tools.refer(question))
    text = context(sections)
    answer = generate(text, question)
    if failures(answer):
        second = generate(text, question)
        answer = second if failures(second) < failures(answer) else answer
    urls = {s["url"] for s in sections}
    answer.citations = [c for c in answer.citations if c.get("url") in urls]
    return answer


@dataclass
class State:
    """Where a question stands: the node that comes next and what was gathered."""

    question: str
    node: str = "plan"
    left: dict[str, int] = field(default_factory=lambda: dict(BUDGETS))
    sections: dict[tuple[str, str], dict] = field(default_factory=dict)
    referrals: list[dict] = field(default_factory=list)
    transcript: list[str] = field(default_factory=list)
    steps: int = 0
    action: dict = field(default_factory=dict)
    answer: Answer | None = None

    def add(self, sections: list[dict]) -> None:
        """Sections once by (url, anchor), the first one stays."""
        for s in sections:
            self.sections.setdefault((s["url"], s.get("anchor", "")), s)


def _searched(state: State, tools: Tools, query: str, library: str | None, kind: str | None) -> None:
    found = tools.search(query, library, kind if kind in KINDS else None)
    state.add(found)
    titles = [(s.get("heading_path") or s["url"]).split(" > ")[-1] for s in found]
    state.transcript.append(f"search_docs {query!r}: {' · '.join([t for t in titles[:4] if t])}")


def begin(question: str, tools: Tools) -> State:
    """A question is always searched for itself, whatever the planner says."""
    state = State(question)
    state.left["search_docs"] -= 1
    _searched(state, tools, question, None, None)
    return state


def _plan(state: State, plan: Plan) -> None:
    state.steps += 1
    try:
        state.action = action_of(plan(state.question, state.transcript, state.left))
    except Exception:  # an unreachable planner does not cost the answer
        state.action = {"action": ANSWER}
    done = state.action["action"] == ANSWER or not any(state.left.values()) or state.steps > MAX_STEPS
    state.node = "generate" if done else "tool"


def _use_tool(state: State, tools: Tools) -> None:
    state.node, action = "plan", state.action
    name = action["action"]
    if state.left[name] <= 0:
        state.transcript.append(f"{name}: no budget left")
        return
    state.left[name] -= 1
    if name == "search_docs":
        _searched(state, tools, str(action.get("query") or state.question), action.get("library"), action.get("kind"))
    elif name == "read_page":
        url = str(action.get("url") or "").strip()
        page = (tools.read(url) if re.match("https?://", url) else {"error": "a full url is needed"}) or {"error": "no such page"}
        if "content" in page:
            state.sections[page["url"], f"whole {len(state.sections)}"] = page
            state.transcript.append(f"read_page {page['url']}: whole page added")
        else:
            state.transcript.append(f"read_page {url}: {page.get('outline') or page.get('error')}")
    else:
        found = tools.refer(str(action.get("question") or state.question))
        state.referrals += [r for r in found if r not in state.referrals]
        state.transcript.append(f"ask_source: {len(found)} links")


def advance(state: State, tools: Tools, plan: Plan, generate: Generate) -> State:
    """One transition: plan to tool or generate, tool to plan, generate to the end."""
    if state.node == "plan":
        _plan(state, plan)
    elif state.node == "tool":
        _use_tool(state, tools)
    elif state.node == "generate":
        state.answer = grounded(state.question, list(state.sections.values()), generate, tools)
        state.answer.referrals += [r for r in state.referrals if r not in state.answer.referrals]
        state.node = "end"
    return state


def states(question: str, tools: Tools, plan: Plan, generate: Generate) -> Iterator[State]:
    """The state after the first search and after each transition."""
    state = begin(question, tools)
    yield state
    while state.node != "end":
        yield advance(state, tools, plan, generate)


def agentic(question: str, tools: Tools, plan: Plan, generate: Generate, progress: Progress = lambda line: None) -> Answer:
    """A first search, then planned steps while budgets last, then the answer."""
    told = 0
    for state in states(question, tools, plan, generate):
        for line in state.transcript[told:]:
            progress(line)
        told = len(state.transcript)
        if state.node == "generate":
            progress("writing the answer")
    return state.answer


def routed(question: str, tools: Tools, plan: Plan, generate: Generate, needs_loop: Callable[[str], bool], progress: Progress = lambda line: None) -> Answer:
    """The planner for questions that need several sources, else one search; without citations the planner after all."""
    if not needs_loop(question):
        sections = tools.search(question, None, None)
        progress(f"search_docs {question!r}: {len(sections)} sections")
        answer = grounded(question, sections, generate, tools)
        if answer.citations:
            return answer
    return agentic(question, tools, plan, generate, progress)


def extractive(text: str, question: str) -> Answer:
    """A generator without a model: the first section of the context and its source."""
    first = text.split("\n\n---\n\n", 1)[0]
    head, _, body = first.partition("\n")
    hit = re.match(r"\[\d+\] (.*) \((\S+?)#(\S*)\)$", head)
    return Answer(body, [{"title": hit[1], "url": hit[2], "anchor": hit[3]}] if hit else [])
