"""Offline stand-in model client for tests and runs without a model service.

It answers each task deterministically from the request text alone (so executors need no shared
state): analysis echoes the post's first 80 characters as summary with neutral sentiment; the
extractors return the longer lines or blocks; ideation turns the summary into one idea; ranking
orders ideas by their count. It says nothing about what a real model would answer and must never
be reported as model output. :class:`ScriptedFailures` adds reproducible errors keyed by the
request key, to exercise retries and dead letters.
"""

from __future__ import annotations

import json
import re

from postmine.operators import requests as RQ
from postmine.operators.enrich import ModelError

_WS = "[\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_COLLAPSE = re.compile(_WS + "+")
_TRIM = re.compile(f"^{_WS}+|{_WS}+$")
_UNESCAPE = re.compile(r'\\(\\|""")')

SUMMARY_CHARS = 80
MIN_POST_CHARS = 40


def _clean(s: str) -> str:
    return _TRIM.sub("", _COLLAPSE.sub(" ", s))


def _between(prompt: str, head: str, tail: str) -> str:
    body = prompt[len(head):] if prompt.startswith(head) else prompt
    return body[: len(body) - len(tail)] if tail and body.endswith(tail) else body


def offline_reply(task: str, prompt: str) -> str:
    if task == "analyze":
        post = _UNESCAPE.sub(r"\1", _between(prompt, RQ.ANALYSIS_PROMPT_HEAD, RQ.ANALYSIS_PROMPT_TAIL))
        return json.dumps({"summary": _clean(post)[:SUMMARY_CHARS], "sentiment": "neutral", "topics": [], "toxicityScore": 0},
                          ensure_ascii=False)
    if task == "extract_chunk":
        text = _between(prompt, RQ.CHUNK_USER_HEAD, "")
        posts = [s for s in (_TRIM.sub("", ln) for ln in text.split("\n")) if len(s) > MIN_POST_CHARS]
        return json.dumps({"posts": posts}, ensure_ascii=False)
    if task == "extract_candidates":
        items = json.loads(_between(prompt, RQ.CANDIDATE_USER_HEAD, RQ.CANDIDATE_USER_TAIL))
        return json.dumps({"posts": [s for s in items if len(_TRIM.sub("", s)) > MIN_POST_CHARS]}, ensure_ascii=False)
    if task == "ideate":
        inp = json.loads(_between(prompt, RQ.IDEA_USER_HEAD, RQ.IDEA_USER_TAIL))
        title = _clean(inp.get("summary") or "")[:40].strip()
        if not title:
            return "n/a"
        return json.dumps([f"{title} kit — packaged help for this need | repeated demand in posts | Suggested: $99/mo"],
                          ensure_ascii=False)
    if task == "rank":
        ideas = json.loads(_between(prompt, RQ.RANK_USER_HEAD, RQ.RANK_USER_TAIL)).get("ideas") or []
        order = sorted(range(len(ideas)), key=lambda i: (-(ideas[i].get("count") or 0), i))
        ranked = [
            {"idea": ideas[i]["idea"], "priority": r + 1, "score": float(ideas[i].get("count") or 0),
             "estimated_revenue_usd": 1000 * (ideas[i].get("count") or 0), "recommended_price_range": "$",
             "go_to_market_channels": [], "examples": (ideas[i].get("examples") or [])[:1]}
            for r, i in enumerate(order)
        ]
        return json.dumps({"ranked": ranked}, ensure_ascii=False)
    raise ModelError(f"unknown task {task}", status=400)


class OfflineClient:
    """``client(key, task, system, prompt) -> reply`` (see module docstring)."""

    def __call__(self, key, task, system, prompt):
        return offline_reply(task, prompt)


def failure_kind(key: str) -> int:
    """0: one 429 then success; 1: always times out; 2: fatal 400; else: success."""
    return int(key[:2], 16) % 16


class ScriptedFailures:
    """Wrap a client with reproducible failures chosen by the request key (see :func:`failure_kind`)."""

    def __init__(self, inner):
        self.inner, self.seen = inner, {}

    def __call__(self, key, task, system, prompt):
        n = self.seen.get(key, 0)
        self.seen[key] = n + 1
        kind = failure_kind(key)
        if kind == 0 and n == 0:
            raise ModelError("LLM request failed: 429 Too Many Requests - rate limit", status=429)
        if kind == 1:
            raise ModelError("Request timed out", code="ETIMEDOUT")
        if kind == 2:
            raise ModelError("LLM request failed: 400 Bad Request - invalid", status=400)
        return self.inner(key, task, system, prompt)


def offline_client():
    """Factory for :class:`OfflineClient` (built on the executor)."""
    return OfflineClient()


def scripted_client():
    """Factory for the offline client behind :class:`ScriptedFailures`."""
    return ScriptedFailures(OfflineClient())


def no_sleep(_seconds):
    """Retry waits skipped (tests and offline runs); the schedule is still followed."""
    return None
