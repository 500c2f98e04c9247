"""Model enrichment connector (S7), retry policy (S8), failure isolation.

``enrich(requests, client_factory, policy)`` sends each request row to a model client inside
``mapInPandas``: one client per partition, built on the executor by the factory (no client object
passes through the driver). Every row yields exactly one reply row — ``status`` ``ok`` with the
reply text, or ``failed`` with the error (a dead letter); one failure never stops other rows.
Request keys are stable hashes (see :func:`postmine.operators.requests.build_requests`), so a
re-run can anti-join the replies already written and call only the missing keys.

Physical notes: a task keeps up to ``in_flight`` calls open at once and starts at most ``rate`` a second;
a call to be retried waits in a heap until its delay is over, while others go on, so a slow key never
blocks its neighbours and results come in any order. Over all tasks the concurrency is their number times
``in_flight`` (``partitions`` repartitions by key). Replies must be written (or checkpointed) before they
are used twice, otherwise a second branch would call the model again.
"""

from __future__ import annotations

import heapq
import itertools
import math
import random
import re
import sys
import time
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gates import RETRYABLE_CODES, RETRYABLE_PATTERN, RETRYABLE_STATUS

REPLY_SCHEMA = (
    "key string, task string, reply string, status string, error string, error_status int, "
    "error_code string, attempts int"
)


class ModelError(Exception):
    """A failed model call: message plus optional HTTP status and error code."""

    def __init__(self, message: str, status: int | None = None, code: str | None = None):
        super().__init__(message)
        self.status, self.code = status, code


@dataclass(frozen=True)
class RetryPolicy:
    """``retries`` extra attempts; delay ``floor(base * factor**attempt) + jitter[0, 300)`` ms."""

    retries: int = 5
    base_ms: int = 1000
    factor: float = 2.0
    jitter_ms: int = 300

    def delay_ms(self, attempt: int) -> int:
        return int(self.base_ms * self.factor**attempt) + random.randrange(self.jitter_ms if self.jitter_ms > 0 else 1)


# Retry presets per task (retries, base delay ms, factor); candidate extraction has none.
POLICIES = {
    "analyze": RetryPolicy(5, 20000, 2),
    "extract_chunk": RetryPolicy(2, 800, 2),
    "ideate": RetryPolicy(2, 800, 2),
    "rank": RetryPolicy(2, 800, 2),
    "extract_candidates": RetryPolicy(0, 0, 2),
}

# An empty analysis is an insight without content; every other task needs an answer.
EMPTY_REPLY_OK = {"analyze"}
SLICE = 32  # replies handed on together
IN_FLIGHT = 8  # calls a task has open at once
WAITING = 8  # requests that may wait for a retry, per call in flight
_END = object()

_RETRYABLE = re.compile(RETRYABLE_PATTERN, re.IGNORECASE)


def is_retryable_error(err: BaseException) -> bool:
    """F8 for one exception."""
    msg = str(getattr(err, "message", None) or err or "").lower()
    status = getattr(err, "status", None)
    code = getattr(err, "code", None)
    return bool(_RETRYABLE.search(msg)) or status == RETRYABLE_STATUS or code in RETRYABLE_CODES


def run_calls(requests, call, policy_of, in_flight: int = IN_FLIGHT, rate: float | None = None, sleep=time.sleep, clock=time.monotonic):
    """Yields ``(request, reply, error, attempts)`` for every request, in the order in which they are done.

    ``call(request)`` returns a reply or raises; it runs on up to ``in_flight`` threads. ``policy_of(request)``
    gives the retry policy. Requests are drawn from the iterator only when a call can start and few
    wait for a retry, so memory is bounded; a waiting request is due after its delay."""
    source, more = iter(requests), True
    due: list[tuple[float, int, int, object]] = []  # time, tie, attempt, request
    open_calls: dict[Future, tuple[int, object]] = {}
    ties, next_start = itertools.count(), -math.inf

    def once(request):
        try:
            return call(request), None
        except Exception as err:  # noqa: BLE001 - isolate every failure
            return None, err

    with ThreadPoolExecutor(max_workers=in_flight) as pool:
        while more or due or open_calls:
            while len(open_calls) < in_flight and clock() >= next_start:
                if due and due[0][0] <= clock():
                    _, _, attempt, request = heapq.heappop(due)
                elif more and len(due) < WAITING * in_flight:
                    attempt, request = 0, next(source, _END)
                    if request is _END:
                        more = False
                        continue
                else:
                    break
                if rate:
                    next_start = max(next_start, clock()) + 1 / rate
                open_calls[pool.submit(once, request)] = (attempt, request)
            wake = [t for t in ([due[0][0]] if due else []) + ([next_start] if rate and (more or due) else []) if t > clock()]
            if open_calls:
                done, _ = wait(open_calls, min(wake) - clock() if wake and len(open_calls) < in_flight else None, return_when=FIRST_COMPLETED)
            else:
                done = ()
                if wake and (due and due[0][0] > clock() or next_start > clock()):
                    sleep(max(0.0, min(wake) - clock()))
            for f in done:
                attempt, request = open_calls.pop(f)
                reply, err = f.result()
                policy = policy_of(request)
                if err is not None and is_retryable_error(err) and attempt < policy.retries:
                    heapq.heappush(due, (clock() + policy.delay_ms(attempt) / 1000.0, next(ties), attempt + 1, request))
                else:
                    yield request, reply, err, attempt + 1


def enrich(
    requests: DataFrame,
    client_factory,
    policy: RetryPolicy | None = None,
    partitions: int | None = None,
    sleep=None,
    in_flight: int = IN_FLIGHT,
    rate: float | None = None,
) -> DataFrame:
    """``requests(key, task, system, prompt)`` -> replies (``REPLY_SCHEMA``).

    ``client_factory()`` runs on the executor and returns ``client(key, task, system, prompt) -> str``;
    a client raises (e.g. :class:`ModelError`) on failure and has to allow ``in_flight`` calls at once. An empty
    reply is a failure but for the tasks in ``EMPTY_REPLY_OK``, as is any exception. A task starts at most
    ``rate`` calls a second (None: no limit). Replies are handed on in slices of ``SLICE``. With ``sleep``
    given (tests pass a no-op) retries are due at once.
    """
    import pandas as pd

    from ..session import ship_module

    ship_module(sys.modules[__name__])
    reqs = requests.select("key", "task", "system", "prompt")
    if partitions:
        reqs = reqs.repartition(partitions, "key")
    names = ["key", "task", "reply", "status", "error", "error_status", "error_code", "attempts"]

    def run(batches):
        client = client_factory()

        def call(request):
            key, task, system, prompt = request
            r = client(key, task, system, prompt)
            if r is None or (r == "" and task not in EMPTY_REPLY_OK):
                raise ModelError("Empty LLM response")
            return r

        def policy_of(request):
            p = policy or POLICIES.get(request[1], RetryPolicy())
            return p if sleep is None else RetryPolicy(p.retries, 0, p.factor, 0)

        def frame(rows):
            return pd.DataFrame(rows, columns=names).astype({"error_status": "Int32", "attempts": "int32"})

        rows = (r for b in batches for r in zip(b["key"], b["task"], b["system"], b["prompt"]))
        out = []
        for (key, task, _, _), reply, err, attempts in run_calls(rows, call, policy_of, in_flight, rate, sleep or time.sleep):
            if err is None:
                out.append((key, task, reply, "ok", None, None, None, attempts))
            else:
                st = getattr(err, "status", None)
                out.append((key, task, None, "failed", str(err), int(st) if st is not None else None, getattr(err, "code", None), attempts))
            if len(out) >= SLICE:
                yield frame(out)
                out = []
        if out:
            yield frame(out)

    return reqs.mapInPandas(run, REPLY_SCHEMA)


def split_failures(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ok replies, dead letters)."""
    return replies.filter(F.col("status") == "ok"), replies.filter(F.col("status") != "ok")


def attach_replies(requests: DataFrame, replies: DataFrame) -> DataFrame:
    """Requests left-join replies on key (no reply yet -> null side)."""
    return requests.join(replies.drop("task"), "key", "left")


def missing_requests(requests: DataFrame, stored_replies: DataFrame) -> DataFrame:
    """Idempotent re-run: requests whose key has no stored ``ok`` reply."""
    return requests.join(stored_replies.filter(F.col("status") == "ok").select("key"), "key", "left_anti")
