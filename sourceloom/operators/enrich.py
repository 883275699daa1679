"""Model calls over rows, as one Arrow-batched Spark job."""

from __future__ import annotations

import random
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "path string, response string, error string"


# Retry defaults.
@dataclass(frozen=True)
class Retry:
    retries: int = 3
    base_delay: float = 1.0
    factor: float = 2.0
    max_delay: float = 30.0
    jitter: float = 0.2

    def delay(self, attempt: int, rand: Callable[[], float] = random.random) -> float:
        raw = min(self.base_delay * self.factor**attempt, self.max_delay)
        return raw * (1 + self.jitter * (2 * rand() - 1))


@dataclass(frozen=True)
class Throttle:
    """Token bucket of one task: burst size and calls per second."""

    burst: float
    per_second: float

    def acquirer(
        self, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep
    ) -> Callable[[], None]:
        """Calls are due one after the other, ``1 / per_second`` apart; up to ``burst`` of them
        (one at least) may be ahead of their time. Threads take their turns under a lock and
        wait outside it."""
        gap = 1 / self.per_second
        ahead = (max(self.burst, 1) - 1) * gap
        due, turn = clock(), threading.Lock()

        def acquire() -> None:
            nonlocal due
            with turn:
                now = clock()
                wait = due - now - ahead
                due = max(due, now) + gap
            if wait > 0:
                sleep(wait)

        return acquire


def call_with_retry(
    call: Callable[[], str], retry: Retry,
    sleep: Callable[[float], None] = time.sleep, rand: Callable[[], float] = random.random,
) -> tuple[str | None, str | None]:
    """``(response, None)``, or ``(None, last error)`` when every attempt failed."""
    error = None
    for attempt in range(retry.retries + 1):
        try:
            return call(), None
        except Exception as exc:  # a failed call becomes a row
            error = f"{type(exc).__name__}: {exc}"
        if attempt < retry.retries:
            sleep(retry.delay(attempt, rand))
    return None, error


def in_order(calls: Iterable[Callable[[], object]], width: int) -> Iterator[object]:
    """Results of the calls, in their order, with at most ``width`` calls begun ahead of the
    one whose result is next. ``calls`` is read no further than that."""
    if width <= 1:
        yield from (call() for call in calls)
        return
    with ThreadPoolExecutor(width) as pool:
        begun: deque[Future] = deque()
        try:
            for call in calls:
                if len(begun) == width:
                    yield begun.popleft().result()
                begun.append(pool.submit(call))
            while begun:
                yield begun.popleft().result()
        finally:
            for left in begun:
                left.cancel()


def enrich(
    prompts: DataFrame,
    make_client: Callable[[], Callable[[str | None, str], str]],
    retry: Retry = Retry(),
    throttle: Throttle | None = None,
    parallelism: int | None = None,
    in_flight: int = 1,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``path, response, error`` and the ``carry`` columns for rows ``path, [system_prompt,] prompt``.

    A task has up to ``in_flight`` calls under way, ``parallelism`` bounds the tasks. Answers
    come in the order of the prompts, whichever is ready first. ``make_client`` runs once in
    each thread of a task that calls, and returns ``client(system_prompt, prompt)``; a client
    need not be safe to share. The throttle holds for a task as a whole; a call that waits for
    another try keeps its place. A call that fails for good becomes a row with its error. A
    lost task calls again: write the result to a table and pass only ``missing`` rows when
    running again. Null prompts are passed on as they are; an empty table calls nothing.
    """
    system = "system_prompt" in prompts.columns
    rows = prompts.select("path", "prompt", *(["system_prompt"] if system else []), *carry)
    if parallelism:
        rows = rows.repartition(parallelism)
    schema = ", ".join([RESULT, *(f"`{c}` {prompts.schema[c].dataType.simpleString()}" for c in carry)])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = threading.local()
        acquire = throttle.acquirer() if throttle else (lambda: None)

        def once(system_prompt: str | None, prompt: str) -> str:
            if not hasattr(own, "client"):
                own.client = make_client()
            acquire()
            return own.client(system_prompt, prompt)

        sizes: deque[pd.DataFrame] = deque()

        def calls() -> Iterator[Callable[[], tuple[str | None, str | None]]]:
            for batch in batches:
                if len(batch):
                    sizes.append(batch)
                systems = batch["system_prompt"] if system else [None] * len(batch)
                for s, p in zip(systems, batch["prompt"], strict=True):
                    yield lambda s=s, p=p: call_with_retry(lambda: once(s, p), retry)

        answers: list[tuple[str | None, str | None]] = []
        for answer in in_order(calls(), in_flight):
            answers.append(answer)
            if len(answers) == len(sizes[0]):  # the oldest batch is complete
                batch = sizes.popleft()
                done = pd.DataFrame({"path": batch["path"], "response": [a[0] for a in answers], "error": [a[1] for a in answers]})
                yield done.assign(**{c: batch[c] for c in carry})
                answers = []

    return rows.mapInPandas(run, schema)


def prompt_key(prompts: DataFrame) -> DataFrame:
    """The prompts with ``prompt_id``, which changes with their text."""
    system = F.coalesce("system_prompt", F.lit("")) if "system_prompt" in prompts.columns else F.lit("")
    return prompts.withColumn("prompt_id", F.sha2(F.concat_ws("\n", F.sha2(system, 256), "prompt"), 256))


def missing(prompts: DataFrame, stored: DataFrame) -> DataFrame:
    """Prompts (``path, prompt_id``) without a stored good answer to just this prompt."""
    return prompts.join(stored.where("error is null").select("path", "prompt_id"), ["path", "prompt_id"], "left_anti")
