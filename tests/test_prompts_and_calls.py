import threading
import time

import pytest
from pyspark.sql import functions as F

from sourceloom.operators import analysis
from sourceloom.operators.enrich import Retry, Throttle, call_with_retry, enrich, in_order, missing, prompt_key


def test_prompts(spark):
    files = spark.createDataFrame(
        [("a.go", "go", "source", "x%s$1\\"), ("go.mod", "go", "module", "m"), ("b.csproj", "csharp", "project", "p"),
         ("c.py", "python", "source", "q")], "path string, language string, type string, content string")
    rows = {r.path: r for r in analysis.with_analysis_prompt(files).collect()}
    assert rows["a.go"].prompt == analysis.PROMPTS["go_source"].replace("%s", "x%s$1\\")
    assert rows["go.mod"].prompt == analysis.PROMPTS["go_source"].replace("%s", "m")
    assert rows["b.csproj"].prompt == analysis.PROMPTS["csharp_project"].replace("%s", "p")
    assert rows["c.py"].prompt is None
    assert rows["a.go"].system_prompt == analysis.SYSTEM_PROMPT
    enhanced = {r.path: r for r in analysis.with_enhanced_prompt(files).collect()}
    assert enhanced["a.go"].prompt == analysis.ENHANCED_PROMPT.replace("%s", "go", 1).replace("\n\n%s\n", "\n\nx%s$1\\\n", 1)
    doc = {r.path: r.prompt for r in analysis.with_documentation_prompt(files).collect()}
    assert doc["c.py"] == "Please analyze this py code and provide comprehensive documentation:\n\nq"


def test_retry_delays():
    retry = Retry()
    assert [retry.delay(i, lambda: 0.5) for i in range(7)] == [1, 2, 4, 8, 16, 30, 30]
    assert retry.delay(0, lambda: 0.0) == pytest.approx(0.8) and retry.delay(0, lambda: 1.0) == pytest.approx(1.2)


def test_call_with_retry():
    slept, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("busy")
        return "ok"

    assert call_with_retry(flaky, Retry(), slept.append, lambda: 0.5) == ("ok", None)
    assert slept == [1, 2]

    def dead():
        raise ValueError("no")

    slept.clear()
    assert call_with_retry(dead, Retry(), slept.append, lambda: 0.5) == (None, "ValueError: no")
    assert slept == [1, 2, 4]


def test_throttle():
    now = [0.0]

    def sleep(seconds):
        now[0] += seconds

    acquire = Throttle(burst=2, per_second=4).acquirer(lambda: now[0], sleep)
    stamps = []
    for _ in range(6):
        acquire()
        stamps.append(round(now[0], 6))
    assert stamps == [0, 0, 0.25, 0.5, 0.75, 1.0]


def test_enrich(spark):
    prompts = spark.createDataFrame([(f"p{i}", f"q{i}") for i in range(20)], "path string, prompt string")

    def make():
        def client(system, prompt):
            if prompt == "q7":
                raise RuntimeError("refused")
            return prompt.upper()
        return client

    rows = enrich(prompts, make, Retry(retries=0), Throttle(100, 1000), parallelism=3)
    got = {r.path: r for r in rows.collect()}
    assert len(got) == 20 and got["p3"].response == "Q3" and got["p3"].error is None
    assert got["p7"].response is None and got["p7"].error == "RuntimeError: refused"
    keyed = prompt_key(prompts)
    stored = rows.join(keyed.select("path", "prompt_id"), "path")
    assert [r.path for r in missing(keyed, stored).collect()] == ["p7"]
    changed = prompt_key(prompts.withColumn("prompt", F.concat("prompt", F.lit("!"))))
    assert missing(changed, stored).count() == 20


def test_enrich_passes_system_prompt(spark):
    prompts = spark.createDataFrame([("a", "s", "p")], "path string, system_prompt string, prompt string")
    assert enrich(prompts, lambda: lambda s, p: s + p).first().response == "sp"


def test_calls_in_flight(spark):
    """100 calls of 0.1 s at width 10 in one task, with failures, answered in order."""
    prompts = spark.range(100).coalesce(1).selectExpr("concat('p', id) as path", "cast(id as string) as prompt", "id % 2 as half")

    def make():
        busy = [0]

        def client(_system, prompt):
            busy[0] += 1  # a client is one thread's
            assert busy[0] == 1
            time.sleep(0.1 if prompt != "0" else 0.4)
            busy[0] -= 1
            if int(prompt) % 10 == 7:
                raise RuntimeError("refused")
            return prompt

        return client

    rows = enrich(prompts, make, Retry(retries=0), in_flight=10, carry=["half"])
    began = time.monotonic()
    got = rows.collect()
    assert time.monotonic() - began < 5  # one after the other takes over ten
    assert [r.path for r in got] == [f"p{i}" for i in range(100)]
    assert all((r.response, r.error) == ((None, "RuntimeError: refused") if i % 10 == 7 else (str(i), None)) for i, r in enumerate(got))
    assert [r.half for r in got] == [i % 2 for i in range(100)]


def test_in_order_reads_no_further_than_its_width():
    read, running, most, lock = [], [0], [0], threading.Lock()

    def call(i):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.01 * (5 - i % 5))
        with lock:
            running[0] -= 1
        return i

    def calls():
        for i in range(30):
            read.append(i)
            yield lambda i=i: call(i)

    results = in_order(calls(), 4)
    assert [next(results) for _ in range(3)] == [0, 1, 2] and len(read) <= 8
    assert list(results) == list(range(3, 30)) and most[0] <= 4
    began = time.monotonic()
    assert list(in_order(((lambda: time.sleep(0.1)) for _ in range(100)), 10)) == [None] * 100
    assert time.monotonic() - began < 2


def test_throttle_holds_for_all_threads():
    acquire, stamps = Throttle(burst=1, per_second=100).acquirer(), []

    def call():
        acquire()
        stamps.append(time.monotonic())

    list(in_order([call] * 21, 7))
    assert max(stamps) - min(stamps) >= 0.18
