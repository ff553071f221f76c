"""The seam for external models: units in, results, errors and attempts out.

A client is a plain function from a request to text, made on the executor by a
factory; a validator raises on a bad result.  A failed unit has a null result
and an error, its siblings go on; failures are raised once, after all.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

Client = Callable[[str], str]


def parse_json(content: str):
    """JSON out of a model's text: without fence, surroundings and trailing commas."""
    fenced = re.search(r"```[a-zA-Z]*[ \t]*\n(.*?)\n?```", content, re.S)
    body = fenced[1] if fenced else content
    found = re.search(r"[{\[].*[}\]]", body, re.S)
    if not found:
        raise ValueError("no JSON in the result")
    return json.loads(re.sub(r",(\s*[}\]])", r"\1", found[0]))


def scripted(answers: Iterable[str]) -> Callable[[], Client]:
    """A factory of clients that give the answers in turn; for tests, in one task."""
    answers = list(answers)

    def make() -> Client:
        queue = iter(answers)
        return lambda request: next(queue)

    return make


def with_feedback(request: str, answer: str | None, errors: list[str]) -> str:
    """A request that shows the last answer and all errors so far; for ``again``."""
    return json.dumps({"request": request, "answer": answer, "errors": errors}, ensure_ascii=False)


def ask(client: Client, request: str, validate: Callable[[object], object], attempts: int, before: Callable[[], None] = lambda: None, again: Callable[[str, str | None, list[str]], str] | None = None) -> tuple[str | None, str | None, int]:
    """Result as JSON text, error and attempts of one request; with ``again`` a further attempt is told the errors so far."""
    errors: list[str] = []
    answer = None
    for n in range(1, attempts + 1):
        before()
        try:
            answer = client(again(request, answer, errors) if again and errors else request)
            return json.dumps(validate(parse_json(answer)), ensure_ascii=False, separators=(",", ":")), None, n
        except StopIteration:
            return None, "the script has no more answers", n
        except Exception as e:  # a unit's failure is data; all are reported together
            errors.append(f"{type(e).__name__}: {e}")
    return None, errors[-1] if errors else None, attempts


def paced(per_second: float | None) -> Callable[[], None]:
    """Waits before each request so that a task sends no more than that."""
    gap, last = (1 / per_second if per_second else 0.0), [0.0]

    def wait() -> None:
        time.sleep(max(0.0, last[0] + gap - time.monotonic()))
        last[0] = time.monotonic()

    return wait


def run_stage(units: DataFrame, request: str, make_client: Callable[[], Client], validate: Callable[[object], object] = lambda x: x, attempts: int = 3, per_second: float | None = None, again: Callable[[str, str | None, list[str]], str] | None = None) -> DataFrame:
    """The units with ``result`` (JSON text, null if failed), ``error`` and ``attempts``.

    ``per_second`` limits the requests of each task; the number of partitions
    limits the tasks.
    """

    def run(frames):
        client, before = make_client(), paced(per_second)
        for frame in frames:
            told = [ask(client, text, validate, attempts, before, again) for text in frame[request]]
            results, errors, tries = ([t[i] for t in told] for i in range(3))
            yield frame.assign(result=pd.Series(results, dtype=object), error=pd.Series(errors, dtype=object), attempts=tries)

    schema = StructType([*units.schema.fields, StructField("result", StringType()), StructField("error", StringType()), StructField("attempts", IntegerType())])
    return units.mapInPandas(run, schema)


def raise_failures(results: DataFrame) -> DataFrame:
    """The results, if none failed; otherwise an error that says how many and shows the first."""
    failed = results.filter(F.col("result").isNull()).agg(F.count("*").alias("n"), F.min("error").alias("first")).first()
    if failed["n"]:
        raise RuntimeError(f"{failed['n']} units failed, such as: {failed['first']}")
    return results
