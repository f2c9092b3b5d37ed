"""Pictures sent to a model by an injected client, and its replies as rows.

A client is a picklable object with ``analyze(prompt, base64, mime)`` that gives
(text, model, tokens_in, tokens_out). It runs in the tasks, a call a picture; a
task has ``Options.calls_in_flight`` of them under way and gives their rows in order.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Protocol, TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import reply
from paperloom.options import Options

T = TypeVar("T")

#: What a reply holds, and of what type; failures that are tried again.
REPLY_FIELDS = {"summary": "a paragraph", "extracted_text": "all text that can be read", "visual_elements": "[{type, description, data_extracted}]", "tables": "[{title, headers, rows}]", "key_entities": "[names, dates, numbers]", "confidence": "high, medium or low", "notes": "what is unclear"}
NETWORK = ("ECONNRESET", "ETIMEDOUT", "ENOTFOUND", "EAI_AGAIN")
#: Replies that a task gathers before it passes them on.
ROWS_HELD = 20
#: Characters of a page's text that go along with its picture.
HINT = 4_000


class ModelClient(Protocol):
    def analyze(self, prompt: str, base64: str, mime: str) -> tuple[str, str, int | None, int | None]: ...


def _asked() -> str:
    return "Reply with one JSON object and nothing else: " + "; ".join(f'"{k}": {v}' for k, v in REPLY_FIELDS.items()) + "."


def image_prompt(context: Column) -> Column:
    """For a picture of its own."""
    return F.concat(F.lit("Look at this picture: its text, charts, diagrams, tables and photos. "), F.coalesce(F.concat(F.lit("Where it is from: "), F.nullif(context, F.lit("")), F.lit(". ")), F.lit("")), F.lit(_asked()))


def page_prompt(file: Column, label: Column, hint: Column) -> Column:
    """For a page that was drawn: its text layer, the first HINT characters, goes along."""
    layer = F.coalesce(F.concat(F.lit('Its text layer, which may be incomplete: """'), F.substring(F.nullif(hint, F.lit("")), 1, HINT), F.lit('""". ')), F.lit(""))
    return F.concat(F.lit('This is a page of "'), file, F.lit('"'), F.coalesce(F.concat(F.lit(", "), label), F.lit("")), F.lit(". Read its text and look at each chart, table and picture. "), layer, F.lit(_asked()))


def page_hints(visuals: DataFrame, sections: DataFrame) -> DataFrame:
    """``visuals`` with the text of the page that each shows; from sections (path, number, text)."""
    return visuals.join(sections.select("path", F.col("number").alias("page"), F.col("text").alias("hint")), ["path", "page"], "left")


def can_retry(e: BaseException) -> bool:
    status = getattr(e, "status", None) or 0
    return status == 429 or 500 <= status < 600 or (not status and getattr(e, "code", None) in NETWORK)


def with_retry(call: Callable[[], T], options: Options = Options(), wait: Callable[[float], None] = time.sleep) -> T:
    """What ``call`` gives; failures that may pass are tried again, each time after twice the wait."""
    for k in range(options.retries + 1):
        try:
            return call()
        except Exception as e:  # noqa: BLE001
            if k == options.retries or not can_retry(e):
                raise
            wait(options.first_wait * 2**k)
    raise AssertionError


def in_flight(call: Callable[[tuple], tuple], rows: Iterable[tuple], most: int) -> Iterator[tuple]:
    """What ``call`` gives of each row, in order, with ``most`` calls under way; no row is taken before there is room for it."""
    with ThreadPoolExecutor(max(1, most)) as pool:
        waiting: deque[Future] = deque()
        try:
            for row in rows:
                if len(waiting) >= max(1, most):
                    yield waiting.popleft().result()
                waiting.append(pool.submit(call, row))
            while waiting:
                yield waiting.popleft().result()
        finally:
            for call_ in waiting:
                call_.cancel()


def parse_reply(raw: Column) -> Column:
    """(parsed, summary, extracted_text, elements, tables, entities, confidence, notes) of a reply; an empty record of low confidence for no JSON."""
    json = reply.json_candidate(raw)
    ok = F.coalesce(reply.valid_json(json), F.lit(False))
    text = lambda field, default: F.when(ok, F.get_json_object(json, f"$.{field}")).otherwise(F.lit(default))
    size = lambda field: F.coalesce(F.json_array_length(F.when(ok, F.get_json_object(json, f"$.{field}"))), F.lit(0))
    return F.struct(
        ok.alias("parsed"), text("summary", "").alias("summary"), text("extracted_text", "").alias("extracted_text"), size("visual_elements").alias("elements"), size("tables").alias("tables"),
        size("key_entities").alias("entities"), text("confidence", "low").alias("confidence"), text("notes", "the reply is no JSON").alias("notes"),
    )


def analyze_visuals(visuals: DataFrame, client: ModelClient, provider: str, options: Options = Options()) -> DataFrame:
    """Analyses (file, visual_no, label, provider, model, latency, tokens_in, tokens_out, error, raw, and parse_reply's) of ``visuals``.

    ``visuals``: (file, visual_no, label, mime, base64, prompt). A call that fails for good is a row with an error, or ends
    the job with ``fail_fast``.
    """
    names = ["file", "visual_no", "label", "model", "latency", "tokens_in", "tokens_out", "error", "raw"]

    def one(row: tuple) -> tuple:
        file, number, label, mime, data, prompt = row
        began = time.monotonic()
        try:
            text, model, used, given, error = *with_retry(lambda: client.analyze(prompt, data, mime), options), None
        except Exception as e:  # noqa: BLE001
            if options.fail_fast:
                raise
            text, model, used, given, error = None, None, None, None, f"{type(e).__name__}: {e}"[:300]
        return file, number, label, model, int(1000 * (time.monotonic() - began)), used, given, error, text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (tuple(row) for batch in batches for row in batch.itertuples(index=False))
        held = []
        for done in in_flight(one, rows, options.calls_in_flight):
            held.append(done)
            if len(held) >= ROWS_HELD:
                yield pd.DataFrame(held, columns=names, dtype=object)
                held = []
        yield pd.DataFrame(held, columns=names, dtype=object)

    schema = "file string, visual_no int, label string, model string, latency long, tokens_in long, tokens_out long, error string, raw string"
    done = visuals.select("file", F.col("visual_no").cast("int"), "label", "mime", "base64", "prompt").mapInPandas(run, schema)
    return done.withColumn("provider", F.lit(provider)).withColumn("said", parse_reply(F.col("raw"))).select("file", "visual_no", "label", "provider", "model", "latency", "tokens_in", "tokens_out", "error", "raw", "said.*")
