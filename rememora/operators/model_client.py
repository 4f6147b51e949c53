"""Calls to a language model inside the tasks: bounded concurrency, retries, and failures that stay rows.

A batch that cannot be answered does not end the job. It keeps its error, and its turns, with those of the
later batches of its chat, go back to the buffer: a chat is remembered in order, so nothing behind a failed
batch may pass it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rememora.functions import extraction
from rememora.operators.consolidate import extract_by_answers
from rememora.session import settle

# a client maps (system text, user text) to the answer
Client = Callable[[str, str], str]


class CallFailed(Exception):
    """What a client raises for an answer with a status; anything else it raises is a transport fault."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status

    def __reduce__(self):
        return CallFailed, (str(self), self.status)


@dataclass(frozen=True)
class CallPolicy:
    """Limits of one task's calls. Statuses of 400 to 499 are final; others and transport faults are tried again."""

    max_retries: int = 2
    in_flight: int = 8
    base_ms: int = 200
    cap_ms: int = 5_000
    sleep: Callable[[float], None] = time.sleep

    def delay_ms(self, attempt: int) -> int:
        return min(self.cap_ms, self.base_ms * 2 ** attempt)


def call(client: Client, system: str, user: str, policy: CallPolicy) -> tuple[str | None, str | None, int, int]:
    """``(answer, error, attempts, waited_ms)`` of one request; it never raises."""
    waited, error = 0, None
    for attempt in range(policy.max_retries + 1):
        try:
            answer = client(system, user)
            if isinstance(answer, str):
                return answer, None, attempt + 1, waited
            return None, "response missing string content", attempt + 1, waited
        except CallFailed as fault:
            error = f"{fault.status} {fault}" if fault.status is not None else str(fault)
            if fault.status is not None and 400 <= fault.status < 500:
                return None, error, attempt + 1, waited
        except Exception as fault:  # the network, or the client itself: perhaps not the next time
            error = str(fault) or type(fault).__name__
        if attempt < policy.max_retries:
            pause = policy.delay_ms(attempt)
            policy.sleep(pause / 1000)
            waited += pause
    return None, f"failed after {policy.max_retries + 1} attempts: {error}", policy.max_retries + 1, waited


def ask(batched: DataFrame, client: Client, policy: CallPolicy = CallPolicy()) -> DataFrame:
    """``(chat_id, batch, answer, error, attempts, waited_ms)``: exactly one of answer and error per batch.

    A task has at most ``in_flight`` calls open. Answers of a lost task are asked for again, so keep
    them in the extraction cache where calls cost money.
    """
    requests = batched.select("chat_id", "batch", extraction.prompt_messages(F.col("messages")).alias("prompt"))
    kinds = {f.name: f.dataType.simpleString() for f in requests.schema}

    def run(frames: Iterator[pd.DataFrame]):
        with ThreadPoolExecutor(policy.in_flight) as pool:
            for frame in frames:
                got = list(pool.map(lambda p: call(client, p[0]["content"], p[1]["content"], policy), frame["prompt"]))
                out = pd.DataFrame(got, columns=["answer", "error", "attempts", "waited_ms"], index=frame.index)
                yield pd.concat([frame[["chat_id", "batch"]], out], axis=1)

    return requests.mapInPandas(run, f"chat_id {kinds['chat_id']}, batch {kinds['batch']}, answer string, error string, attempts int, waited_ms long")


def extract_by_model(batched: DataFrame, client: Client, policy: CallPolicy = CallPolicy()) -> tuple[DataFrame, DataFrame]:
    """``(extracted, returned)``: facts of the batches that drain, and batches that stay in the buffer with their ``error``.

    A batch drains when it and all before it in its chat were answered, whatever the answer says: one that is
    not JSON has no facts and is counted as a parse failure. A batch that was answered but lies behind a failed
    one has a null error; its answer is not used.
    """
    asked = settle(ask(batched, client, policy), "answers")
    first = asked.filter(F.col("error").isNotNull()).groupBy("chat_id").agg(F.min("batch").alias("failed"))
    judged = settle(asked.join(first, "chat_id", "left"), "judged-answers")
    drains = F.col("failed").isNull() | (F.col("batch") < F.col("failed"))
    extracted = extract_by_answers(batched, judged.filter(drains).select("chat_id", "batch", "answer"))
    returned = batched.join(judged.filter(~drains).select("chat_id", "batch", "error", "attempts"), ["chat_id", "batch"])
    return extracted, returned


def back_to_buffer(returned: DataFrame) -> DataFrame:
    """Turns ``(chat_id, turn, role, text)`` of batches that did not drain, for the next run."""
    return returned.select("chat_id", F.posexplode("sources").alias("at", "turn"), "messages").select(
        "chat_id", "turn", F.get("messages", F.col("at"))["role"].alias("role"), F.get("messages", F.col("at"))["content"].alias("text"))
