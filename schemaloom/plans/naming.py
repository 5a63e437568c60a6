"""Naming proposals from outside: an interface, a provider that replays recorded answers, and retries. No query needs one."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from schemaloom.plans.settings import Settings
from schemaloom.sources.files import proposal

#: Failures that a later attempt may not meet.
PASSING = ("429", "500", "502", "503", "504", "timeout", "temporarily", "overloaded", "rate limit", "unavailable")


class NamingProvider(Protocol):
    """Answers a prompt with a JSON document, as text."""

    def available(self) -> bool: ...

    def answer(self, prompt: str, temperature: float) -> str: ...


class NoProvider:
    """There is none; runs that need one are left out."""

    def available(self) -> bool:
        return False

    def answer(self, prompt: str, temperature: float) -> str:
        raise RuntimeError("no naming provider is set")


class Replay:
    """Recorded answers by temperature, each list gone through in order."""

    def __init__(self, answers: dict[float, list[str]]):
        self.answers = {t: list(x) for t, x in answers.items()}

    def available(self) -> bool:
        return any(self.answers.values())

    def answer(self, prompt: str, temperature: float) -> str:
        return self.answers[temperature].pop(0)


def asked(provider: NamingProvider, prompt: str, temperature: float, settings: Settings = Settings(), sleep: Callable[[float], None] = time.sleep) -> str:
    """An answer; failures that may pass are tried again after a growing pause."""
    for attempt in range(settings.attempts):
        try:
            return provider.answer(prompt, temperature)
        except Exception as e:
            if attempt + 1 == settings.attempts or not any(x in str(e).lower() for x in PASSING):
                raise
            sleep(settings.pause * 2**attempt)
    raise RuntimeError("no attempt was made")


def read_answer(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """The answer's document as one row; null fields where it can't be read."""
    return proposal(spark.createDataFrame([(text,)], "answer string"), schema)


def inlined(schema: dict) -> dict:
    """A JSON schema without references, titles and defaults, as providers ask for it."""
    known = schema.get("$defs", {})

    def walk(x):
        if isinstance(x, dict):
            if "$ref" in x:
                return walk(known[x["$ref"].rpartition("/")[2]])
            return {k: walk(v) for k, v in x.items() if k not in ("$defs", "title", "default", "additionalProperties", "$schema")}
        return [walk(v) for v in x] if isinstance(x, list) else x

    return walk(schema)
