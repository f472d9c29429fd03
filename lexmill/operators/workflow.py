"""Generate, review, revise, judge: providers as strategies, and the workflow over batches of requests."""

from __future__ import annotations

import json
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


class Provider(ABC):
    """A source of texts and verdicts; each answer is a JSON text."""

    @abstractmethod
    def answer(self, role: str, payload: dict) -> str: ...


class OfflineProvider(Provider):
    """Deterministic answers for tests: a draft from the facts, a review that fails a draft with a marker."""

    def answer(self, role: str, payload: dict) -> str:
        if role == "write":
            return json.dumps({"title": payload["topic"], "body": "\n".join(payload["facts"])})
        if role == "review":
            bad = "[fix]" in payload["body"]
            return json.dumps({"pass": not bad, "issues": ["marker"] if bad else []})
        if role == "revise":
            return json.dumps({"title": payload["title"], "body": payload["body"].replace("[fix]", "").strip()})
        return json.dumps({"score": min(100, len(payload["body"]))})


PROVIDERS: dict[str, Callable[[], Provider]] = {"offline": OfflineProvider}


def provider(name: str) -> Provider:
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}")
    return PROVIDERS[name]()


def retried(call: Callable[[], str], attempts: int = 3, base: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The first answer without an error; waits double between attempts."""
    for i in range(attempts):
        try:
            return call()
        except (ConnectionError, TimeoutError):
            if i + 1 == attempts:
                raise
            sleep(base * 2**i)
    raise ValueError("no attempt was made")


def checked(p: Provider, role: str, payload: dict, keys: tuple[str, ...]) -> dict:
    """An answer that parses and has its keys; a bad one is asked for once more."""
    for left in (1, 0):
        try:
            got = json.loads(p.answer(role, payload))
            if all(k in got for k in keys):
                return got
        except ValueError:
            pass
        if not left:
            raise ValueError(f"{role}: the answer does not fit its schema")
    raise AssertionError


def one(p: Provider, topic: str | None, facts: list[str]) -> dict:
    """A request through the workflow: a passing review skips the revision; an empty request stops before the writer."""
    if not (topic or "").strip() or not facts:
        return {"state": "invalid_input", "title": None, "body": None, "revised": False, "score": None}
    try:
        d = checked(p, "write", {"topic": topic, "facts": facts}, ("title", "body"))
        r = checked(p, "review", d, ("pass", "issues"))
        if r["pass"] == bool(r["issues"]):
            raise ValueError("review: pass and issues contradict")
        if not r["pass"]:
            d = checked(p, "revise", d | {"issues": r["issues"]}, ("title", "body"))
        s = checked(p, "judge", d, ("score",))
    except ValueError as e:
        return {"state": f"failed: {e}", "title": None, "body": None, "revised": False, "score": None}
    return {"state": "done", "title": d["title"], "body": d["body"], "revised": not r["pass"], "score": int(s["score"])}


def run(requests: DataFrame, name: str = "offline") -> DataFrame:
    """(id, state, title, body, revised, score) of requests (id, topic, facts). A provider is made once a partition;
    Spark's own task retry takes the place of a scheduler."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = provider(name)
        for b in parts:
            rows = [{"id": i} | one(p, t, list(f) if f is not None else []) for i, t, f in zip(b["id"], b["topic"], b["facts"])]
            yield pd.DataFrame(rows, columns=["id", "state", "title", "body", "revised", "score"]).astype({"score": "Int64"})

    return requests.select("id", "topic", "facts").mapInPandas(batches, f"id {dict(requests.dtypes)['id']}, state string, title string, body string, revised boolean, score long")
