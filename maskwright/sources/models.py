"""Text models behind HTTP, and a stand-in for tests."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import WS
from ..operators.model_matches import prompt
from .files import provided

STATUS_SECONDS, REPLY_SECONDS = 1.2, 180.0


@dataclass
class ModelStatus:
    available: bool
    base_url: str
    model: str = ""
    models: list[str] = field(default_factory=list)
    error: str | None = None


def choose(models: list[str], wanted: str | None) -> str | None:
    """As ``operators.model_matches.pick_model``, on the driver."""
    if not models:
        return wanted or None
    if wanted and wanted in models:
        return wanted
    return next((m for m in models if "instruct" in m.lower()), models[0])


def status(base_url: str, wanted: str | None = None, get: Callable[[str, float], bytes] | None = None) -> ModelStatus:
    """The models a host lists; any failure means that none is available."""
    try:
        listed = json.loads((get or _get)(f"{base_url}/api/tags", STATUS_SECONDS))
        models = [m["name"] for m in listed.get("models") or []]
    except Exception as e:  # an unreachable host is an answer
        return ModelStatus(False, base_url, wanted or "", [], str(e))
    return ModelStatus(bool(models), base_url, choose(models, wanted) or "", models)


def _get(url: str, seconds: float) -> bytes:
    with urllib.request.urlopen(url, timeout=seconds) as r:
        return r.read()


def http_reply(base_url: str, model: str) -> Callable[[str], str]:
    """A function from a prompt to the model's raw reply."""

    def reply(text: str) -> str:
        body = json.dumps({"model": model, "prompt": text, "stream": False, "format": "json", "options": {"temperature": 0}}).encode()
        request = urllib.request.Request(f"{base_url}/api/generate", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=REPLY_SECONDS) as r:
            return json.loads(r.read()).get("response") or ""

    return reply


def prompts(pages: DataFrame, instructions: str) -> DataFrame:
    """Rows (doc_id, page, prompt) for the pages that are not blank."""
    return pages.where(F.regexp_replace("text", WS + "+", "") != "").select("doc_id", "page", prompt(F.col("text"), instructions).alias("prompt"))


def model_replies(pages: DataFrame, instructions: str, reply: Callable[[str], str], concurrency: int = 1) -> DataFrame:
    """Rows (doc_id, page, raw) for the pages that are not blank; a failed call gives an empty reply.

    Calls are made by ``concurrency`` tasks at most: a host that queues
    requests would let the later ones run out of time.
    """

    def call(batch: pd.DataFrame) -> pd.DataFrame:
        raw = []
        for text in batch.prompt:
            try:
                raw.append(reply(text))
            except Exception:  # a page without a reply has no findings
                raw.append("")
        return pd.DataFrame({"doc_id": batch.doc_id, "page": batch.page, "raw": raw})

    return provided(prompts(pages, instructions), "doc_id long, page int, raw string", call, concurrency)
