"""Models as adapters that run inside a task: answers from text models, spans from token models.

No model comes with the library.  HTTP adapters use the standard library alone; those that need a package import it when they
are first used.  `Scripted` adapters answer from a table or a function and are what tests and dry runs take.
"""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from .model_output import extract, prompt

Found = tuple[str, int, int, str, float]


class TextModel(Protocol):
    name: str

    def complete(self, system: str, user: str, grammar: str | None = None, temperature: float = 0.0, max_tokens: int = 2048) -> str: ...


class SpanModel(Protocol):
    name: str

    def predict(self, text: str) -> list[Found]:
        """(label, start, end, value, score) in code points."""


def post(url: str, payload: dict, timeout: float = 120.0, retries: int = 3, headers: dict[str, str] | None = None, wait: Callable[[float], None] = time.sleep) -> Any:
    """POST JSON and read JSON, tried `retries` times with pauses of 0.1, 0.2, 0.4 s ...; the last error rises."""
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **(headers or {})})
    for k in range(max(1, retries)):
        try:
            with _opener().open(request, timeout=timeout) as answer:
                return json.loads(answer.read())
        except (urllib.error.URLError, TimeoutError, json.JSONDecodeError):
            if k + 1 >= retries:
                raise
            wait(0.1 * 2**k)
    raise AssertionError("unreachable")


_local = threading.local()


def _opener() -> urllib.request.OpenerDirector:
    """One opener for each thread of a worker, made when it is first needed."""
    if not hasattr(_local, "opener"):
        _local.opener = urllib.request.build_opener()
    return _local.opener


@dataclass
class Scripted:
    """A text model that answers from a function of the user prompt."""

    answer: Callable[[str], str]
    name: str = "scripted"

    def complete(self, system, user, grammar=None, temperature=0.0, max_tokens=2048) -> str:
        return self.answer(user)


@dataclass
class ScriptedSpans:
    """A token model that finds the values of a table: value -> (label, score)."""

    values: dict[str, tuple[str, float]]
    name: str = "scripted-spans"

    def predict(self, text: str) -> list[Found]:
        out = []
        for value, (label, score) in self.values.items():
            at = text.find(value)
            while value and at >= 0:
                out.append((label, at, at + len(value), value, score))
                at = text.find(value, at + len(value))
        return sorted(out, key=lambda f: f[1:3])


@dataclass
class ChatHttp:
    """A server with /api/chat, or on 404 /api/generate."""

    base_url: str = "http://localhost:11434"
    name: str = "llama3"
    timeout: float = 120.0
    retries: int = 3
    options: dict[str, Any] = field(default_factory=dict)

    def complete(self, system, user, grammar=None, temperature=0.1, max_tokens=2048) -> str:
        common = {"model": self.name, "stream": False, "format": "json", "options": {"temperature": temperature, "num_predict": max_tokens, **self.options}}
        try:
            messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
            return post(f"{self.base_url.rstrip('/')}/api/chat", common | {"messages": messages}, self.timeout, self.retries)["message"]["content"]
        except urllib.error.HTTPError as e:
            if e.code != 404:
                raise
        return post(f"{self.base_url.rstrip('/')}/api/generate", common | {"system": system, "prompt": user}, self.timeout, self.retries).get("response", "")


@dataclass
class CompletionsHttp:
    """A server with /v1/chat/completions (and /health), as served by batching inference servers."""

    base_url: str
    name: str
    key: str | None = None
    timeout: float = 120.0
    retries: int = 3

    def complete(self, system, user, grammar=None, temperature=0.0, max_tokens=2048) -> str:
        payload = {"model": self.name, "temperature": temperature, "max_tokens": max_tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        headers = {"Authorization": f"Bearer {self.key}"} if self.key else None
        return post(f"{self.base_url.rstrip('/')}/v1/chat/completions", payload, self.timeout, self.retries, headers)["choices"][0]["message"]["content"]

    def healthy(self, timeout: float = 2.0) -> bool:
        try:
            with _opener().open(f"{self.base_url.rstrip('/')}/health", timeout=timeout) as answer:
                return answer.status == 200
        except OSError:
            return False


@dataclass
class GrammarHttp:
    """A server with /completion that holds answers to a grammar."""

    base_url: str = "http://localhost:8080"
    name: str = "local"
    timeout: float = 120.0
    retries: int = 3

    def complete(self, system, user, grammar=None, temperature=0.0, max_tokens=2048) -> str:
        payload = {"prompt": f"{system}\n\n{user}", "temperature": temperature, "n_predict": max_tokens, "stop": ["</s>"]}
        return post(f"{self.base_url.rstrip('/')}/completion", payload | ({"grammar": grammar} if grammar else {}), self.timeout, self.retries)["content"]


@dataclass
class InferenceHttp:
    """A hosted text-generation endpoint that takes `inputs` and `parameters`."""

    url: str
    name: str
    token: str | None = None
    timeout: float = 120.0
    retries: int = 3

    def complete(self, system, user, grammar=None, temperature=0.01, max_tokens=2048) -> str:
        payload = {"inputs": f"{system}\n\n{user}", "parameters": {"temperature": max(temperature, 0.01), "max_new_tokens": max_tokens, "return_full_text": False}}
        got = post(self.url, payload, self.timeout, self.retries, {"Authorization": f"Bearer {self.token}"} if self.token else None)
        return (got[0] if isinstance(got, list) else got)["generated_text"]


@dataclass
class TokenClassifier:
    """A token-classification checkpoint, with a low-rank adapter merged in if one is named; needs `transformers` (and `peft`)."""

    model: str
    adapter: str | None = None
    name: str = "token-classifier"
    _pipe: Any = field(default=None, repr=False)

    def _load(self):
        from transformers import AutoModelForTokenClassification, AutoTokenizer, pipeline

        model = AutoModelForTokenClassification.from_pretrained(self.model)
        if self.adapter:
            from peft import PeftModel

            model = PeftModel.from_pretrained(model, self.adapter).merge_and_unload()
        self._pipe = pipeline("token-classification", model=model, tokenizer=AutoTokenizer.from_pretrained(self.model), aggregation_strategy="simple")

    def predict(self, text: str) -> list[Found]:
        if self._pipe is None:
            self._load()
        return [(p.get("entity_group") or p.get("entity"), p["start"], p["end"], p.get("word", ""), float(p.get("score", 1.0))) for p in self._pipe(text)]


# The labels that a prompted span model is asked for.
PROMPTED_LABELS = ["person", "organization", "address", "location", "email", "phone number", "date of birth", "date", "driver's license number"]


@dataclass
class PromptedSpans:
    """A model that finds spans of the labels it is told; needs `gliner`."""

    model: str
    threshold: float = 0.4
    labels: list[str] = field(default_factory=lambda: list(PROMPTED_LABELS))
    name: str = "prompted-spans"
    _model: Any = field(default=None, repr=False)

    def predict(self, text: str) -> list[Found]:
        if self._model is None:
            from gliner import GLiNER

            self._model = GLiNER.from_pretrained(self.model)
        return [(e["label"], e["start"], e["end"], text[e["start"] : e["end"]], float(e.get("score", 1.0))) for e in self._model.predict_entities(text, self.labels, threshold=self.threshold)]


# A narrative model's categories in the terms of token models; all others are account numbers.
NARRATIVE_LABELS = {
    "name": "private_person", "address": "private_address", "email": "private_email", "phone": "private_phone", "date": "private_date", "date_of_birth": "private_date", "url": "private_url", "username": "secret",
}


@dataclass
class Narrative:
    """A text model as a span model: its entities at every place where they stand; texts of more than max_chars are passed over."""

    text_model: TextModel
    max_chars: int = 8000
    fail: bool = False

    @property
    def name(self) -> str:
        return f"narrative({self.text_model.name})"

    def predict(self, text: str) -> list[Found]:
        if not text or len(text) > self.max_chars:
            return []
        system, user = prompt(text)
        out = []
        for category, value in extract(lambda: self.text_model.complete(system, user, None, 0.0, 2048), self.fail):
            at = text.find(value)
            while at >= 0:
                out.append((NARRATIVE_LABELS.get(category, "account_number"), at, at + len(value), value, 1.0))
                at = text.find(value, at + len(value))
        return out


def choose_narrative(requested: str = "disabled", batching: CompletionsHttp | None = None, chat: ChatHttp | None = None) -> tuple[str, Narrative | None]:
    """(name, model): disabled, batching, chat, or auto: the batching server if it answers, else the chat server.  Unknown names disable it."""
    if requested == "auto":
        requested = "batching" if batching is not None and batching.healthy() else "chat"
    model = {"batching": batching, "chat": chat}.get(requested)
    return (requested, Narrative(model)) if model is not None else ("disabled", None)


def choose_spans(requested: str, factories: dict[str, Callable[[], SpanModel]], fallback: str) -> tuple[str, SpanModel]:
    """The named model; where its files are missing, or the name is unknown, the fallback."""
    try:
        return requested, factories[requested]()
    except (KeyError, FileNotFoundError):
        return fallback, factories[fallback]()
