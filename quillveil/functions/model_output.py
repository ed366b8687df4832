"""What language models answer, as entities: fences, surrounding prose, wrappers and aliases of keys."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The categories, and the names that models give to a list of entities and to an entity's two fields.
CATEGORIES = [
    "name", "date_of_birth", "date", "address", "patient_id", "medical_record_number", "phone", "email", "url", "username", "generic_id", "ip_address", "healthcare_identifier",
    "organisation", "location", "tfn", "medicare", "abn", "acn", "driver_licence", "passport", "bsb_account", "centrelink_crn",
]
WRAPPERS = ["pii", "entities", "pii_entities", "personal_information", "redactions", "items", "results"]
CATEGORY_KEYS, VALUE_KEYS = ["category", "type", "entity_type", "label"], ["value", "text", "entity", "detected_text"]


class ExtractionError(ValueError):
    """An answer that can't be read, where that isn't to pass for an empty one."""


def category_name(raw: Column) -> Column:
    """A category as models write it (`PIICategory.Tax File`) in the form of the table: after the last full stop, lower, underscores."""
    return F.translate(F.lower(F.trim(F.substring_index(raw, ".", -1))), " -", "__")


def _unfenced(raw: str) -> str:
    text = raw.strip()
    if text.startswith("```"):
        text = text[3:].removeprefix("json").lstrip()
        text = text.rstrip().removesuffix("```")
    return text.strip()


def _listed(data: Any) -> list | None:
    """The list of entities in an answer of any of the known forms, or None."""
    if isinstance(data, list):
        return data
    if not isinstance(data, dict):
        return None
    if not data:
        return []
    if data.keys() & set(CATEGORY_KEYS) and data.keys() & set(VALUE_KEYS):
        return [data]
    for key in WRAPPERS:
        inner = data.get(key)
        got = inner if isinstance(inner, list) else _listed(inner) if isinstance(inner, dict) else None
        if got is not None:
            return got
    if (got := _listed(data.get("data"))) is not None:
        return got
    by_category = [(str(k).lower(), v) for k, v in data.items() if str(k).lower() in CATEGORIES]
    pairs = [{"category": k, "value": x} for k, v in by_category for x in (v if isinstance(v, list) else [v]) if isinstance(x, str)]
    return pairs or None


def _first(entity: dict, keys: list[str]) -> Any:
    return next((entity[k] for k in keys if entity.get(k)), None)


def entities_of(raw: str | None, fail: bool = False) -> list[tuple[str, str]]:
    """(category, value) of the entities in an answer; unknown categories and empty values are left out.

    An answer that can't be read has none, or with `fail` raises ExtractionError.
    """
    text = _unfenced(raw or "")
    if not text.startswith("["):
        a, b = text.find("{"), text.rfind("}")
        text = text[a : b + 1] if a >= 0 and b >= 0 else ""
    try:
        found = _listed(json.loads(text))
    except json.JSONDecodeError:
        found = None
    if found is None:
        if fail:
            raise ExtractionError("no list of entities in the answer")
        return []
    out = []
    for entity in found:
        if isinstance(entity, dict):
            category, value = _first(entity, CATEGORY_KEYS), _first(entity, VALUE_KEYS)
            name = str(category or "").split(".")[-1].strip().lower().replace(" ", "_").replace("-", "_")
            if value and name in CATEGORIES:
                out.append((name, value if isinstance(value, str) else str(value)))
    return out


def extract(ask: Callable[[], str], fail: bool = False) -> list[tuple[str, str]]:
    """Ask a model and read its answer: once, with nothing found if that fails; or, with `fail`, a second time if the answer can't be read, and then an error."""
    for last in ([True] if not fail else [False, True]):
        try:
            raw = ask()
        except Exception as e:
            if fail:
                raise ExtractionError("the model gave no answer") from e
            return []
        try:
            return entities_of(raw, fail)
        except ExtractionError:
            if last:
                raise
    return []


ENTITIES = "array<struct<category:string,value:string>>"
_KIND = pa.list_(pa.struct([("category", pa.string()), ("value", pa.string())]))


def with_entities(answers: DataFrame, raw_col: str, fail: bool = False, name: str = "entities") -> DataFrame:
    """answers with the entities that each raw answer holds; the forms nest to any depth, so this runs in Arrow batches."""
    from ..ship import ship

    ship(answers.sparkSession)
    at = answers.columns.index(raw_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"category": c, "value": v} for c, v in entities_of(r, fail)] for r in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, _KIND)], [*b.schema.names, name])

    return answers.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in answers.schema), f"{name} {ENTITIES}"]))


def result_items(response: Column) -> Column:
    """The items of a service's answer (JSON): the list itself, or what stands under `results`; an object or id of each as JSON."""
    v = F.try_parse_json(response)
    listed = F.try_variant_get(v, "$", "array<variant>")
    return F.coalesce(listed, F.try_variant_get(v, "$.results", "array<variant>"), F.array().cast("array<variant>"))


def item_id(item: Column) -> Column:
    """document_id, or else id, of an item."""
    def text(path: str) -> Column:
        got = F.try_variant_get(item, path, "string")
        return F.when(got != "", got)

    return F.coalesce(text("$.document_id"), text("$.id"))


def prompt(text: str, categories: Iterable[str] = CATEGORIES) -> tuple[str, str]:
    """(system, user): what a model is asked, with the text in a block of three quotes at the end."""
    names = ", ".join(f'"{c}"' for c in categories)
    system = "You find personally identifiable information in texts and give it back as JSON. You write nothing but the JSON object."
    user = (
        f'List all personally identifiable information in the text below as one JSON object {{"pii": [...]}}.\nEach item has "category", one of {names}, and "value", the exact characters as they stand in the text, '
        "without the punctuation around them.\nName every occurrence; a person's title belongs to the name; places of all kinds are addresses; numbers of unknown kind are generic_id. "
        f'Take no category that is not in the list. Without any such information answer {{"pii": []}}.\n\nText:\n"""\n{text}\n"""'
    )
    return system, user


def prompt_column(text: Column, categories: Iterable[str] = CATEGORIES) -> Column:
    """struct(system, user) of every text."""
    system, user = prompt("\x01", categories)
    before, after = user.split("\x01")
    return F.struct(F.lit(system).alias("system"), F.concat(F.lit(before), F.coalesce(text, F.lit("")), F.lit(after)).alias("user"))


def last_block(user: Column) -> Column:
    """The text in the last block of three quotes of a prompt, or null."""
    return F.regexp_extract(user, r'(?s).*"""\n?(.*?)\n?"""', 1)


def grammar(categories: Iterable[str] = CATEGORIES) -> str:
    """A GBNF grammar of the answers that `prompt` asks for."""
    names = " | ".join(rf'"\"{c}\""' for c in categories)

    def obj(*fields: tuple[str, str]) -> str:
        return r' ws "," ws '.join(rf'"\"{k}\":" ws {v}' for k, v in fields)

    rules = {
        "root": '"{" ws ' + obj(("pii", '"[" ws (entity (ws "," ws entity)*)? ws "]"')) + ' ws "}"',
        "entity": '"{" ws ' + obj(("category", "category"), ("value", "string")) + ' ws "}"',
        "category": names,
        "string": r'"\"" char* "\""',
        "char": r'[^"\\] | "\\" (["\\/bfnrt] | "u" [0-9a-fA-F]{4})',
        "ws": r"[ \t\n]*",
    }
    return "\n".join(f"{k} ::= {v}" for k, v in rules.items())
