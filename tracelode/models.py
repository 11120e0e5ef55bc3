"""Text models that callers pass in: answers, structured answers, and which one a session would use. Nothing here opens a connection."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass

#: Provider to the environment variable that configures it, in order of preference.
CONFIGURED_BY = {"local": "LLM_BASE_URL", "anthropic": "ANTHROPIC_API_KEY", "openai": "OPENAI_API_KEY"}


@dataclass(frozen=True)
class Answer:
    """A model's text with the token counts that its provider told, if it did."""

    text: str
    input_tokens: int | None = None
    output_tokens: int | None = None


def answer(model, system: str, prompt: str) -> Answer:
    """What the model says; models may return plain strings."""
    said = model.generate(system, prompt)
    return said if isinstance(said, Answer) else Answer(said or "")


def structured(model, system: str, prompt: str, schema: dict) -> Answer:
    """An answer meant to be JSON of the schema: by the model's ``generate_structured``, else by asking for it in words.

    What comes back is read leniently (``functions.text.lenient_json``), so an
    answer in prose or in a fence still counts.
    """
    if hasattr(model, "generate_structured"):
        said = model.generate_structured(system, prompt, schema)
        if isinstance(said, Answer):
            return said
        return Answer(said if isinstance(said, str) else json.dumps(said))
    return answer(model, f"{system}\nAnswer with one JSON object of this schema and nothing else:\n{json.dumps(schema)}", prompt)


_MAKERS: dict[str, Callable] = {}


def register(provider: str, make: Callable) -> None:
    """``make(environment)`` returns an object with ``generate``."""
    _MAKERS[provider] = make


def choose_provider(environment: Mapping[str, str], preferred: str | None = None) -> str:
    """The preferred provider, else a local server if there is one, else the first with a key."""
    wanted = preferred or environment.get("TRACELODE_PROVIDER")
    if wanted:
        if wanted not in CONFIGURED_BY and wanted not in _MAKERS:
            raise ValueError(f"unknown provider {wanted}")
        return wanted
    for provider, variable in CONFIGURED_BY.items():
        if environment.get(variable):
            return provider
    raise LookupError("no model is configured: set one of " + ", ".join(CONFIGURED_BY.values()))


def make_model(environment: Mapping[str, str], preferred: str | None = None):
    """The registered model of the chosen provider."""
    provider = choose_provider(environment, preferred)
    if provider not in _MAKERS:
        raise LookupError(f"no adapter is registered for {provider}")
    return _MAKERS[provider](environment)
