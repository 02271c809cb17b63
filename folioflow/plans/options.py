"""Options: defaults, then a JSON file, then FOLIOFLOW_* variables, then what the caller gives. Never changed in place."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Options:
    max_tokens: int = 2000
    overlap: int = 200
    split_by_sentence: bool = True
    strategy: str = "finest_granularity"
    strict_max_tokens: bool = False
    legal: bool = False
    custom_patterns: tuple[str, ...] = ()

    def __post_init__(self):
        if self.max_tokens <= 0 or not 0 <= self.overlap < self.max_tokens:
            raise ValueError("max_tokens must be positive, and overlap from 0 to below it")


@dataclass(frozen=True)
class HeadingModel:
    enabled: bool = False
    provider: str = "custom"
    max_texts: int = 20
    max_batch_tokens: int = 3000
    attempts: int = 3
    classify: Callable[[list[str]], str] | None = field(default=None, compare=False)


#: domain -> type -> (max_tokens, overlap, strategy); "" is the domain's own.
DOMAINS: dict[str, dict[str, tuple[int, int, str]]] = {
    "legal": {"": (1500, 100, "finest_granularity")},
    "contract": {"": (2000, 200, "finest_granularity"), "service": (1800, 150, "finest_granularity"), "purchase": (2200, 200, "finest_granularity"), "employment": (1600, 100, "finest_granularity"), "partnership": (2500, 250, "all_levels"), "general": (2000, 200, "finest_granularity")},
    "regulation": {"": (1800, 150, "finest_granularity"), "hr": (1600, 120, "finest_granularity"), "finance": (2000, 180, "finest_granularity"), "operation": (2200, 200, "all_levels"), "safety": (1500, 100, "finest_granularity"), "general": (1800, 150, "finest_granularity")},
}

_ENV = {"FOLIOFLOW_MAX_TOKENS": "max_tokens", "FOLIOFLOW_OVERLAP": "overlap", "FOLIOFLOW_STRICT_MAX_TOKENS": "strict_max_tokens", "FOLIOFLOW_SPLIT_BY_SENTENCE": "split_by_sentence", "FOLIOFLOW_STRATEGY": "strategy", "FOLIOFLOW_LEGAL": "legal"}
_MODEL_ENV = {"FOLIOFLOW_LLM_ENABLED": "enabled", "FOLIOFLOW_LLM_PROVIDER": "provider", "FOLIOFLOW_LLM_BATCH_SIZE": "max_texts", "FOLIOFLOW_LLM_RETRY_TIMES": "attempts", "FOLIOFLOW_LLM_BATCH_TOKENS": "max_batch_tokens"}


def _typed(value: str, like):
    if isinstance(like, bool):
        return value.strip().lower() in ("true", "1", "yes", "on")
    return type(like)(value)


def _merged(base, given: dict, env: dict[str, str]):
    names = {f.name for f in fields(base)}
    known = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in names}
    for var, name in env.items():
        if var in os.environ:
            try:
                known[name] = _typed(os.environ[var], getattr(base, name))
            except ValueError:
                continue  # a variable that can't be read leaves the value before it
    return replace(base, **known)


def load(path: str | None = None, **given) -> tuple[Options, HeadingModel]:
    """Options and heading model; unknown names in the file are ignored, those given are an error."""
    data = {}
    if path:
        data = json.loads(Path(path).read_text("utf-8"))
    options = _merged(Options(), data.get("document", {}), _ENV)
    return replace(options, **given), _merged(HeadingModel(), data.get("llm", {}), _MODEL_ENV)


def save(options: Options, path: str) -> None:
    Path(path).write_text(json.dumps({"document": asdict(options)}, ensure_ascii=False, indent=2), "utf-8")


def for_domain(domain: str, kind: str = "", **given) -> Options:
    """Explicit options, then those of the type, then those of the domain."""
    types = DOMAINS[domain]
    size, overlap, strategy = types.get(kind, types[""])
    return Options(**({"max_tokens": size, "overlap": overlap, "strategy": strategy, "strict_max_tokens": True, "legal": domain == "legal"} | given))


def known(function: Callable, given: dict) -> dict:
    """Only the arguments that ``function`` takes."""
    import inspect

    return {k: v for k, v in given.items() if k in inspect.signature(function).parameters}
