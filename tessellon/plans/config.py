"""Rules from files: JSON, or YAML where its library is there, checked before they become Columns and parameters.

What is wrong is named by its place in the file (``rules[2].then.backend``). Missing sections have the defaults of the code.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

from tessellon.functions import text as tx
from tessellon.operators import routing
from tessellon.operators.chunking import ChunkConfig
from tessellon.operators.gates import Rule

try:
    import yaml
except ImportError:  # optional: JSON is always read
    yaml = None

BACKENDS = ("faiss", "weaviate", "pinecone")


class ConfigError(ValueError):
    pass


def load(spark: SparkSession, path: str) -> dict[str, Any]:
    """A file's content; an empty file is an empty one, a missing file is an error."""
    text = spark.read.text(path, wholetext=True).first()
    text = text[0] if text else ""
    if path.endswith((".yaml", ".yml")):
        if yaml is None:
            raise ConfigError(f"{path}: reading YAML needs a library that isn't there; JSON needs none")
        got = yaml.safe_load(text)
    else:
        got = json.loads(text) if text.strip() else None
    if not isinstance(got or {}, dict):
        raise ConfigError(f"{path}: a mapping is needed at the top")
    return got or {}


def _need(test: bool, place: str, what: str) -> None:
    if not test:
        raise ConfigError(f"{place}: {what}")


def _text(value: Any, place: str) -> str:
    _need(isinstance(value, str) and value.strip() != "", place, "a text is needed")
    return value


def _number(value: Any, place: str) -> float:
    _need(isinstance(value, (int, float)) and not isinstance(value, bool), place, "a number is needed")
    return float(value)


def _texts(value: Any, place: str) -> list[str]:
    _need(isinstance(value, list) and len(value) > 0, place, "a list of texts is needed")
    return [_text(v, f"{place}[{k}]") for k, v in enumerate(value)]


def _section(config: dict, name: str, kind: type, known: Sequence[str] | None = None) -> Any:
    got = config.get(name, kind())
    _need(isinstance(got, kind), name, f"a {'mapping' if kind is dict else 'list'} is needed")
    if known is not None:
        for key in got:
            _need(key in known, f"{name}.{key}", f"not known; known are {', '.join(known)}")
    return got


@dataclass(frozen=True)
class Router:
    """Weights, rules in order, personas' backends, the order of fallbacks and how many hits are asked for."""

    weights: dict[str, float] = field(default_factory=lambda: {"similarity": 0.6, "recency": 0.3, "diversity": 0.1})
    rules: tuple[tuple[tuple[str, ...], str, str], ...] = ()
    bias: dict[str, str] = field(default_factory=dict)
    fallback: tuple[str, ...] = BACKENDS
    top_k: int = 10

    def decide(self, query: Column, persona: Column | None = None) -> Column:
        return routing.decide(query, persona, [(list(k), b, r) for k, b, r in self.rules], self.bias)

    def rescore(self, hits: DataFrame, as_of: Column, kind: str = "neg_distance") -> DataFrame:
        return routing.rescore(hits, as_of, self.weights, kind)


def router(config: dict[str, Any]) -> Router:
    weights = {k: _number(v, f"weights.{k}") for k, v in _section(config, "weights", dict, ("similarity", "recency", "diversity")).items()}
    _need(all(v >= 0 for v in weights.values()), "weights", "none may be negative")
    backend = lambda value, place: _need(value in BACKENDS, place, f"one of {', '.join(BACKENDS)} is needed") or value
    bias = {_text(k, "persona_bias"): backend(v, f"persona_bias.{k}") for k, v in _section(config, "persona_bias", dict).items()}
    rules = []
    for k, rule in enumerate(_section(config, "rules", list)):
        place = f"rules[{k}]"
        _need(isinstance(rule, dict) and isinstance(rule.get("if"), dict) and isinstance(rule.get("then"), dict), place, "`if` and `then` are needed")
        words = [w.lower() for w in _texts(rule["if"].get("has_keywords"), f"{place}.if.has_keywords")]
        rules.append((tuple(words), backend(rule["then"].get("backend"), f"{place}.then.backend"), _text(rule["then"].get("reason"), f"{place}.then.reason")))
    fallback = [backend(b, f"fallback_order[{k}]") for k, b in enumerate(_section(config, "fallback_order", list))]
    _need(len(set(fallback)) == len(fallback), "fallback_order", "a backend stands there twice")
    top_k = config.get("top_k_default", 10)
    _need(isinstance(top_k, int) and top_k > 0, "top_k_default", "a positive whole number is needed")
    return Router(Router().weights | weights, tuple(rules), bias, tuple(fallback) or BACKENDS, top_k)


def tag_rules(config: dict[str, Any], section: str) -> list[tuple[str, list[str]]]:
    """Names with their key words (a mapping of lists), in the file's order, for text.tags."""
    return [(_text(k, section), [w.lower() for w in _texts(v, f"{section}.{k}")]) for k, v in _section(config, section, dict).items()]


def tagged(config: dict[str, Any], section: str, text: Column) -> Column:
    return tx.tags(text, tag_rules(config, section))


def chunking(config: dict[str, Any]) -> ChunkConfig:
    """target_tokens, overlap_tokens, short_doc_threshold_tokens and boundary_tolerance_chars over the defaults."""
    names = {"target_tokens": "target", "overlap_tokens": "overlap", "short_doc_threshold_tokens": "short", "boundary_tolerance_chars": "tolerance"}
    got = {}
    for key, value in config.items():
        if key in names:
            _need(isinstance(value, int) and not isinstance(value, bool) and value >= 0, key, "a whole number from 0 is needed")
            got[names[key]] = value
    made = ChunkConfig(**got)
    _need(made.overlap < made.target, "overlap_tokens", "must be less than target_tokens")
    return made


def gate_rules(config: dict[str, Any]) -> list[Rule]:
    """Checks of gates: {gate: {id: {metric, low, high, warn_low, warn_high}}}; a check needs a bound, and its warnings lie outside of its bounds."""
    bounds = [f.name for f in fields(Rule) if f.name not in ("gate", "id", "metric")]
    out = []
    for gate, checks in _section(config, "gates", dict).items():
        _need(isinstance(checks, dict), f"gates.{gate}", "a mapping is needed")
        for name, check in checks.items():
            place = f"gates.{gate}.{name}"
            _need(isinstance(check, dict), place, "a mapping is needed")
            for key in check:
                _need(key == "metric" or key in bounds, f"{place}.{key}", "not known")
            rule = Rule(gate, name, _text(check.get("metric"), f"{place}.metric"), **{k: _number(check[k], f"{place}.{k}") for k in bounds if check.get(k) is not None})
            _need(rule.low is not None or rule.high is not None, place, "low or high is needed")
            _need(rule.low is None or rule.high is None or rule.low <= rule.high, place, "low is above high")
            _need(rule.warn_low is None or (rule.low is not None and rule.warn_low <= rule.low), f"{place}.warn_low", "must lie below low")
            _need(rule.warn_high is None or (rule.high is not None and rule.warn_high >= rule.high), f"{place}.warn_high", "must lie above high")
            out.append(rule)
    return out
