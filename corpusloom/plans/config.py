"""Settings of a run as frozen dataclasses, read from TOML or JSON; unknown keys are errors."""

from __future__ import annotations

import json
import tomllib
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import get_type_hints

from corpusloom.functions.chunk import Policy
from corpusloom.functions.score import Heuristics
from corpusloom.operators.screen import MIN_SCORE, MODES

DEDUP = ("none", "exact", "near")


@dataclass(frozen=True)
class Source:
    kind: str
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Sink:
    kind: str
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in ("jsonl", "jsonl_gz", "prompts", "parquet"):
            raise ValueError(f"no sink {self.kind!r}")


@dataclass(frozen=True)
class Quality:
    mode: str = "off"
    min_score: float | None = MIN_SCORE
    dedup: str = "none"
    drop_near_dups: bool = False
    heuristics: Heuristics = Heuristics()

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"quality.mode must be one of {', '.join(MODES)}")
        if self.dedup not in DEDUP:
            raise ValueError(f"quality.dedup must be one of {', '.join(DEDUP)}")


@dataclass(frozen=True)
class Safety:
    mode: str = "off"
    allowed_licenses: tuple[str, ...] = ()
    toxicity_threshold: float | None = None

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"safety.mode must be one of {', '.join(MODES)}")


@dataclass(frozen=True)
class Config:
    sources: tuple[Source, ...] = ()
    sinks: tuple[Sink, ...] = ()
    chunk: Policy = Policy()
    quality: Quality = Quality()
    safety: Safety = Safety()
    languages: bool = False
    extract_kql: bool = False
    decode_cap: int | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    max_error_rate: float | None = None
    #: Find the licence of each repository where neither a file nor ``metadata`` names one.
    find_licences: bool = False

    def __post_init__(self):
        if clash := {"text", "content", "path"} & set(self.metadata):
            raise ValueError(f"metadata can't set {', '.join(sorted(clash))}")
        if self.max_error_rate is not None and not 0 <= self.max_error_rate <= 1:
            raise ValueError("max_error_rate must lie in 0..1")
        out = [s.options.get("path") for s in self.sinks]
        if len({p for p in out if p}) < len([p for p in out if p]):
            raise ValueError("two sinks write to one path")


_LISTS = {"sources": Source, "sinks": Sink}


def _build(cls, data: dict, where: str):
    if not isinstance(data, dict):
        raise ValueError(f"{where or 'the config'} must be a table")
    known = {f.name for f in fields(cls)}
    if unknown := sorted(set(data) - known):
        raise ValueError(f"{where or 'the config'} doesn't know {', '.join(unknown)}; it takes {', '.join(sorted(known))}")
    types, out = get_type_hints(cls), {}
    for k, v in data.items():
        t = types[k]
        if cls is Config and k in _LISTS:
            out[k] = tuple(_build(_LISTS[k], x, f"{k}[{i}]") for i, x in enumerate(v))
        elif is_dataclass(t):
            out[k] = _build(t, v, k)
        else:
            out[k] = tuple(v) if isinstance(v, list) else v
    return cls(**out)


def from_dict(data: dict) -> Config:
    return _build(Config, data, "")


def to_dict(config: Config) -> dict:
    return json.loads(json.dumps(asdict(config)))


def load(path: str) -> Config:
    with open(path, "rb") as f:
        raw = f.read()
    return from_dict(tomllib.loads(raw.decode()) if path.endswith(".toml") else json.loads(raw))


def shards(config: Config, source: int, option: str, targets: list[str], n: int) -> list[Config]:
    """One config for each of n contiguous parts of a source's targets, with outputs of its own."""
    if n < 1:
        raise ValueError("n must be positive")
    base, extra = divmod(len(targets), n)
    out, at, data = [], 0, to_dict(config)
    for k in range(n):
        size = base + (k < extra)
        part = json.loads(json.dumps(data))
        part["sources"][source]["options"][option] = targets[at : at + size]
        for s in part["sinks"]:
            if "path" in s["options"]:
                s["options"]["path"] = f"{s['options']['path'].rstrip('/')}/shard-{k + 1:05d}"
        at += size
        out.append(from_dict(part))
    return out
