"""Settings of an evaluation: defaults, a JSON or TOML file, and environment overrides, as one frozen record."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    top_pages: int = 5
    max_crops: int = 6
    retry_budget: int = 2
    neighbours_per_packet: int = 2
    context_budget: int = 6
    resamples: int = 1000
    seed: int = 42
    planner: str = "recorded"
    reasoner: str = "recorded"
    verifier: str = "recorded"


def load(path: str | None = None, prefix: str = "EVIDORA_", environ=os.environ) -> Settings:
    """Defaults, then the file's values, then variables such as EVIDORA_TOP_PAGES; unknown names raise."""
    given: dict = {}
    if path:
        with open(path, "rb") as f:
            given = tomllib.load(f) if path.endswith(".toml") else json.load(f)
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    unknown = set(given) - set(kinds)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    given |= {n: environ[prefix + n.upper()] for n in kinds if prefix + n.upper() in environ}
    return replace(Settings(), **{n: kinds[n](v) for n, v in given.items()})
