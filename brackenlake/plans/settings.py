"""Settings in layers: defaults, the user's file, the project's file, the environment; a later layer's section replaces an earlier one whole."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from pathlib import Path

from .planner import merge_settings, validate

DEFAULTS = {"retrieval": {"max_files": 20, "candidate_k": 100, "lexical_weight": 1.0, "structural_weight": 0.4}, "context": {"token_budget": 8000, "max_lines": 15, "docs_share": 0.45}}
PREFIX = "BRACKENLAKE_"


def from_environment(env: Mapping[str, str] | None = None) -> dict:
    """Sections from variables like BRACKENLAKE_RETRIEVAL__MAX_FILES; numbers are read as such."""
    out: dict = {}
    for k, v in (os.environ if env is None else env).items():
        if k.startswith(PREFIX) and "__" in k:
            section, name = k[len(PREFIX) :].lower().split("__", 1)
            try:
                value: object = float(v) if "." in v else int(v)
            except ValueError:
                value = v
            out.setdefault(section, {})[name] = value
    return out


def load(*files: str | Path, env: Mapping[str, str] | None = None) -> dict:
    """All layers put together, files that are missing left out; raises ValueError with all that is wrong."""
    layers = [tomllib.loads(Path(f).read_text(encoding="utf-8")) for f in files if Path(f).is_file()]
    out = merge_settings(DEFAULTS, *layers)
    for section, values in from_environment(env).items():
        out[section] = {**out.get(section, {}), **values}
    wrong = [w for s in out.values() if isinstance(s, dict) for w in validate(s)]
    if wrong:
        raise ValueError("; ".join(wrong))
    return out
