"""Settings and rules on the driver: JSON, or YAML where its package is there; a rules file is written with its defaults when it is missing."""

from __future__ import annotations

import json
from pathlib import Path


def load_config(path: str) -> dict:
    """The mapping in a .json or .yml file; an empty file is an empty mapping."""
    text = Path(path).read_text(encoding="utf-8-sig")
    if path.endswith(".json"):
        return json.loads(text) if text.strip() else {}
    try:
        import yaml
    except ImportError as e:
        raise ImportError("YAML settings need the yaml package; a .json file does not") from e
    return yaml.safe_load(text) or {}


def load_rules(path: str, defaults: dict) -> dict:
    """The rules in a file over the defaults; a file that is missing is written first."""
    file = Path(path)
    if not file.exists():
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(json.dumps(defaults, ensure_ascii=False, indent=1), encoding="utf-8")
        return dict(defaults)
    return {**defaults, **load_config(path)}


def sample_bounds(config: dict, first: str = "1996Q3", last: str = "1999Q2", regime: str = "1998Q1") -> tuple[str, str, str]:
    """(first period, last period, first period of the later regime) of the settings, or the values given."""
    own = config.get("sample", {})
    return own.get("first", first), own.get("last", last), own.get("regime", regime)
