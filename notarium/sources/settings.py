"""Configuration on the driver: collections and contexts in a JSON file, settings from layered files and the environment."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path


#: How a switch may be written.
_SWITCH = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}


@dataclass
class Settings:
    """Numbers that the engine works with; from_env reads NOTARIUM_<NAME>."""

    chunk_min_tokens: int = 120
    chunk_target_tokens: int = 220
    chunk_max_tokens: int = 320
    chunk_overlap: float = 0.12
    rerank_pool: int = 25
    neighbour_radius: int = 1
    results_per_document: int = 2
    session_policy: str = "penalize"
    session_penalty: float = 0.65
    session_most: int = 1
    graph_top_k: int = 20
    graph_floor_ratio: float = 0.0
    graph_signals: bool | None = None
    reranker: bool = True
    embed_batch_tokens: int = 12_000
    embed_batch_items: int = 32
    write_folders: tuple[str, ...] = ("",)
    poll_seconds: float = 300.0
    new_file_seconds: float = 600.0
    changed_seconds: float = 86_400.0
    extra: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> "Settings":
        """Defaults with what the environment gives; values that do not parse are left out."""
        given = os.environ if env is None else env
        out = cls()
        for f in fields(cls):
            raw = given.get("NOTARIUM_" + f.name.upper())
            if raw is None or f.name == "extra":
                continue
            try:
                own = getattr(out, f.name)
                if f.name == "write_folders":
                    setattr(out, f.name, tuple(x.strip() for x in raw.split(",")))
                elif f.name == "graph_signals" or isinstance(own, bool):
                    setattr(out, f.name, _SWITCH[raw.strip().lower()])
                else:
                    setattr(out, f.name, type(own)(raw))
            except (ValueError, KeyError):
                continue
        return out


def load_env(paths: list[str], override: bool = False) -> dict[str, str]:
    """key=value lines of several files; earlier files and the environment hold unless override."""
    out: dict[str, str] = {}
    for path in paths:
        if not Path(path).exists():
            continue
        for line in Path(path).read_text().splitlines():
            line = line.strip().removeprefix("export ")
            if line and not line.startswith("#") and "=" in line:
                key, value = (x.strip() for x in line.split("=", 1))
                if override or (key not in out and key not in os.environ):
                    out[key] = value.strip("\"'")
    return out


def read_config(path: str) -> dict:
    """The JSON configuration; an empty one if the file is missing."""
    try:
        return json.loads(Path(path).read_text())
    except FileNotFoundError:
        return {"collections": [], "contexts": []}


def write_config(config: dict, path: str) -> None:
    """Write the configuration by a rename."""
    staged = Path(path + ".next")
    staged.parent.mkdir(parents=True, exist_ok=True)
    staged.write_text(json.dumps(config, indent=2, sort_keys=True) + "\n")
    staged.replace(path)


def add_collection(config: dict, name: str, root: str, pattern: str = "**/*.md", excludes: list[str] | None = None) -> dict:
    """config with the collection added or replaced."""
    kept = [c for c in config.get("collections", []) if c["name"] != name]
    return {**config, "collections": [*kept, {"name": name, "root": root, "pattern": pattern, "excludes": excludes or []}]}


def add_context(config: dict, collection: str, prefix: str, text: str) -> dict:
    """config with the context added; the same one twice makes no difference."""
    row = {"collection": collection, "prefix": prefix.strip("/"), "text": text}
    kept = [c for c in config.get("contexts", []) if c != row]
    return {**config, "contexts": [*kept, row]}
