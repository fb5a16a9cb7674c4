"""The public operations: a registry with checked parameters and a uniform envelope."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from notarium.engine import Engine

KINDS = {"string": str, "number": (int, float), "boolean": bool, "object": dict, "array": list}
MODES = ("fast", "focused", "balanced", "deep", "hybrid")


@dataclass(frozen=True)
class Param:
    """One parameter: its kind, whether it must be given, its default and the values it may take."""

    kind: str
    required: bool = False
    default: Any = None
    among: tuple[str, ...] = ()


@dataclass(frozen=True)
class Operation:
    """A named call of the engine; scope is read, index or write."""

    name: str
    run: Callable[..., DataFrame]
    params: dict[str, Param] = field(default_factory=dict)
    scope: str = "read"


_VIEW = Param("string", default="default", among=("default", "minimal", "debug", "full", "verbose", "compact", "normal"))
_NODE = {"identifier": Param("string", True), "limit": Param("number", default=50)}
OPERATIONS = {
    op.name: op
    for op in (
        Operation("status", lambda e: e.status()),
        Operation("collection_list", lambda e: e.collections()),
        Operation(
            "chunk_stats",
            lambda e, sample_limit, collection_name=None: e.chunk_stats(collection_name),
            {"collection_name": Param("string"), "sample_limit": Param("number", default=12)},
        ),
        Operation("operation_list", lambda e: e.spark.createDataFrame([(o["name"], o["scope"], o["params"]) for o in list_operations()], "name string, scope string, params map<string,string>")),
        Operation("background_status", lambda e, collection_name=None: e.background(collection_name), {"collection_name": Param("string")}),
        Operation(
            "semantic_clusters",
            lambda e, seed_limit, related_limit, min_score, session_policy, session_penalty, session_max_per_seed, collection_name=None, seed_prefixes=None, candidate_prefixes=None, exclude_prefixes=None: e.semantic_clusters(
                collection_name, seed_prefixes, seed_limit=int(seed_limit), keep=int(related_limit), min_score=float(min_score), policy=session_policy, penalty=float(session_penalty),
                most_sessions=int(session_max_per_seed), candidates=candidate_prefixes or [], excluded=exclude_prefixes or [],
            ),
            {
                "collection_name": Param("string"), "seed_prefixes": Param("array"), "candidate_prefixes": Param("array"), "exclude_prefixes": Param("array"),
                "seed_limit": Param("number", default=25), "related_limit": Param("number", default=5), "min_score": Param("number", default=0.35),
                "session_policy": Param("string", default="exclude", among=("exclude", "penalize", "include")), "session_penalty": Param("number", default=0.65),
                "session_max_per_seed": Param("number", default=1),
            },
        ),
        Operation("fetch", lambda e, point_id: e.fetch(point_id), {"point_id": Param("string", True)}),
        Operation("write_status", lambda e, collection_name=None: e.write_status(collection_name), {"collection_name": Param("string")}),
        Operation(
            "capture",
            lambda e, text, kind, domain, title=None, collection_name=None: e.write("capture", collection_name, text=text, kind=kind, domain=domain, title=title),
            {
                "text": Param("string", True), "kind": Param("string", default="note", among=("idea", "note", "question", "finding", "report", "draft")),
                "domain": Param("string", default="general"), "title": Param("string"), "collection_name": Param("string"),
            },
            scope="write",
        ),
        Operation(
            "note_put",
            lambda e, rel_path, markdown, collection_name=None: e.write("note_put", collection_name, rel_path=rel_path, markdown=markdown),
            {"rel_path": Param("string", True), "markdown": Param("string", True), "collection_name": Param("string")},
            scope="write",
        ),
        Operation(
            "note_append",
            lambda e, rel_path, text, heading=None, collection_name=None: e.write("note_append", collection_name, rel_path=rel_path, text=text, heading=heading),
            {"rel_path": Param("string", True), "text": Param("string", True), "heading": Param("string"), "collection_name": Param("string")},
            scope="write",
        ),
        Operation(
            "note_propose",
            lambda e, title, body, collection_name=None: e.write("note_propose", collection_name, title=title, text=body),
            {"title": Param("string", True), "body": Param("string", True), "collection_name": Param("string")},
            scope="write",
        ),
        Operation("search", lambda e, query, limit, view: e.search(query, int(limit), "keyword", view), {"query": Param("string", True), "limit": Param("number", default=5), "view": _VIEW}),
        Operation(
            "query",
            lambda e, query, limit, mode, view: e.search(query, int(limit), mode, view),
            {"query": Param("string", True), "limit": Param("number", default=5), "mode": Param("string", default="hybrid", among=MODES), "view": _VIEW},
        ),
        Operation(
            "related_work",
            lambda e, idea, limit, mode: e.related(idea, int(limit), mode),
            {"idea": Param("string", True), "limit": Param("number", default=6), "mode": Param("string", default="focused", among=MODES)},
        ),
        Operation("get_doc", lambda e, identifier, full: e.document(identifier, full), {"identifier": Param("string", True), "full": Param("boolean", default=False)}),
        Operation("graph_neighbors", lambda e, identifier, limit: e.neighbours(identifier, int(limit)), _NODE),
        Operation("graph_backlinks", lambda e, identifier, limit: e.backlinks(identifier, int(limit)), _NODE),
        Operation(
            "graph_traverse",
            lambda e, identifier, depth, direction, limit, edge_type=None: e.traverse(identifier, int(depth), direction, edge_type, int(limit)),
            {
                "identifier": Param("string", True),
                "depth": Param("number", default=2),
                "direction": Param("string", default="out", among=("out", "in", "both")),
                "edge_type": Param("string"),
                "limit": Param("number", default=200),
            },
        ),
        Operation("graph_extract", lambda e: e.extract_links(), scope="index"),
        Operation("think", lambda e, question, limit: e.think(question, int(limit)), {"question": Param("string", True), "limit": Param("number", default=5)}),
    )
}


def list_operations() -> list[dict[str, Any]]:
    """Name, scope and parameters of every operation."""
    return [{"name": o.name, "scope": o.scope, "params": {k: p.kind + ("!" if p.required else "") for k, p in o.params.items()}} for o in OPERATIONS.values()]


def summarize_params(name: str, given: dict[str, Any]) -> dict[str, Any]:
    """What a call was given, without any value: declared names, the number of others, and the kinds of the values."""
    known = OPERATIONS[name].params if name in OPERATIONS else {}
    declared = sorted(k for k in given if k in known)
    return {"redacted": True, "declared_keys": declared, "unknown_key_count": len(given) - len(declared), "kinds": {k: type(given[k]).__name__ for k in declared}}


def check_params(operation: Operation, given: dict[str, Any]) -> dict[str, Any]:
    """The parameters with defaults filled in; ValueError names every fault."""
    faults = [f"unknown parameter {k}" for k in given if k not in operation.params]
    out: dict[str, Any] = {}
    for name, p in operation.params.items():
        value = given.get(name)
        if value is None:
            if p.required:
                faults.append(f"missing parameter {name}")
            elif p.default is not None:
                out[name] = p.default
            continue
        if not isinstance(value, KINDS[p.kind]) or (p.kind == "number" and isinstance(value, bool)):
            faults.append(f"{name} must be a {p.kind}")
        elif p.among and value not in p.among:
            faults.append(f"{name} must be one of {', '.join(p.among)}")
        else:
            out[name] = value
    if faults:
        raise ValueError("; ".join(faults))
    return out


def run(engine: Engine, name: str, given: dict[str, Any] | None = None) -> dict[str, Any]:
    """{ok: True, data: DataFrame} or {ok: False, error, hint}."""
    operation = OPERATIONS.get(name)
    if operation is None:
        return {"ok": False, "error": f"no such operation: {name}", "hint": ", ".join(OPERATIONS)}
    try:
        return {"ok": True, "data": operation.run(engine, **check_params(operation, given or {}))}
    except ValueError as fault:
        return {"ok": False, "error": str(fault), "hint": str(list(operation.params))}
