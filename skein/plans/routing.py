"""The advisory planner: what a request reads, with which hints, and at what estimated cost."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from skein.functions.text import GRAPH_PATTERNS, SEMANTIC_PATTERNS

CACHE_S, TIMEOUT_S, MIN_CERTAINTY = 300, 10, 0.7
CACHED_OPERATIONS = ("blast_radius", "service_topology", "call_chain")


@dataclass(frozen=True)
class Route:
    """kind: semantic, graph, file or hybrid; reads: the tables that answer it; tool: the method of the API."""

    kind: str
    reads: tuple[str, ...]
    tool: str
    arguments: dict = field(default_factory=dict)
    hints: dict = field(default_factory=dict)
    cost_ms: int = 0
    cached: bool = False


def classify(query: str, endpoint: str | None = None, include_graph: bool = False) -> str:
    for part, kind in (("dependency", "graph"), ("blast-radius", "graph"), ("file", "file"), ("search", "hybrid" if include_graph else "semantic")):
        if endpoint and part in endpoint:
            return kind
    hits = [sum(bool(re.search(p, query.lower())) for p in patterns) for patterns in (GRAPH_PATTERNS, SEMANTIC_PATTERNS)]
    return "graph" if hits[0] > hits[1] else "semantic"


def search_route(query: str, k: int = 10, hybrid: bool = False, **filters) -> Route:
    hints = {"cache_ttl": CACHE_S, "min_certainty": MIN_CERTAINTY}
    words = len(query.split())
    hints |= {"k_multiplier": 1.5} if words > 10 else {}
    hints |= {"enable_pagination": True} if k > 20 else {}
    reads = ("units", "files", "imports", "modified", "commits") if hybrid else ("units",)
    return Route("hybrid" if hybrid else "semantic", reads, "search", {"query": query, "k": k, **filters}, hints, 500 if hybrid else 100 + 10 * k, words >= 5 and not hybrid)


def graph_route(operation: str, **arguments) -> Route:
    hops = arguments.get("max_hops")
    hints = {"cache_ttl": CACHE_S, "timeout": TIMEOUT_S}
    if operation == "blast_radius" and (hops or 5) > 5:
        hints["timeout"] = 2 * TIMEOUT_S
    if operation == "dependencies" and arguments.get("direction", "both") == "both":
        hints["parallel_execution"] = True
    cost = 200 * 2 ** (hops or 3) if operation == "blast_radius" else 150 + 50 * (hops or 3)
    tool = {"dependencies": "dependency_graph"}.get(operation, operation)
    return Route("graph", ("files", "imports", "belongs_to"), tool, arguments, hints, cost, operation in CACHED_OPERATIONS)


def file_route(path) -> Route:
    return Route("file", ("contents",), "file", {"path": path}, {"cache_ttl": 3600}, 50, True)
