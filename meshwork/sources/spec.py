"""Query specifications and their text form."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class MetaPath:
    """Vertex types of a path and the edge types between them; -1 stands for any edge type."""

    vertices: tuple[int, ...]
    edges: tuple[int, ...]

    def __post_init__(self):
        if len(self.vertices) != len(self.edges) + 1 or not self.edges:
            raise ValueError("a meta-path has one vertex type more than edge types")

    @classmethod
    def parse(cls, text: str) -> MetaPath:
        """From ``v e v ... v``."""
        n = [int(x) for x in text.split()]
        return cls(tuple(n[0::2]), tuple(n[1::2]))


@dataclass(frozen=True)
class QuerySpec:
    """mu, hops, query type, query vertices, thresholds by type or one for all, meta-paths with thresholds.

    ``ids`` empty means a stride sample of ``n_queries``; ``from_file`` that a list
    of selected ids is to be read instead.
    """

    mu: int
    hops: int
    query_type: int
    n_queries: int
    ids: tuple[int, ...] = ()
    from_file: bool = False
    unit_eps: float | None = None
    eps: dict[int, float] = field(default_factory=dict)
    metapaths: tuple[tuple[MetaPath, float], ...] = ()

    def thresholds(self, distance: dict[int, int]) -> dict[int, float]:
        """Threshold of each compared type; ``distance`` is the schema distance from the query type."""
        if self.unit_eps is not None:
            found = {t: self.unit_eps for t, d in distance.items() if 1 <= d <= self.hops}
        else:
            found = dict(self.eps)
        found = {t: e for t, e in sorted(found.items()) if e > 0 and t != self.query_type}
        if not found:
            raise ValueError("no type is compared")
        return found


def parse_spec(text: str, n_types: int) -> QuerySpec:
    """Parse a query file: mu; hops; type and count; ids, -1 or -2; thresholds (rows, -1, -2, -3 or -4) and meta-paths."""
    lines = [x.split() for x in text.splitlines() if x.strip()]
    if len(lines) < 5:
        raise ValueError("a query file has five lines at least")
    mu, hops = int(lines[0][0]), int(lines[1][0])
    kind, count = int(lines[2][0]), int(lines[2][1])
    if mu <= 0 or not 0 <= hops < n_types or not 0 <= kind < n_types:
        raise ValueError("mu, hops or query type out of range")
    ids = [int(x) for x in lines[3]]
    from_file, ids = ids[:1] == [-2], () if ids[:1] in ([-1], [-2]) else tuple(ids)

    def checked(t: int, e: float) -> tuple[int, float]:
        if not 0 <= t < n_types or not 0 <= e <= 1:
            raise ValueError(f"threshold {t} {e} out of range")
        return t, e

    rest, unit, eps, paths = lines[4:], None, {}, ()
    head = int(rest[0][0])
    if head in (-1, -2, -3):
        unit = float(rest[0][1])
        if not 0 <= unit <= 1 or head != -1 and not unit > 0:
            raise ValueError("the unit threshold is out of range")
        tail = rest[1:] if head != -1 else []
    elif head == -4:
        n = int(rest[0][1])
        if n <= 0:
            raise ValueError("-4 needs a number of rows")
        eps = dict(checked(int(t), float(e)) for t, e in rest[1 : n + 1])
        tail = rest[n + 1 :]
    else:
        eps, tail = dict(checked(int(t), float(e)) for t, e in rest), []
    if tail:
        n = int(tail[0][0])
        paths = tuple((MetaPath.parse(" ".join(tail[1 + 2 * i])), float(tail[2 + 2 * i][0])) for i in range(n))
        if any(e == 0 for _, e in paths):
            raise ValueError("a meta-path's threshold is not 0")
    return QuerySpec(mu, hops, kind, count, ids, from_file, unit, eps, paths)
