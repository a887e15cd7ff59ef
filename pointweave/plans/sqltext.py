"""Building blocks for the comparison SQL (DuckDB): WITH clauses that mirror the operators."""

from __future__ import annotations

from pointweave.sources.tables import SQL


def rnd(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0::DOUBLE)"


def cloud(name: str) -> str:
    return f"p AS ({SQL[name]})"


def knn(k: int, name: str = "k", queries: str = "p", points: str = "p", skip: bool = True) -> str:
    other = "AND a.point_id <> b.point_id" if skip else ""
    return (
        f"{name} AS (SELECT cloud_id, src, t.dst AS dst, sqrt(t.d2) AS dist, CAST(rank AS INTEGER) AS rank FROM (SELECT cloud_id, src, unnest(l) AS t, "
        f"generate_subscripts(l, 1) AS rank FROM (SELECT cloud_id, src, min({{'d2': d2, 'dst': dst}}, {k}) AS l FROM (SELECT a.cloud_id, "
        f"a.point_id AS src, b.point_id AS dst, (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)+(b.z-a.z)*(b.z-a.z) AS d2 FROM {queries} a JOIN {points} b "
        f"ON a.cloud_id = b.cloud_id {other}) GROUP BY cloud_id, src)))"
    )


def capped(factor: float, source: str = "k", name: str = "c") -> str:
    return (
        f"{name} AS (SELECT {source}.cloud_id, src, dst, dist FROM {source} JOIN (SELECT cloud_id, avg(dist) AS m FROM {source} "
        f"WHERE dist > 0 GROUP BY cloud_id) s ON s.cloud_id = {source}.cloud_id WHERE dist > 0 AND dist <= m * {factor})"
    )


def mutual(source: str = "c", name: str = "e") -> str:
    return (
        f"{name} AS (SELECT a.cloud_id, a.src, a.dst, a.dist FROM {source} a JOIN {source} b "
        f"ON a.cloud_id = b.cloud_id AND a.src = b.dst AND a.dst = b.src)"
    )


def graph(cloud_name: str, k: int, factor: float = 2.5) -> list[str]:
    return [cloud(cloud_name), knn(k), capped(factor), mutual()]


def top_mask(column: str, q: float, name: str = "mask") -> str:
    return (
        f"{name} AS (SELECT p.cloud_id, p.point_id FROM p JOIN (SELECT cloud_id, quantile_cont({column}, {q}) AS t FROM p "
        f"GROUP BY cloud_id) s ON s.cloud_id = p.cloud_id WHERE {column} >= t)"
    )


def hops(sources: str, limit: int | None, name: str = "h", edges: str = "e", group: str = "", blocked: str = "") -> str:
    """Breadth-first hops by a recursive union; ``group`` is an extra key column of the sources."""
    g = f", {group}" if group else ""
    hg = f", w.{group}" if group else ""
    guard = f"WHERE w.hop < {limit if limit is not None else 1000000}"
    stop = f" AND NOT EXISTS (SELECT 1 FROM {blocked} b WHERE b.cloud_id = w.cloud_id AND b.point_id = x.dst)" if blocked else ""
    once = (
        f" AND NOT EXISTS (SELECT 1 FROM recurring.w_{name} r WHERE r.cloud_id = w.cloud_id AND r.point_id = x.dst"
        + (f" AND r.{group} = w.{group}" if group else "")
        + ")"
    )
    return (
        f"w_{name}(cloud_id{g}, point_id, hop) USING KEY (cloud_id{g}, point_id) AS (SELECT cloud_id{g}, point_id, 0 FROM {sources} "
        f"UNION SELECT w.cloud_id{hg}, x.dst, min(w.hop + 1) FROM w_{name} w JOIN {edges} x ON x.cloud_id = w.cloud_id "
        f"AND x.src = w.point_id {guard}{stop}{once} GROUP BY w.cloud_id{hg}, x.dst), "
        f"{name} AS (SELECT cloud_id{g}, point_id, hop FROM w_{name})"
    )


def labels(nodes: str, edges: str = "e", name: str = "comp") -> str:
    """Connected components of the subgraph on ``nodes``: smallest reachable id."""
    return (
        f"r_{name}(cloud_id, point_id, root) AS (SELECT cloud_id, point_id, point_id FROM {nodes} UNION "
        f"SELECT r.cloud_id, x.dst, r.root FROM r_{name} r JOIN {edges} x ON x.cloud_id = r.cloud_id AND x.src = r.point_id "
        f"JOIN {nodes} n ON n.cloud_id = x.cloud_id AND n.point_id = x.dst WHERE x.dst > r.root), "
        f"{name} AS (SELECT cloud_id, point_id, min(root) AS component FROM r_{name} GROUP BY cloud_id, point_id)"
    )


def query(ctes: list[str], body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(ctes) + " " + body
