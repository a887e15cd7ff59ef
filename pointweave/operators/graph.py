"""Relational graph operators: components, hops, morphology, growth.

A point set is a table keyed by (cloud_id[, group], point_id); a graph is
edges(cloud_id, src, dst, ...) with both directions stored. Each round is one
join of the frontier with the edges; rounds are cut into written tables, whose
size lets Spark broadcast a small frontier and shuffle a large one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.functions.order_stats import percentiles
from pointweave.session import cut, discard

POINT = ["cloud_id", "point_id"]


def _step(frontier: DataFrame, edges: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Neighbours of the frontier as ``point_id``; ``keep`` columns ride along, the origin is ``via``."""
    hop = edges.select("cloud_id", F.col("src").alias("point_id"), "dst")
    return frontier.join(hop, POINT).select(
        "cloud_id", F.col("point_id").alias("via"), F.col("dst").alias("point_id"), *keep
    )


def _print(*columns: str) -> dict:
    """A fingerprint of a table, to be collected while it is written."""
    return {"rows": F.count(F.lit(1)), "mark": F.bit_xor(F.xxhash64(*columns))}


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes``."""
    ends = nodes.select(*POINT)
    left = edges.join(ends.withColumnRenamed("point_id", "src"), ["cloud_id", "src"], "left_semi")
    return left.join(ends.withColumnRenamed("point_id", "dst"), ["cloud_id", "dst"], "left_semi")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(cloud_id, point_id, component): component is the smallest id in it.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): a
    logarithmic number of rounds in practice, each made of two partial
    aggregations and two joins, so a hub never becomes one task's list.
    """
    pairs = cut(
        edges.where(F.col("src") != F.col("dst"))
        .select("cloud_id", F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
        .distinct(),
        "pairs",
    )
    state = None
    while True:
        both = pairs.select("cloud_id", F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            pairs.select("cloud_id", F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy("cloud_id", "u").agg(F.min("v").alias("m"))
        low = low.select("cloud_id", "u", F.least("u", "m").alias("m"))
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(low, ["cloud_id", "u"])
            .select("cloud_id", F.col("v").alias("a"), F.col("m").alias("b"))
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
        least = large.groupBy("cloud_id", "a").agg(F.min("b").alias("m"))
        moved = large.join(least, ["cloud_id", "a"])
        small = moved.select("cloud_id", "a", F.col("m").alias("b")).unionByName(
            moved.where(F.col("b") != F.col("m")).select("cloud_id", F.col("b").alias("a"), F.col("m").alias("b"))
        )
        last, pairs = pairs, cut(small.distinct(), "pairs", **_print("cloud_id", "a", "b"))
        discard(last)
        if pairs.seen == state:
            break
        state = pairs.seen
    roots = pairs.select("cloud_id", F.col("a").alias("point_id"), F.col("b").alias("root"))
    return nodes.select(*POINT).join(roots, POINT, "left").select(
        *POINT, F.coalesce("root", "point_id").alias("component")
    )


def mask_components(mask: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of the subgraph on ``mask``."""
    mask = mask.select(*POINT)
    return components(mask, induced(edges, mask))


def component_sizes(labels: DataFrame, label: str = "component") -> DataFrame:
    return labels.groupBy("cloud_id", label).agg(F.count(F.lit(1)).alias("size"))


def hop_distance(
    sources: DataFrame,
    edges: DataFrame,
    max_hops: int | None = None,
    group: Sequence[str] = (),
    allowed: DataFrame | None = None,
    blocked: DataFrame | None = None,
    owners: DataFrame | None = None,
    directed: bool = False,
) -> DataFrame:
    """Multi-source breadth-first hops: sources have hop 0; unreached points are absent.

    With ``group`` every group spreads on its own. ``allowed`` and ``blocked``
    limit what may be entered; they carry cloud_id, point_id and any group columns.
    ``owners`` (cloud_id, point_id, own_low, own_high) names points that only the
    group of that name (the single one in ``group``) may enter. ``directed``
    says that edges may lack their other direction.
    """
    group = list(group)
    key = ["cloud_id", *group, "point_id"]
    front = cut(sources.select(*key).distinct().withColumn("hop", F.lit(0)), "hop")
    if allowed is not None and set(allowed.columns) == set(POINT) and max_hops != 0:
        # the same for every group and round, so it is asked once per edge
        edges = cut(edges.select("cloud_id", "src", "dst").join(allowed.withColumnRenamed("point_id", "dst"), ["cloud_id", "dst"], "left_semi"), "allowed")
        allowed = None
    rounds, hop = [front], 0
    while max_hops is None or hop < max_hops:
        hop += 1
        nxt = _step(front, edges, group).drop("via").select(*key).distinct()
        if allowed is not None:
            nxt = nxt.join(allowed, [c for c in key if c in allowed.columns], "left_semi")
        if blocked is not None:
            nxt = nxt.join(blocked, [c for c in key if c in blocked.columns], "left_anti")
        if owners is not None:
            mine = (F.col("own_low") == F.col(group[0])) & (F.col("own_high") == F.col(group[0]))
            nxt = nxt.join(owners, POINT, "left").where(F.col("own_low").isNull() | mine).select(*key)
        # on an undirected graph only the last two shells can be met again, whatever may not be entered: what a point
        # is entered from may be entered itself or is a source, so the point's other neighbours are at most one hop away
        if directed:  # all shells count: those points of them are found that are met now, so what is broadcast is a shell
            nxt = reached = cut(nxt, "reached", rows=F.count(F.lit(1)))
            met = reduce(DataFrame.unionByName, rounds).select(*key).join(reached, key, "left_semi")
            seen = cut(met, "met", rows=F.count(F.lit(1)))
        else:
            seen = reduce(DataFrame.unionByName, rounds[-2:]).select(*key)
        nxt = nxt.join(seen, key, "left_anti")
        front = cut(nxt.withColumn("hop", F.lit(hop)), "hop", rows=F.count(F.lit(1)))
        if directed:
            discard(reached, seen)
        if not front.seen["rows"]:
            break
        rounds.append(front)
    return reduce(DataFrame.unionByName, rounds)


def dilate(mask: DataFrame, edges: DataFrame, hops: int, group: Sequence[str] = (), **limits) -> DataFrame:
    return hop_distance(mask, edges, hops, group, **limits).drop("hop")


def erode(mask: DataFrame, edges: DataFrame, hops: int, group: Sequence[str] = (), isolated: str = "keep") -> DataFrame:
    """Peel ``hops`` layers. ``isolated`` says what happens to points without any neighbour: keep or drop.

    A point survives iff the nearest point outside is more than ``hops`` away,
    so peeling is a breadth-first walk inward from the rim of the mask.
    """
    group = list(group)
    key = ["cloud_id", *group, "point_id"]
    mask = mask.select(*key)
    if hops <= 0:
        return mask
    mask = cut(mask, "mask")
    out = _step(mask, edges, group).join(mask, key, "left_anti")
    rim = out.select("cloud_id", *group, F.col("via").alias("point_id")).distinct()
    peeled = hop_distance(rim, edges, hops - 1, group, allowed=mask).drop("hop")
    left = mask.join(peeled, key, "left_anti")
    if isolated == "drop":
        linked = edges.select("cloud_id", F.col("src").alias("point_id")).distinct()
        left = left.join(linked, POINT, "left_semi")
    return left


def close(
    mask: DataFrame,
    edges: DataFrame,
    dilation: int,
    erosion: int,
    group: Sequence[str] = (),
    keep_original: bool = False,
    isolated: str = "keep",
) -> DataFrame:
    """Dilation, then erosion; each group on its own."""
    key = ["cloud_id", *group, "point_id"]
    out = erode(dilate(mask, edges, dilation, group), edges, erosion, group, isolated)
    if keep_original:
        out = out.unionByName(mask.select(*key)).distinct()
    return out


def rings(components_: DataFrame, edges: DataFrame, hops: int = 3, label: str = "component") -> DataFrame:
    """(cloud_id, label, point_id, hop 1..hops) around every component.

    A component's ring may not enter a point of any component.
    """
    members = cut(components_.select("cloud_id", label, "point_id"), "members")
    taken = members.select(*POINT)
    return hop_distance(members, edges, hops, [label], blocked=taken).where(F.col("hop") > 0)


def adjacent_components(labels: DataFrame, edges: DataFrame, label: str = "component") -> DataFrame:
    """Distinct pairs (a < b) of components that an edge connects."""
    # both directions are stored, so one of them is enough
    edges = edges.where(F.col("src") <= F.col("dst"))
    left = labels.select("cloud_id", F.col("point_id").alias("src"), F.col(label).alias("a"))
    right = labels.select("cloud_id", F.col("point_id").alias("dst"), F.col(label).alias("b"))
    pairs = edges.select("cloud_id", "src", "dst").join(left, ["cloud_id", "src"]).join(right, ["cloud_id", "dst"])
    return pairs.where(F.col("a") != F.col("b")).select("cloud_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def gap_groups(labels: DataFrame, edges: DataFrame, max_gap: int = 2) -> DataFrame:
    """(cloud_id, component, grp): components at most ``max_gap`` edges apart share a group.

    The walk may cross any point; bridge points do not join the group.
    """
    reach = hop_distance(labels, edges, max_gap, ["component"])
    other = labels.select(*POINT, F.col("component").alias("other"))
    links = reach.join(other, POINT).where(F.col("component") != F.col("other"))
    links = links.select("cloud_id", F.col("component").alias("src"), F.col("other").alias("dst")).distinct()
    nodes = labels.select("cloud_id", F.col("component").alias("point_id")).distinct()
    return components(nodes, links).select(
        "cloud_id", F.col("point_id").alias("component"), F.col("component").alias("grp")
    )


def descending_growth(
    roots: DataFrame, response: DataFrame, edges: DataFrame, threshold: DataFrame | float, eps: float = 1e-12,
    blocked: DataFrame | None = None,
) -> DataFrame:
    """Grow roots (cloud_id, point_id, budget) downhill along ``response`` (cloud_id, point_id, response).

    A step is legal when the next response is not above the current one and not
    below the threshold. Returns (cloud_id, point_id, remaining, depth, parent):
    the best budget left, the first round that reached the point, and the
    smallest predecessor that gave that best budget (null for an untouched root).
    """
    legal = edges.select("cloud_id", "src", "dst")
    a = response.select("cloud_id", F.col("point_id").alias("src"), F.col("response").alias("r0"))
    b = response.select("cloud_id", F.col("point_id").alias("dst"), F.col("response").alias("r1"))
    legal = legal.join(a, ["cloud_id", "src"]).join(b, ["cloud_id", "dst"])
    if isinstance(threshold, DataFrame):
        legal = legal.join(threshold, "cloud_id")
    else:
        legal = legal.withColumn("threshold", F.lit(float(threshold)))
    legal = legal.where((F.col("r1") <= F.col("r0") + eps) & (F.col("r1") >= F.col("threshold") - eps))
    if blocked is not None:
        legal = legal.join(blocked.select("cloud_id", F.col("point_id").alias("dst")), ["cloud_id", "dst"], "left_anti")
    legal = cut(legal.select("cloud_id", "src", "dst"), "legal")
    best = cut(
        roots.groupBy(*POINT).agg(F.max("budget").cast("int").alias("remaining"))
        .select(*POINT, "remaining", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent")),
        "grown",
    )
    front, depth = best, 0
    while True:
        depth += 1
        live = front.where(F.col("remaining") > 0)
        reach = _step(live, legal, ["remaining"]).groupBy(*POINT).agg(
            F.max(F.struct((F.col("remaining") - 1).alias("left"), (-F.col("via")).alias("neg"))).alias("top")
        )
        reach = reach.select(*POINT, F.col("top.left").alias("left"), (-F.col("top.neg")).alias("from_id"))
        merged = best.join(reach, POINT, "full")
        better = F.col("left").isNotNull() & (F.col("left") > F.coalesce("remaining", F.lit(-1)))
        merged = cut(
            merged.select(
                *POINT,
                F.when(better, F.col("left")).otherwise(F.col("remaining")).alias("remaining"),
                F.coalesce("depth", F.lit(depth)).alias("depth"),
                F.when(better, F.col("from_id")).otherwise(F.col("parent")).alias("parent"),
                F.coalesce(better, F.lit(False)).alias("better"),
            ),
            "grown",
            live=F.count_if(F.col("better") & (F.col("remaining") > 0)),
        )
        best, front = merged.drop("better"), merged.where("better").drop("better")
        if not merged.seen["live"]:
            return best


def energy_growth(
    seeds: DataFrame, energy: DataFrame, edges: DataFrame, floor: DataFrame, max_hops: int = 9, eps: float = 1e-6,
    descend: str = "strict", label: str = "component",
) -> DataFrame:
    """Grow every seed component downhill in ``energy`` (cloud_id, point_id, energy).

    A point is taken from its highest-energy grown neighbour (ties: fewer hops,
    smaller id) when its own energy is at least the component's ``floor`` and
    lower than that neighbour's by more than ``eps``. Because energy falls along
    every step, that rule equals a walk in order of falling energy; it is solved
    as a fixed point over all components at once. ``descend='any'`` drops the
    downhill rule (breadth-first growth above the floor).
    """
    key = ["cloud_id", label, "point_id"]
    seeds = cut(seeds.select(*key), "seeds")
    if descend == "any":
        ok = energy.join(floor, "cloud_id").where(F.col("energy") >= F.col("floor")).select(*key)
        grown = hop_distance(seeds, edges, max_hops, [label], allowed=ok)
        return grown.select(*key, "hop")
    a = energy.select("cloud_id", F.col("point_id").alias("src"), F.col("energy").alias("e0"))
    b = energy.select("cloud_id", F.col("point_id").alias("dst"), F.col("energy").alias("e1"))
    hops = edges.select("cloud_id", "src", "dst").join(a, ["cloud_id", "src"]).join(b, ["cloud_id", "dst"])
    hops = cut(hops.where(F.col("e1") < F.col("e0") - eps), "downhill")
    grown = cut(seeds.withColumn("hop", F.lit(0)), "grown")
    state = None
    while True:
        moves = grown.where(F.col("hop") < max_hops).join(hops.withColumnRenamed("src", "point_id"), POINT)
        moves = moves.join(floor, ["cloud_id", label]).where(F.col("e1") >= F.col("floor"))
        pick = F.max(F.struct("e0", (-F.col("hop")).alias("neg_hop"), (-F.col("point_id")).alias("neg_id")))
        new = moves.groupBy("cloud_id", label, F.col("dst").alias("point_id")).agg(pick.alias("by"))
        new = new.select(*key, (F.lit(1) - F.col("by.neg_hop")).alias("hop")).join(seeds, key, "left_anti")
        last, grown = grown, cut(seeds.withColumn("hop", F.lit(0)).unionByName(new), "grown", **_print(*key, "hop"))
        discard(last)
        if grown.seen == state:
            return grown
        state = grown.seen


def capacity_within(seeds: DataFrame, energy: DataFrame, edges: DataFrame, max_hops: int, label: str = "component") -> DataFrame:
    """(cloud_id, label, point_id, capacity): the largest floor at which the seeds of ``label`` still reach the point.

    That is the best minimum energy over all walks of at most ``max_hops`` hops,
    ends included (infinite at a seed). Growth above any floor is then a filter
    ``capacity >= floor``. Round h sends on what round h - 1 improved; rounds are
    only appended. Points without a finite energy are not entered.
    """
    key = ["cloud_id", label, "point_id"]
    into = energy.where(F.abs("energy") < float("inf")).select("cloud_id", F.col("point_id").alias("dst"), F.col("energy").alias("e1"))
    arc = edges.select("cloud_id", F.col("src").alias("point_id"), "dst").join(into, ["cloud_id", "dst"])
    front = cut(seeds.select(*key).distinct().withColumn("capacity", F.lit(float("inf"))), "capacity")
    rounds = [front]
    for _ in range(max_hops):
        offers = front.join(arc, POINT).select("cloud_id", label, F.col("dst").alias("point_id"), F.least("capacity", "e1").alias("offer"))
        known = reduce(DataFrame.unionByName, rounds)
        met = offers.unionByName(known, allowMissingColumns=True).groupBy(*key).agg(F.max("offer").alias("offer"), F.max("capacity").alias("known"))
        better = met.where(F.col("offer").isNotNull() & (F.col("known").isNull() | (F.col("offer") > F.col("known"))))
        front = cut(better.select(*key, F.col("offer").alias("capacity")), "capacity", rows=F.count(F.lit(1)))
        if not front.seen["rows"]:
            break
        rounds.append(front)
    best = cut(reduce(DataFrame.unionByName, rounds).groupBy(*key).agg(F.max("capacity").alias("capacity")), "capacity")
    discard(*rounds)
    return best


def adaptive_growth(
    seeds: DataFrame, energy: DataFrame, edges: DataFrame, alphas: Sequence[float], max_size: DataFrame | int, support_min: float,
    max_hops: int = 9, seed_fraction: float = 0.9, background_fraction: float = 0.5, label: str = "component",
) -> DataFrame:
    """Grow every seed component above the first of several floors that keeps it within ``max_size`` points.

    The floor of an alpha lies that share of the way from the level around the
    component to the seeds' own level (a quantile each; the level around is that
    of all points within ``max_hops``, or of the cloud where there are none), at
    least ``support_min`` and at most 0.95 of the seeds' level. Where every alpha
    grows too far the smallest result stays, marked ``oversized`` (ties: the
    earlier alpha). All alphas are sized by one table of capacities, so none is
    tried by itself. ``max_size`` is a number or (cloud_id, max_size).

    Gives (cloud_id, label, point_id, alpha, floor, size, oversized). Without
    alphas the seeds come back with a null alpha. Components whose seeds have no
    energy have no floor and stay as their seeds, again with a null alpha.
    """
    key = ["cloud_id", label]
    energy = energy.select(*POINT, F.col("energy").cast("double").alias("energy"))
    sound = energy.where(F.abs("energy") < float("inf"))
    reach = capacity_within(seeds, energy, edges, max_hops, label)
    if not alphas:
        only = reach.where(F.col("capacity") == float("inf"))
        none = [F.lit(None).cast("double").alias(n) for n in ("alpha", "floor")]
        count = only.groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
        return only.join(count, key).select(*key, "point_id", *none, "size", F.lit(False).alias("oversized"))
    own = percentiles(seeds.select(*key, "point_id").distinct().join(sound, POINT), key, "energy", [seed_fraction], ["seed_level"])
    around = percentiles(reach.where(F.col("capacity") < float("inf")).join(sound, POINT), key, "energy", [background_fraction], ["near_level"])
    whole = percentiles(sound, ["cloud_id"], "energy", [background_fraction], ["cloud_level"])
    levels = own.join(around, key, "left").join(whole, "cloud_id")
    level, seed, least = F.coalesce("near_level", "cloud_level"), F.col("seed_level"), F.lit(float(support_min))
    floors = [F.least(F.greatest(level + F.lit(float(a)) * (seed - level), least), F.greatest(seed * 0.95, least)).alias(f"floor_{i}") for i, a in enumerate(alphas)]
    levels = cut(levels.select(*key, *floors), "floors")
    sizes = reach.join(levels, key).groupBy(*key).agg(
        *[F.count_if(F.col("capacity") >= F.col(f"floor_{i}")).alias(f"size_{i}") for i in range(len(alphas))]
    )
    limit = sizes.join(max_size.select("cloud_id", "max_size"), "cloud_id") if isinstance(max_size, DataFrame) else sizes.withColumn("max_size", F.lit(max_size))
    return _first_that_fits(reach, levels, limit, list(alphas), key)


def _first_that_fits(reach: DataFrame, levels: DataFrame, sizes: DataFrame, alphas: list[float], key: list[str]) -> DataFrame:
    """The points of every component at its chosen floor, with the report of that choice."""
    report = [
        F.struct(F.col(f"size_{i}").alias("size"), F.lit(i).alias("turn"), F.lit(float(a)).alias("alpha"), F.col(f"floor_{i}").alias("floor"))
        for i, a in enumerate(alphas)
    ]
    tried = sizes.join(levels, key).withColumn("tried", F.array(*report))
    fits = F.get(F.filter("tried", lambda r: r.size <= F.col("max_size")), F.lit(0))
    chosen = tried.withColumn("by", F.coalesce(fits, F.array_min("tried"))).select(*key, "by.*", (F.col("by.size") > F.col("max_size")).alias("oversized"))
    seeds = F.count_if(F.col("capacity") == float("inf"))
    count = reach.groupBy(*key).agg(seeds.alias("seed_count"))
    grown = reach.join(count.join(chosen, key, "left"), key)
    grown = grown.where((F.col("capacity") == float("inf")) | (F.col("capacity") >= F.col("floor")))
    return grown.select(*key, "point_id", "alpha", "floor", F.coalesce("size", "seed_count").alias("size"), F.coalesce("oversized", F.lit(False)).alias("oversized"))


def widest_paths(sources: DataFrame, response: DataFrame, edges: DataFrame) -> DataFrame:
    """(cloud_id, point_id, capacity, path_hops) from ``sources`` over ``response`` in [0, 1].

    Capacity is the best minimum response met on the way (1 at a source);
    path_hops is the shortest way among those of that capacity.
    """
    arc = edges.select("cloud_id", F.col("src").alias("point_id"), "dst").join(
        response.select("cloud_id", F.col("point_id").alias("dst"), F.col("response").alias("r1")), ["cloud_id", "dst"]
    )
    arc = cut(arc, "arc")
    best = cut(sources.select(*POINT).distinct().withColumn("capacity", F.lit(1.0)), "capacity")
    front = best
    while True:
        reach = front.join(arc, POINT).groupBy("cloud_id", F.col("dst").alias("point_id")).agg(
            F.max(F.least("capacity", "r1")).alias("offer")
        )
        better = F.col("offer").isNotNull() & (F.col("offer") > F.coalesce("capacity", F.lit(-1.0)))
        merged = cut(
            best.join(reach, POINT, "full").select(
                *POINT,
                F.when(better, F.col("offer")).otherwise(F.col("capacity")).alias("capacity"),
                F.coalesce(better, F.lit(False)).alias("better"),
            ),
            "capacity",
            changed=F.count_if("better"),
        )
        best = merged.drop("better")
        if not merged.seen["changed"]:
            break
        # a table of its own, as its size decides how the next round is joined
        front = cut(merged.where("better").drop("better"), "front", rows=F.count(F.lit(1)))
    into = best.select("cloud_id", F.col("point_id").alias("dst"), F.col("capacity").alias("c1"))
    tight = arc.join(best, POINT).join(into, ["cloud_id", "dst"]).where(F.least("capacity", "r1") == F.col("c1"))
    tight = cut(tight.select("cloud_id", F.col("point_id").alias("src"), "dst"), "tight")
    start = sources.select(*POINT).distinct()
    # the tight arcs are directed, so every shell must be checked
    steps = hop_distance(start, tight, None, directed=True)
    return best.join(steps, POINT, "left").select(*POINT, "capacity", F.col("hop").alias("path_hops"))


def smooth(points: DataFrame, values: Sequence[str], edges: DataFrame, iterations: int = 2) -> DataFrame:
    """Mean over a point and its neighbours, repeated. ``points`` keeps only ids and values."""
    values = list(values)
    now = points.select(*POINT, *values)
    for _ in range(iterations):
        near = edges.select("cloud_id", F.col("src").alias("point_id"), F.col("dst")).join(
            now.withColumnRenamed("point_id", "dst"), ["cloud_id", "dst"]
        )
        near = near.select(*POINT, *values).unionByName(now)
        now = cut(near.groupBy(*POINT).agg(*[F.avg(v).alias(v) for v in values]), "smooth")
    return now


def label_aware_merge(
    grown: DataFrame, energy: DataFrame, edges: DataFrame, percentile: float = 0.8, min_ratio: float = 0.7
) -> tuple[DataFrame, DataFrame]:
    """Merge grown components (cloud_id, component, point_id) by energy labels.

    The label of a component is a percentile of the energy over it, and
    components are ranked by it. An arrow from a higher to an adjacent lower
    component is accepted when the lower label reaches ``min_ratio`` of the
    largest label upstream. Accepted arrows form groups; a point claimed by
    several groups goes to the component whose label is nearest to its energy.

    Returns (members: cloud_id, y_id, point_id) and (lineage: cloud_id,
    component, label, rank, y_id), where y_id is the best rank in the group.
    Only component tables are ordered per cloud.
    """
    grown = cut(grown.select("cloud_id", "component", "point_id"), "claims")
    labels = percentiles(grown.join(energy, POINT), ["cloud_id", "component"], "energy", [percentile], ["label"])
    by_rank = Window.partitionBy("cloud_id").orderBy(F.desc("label"), "component")
    labels = cut(labels.withColumn("rank", F.row_number().over(by_rank).cast("long")), "labels")
    ranked = cut(grown.join(labels.select("cloud_id", "component", "rank"), ["cloud_id", "component"]), "ranked")
    near = _step(ranked, edges, ["rank"]).select("cloud_id", "point_id", F.col("rank").alias("a"))
    pairs = near.join(ranked.select(*POINT, F.col("rank").alias("b")), POINT).where(F.col("a") != F.col("b"))
    pairs = cut(pairs.select("cloud_id", F.least("a", "b").alias("hi"), F.greatest("a", "b").alias("lo")).distinct(), "adj")
    rank_label = labels.select("cloud_id", "rank", "label")
    up = cut(labels.select("cloud_id", "rank", F.col("rank").alias("up"), F.col("label").alias("up_label")), "up")
    low = rank_label.select("cloud_id", F.col("rank").alias("lo"), F.col("label").alias("lo_label"))
    state = None
    while True:
        arrows = pairs.join(up.withColumnsRenamed({"rank": "hi"}), ["cloud_id", "hi"]).join(low, ["cloud_id", "lo"])
        arrows = arrows.where(F.col("lo_label") >= F.col("up_label") * min_ratio)
        best = arrows.groupBy("cloud_id", F.col("lo").alias("rank")).agg(F.min("up").alias("via"))
        nxt = rank_label.join(best, ["cloud_id", "rank"], "left")
        nxt = nxt.select("cloud_id", "rank", F.least("rank", "via").alias("up"))
        top = rank_label.select("cloud_id", F.col("rank").alias("up"), F.col("label").alias("up_label"))
        up = cut(nxt.join(top, ["cloud_id", "up"]).select("cloud_id", "rank", "up", "up_label"), "up", **_print("cloud_id", "rank", "up"))
        if up.seen == state:
            break
        state = up.seen
    arrows = pairs.join(up.withColumnsRenamed({"rank": "hi"}), ["cloud_id", "hi"]).join(low, ["cloud_id", "lo"])
    arrows = arrows.where(F.col("lo_label") >= F.col("up_label") * min_ratio)
    links = arrows.select("cloud_id", F.col("hi").alias("src"), F.col("lo").alias("dst"))
    groups = components(labels.select("cloud_id", F.col("rank").alias("point_id")), links)
    groups = groups.select("cloud_id", F.col("point_id").alias("rank"), F.col("component").alias("y_id"))
    lineage = cut(labels.join(groups, ["cloud_id", "rank"]), "lineage")
    claims = grown.join(lineage, ["cloud_id", "component"]).join(energy, POINT)
    gap = F.struct(F.abs(F.col("label") - F.col("energy")).alias("gap"), "rank", "y_id")
    owned = claims.groupBy(*POINT).agg(F.min(gap)["y_id"].alias("y_id"))
    return owned.select("cloud_id", "y_id", "point_id"), lineage


def summary(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Per cloud: points, undirected edges, degree range, isolated points, components, largest component."""
    from pointweave.operators.neighbors import degrees

    d = degrees(points, edges).groupBy("cloud_id").agg(
        F.count(F.lit(1)).alias("points"), (F.sum("degree") / 2).cast("long").alias("edges"),
        F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"),
        F.count_if(F.col("degree") == 0).alias("isolated"),
    )
    sizes = component_sizes(components(points, edges))
    c = sizes.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("components"), F.max("size").alias("largest"))
    return d.join(c, "cloud_id")


def hysteresis(strong: DataFrame, weak: DataFrame, edges: DataFrame) -> DataFrame:
    """Points of ``weak`` connected to a strong point through weak points (strong points are weak too)."""
    weak = cut(weak.select(*POINT).unionByName(strong.select(*POINT)).distinct(), "weak")
    return hop_distance(strong, edges, None, allowed=weak).drop("hop")


def fill_holes(
    members: DataFrame, edges: DataFrame, roi_hops: int = 4, max_ratio: float = 3.0, label: str = "component"
) -> DataFrame:
    """(cloud_id, label, point_id): components with the holes that they enclose.

    A component's surroundings reach ``roi_hops``. What lies in them and is not
    of the component is outside if it has a neighbour beyond the surroundings,
    or no neighbour, or is connected with such a point without crossing the
    component; the rest are holes. A component that would grow to more than
    ``max_ratio`` times its size stays as it is.
    """
    key = ["cloud_id", label, "point_id"]
    members = cut(members.select(*key), "members")
    roi = cut(hop_distance(members, edges, roi_hops, [label]), "roi")
    passable = cut(roi.where("hop > 0").select(*key), "passable")
    beyond = _step(passable, edges, [label]).join(roi.select(*key), key, "left_anti").select("cloud_id", label, F.col("via").alias("point_id"))
    alone = passable.join(edges.select("cloud_id", F.col("src").alias("point_id")).distinct(), POINT, "left_anti")
    open_ = beyond.unionByName(alone).distinct()
    holes = cut(passable.join(hop_distance(open_, edges, None, [label], allowed=passable), key, "left_anti"), "holes")
    before = members.groupBy("cloud_id", label).agg(F.count(F.lit(1)).alias("before"))
    added = holes.groupBy("cloud_id", label).agg(F.count(F.lit(1)).alias("added")).join(before, ["cloud_id", label])
    fine = added.where(F.col("before") + F.col("added") <= F.col("before") * max_ratio).select("cloud_id", label)
    return members.unionByName(holes.join(fine, ["cloud_id", label], "left_semi"))


def expand_closed(
    closed: DataFrame, candidates: DataFrame, edges: DataFrame, hops: int, label: str = "component", block_others: bool = True
) -> DataFrame:
    """Closed components (cloud_id, label, point_id) grown by up to ``hops`` into the background; adds ``distance``.

    A component does not pass through original candidates of another one. A
    point that several reach goes to the nearest, then the smallest component;
    points of closed components keep theirs at distance 0.
    """
    key = ["cloud_id", label, "point_id"]
    closed = cut(closed.select(*key), "closed")
    owners = None
    if block_others:
        owners = cut(candidates.groupBy(*POINT).agg(F.min(label).alias("own_low"), F.max(label).alias("own_high")), "owners")
    reach = hop_distance(closed, edges, hops, [label], owners=owners).where("hop > 0")
    fresh = reach.join(closed.select(*POINT), POINT, "left_anti")
    owner = fresh.groupBy(*POINT).agg(F.min(F.struct(F.col("hop"), F.col(label))).alias("o"))
    added = owner.select("cloud_id", F.col(f"o.{label}").alias(label), "point_id", F.col("o.hop").alias("distance"))
    return closed.withColumn("distance", F.lit(0)).unionByName(added)


def suppress_peaks(peaks: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """Peaks (cloud_id, point_id, score) that no kept higher peak is near to: their ``hops`` neighbourhoods do not meet.

    The greedy choice by falling score (then smaller id) is the fixed point of:
    a peak is kept once all higher peaks that it meets have gone, and goes once
    one of them is kept. Every round decides at least the highest open peak.
    """
    peaks = cut(peaks.select(*POINT, "score"), "peaks")
    around = cut(hop_distance(peaks.select(*POINT, F.col("point_id").alias("peak")), edges, hops, ["peak"]).select(*POINT, "peak"), "around")
    meets = around.join(around.withColumnRenamed("peak", "other"), POINT).where("peak <> other").select("cloud_id", "peak", "other").distinct()
    rank = peaks.select("cloud_id", F.col("point_id").alias("peak"), F.struct((-F.col("score")).alias("s"), F.col("point_id").alias("i")).alias("r"))
    above = meets.join(rank, ["cloud_id", "peak"]).join(rank.withColumnsRenamed({"peak": "other", "r": "o"}), ["cloud_id", "other"])
    above = cut(above.where(F.col("o") < F.col("r")).select("cloud_id", "peak", "other"), "above")
    state = cut(peaks.select("cloud_id", F.col("point_id").alias("peak"), F.lit(0).alias("state")), "state", open=F.count(F.lit(1)))  # 0 open, 1 kept, 2 gone
    while state.seen["open"]:
        seen = above.join(state.withColumnsRenamed({"peak": "other", "state": "s"}), ["cloud_id", "other"]).groupBy("cloud_id", "peak").agg(
            F.bool_or(F.col("s") == 1).alias("near"), F.bool_and(F.col("s") == 2).alias("free")
        )
        nxt = F.when(F.col("state") != 0, F.col("state")).when(F.coalesce("near", F.lit(False)), 2).when(F.coalesce("free", F.lit(True)), 1).otherwise(0)
        last, state = state, cut(
            state.join(seen, ["cloud_id", "peak"], "left").select("cloud_id", "peak", nxt.alias("state")), "state", open=F.count_if(F.col("state") == 0)
        )
        discard(last)
    kept = state.where("state = 1").select("cloud_id", F.col("peak").alias("point_id"))
    return peaks.join(kept, POINT)
