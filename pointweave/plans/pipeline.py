"""The detection pipeline over many clouds at once.

Stages: working sample and graph -> evidence -> suppression of normal structure
-> candidate regions -> verification by reconstruction. Every stage is a table
keyed by cloud; a working cloud is bounded by ``sample_points``, which is the
proof behind ``rows_bound`` below. Stage results are cut, so losing an executor
costs one stage at most.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.config import Settings
from pointweave.functions.order_stats import percentiles
from pointweave.operators import graph as G
from pointweave.operators import neighbors as NB
from pointweave.operators import normalize as N
from pointweave.operators import restore as R
from pointweave.operators import rules, spectral, surface
from pointweave.operators.balls import local_contrast
from pointweave.operators.sampling import working_sample
from pointweave.session import cut

IDS = ["cloud_id", "point_id"]


@dataclass
class Stages:
    """Tables of one run, by stage."""

    points: DataFrame
    edges: DataFrame
    evidence: DataFrame | None = None
    masks: DataFrame | None = None
    regions: DataFrame | None = None
    final: DataFrame | None = None
    extra: dict = field(default_factory=dict)


def working_cloud(raw: DataFrame, s: Settings) -> Stages:
    sample = working_sample(raw, s.sample_points, s.sample_mode, s.sample_prefilter, s.sample_seed)
    points = cut(N.isotropic_scale(sample, s.cube), "points")
    knn = cut(NB.knn_join(points, max(max(s.variation_scales), s.graph_k)), "knn")
    edges = cut(NB.mutual_from_knn(knn, s.graph_k, s.graph_cap), "edges")
    return Stages(points, edges, extra={"knn": knn})


def evidence(st: Stages, s: Settings) -> Stages:
    """Surface variation and heat signatures, each turned into a local response."""
    variation = cut(surface.surface_variation(st.points, st.extra["knn"], s.variation_scales), "sv")
    bound = s.sample_points * s.graph_k
    pure = surface.normalized_laplacian(st.points, surface.gaussian_weights(st.edges, bound))
    varied = surface.normalized_laplacian(st.points, surface.variation_weights(st.edges, variation, s.va_gamma))
    hks = []
    for name, lap in (("p", pure), ("v", varied)):
        h = spectral.heat_signatures(spectral.smallest_eigenpairs(lap, s.eigenpairs, st.points))
        hks.append(cut(h.withColumnsRenamed({f"hks{i}": f"{name}{i}" for i in range(3)}), "hks"))
    rows = variation.withColumn("sv_up", F.sqrt(F.greatest("sv", F.lit(0.0)))).join(hks[0], IDS).join(hks[1], IDS)
    values = ["sv_up", "p0", "p1", "p2", "v0", "v1", "v2"]
    z = cut(N.zscore(rows, values), "zscores")
    z = N.mahalanobis(z, ["z_sv_up"], "r_sv")
    z = N.mahalanobis(z, ["z_p0", "z_p1", "z_p2"], "r_p")
    z = cut(N.mahalanobis(z, ["z_v0", "z_v1", "z_v2"], "r_v").select(*IDS, "r_sv", "r_p", "r_v"), "scores")
    smooth = G.smooth(z, ["r_sv", "r_p", "r_v"], st.edges, s.smooth_rounds)
    local = local_contrast(st.points.join(smooth, IDS), ["r_sv", "r_p", "r_v"], s.contrast_radii)
    st.evidence = cut(rows.select(*IDS, "sv", "sv_up").join(local, IDS), "evidence")
    return st


def _grown(roots: DataFrame, response: DataFrame, level: DataFrame, edges, threshold, s: Settings, blocked=None) -> DataFrame:
    budget = roots.select(*IDS).join(level, IDS).select(*IDS, N.hop_budget(F.col("level"), F.lit(True), s.level_budgets).alias("budget"))
    return G.descending_growth(budget, response, edges, threshold, 1e-12, blocked).select(*IDS)


def suppression(st: Stages, s: Settings) -> Stages:
    """Open boundary, normal heat structure, and the veto that protects likely defects."""
    bound, ev = s.sample_points, st.evidence
    none = st.points.select(*IDS).where(F.lit(False))
    rim = cut(surface.open_boundary(st.points, st.edges, s.boundary_angle, s.boundary_neighbors).where("boundary").select(*IDS), "rim")
    parts = cut(G.mask_components(rim, st.edges), "rim_parts")
    groups = parts.join(G.gap_groups(parts, st.edges, s.boundary_gap_edges), ["cloud_id", "component"])
    groups = cut(groups.select(*IDS, F.col("grp").alias("component")), "rim_groups")
    keep = rules.relative_size(G.component_sizes(groups), s.boundary_relative).where("eligible")
    core = groups.join(keep, ["cloud_id", "component"], "left_semi").select(*IDS)
    expanded = cut(G.dilate(core, st.edges, s.boundary_expand), "rim_wide")
    response = ev.select(*IDS, F.col("r_p").alias("response"))
    threshold = cut(N.nonzero_percentile(ev, "r_p", s.growth_percentile, "threshold", bound), "threshold")
    norm = N.quantile_norm(ev.select(*IDS, "r_p"), "r_p", "norm", degenerate="le_eps", rows_bound=bound)
    level = cut(norm.select(*IDS, "norm", N.display_level(F.col("norm")).alias("level")), "level")
    lv = level.select(*IDS, "level")
    boundary = cut(_grown(expanded, response, lv, st.edges, threshold, s), "boundary")
    roots = cut(level.where(F.col("norm") >= s.root_display).select(*IDS), "roots")
    if s.use_suppression:
        protected = cut(_veto(st, s, roots, boundary), "protected")
        grown = _grown(roots.join(protected, IDS, "left_anti"), response, lv, st.edges, threshold, s, protected)
        total = boundary.unionByName(grown).distinct()
        ac = boundary
    else:
        protected, total, ac = none, none, none
    st.extra.update(boundary=boundary, protected=protected)
    flags = [(total, "suppressed"), (ac, "on_boundary"), (boundary, "support")]
    masks = st.points.select(*IDS)
    for df, name in flags:
        masks = masks.join(df.select(*IDS, F.lit(True).alias(name)), IDS, "left")
    st.masks = cut(masks.na.fill(False, [n for _, n in flags]), "masks")
    return st


def _veto(st: Stages, s: Settings, roots: DataFrame, boundary: DataFrame) -> DataFrame:
    """Points of normal-looking components that joint evidence marks as likely defects."""
    bound, ev = s.sample_points, st.evidence
    parts = cut(G.mask_components(roots, st.edges), "veto_parts")
    key = ["cloud_id", "component"]
    touching = parts.join(boundary, IDS, "left_semi").select(*key).distinct()
    parts = cut(parts.join(touching, key, "left_anti"), "veto_parts")
    sv = N.quantile_norm(ev.select(*IDS, "r_sv", "r_v", "sv"), "r_sv", "n_sv", degenerate="le_eps", rows_bound=bound)
    joint = F.col("n_sv")
    if s.use_va:
        sv = N.quantile_norm(sv, "r_v", "n_v", degenerate="le_eps", rows_bound=bound)
        joint = F.least("n_sv", "n_v")
    sv = N.quantile_norm(sv, "sv", "n_c", degenerate="never", rows_bound=bound)
    norm = cut(sv.select(*IDS, joint.alias("joint"), F.col("n_c").alias("response")), "joint")
    own = percentiles(parts.join(norm, IDS), key, "joint", [0.9], ["own_p90"], bound)
    shell = G.hop_distance(parts, st.edges, 2, ["component"]).where(F.col("hop") == 2)
    outer = percentiles(shell.join(norm, IDS), key, "joint", [0.9], ["shell_p90"], bound)
    # a component can only be protected when both percentiles are high, so paths are walked for those clouds alone
    strong = own.join(outer, key).where((F.col("own_p90") >= s.veto_component_p90) & (F.col("shell_p90") >= s.veto_shell_p90))
    strong = cut(strong.select(*key), "strong")
    live = strong.select("cloud_id").distinct()
    near = boundary.join(live, "cloud_id", "left_semi")
    edges = cut(st.edges.join(live, "cloud_id", "left_semi"), "veto_edges")
    hops = G.hop_distance(near, edges)
    paths = G.widest_paths(near, norm.select(*IDS, "response"), edges)
    seen = parts.join(strong, key, "left_semi").join(hops, IDS, "left").join(paths, IDS, "left")
    seen = seen.groupBy(*key).agg(F.min("hop").alias("d"), F.min("path_hops").alias("length"))
    direct = F.least(F.col("d") / F.nullif("length", F.lit(0)), F.lit(1.0))
    ok = F.col("d").isNotNull() & (F.col("length") > 0) & (F.col("d") > s.veto_boundary_hops)
    long = (F.col("d") >= s.veto_long_hops) & (direct >= s.veto_efficiency)
    return parts.join(seen.where(ok & ~long), key, "left_semi").select(*IDS)


def confidence(st: Stages, s: Settings) -> DataFrame:
    """(cloud_id, point_id, confidence, seed): gated product of surface and heat evidence."""
    bound, e = s.sample_points, st.evidence.join(st.masks, IDS)
    e = e.withColumn("a_sv", N.attenuate(F.col("r_sv"), F.col("suppressed"), s.keep_weight))
    e = N.minmax_norm(e, "a_sv", "m_sv")
    fused = F.col("m_sv")
    if s.use_va:
        t = N.nonzero_percentile(e, "r_v", s.growth_percentile, "threshold", bound)
        norm = N.quantile_norm(e.select(*IDS, "r_v"), "r_v", "norm", degenerate="le_eps", rows_bound=bound)
        level = cut(norm.select(*IDS, N.display_level(F.col("norm")).alias("level")), "va_level")
        roots = e.where("suppressed").select(*IDS)
        grown = _grown(roots, e.select(*IDS, F.col("r_v").alias("response")), level, st.edges, cut(t, "va_t"), s)
        e = e.join(grown.select(*IDS, F.lit(True).alias("va_mask")), IDS, "left").na.fill(False, ["va_mask"])
        e = e.withColumn("a_v", N.attenuate(F.col("r_v"), F.col("va_mask"), s.keep_weight))
        e = N.minmax_norm(e, "a_v", "m_v")
        fused = F.least("m_sv", "m_v")
    e = cut(e.withColumn("fused", fused), "fused")
    gate = N.nonzero_percentile(e, "fused", s.semantic_percentile, "t_fused", bound)
    raw = percentiles(e, ["cloud_id"], "sv", [s.variation_percentile / 100.0], ["t_sv"], bound)
    e = e.join(gate, "cloud_id").join(raw, "cloud_id")
    power = F.pow(N.gate(F.col("fused"), F.col("t_fused")), F.lit(s.semantic_exponent))
    e = cut(e.withColumn("confidence", N.gate(F.col("sv"), F.col("t_sv")) * power), "confidence")
    e = N.quantile_norm_positive_fallback(e, "confidence", "shown", rows_bound=bound)
    seed = (F.col("shown") >= s.seed_threshold) & ~F.col("on_boundary")
    return cut(e.select(*IDS, "confidence", seed.alias("seed")), "seeds")


def candidates(st: Stages, s: Settings) -> Stages:
    """Seeds Q, grown regions U, merged regions Y and the marker groups Z and W."""
    bound = s.sample_points
    conf = confidence(st, s)
    seeds = cut(conf.where("seed").select(*IDS), "seed_points")
    links = cut(NB.seed_graph(st.points, seeds, s.seed_k, s.seed_scale_k, s.seed_factor), "seed_edges")
    parts = G.components(seeds, links)
    shown = st.evidence.select(*IDS, "sv")
    shown = N.quantile_norm(shown, "sv", "value", degenerate="never", rows_bound=bound)
    shown = cut(shown.select(*IDS, "value"), "shown")
    red = percentiles(shown, ["cloud_id"], "value", [s.seed_red_quantile], ["red"], bound)
    q = cut(rules.drop_small_and_red(parts, shown, red, s.seed_min_size).select(*IDS, "component"), "q")
    energy = st.evidence.select(*IDS, F.col("sv_up").alias("energy"))
    if not s.use_growth:
        st.extra.update(q=q, y=q.select("cloud_id", F.col("component").alias("y_id"), "point_id"), conf=conf)
        return st
    norm = N.quantile_norm(energy, "energy", "norm", rows_bound=bound).select(*IDS, F.col("norm").alias("energy"))
    norm = cut(norm, "grow_energy")
    floor = percentiles(q.join(norm, IDS), ["cloud_id", "component"], "energy", [s.grow_level], ["level"], bound)
    floor = floor.select("cloud_id", "component", F.greatest(F.col("level") * s.grow_ratio, F.lit(s.grow_floor)).alias("floor"))
    u = cut(G.energy_growth(q, norm, st.edges, cut(floor, "floor"), s.grow_hops).select("cloud_id", "component", "point_id"), "u")
    y, lineage = G.label_aware_merge(u, energy, st.edges, s.merge_percentile, s.merge_ratio)
    y = cut(y, "y")
    # marker groups: strong confidence, completed by Q so that every Q lies in exactly one Z
    high = N.percentile_mask(conf, "confidence", s.z_percentile, "high", strict=True, rows_bound=bound).where("high")
    zmask = cut(high.select(*IDS).unionByName(q.select(*IDS)).distinct(), "z_mask")
    own = q.select("cloud_id", F.col("point_id").alias("src"), F.col("component").alias("c0"))
    other = q.select("cloud_id", F.col("point_id").alias("dst"), F.col("component").alias("c1"))
    inside = links.join(own, ["cloud_id", "src"]).join(other, ["cloud_id", "dst"]).where(F.col("c0") == F.col("c1"))
    zedges = st.edges.select("cloud_id", "src", "dst").unionByName(inside.select("cloud_id", "src", "dst")).distinct()
    z = cut(G.mask_components(zmask, zedges).withColumnRenamed("component", "z_id"), "z")
    active = z.join(seeds, IDS, "left_semi").select("cloud_id", "z_id").distinct()
    active = cut(active, "z_active")
    meets = z.join(active, ["cloud_id", "z_id"], "left_semi").join(y, IDS).select("cloud_id", "y_id", "z_id").distinct()
    anchor = meets.groupBy("cloud_id", "y_id").agg(F.min("z_id").alias("src"))
    ties = meets.join(anchor, ["cloud_id", "y_id"]).select("cloud_id", "src", F.col("z_id").alias("dst"))
    nodes = active.select("cloud_id", F.col("z_id").alias("point_id"))
    w = G.components(nodes, ties).select("cloud_id", F.col("point_id").alias("z_id"), F.col("component").alias("w_id"))
    w = cut(w, "w")
    wpoints = z.join(w, ["cloud_id", "z_id"]).select("cloud_id", F.col("w_id").alias("component"), "point_id")
    closed = G.close(wpoints, st.edges, s.closing_hops, s.closing_hops, ["component"], keep_original=True)
    wsize = closed.groupBy("cloud_id", F.col("component").alias("w_id")).agg(F.count(F.lit(1)).alias("w_size"))
    st.extra.update(q=q, u=u, y=y, z=z, lineage=lineage, w=w, wsize=cut(wsize, "wsize"), conf=conf)
    return st


def _closings(st: Stages, s: Settings) -> DataFrame:
    """(cloud_id, y_id, point_id, hop, original, priority): each region closed on its own."""
    y = st.extra["y"].select("cloud_id", F.col("y_id").alias("component"), "point_id")
    key = ["cloud_id", "component", "point_id"]
    wide = cut(G.hop_distance(y, st.edges, s.closing_hops, ["component"]), "wide")
    eroded = G.erode(wide.select(*key), st.edges, s.closing_hops, ["component"], isolated="drop")
    closed = eroded.unionByName(y.select(*key)).distinct().join(wide, key)
    energy = st.evidence.select(*IDS, "sv_up")
    seed = st.extra["q"].join(energy, IDS).groupBy("cloud_id", F.col("component").alias("q_id")).agg(F.avg("sv_up").alias("mean"))
    meet = st.extra["q"].withColumnRenamed("component", "q_id").join(y, IDS).select("cloud_id", "component", "q_id").distinct()
    by_seed = meet.join(seed, ["cloud_id", "q_id"]).groupBy("cloud_id", "component").agg(F.max("mean").alias("by_seed"))
    by_self = y.join(energy, IDS).groupBy("cloud_id", "component").agg(F.avg("sv_up").alias("by_self"))
    priority = by_self.join(by_seed, ["cloud_id", "component"], "left")
    priority = priority.select("cloud_id", "component", F.coalesce("by_seed", "by_self").alias("priority"))
    out = closed.join(priority, ["cloud_id", "component"])
    return cut(out.withColumn("original", F.col("hop") == 0), "closings")


def overlap_owner(closings: DataFrame) -> DataFrame:
    """One owner per point: its original region, else highest priority, nearest, smallest id."""
    rank = F.struct((~F.col("original")).alias("o"), (-F.col("priority")).alias("p"), "hop", "component")
    return closings.groupBy(*IDS).agg(F.min(rank)["component"].alias("component")).select("cloud_id", "component", "point_id")


def seed_evidence(st: Stages, closings: DataFrame) -> DataFrame:
    """One row per seed component with the sizes the scale rules read."""

    def sizes(df, label, name):
        return df.groupBy("cloud_id", label).agg(F.count(F.lit(1)).alias(name))

    e = st.extra
    q = sizes(e["q"].withColumnRenamed("component", "q_id"), "q_id", "q_size")
    u = sizes(e["u"].withColumnRenamed("component", "q_id"), "q_id", "u_size")
    y = sizes(e["y"], "y_id", "y_size")
    g = sizes(overlap_owner(closings).withColumnRenamed("component", "y_id"), "y_id", "gtr_size")
    lineage = e["lineage"].select("cloud_id", F.col("component").alias("q_id"), "y_id")
    z_of = e["q"].withColumnRenamed("component", "q_id").join(e["z"], IDS).groupBy("cloud_id", "q_id")
    z_of = z_of.agg(F.min("z_id").alias("z_id"), F.count_distinct("z_id").alias("z_count"))
    zs = sizes(e["z"], "z_id", "z_size")
    rows = q.join(u, ["cloud_id", "q_id"]).join(lineage, ["cloud_id", "q_id"]).join(y, ["cloud_id", "y_id"])
    rows = rows.join(g, ["cloud_id", "y_id"]).join(z_of, ["cloud_id", "q_id"]).join(zs, ["cloud_id", "z_id"])
    rows = rows.join(e["w"], ["cloud_id", "z_id"]).join(e["wsize"], ["cloud_id", "w_id"])
    once = F.when(F.col("z_count") != 1, F.raise_error(F.lit("a seed component lies in more than one marker group"))).otherwise(F.col("z_size"))
    return cut(rows.withColumn("z_size", once).withColumn("seed_state", rules.seed_state()), "seed_evidence")


def verify(st: Stages, s: Settings) -> Stages:
    """Close, reconstruct, measure and classify every region; then clean its points."""
    bound = s.sample_points
    key = ["cloud_id", "component"]
    closings = _closings(st, s)
    cleanup = None
    if s.use_growth:
        seeds = seed_evidence(st, closings)
        votes = cut(rules.vote_regions(seeds), "votes")
        normal = votes.where(F.col("y_state") == "normal").select("cloud_id", F.col("y_id").alias("component"))
        closings = cut(closings.join(normal, key, "left_anti"), "closings")
        kept = votes.where(F.col("y_state") != "normal").select("cloud_id", "y_id")
        bad = seeds.where(F.col("seed_state").isin("strong_normal", "weak_normal")).join(kept, ["cloud_id", "y_id"], "left_semi")
        cleanup = st.extra["u"].join(bad.select("cloud_id", F.col("q_id").alias("component")), key, "left_semi").select(*IDS).distinct()
        st.extra.update(seed_evidence=seeds, votes=votes)
    closed = cut(overlap_owner(closings), "closed")
    support = cut(G.dilate(st.extra["boundary"], st.edges, s.support_expand), "support")
    inner = cut(closed.join(support, IDS, "left_anti"), "decision")
    if not s.use_verification:
        st.final = inner
        st.regions = inner.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).withColumn("verdict", F.lit("accepted"))
        return st
    restored = cut(R.restore_regions(st.points, st.edges, inner, s.restoration), "restored")
    fields = cut(R.displacement_and_stress(st.points, restored, st.edges), "fields")
    ring = cut(G.rings(closed, st.edges, 3).select(*key, "point_id"), "ring")
    control_area = closed.unionByName(ring)
    control = cut(R.restore_regions(st.points, st.edges, control_area, s.restoration), "control")
    control = R.displacement_and_stress(st.points, control, st.edges)
    fs = fields.select(*IDS, "displacement", "stress")
    stats = rules.region_statistics(inner, fs, rows_bound=bound)
    counts = cut(st.points.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("cloud_size")), "counts")
    area = control_area.groupBy(*key).agg(F.count(F.lit(1)).alias("area"))
    room = area.join(counts, "cloud_id").where(F.col("cloud_size") - F.col("area") >= s.min_context)
    ring_rows = ring.join(room, key, "left_semi").join(control, [*key, "point_id"])
    reference = _ring_statistics(ring_rows, bound)
    both = rules.reference_ratios(stats, reference).join(counts, "cloud_id")
    verdict = rules.classify_regions(
        mode=s.classifier, min_size=s.min_region, max_ratio=s.max_normal_ratio, min_large_fraction=s.min_large_fraction,
        max_shallow=s.max_shallow, object_scale=s.cube, max_stress=s.max_stress, absolute_threshold=s.absolute_threshold,
    )
    st.regions = cut(both.withColumn("verdict", verdict), "regions")
    every = st.points.select(*IDS).join(fs, IDS, "left").na.fill(0.0, ["displacement", "stress"])
    every = N.quantile_norm(every, "displacement", "n_d", rows_bound=bound)
    every = cut(N.quantile_norm(every, "stress", "n_s", rows_bound=bound), "quadrants")
    every = every.withColumn("quadrant", rules.quadrant(F.col("n_d"), F.col("n_s")))
    accepted = inner.join(st.regions.where(F.col("verdict") == "accepted"), key, "left_semi")
    final = accepted.join(every.where(F.col("quadrant") != 4).select(*IDS), IDS, "left_semi")
    if cleanup is not None:
        final = final.join(cleanup, IDS, "left_anti")
    st.extra["fields"] = every
    st.final = cut(final, "final")
    return st


def _ring_statistics(ring_rows: DataFrame, bound: int) -> DataFrame:
    """Control statistics; rings of different regions may share points, so rows carry their region."""
    key = ["cloud_id", "component"]
    d = percentiles(ring_rows, key, "displacement", [0.5, 0.9, 0.95], ["d_median", "d_p90", "d_p95"], bound)
    t = percentiles(ring_rows, key, "stress", [0.5, 0.9, 0.95], ["s_median", "s_p90", "s_p95"], bound)
    return d.join(t, key)


def run_pipeline(raw: DataFrame, settings: Settings | None = None) -> Stages:
    """raw: cloud_id, point_id, x, y, z. Ground truth is not an input and cannot leak in."""
    s = settings or Settings()
    st = working_cloud(raw, s)
    st = evidence(st, s)
    st = suppression(st, s)
    st = candidates(st, s)
    return verify(st, s)


def point_report(st: Stages) -> DataFrame:
    """One row per working point with its evidence, masks and verdict."""
    defect = st.final.select(*IDS, F.lit(True).alias("defect"))
    out = st.points.select(*IDS, "sample_rank").join(st.evidence, IDS).join(st.masks, IDS).join(defect, IDS, "left")
    return out.na.fill(False, ["defect"])
