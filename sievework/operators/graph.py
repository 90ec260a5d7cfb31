"""Bounded traversal of an edge table (src, dst, kind), one hop a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import checkpointed


#: What couples a dependent to what it depends on, the closest first (fixed values).
COUPLINGS = ("callers", "interface", "type_users", "distributed", "concurrent", "other")
#: More than there are ranks of couplings.
_RANKS = len(COUPLINGS) + 1


def _walk(seeds: DataFrame, hop: DataFrame, depth: int, cap: int | None = None) -> DataFrame:
    """seed, node, at: nodes within depth hops (a, b, rank) of each seed (node), seeds left out; at is _RANKS times the least depth, plus the
    least rank of a hop that leads there from a node one nearer.

    Each hop joins the nodes of the level before with the hops by key; a node found again stays at its least depth, which is a minimum over
    all rows found, so that no level is held against those before it.
    """
    hop = hop.where(~F.col("a").eqNullSafe(F.col("b")))
    found, last = None, None
    for d in range(1, depth + 1):
        at = (F.lit(d * _RANKS) + F.col("rank")).alias("at")
        if last is None:  # a seed's own hops lie with it
            step = hop.join(seeds.select(F.col("node").alias("a")).distinct(), "a", "left_semi").select(F.col("a").alias("seed"), F.col("b").alias("node"), at)
        else:
            step = last.join(hop, "a").where(~F.col("seed").eqNullSafe(F.col("b"))).select("seed", F.col("b").alias("node"), at)
        found = (step if found is None else found.unionByName(step)).groupBy("seed", "node").agg(F.min("at").alias("at"))
        last = found.where(F.col("at") >= d * _RANKS).select("seed", F.col("node").alias("a"))
        if cap is not None and d < depth:
            full = found.groupBy("seed").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= cap)
            last = last.join(full, "seed", "left_anti")
    return found


def reachable(seeds: DataFrame, edges: DataFrame, depth: int, kinds: tuple[str, ...] | None = None, direction: str = "out", cap: int | None = None) -> DataFrame:
    """seed, node, depth: nodes within depth hops of each seed (node), at their least depth, seeds left out.

    direction: 'out' along edges, 'in' against them, 'both'. With cap, the first cap nodes of a seed by (depth, node).
    Depth is a small constant. A seed that has cap nodes goes no further: what lies deeper comes after them.
    """
    e = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    out, back = e.select(F.col("src").alias("a"), F.col("dst").alias("b")), e.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    hop = {"out": out, "in": back, "both": out.union(back)}[direction].withColumn("rank", F.lit(0))
    found = _walk(seeds, hop, depth, cap).select("seed", "node", F.expr(f"cast(at div {_RANKS} as int)").alias("depth"))
    if cap is None:
        return found
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("seed").orderBy("depth", "node"))).where(F.col("_n") <= cap).drop("_n")


def _within(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """seed, src, dst, kind: edges both of whose ends are among a seed's nodes (seed, node).

    Each edge meets the seeds of that end which fewer seeds have, then the other end is looked up.
    """
    a, b = nodes.select("seed", F.col("node").alias("src")), nodes.select("seed", F.col("node").alias("dst"))
    n = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    e = edges.join(n.select(F.col("node").alias("src"), F.col("n").alias("_src")), "src").join(n.select(F.col("node").alias("dst"), F.col("n").alias("_dst")), "dst")
    by_src = e.where("_src <= _dst").join(a, "src").join(b, ["seed", "dst"])
    by_dst = e.where("_src > _dst").join(b, "dst").join(a, ["seed", "src"])
    return by_src.select("seed", "src", "dst", "kind").unionByName(by_dst.select("seed", "src", "dst", "kind"))


def _between(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """_within for edges that are all different: nodes, a long plan, stand in it half as often."""
    n = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    ends = edges.select("src", "dst", "kind", F.explode(F.array("src", "dst")).alias("node")).join(n, "node")
    both = ends.groupBy("src", "dst", "kind").agg(F.min_by("node", "n").alias("node"), F.count(F.lit(1)).alias("_n")).where("_n = 2")
    met = both.withColumn("other", F.when(F.col("node") == F.col("src"), F.col("dst")).otherwise(F.col("src"))).join(nodes, "node")
    return met.select("seed", "other", "src", "dst", "kind").join(nodes.withColumnRenamed("node", "other"), ["seed", "other"]).select("seed", "src", "dst", "kind")


def _dealt(edges: DataFrame) -> DataFrame:
    """a, b, out, kind: edges with two ends, equal ones once, from both ends (a), out of a or into it; dealt by a.

    A window, unlike distinct(), needs all columns and lets no filter below it but those on a, so every join by a asks for the same rows and Spark
    deals them once. It looks back at plain columns: of an expression, a copy would be dealt too.
    """
    whole = edges.where("src is not null and dst is not null")
    ways = [whole.select(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(a == "src").alias("out"), "kind") for a, b in (("src", "dst"), ("dst", "src"))]
    w = Window.partitionBy("a").orderBy("b", "out", "kind")
    before = [F.lag(c).over(w).alias(f"_{c}") for c in ("b", "out", "kind")]  # all null before the first; out is not null elsewhere
    return ways[0].unionByName(ways[1]).select("*", *before).where("not (b <=> _b and out <=> _out and kind <=> _kind)").drop("_b", "_out", "_kind")


def subgraph(seeds: DataFrame, edges: DataFrame, depth: int, cap: int | None = None) -> DataFrame:
    """seed, src, dst, kind: edges between nodes within depth hops, whatever their direction. Without cap, equal edges count once.

    Nodes less than depth hops away are inner ones, and an edge at one has both ends within depth hops: it counts from src where that is inner,
    else from dst. Edges between two nodes that lie depth hops away are looked up by both ends; with cap, all are.
    """
    if cap is not None:
        nodes = reachable(seeds, edges, depth, direction="both", cap=cap).select("seed", "node")
        return _within(nodes.unionByName(seeds.select(F.col("node").alias("seed"), "node").distinct()), edges)
    hop = _dealt(edges)
    starts = seeds.where("node is not null").select("node").distinct().select(F.col("node").alias("seed"), F.col("node").alias("a"))
    found, last = None, starts
    for d in range(1, depth):
        step = last.join(hop, "a").where("seed <> b").select("seed", "b", F.lit(d).alias("at"))
        # dealt by both, so that what looks pairs up and what goes on from them read the same rows
        found = (step if found is None else found.unionByName(step)).repartition("seed", "b").groupBy("seed", "b").agg(F.min("at").alias("at"))
        last = found.where(F.col("at") == d).select("seed", F.col("b").alias("a"))
    inner = starts if found is None else starts.unionByName(found.select("seed", F.col("b").alias("a")))
    outside = lambda rows: rows if found is None else rows.join(found, ["seed", "b"], "left_anti")
    near = inner.join(hop, "a")
    leaving = near.where("out").select("seed", F.col("a").alias("src"), F.col("b").alias("dst"), "kind")
    coming = outside(near.where("not out and seed <> b")).select("seed", F.col("b").alias("src"), F.col("a").alias("dst"), "kind")

    # Pairs of a seed and a node depth hops away are most rows of a walk, and few of these nodes may have an edge to another. So first come the nodes that
    # lie there for some seed, without the pairs: those next to a node that is inner for several seeds (and maybe inner for all of them themselves),
    # and those next to one that is inner for a single seed but not inner for it. Pairs are made for the ends of edges between two of them only.
    w = Window.partitionBy("a")
    each = inner.select("seed", "a", F.min("seed").over(w).alias("least"), F.max("seed").over(w).alias("most")).where("seed = least")
    each = each.where("least <> most or seed <> a") if depth > 1 else each
    single = each.select("a", F.when(F.col("least") == F.col("most"), F.col("seed")).alias("seed"))
    some = outside(single.join(hop, "a").where("seed is null or seed <> b")).select("b").distinct()
    edge = hop.where("not out").join(some.select(F.col("b").alias("a")), "a").join(some, "b").select(F.col("b").alias("src"), F.col("a").alias("dst"), "kind").distinct()
    ends = edge.select(F.explode(F.array("src", "dst")).alias("a")).distinct()
    back = hop.join(ends, "a").select(F.col("b").alias("a"), F.col("a").alias("b"))
    pairs = outside(inner.join(back, "a").where("seed <> b")).select("seed", F.col("b").alias("node")).distinct()
    return leaving.unionByName(coming).unionByName(_between(pairs, edge))


def impact(seeds: DataFrame, edges: DataFrame, depth: int, couplings: dict[str, str] | None = None) -> DataFrame:
    """seed, category, n: how many nodes depend on each seed within depth hops, by how they are coupled.

    couplings: category of an edge's kind, 'other' without one. A node counts once for each seed, by the closest coupling
    among the edges that lead it one hop nearer.
    """
    rank = F.lit(len(COUPLINGS))
    for kind, category in (couplings or {}).items():
        rank = F.when(F.col("kind") == kind, COUPLINGS.index(category) + 1).otherwise(rank)
    by = _walk(seeds, edges.where("src is not null").select(F.col("dst").alias("a"), F.col("src").alias("b"), rank.alias("rank")), depth)
    name = F.element_at(F.array(*map(F.lit, COUPLINGS)), F.col("at") % _RANKS)
    return by.groupBy("seed", name.alias("category")).agg(F.count(F.lit(1)).alias("n"))


def step_order(steps: DataFrame, needs: DataFrame) -> DataFrame:
    """step, level: the longest chain of needs (step, needed) below each step; null for steps that lie on or behind a cycle.

    A need is a link with a length. Each round, every link to a step that has just one link is led on to where that one goes, so
    links along chains double in length, and of a step's links to the same place the longest stays: rounds grow with the logarithm
    of chains, and with the number of steps with several needs that lie on one path. Links never become more. One that comes back
    to its step, or is longer than there are steps, is on or behind a cycle. Lineage is cut by checkpoints. Needs that are no step
    count as done before.
    """
    every = steps.select("step").distinct()
    most = every.count()
    known = needs.select("step", "needed").distinct().join(every.withColumnRenamed("step", "needed"), "needed", "left_semi").join(every, "step", "left_semi")
    # needed is null where a link ends, length where it ends in a cycle
    links = known.select("step", "needed", F.lit(1).cast("long").alias("length")).unionByName(every.join(known, "step", "left_anti").select("step", F.lit(None).cast("string").alias("needed"), F.lit(0).cast("long").alias("length")))
    n = F.count(F.lit(1)).over(Window.partitionBy("step")).alias("n")
    links = checkpointed(links.select("step", "needed", "length", n))
    moving = True
    while moving:
        only = links.where("n = 1").select(F.col("step").alias("needed"), F.col("needed").alias("_on"), F.col("length").alias("_more"), F.lit(True).alias("_led"))
        led = F.col("_led").isNotNull()
        step = links.where("needed is not null").join(only, "needed", "left").select("step", F.when(led, F.col("_on")).otherwise(F.col("needed")).alias("needed"), F.when(led, F.col("length") + F.col("_more")).otherwise(F.col("length")).alias("length"), led.alias("led"))
        loop = F.coalesce((F.col("needed") == F.col("step")) | (F.col("length") > most), F.lit(False))
        cut = step.select("step", F.when(~loop, F.col("needed")).alias("needed"), F.when(~loop, F.col("length")).alias("length"), "led")
        both = cut.unionByName(links.where("needed is null").select("step", "needed", "length", F.lit(False).alias("led")))
        longest = F.when(F.count("length") == F.count(F.lit(1)), F.max("length")).alias("length")
        links = checkpointed(both.groupBy("step", "needed").agg(longest, F.bool_or("led").alias("led")).select("step", "needed", "length", "led", n))
        moving = not links.where("led").isEmpty()
    level = F.when(F.count("needed") + F.count_if(F.col("length").isNull()) == 0, F.max("length")).cast("int")
    return links.groupBy("step").agg(level.alias("level"))
