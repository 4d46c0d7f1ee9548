"""Density clusters: mutual reachability, condensed tree and the most stable choice of clusters, as joins.

A threshold that grows from zero joins points by their edges. A component counts as a cluster from ``min_cluster_size``
points on. Three facts let this be found without a sorted pass over all edges:

* The lightest edge that leaves a component joins it to its neighbour exactly at that weight. So small components can all
  be settled at once: where two have the same lightest edge they merge; where the trail of lightest edges ends
  in a cluster, every component on the trail falls to that cluster at the weight of its own lightest edge.
* Once each point knows the edge at which it came into a cluster (its entry), what is left to merge are whole clusters, at
  most one for every ``min_cluster_size`` points.
* Of whole clusters, an edge that is no cluster's lightest joins two merges; the others extend a chain of merges. So all lightest
  edges are contracted, round by round, and the tree is built from the last round down: the edges of a round are placed in
  the tree of the later ones by leaps, sorted into their chains. Rounds grow with the logarithm of the number of
  clusters, whatever the depth of the tree.

Edges are ordered by (weight, smaller id, larger id), so ties have one outcome.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatseam.session import saved

NOISE = -1

# Distances below this count as this, so that copies of a point have a finite density.
LEAST_DISTANCE = 1e-9


def mutual_reachability(neighbours: DataFrame, min_samples: int = 5) -> DataFrame:
    """``(a, b, weight)`` with a < b: the greatest of the distance and both core distances.

    ``neighbours`` is ``(id, neighbour, distance)`` with at least ``min_samples`` neighbours a point where there
    are so many. The core distance is that of the ``min_samples``-th neighbour (the last, if fewer).
    """
    ordered = F.array_sort(F.collect_list("distance"))
    core = neighbours.groupBy("id").agg(ordered.alias("distances")).select(
        "id", F.col("distances")[F.least(F.size("distances"), F.lit(min_samples)) - 1].alias("core")
    )
    core = saved(core)
    other = core.select(F.col("id").alias("neighbour"), F.col("core").alias("other_core"))
    # A point without a list of its own has no core distance; greatest() skips nulls.
    weighted = neighbours.where(F.col("id") != F.col("neighbour")).join(core, "id").join(other, "neighbour", "left")
    return weighted.groupBy(
        F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")
    ).agg(F.min(F.greatest("distance", "core", "other_core")).alias("weight"))


def density_clusters(points: DataFrame, edges: DataFrame, min_cluster_size: int = 30) -> DataFrame:
    """``(id, topic, strength)`` for every id of ``points``.

    ``edges`` is ``(a, b, weight)`` with a < b. ``topic`` is the smallest id of the cluster, or -1 for noise, so ids must not
    be negative. ``strength`` is the density at which the point entered, as a share of the greatest in its
    cluster; 0 for noise. Clusters are those of the greatest total stability (excess of mass). The cluster that holds
    everything is none, unless the graph falls into several parts that each hold one.

    Null ids take no part; ids without edges are noise; repeated edges count once, by their least weight.
    Rounds: at most ``min_cluster_size`` for the small components, then some that grow with the logarithm of the clusters, each
    with leaps that grow with the logarithm of the tree's depth.
    """
    if min_cluster_size < 2:
        raise ValueError("min_cluster_size must be at least 2")
    ids = points.select(F.col("id").cast("bigint").alias("id")).where(F.col("id").isNotNull()).distinct()
    entered, between = _enter(ids, edges, min_cluster_size)
    nodes, leaps = _with_ancestors(_merge_clusters(entered, between))
    fallen = saved(_climbed(entered.select("id", "entry", _leaf(F.col("cluster")).alias("node")), "entry", nodes, leaps))
    chosen = _choose(fallen, nodes, leaps)
    placed = fallen.join(chosen, "node").where(F.col("top").isNotNull()).select("id", "top", _density(F.col("entry.weight")).alias("density"))
    placed = saved(placed)
    clusters = placed.groupBy("top").agg(F.min("id").alias("topic"), F.max("density").alias("most"))
    labelled = placed.join(clusters, "top").select("id", "topic", (F.col("density") / F.col("most")).alias("strength"))
    return ids.join(labelled, "id", "left").select(
        "id", F.coalesce("topic", F.lit(NOISE).cast("bigint")).alias("topic"), F.coalesce("strength", F.lit(0.0)).alias("strength")
    )


def _density(weight: Column) -> Column:
    return 1 / F.greatest(weight, F.lit(LEAST_DISTANCE))


def _both_ways(edges: DataFrame) -> DataFrame:
    turned = edges.select(
        F.col("right").alias("left"), F.col("right_small").alias("left_small"),
        F.col("left").alias("right"), F.col("left_small").alias("right_small"), "edge",
    )
    return edges.select("left", "left_small", "right", "right_small", "edge").unionByName(turned)


def _enter(ids: DataFrame, edges: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Points ``(id, cluster, entry)`` and edges ``(left, right, edge)`` between different clusters."""
    edge = F.struct(F.col("weight").cast("double").alias("weight"), F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))
    small = F.lit(True)
    active = saved(
        edges.where((F.col("a") != F.col("b")) & F.col("weight").isNotNull())
        .groupBy(F.col("a").cast("bigint").alias("left"), F.col("b").cast("bigint").alias("right"))
        .agg(F.min(edge).alias("edge"))
        .select("left", small.alias("left_small"), "right", small.alias("right_small"), "edge")
    )
    waiting = saved(ids.select("id", F.col("id").alias("part")))
    sizes = waiting.select("part", F.lit(1).cast("bigint").alias("size"))
    entered: list[DataFrame] = []
    between: list[DataFrame] = []
    while not active.isEmpty():
        lightest = (
            _both_ways(active).where("left_small").groupBy(F.col("left").alias("part"))
            .agg(F.min(F.struct("edge", "right", "right_small")).alias("pick"))
            .select("part", "pick.edge", F.col("pick.right").alias("next"), F.col("pick.right_small").alias("next_small"))
        )
        lightest = saved(lightest.join(sizes, "part"))
        back = lightest.select(F.col("part").alias("next"), F.col("next").alias("_back"), F.col("size").alias("next_size"))
        # The lightest edge of both ends: a pair. The smaller name becomes its root.
        paired = lightest.join(back, "next", "left").withColumn("pair", F.coalesce(F.col("_back") == F.col("part"), F.lit(False)))
        trail = saved(
            paired.select(
                "part", "edge", "pair", "size",
                F.when(F.col("pair"), F.least("part", "next")).otherwise(F.col("next")).alias("root"),
                F.when(F.col("pair"), F.col("size") + F.col("next_size")).alias("pair_size"),
            )
        )
        roots = _ends(trail.select("part", "root"))
        pair_of = trail.where("pair").select(F.col("part").alias("root"), F.col("pair_size").alias("root_size"))
        ended = trail.drop("root").join(roots, "part").join(pair_of, "root", "left")
        # Without a size the trail ends in a cluster; with enough of it, in one that begins now.
        settled = F.col("root_size").isNull() | (F.col("root_size") >= least)
        moves = saved(
            ended.where(settled | F.col("pair")).select("part", F.col("root").alias("to"), "edge", settled.alias("settled"), "size")
        )
        here = waiting.join(moves.select("part", "to", "edge", "settled"), "part", "left")
        here = saved(here)
        entered.append(here.where("settled").select("id", F.col("to").alias("cluster"), F.col("edge").alias("entry")))
        waiting = here.where(~F.coalesce("settled", F.lit(False))).select("id", F.coalesce("to", "part").alias("part"))
        # A part is small, so the count of its points is no hot key.
        sizes = waiting.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
        moved = active
        for side in ("left", "right"):
            to = moves.select(F.col("part").alias(side), "to", "settled")
            moved = moved.join(to, side, "left").select(
                F.coalesce("to", side).alias(side),
                (F.col(f"{side}_small") & ~F.coalesce("settled", F.lit(False))).alias(f"{side}_small"),
                *[name for name in moved.columns if not name.startswith(side)],
            )
        moved = (
            moved.where(F.col("left") != F.col("right"))
            .groupBy(
                F.least("left", "right").alias("_a"), F.greatest("left", "right").alias("_b"),
                F.when(F.col("left") < F.col("right"), F.col("left_small")).otherwise(F.col("right_small")).alias("_a_small"),
                F.when(F.col("left") < F.col("right"), F.col("right_small")).otherwise(F.col("left_small")).alias("_b_small"),
            )
            .agg(F.min("edge").alias("edge"))
            .select(
                F.col("_a").alias("left"), F.col("_a_small").alias("left_small"),
                F.col("_b").alias("right"), F.col("_b_small").alias("right_small"), "edge",
            )
        )
        moved = saved(moved)
        still = F.col("left_small") | F.col("right_small")
        # Clusters keep their name from here on, so their edges need no further round.
        between.append(moved.where(~still).select("left", "right", "edge"))
        active = moved.where(still)
    key = "struct<weight:double,a:bigint,b:bigint>"
    spark = ids.sparkSession
    none_entered = spark.createDataFrame([], f"id bigint, cluster bigint, entry {key}")
    none_between = spark.createDataFrame([], f"left bigint, right bigint, edge {key}")
    all_between = reduce(DataFrame.unionByName, between, none_between)
    return (
        saved(reduce(DataFrame.unionByName, entered, none_entered)),
        saved(all_between.groupBy("left", "right").agg(F.min("edge").alias("edge"))),
    )


def _ends(trail: DataFrame) -> DataFrame:
    """``(part, root)``: where the trails end, by doubling the steps. Roots point to themselves or have no row."""
    while True:
        step = trail.select(F.col("part").alias("root"), F.col("root").alias("_further"))
        further = saved(trail.join(step, "root", "left"))
        trail = further.select("part", F.coalesce("_further", "root").alias("root"))
        if further.where(F.col("_further") != F.col("root")).isEmpty():
            return trail


def _leaf(cluster: Column) -> Column:
    return F.concat(cluster.cast("string"), F.lit(":"))


def _merge(edge: Column) -> Column:
    """The name of the merge at an edge; null without one."""
    return F.concat(edge["a"].cast("string"), F.lit("-"), edge["b"].cast("string"))


def _merge_clusters(entered: DataFrame, between: DataFrame) -> DataFrame:
    """The tree ``(node, edge, parent, parent_edge)`` of clusters: those that points entered, and one for each merge of two."""
    rounds: list[DataFrame] = []
    active = saved(between.select("left", "right", "edge"))
    while not active.isEmpty():
        ways = active.unionByName(active.select(F.col("right").alias("left"), F.col("left").alias("right"), "edge"))
        lightest = ways.groupBy(F.col("left").alias("part")).agg(F.min(F.struct("edge", "right")).alias("pick"))
        lightest = saved(lightest.select("part", "pick.edge", F.col("pick.right").alias("next")))
        back = lightest.select(F.col("part").alias("next"), F.col("next").alias("_back"))
        # The lightest edge of both ends: a pair. The smaller name becomes its root.
        root = F.when(F.col("_back") == F.col("part"), F.least("part", "next")).otherwise(F.col("next"))
        trail = saved(lightest.join(back, "next").select("part", root.alias("root")))
        rounds.append(saved(lightest.select("part", "edge").join(_ends(trail).withColumnRenamed("root", "to"), "part")))
        for side in ("left", "right"):
            to = rounds[-1].select(F.col("part").alias(side), "to")
            active = active.join(to, side).withColumn(side, F.col("to")).drop("to")
        active = saved(
            active.where(F.col("left") != F.col("right"))
            .groupBy(F.least("left", "right").alias("_a"), F.greatest("left", "right").alias("_b"))
            .agg(F.min("edge").alias("edge"))
            .select(F.col("_a").alias("left"), F.col("_b").alias("right"), "edge")
        )
    leaves = entered.groupBy("cluster").agg(F.min("entry").alias("edge"))
    named = leaves.select(_leaf(F.col("cluster")).alias("node"), "cluster", "edge")
    if not rounds:
        key = entered.schema["entry"].dataType
        return named.select("node", "edge", F.lit(None).cast("string").alias("parent"), F.lit(None).cast(key).alias("parent_edge"))
    tree = None
    for at in reversed(range(len(rounds))):
        merges = rounds[at].groupBy("edge").agg(F.min("to").alias("to"))
        if tree is None:
            chains = merges.select("edge", _leaf(F.col("to")).alias("chain"), F.lit(None).cast(merges.schema["edge"].dataType).alias("top"))
            tree = _chained(chains)
            continue
        # Where the contracted parts first merge, and from there up to the last merge before the edge.
        first = rounds[at + 1].select(F.col("part").alias("to"), F.col("edge").alias("first"))
        started = merges.join(first, "to", "left").withColumn("node", F.when(F.col("first") < F.col("edge"), _merge(F.col("first"))))
        known, leaps = _with_ancestors(tree)
        climbed = _climbed(started, "edge", known, leaps).join(known.select("node", "parent_edge"), "node", "left")
        top = F.when(F.col("node").isNull(), F.col("first")).otherwise(F.col("parent_edge"))
        tree = _chained(climbed.select("edge", F.coalesce("node", _leaf(F.col("to"))).alias("chain"), top.alias("top")), tree)
    # A cluster's lightest edge is its first merge.
    parents = rounds[0].select(F.col("part").alias("cluster"), F.col("edge").alias("parent_edge"))
    parented = named.join(parents, "cluster", "left").select("node", "edge", _merge(F.col("parent_edge")).alias("parent"), "parent_edge")
    return saved(parented.unionByName(tree))


def _chained(chains: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """The tree with further merges ``(edge, chain, top)``: above the node ``chain`` of the tree in order, below the merge ``top``."""
    # A chain may hold nearly all merges, so it is sorted in ranges whose ends are joined.
    ordered = saved(chains.repartitionByRange("chain", "edge").withColumn("_range", F.spark_partition_id()))
    starts = ordered.groupBy("chain", "_range").agg(F.min("edge").alias("_first"))
    starts = starts.withColumn("_later", F.lead("_first").over(Window.partitionBy("chain").orderBy("_range")))
    following = F.lead("edge").over(Window.partitionBy("chain", "_range").orderBy("edge"))
    linked = ordered.withColumn("_next", following).join(starts, ["chain", "_range"])
    linked = linked.select("edge", F.coalesce("_next", "_later", "top").alias("parent_edge"))
    if tree is not None:
        lowest = ordered.groupBy(F.col("chain").alias("node")).agg(F.min("edge").alias("_lowest"))
        linked = linked.unionByName(tree.join(lowest, "node", "left").select("edge", F.coalesce("_lowest", "parent_edge").alias("parent_edge")))
    return saved(linked.select(_merge(F.col("edge")).alias("node"), "edge", _merge(F.col("parent_edge")).alias("parent"), "parent_edge"))


def _with_ancestors(nodes: DataFrame) -> tuple[DataFrame, int]:
    """Add ``up``: the ancestors 1, 2, 4, ... steps above, each with its edge, null beyond the top; and how many of these there are."""
    up = saved(nodes.select("node", F.array(F.struct(F.col("parent").alias("node"), F.col("parent_edge").alias("edge"))).alias("up")))
    leaps = 0
    while not up.where(F.col("up")[leaps]["node"].isNotNull()).isEmpty():
        higher = up.select(F.col("node").alias("_via"), F.col("up")[leaps].alias("_next"))
        up = up.withColumn("_via", F.col("up")[leaps]["node"]).join(higher, "_via", "left")
        up = saved(up.select("node", F.concat("up", F.array("_next")).alias("up")))
        leaps += 1
    return saved(nodes.join(up, "node")), leaps


def _climbed(rows: DataFrame, limit: str, nodes: DataFrame, leaps: int) -> DataFrame:
    """Rows with ``node`` moved up to the last merge before the edge ``limit``; null stays null."""
    others = [name for name in rows.columns if name != "node"]
    for step in reversed(range(leaps)):
        higher = nodes.select("node", F.col("up")[step].alias("leap")).where(F.col("leap.node").isNotNull())
        rows = rows.join(higher, "node", "left").select(
            *others, F.when(F.col("leap.edge") < F.col(limit), F.col("leap.node")).otherwise(F.col("node")).alias("node")
        )
    return rows


def _choose(fallen: DataFrame, nodes: DataFrame, leaps: int) -> DataFrame:
    """``(node, top)``: the chosen cluster each node of the tree lies in, null outside all of them."""
    points = fallen.groupBy("node").agg(F.count(F.lit(1)).alias("points"), F.sum(_density(F.col("entry.weight"))).alias("density"))
    tree = saved(
        nodes.join(points, "node", "left").select(
            "node", "parent", "up",
            F.coalesce("points", F.lit(0)).alias("points"), F.coalesce("density", F.lit(0.0)).alias("density"),
            _density(F.col("edge.weight")).alias("ends"),
            F.when(F.col("parent").isNull(), 0.0).otherwise(_density(F.col("parent_edge.weight"))).alias("begins"),
        )
    )
    single = tree.where("parent IS NULL").limit(2).count() == 1
    # After each step a size counts the points twice as far below.
    sized = tree.withColumn("size", F.col("points"))
    for step in range(leaps):
        below = sized.where(F.col("up")[step]["node"].isNotNull()).groupBy(F.col("up")[step]["node"].alias("node")).agg(F.sum("size").alias("_below"))
        sized = saved(sized.join(below, "node", "left").withColumn("size", F.col("size") + F.coalesce("_below", F.lit(0))).drop("_below"))
    stability = F.col("density") + (F.col("size") - F.col("points")) * F.col("ends") - F.col("size") * F.col("begins")
    whole = F.col("parent").isNull() if single else F.lit(False)
    sized = saved(sized.select("node", "parent", "up", stability.alias("stability"), whole.alias("whole")))
    best = _best(sized)
    inner = sized.join(best, "node").groupBy(F.col("parent").alias("node")).agg(F.sum("best").alias("inner"))
    # The highest chosen cluster above each node; each step looks twice as far.
    chosen = ~F.col("whole") & (F.col("inner").isNull() | (F.col("stability") >= F.col("inner")))
    tops = saved(sized.join(inner, "node", "left").select("node", "up", F.when(chosen, F.col("node")).alias("top")))
    for step in range(leaps):
        above = tops.select(F.col("node").alias("_via"), F.col("top").alias("_top"))
        tops = saved(
            tops.withColumn("_via", F.col("up")[step]["node"]).join(above, "_via", "left").select("node", "up", F.coalesce("_top", "top").alias("top"))
        )
    return tops.select("node", "top")


def _best(sized: DataFrame) -> DataFrame:
    """``(node, best)``: the greater of a node's stability and the sum of its children's best.

    A node with one open child of best x has max(own, x + passed). Such steps in a row are one step of the same form, so
    each round takes in the children that are done and halves the rows of single open children.
    """
    children = sized.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.collect_list("node").alias("open"))
    least = F.lit(float("-inf"))
    nothing = F.array().cast("array<string>")
    state = saved(
        sized.join(children, "node", "left").select(
            "node", F.when(F.col("whole"), least).otherwise(F.col("stability")).alias("own"),
            F.when(F.col("open").isNull(), least).otherwise(0.0).alias("passed"), F.coalesce("open", nothing).alias("open"),
        )
    )
    while not state.where(F.size("open") > 0).isEmpty():
        asked = state.select("node", F.size("open").alias("_n"), F.explode("open").alias("_child"))
        child = state.select(F.col("node").alias("_child"), F.col("own").alias("_own"), F.col("passed").alias("_passed"), F.col("open").alias("_open"))
        done, steps = F.size("_open") == 0, (F.col("_n") == 1) & (F.size("_open") == 1)
        taken = F.when(done, F.greatest("_own", "_passed")).when(steps, F.col("_passed")).otherwise(0.0)
        left = F.when(done, nothing).when(steps, F.col("_open")).otherwise(F.array("_child"))
        found = asked.join(child, "_child").groupBy("node").agg(
            F.sum(taken).alias("_taken"), F.max(F.when(steps, F.col("_own"))).alias("_over"), F.flatten(F.collect_list(left)).alias("_left")
        )
        # greatest() skips nulls.
        state = saved(
            state.join(found, "node", "left").select(
                "node", F.greatest("own", F.col("_over") + F.col("passed")).alias("own"),
                (F.col("passed") + F.coalesce("_taken", F.lit(0.0))).alias("passed"), F.coalesce("_left", nothing).alias("open"),
            )
        )
    return state.select("node", F.greatest("own", "passed").alias("best"))
