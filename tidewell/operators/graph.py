"""Reachability, levels and cycles by rounds.

A frontier round is a join of the frontier with the edges and an anti-join with what was visited; it is written to the shared
folder, and only its count comes to the driver: the joins of rounds are shuffled, as broadcasts would go through it. The
number of such rounds is the depth of the graph. Where depths aren't asked for, chains are folded first, by doubled jumps, so
that rounds don't follow the length of chains.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell import session

stored = partial(session.stored, broadcast=False)


def reach(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node, depth of all nodes that roots (node) lead to along edges (src, dst), each at its least depth."""
    frontier = stored(roots.select("node").distinct().withColumn("depth", F.lit(0)), "frontier")
    visited, depth = frontier, 0
    steps = stored(edges.select("src", "dst").distinct(), "steps")  # once, not in each round
    while max_depth is None or depth < max_depth:
        depth += 1
        found = frontier.join(steps, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = stored(found.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def levels(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, level) by longest path from the nodes without a predecessor, and the nodes that stand on or behind a cycle."""
    left, between = stored(nodes.select("node").distinct(), "left"), stored(edges.select("src", "dst").distinct(), "steps")
    done, level = None, 0
    while not left.isEmpty():
        free = stored(left.join(between.select(F.col("dst").alias("node")), "node", "left_anti").withColumn("level", F.lit(level)), "level")
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        left = stored(left.join(free.select("node"), "node", "left_anti"), "left")
        between = stored(between.join(free.select(F.col("node").alias("src")), "src", "left_anti"), "between")
        level += 1
    return (done if done is not None else nodes.select("node", F.lit(0).alias("level")).limit(0)), left


def _fold(steps: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """jump (node, to, hit, open) of the nodes with one link in, and the links and seeds among the other nodes.

    hit: a seed stands on the way back from the node, itself included. Otherwise the node is reached if to is, the first node
    on that way that doesn't have one link in; open marks nodes without such a node, on or behind a ring without a seed.
    The k-th round doubles the way that is seen.
    """
    sole = steps.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("to")).where("n = 1").select(F.col("dst").alias("node"), "to")
    marked = stored(sole.join(seeds.select("node", F.lit(True).alias("hit")), "node", "left").select("node", "to", F.coalesce("hit", F.lit(False)).alias("hit")), "jump")
    on = marked.select(F.col("node").alias("to"), F.lit(True).alias("open"))
    jump = stored(marked.join(on, "to", "left").select("node", "to", "hit", (~F.col("hit") & F.coalesce("open", F.lit(False))).alias("open")), "jump")
    seen, most = 1, jump.count()
    while seen < most and not jump.where("open").isEmpty():
        far = jump.select(F.col("node").alias("to"), F.col("to").alias("farther"), F.col("hit").alias("far_hit"), F.col("open").alias("far_open"))
        on = jump.where("open").join(far, "to").select("node", F.col("farther").alias("to"), F.col("far_hit").alias("hit"), F.col("far_open").alias("open"))
        jump, seen = stored(on.unionByName(jump.where("NOT open")), "jump"), seen * 2
    heads = jump.select(F.col("node").alias("src"), "to", "hit", "open")
    others = steps.join(jump.select(F.col("node").alias("dst")), "dst", "left_anti").join(heads, "src", "left")
    others = stored(others.select(F.coalesce("to", "src").alias("src"), "dst", F.coalesce("hit", F.lit(False)).alias("hit"), F.coalesce("open", F.lit(False)).alias("open")), "others")
    left = stored(others.where("NOT hit AND NOT open AND src <> dst").select("src", "dst").distinct(), "steps")
    sown = seeds.join(jump.select("node"), "node", "left_anti").unionByName(others.where("hit").select(F.col("dst").alias("node")))
    return jump, left, stored(sown.distinct(), "seeds")


def reachable(edges: DataFrame, roots: DataFrame, least_share: float = 0.25) -> DataFrame:
    """node: roots (node) and all that they lead to along edges (src, dst), without depths.

    Nodes with one link in are folded into the node that their chain comes from, again and again as long as they take at
    least this share of the links (two ways that part and meet again are one link after a fold); what is left goes by
    frontier rounds. So a chain of n takes log n rounds, and links are never more than at the start. Links with a null, and
    those of a node to itself, lead nowhere.
    """
    seeds = stored(roots.select("node").where("node IS NOT NULL").distinct(), "seeds")
    steps, folds = stored(edges.select("src", "dst").where("src <> dst").distinct(), "steps"), []
    while True:
        sizes = steps.groupBy("dst").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") == 1).alias("sole"), F.sum("n").alias("links")).first()
        if not sizes["sole"] or sizes["sole"] < least_share * sizes["links"]:
            break
        jump, steps, seeds = _fold(steps, seeds)
        folds.append(jump)
    found = reach(steps, seeds).select("node") if sizes["links"] else seeds
    for jump in reversed(folds):
        behind = jump.where("NOT hit AND NOT open").join(found.select(F.col("node").alias("to")), "to", "left_semi")
        found = stored(found.unionByName(jump.where("hit").select("node")).unionByName(behind.select("node")), "found")
    return found


def ancestors(parents: DataFrame, start: DataFrame) -> DataFrame:
    """node: start and all that it comes from, where each node has one parent or none (null).

    Jumps are doubled: the k-th round goes 2^k steps at once, so a chain of n takes log n rounds.
    """
    jump = stored(parents.where("parent IS NOT NULL").select("node", "parent"), "jump")
    reached = stored(start.select("node").distinct(), "reached")
    while True:
        more = reached.join(jump, "node").select(F.col("parent").alias("node"))
        reached, before = stored(reached.unionByName(more).distinct(), "reached"), reached
        if reached.count() == before.count():
            return reached
        far = jump.select(F.col("node").alias("parent"), F.col("parent").alias("farther"))
        jump = stored(jump.join(far, "parent").select("node", F.col("farther").alias("parent")), "jump")


def strong_components(edges: DataFrame, trims: int = 3) -> DataFrame:
    """node, component (its smallest node) of the nodes that stand on a cycle; a link to itself is one.

    Each round trims nodes without a way in or out, gives every node the first colour, in a random order of the nodes, that
    leads to it, and takes from each colour what leads back to the node that it comes from: that is a component. What is
    left has fewer nodes, however the links run: of a chain a random colour cuts off a part.
    """
    left = stored(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    found = left.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    left, turn = stored(left.where("src <> dst"), "edges"), 0
    while not left.isEmpty():
        for _ in range(trims):
            ins, outs = (left.select(F.col(c).alias("node")).distinct() for c in ("dst", "src"))
            inner = ins.join(outs, "node", "left_semi")
            size = left.count()
            left = stored(left.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi"), "edges")
            if left.count() == size:
                break
        nodes = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        own = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("root"))
        colours = stored(nodes.withColumn("colour", own), "colours")
        moved = colours
        while not moved.isEmpty():  # on from the nodes whose colour has changed
            offers = moved.join(left, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("at")).agg(F.min("colour").alias("offer"))
            after = stored(colours.join(offers, F.col("node") == F.col("at"), "left").select("node", F.least("colour", "offer").alias("colour"), (F.col("offer") < F.col("colour")).alias("new")), "colours")
            colours, moved = after.select("node", "colour"), after.where("new").select("node", "colour")
        root = colours.select("node", F.col("colour.root").alias("root"))
        of = lambda c: root.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        inside = left.join(of("src"), "src").join(of("dst"), "dst").where("root_src = root_dst")
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        hit = stored(reach(back, root.where("node = root")).select("node").join(root, "node"), "component")
        sizes = hit.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
        found = found.unionByName(hit.join(sizes, "root").select("node", "component"))
        left = stored(left.join(hit.select(F.col("node").alias("src")), "src", "left_anti").join(hit.select(F.col("node").alias("dst")), "dst", "left_anti"), "edges")
        turn += 1
    return stored(found.groupBy("node").agg(F.min("component").alias("component")), "components")


def shortest_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """component, length, cycle: a shortest cycle through the smallest node of each component, as its nodes from there on; of
    several the one that is first in order."""
    of = lambda c: components.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    inside = edges.select("src", "dst").distinct().join(of("src"), "src").join(of("dst"), "dst").where("of_src = of_dst")
    steps = stored(inside.select("src", "dst", F.col("of_src").alias("component")), "steps")
    front = stored(components.where("node = component").select("component", "node", F.array("node").alias("cycle")), "front")
    seen, done = front.select("component", "node"), None
    while not front.isEmpty():
        on = stored(front.join(steps.withColumnRenamed("src", "node"), ["component", "node"]), "on")
        closed = on.where("dst = component").groupBy("component").agg(F.min("cycle").alias("cycle"))
        done = stored(closed if done is None else done.unionByName(closed), "cycles")
        further = on.join(done.select("component"), "component", "left_anti").join(seen.withColumnRenamed("node", "dst"), ["component", "dst"], "left_anti")
        front = stored(further.groupBy("component", "dst").agg(F.min("cycle").alias("before")).select("component", F.col("dst").alias("node"), F.concat("before", F.array("dst")).alias("cycle")), "front")
        seen = seen.unionByName(front.select("component", "node"))
    if done is None:
        return front.select("component", F.lit(0).alias("length"), "cycle")
    return done.select("component", F.size("cycle").alias("length"), "cycle")


def lineage(edges: DataFrame, roots: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """Upstream nodes with their depth, and the edges seen: those of a node on the last level are left out, those that
    lead there stay. edges: src (input), dst (result)."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = reach(back, roots, max_depth)
    seen = edges.join(found.where(F.col("depth") < max_depth).select(F.col("node").alias("dst")), "dst", "left_semi")
    return found, seen


def cascade(nodes: DataFrame, edges: DataFrame, target: DataFrame) -> DataFrame:
    """The steps that a target needs: node, reason (target, stale, missing), skip, ms; nodes: node, status, ms."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    aims = target.select("node", F.lit(True).alias("aim")).distinct()
    found = reachable(back, target).join(aims, "node", "left")
    reason = F.when(F.col("aim"), "target").when(F.col("status") == "stale", "stale").otherwise("missing")
    return found.join(nodes, "node").select("node", reason.alias("reason"), (F.col("status") == "ready").alias("skip"), "ms")


def stale_closure(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node, is_stale: a node is stale if it or any node upstream of it is a seed."""
    hit = reachable(edges, seeds).withColumn("is_stale", F.lit(True))
    return nodes.join(hit, "node", "left").withColumn("is_stale", F.coalesce("is_stale", F.lit(False)))


def staleness_cause(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The cause of each stale node (node, is_stale, source_changed, env_changed): an upstream one first, then the environment, then the source."""
    up = edges.join(nodes.select(F.col("node").alias("src"), F.col("is_stale").alias("up")), "src").groupBy(F.col("dst").alias("node")).agg(F.bool_or("up").alias("up"))
    cause = F.when(F.coalesce("up", F.lit(False)), "input_changed").when(F.col("env_changed"), "env_changed").otherwise("source_changed")
    return nodes.where("is_stale").join(up, "node", "left").select("node", cause.alias("cause"))


def iterate(carry: DataFrame, step, until, max_iter: int) -> tuple[DataFrame, int]:
    """carry, step(carry), step(step(carry)), ... until until(before, after) or max_iter; each carry is stored, which cuts the plan."""
    carry = stored(carry, "iteration-0")
    for k in range(1, max_iter + 1):
        after = stored(step(carry), f"iteration-{k}")
        if until(carry, after):
            return after, k
        carry = after
    return carry, max_iter
