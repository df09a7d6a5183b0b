"""Closing matches: connected components, clusters, transitive closure.

The loops run on the driver, the rows do not: a round is a few joins, its result
is checkpointed, and only a count comes back. No operator lists all pairs of a
group.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, functions as F

from sameas.session import cut_lineage

PAIR = ["a_id", "b_id"]


def _star_round(edges: DataFrame) -> DataFrame:
    """A large and a small star step on edges (u, v) with u > v, each pair once.
    Large: every larger neighbour of a node moves under its smallest neighbour.
    Small: the smaller neighbours of a node and itself move under the smallest."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    raised = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    lowest = raised.groupBy("u").agg(F.min("v").alias("m"))
    moved = raised.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        lowest.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, cluster_id) with cluster_id the smallest id of the component, by
    alternating star steps (Kiveris et al., SoCC 2014). `edges` is (src, dst);
    `nodes` (id) adds the ones without edges."""
    links = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    oriented = links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    start = cut_lineage(oriented)       # loops kept: their nodes are part of the answer
    everyone = start.select(F.explode(F.array("u", "v")).alias("id"))
    if nodes is not None:
        everyone = everyone.unionByName(nodes.select("id"))
    now, size = start.filter(F.col("u") != F.col("v")), -1
    while True:         # every round that changes anything brings nodes closer to their smallest id
        after = cut_lineage(_star_round(now))
        before, size = size, after.count()
        # both are sets: the same size and no new row mean the same set
        settled = size == before and after.join(now, ["u", "v"], "left_anti").isEmpty()
        now = after
        if settled:
            root = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
            return everyone.distinct().join(root, "id", "left").select(
                "id", F.coalesce("root", "id").alias("cluster_id"))


def two_sided_nodes(pairs: DataFrame) -> DataFrame:
    """(src, dst) with ids of A and B kept apart: 'a:1', 'b:7'."""
    return pairs.select(F.concat(F.lit("a:"), F.col("a_id").cast("string")).alias("src"),
                        F.concat(F.lit("b:"), F.col("b_id").cast("string")).alias("dst"))


def match_clusters(matches: DataFrame) -> DataFrame:
    """(id, cluster_id, size) over predicted matches of two tables."""
    clusters = connected_components(two_sided_nodes(matches))
    sizes = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return clusters.join(sizes, "cluster_id").select("id", "cluster_id", "size")


def _meet(pairs: DataFrame, links: DataFrame, degree: DataFrame) -> DataFrame:
    """Which (x, y) have a common neighbour in links (node, other). The end with
    fewer neighbours is expanded, the other one only looked up."""
    dx = degree.select(F.col("node").alias("x"), F.col("degree").alias("dx"))
    dy = degree.select(F.col("node").alias("y"), F.col("degree").alias("dy"))
    rated = pairs.select("x", "y").distinct().join(dx, "x").join(dy, "y")
    few = rated.select("x", "y", F.when(F.col("dx") <= F.col("dy"), F.col("x")).otherwise(F.col("y")).alias("node"),
                       F.when(F.col("dx") <= F.col("dy"), F.col("y")).otherwise(F.col("x")).alias("many"))
    steps = few.join(links, "node").select("x", "y", F.col("many").alias("node"), "other")
    return steps.join(links, ["node", "other"], "left_semi").select("x", "y").distinct()


def _ends(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, other) seen from A and from B."""
    return (pairs.select(F.col("a_id").alias("node"), F.col("b_id").alias("other")),
            pairs.select(F.col("b_id").alias("node"), F.col("a_id").alias("other")))


def _degrees(pairs: DataFrame, before: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, degree) of A and of B; with `before` the pairs are added to what it counts."""
    found = []
    for side, ends in enumerate(_ends(pairs)):
        new = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        found.append(new if before is None else before[side].unionByName(new).groupBy("node").agg(F.sum("degree").alias("degree")))
    return found[0], found[1]


def _close_once(matched: DataFrame, open_pairs: DataFrame, degrees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Open (e1, e4) with matched (e1, e2), (e3, e2), (e3, e4) for some e2, e3.

    From the end of (e1, e4) with fewer matches one step is taken; the node
    reached and the other end must then have a common matched neighbour.
    """
    by_a, by_b = _ends(matched)
    degree_a, degree_b = degrees or _degrees(matched)
    rated = (
        open_pairs.join(degree_a.select(F.col("node").alias("a_id"), F.col("degree").alias("da")), "a_id")
        .join(degree_b.select(F.col("node").alias("b_id"), F.col("degree").alias("db")), "b_id")
    )
    from_a = rated.filter(F.col("da") <= F.col("db")).join(
        by_a.select(F.col("node").alias("a_id"), F.col("other").alias("x")), "a_id").select(*PAIR, "x", F.col("b_id").alias("y"))
    from_b = rated.filter(F.col("da") > F.col("db")).join(
        by_b.select(F.col("node").alias("b_id"), F.col("other").alias("x")), "b_id").select(*PAIR, "x", F.col("a_id").alias("y"))
    closed_a = from_a.join(_meet(from_a, by_b, degree_b), ["x", "y"], "left_semi").select(*PAIR)
    closed_b = from_b.join(_meet(from_b, by_a, degree_a), ["x", "y"], "left_semi").select(*PAIR)
    return closed_a.unionByName(closed_b).distinct()


def transitive_round(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidate pairs one round of the closure rule adds."""
    known = matches.select(*PAIR).distinct()
    return _close_once(known, candidates.select(*PAIR).distinct().join(known, PAIR, "left_anti"))


def _touched(waiting: DataFrame, known: DataFrame, added: DataFrame) -> DataFrame:
    """The open pairs that a way over an added pair can close. On the way e1, e2, e3, e4 a
    new (e1, e2) or (e3, e2) makes e2 a new B end that e1 is matched with, a new
    (e3, e4) makes e4 one; all other pairs were decided before."""
    ends = added.select("b_id").distinct()
    near = known.join(ends, "b_id", "left_semi").select("a_id").distinct()
    return waiting.join(near, "a_id", "left_semi").unionByName(waiting.join(ends, "b_id", "left_semi")).distinct()


def transitive_closure(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """(a_id, b_id, round): matches (round 0) and the candidates that follow from
    them, until nothing is added. A pair can only close inside a component of the
    matches, so all others leave before the first round; later rounds look only at
    pairs that the last one's additions touch, and add to the counts of matches."""
    known = cut_lineage(matches.select(*PAIR).distinct())
    parts = cut_lineage(connected_components(two_sided_nodes(known)))
    side = lambda tag, col: parts.filter(F.col("id").startswith(tag)).select(
        F.substr("id", F.lit(3)).alias(f"{col}_text"), F.col("cluster_id").alias(f"{col}_cluster"))
    waiting = candidates.select(*PAIR).distinct().join(known, PAIR, "left_anti")
    waiting = (
        waiting.withColumn("a_text", F.col("a_id").cast("string")).withColumn("b_text", F.col("b_id").cast("string"))
        .join(side("a:", "a"), "a_text").join(side("b:", "b"), "b_text")
        .filter(F.col("a_cluster") == F.col("b_cluster")).select(*PAIR)
    )
    waiting = cut_lineage(waiting)
    result, touched, degrees = known.withColumn("round", F.lit(0)), waiting, tuple(map(cut_lineage, _degrees(known)))
    for number in count(1):         # every round takes pairs from those that wait
        added = cut_lineage(_close_once(known, touched, degrees))
        if added.isEmpty():
            return result
        result = result.unionByName(added.withColumn("round", F.lit(number)))
        known = known.unionByName(added)
        waiting = cut_lineage(waiting.join(added, PAIR, "left_anti"))
        touched, degrees = cut_lineage(_touched(waiting, known, added)), tuple(map(cut_lineage, _degrees(added, degrees)))
