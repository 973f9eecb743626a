"""How much each fragment reaches through its references, without a table of (root, reference) pairs.

Fragments with one reference that are referred to once form plain runs. Jumps that double bring each to the
end of its run, which then counts as one reference with a sketch of what it passes. In what is left,
references that run in circles are brought together (strongly connected components), which leaves a graph
without circles. Along it, from the ends backwards, every component gets the union of what its
references reach as a sketch of fixed size: each reference is followed once, whatever the number of roots.
A fragment within a run reaches what the run's end reaches and, besides, the rest of its run: a plain sum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Keep = Callable[[DataFrame, str], DataFrame]


def keeper(spark, path: str) -> Keep:
    """Write a table below ``path`` and read it back; repeated names get a number."""
    used: dict[str, int] = {}

    def keep(df: DataFrame, name: str) -> DataFrame:
        used[name] = used.get(name, -1) + 1
        place = f"{path}/{name}/{used[name]:06d}"
        df.write.parquet(place)
        return spark.read.schema(df.schema).parquet(place)

    return keep


def strong_components(links: DataFrame, keep: Keep) -> DataFrame:
    """``(node, component)`` of the nodes that lie on circles of links ``(fragment, ref)``.

    Links that cannot lie on a circle are trimmed. Then the largest node that reaches a node colours it
    (forward), and those of a colour that lead back to the node of that name are a component (backward);
    its links go, until none are left. Every round is one written table; counts alone come to the driver.
    """
    found = None
    rest = keep(links.filter("fragment <> ref"), "links")
    while trimmed := trim(rest, keep):
        rest = trimmed
        nodes = rest.select(F.col("fragment").alias("node")).union(rest.select("ref")).distinct()
        colours = keep(nodes.withColumn("colour", F.col("node")), "colours")
        while True:
            came = rest.join(colours, F.col("fragment") == F.col("node")).groupBy(F.col("ref").alias("node"))
            came = came.agg(F.max("colour").alias("other"))
            mixed = colours.join(came, "node", "left").select("node", F.greatest("colour", "other").alias("colour"), (F.col("other") > F.col("colour")).alias("new"))
            mixed = keep(mixed, "colours")
            colours = mixed.drop("new")
            if mixed.filter("new").isEmpty():
                break
        left = colours.select(F.col("node").alias("fragment"), F.col("colour").alias("own"))
        right = colours.select(F.col("node").alias("ref"), F.col("colour").alias("colour"))
        within = rest.join(left, "fragment").join(right, "ref").filter("own = colour").select("fragment", "ref", "colour")
        within = keep(within, "within")
        edge = keep(colours.filter("node = colour"), "back")
        members = edge
        while not edge.isEmpty():
            step = within.join(edge.select(F.col("node").alias("ref")), "ref").select(F.col("fragment").alias("node"), "colour").distinct()
            edge = keep(step.join(members, "node", "left_anti"), "back")
            members = members.union(edge)
        members = keep(members, "members")
        found = members if found is None else found.union(members)
        gone = members.select("node")
        rest = rest.join(gone, F.col("fragment") == F.col("node"), "left_anti").join(gone, F.col("ref") == F.col("node"), "left_anti")
        rest = keep(rest, "links")
    if found is None:
        found = rest.select(F.col("fragment").alias("node"), F.col("ref").alias("colour")).limit(0)
    return found.withColumnRenamed("colour", "component")


def trim(links: DataFrame, keep: Keep) -> DataFrame | None:
    """Take away, again and again, links from where no link ends and to where no link starts; None if none is left."""
    size = links.count()
    while size:
        starts, ends = (links.select(F.col(c).alias(other)).distinct() for c, other in (("fragment", "ref"), ("ref", "fragment")))
        links = keep(links.join(starts, "ref", "left_semi").join(ends, "fragment", "left_semi"), "links")
        before, size = size, links.count()
        if size == before:
            return links
    return None


def plain_runs(links: DataFrame, keep: Keep) -> DataFrame:
    """``(node, at, steps, tail, top, circle)`` of the nodes where just one of the distinct links starts and one ends.

    Such a node lies on a run that ``steps`` links on leaves for ``at``, which is not plain; ``tail`` is the last
    of the run. Or it lies on a circle of plain nodes, whose largest is ``top``. Each round doubles the steps. Two
    jumps in a row with the same largest node have gone round, for on a run no node comes twice.
    """
    out = links.select(F.col("fragment").alias("node"), F.col("ref").alias("at"))
    into = links.select(F.col("ref").alias("node"), F.lit(None).cast(links.schema["ref"].dataType).alias("at"))
    ends = out.union(into).groupBy("node").agg(F.max("at").alias("at"), F.count("at").alias("n_out"), F.count("*").alias("n"))
    start = ends.filter("n_out = 1 AND n = 2").select("node", "at", F.lit(1).cast("bigint").alias("steps"), F.col("node").alias("tail"), F.col("node").alias("top"))
    running = keep(start.withColumn("circle", F.lit(None).cast("boolean")), "plain")
    known, settled = running, None
    while not running.isEmpty():
        there = known.select(F.col("node").alias("at"), *(F.col(c).alias(f"_{c}") for c in ("at", "steps", "tail", "top", "circle")))
        circle = F.when(F.col("_at").isNull(), False).when(F.col("_circle").isNotNull(), F.col("_circle")).when(F.col("top") == F.col("_top"), True)
        step = running.join(there, "at", "left").select(
            "node",
            F.coalesce("_at", "at").alias("at"),
            (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
            F.coalesce("_tail", "tail").alias("tail"),
            F.greatest("top", "_top").alias("top"),
            circle.alias("circle"),
        )
        step = keep(step, "plain")
        running, closed = step.filter("circle IS NULL"), step.filter("circle IS NOT NULL")
        settled = closed if settled is None else settled.union(closed)
        known = settled.union(running)
    return known


def reach_counts(roots: DataFrame, edges: DataFrame, path: str, lg_k: int = 12) -> DataFrame:
    """``(root, n_refs, on_cycle, degraded)`` for every root.

    ``edges`` holds ``(fragment, ref)``; a fragment without references may have a row with a NULL ``ref``.
    ``n_refs`` estimates the number of fragments reached: the relative standard error is some
    1.04 / sqrt(2**lg_k), 1.6 % by default, and small numbers are exact. ``on_cycle`` (reaches itself)
    and ``degraded`` (reaches a circle) are exact. Roots without references reach 0.

    Plain runs take as many rounds as their longest has doublings. Then there are as many as the longest chain of
    components has, each run counted as one reference; a round sends one sketch for each reference to what
    the round before finished, and holds back what still waits for other references.
    """
    keep = keeper(edges.sparkSession, path)
    links = keep(edges.filter("fragment IS NOT NULL AND ref IS NOT NULL").select("fragment", "ref").distinct(), "links")
    plain = plain_runs(links, keep)
    runs, rings = plain.filter("NOT circle"), plain.filter("circle")
    core = links.join(plain.select(F.col("node").alias("fragment")), "fragment", "left_anti")
    core = core.join(runs.select(F.col("node").alias("ref"), "at", "tail"), "ref", "left")
    core = keep(core.select("fragment", F.coalesce("at", "ref").alias("ref"), "tail"), "core")
    circles = strong_components(core.select("fragment", "ref").distinct(), keep)
    own = core.filter("fragment = ref").select(F.col("fragment").alias("node")).distinct()
    nodes = core.select(F.col("fragment").alias("node")).union(core.select("ref")).distinct()
    placed = nodes.join(circles, "node", "left").join(own.withColumn("self", F.lit(True)), "node", "left")
    placed = placed.select("node", F.coalesce("component", "node").alias("component"), (F.col("component").isNotNull() | F.col("self").isNotNull()).alias("circle"))
    placed = keep(placed, "placed")
    left = placed.select(F.col("node").alias("fragment"), F.col("component").alias("a"))
    right = placed.select(F.col("node").alias("ref"), F.col("component").alias("b"))
    between = keep(core.join(left, "fragment").join(right, "ref").select("a", "b", "tail", (F.col("a") == F.col("b")).alias("inside")), "between")
    pairs = keep(between.filter("NOT inside").select("a", "b").distinct(), "pairs")
    passed = runs.groupBy("tail").agg(F.hll_sketch_agg("node", lg_k).alias("passed"))
    passed = between.join(passed, "tail").groupBy(F.col("a").alias("component"), "inside").agg(F.hll_union_agg("passed").alias("passed"))
    passed = keep(passed, "passed")
    here = placed.groupBy("component").agg(F.hll_sketch_agg("node", lg_k).alias("own"), F.bool_or("circle").alias("circle"))
    here = here.join(pairs.groupBy(F.col("a").alias("component")).agg(F.count("*").alias("n_out")), "component", "left")
    here = here.join(passed.filter("inside").select("component", F.col("passed").alias("within")), "component", "left")
    here = here.join(passed.filter("NOT inside").select("component", "passed"), "component", "left")
    here = keep(here.select("component", "circle", _both("own", "within").alias("own"), "passed", F.coalesce("n_out", F.lit(0)).alias("n_out")), "components")

    def finished(ready: DataFrame) -> DataFrame:
        """``(component, circle, whole, bad, n_below, n_whole)`` of components whose references are all known."""
        ready = ready.withColumn("below", _both("passed", "below"))
        ready = ready.withColumn("whole", _both("own", "below"))
        sizes = (F.coalesce(F.hll_sketch_estimate(c), F.lit(0)).alias(f"n_{c}") for c in ("below", "whole"))
        return ready.select("component", "circle", "whole", (F.col("circle") | F.coalesce("bad", F.lit(False))).alias("bad"), *sizes)

    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("below", "binary"), ("bad", "boolean"))]
    fresh = keep(finished(here.filter("n_out = 0").select("*", *none)), "done")
    done, waiting = fresh, None
    while not fresh.isEmpty():
        came = pairs.join(fresh.select(F.col("component").alias("b"), "whole", "bad"), "b")
        came = came.select(F.col("a").alias("component"), F.col("whole").alias("below"), "bad", F.lit(1).cast("bigint").alias("n"))
        if waiting is not None:
            came = came.union(waiting)
        merged = came.groupBy("component").agg(F.hll_union_agg("below").alias("below"), F.bool_or("bad").alias("bad"), F.sum("n").alias("n"))
        merged = keep(merged.join(here, "component"), "merged")
        waiting = merged.filter("n < n_out").select("component", "below", "bad", "n")
        fresh = keep(finished(merged.filter("n = n_out")), "done")
        done = done.union(fresh)
    done = done.drop("whole")
    by_core = placed.select("node", "component").join(done, "component")
    by_core = by_core.select("node", F.when(F.col("circle"), F.col("n_whole")).otherwise(F.col("n_below")).alias("n_refs"), "circle", "bad")
    after = between.filter("tail IS NOT NULL").join(done.select(F.col("component").alias("b"), "n_whole", "bad"), "b")
    by_run = runs.select("node", "steps", "tail").join(after.select("tail", "inside", "n_whole", "bad"), "tail")
    further = F.when(F.col("inside"), F.lit(0)).otherwise(F.col("steps") - 1)
    by_run = by_run.select("node", (F.col("n_whole") + further).alias("n_refs"), "inside", "bad")
    by_ring = rings.select("node", "top").join(rings.groupBy("top").agg(F.count("*").alias("n_refs")), "top")
    by_ring = by_ring.select("node", "n_refs", F.lit(True), F.lit(True))
    out = roots.select("root").join(by_core.union(by_run).union(by_ring).withColumnRenamed("node", "root"), "root", "left")
    return out.select(
        "root",
        F.coalesce("n_refs", F.lit(0)).alias("n_refs"),
        F.coalesce("circle", F.lit(False)).alias("on_cycle"),
        F.coalesce("bad", F.lit(False)).alias("degraded"),
    )


def _both(one: str, other: str):
    """The union of two sketches, either of which may be NULL."""
    return F.coalesce(F.hll_union(one, other), one, other)
