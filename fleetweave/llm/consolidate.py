"""p2: one group identifier for everything linked directly or through others (Borůvka hooking).

Each round every component picks its smallest outgoing edge. Edges are ordered by (smaller label, larger label), and
then the smallest edge of a component is the one to its smallest neighbour, so the pick is one `min` with map-side
combine however many edges a component has. Picks form trees whose only cycles are two components that chose each
other; the smaller one becomes the root. Pointer doubling lets every component know its root, edges are relabelled,
those inside a component dropped, repeated ones merged, and the next round begins until no edge remains. A round at
least halves the number of components that still have edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetweave.session import discard, staged


def _double(parents: DataFrame) -> DataFrame:
    """(id, root) of (id, parent): pointers jump to their target's target until none moves."""
    now = parents
    while True:
        up = now.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
        step = staged(now.join(up, "parent", "left").select("id", "parent", F.coalesce("grand", "parent").alias("grand")), "p2-jump")
        moved = not step.where("grand <> parent").isEmpty()
        if now is not parents:
            discard(now._from)
        now = step.select("id", F.col("grand").alias("parent"))
        now._from = step
        if not moved:
            return now


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """`(id, group_id)` of every end of an edge; `group_id` is the smallest id of the group, by code points.

    Self pairs make an id of its own group; null ends are ignored; direction and repetition don't matter; an empty
    table gives an empty table.
    """
    a, b = F.col(left), F.col(right)
    ends = edges.where(a.isNotNull() & b.isNotNull()).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    live = staged(ends.where("u <> v").distinct(), "p2-edges")
    loops = ends.where("u = v").select(F.col("u").alias("id")).distinct()
    label: DataFrame | None = None  # (id, root) so far
    while not live.isEmpty():
        both = live.select(F.col("u").alias("id"), F.col("v").alias("to")).unionByName(live.select(F.col("v").alias("id"), F.col("u").alias("to")))
        pick = staged(both.groupBy("id").agg(F.min("to").alias("parent")), "p2-pick")
        back = pick.select(F.col("id").alias("parent"), F.col("parent").alias("theirs"))
        mutual = (F.col("theirs") == F.col("id")) & (F.col("id") < F.col("parent"))
        hooked = pick.join(back, "parent", "left").select("id", F.when(mutual, F.col("id")).otherwise(F.col("parent")).alias("parent"))
        roots = _double(hooked)
        to = roots.select(F.col("id").alias("root"), F.col("parent").alias("next"))
        if label is None:
            new = staged(to.select(F.col("root").alias("id"), F.col("next").alias("root")), "p2-label")
        else:
            new = staged(label.join(to, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "p2-label")
        ru = roots.select(F.col("id").alias("u"), F.col("parent").alias("ru"))
        rv = roots.select(F.col("id").alias("v"), F.col("parent").alias("rv"))
        moved = live.join(ru, "u").join(rv, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
        after = staged(moved.distinct(), "p2-edges")
        for old in (live, pick, roots._from, label):
            discard(old)
        live, label = after, new
    if label is None:
        return loops.select("id", F.col("id").alias("group_id"))
    smallest = label.groupBy("root").agg(F.min("id").alias("group_id"))
    linked = label.join(smallest, "root").select("id", "group_id")
    alone = loops.join(linked.select("id"), "id", "left_anti").select("id", F.col("id").alias("group_id"))
    return linked.unionByName(alone)


def consolidate(records: DataFrame, pairs: DataFrame, key: str, left: str, right: str, weight: str, threshold: float) -> DataFrame:
    """`(key, group_id)`: every distinct `key` of `records` once, with the smallest `key` of its group.

    Pairs of a weight at least `threshold` link (null weights and NaN don't), also through ids that aren't in
    `records`; such ids neither come out nor name a group. A record without a link has its own `key`. Null keys are left out.
    """
    w = F.col(weight)
    links = pairs.where((w >= threshold) & ~F.isnan(w))
    groups = components(links, left, right)
    ids = records.where(F.col(key).isNotNull()).select(F.col(key).alias("id")).distinct()
    known = ids.join(groups, "id", "left")
    # a group's name must be a record: the smallest member that is one
    linked = known.where(F.col("group_id").isNotNull())
    named = linked.groupBy("group_id").agg(F.min("id").alias("name"))
    out = known.join(named, "group_id", "left")
    return out.select(F.col("id").alias(key), F.coalesce("name", "id").alias("group_id"))
