"""Connected components by minimum-label contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigraph.sources.tables import stash

#: Edges that a task keeps a forest of before it passes it on, and edges that one task may finish alone.
FOREST, LAST = 500_000, 16_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lo, hi): for the edges seen, each node with the smallest of its component; after FOREST edges the forest starts anew."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def out(kind: pa.DataType) -> pa.RecordBatch:
        pairs = [(find(x), x) for x in list(root)]
        pairs = [p for p in pairs if p[0] != p[1]]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], kind), pa.array([p[1] for p in pairs], kind)], ["lo", "hi"])

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > FOREST:
            yield out(kind)
    if root:
        yield out(kind)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) of every node of an undirected edge list; component is the smallest id of its component.

    Each task first replaces its edges by a forest of them.  Each round then
    maps every node to the smallest of itself and its neighbours and contracts
    the edges by that map.  A node that stays is smaller than all its
    neighbours, which leave, so every round removes at least half of the nodes
    that have edges: log2(n) rounds at most, and when LAST edges or fewer are
    left, one task ends the matter.  The smallest id never moves.  Nulls and
    self-loops link nothing; nodes without another neighbour are not returned.
    Hubs cost nothing special: the minimum is combined map-side and the joins
    can be split by key.
    """
    lo, hi = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    given = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(lo.alias("lo"), hi.alias("hi"))
    rest = stash(given.mapInArrow(_forest, given.schema).distinct())
    roots, n = None, rest.count()
    while n:
        if n <= LAST:
            step = stash(rest.coalesce(1).mapInArrow(_forest, rest.schema).select(F.col("hi").alias("id"), F.col("lo").alias("root")))
        else:
            both = rest.select(F.col("lo").alias("id"), F.col("hi").alias("near")).unionAll(rest.select(F.col("hi").alias("id"), F.col("lo").alias("near")))
            step = stash(both.groupBy("id").agg(F.min("near").alias("near")).select("id", F.least("id", "near").alias("root")))
        if roots is None:
            roots = step
        else:
            moved = step.select(F.col("id").alias("was"), F.col("root").alias("now"))
            roots = stash(roots.join(moved, F.col("root") == F.col("was"), "left").select("id", F.coalesce("now", "root").alias("root")))
        if n <= LAST:
            break
        to_lo = step.select(F.col("id").alias("lo"), F.col("root").alias("new_lo"))
        to_hi = step.select(F.col("id").alias("hi"), F.col("root").alias("new_hi"))
        moved = rest.join(to_lo, "lo").join(to_hi, "hi").where("new_lo <> new_hi")
        moved = moved.select(F.least("new_lo", "new_hi").alias("lo"), F.greatest("new_lo", "new_hi").alias("hi"))
        rest = stash(moved.mapInArrow(_forest, moved.schema).distinct())
        n = rest.count()
    if roots is None:
        return rest.select(F.col("lo").alias("id"), F.col("hi").alias("component"))
    # The last step names only nodes that move: those that stayed are the roots themselves.
    named = roots.select("id", F.col("root").alias("component"))
    return named.unionAll(named.select(F.col("component").alias("id"), "component")).distinct()


def merged_components(known: DataFrame, added: DataFrame, a: str, b: str) -> DataFrame:
    """(component, now) of the components of `known` (id, component) that new edges join to smaller ones, and of new nodes.

    Edges are lifted to components, so that rounds and shuffles go with the new
    edges and not with what is known; the known labels are read once, to look
    their ends up.  A new node that an edge joins to a smaller one appears as a
    component of its own; a component that is not returned stays as it is.
    """
    edges = stash(added.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("x"), F.col(b).alias("y")))
    ends = edges.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    label = stash(ends.join(known.select("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    one, two = (label.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}")) for c in "xy")
    found = connected_components(edges.join(one, "x").join(two, "y"), "of_x", "of_y")
    return found.select(F.col("id").alias("component"), F.col("component").alias("now")).where("component <> now")


def with_edges(known: DataFrame, added: DataFrame, a: str, b: str) -> DataFrame:
    """`known` (id, component) after new edges, with their new nodes: what `connected_components` of all edges would say."""
    moved = stash(merged_components(known, added, a, b))
    ends = added.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.explode(F.array(a, b)).alias("id")).distinct()
    nodes = known.select("id", "component").unionByName(ends.join(known, "id", "left_anti").select("id", F.col("id").alias("component")))
    return nodes.join(moved, "component", "left").select("id", F.coalesce("now", "component").alias("component"))


def without_edges(known: DataFrame, removed: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """`known` (id, component) after edges went, `edges` being those that are left.

    Only the components that lost an edge are worked out again, from the edges
    that are left in them; an id that has none is a component by itself.
    """
    ends = removed.select(F.explode(F.array(a, b)).alias("id")).distinct()
    torn = stash(known.join(ends, "id", "left_semi").select("component").distinct())
    nodes = stash(known.join(torn, "component", "left_semi").select("id"))
    left = edges.join(nodes.withColumnRenamed("id", a), a, "left_semi")
    again = nodes.join(connected_components(left, a, b), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return known.join(torn, "component", "left_anti").select("id", "component").unionByName(again)
