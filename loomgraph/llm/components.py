"""Problem 3: consolidating pairwise matches into groups.

Connected components by reduction: vertices of degree one are stripped, vertices inside chains (degree two) are spliced out by the
independent-set form of list ranking (a vertex goes when its random priority is below that of its degree-two neighbours, so that a
chain shrinks by a constant share in each round, whatever its length), until neither is left, after a number of rounds in the logarithm of
the graph; the reduced core is solved by alternating large-star and small-star until nothing changes; then labels go back to the removed vertices along their parents, by pointer jumping.

All steps are aggregations and equi-joins of edge tables, written to the shared folder after each round; degrees and lone neighbours
come from map-side counts, minima and maxima, so that a vertex with a third of all edges never meets in one task; joins on such a vertex
are left to the skew handling of adaptive execution.  Nothing but row counts reaches the driver.

Defined cases: null and empty strings are no names; blanks are names as stored; a name of a null book belongs to no book and is left
out; matches of a name with itself, repeated matches, either order, null arrays and rows of one name add nothing.  Empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.frames import cut, uncut

#: Parts book from name in a vertex; a book has no such character.
_SEP = "\x01"


def match_edges(alias_groups: DataFrame, merge_map: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b: a star from the smallest member of each row, and the pairs of the map."""
    names = F.array_distinct(F.filter("members", lambda x: x.isNotNull() & (x != "")))
    g = alias_groups.where("book is not null").select("book", names.alias("m")).where("size(m) >= 2")
    star = g.select("book", F.array_min("m").alias("x"), F.explode("m").alias("y"))
    pair = merge_map.where("book is not null and alias <> '' and canon <> ''").select("book", F.col("alias").alias("x"), F.col("canon").alias("y"))
    v = lambda c: F.concat("book", F.lit(_SEP), c)
    return star.unionByName(pair).where("x <> y").select(v(F.least("x", "y")).alias("a"), v(F.greatest("x", "y")).alias("b")).distinct()


def _degrees(edges: DataFrame) -> DataFrame:
    """(v, d, lo, hi): with one neighbour lo is it, with two lo and hi are they."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("e")).select("e.*")
    return ends.groupBy("v").agg(F.count("*").alias("d"), F.min("u").alias("lo"), F.max("u").alias("hi"))


def _leaves(deg: DataFrame) -> DataFrame:
    """(v, parent) of degree-one vertices; of two that have only each other the greater goes."""
    one = deg.where("d = 1").select("v", F.col("lo").alias("parent"))
    mutual = one.groupBy(F.least("v", "parent").alias("a"), F.greatest("v", "parent").alias("b")).agg(F.count("*").alias("n"), F.max("v").alias("v"), F.min("v").alias("w"))
    return mutual.select("v", F.when(F.col("n") > 1, F.col("a")).when(F.col("v") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("parent"))


def _splices(deg: DataFrame) -> DataFrame:
    """(v, lo, hi) of an independent set of the degree-two vertices that have no degree-one neighbour."""
    two = deg.where("d = 2").select("v", "lo", "hi")
    rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
    near = two.select("v", F.explode(F.array("lo", "hi")).alias("u")).join(deg.where("d <= 2").select(F.col("v").alias("u"), F.col("d").alias("du")), "u", "left")
    blocked = F.coalesce(F.col("du") == 1, F.lit(False)) | (F.coalesce(F.col("du") == 2, F.lit(False)) & (rank("u") < rank("v")))
    free = near.groupBy("v").agg(F.max(blocked.cast("int")).alias("x")).where("x = 0").select("v")
    return two.join(free, "v", "left_semi")


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select(F.col("v").alias("a")), "a", "left_anti").join(gone.select(F.col("v").alias("b")), "b", "left_anti").select("a", "b")


def reduce_graph(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The core's edges, every vertex of which has three neighbours or more, and the (v, parent, hi) tables of the removed vertices, by round."""
    removed: list[DataFrame] = []
    now = cut(edges)
    left = now.count()
    while left:
        deg = cut(_degrees(now))
        gone = cut(_leaves(deg).withColumn("hi", F.lit(None).cast("string")).unionByName(_splices(deg).withColumnRenamed("lo", "parent")))
        uncut(deg)
        if not gone.limit(1).count():
            uncut(gone)
            break
        removed.append(gone)
        short = gone.where("hi is not null").select(F.least("parent", "hi").alias("a"), F.greatest("parent", "hi").alias("b"))
        after = cut(_without(now, gone).unionAll(short).distinct())
        uncut(now)
        now, left = after, after.count()
    return now, removed


def core_labels(edges: DataFrame) -> DataFrame:
    """(v, root) of all vertices of the edges, root the smallest vertex of the component: large-star and small-star until nothing changes."""
    now = cut(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    state = None
    while True:
        # large-star: the greater neighbours of each vertex go to its smallest neighbour or itself
        both = now.select("v", "u").unionAll(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        large = cut(large)
        # small-star: the smaller neighbours and the vertex itself go to the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        small = small.select(F.col("u").alias("v"), F.col("m").alias("u")).unionAll(low.select("v", F.col("m").alias("u"))).where("v <> u").distinct()
        after = cut(small)
        new = after.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        uncut(now, large)
        now = after
        if new == state:
            break
        state = new
    roots = now.select(F.col("u").alias("v")).distinct()
    return now.select("v", F.col("u").alias("root")).unionAll(roots.select("v", F.col("v").alias("root")))


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of the edges (a, b); root is the smallest vertex of its component."""
    core, removed = reduce_graph(edges)
    n = core.count()
    label = core_labels(core) if n else None
    parent = None
    for r in removed:
        up = r.select("v", "parent")
        parent = up if parent is None else parent.unionAll(up)
    if parent is None:
        return edges.select(F.col("a").alias("v"), F.col("a").alias("root"))  # no edges
    if label is not None:
        parent = parent.unionAll(label.select("v", F.col("root").alias("parent")).where("v <> parent"))
    p = cut(parent)
    uncut(core, *removed)
    # Pointer jumping: roots have no row of their own; a parent with none is a root.
    while True:
        up = p.select(F.col("v").alias("parent"), F.col("parent").alias("grand"))
        j = cut(p.join(up, "parent", "left").select("v", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")))
        uncut(p)
        p = j
        if not p.where("moved").limit(1).count():
            break
    p = p.select("v", "parent")
    # The root that pointers lead to need not be the smallest vertex of its component.
    least = p.groupBy("parent").agg(F.min("v").alias("m")).select("parent", F.least("parent", "m").alias("root"))
    members = p.unionAll(p.select(F.col("parent").alias("v"), "parent").distinct())
    return members.join(least, "parent").select("v", "root")


def found(alias_groups: DataFrame, merge_map: DataFrame) -> DataFrame:
    """(book, name, group_name)."""
    c = components(match_edges(alias_groups, merge_map))
    part = lambda v, i: F.split(v, _SEP, 2)[i]
    return c.select(part("v", 0).alias("book"), part("v", 1).alias("name"), part("root", 1).alias("group_name"))


def group_sizes(alias_groups: DataFrame, merge_map: DataFrame) -> DataFrame:
    """(book, group_name, names)."""
    return found(alias_groups, merge_map).groupBy("book", "group_name").agg(F.count("*").alias("names"))
