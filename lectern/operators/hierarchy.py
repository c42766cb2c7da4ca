"""Parent-child links of unknown depth: paths, depths, roots, descendants and cycles.

Everything rests on pointer doubling.  A pointer (node, anc) says that ``anc`` lies 2^k links
above ``node``; joining the pointers with themselves doubles the distance, so a hierarchy of
depth d is settled in log2(d) + 1 rounds.  Pointers carry the piece of path they jump over, and
a join concatenates two pieces.

A round that settles no further node proves that none of the rest can ever be settled: in an
acyclic rest the depths present have no gap.  The rest are thus exactly the nodes on cycles or
below them, and the loop needs no bound guessed from the number of rows.

Nulls and dirt: links with a null end are ignored, as are repeated links.  A self-link is a cycle
of one node.  Empty inputs give empty results with the same columns.  Input columns other than
those named are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import cut, cut_counting, is_empty


def clean_links(links: DataFrame, parent: str = "parent", child: str = "child") -> DataFrame:
    """Distinct (parent, child) pairs without null ends."""
    return (
        links.select(F.col(parent).alias("parent"), F.col(child).alias("child"))
        .where(F.col("parent").isNotNull() & F.col("child").isNotNull())
        .distinct()
    )


def known_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links both of whose ends have a row in ``nodes(node)``."""
    parents = nodes.select(F.col("node").alias("parent"))
    children = nodes.select(F.col("node").alias("child"))
    return links.join(parents, "parent", "left_semi").join(children, "child", "left_semi").select("parent", "child")


def _doubled(pointers: DataFrame) -> tuple[DataFrame, int]:
    """Pointers of twice the length and their number; upward walks that end are dropped."""
    upper = pointers.select(F.col("node").alias("anc"), F.col("anc").alias("upper"))
    longer, seen = cut_counting(pointers.join(upper, "anc").select("node", F.col("upper").alias("anc")).distinct(), rows=F.count(F.lit(1)))
    return longer, seen["rows"]


def unsettled(links: DataFrame) -> DataFrame:
    """The nodes on or below a cycle, with those of their pointers that never end.

    ``links`` must be clean.  Columns (node, anc): after the last round ``anc`` ranges over the
    nodes reached by upward walks of one and the same length, longer than any path in what is settled.
    """
    pointers, seen = cut_counting(links.select(F.col("child").alias("node"), F.col("parent").alias("anc")), rows=F.count(F.lit(1)))
    rows, nodes = seen["rows"], None
    while rows:
        # A node whose every upward walk ends has no pointer left.
        before = rows
        pointers, rows = _doubled(pointers)
        # Nodes are counted only where few pointers went, and compared with the round before.
        left = pointers.select("node").distinct().count() if rows > 0.8 * before else None
        if left is not None and left == nodes:
            break
        nodes = left
    return pointers


def _far_ends(pointers: DataFrame) -> DataFrame:
    """The nodes at which upward walks of any length can end, from the pointers of ``unsettled``.

    The ends of walks of length m + 1 are among those of length m, and once two lengths have the
    same ends all greater lengths have; so doubling stops when the number of ends stays.
    """
    before = pointers.select("anc").distinct().count()
    while True:
        pointers, _ = _doubled(pointers)
        ends = pointers.select(F.col("anc").alias("node")).distinct()
        number = ends.count()
        if number == before:
            return ends
        before = number


def spoilt_by_cycles(links: DataFrame) -> DataFrame:
    """(node, finding): ``on_cycle`` or ``below_cycle``, for every node that a cycle spoils.

    Unsettled nodes come from pointer doubling.  Doubling on, the pointers' far ends are the nodes
    on cycles and those on links from one cycle to another; of these the nodes on cycles are the
    ones that reach themselves.  Both steps double, so their rounds are logarithmic in the longest
    way round a cycle, and the pairs held are among those that ``reachable`` returns.
    """
    pointers = unsettled(links)
    if is_empty(pointers):
        return links.select(F.col("child").alias("node"), F.lit("on_cycle").alias("finding")).limit(0)
    spoilt = pointers.select("node").distinct()
    ends = _far_ends(pointers)
    among = links.join(ends.withColumnRenamed("node", "parent"), "parent", "left_semi").join(
        ends.withColumnRenamed("node", "child"), "child", "left_semi"
    )
    loops = among.where("parent = child").select(F.col("parent").alias("node"))
    pairs = reachable(among)
    mutual = pairs.select("node", "descendant").join(pairs.select(F.col("descendant").alias("node"), F.col("node").alias("descendant")), ["node", "descendant"], "left_semi")
    on_cycle = loops.unionByName(mutual.select("node")).distinct()
    return spoilt.join(on_cycle.withColumn("hit", F.lit(True)), "node", "left").select(
        "node", F.when(F.col("hit"), "on_cycle").otherwise("below_cycle").alias("finding")
    )


def full_paths(nodes: DataFrame, links: DataFrame, barred: DataFrame) -> DataFrame:
    """Every path from a root down to each node that leads through no node of ``barred(node)``.

    ``nodes(node, label)``; columns out: node, root, depth (root = 0), path (node ids) and labels,
    from the root to the node itself.  A node with several parents has one row for each path; one
    that only barred nodes lead to has none.  What is left of the links must be free of cycles, as
    it is where the nodes on cycles, or all spoilt nodes, are barred.
    """
    allowed = nodes.join(barred.select("node"), "node", "left_anti")
    ids = allowed.select("node")
    usable = links.join(ids.withColumnRenamed("node", "child"), "child", "left_semi").join(ids.withColumnRenamed("node", "parent"), "parent", "left_semi")
    roots = allowed.join(links.select(F.col("child").alias("node")).distinct(), "node", "left_anti").withColumn("anc", F.lit(None).cast(allowed.schema["node"].dataType))
    below = allowed.join(usable.select(F.col("child").alias("node"), F.col("parent").alias("anc")), "node")
    start = roots.select("node", "anc", "label").unionByName(below.select("node", "anc", "label"))
    open_ones = F.count("anc")
    state, seen = cut_counting(start.select("node", "anc", F.array("node").alias("path"), F.array(F.coalesce("label", F.lit(""))).alias("labels")), open=open_ones)
    while seen["open"]:
        upper = state.select(
            F.col("node").alias("anc"), F.col("anc").alias("up"), F.col("path").alias("above"), F.col("labels").alias("titles")
        )
        jumped = (
            state.where("anc is not null")
            .join(upper, "anc")
            .select("node", F.col("up").alias("anc"), F.concat("above", "path").alias("path"), F.concat("titles", "labels").alias("labels"))
        )
        state, seen = cut_counting(state.where("anc is null").unionByName(jumped), open=open_ones)
    return state.select("node", F.col("path")[0].alias("root"), (F.size("path") - 1).alias("depth"), "path", "labels")


def descendants(paths: DataFrame) -> DataFrame:
    """(node, descendant, distance): each node of ``full_paths`` with everything below it, the
    shortest distance where several paths lead there.  A generator over the paths: no join."""
    steps = paths.select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "node"))
    return (
        steps.where("node <> descendant").groupBy("node", "descendant").agg(F.min(F.col("depth") - F.col("at")).alias("distance"))
    )


def reachable(links: DataFrame) -> DataFrame:
    """(node, descendant, distance): every node with everything below it, by the fewest links.

    ``links`` must be clean.  Cycles break nothing here: nodes on or below them have their rows
    like all others, only that no node is its own descendant.  A shortest path of more than 2^k
    links starts with one of exactly 2^k links, so each round joins just those pairs with all the
    pairs known, and no such pair left means that all are found.
    """
    count = {"most": F.max("distance")}
    first = links.where("parent <> child").select(F.col("parent").alias("node"), F.col("child").alias("descendant"), F.lit(1).alias("distance"))
    pairs, seen = cut_counting(first, **count)
    length = 1
    while seen["most"] == length:
        edge = pairs.where(F.col("distance") == length)
        onward = pairs.select(F.col("node").alias("descendant"), F.col("descendant").alias("far"), F.col("distance").alias("more"))
        further = edge.join(onward, "descendant").where("node <> far").select("node", F.col("far").alias("descendant"), (F.col("distance") + F.col("more")).alias("distance"))
        pairs, seen = cut_counting(pairs.unionByName(further).groupBy("node", "descendant").agg(F.min("distance").alias("distance")), **count)
        length *= 2
    return pairs


def longest(links: DataFrame) -> DataFrame:
    """(node, descendant, distance): as ``reachable``, by the most links; ``links`` must be free of cycles.

    Pairs are squared until no distance grows, so the rounds are logarithmic in the depth."""
    count = {"sum": F.sum("distance")}
    pairs, seen = cut_counting(links.select(F.col("parent").alias("node"), F.col("child").alias("descendant"), F.lit(1).alias("distance")), **count)
    before = None
    while seen["sum"] != before:
        before = seen["sum"]
        onward = pairs.select(F.col("node").alias("descendant"), F.col("descendant").alias("far"), F.col("distance").alias("more"))
        further = pairs.join(onward, "descendant").select("node", F.col("far").alias("descendant"), (F.col("distance") + F.col("more")).alias("distance"))
        pairs, seen = cut_counting(pairs.unionByName(further).groupBy("node", "descendant").agg(F.max("distance").alias("distance")), **count)
    return pairs


def levels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, level): the order in which what is built of others can be built, 0 for what has no children;
    null for what lies on a cycle or above one, which can never be built."""
    turned = links.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    never = cut(spoilt_by_cycles(turned).select("node"))
    sound = links.join(never.withColumnRenamed("node", "parent"), "parent", "left_anti")
    deep = longest(sound).groupBy("node").agg(F.max("distance").alias("deep"))
    known = nodes.select("node").join(deep, "node", "left").join(never.withColumn("never", F.lit(True)), "node", "left")
    return known.select("node", F.when(F.col("never"), None).otherwise(F.coalesce("deep", F.lit(0))).alias("level"))


def squeeze(column):
    """Trimmed text with each run of white space, the ideographic space included, made one space."""
    return F.trim(F.regexp_replace(column, r"[\s\p{Z}\x{85}]+", " "))
