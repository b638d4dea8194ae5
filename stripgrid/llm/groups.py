"""Links between rows that share buckets, and connected groups of links - both without all pairs of a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stripgrid.functions.lineage import cut_lineage
from stripgrid.llm.common import stored

SMALL = 32
MOST_PIVOTS = 62  # a bit of a long each
BLOCK_NODES, BLOCK_SIZE = 512, 2**20


def linked_pairs(
    members: DataFrame,
    values: Callable[[DataFrame], DataFrame],
    apart: Callable[[Column, Column], Column],
    distance: Callable[[Column, Column], Column],
    reach: float,
    small: int = SMALL,
) -> DataFrame:
    """Pairs (a, b) that connect all nodes that share a bucket and lie within reach of each other, and no others.

    ``members``: distinct (bucket, node, size, n) with n > 1 nodes in the bucket. ``values`` adds ``value`` to nodes that are to be measured.
    ``distance`` of two structs (size, value) must be a metric, exact up to 2 x reach, and above that any number over 2 x reach;
    ``apart`` of two sizes is a bound from below. In a bucket of at most ``small`` nodes every pair is
    measured. In a larger one all nodes are measured against a pivot, its smallest node, then
    against up to ``small`` pivots at once, then ``MOST_PIVOTS``; pivots leave after their round. A node has its pivots beside it in one array,
    so a round has a row for each member and not for each measured pair. Nodes that links of their bucket
    connect form a class, and a pair for each node and its class is handed on. A node leaves if no node of another class can be within its reach: by the
    triangle inequality, when its distance to a linked pivot plus the reach is less than the distance of each node outside the pivot's class.
    A bucket of one class is settled. So two nodes within reach are in the same connected group of the pairs whatever the
    bucket sizes, while a bucket of n near copies costs about n distances a pivot and not n * n / 2. Half of the pivots are
    drawn by class, so that the nodes still apart are measured first.
    """

    def inner(few: DataFrame) -> DataFrame:
        sides = [few.select("bucket", F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("label").alias(f"label_{x}")) for x in "ab"]
        both = sides[0].join(sides[1], "bucket").where("a < b and label_a != label_b")
        return both.where(apart(F.col("size_a"), F.col("size_b")) <= reach).select("a", "b", "size_a", "size_b").distinct()

    def near(pairs: DataFrame) -> DataFrame:
        for x in "ab":
            pairs = pairs.join(known.select(F.col("node").alias(x), F.col("value").alias(f"value_{x}")), x)
        sides = [F.struct(F.col(f"size_{x}").alias("size"), F.col(f"value_{x}").alias("value")) for x in "ab"]
        return pairs.where(distance(*sides) <= reach).select("a", "b")

    members = stored(members.select("bucket", "node", "size", "n", F.col("node").alias("label")))
    pairs = stored(inner(members.where(F.col("n") <= small)))
    members = members.where(F.col("n") > small).select("bucket", "node", "size", "label")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.select("node"))
    known = stored(values(wanted.distinct()))
    links, pivots, turn = stored(near(pairs)), 1, 0
    while not members.isEmpty():
        by_label, half = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0, F.lit((pivots + 1) // 2)
        draw = F.when(by_label, F.pmod(F.xxhash64("label"), half)).otherwise(F.lit(pivots // 2) + F.pmod(F.xxhash64("node"), half))
        drawn = members.groupBy("bucket", draw.alias("draw")).agg(
            F.min(F.struct("node", "size")).alias("pivot"), F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")
        )
        drawn = drawn.withColumn("node", F.col("pivot.node")).join(known, "node")
        pivot = F.struct("node", F.col("pivot.size").alias("size"), "value")
        shapes = drawn.groupBy("bucket").agg(
            F.sum("n").alias("n"), (F.min("low") != F.max("high")).alias("mixed"), F.sort_array(F.collect_list(pivot)).alias("pivots")
        )
        shapes = stored(shapes.where("mixed").select("bucket", "n", "pivots"))
        if turn:  # buckets that have become small
            few = shapes.where(F.col("n") <= small).select("bucket")
            links = links.unionByName(stored(near(inner(members.join(few, "bucket")))))
        crowded = shapes.where(F.col("n") > small).drop("n")
        turn += 1
        members, found = _unsettled(members.join(known, "node").join(crowded, "bucket"), distance, reach, pivots, turn)
        links, pivots = links.unionByName(found), small if pivots == 1 else MOST_PIVOTS
    return links


def _unsettled(
    crowded: DataFrame, distance: Callable[[Column, Column], Column], reach: float, pivots: int, turn: int
) -> tuple[DataFrame, DataFrame]:
    """(bucket, node, size, label) of nodes that may still be within reach of a node of another class of their bucket, and pairs
    (a, b) of a node of each label with a pivot of its class.

    Per bucket: a bit per pivot says which labels are linked to it, and closing these sets over each other gives the
    classes. All that a bucket's nodes share is sums of fixed size (``pivots`` masks, ``pivots`` distances).
    """
    far = F.transform("pivots", lambda p: distance(F.struct("size", "value"), p))
    seen = crowded.select("bucket", "node", "size", "label", F.array_contains("pivots.node", F.col("node")).alias("is_pivot"), F.col("pivots.node").alias("pivots"), far.alias("far"))
    bits = F.transform("far", lambda d, i: F.when(d <= reach, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    mask = F.aggregate(bits, F.lit(0).cast("long"), lambda m, bit: m.bitwiseOR(bit))
    seen = stored(seen.withColumn("mask", mask))
    labels = cut_lineage(seen.groupBy("bucket", "label").agg(F.bit_or("mask").alias("mask"), F.min(F.struct("node", "pivots")).alias("least")))
    touching = [F.coalesce(F.bit_or(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.col("mask"))), F.lit(0).cast("long")) for i in range(pivots)]
    # Warshall: rows that reach pivot k reach all that k reaches.
    closed = F.expr(
        f"aggregate(sequence(0, {pivots - 1}), touching, (rows, k) -> "
        "transform(rows, r -> if((r & shiftleft(1L, k)) != 0, r | rows[k], r)))"
    )
    closed = labels.groupBy("bucket").agg(F.array(*touching).alias("touching")).select("bucket", closed.alias("closed"))
    closed = cut_lineage(closed)
    own = F.expr("get(filter(closed, r -> (r & mask) != 0), 0)")
    classes = stored(labels.join(closed, "bucket").select("bucket", "label", "least", F.coalesce(own, F.lit(0).cast("long")).alias("class")))
    chief = F.expr("get(least.pivots, bit_count((class & -class) - 1))")  # the pivot of the lowest bit
    links = classes.where(F.col("class") != 0).select(F.col("least.node").alias("a"), chief.alias("b")).where("a != b")
    named = seen.join(classes.drop("least"), ["bucket", "label"])
    outside = [
        F.min(F.when(~F.col("is_pivot") & (F.col("class").bitwiseAND(F.lit(1 << i)) == 0), F.get("far", F.lit(i)))) for i in range(pivots)
    ]
    beyond = cut_lineage(named.groupBy("bucket").agg(F.array(*outside).alias("beyond")))
    free = F.expr(
        f"exists(sequence(0, size(far) - 1), i -> far[i] <= {reach!r} and (beyond[i] is null or far[i] + {reach!r} < beyond[i]))"
    )
    # Labels of the classes of one round differ from those of other rounds and (but for 64-bit chance) from nodes.
    label = F.when(F.col("class") == 0, F.col("label")).otherwise(F.xxhash64("bucket", "class", F.lit(turn)))
    rest = named.join(beyond, "bucket").where(~F.col("is_pivot") & ~free)
    return stored(rest.select("bucket", "node", "size", label.alias("label"))), links


def crowds(members: DataFrame, sizes: DataFrame, small: int = SMALL) -> tuple[DataFrame, DataFrame | None]:
    """Every pair of nodes that share a bucket, once: in pairs of blocks (unit, only, low, high, node, is_low), or as rows (a, b).

    ``members``: distinct (bucket, node) of buckets with two nodes or more; ``sizes``: (node, size). Nodes connected by buckets are
    one unit, all of whose pairs are looked at, unless the buckets one by one hold fewer pairs. Then the nodes that are connected by buckets of more than ``small``
    nodes are a unit (again unless their buckets one by one hold fewer pairs; each is a unit then and ``only`` is that bucket, as
    two nodes may meet in several), and the pairs of the other buckets are rows. A unit is cut in blocks of
    about ``BLOCK_NODES`` nodes and ``BLOCK_SIZE`` of size, and each node goes to all pairs of its block with another.
    """
    groups = stored(components(_stars(members)))
    units, split = _units(members, groups, sizes, small)
    rest, pairs = stored(members.join(groups, "node").join(split.select("component").distinct(), "component").select("bucket", "node")), None
    if not rest.isEmpty():
        counted = cut_lineage(rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
        groups = stored(components(_stars(rest.join(counted.where(F.col("n") > small), "bucket"))))
        whole, split = _units(rest, groups, sizes, small)
        several = rest.join(groups, "node").join(split, ["component", "bucket"])
        several = several.select(F.xxhash64("component", "bucket").alias("unit"), F.col("bucket").alias("only"), "node", "cuts")
        units = units.unionByName(whole).unionByName(several)
        few = rest.join(counted.where(F.col("n") <= small), "bucket").join(groups, "node", "left")
        sides = [few.select("bucket", F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in "ab"]
        pairs = sides[0].join(sides[1], "bucket").where("a < b and not (of_a <=> of_b and of_a is not null)").select("a", "b").distinct()
    units = units.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("cuts")).cast("int"))
    units = units.withColumn("other", F.explode(F.expr("sequence(0, cuts - 1)")))
    ends = {"low": F.least("block", "other"), "high": F.greatest("block", "other"), "is_low": F.col("block") <= F.col("other")}
    return stored(units.withColumns(ends).select("unit", "only", "low", "high", "node", "is_low")), pairs


def _stars(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of a bucket's smallest node and each of its nodes."""
    least = members.groupBy("bucket").agg(F.min("node").alias("a"))
    return members.join(least, "bucket").select("a", F.col("node").alias("b"))


def _units(members: DataFrame, groups: DataFrame, sizes: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (unit, only, node, cuts) of the groups to be taken whole, and the buckets (component, bucket, cuts) of the others."""
    placed = members.join(groups, "node").join(sizes, "node")
    parts = cut_lineage(placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")))
    spread = parts.groupBy("component").agg(F.sum(F.col("n") * F.col("n")).alias("spread"))
    whole = groups.join(sizes, "node").groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    fits = (F.col("n") <= small) | (F.col("n") * F.col("n") <= F.col("spread"))
    chosen = cut_lineage(whole.join(spread, "component").withColumn("whole", fits))
    cuts = F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("size") / BLOCK_SIZE)).cast("int").alias("cuts")
    one = groups.join(chosen.where("whole").select("component", cuts), "component")
    one = one.select(F.col("component").alias("unit"), F.lit(None).cast("long").alias("only"), "node", "cuts")
    split = parts.where("n > 1").join(chosen.where("not whole").select("component"), "component")
    return one, split.select("component", "bucket", cuts)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of the links (a, b); a component is named by its smallest node.

    Alternating large-star and small-star steps: each node hands its neighbours the smallest node it knows. Steps are
    joins and minima on the links, partial minima come first, and the number of rounds grows with the logarithm of the
    longest chain.
    """
    both = links.select("a", "b").where("a != b")
    edges = stored(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("of"), F.least("a", "least").alias("least"))
        large = around.join(least, F.col("a") == F.col("of")).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("least")).withColumnRenamed("a", "of")
        small = large.join(down, F.col("a") == F.col("of")).where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = stored(small.unionByName(down.select(F.col("of").alias("a"), F.col("least").alias("b"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
