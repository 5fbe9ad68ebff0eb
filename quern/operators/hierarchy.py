"""Trees from parent links as nested-set ranges (general problem 5).

Upward: pointers double, and in each round every node hands its size so far to
the node its pointer names, so after k rounds a node knows how many nodes lie
less than 2^k below it. Downward: siblings get disjoint preorder offsets by
prefix sums of their sizes, and doubled pointers add the offsets up along the
way to the root. Both take as many rounds as the logarithm of the depth, for a
chain of 100,000 nodes 18. Nodes whose pointer never runs off a root lie on
or below a cycle: when a round frees no node, none of those left is in a tree,
for a deeper node would have had an ancestor to free.

Descendants of v are the nodes of the same root with preorder in (lft, rgt],
its ancestors those whose range holds lft. Ranges are cut into aligned blocks
for an equi-join that meets results only, so one large tree is spread too.

A parent with very many children never meets in one task: sizes are summed
before the shuffle, offsets per bucket of children.

Defined results: of repeated ids the row with the greatest version counts
(ties: the greatest parent, null lowest); a null id is dropped; a null, empty
or unknown parent makes a root; a session that is its own parent is a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.checkpoints import cut, release

TREE, ON_CYCLE, BELOW_CYCLE = "tree", "on_cycle", "below_cycle"
BUCKETS = 64


def latest_links(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id", version_col: str = "time_updated") -> DataFrame:
    """(id, parent): one row per id, parent null for roots."""
    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), F.col(version_col).alias("v"))
    one = rows.groupBy("id").agg(F.max(F.struct("v", "parent")).alias("r")).select("id", F.when(F.col("r.parent") != "", F.col("r.parent")).alias("parent"))
    ids = one.select(F.col("id").alias("known"))
    return one.join(ids, one.parent == ids.known, "left").select("id", F.col("known").alias("parent"))


def _jump(hops: DataFrame, fields: list[str], joined: dict) -> DataFrame:
    """Each row with a pointer takes over that of the row it points at; joined gives the other columns from t_ ones.

    Rows without a pointer (most, after a few rounds) stay out of the join, whose null keys would meet in one task.
    """
    target = hops.select(F.col("id").alias("t"), *[F.col(c).alias(f"t_{c}") for c in ["up", *fields]])
    moving = hops.filter(F.col("up").isNotNull())
    moved = moving.join(target, moving.up == target.t).select("id", F.col("t_up").alias("up"), *[joined[c].alias(c) for c in fields])
    return hops.filter(F.col("up").isNull()).select("id", "up", *fields).unionByName(moved)


def subtree_sizes(links: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """(sizes, left, rounds): sizes(id, size) of the nodes of trees; left(id, parent) those on or below a cycle, None if there are none; rounds that free all of the former."""
    hops = cut(links.select("id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size")))
    before, rounds = -1, 0
    while (waiting := hops.filter(F.col("up").isNotNull()).count()) not in (0, before):
        before, rounds = waiting, rounds + 1
        handed = hops.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("more"))
        moved = _jump(hops, ["size"], {"size": F.col("size")})
        last, hops = hops, cut(moved.join(handed, "id", "left").select("id", "up", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        release(last)
    if not waiting:
        return hops.select("id", "size"), None, rounds
    # The last round freed nobody.
    return hops.filter(F.col("up").isNull()).select("id", "size"), cut(links.join(hops.filter(F.col("up").isNotNull()).select("id"), "id", "left_semi")), rounds - 1


def on_cycles(left: DataFrame) -> DataFrame:
    """ids of the nodes that are their own ancestors, of links that never reach a root.

    Those that some node's doubled pointer names; when a round makes them no fewer, no node of a tail is left.
    """
    hops, before = left.select("id", F.col("parent").alias("up")), -1
    while True:
        named = cut(hops.select(F.col("up").alias("id")).distinct())
        if (n := named.count()) == before:
            return named
        before = n
        hops = cut(_jump(hops, [], {}))


def sibling_offsets(sized: DataFrame) -> DataFrame:
    """sized with step: 1 plus the sizes of the siblings before it (0 for roots)."""
    b = F.pmod(F.hash("id"), F.lit(BUCKETS))
    inner = Window.partitionBy("parent", "b").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("parent").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.filter(F.col("parent").isNotNull()).withColumn("b", b)
    before = rows.groupBy("parent", "b").agg(F.sum("size").alias("total")).withColumn("before", F.coalesce(F.sum("total").over(outer), F.lit(0))).drop("total")
    inside = rows.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    placed = inside.join(before, ["parent", "b"]).select("id", "parent", "size", (F.col("before") + F.col("inside") + 1).alias("step"))
    roots = sized.filter(F.col("parent").isNull()).select("id", "parent", "size", F.lit(0).cast("long").alias("step"))
    return placed.unionByName(roots)


def nested_sets(links: DataFrame) -> DataFrame:
    """One row per node: id, state, root_id, depth, path, lft, rgt, descendants.

    lft and rgt are preorder places within the root's tree; nodes on or below a
    cycle have root_id and path '', depth -1 and null places.
    """
    links = cut(links)
    sizes, left, rounds = subtree_sizes(links)
    placed = sibling_offsets(cut(links.join(sizes, "id")))
    child = F.col("parent").isNotNull()
    hops = cut(placed.select("id", F.col("parent").alias("up"), "size", "step", F.when(child, 1).otherwise(0).alias("depth"), F.col("id").alias("path"), F.coalesce("parent", "id").alias("root_id")))
    add = lambda c: F.col(c) + F.col(f"t_{c}")
    for _ in range(rounds):
        last, hops = hops, cut(_jump(hops, ["size", "step", "depth", "path", "root_id"], {"size": F.col("size"), "step": add("step"), "depth": add("depth"), "path": F.concat_ws("/", "t_path", "path"), "root_id": F.col("t_root_id")}))
        release(last)
    trees = hops.select("id", F.lit(TREE).alias("state"), "root_id", F.col("depth").cast("int").alias("depth"), "path", F.col("step").alias("lft"), (F.col("step") + F.col("size") - 1).alias("rgt"), (F.col("size") - 1).alias("descendants"))
    if left is None:
        return trees
    none = F.lit(None).cast("long")
    cyclic = left.join(on_cycles(left).withColumn("own", F.lit(True)), "id", "left").select(
        "id", F.when(F.col("own"), F.lit(ON_CYCLE)).otherwise(F.lit(BELOW_CYCLE)).alias("state"), F.lit("").alias("root_id"), F.lit(-1).alias("depth"), F.lit("").alias("path"), none.alias("lft"), none.alias("rgt"), none.alias("descendants"),
    )
    return trees.unionByName(cyclic)


#: Bits by which an aligned block grows from level to level.
BITS = 4
#: The aligned blocks (level, block) that make up the range from lo to hi: at each level those that no larger one within the range holds.
_BLOCKS = f"""
flatten(transform(sequence(0, top), l -> transform(
  CASE WHEN (lo + shiftleft(1L, {BITS} * l) - 1) DIV shiftleft(1L, {BITS} * l) > (hi + 1) DIV shiftleft(1L, {BITS} * l) - 1 THEN array()
       WHEN (lo + shiftleft(1L, {BITS} * (l + 1)) - 1) DIV shiftleft(1L, {BITS} * (l + 1)) > (hi + 1) DIV shiftleft(1L, {BITS} * (l + 1)) - 1
       THEN sequence((lo + shiftleft(1L, {BITS} * l) - 1) DIV shiftleft(1L, {BITS} * l), (hi + 1) DIV shiftleft(1L, {BITS} * l) - 1)
       ELSE filter(sequence((lo + shiftleft(1L, {BITS} * l) - 1) DIV shiftleft(1L, {BITS} * l), shiftleft((lo + shiftleft(1L, {BITS} * (l + 1)) - 1) DIV shiftleft(1L, {BITS} * (l + 1)), {BITS})), b -> b < shiftleft((lo + shiftleft(1L, {BITS} * (l + 1)) - 1) DIV shiftleft(1L, {BITS} * (l + 1)), {BITS}))
         || filter(sequence(shiftleft((hi + 1) DIV shiftleft(1L, {BITS} * (l + 1)), {BITS}) - 1, (hi + 1) DIV shiftleft(1L, {BITS} * l) - 1), b -> b >= shiftleft((hi + 1) DIV shiftleft(1L, {BITS} * (l + 1)), {BITS}))
  END, b -> struct(l AS level, b AS block))))
"""


def contained(ranges: DataFrame, points: DataFrame) -> DataFrame:
    """ranges(root_id, lo, hi, ..) with the points(root_id, at, ..) that they hold.

    A range of any length is at most 30 blocks a level, a point one; pairs that don't belong together never meet.
    """
    longest = ranges.agg(F.max(F.col("hi") - F.col("lo") + 1)).first()[0] or 1
    top = (int(longest).bit_length() - 1) // BITS
    cutting = ranges.filter("lo <= hi").withColumn("top", F.lit(top)).withColumn("b", F.explode(F.expr(_BLOCKS))).select("*", "b.level", "b.block").drop("b", "top", "lo", "hi")
    placed = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("block", F.expr(f"shiftright(at, {BITS} * level)")).drop("at")
    return placed.join(cutting, ["root_id", "level", "block"]).drop("level", "block")


def descendants(nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(ancestor, descendant, steps) of the nodes named in of(id), else of all."""
    trees = nodes.filter(F.col("state") == TREE)
    asked = trees if of is None else trees.join(of.select("id").distinct(), "id", "left_semi")
    ranges = asked.filter("descendants > 0").select("root_id", F.col("id").alias("ancestor"), F.col("depth").alias("a_depth"), (F.col("lft") + 1).alias("lo"), F.col("rgt").alias("hi"))
    return contained(ranges, trees.select("root_id", F.col("lft").alias("at"), F.col("id").alias("descendant"), "depth")).select("ancestor", "descendant", (F.col("depth") - F.col("a_depth")).alias("steps"))


def ancestors(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """(descendant, ancestor, steps) of the nodes named in of(id)."""
    trees = nodes.filter(F.col("state") == TREE)
    points = trees.join(of.select("id").distinct(), "id", "left_semi").select("root_id", F.col("lft").alias("at"), F.col("id").alias("descendant"), "depth")
    ranges = trees.filter("descendants > 0").select("root_id", F.col("id").alias("ancestor"), F.col("depth").alias("a_depth"), (F.col("lft") + 1).alias("lo"), F.col("rgt").alias("hi"))
    return contained(ranges, points).select("descendant", "ancestor", (F.col("depth") - F.col("a_depth")).alias("steps"))
