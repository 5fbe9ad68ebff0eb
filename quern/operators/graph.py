"""Property-graph queries as rounds of joins.

A traversal is level-synchronous: each round joins the frontier with the edges
and drops what was seen before; lineage is cut per round in the shared
checkpoint folder. Nodes at distance k are exact, so the result doesn't depend
on the order of visits (depth-first variants give the same sets).
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.checkpoints import cut

DEPENDENT = ("calls", "references", "imports")


def priority(kind: Column) -> Column:
    return F.when(kind == "contains", 0).when(kind == "calls", 1).otherwise(2)


def adjacency(edges: DataFrame, direction: str, kinds: list[str] | None = None) -> DataFrame:
    """src, dst, kind along the direction: out, in or both."""
    if kinds:
        edges = edges.filter(F.col("kind").isin(*kinds))
    out = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), "kind")
    back = edges.select(F.col("target").alias("src"), F.col("source").alias("dst"), "kind")
    return out if direction == "out" else back if direction == "in" else out.unionByName(back)


class Levels:
    """The levels of a traversal as separate frames, so that a level costs its own rows; every COMPACT of them become one."""

    COMPACT = 12

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def add(self, level: DataFrame) -> None:
        self.parts.append(level)
        if len(self.parts) > self.COMPACT:
            self.parts = [cut(self.union())]

    def union(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


def bfs(edges: DataFrame, starts: DataFrame, depth: int | None = None, direction: str = "out", kinds: list[str] | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """id, depth, parent, kind of the nodes within depth (else at any) of starts(id); the tree edge is that of the first kind, then the least parent."""
    links = adjacency(edges, direction, kinds)
    if allowed is not None:
        links = links.join(allowed.select(F.col("id").alias("dst")), "dst", "left_semi")
    if depth is None or depth > 1:  # the links are read once per level
        links = cut(links)
    none = F.lit(None).cast("string")
    frontier = cut(starts.select("id").distinct().select("id", F.lit(0).alias("depth"), none.alias("parent"), none.alias("kind")))
    levels = Levels(frontier)
    for level in count(1) if depth is None else range(1, depth + 1):
        seen = levels.union()
        step = frontier.select(F.col("id").alias("src")).join(links, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct(priority(F.col("kind")).alias("p"), "src", "kind")).alias("e"))
        frontier = cut(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(level).alias("depth"), F.col("e.src").alias("parent"), F.col("e.kind").alias("kind")))
        if frontier.isEmpty():
            break
        levels.add(frontier)
    return levels.union()


def callers(edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    return bfs(edges, starts, depth, "in", list(DEPENDENT)).filter("depth > 0")


def callees(edges: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    return bfs(edges, starts, depth, "out", list(DEPENDENT)).filter("depth > 0")


def call_graph(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Callers, callees and the focal nodes, each once, with the side they are on."""
    up = callers(edges, starts, depth).select("id", F.lit("caller").alias("side"))
    down = callees(edges, starts, depth).select("id", F.lit("callee").alias("side"))
    return up.unionByName(down).unionByName(starts.select("id", F.lit("focal").alias("side"))).distinct()


def impact_radius(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int, containers: list[str]) -> DataFrame:
    """id, depth of what depends on the starts; members of a container cost no depth."""
    edges = cut(edges.select("source", "target", "kind"))
    back = adjacency(edges, "in")
    members = edges.filter("kind = 'contains'").join(nodes.filter(F.col("kind").isin(*containers)).select(F.col("id").alias("source")), "source", "left_semi").select(F.col("source").alias("src"), F.col("target").alias("dst"))

    def closed(level: DataFrame, seen: DataFrame, at: int) -> DataFrame:
        """The level with the members of its containers, at any depth of nesting."""
        whole, fresh = level, level
        while True:
            fresh = cut(fresh.select(F.col("id").alias("src")).join(members, "src").select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").join(whole.select("id"), "id", "left_anti").select("id", F.lit(at).alias("depth")))
            if fresh.isEmpty():
                return whole
            whole = cut(whole.unionByName(fresh))

    first = cut(starts.select("id", F.lit(0).alias("depth")))
    frontier = closed(first, first.limit(0), 0)
    levels = Levels(frontier)
    for level in range(1, depth + 1):
        seen = levels.union()
        step = frontier.select(F.col("id").alias("src")).join(back.select("src", "dst"), "src").select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").select("id", F.lit(level).alias("depth"))
        frontier = closed(cut(step), seen, level)
        if frontier.isEmpty():
            break
        levels.add(frontier)
    return levels.union()


def ancestors(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """start, id, depth: the chain of containers above each start, by the least container of a node; loops end at their first repeat."""
    parent = cut(edges.filter("kind = 'contains'").groupBy(F.col("target").alias("child")).agg(F.min("source").alias("up")))
    chain = cut(starts.select(F.col("id").alias("start"), F.col("id").alias("at"), F.array("id").alias("path")))
    out, depth = None, 0
    while True:
        depth += 1
        chain = cut(chain.join(parent, chain.at == parent.child).filter(~F.array_contains("path", F.col("up"))).select("start", F.col("up").alias("at"), F.concat("path", F.array("up")).alias("path")))
        if chain.isEmpty():
            break
        level = chain.select("start", F.col("at").alias("id"), F.lit(depth).alias("depth"))
        out = level if out is None else out.unionByName(level)
    return out if out is not None else starts.limit(0).select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"))


def shortest_path(edges: DataFrame, start: str, goal: str, limit: int | None = None, kinds: list[str] | None = None) -> DataFrame:
    """step, id of a shortest directed path, empty if there is none (within limit, if given); of equal ones that of the least parents."""
    spark = edges.sparkSession
    links = cut(adjacency(edges, "out", kinds))
    frontier = cut(spark.createDataFrame([(start, 0, None)], "id string, depth int, parent string"))
    levels, level, found = Levels(frontier), 0, start == goal
    while not found and (limit is None or level < limit):
        level += 1
        seen = levels.union()
        step = frontier.select(F.col("id").alias("src")).join(links, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        frontier = cut(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(level).alias("depth"), "parent"))
        if frontier.isEmpty():
            break
        found = not frontier.filter(F.col("id") == goal).isEmpty()
        levels.add(frontier)
    seen = levels.union()
    if not found:
        return seen.limit(0).select(F.lit(0).alias("step"), "id")
    # Back from the goal, one row per step.
    path, at = [(level, goal)], goal
    for depth in range(level, 0, -1):
        at = seen.filter((F.col("depth") == depth) & (F.col("id") == at)).first()["parent"]
        path.append((depth - 1, at))
    return spark.createDataFrame(path, "step int, id string")


def type_hierarchy(edges: DataFrame, starts: DataFrame, kinds: list[str], limit: int | None = None) -> DataFrame:
    """id, side of the types above and below the starts, at any distance unless limited."""
    up = bfs(edges, starts, limit, "out", kinds).filter("depth > 0").select("id", F.lit("above").alias("side"))
    down = bfs(edges, starts, limit, "in", kinds).filter("depth > 0").select("id", F.lit("below").alias("side"))
    return up.unionByName(down)


def file_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """from_file, to_file of the edges that aren't containment, within no file itself."""
    at = nodes.select("id", "file_path")
    used = edges.filter("kind <> 'contains'")
    a = used.join(at.select(F.col("id").alias("source"), F.col("file_path").alias("from_file")), "source")
    return a.join(at.select(F.col("id").alias("target"), F.col("file_path").alias("to_file")), "target").filter("from_file <> to_file").select("from_file", "to_file").distinct()


def simple_cycles(links: DataFrame, longest: int | None = None) -> DataFrame:
    """cycle: the nodes of each directed cycle of links(src, dst), from its least node on; longest bounds their length where it is given."""
    links = cut(links.select("src", "dst").distinct())
    # A path starts at its least node, so that each cycle is found once.
    paths = cut(links.filter("src < dst").select(F.array("src", "dst").alias("path")))
    out = links.filter("src = dst").select(F.array("src").alias("cycle"))
    for _ in count() if longest is None else range(longest - 1):
        ends = paths.withColumn("src", F.element_at("path", -1)).join(links, "src")
        out = out.unionByName(cut(ends.filter(F.col("dst") == F.col("path")[0]).select(F.col("path").alias("cycle"))))
        paths = cut(ends.filter((F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path")))
        if paths.isEmpty():
            break
    return out


def dead_code(nodes: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """Nodes of the kinds that aren't exported and that nothing but containment points at."""
    used = edges.filter("kind <> 'contains'").select(F.col("target").alias("id"))
    return nodes.filter(F.col("kind").isin(*kinds) & ~F.col("is_exported")).join(used, "id", "left_anti")


def node_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in, out, calls, callers, children per node."""
    of = lambda c, kind: F.count(F.when(c == kind, 1))
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n_out"), of(F.col("kind"), "calls").alias("calls"), of(F.col("kind"), "contains").alias("children"))
    into = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n_in"), of(F.col("kind"), "calls").alias("callers"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.select("id").join(out, "id", "left").join(into, "id", "left").select("id", *map(zero, ["n_in", "n_out", "calls", "callers", "children"]))


def induced(edges: DataFrame, ids: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Edges whose ends both are among ids(id)."""
    e = edges.filter(F.col("kind").isin(*kinds)) if kinds else edges
    return e.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")


def call_chains(edges: DataFrame, roots: DataFrame, hops: int, least: int, top: int) -> DataFrame:
    """chain: the longest call chains from the roots, up to hops edges and of at least that many nodes; none a prefix of another."""
    links = cut(adjacency(edges, "out", ["calls", "references"]).select("src", "dst").distinct())
    paths = cut(roots.select(F.array("id").alias("path")))
    done = None
    for _ in range(hops):
        ends = paths.withColumn("src", F.element_at("path", -1))
        grown = ends.join(links, "src").filter(~F.array_contains("path", F.col("dst")))
        stuck = ends.join(links.select("src").distinct(), "src", "left_anti").select("path")
        done = stuck if done is None else done.unionByName(stuck)
        paths = cut(grown.select(F.concat("path", F.array("dst")).alias("path")))
    every = done.unionByName(paths).filter(F.size("path") >= least).distinct()
    return every.select(F.array_join("path", ">").alias("chain"), F.size("path").alias("length")).orderBy(F.desc("length"), "chain").limit(top)


def enclosing(spans: DataFrame, points: DataFrame, key: str, width: int) -> DataFrame:
    """For each point(key, at, pid) the span(key, start, stop, sid) around it that starts last.

    Spans are spread over buckets of the given width, so the join is an
    equi-join on key and bucket and no bucket meets all spans of a key.
    """
    spread = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))))
    met = points.withColumn("bucket", F.floor(F.col("at") / width)).join(spread, [key, "bucket"]).filter((F.col("start") <= F.col("at")) & (F.col("at") <= F.col("stop")))
    return met.groupBy("pid").agg(F.max(F.struct("start", F.col("sid"))).alias("s")).select("pid", F.col("s.sid").alias("sid"))


def overlapping(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """lid, rid of the spans (key, start, stop) that overlap within a key; each pair once, in the bucket where it begins."""
    cells = lambda df, s: df.select(key, F.col("start").alias(f"{s}_start"), F.col("stop").alias(f"{s}_stop"), F.col("id").alias(f"{s}id"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))).alias("bucket"))
    both = cells(left, "l").join(cells(right, "r"), [key, "bucket"]).filter((F.col("l_start") <= F.col("r_stop")) & (F.col("r_start") <= F.col("l_stop")))
    return both.filter(F.col("bucket") == F.floor(F.greatest("l_start", "r_start") / width)).select("lid", "rid")


def top_group(counts: DataFrame, name: str, least: int, ratio: float) -> DataFrame:
    """The group of the greatest n, with the runner-up's, if n is at least least and ratio times the runner-up's."""
    place = F.row_number().over(Window.orderBy(F.desc("n"), name))
    two = counts.orderBy(F.desc("n"), name).limit(2).withColumn("p", place)
    one = two.agg(F.max(F.when(F.col("p") == 1, F.col(name))).alias(name), F.max(F.when(F.col("p") == 1, F.col("n"))).alias("n"), F.coalesce(F.max(F.when(F.col("p") == 2, F.col("n"))), F.lit(0)).alias("runner_up"))
    return one.filter((F.col("n") >= least) & (F.col("n") >= ratio * F.col("runner_up")))
