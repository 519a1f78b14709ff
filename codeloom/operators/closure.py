"""Iterative graph primitives. Each answers a question for many roots in one run.

A loop keeps only the last frontier and the visited pairs; both are stored in the
shared folder, so plans stay short and a lost executor costs one round, and they are
deleted when the loop ends. Adjacency is made distinct and stored once, keyed on its source.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.sources.scratch import checkpoint, discard, materialise, scoped


#: Rounds that are stored as one once there are so many.
MERGED = 8
#: Columns of 64 roots in a row of a closure, at most.
COLUMNS = 16


def stored_round(tiers: list[list[DataFrame]], rows: DataFrame) -> None:
    """Add a round's table; of each tier eight become one of the next, so that each row is written a few times only and few tables are read."""
    last = rows
    for tier in tiers:
        tier.append(rows)
        if len(tier) < MERGED:
            return
        rows = checkpoint(reduce(DataFrame.unionByName, tier).coalesce(rows.sparkSession.sparkContext.defaultParallelism))
        discard(*(t for t in tier if t is not last))  # the next round reads the last one
        tier.clear()
    tiers.append([rows])


@scoped
def reached_words(steps: DataFrame, seeds: DataFrame, depth: int | None) -> DataFrame:
    """(id, w, b0, b1, ..., depth): which seeds of a word w (id, w and columns of 64 bits) reach a node first after so many steps.

    One row stands for as many pairs as its columns have bits. What a round meets is stored before it is compared with what
    was there, so that where it is little it goes to the tasks, and what was there isn't shuffled.
    """
    steps = checkpoint(steps)
    frontier = checkpoint(seeds.withColumn("depth", F.lit(0)))
    bits = [c for c in seeds.columns if c not in ("id", "w")]
    merged = lambda names: [F.bit_or(c).alias(c) for c in names]
    seen = [f"seen_{c}" for c in bits]
    tiers: list[list[DataFrame]] = []
    level, n = 0, 1
    stored_round(tiers, frontier)
    while n and (depth is None or level < depth):
        level += 1
        grown = checkpoint(frontier.join(steps, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id"), "w").agg(*merged(bits)))
        known = reduce(DataFrame.unionByName, [t for tier in tiers for t in tier]).select("id", "w", *(F.col(c).alias(s) for c, s in zip(bits, seen)))
        met = known.join(grown.select("id", "w"), ["id", "w"]).groupBy("id", "w").agg(*merged(seen))
        new = [F.col(c).bitwiseAND(F.bitwise_not(F.coalesce(s, F.lit(0).cast("long")))).alias(c) for c, s in zip(bits, seen)]
        fresh = grown.join(met, ["id", "w"], "left").select("id", "w", *new, F.lit(level).alias("depth"))
        frontier = checkpoint(fresh.filter(reduce(Column.bitwiseOR, map(F.col, bits)) != 0))
        discard(grown)
        n = frontier.count()
        if n:
            stored_round(tiers, frontier)
    return reduce(DataFrame.unionByName, [t for tier in tiers for t in tier])


def numbered_roots(roots: DataFrame) -> tuple[DataFrame, int]:
    """(root, n) with numbers from 0 without gaps, and how many there are; stored."""
    placed = materialise(roots.withColumn("n", F.monotonically_increasing_id()), "roots")
    part = F.shiftright("n", 33)
    counts = placed.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row for each partition
    starts = dict(zip([r["part"] for r in counts], accumulate((r["count"] for r in counts), initial=0)))
    shift = F.create_map(*(F.lit(x) for p, start in starts.items() for x in (p, start - (p << 33))))[part] if starts else F.lit(0)
    return placed.select("root", (F.col("n") + shift).cast("long").alias("n")), sum(r["count"] for r in counts)


def closure(adj: DataFrame, seeds: DataFrame, depth: int | None = None, include_seeds: bool = False, columns: int | None = None) -> DataFrame:
    """(root, id, depth) of all that each root reaches along ``adj`` (src, dst).

    ``seeds`` has root, and id where a root starts from other nodes than itself.
    Without ``include_seeds`` a root's seeds are left out even where a cycle leads
    back. Depth 0 reaches nothing; None is unlimited. Roots are numbered and kept as bits, 64
    to a column and up to ``COLUMNS`` columns to a row, or ``columns`` where a node is reached by few; the pairs are made
    when the result is read.
    """
    start = seeds if "id" in seeds.columns else seeds.withColumn("id", F.col("root"))
    start = start.select("root", "id").distinct()
    numbered, many = numbered_roots(start.select("root").distinct())
    wide = columns or min(COLUMNS, max(1, -(-many // 64)))
    at, place = F.shiftright("n", 6), F.col("n").bitwiseAND(F.lit(63)).cast("int")
    bit = F.expr("shiftleft(1L, cast(n & 63 as int))")
    column = [F.coalesce(F.bit_or(F.when(F.col("i") == i, F.col("b"))), F.lit(0).cast("long")).alias(f"b{i}") for i in range(wide)]
    words = start.join(numbered, "root").select("id", F.floor(at / wide).alias("w"), F.pmod(at, F.lit(wide)).alias("i"), bit.alias("b")).groupBy("id", "w").agg(*column)
    found = reached_words(adj.select("src", "dst").distinct(), words, depth)
    members = numbered.select(at.alias("at"), F.struct(place.alias("place"), "root").alias("m")).groupBy("at").agg(F.collect_list("m").alias("ms"))
    pairs = found if include_seeds else found.filter("depth > 0")
    split = F.array(*(F.struct((F.col("w") * wide + i).alias("at"), F.col(f"b{i}").alias("bits")) for i in range(wide)))
    narrow = pairs.select("id", "depth", F.explode(split).alias("x")).filter("x.bits <> 0").select("id", "depth", "x.at", "x.bits")
    return narrow.join(members, "at").select("id", "depth", "bits", F.explode("ms").alias("m")).filter("(shiftright(bits, m.place) & 1L) = 1L").select("m.root", "id", "depth")


@scoped
def shortest_paths(adj: DataFrame, pairs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(from_id, to_id, path) for each pair with a path; of the shortest, the one that edge ids order first.

    ``adj`` has src, dst and edge_id; ``path`` is the list of node ids with both ends. The
    distance to each target is found backwards; then each pair goes its way once, by the least
    edge that leads nearer.
    """
    wanted = checkpoint(pairs.select("from_id", "to_id").distinct())
    steps = checkpoint(adj.groupBy("src", "dst").agg(F.min("edge_id").alias("edge_id")))
    back = steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    far = closure(back, wanted.select(F.col("to_id").alias("root")), max_depth, include_seeds=True).select(F.col("root").alias("to_id"), F.col("id").alias("at"), F.col("depth").alias("left"))
    waiting = checkpoint(wanted.select("from_id", "to_id", F.col("from_id").alias("at")).join(far, ["to_id", "at"]).select("from_id", "to_id", "at", "left", F.array("at").alias("path")))
    live = waiting.limit(0)
    for left in range(waiting.agg(F.max("left")).first()[0] or 0, 0, -1):
        begun = waiting.filter(F.col("left") == left)
        nearer = far.filter(F.col("left") == left - 1).select("to_id", F.col("at").alias("dst"))
        ways = live.unionByName(begun).join(steps, F.col("at") == F.col("src")).join(nearer, ["to_id", "dst"])
        best = ways.groupBy("from_id", "to_id").agg(F.min_by(F.struct("path", "dst"), "edge_id").alias("b"))
        live = checkpoint(best.select("from_id", "to_id", F.col("b.dst").alias("at"), F.lit(left - 1).alias("left"), F.array_append("b.path", F.col("b.dst")).alias("path")))
    return live.unionByName(waiting.filter("left = 0")).select("from_id", "to_id", "path")


@scoped
def chains(step: DataFrame, starts: DataFrame) -> DataFrame:
    """(root, position, id): follow ``step`` (id, next; one next each) until it ends or comes to a node of the chain again.

    The start isn't of the chain, so a cycle ends on it once.
    """
    step = checkpoint(step.select(F.col("id").alias("at"), "next"))
    live = checkpoint(starts.select("root", F.col("root").alias("at")).distinct().withColumn("chain", F.array().cast("array<bigint>")))
    done = live.limit(0)
    while not live.isEmpty():
        grown = live.join(step, "at", "left")
        stops = F.col("next").isNull() | F.array_contains("chain", F.col("next"))
        done = checkpoint(done.unionByName(grown.filter(F.coalesce(stops, F.lit(True))).select("root", "at", "chain")))
        live = checkpoint(grown.filter(~F.coalesce(stops, F.lit(True))).select("root", F.col("next").alias("at"), F.array_append("chain", F.col("next")).alias("chain")))
    return done.select("root", F.posexplode("chain").alias("position", "id"))


@scoped
def nearest_ancestors(nodes: DataFrame, parents: DataFrame, is_goal: str, rounds: int = 40) -> DataFrame:
    """(id, ancestor): the node itself or its nearest ancestor for which ``is_goal`` holds, by pointer doubling.

    Cycles of parents and chains without a goal have none. ``rounds`` of doubling cover
    2**rounds steps. Pointers are doubled for nodes that are a parent; all others take
    their parent's ancestor at the end, in one join.
    """
    goal = F.expr(is_goal)
    jump = nodes.join(parents, "id", "left").select("id", F.when(goal, F.col("id")).otherwise(F.col("parent")).alias("to"), goal.alias("done"))
    every = checkpoint(jump.filter("to is not null"))
    state = checkpoint(every.join(every.filter("not done").select(F.col("to").alias("id")).distinct(), "id", "left_semi"))
    for _ in range(rounds):
        if state.filter("not done").isEmpty():
            break
        far = state.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("done").alias("far_done"))
        moved = state.filter("not done").join(far, "to").select("id", F.col("far").alias("to"), F.col("far_done").alias("done"))
        now = checkpoint(state.filter("done").unionByName(moved.filter("id <> to or done")))
        if now.count() == state.count() and now.filter("done").count() == state.filter("done").count() and now.join(state, ["id", "to", "done"], "left_anti").isEmpty():
            break
        state = now
    found = state.filter("done").select(F.col("id").alias("to"), F.col("to").alias("ancestor"))
    return every.filter("done").select("id", F.col("to").alias("ancestor")).unionByName(every.filter("not done").join(found, "to").select("id", "ancestor"))


def chain_ends(step: DataFrame, most: int) -> DataFrame:
    """(id, to, done, least): where the pointers of ``step`` (id, next) lead out of its ids, by pointer doubling; without ``done`` they go round a cycle, whose least id is ``least``. ``most`` is the number of ids."""
    inner = step.select(F.col("id").alias("next"), F.lit(True).alias("inner"))
    state = checkpoint(step.join(inner, "next", "left").select("id", F.col("next").alias("to"), F.col("inner").isNull().alias("done"), F.when(F.col("inner"), F.least("id", "next")).otherwise(F.col("id")).alias("least")))
    for _ in range(most.bit_length()):
        far = state.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("done").alias("far_done"), F.col("least").alias("far_least"))
        moved = state.filter("not done").join(far, "to").select("id", F.col("far").alias("to"), F.col("far_done").alias("done"), F.least("least", "far_least").alias("least"))
        state = checkpoint(state.filter("done").unionByName(moved))
        if state.filter("not done").isEmpty():
            break
    return state


def without_chains(rest: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int] | None:
    """Edges with one in place of each chain of nodes that have one edge in and one out; the chains' nodes with what leads into and out of them (id, head, goal); the cycles that are all chain (id, component); how many nodes went. None if few nodes are of a chain."""
    degrees = rest.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("dst").alias("n")).unionByName(rest.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(None).cast("long").alias("n")))
    nodes = checkpoint(degrees.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.max("n").alias("next")))
    total, many = nodes.agg(F.count(F.lit(1)), F.count(F.when((F.col("o") == 1) & (F.col("i") == 1), 1))).first()
    if many * 10 < total:
        return None
    chain = nodes.filter("o = 1 and i = 1").select("id", "next")
    back = rest.join(chain.select(F.col("id").alias("dst")), "dst").select(F.col("dst").alias("id"), F.col("src").alias("next"))
    ahead = chain_ends(chain, many)
    behind = chain_ends(back, many)
    segments = checkpoint(ahead.filter("done").select("id", F.col("to").alias("goal")).join(behind.filter("done").select("id", F.col("to").alias("head")), "id").select("id", "head", "goal"))
    round_ = ahead.filter("not done").select("id", F.col("least").alias("component"))
    free = rest.join(chain.select(F.col("id").alias("src")), "src", "left_anti").join(chain.select(F.col("id").alias("dst")), "dst", "left_anti")
    left = checkpoint(free.unionByName(segments.select(F.col("head").alias("src"), F.col("goal").alias("dst"))).distinct())
    return left, segments, round_, many


@scoped
def strong_components(adj: DataFrame) -> DataFrame:
    """(id, component) of nodes on a cycle; the component is its least id. A self-loop is a cycle.

    The graph is made small first, again and again: nodes without an edge in or out are
    trimmed, and a chain of nodes with one edge in and one out becomes one edge, its ends
    found by pointer doubling; so the rounds for a path, or a cycle, grow with the logarithm
    of its length. Of what is left every node takes the least id that reaches it, and what
    reaches back to that id within its colour is a component; these are taken off, and
    the rest goes round again. Last, a chain joins the component that both its ends are of.
    """
    edges = checkpoint(adj.select("src", "dst").distinct())
    loops = edges.filter("src = dst").select(F.col("src").alias("id"))
    rest = edges.filter("src <> dst")
    found, taken, size = None, [], rest.count()
    while size:
        trimmed = checkpoint(rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        before, size, rest = size, trimmed.count(), trimmed
        shorter = without_chains(rest) if size else None
        if shorter:
            left, segments, whole, _ = shorter
            taken.append((segments, left.filter("src = dst").select(F.col("src").alias("id"))))
            found = whole if found is None else found.unionByName(whole)
            rest = left.filter("src <> dst")
            size = rest.count()
        elif size == before or size * 10 > before * 9:
            break
    while size:
        colour = checkpoint(rest.select(F.col("src").alias("id")).unionByName(rest.select(F.col("dst").alias("id"))).distinct().withColumn("c", F.col("id")))
        while True:
            told = rest.join(colour, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), "c")
            new = checkpoint(colour.unionByName(told).groupBy("id").agg(F.min("c").alias("c")))
            if new.join(colour, ["id", "c"], "left_anti").isEmpty():
                break
            colour = new
        own = rest.join(colour.withColumnRenamed("c", "c1"), F.col("src") == F.col("id")).drop("id").join(colour, F.col("dst") == F.col("id")).filter("c1 = c").select(F.concat_ws(":", "c", "dst").alias("src"), F.concat_ws(":", "c", "src").alias("dst"))
        starts = colour.filter("id = c").select(F.concat_ws(":", "c", "id").alias("root"))
        back = closure(own, starts, include_seeds=True, columns=1)  # a node is reached by one root
        part = checkpoint(back.select(F.split("id", ":")[1].cast("long").alias("id"), F.split("root", ":")[0].cast("long").alias("component")))
        many = part.join(part.groupBy("component").count().filter("count > 1"), "component", "left_semi").select("id", "component")
        found = many if found is None else found.unionByName(many)
        gone = part.select("id")
        rest = checkpoint(rest.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
        rest = checkpoint(rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(rest.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        size = rest.count()
    if found is None:
        found = loops.limit(0).withColumn("component", F.col("id"))
    of_itself = lambda ids: ids.join(found.select("id"), "id", "left_anti").withColumn("component", F.col("id"))
    for segments, closed in reversed(taken):
        found = checkpoint(found)
        found = found.unionByName(of_itself(closed))
        ends = segments.join(found.select(F.col("id").alias("head"), "component"), "head").join(found.select(F.col("id").alias("goal"), F.col("component").alias("c")), "goal")
        found = found.unionByName(ends.filter("component = c").select("id", "component"))
    if taken:
        found = checkpoint(found)
        found = found.join(found.groupBy("component").agg(F.min("id").alias("least")), "component").select("id", F.col("least").alias("component"))
    return found.unionByName(of_itself(loops))
