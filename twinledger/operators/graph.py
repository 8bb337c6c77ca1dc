"""Cycle check for parent-component rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from twinledger.operators.skew import HOT_ROWS, hot_keys_of, join_unique
from twinledger.session import ensure_checkpoint_dir, stored

# Default column names.
PARENT_COLUMN = "product-sku"
COMPONENT_COLUMN = "product-sku-to"
SPELLED = 1000
"""Nodes of a cycle that a problem row's text names."""


@dataclass
class CycleSplit:
    """Importable rows, problem rows, the nodes of every cycle (``node, cycle``) and a path for each (``cycle, step, node``)."""

    importable: DataFrame
    problems: DataFrame
    groups: DataFrame
    paths: DataFrame
    counts: dict


def _hot(edges: DataFrame, column: str, hot_rows: int) -> DataFrame | None:
    """Hot nodes of one end, or None when there are none."""
    hot = hot_keys_of(edges, column, hot_rows)
    return None if hot.isEmpty() else hot.transform(stored, "graph")


def _on(edges: DataFrame, nodes: DataFrame, column: str, how: str, hot: DataFrame | None) -> DataFrame:
    """Join edges with a node table (unique ``node``) on one end."""
    return join_unique(edges, nodes.withColumnRenamed("node", column), column, how, hot)


def _trim(edges: DataFrame, hot_src: DataFrame | None, hot_dst: DataFrame | None) -> DataFrame:
    """Drop edges that cannot lie on a cycle: a source nothing enters, a target nothing leaves."""
    size = edges.count()
    while size:
        sources = edges.select(F.col("src").alias("node")).distinct()
        targets = edges.select(F.col("dst").alias("node")).distinct()
        kept = _on(_on(edges, targets, "src", "left_semi", hot_src), sources, "dst", "left_semi", hot_dst)
        kept = kept.select("src", "dst").transform(stored, "graph")
        left = kept.count()
        if left == size:
            return kept
        edges, size = kept, left
    return edges


def _spread_minimum(edges: DataFrame, labels: DataFrame, hot_src: DataFrame | None) -> DataFrame:
    """Each node takes the smallest label that reaches it, until nothing changes.

    ``labels`` is ``(node, label)``.  A hop pre-aggregates the minimum per
    target and is checkpointed, so it is computed once.  The label a node had
    before travels along, so the check for changes needs no join.
    """
    while True:
        offered = _on(edges, labels, "src", "inner", hot_src).select(
            F.col("dst").alias("node"), "label", F.lit(None).cast("string").alias("before")
        )
        hop = stored(
            labels.withColumn("before", F.col("label")).unionByName(offered)
            .groupBy("node").agg(F.min("label").alias("label"), F.min("before").alias("before")), "graph"
        )
        labels = hop.select("node", "label")
        if hop.filter(~F.col("label").eqNullSafe(F.col("before"))).isEmpty():
            return labels


def _flood(edges: DataFrame, roots: DataFrame, hot_src: DataFrame | None) -> DataFrame:
    """``(node, label, next, hops)`` of what each root (``node, label``) reaches: by how many edges, and the smallest node that it was reached from then."""
    reached = roots.select("node", "label", F.lit(None).cast("string").alias("next"), F.lit(0).alias("hops")).transform(stored, "graph")
    size, hops = reached.count(), 0
    while True:
        last = reached.filter(F.col("hops") == hops).select("node", "label")
        hops += 1
        offered = _on(edges, last, "src", "inner", hot_src).select(F.col("dst").alias("node"), "label", F.col("src").alias("next"), F.lit(hops).alias("hops"))
        reached = reached.unionByName(offered).groupBy("node").agg(F.min(F.struct("hops", "next", "label")).alias("e")).select(
            "node", "e.label", "e.next", "e.hops").transform(stored, "graph")
        before, size = size, reached.count()
        if size == before:
            return reached


def _kernel_components(edges: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """``(node, cycle)`` for nodes of strongly connected components of two or more, and ``(cycle, node, next, hops)``: each one's next node towards its root.

    Forward, every node takes the smallest node that reaches it as its colour.
    A colour's first node then floods its own colour backwards: what it reaches
    is one component.  Those nodes leave and the rest repeats.
    """
    spark = edges.sparkSession
    remaining = edges.select("src", "dst").filter(F.col("src") != F.col("dst")).distinct().transform(stored, "graph")
    hot_src, hot_dst = _hot(remaining, "src", hot_rows), _hot(remaining, "dst", hot_rows)
    back_hot = None if hot_dst is None else hot_dst.withColumnRenamed("dst", "src")
    found = spark.createDataFrame([], "node string, cycle string")
    towards = spark.createDataFrame([], "cycle string, node string, next string, hops int")
    while True:
        remaining = _trim(remaining, hot_src, hot_dst)
        if remaining.isEmpty():
            return found, towards
        nodes = remaining.select(F.col("src").alias("node")).distinct()
        colours = _spread_minimum(remaining, nodes.withColumn("label", F.col("node")), hot_src)
        source_colour = colours.select("node", F.col("label").alias("colour"))
        target_colour = colours.select("node", F.col("label").alias("_colour"))
        inside = _on(_on(remaining, source_colour, "src", "inner", hot_src), target_colour, "dst", "inner", hot_dst)
        backward = stored(
            inside.filter(F.col("colour") == F.col("_colour"))
            .select(F.col("dst").alias("src"), F.col("src").alias("dst")), "graph"
        )
        roots = colours.filter(F.col("node") == F.col("label"))
        members = _flood(backward, roots, back_hot)
        sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
        cycles = members.join(sizes, "label").select("node", F.col("label").alias("cycle"))
        found = found.unionByName(cycles).transform(stored, "graph")
        towards = towards.unionByName(members.filter("hops > 0").select(F.col("label").alias("cycle"), "node", "next", "hops")).transform(stored, "graph")
        # Every node that met its root is settled, alone or in a component.
        settled = members.select("node")
        remaining = _on(_on(remaining, settled, "src", "left_anti", hot_src), settled, "dst", "left_anti", hot_dst)
        remaining = remaining.select("src", "dst").transform(stored, "graph")


def _describe(cycles: DataFrame, paths: DataFrame, spelled: int) -> DataFrame:
    """``(cycle, cycle_description)``: members and path are spelled out for cycles of at most ``spelled`` nodes."""
    sizes = cycles.groupBy("cycle").agg(F.count(F.lit(1)).alias("_n"))
    small = sizes.filter(F.col("_n") <= spelled).select("cycle")
    names = cycles.join(small, "cycle").groupBy("cycle").agg(F.array_join(F.array_sort(F.collect_list("node")), ", ").alias("_names"))
    ways = paths.join(small, "cycle").groupBy("cycle").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "node"))), lambda x: x["node"]).alias("_way"))
    text = F.concat(F.lit("Cycle among "), "_names", F.lit(" (path: "), F.array_join(F.concat("_way", F.slice("_way", 1, 1)), " -> "), F.lit(")"))
    long = F.concat(F.lit("Cycle among "), F.col("_n").cast("string"), F.lit(" nodes, first "), F.col("cycle"))
    return sizes.join(names, "cycle", "left").join(ways, "cycle", "left").select("cycle", F.coalesce(text, long).alias("cycle_description"))


@dataclass
class Level:
    """What one contraction took out of a graph: see ``_contract``."""

    members: DataFrame
    chains: DataFrame
    chosen: DataFrame
    loops: DataFrame
    rings: DataFrame


def _jump(pointers: DataFrame) -> DataFrame:
    """Doubles pointers until each leaves the chain nodes or is known to go round a ring.

    ``pointers`` has ``x, nxt, d, last, low, dlow``: what the pointer reaches
    after ``d`` steps, the chain node before it, and the smallest node passed
    with the steps to it.  Returns them with ``ring``: still among chain nodes.
    A pass doubles what is covered, so the passes are the logarithm of the
    longest chain or ring.
    """
    now, before = pointers, None
    while True:
        seen = Observation()
        now = _doubled(_doubled(now).drop("open", "new")).observe(seen, F.count_if("open").alias("left"), F.count_if(F.col("open") & F.col("new")).alias("changed"))
        now = now.drop("new").transform(stored, "graph")
        left, changed = seen.get["left"], seen.get["changed"]
        # a chain settles some of its nodes in each pass; what no longer shrinks are rings, done when no smaller node comes up
        if not left or (left == before and not changed):
            return now.withColumnRenamed("open", "ring")
        before, now = left, now.drop("open")


def _doubled(now: DataFrame) -> DataFrame:
    """Each pointer followed by the one of the node that it reaches; ``open`` if there is one, ``new`` if that passed a smaller node."""
    ahead = now.select(F.col("x").alias("nxt"), *[F.col(c).alias(f"_{c}") for c in ("nxt", "d", "last", "low", "dlow")])
    joined = now.join(ahead, "nxt", "left")
    more, lower = F.col("_d").isNotNull(), F.coalesce(F.col("_low") < F.col("low"), F.lit(False))
    return joined.select(
        "x", F.coalesce("_nxt", "nxt").alias("nxt"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d"), F.coalesce("_last", "last").alias("last"),
        F.when(lower, F.col("_low")).otherwise(F.col("low")).alias("low"), F.when(lower, F.col("d") + F.col("_dlow")).otherwise(F.col("dlow")).alias("dlow"),
        "succ", "w", more.alias("open"), lower.alias("new"))


def _contract(edges: DataFrame) -> tuple[DataFrame, int, Level] | None:
    """Edges without dead ends and without chains, and their number, or None when there are neither.

    ``edges`` are ``src, dst, w`` (``w`` original steps), one a pair, no loops.
    Nodes with one edge in and one out form chains and rings.  A chain between
    two other nodes becomes an edge; what leads from or to a node that can't
    be passed through goes.  Level: ``members`` (``x, chain, d, succ, w``: steps
    ``d`` to the chain's end, its own edge), ``chains`` (``chain, u, v, first,
    wfirst, w``), ``chosen`` (``u, v, chain``: the edge that stands for the
    pair), ``loops`` (``node, chain, w``) and ``rings`` (``cycle, at, src, dst,
    w``, ``at`` steps from the smallest node).
    """
    outs = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.min(F.struct("dst", "w")).alias("e"))
    ins = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"))
    chain_node = (F.col("n_in") == 1) & (F.col("n_out") == 1)
    passable = F.col("n_in").isNotNull() & F.col("n_out").isNotNull()
    seen = Observation()
    degrees = outs.join(ins, "node", "full").observe(seen, F.count_if(chain_node).alias("chain"), F.count_if(~passable).alias("dead")).transform(stored, "graph")
    if not seen.get["chain"] and not seen.get["dead"]:
        return None
    on_chain = degrees.filter(chain_node).select(F.col("node").alias("x"), F.col("e.dst").alias("succ"), F.col("e.w").alias("w"))
    found = _jump(on_chain.select("x", F.col("succ").alias("nxt"), F.col("w").alias("d"), F.col("x").alias("last"), F.col("x").alias("low"), F.lit(0).cast("long").alias("dlow"), "succ", "w"))
    members = found.filter(~F.col("ring")).select("x", F.col("last").alias("chain"), "d", "succ", "w")
    rounds = found.filter("ring")
    total = rounds.groupBy(F.col("low").alias("cycle")).agg(F.sum("w").alias("total"))
    rings = rounds.withColumnRenamed("low", "cycle").join(total, "cycle").select(
        "cycle", F.when(F.col("dlow") == 0, F.lit(0).cast("long")).otherwise(F.col("total") - F.col("dlow")).alias("at"), F.col("x").alias("src"), F.col("succ").alias("dst"), "w")
    ends = found.filter(~F.col("ring")).select(F.col("x").alias("dst"), F.col("nxt").alias("v"), F.col("last").alias("chain"), "d")
    inner = on_chain.select(F.col("x").alias("src"))
    outer = edges.join(inner, "src", "left_anti").join(on_chain.select(F.col("x").alias("dst"), F.lit(True).alias("_chain")), "dst", "left")
    chains = outer.filter("_chain").join(ends, "dst").select(
        "chain", F.col("src").alias("u"), "v", F.col("dst").alias("first"), F.col("w").alias("wfirst"), (F.col("w") + F.col("d")).alias("w")).transform(stored, "graph")
    direct = outer.filter(F.col("_chain").isNull()).select(F.col("src").alias("u"), F.col("dst").alias("v"), "w", F.lit(None).cast("string").alias("chain"))
    made = direct.unionByName(chains.select("u", "v", "w", "chain")).groupBy("u", "v").agg(F.min(F.struct("w", "chain")).alias("e")).select("u", "v", "e.w", "e.chain")
    dead = degrees.filter(~passable).select("node", F.lit(True).alias("_dead"))
    marked = made.join(dead.withColumnsRenamed({"node": "u", "_dead": "_from"}), "u", "left").join(dead.withColumnsRenamed({"node": "v", "_dead": "_to"}), "v", "left")
    marked = marked.select("u", "v", "w", "chain", (F.col("_from").isNull() & F.col("_to").isNull() & (F.col("u") != F.col("v"))).alias("goes_on"))
    left = Observation()
    marked = marked.observe(left, F.count_if("goes_on").alias("n")).transform(stored, "graph")
    rest = marked.filter("goes_on").select(F.col("u").alias("src"), F.col("v").alias("dst"), "w")
    return rest, left.get["n"], Level(members, chains, marked.filter(F.col("chain").isNotNull()).select("u", "v", "chain"),
                                      marked.filter(F.col("u") == F.col("v")).select(F.col("u").alias("node"), "chain", "w"), rings)


def _kernel_paths(kernel: DataFrame, cycles: DataFrame, towards: DataFrame) -> DataFrame:
    """``cycle, at, src, dst, w``: one cycle through each component's root.

    ``towards`` has each member's next node on a way back to its root.  The
    cycle leaves the root by its edge to the member that is nearest by hops.
    Which nodes the way passes is marked by doubling: those marked so far and
    what their pointers reach, until nothing is added.
    """
    weights = kernel.select("src", "dst", "w")
    hop = towards.withColumnsRenamed({"node": "src", "next": "dst"}).join(weights, ["src", "dst"]).select("cycle", "hops", "src", "dst", "w")
    hop = hop.transform(stored, "graph")  # one edge a member but the root
    starts = weights.join(cycles.filter(F.col("node") == F.col("cycle")).select(F.col("node").alias("src"), "cycle"), "src").join(
        hop.select(F.col("src").alias("dst"), F.col("cycle").alias("_own"), "hops"), "dst").filter(F.col("cycle") == F.col("_own"))
    first = starts.groupBy("cycle").agg(F.min(F.struct("hops", "dst", "w")).alias("e")).select("cycle", F.col("cycle").alias("src"), "e.dst", "e.w").transform(stored, "graph")
    pointer = hop.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.col("w").alias("d"))
    marked = first.select("cycle", F.col("dst").alias("node"), F.col("w").alias("at"))
    size = 0
    while True:
        reached = marked.join(pointer, "node").select("cycle", F.col("to").alias("node"), (F.col("at") + F.col("d")).alias("at")).filter(F.col("node") != F.col("cycle"))
        marked = marked.unionByName(reached).distinct().transform(stored, "graph")
        now = marked.count()
        if now == size:
            break
        size = now
        further = pointer.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("d").alias("_d"))
        pointer = pointer.join(further, "to", "left").select("node", F.coalesce("_to", "to").alias("to"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d")).transform(stored, "graph")
    rest = marked.select("cycle", "at", F.col("node").alias("src")).join(hop.select("src", "dst", "w"), "src")
    return first.select("cycle", F.lit(0).cast("long").alias("at"), "src", "dst", "w").unionByName(rest.select("cycle", "at", "src", "dst", "w")).transform(stored, "graph")


def _unfolded(paths: DataFrame, level: Level, loops: DataFrame) -> DataFrame:
    """Path edges of the graph that ``level`` was taken out of."""
    by = paths.join(level.chosen.select(F.col("u").alias("src"), F.col("v").alias("dst"), "chain"), ["src", "dst"], "left").select("cycle", "at", "src", "dst", "w", "chain")
    every = by.unionByName(loops.select(F.col("node").alias("cycle"), F.lit(0).cast("long").alias("at"), F.col("node").alias("src"), F.col("node").alias("dst"), "w", "chain"))
    plain = every.filter(F.col("chain").isNull()).drop("chain")
    folded = every.filter(F.col("chain").isNotNull())
    entry = folded.select("cycle", "at", "src", "dst", "chain").join(
        level.chains.select("chain", F.col("u").alias("src"), F.col("v").alias("dst"), "first", "wfirst"), ["chain", "src", "dst"])
    inside = folded.select("cycle", "chain", (F.col("at") + F.col("w")).alias("_end")).join(level.members, "chain")
    return plain.unionByName(entry.select("cycle", "at", "src", F.col("first").alias("dst"), F.col("wfirst").alias("w"))).unionByName(
        inside.select("cycle", (F.col("_end") - F.col("d")).alias("at"), F.col("x").alias("src"), F.col("succ").alias("dst"), "w")).unionByName(level.rings).transform(stored, "graph")


def components(edges: DataFrame, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """``(node, cycle)`` for nodes on cycles of two or more, and one path ``(cycle, step, node)`` for each cycle.

    Dead ends and chains are contracted first, again until none is left; a
    chain or ring of any length takes passes in its logarithm.  The strongly
    connected components of what is left are found as ``_kernel_components``
    tells.  Then the contracted nodes come back: a chain lies on a cycle where
    both its ends are in one component.  ``cycle`` is the component's smallest
    node; a path begins with its own smallest node, step 0.
    """
    spark = edges.sparkSession
    seen = Observation()
    graph = edges.select("src", "dst").filter(F.col("src") != F.col("dst")).distinct().withColumn("w", F.lit(1).cast("long"))
    graph = graph.observe(seen, F.count(F.lit(1)).alias("n")).transform(stored, "graph")
    size, levels = seen.get["n"], []
    while size:
        less = _contract(graph)
        if less is None:
            break
        graph, size, level = less
        levels.append(level)
    cycles, paths = spark.createDataFrame([], "node string, cycle string"), spark.createDataFrame([], "cycle string, at long, src string, dst string, w long")
    if size:
        cycles, towards = _kernel_components(graph, hot_rows)
        paths = _kernel_paths(graph, cycles, towards)
    for level in reversed(levels):
        loops = level.loops.join(cycles.select("node"), "node", "left_anti").transform(stored, "graph")
        cycles = cycles.unionByName(loops.select("node", F.col("node").alias("cycle")))
        paths = _unfolded(paths, level, loops)
        on = level.chains.join(cycles.select(F.col("node").alias("u"), "cycle"), "u").join(cycles.select(F.col("node").alias("v"), F.col("cycle").alias("_v")), "v")
        inner = level.members.join(on.filter(F.col("cycle") == F.col("_v")).select("chain", "cycle"), "chain").select(F.col("x").alias("node"), "cycle")
        cycles = cycles.unionByName(inner).unionByName(level.rings.select(F.col("src").alias("node"), "cycle")).transform(stored, "graph")
    named = cycles.groupBy("cycle").agg(F.min("node").alias("name"))
    own = paths.groupBy("cycle").agg(F.sum("w").alias("steps"), F.min(F.struct("src", "at")).alias("head"))
    turned = paths.join(own, "cycle").join(named, "cycle").select(
        F.col("name").alias("cycle"), F.pmod(F.col("at") - F.col("head.at"), F.col("steps")).alias("step"), F.col("src").alias("node"))
    return cycles.join(named, "cycle").select("node", F.col("name").alias("cycle")).transform(stored, "graph"), turned.transform(stored, "graph")


def bom_cycle_split(
    rows: DataFrame, parent: str = PARENT_COLUMN, child: str = COMPONENT_COLUMN,
    assoc_col: str | None = None, assoc_type: str | None = None,
    hot_rows: int = HOT_ROWS, spelled: int = SPELLED,
) -> CycleSplit:
    """Split parent-component rows into importable ones and ones on a cycle.

    Problem rows gain ``error_reason`` and ``cycle_description``.  Rows with a
    missing end or another association type are skipped and only counted.
    ``groups`` and ``paths`` are whole at every size; the description, which
    each problem row repeats, spells members and path for cycles of at most
    ``spelled`` nodes and tells the number and the first node of larger ones.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    src, dst = F.trim(F.col(f"`{parent}`")), F.trim(F.col(f"`{child}`"))
    usable = src.isNotNull() & dst.isNotNull() & (src != "") & (dst != "")
    if assoc_col and assoc_type:
        usable = usable & F.coalesce(F.col(f"`{assoc_col}`") == F.lit(assoc_type), F.lit(False))
    total = rows.count()
    kept = rows.filter(usable).withColumn("src", src).withColumn("dst", dst)
    edges = kept.select("src", "dst").distinct()
    cycles, paths = components(edges, hot_rows)

    hot_src, hot_dst = _hot(kept, "src", hot_rows), _hot(kept, "dst", hot_rows)
    start = cycles.select("node", F.col("cycle"))
    stop = cycles.select("node", F.col("cycle").alias("_cycle"))
    marked = _on(_on(kept, start, "src", "left", hot_src), stop, "dst", "left", hot_dst)
    marked = marked.withColumn("cycle", F.when(F.col("cycle") == F.col("_cycle"), F.col("cycle"))).drop("_cycle").checkpoint()
    loop = F.col("src") == F.col("dst")
    on_cycle = F.col("cycle").isNotNull() & ~loop
    texts = _describe(cycles, paths, spelled)
    columns = [F.col(f"`{c}`") for c in rows.columns]
    importable = marked.filter(~loop & F.col("cycle").isNull()).select(*columns)
    self_rows = marked.filter(loop).select(
        *columns, F.lit("Self relationship").alias("error_reason"),
        F.concat(F.lit("Self relationship on "), F.col("src")).alias("cycle_description"),
    )
    by_cycle = marked.filter(on_cycle)
    hot_cycle = hot_keys_of(by_cycle, "cycle", hot_rows)
    cycle_rows = join_unique(by_cycle, texts, "cycle", "left", hot_cycle).select(
        *columns, F.lit("Cyclic relationship").alias("error_reason"), "cycle_description"
    )
    problems = cycle_rows.unionByName(self_rows)
    loops = kept.filter(loop).select(F.col("src").alias("node")).distinct()
    in_component = cycles.select("node")
    alone = loops.join(in_component, "node", "left_anti").transform(stored, "graph")
    groups = cycles.unionByName(alone.select("node", F.col("node").alias("cycle")))
    paths = paths.unionByName(alone.select(F.col("node").alias("cycle"), F.lit(0).cast("long").alias("step"), "node"))
    split = marked.agg(
        F.count_if(loop | on_cycle).alias("problem"), F.count_if(~loop & F.col("cycle").isNull()).alias("importable")
    ).first()
    counts = {
        "totalRowCount": total,
        "importableRowCount": split["importable"],
        "problemRowCount": split["problem"],
        "skippedRowCount": total - split["importable"] - split["problem"],
        "cycleCount": groups.select("cycle").distinct().count(),
    }
    return CycleSplit(importable, problems, groups, paths, counts)
