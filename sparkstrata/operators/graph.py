"""Operators on property graphs given as edge lists.

Edges have ``source`` and ``target`` and, where an operator uses them, ``kind``
(static, dynamic, re-export), ``is_type_only``, ``symbols`` and ``ord`` (their
order of arrival, which decides ties). Nodes have ``id``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from sparkstrata.functions.text import half_up

#: Rounds of a frontier or label loop after which its lineage is cut.
CUT_EVERY = 3
#: Most edges whose strong components one task finds in memory.
TASK_EDGES = 1_000_000


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for a new table in the folder that ``spark.checkpoint.dir`` names; deleted when the session ends.

    A temporary folder is used only where none is set and all tasks run on this
    machine; on a cluster that would lose rows, so it is an error there.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = new_folder.own = getattr(new_folder, "own", None) or tempfile.mkdtemp(prefix="strata-")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


#: Rows of `dealt` for each task where their number is known.
TASK_ROWS = 200_000


def dealt(df: DataFrame, *keys, rows: int = 0) -> DataFrame:
    """Rows dealt out by keys to as many partitions as shuffles have, or more where ``rows``, about how many there are, ask for it.

    Small files are read by few tasks, and names take far less room in files and
    in shuffles than in memory; partitions of a fixed number are not put
    together by that size, and what is dealt out has its true size where a plan
    decides on a broadcast.
    """
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)), *keys)


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input, as the other does: it is sorted and merged, never broadcast by an estimate of its size."""
    return df.hint("merge")


def cut_lineage(df: DataFrame, name: str = "graph") -> DataFrame:
    """``df`` written to the folder in ``spark.checkpoint.dir`` and read again."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, name: str, metric: Column | None = None) -> tuple[DataFrame, int]:
    """``df`` written and read again, and the number of its rows or another count, which is taken while it is written."""
    seen = Observation()
    kept = cut_lineage(df.observe(seen, (F.count("*") if metric is None else metric).alias("n")), name)
    return kept, seen.get["n"]


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order, by a partial aggregation before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    least = F.min_by(F.struct(*rest), F.struct(*order)).alias("r")
    return df.groupBy(*keys).agg(least).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*df.columns)


def dedup_edges(edges: DataFrame, merge_symbols: bool = False) -> DataFrame:
    """One edge of each (source, target, kind), the first by ``ord`` (of equals one that isn't type-only); with ``merge_symbols`` it gets the symbols of all."""
    first = first_of(edges, ["source", "target", "kind"], ["ord", *[c for c in ["is_type_only"] if c in edges.columns]])
    if not merge_symbols:
        return first
    symbols = edges.groupBy("source", "target", "kind").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("symbols")))).alias("symbols"))
    return first.drop("symbols").join(symbols, ["source", "target", "kind"]).select(*edges.columns)


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target is a node; sources aren't checked."""
    return edges.join(nodes.select(F.col("id").alias("target")).distinct(), "target", "left_semi").select(*edges.columns)


def mark_tests(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with ``is_test_coverage``: whether the source is of kind test."""
    tests = nodes.where("kind = 'test'").select(F.col("id").alias("source"), F.lit(True).alias("t")).distinct()
    return edges.join(tests, "source", "left").withColumn("is_test_coverage", F.coalesce("t", F.lit(False))).select(*edges.columns, "is_test_coverage")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) of all ends of edges, in one pass over them."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def edge_weight(n_symbols: Column, kind: Column, is_type_only: Column) -> Column:
    """Symbols (1 at least), halved for dynamic and a fifth for type-only edges, to one place."""
    w = F.greatest(n_symbols, F.lit(1)) * F.when(kind == "dynamic", 0.5).otherwise(1.0) * F.when(is_type_only, 0.2).otherwise(1.0)
    return half_up(w, 1)


def hub_scores(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, hub_score) of every node: (2 in + out) / nodes * 100 to two places."""
    total = nodes.agg(F.count("*").alias("total"))
    own = nodes.select("id").join(degrees(edges), "id", "left").crossJoin(F.broadcast(total))  # one row
    i, o = (F.coalesce(c, F.lit(0)) for c in ("in_degree", "out_degree"))
    return own.select("id", i.cast("long").alias("in_degree"), o.cast("long").alias("out_degree"), half_up((2 * i + o) / F.col("total") * 100, 2).alias("hub_score"))


def raw_importance(in_degree: Column, out_degree: Column, n_functions: Column, n_lines: Column) -> Column:
    """The first estimate of importance, before cycles are known."""
    return half_up(in_degree * 1.5 + out_degree + n_functions * 0.5 + F.least(n_lines * 0.01, F.lit(10.0)))


def _components_of(pdf):
    """Strong components of two or more nodes of all edges (source, target), by an iterative depth-first walk."""
    import pandas as pd

    names = sorted({*pdf.source, *pdf.target})
    at = {x: k for k, x in enumerate(names)}
    after: list[list[int]] = [[] for _ in names]
    for s, t in zip(pdf.source, pdf.target):
        after[at[s]].append(at[t])
    met, low, stack, on, out = [-1] * len(names), [0] * len(names), [], [False] * len(names), []
    n = 0
    for root in range(len(names)):
        if met[root] >= 0:
            continue
        path = [(root, 0)]
        while path:
            v, k = path.pop()
            if k == 0:
                met[v] = low[v] = n
                n += 1
                stack.append(v)
                on[v] = True
            for j in range(k, len(after[v])):
                w = after[v][j]
                if met[w] < 0:
                    path += [(v, j + 1), (w, 0)]
                    break
                if on[w]:
                    low[v] = min(low[v], met[w])
            else:
                if low[v] == met[v]:
                    part = []
                    while not part or part[-1] != v:
                        part.append(stack.pop())
                        on[part[-1]] = False
                    if len(part) > 1:
                        out += [(names[x], names[min(part)]) for x in part]
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[v])
    return pd.DataFrame(out, columns=["id", "component"])


def compressed(todo: DataFrame, n_edges: int) -> tuple[DataFrame, int, DataFrame, DataFrame] | None:
    """Paths taken out of a graph of ``todo`` edges: (edges, their number, members, components), or None where too few nodes stand on paths.

    A path's nodes have one edge in and one out. They are in a component exactly
    if the nodes before and behind the path are in one, so an edge between these
    two stands for the path; ``members`` has (id, start, end) for its nodes. A
    path that closes on itself is a component, and is in ``components``.
    Each node jumps ahead to the node that the one it points to points to, more
    and more often in one round, so the rounds grow slower than the logarithm of
    the longest path.
    """
    into = todo.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n")).where("n = 1").select("id")
    out = todo.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"), F.min("target").alias("next")).where("n = 1").select("id", "next")
    nodes, n = cut_counted(out.join(into, "id"), "scc")
    if n * 20 < n_edges or not n:
        return None
    on_path = nodes.select(F.col("id").alias("next"), F.lit(True).alias("goes_on"))
    first = nodes.join(on_path, "next", "left").select("id", "next", F.coalesce("goes_on", F.lit(False)).alias("goes_on"))
    ends = first.where("not goes_on").select(F.col("id").alias("last"), F.col("next").alias("end"))
    jumps = first.select("id", F.when(F.col("goes_on"), F.col("next")).otherwise(F.col("id")).alias("jump"), "id").toDF("id", "jump", "low")
    jumps, _ = cut_counted(jumps, "scc")
    reach, joins = 1, 3
    while reach < n:  # a closed path never stops, and none is longer than all nodes
        step, ahead = jumps.withColumn("was", F.col("jump")), jumps.select(F.col("id").alias("jump"), F.col("jump").alias("to"), F.col("low").alias("below"))
        for _ in range(joins):
            step = step.join(ahead, "jump").select("id", F.col("to").alias("jump"), F.least("low", "below").alias("low"), "was")
        jumps, changed = cut_counted(step, "scc", F.count_if(F.col("jump") != F.col("was")))
        jumps = jumps.drop("was")
        reach, joins = reach * (joins + 1), min(2 * joins + 1, 31)
        if not changed:
            break
    last = jumps.join(ends, jumps.jump == ends.last, "left").select("id", "low", "last", "end")
    last, _ = cut_counted(last, "scc")
    entered = todo.join(last.where("last is not null").select(F.col("id").alias("target"), "last", "end"), "target")
    entered = entered.join(last.select(F.col("id").alias("source")), "source", "left_anti").select(F.col("source").alias("start"), "last", "end")
    members = last.where("last is not null").select("id", "last").join(entered, "last").select("id", "start", "end")
    off = todo.join(last.select(F.col("id").alias("source")), "source", "left_anti").join(last.select(F.col("id").alias("target")), "target", "left_anti")
    over = entered.select(F.col("start").alias("source"), F.col("end").alias("target")).where("source <> target")
    edges, left = cut_counted(off.select("source", "target").unionByName(over).distinct(), "scc")
    return edges, left, members, last.where("last is null").select("id", F.col("low").alias("component"))


def expanded(parts: DataFrame, members: DataFrame) -> DataFrame:
    """``parts`` (id, component) with the nodes of paths whose both ends are in one component, or are one node, which then is in it too."""
    of = lambda c: parts.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}"))
    both = members.join(of("start"), "start", "left").join(of("end"), "end", "left")
    loop = F.col("start") == F.col("end")
    own = both.where(loop | (F.col("c_start") == F.col("c_end"))).select("id", "start", F.coalesce("c_start", "start").alias("component"), (loop & F.col("c_start").isNull()).alias("new"))
    return parts.unionByName(own.select("id", "component")).unionByName(own.where("new").select(F.col("start").alias("id"), "component").distinct())


def raked(todo: DataFrame) -> tuple[DataFrame, int]:
    """The edges without those to nodes that have none out, or from nodes that have none in."""
    kept = todo.join(todo.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
    return cut_counted(kept.join(todo.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"), "scc")


def by_labels(todo: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(components found, edges left, their number): each node gets the least id that reaches it; in the set of a label, what can reach the label's node within the set is its component."""
    label = todo.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("label", F.col("id"))
    changed = 1
    while changed:  # forward labels
        seen = todo.join(label.select(F.col("id").alias("source"), "label"), "source").select(F.col("target").alias("id"), "label", F.lit(None).cast("boolean").alias("own"))
        new = label.withColumn("own", F.lit(True)).unionByName(seen).groupBy("id").agg(F.min("label").alias("label"), F.min(F.when(F.col("own"), F.col("label"))).alias("was"))
        label, changed = cut_counted(new, "scc", F.count_if(F.col("label") != F.col("was")))
        label = label.drop("was")
    inside = todo.join(label.select(F.col("id").alias("source"), F.col("label").alias("l1")), "source")
    inside, _ = cut_counted(inside.join(label.select(F.col("id").alias("target"), F.col("label").alias("l2")), "target").where("l1 = l2").select("source", "target", "l1"), "scc")
    reach, n = cut_counted(label.where("id = label").select("id", "label"), "scc")
    frontier = reach
    while n:  # backward from each label's node, inside its set
        step = inside.join(frontier.select(F.col("id").alias("target"), F.col("label").alias("l1")), ["target", "l1"]).select(F.col("source").alias("id"), F.col("l1").alias("label")).distinct()
        frontier, n = cut_counted(step.join(reach, ["id", "label"], "left_anti"), "scc")
        reach = cut_lineage(reach.unionByName(frontier), "scc") if n else reach
    sizes = reach.groupBy("label").count().where("count > 1").select("label")
    part = reach.join(sizes, "label", "left_semi").select("id", F.col("label").alias("component"))
    done = reach.select("id")
    left = inside.join(done.withColumnRenamed("id", "source"), "source", "left_anti").join(done.withColumnRenamed("id", "target"), "target", "left_anti")
    return part, *cut_counted(left.select("source", "target"), "scc")


def strong_components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(id, component) of the nodes in directed cycles of two or more nodes; component is the least id of the cycle's nodes.

    Up to ``task_edges`` edges are solved in one task. While there are more,
    paths are put together to single edges and dead ends are taken away, which
    leaves nothing of a chain or a tree after few rounds; where neither takes
    much away, components are found by labels. At last the nodes of paths join
    the components of their ends. Each step is a join and an aggregation over the
    edges left. Self-links and repeated edges do no harm; nulls match nothing.
    """
    todo, n = cut_counted(edges.select("source", "target").where("source <> target").distinct(), "scc")
    kind = dict(todo.dtypes)["source"]
    found: list[DataFrame] = []
    paths: list[DataFrame] = []
    while n > task_edges:
        before = n
        if step := compressed(todo, n):
            todo, n, members, closed = step
            paths.append(members)
            found.append(closed)
        if n > task_edges:
            todo, n = raked(todo)
        if n > task_edges and n * 4 > before * 3:
            part, todo, n = by_labels(todo)
            found.append(part)
    out = todo.groupBy(F.lit("all")).applyInPandas(_components_of, f"id {kind}, component {kind}")  # at most task_edges edges
    for part in found:
        out = out.unionByName(part)
    if not paths:
        return out
    for members in reversed(paths):
        out = cut_lineage(expanded(out, members), "scc")
    return out.join(out.groupBy("component").agg(F.min("id").alias("least")), "component").select("id", F.col("least").alias("component"))


def circular_edges(edges: DataFrame, all_edges: DataFrame | None = None) -> DataFrame:
    """``all_edges`` (or ``edges``) with ``is_circular``: both ends are in one component of the static, not type-only edges."""
    every = edges if all_edges is None else all_edges
    own = edges
    if "kind" in edges.columns:
        own = own.where("kind <> 'dynamic'")
    if "is_type_only" in edges.columns:
        own = own.where("not is_type_only")
    parts = cut_lineage(strong_components(own), "scc")
    out = every.join(parts.select(F.col("id").alias("source"), F.col("component").alias("cs")), "source", "left")
    out = out.join(parts.select(F.col("id").alias("target"), F.col("component").alias("ct")), "target", "left")
    return out.select(*every.columns, F.coalesce(F.col("cs") == F.col("ct"), F.lit(False)).alias("is_circular"))


def cycle_scores(nodes: DataFrame, circular: DataFrame, hubs: DataFrame) -> DataFrame:
    """(id, hub_score, cycle_score, importance): circular edges at a node, and min(100, hub + 5 cycle) to two places."""
    at = circular.where("is_circular").select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id")).groupBy("id").agg(F.count("*").alias("c"))
    own = nodes.select("id").join(hubs.select("id", "hub_score"), "id", "left").join(at, "id", "left")
    hub, cycle = F.coalesce("hub_score", F.lit(0.0)), F.coalesce("c", F.lit(0)).cast("long")
    return own.select("id", hub.alias("hub_score"), cycle.alias("cycle_score"), half_up(F.least(F.lit(100.0), hub + 5 * cycle), 2).alias("importance"))


def graph_stats(nodes: DataFrame, edges: DataFrame, functions: DataFrame | None = None, calls: DataFrame | None = None) -> DataFrame:
    """One row of counters of a graph; tables that aren't given count 0."""
    spark = nodes.sparkSession
    flag = lambda c, df: F.count_if(F.col(c)) if c in df.columns else F.lit(0)
    n = nodes.agg(
        F.count("*").alias("n_files"), flag("is_entry_point", nodes).alias("n_entry_points"), flag("is_dead_code", nodes).alias("n_dead"),
        (F.count_if(F.col("kind") == "test") if "kind" in nodes.columns else F.lit(0)).alias("n_tests"),
    )
    e = edges.agg(F.count("*").alias("n_edges"), flag("is_circular", edges).alias("n_circular"), (F.count_if(F.col("kind") == "dynamic") if "kind" in edges.columns else F.lit(0)).alias("n_dynamic"))
    f = (functions.agg(F.count("*").alias("n_functions")) if functions is not None else spark.createDataFrame([(0,)], "n_functions long"))
    c = (calls.agg(F.count("*").alias("n_calls")) if calls is not None else spark.createDataFrame([(0,)], "n_calls long"))
    return n.crossJoin(e).crossJoin(f).crossJoin(c).select(*[F.col(x).cast("long").alias(x) for x in n.columns + e.columns + f.columns + c.columns])  # one row each


def walk(edges: DataFrame, starts: DataFrame, depth: int, backward: bool = False) -> DataFrame:
    """(id, hop): nodes within ``depth`` edges of ``starts`` (column id) with their least hop, the starts at 0."""
    a, b = ("target", "source") if backward else ("source", "target")
    steps = edges.select(F.col(a).alias("id"), F.col(b).alias("to")).distinct()
    seen = cut_lineage(starts.select("id").distinct().withColumn("hop", F.lit(0).cast("long")), "walk")
    frontier = seen
    for hop in range(1, depth + 1):
        new = steps.join(frontier.select("id"), "id", "left_semi").select(F.col("to").alias("id")).distinct()
        frontier = cut_lineage(new.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop).cast("long")), "walk")
        if not frontier.count():
            break
        seen = seen.unionByName(frontier) if hop % CUT_EVERY else cut_lineage(seen.unionByName(frontier), "walk")
    return seen


def focus(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(id, hop_forward, hop_backward, is_cyclic) of all nodes that a walk in either direction meets, without the starts."""
    f = walk(edges, starts, depth).where("hop > 0").withColumnRenamed("hop", "hop_forward")
    b = walk(edges, starts, depth, backward=True).where("hop > 0").withColumnRenamed("hop", "hop_backward")
    return f.join(b, "id", "full").select("id", "hop_forward", "hop_backward", (F.col("hop_forward").isNotNull() & F.col("hop_backward").isNotNull()).alias("is_cyclic"))


def folder_bubbles(side: DataFrame, folder: Column, most: int = 5, total_most: int = 150, all_depths: bool = False, search: str | None = None) -> DataFrame:
    """(folder, n_files, mean_hop, is_collapsed) of one side of a focus (id, hop); folders over ``most`` files are collapsed.

    At all depths folders are collapsed too if the side has over ``total_most`` files.
    """
    own = side if search is None else side.where(F.lower("id").contains(search.lower()))
    groups = own.groupBy(folder.alias("folder")).agg(F.count("*").alias("n_files"), half_up(F.avg("hop")).cast("long").alias("mean_hop"))
    if not all_depths:
        return groups.withColumn("is_collapsed", F.col("n_files") > most)
    total = own.agg(F.count("*").alias("total"))
    return groups.crossJoin(F.broadcast(total)).withColumn("is_collapsed", (F.col("n_files") > most) | (F.col("total") > total_most)).drop("total")  # one row


def ghost_edges(edges: DataFrame, visible: DataFrame, most: int | None = 500) -> DataFrame:
    """(source, target): pairs of visible nodes joined through a hidden one and not directly, each once.

    ``most`` of them, the least by (source, target); None gives all.
    """
    show = visible.select("id").distinct()
    pairs = dealt(edges.select("source", "target"), "source", "target").distinct()
    into = pairs.join(merged(show.withColumnRenamed("id", "source")), "source", "left_semi").join(merged(show.withColumnRenamed("id", "target")), "target", "left_anti")
    out = pairs.join(merged(show.withColumnRenamed("id", "target")), "target", "left_semi").join(merged(show.withColumnRenamed("id", "source")), "source", "left_anti")
    bridged = into.select("source", F.col("target").alias("via")).join(merged(out.select(F.col("source").alias("via"), "target")), "via")
    bridged = dealt(bridged.where("source <> target").select("source", "target"), "source", "target").distinct().join(pairs, ["source", "target"], "left_anti")
    return bridged if most is None else bridged.orderBy("source", "target").limit(most)


def reveal(edges: DataFrame, node: str) -> DataFrame:
    """(id, direction): a node's neighbours as out, in or cyc."""
    out = edges.where(F.col("source") == node).select(F.col("target").alias("id"), F.lit(1).alias("o")).distinct()
    into = edges.where(F.col("target") == node).select(F.col("source").alias("id"), F.lit(1).alias("i")).distinct()
    return out.join(into, "id", "full").where(F.col("id") != node).select("id", F.when(F.col("o").isNull(), "in").when(F.col("i").isNull(), "out").otherwise("cyc").alias("direction"))


def back_edges(edges: DataFrame, groups: str, representatives: DataFrame | None = None) -> DataFrame:
    """(group, source, target): edges that close a cycle in a depth-first walk of each group's graph.

    Representative nodes (column id) come first, then nodes in order of id; the
    order decides which edge of a cycle closes it. A group's graph is walked in
    one task, as depth-first order is sequential.
    """
    import pandas as pd

    types = dict(edges.dtypes)
    schema = f"{groups} {types[groups]}, source {types['source']}, target {types['target']}"
    own = edges.select(groups, "source", "target").distinct().withColumn("rep", F.lit(False))
    if representatives is not None:
        reps = representatives.select(F.col("id").alias("source"), F.lit(True).alias("r")).distinct()
        own = own.join(reps, "source", "left").withColumn("rep", F.coalesce("r", F.lit(False))).drop("r")

    def closing(pdf: pd.DataFrame) -> pd.DataFrame:
        after: dict = {}
        for s, t in sorted(zip(pdf.source, pdf.target)):
            after.setdefault(s, []).append(t)
        first = sorted(set(pdf.source[pdf.rep]))
        state: dict = {}
        out = []
        for root in [*first, *sorted({*pdf.source, *pdf.target})]:
            if root in state:
                continue
            state[root] = 1
            stack = [(root, iter(after.get(root, ())))]
            while stack:
                node, rest = stack[-1]
                for t in rest:
                    if state.get(t) == 1:
                        out.append((node, t))
                    elif t not in state:
                        state[t] = 1
                        stack.append((t, iter(after.get(t, ()))))
                        break
                else:
                    state[node] = 2
                    stack.pop()
        return pd.DataFrame([(pdf[groups].iloc[0], s, t) for s, t in out], columns=[groups, "source", "target"])

    return own.groupBy(groups).applyInPandas(closing, schema)


def resolve_calls(calls: DataFrame, functions: DataFrame, rows: int = 0) -> DataFrame:
    """(source, target) of calls by name.

    ``calls`` has (caller, raw), ``functions`` (id, name, file, ord). A raw name
    is looked up as a whole among names and names' last dotted parts; a function
    of the caller's file goes first, then the first by ord, so a call has one
    row of each of two tables to join, however many functions share its name. Calls of oneself are
    dropped, repeated calls count once. ``rows`` is about how many calls there
    are: tasks grow in number with it, not in what they sort.
    """
    names = functions.select(
        F.col("id").alias("target"), F.col("file").alias("caller_file"), "ord",
        F.explode(F.array_distinct(F.array("name", F.element_at(F.split("name", r"\."), -1)))).alias("raw"),
    )
    least = F.min_by("target", F.struct("ord", "target"))
    near = dealt(names, "raw", "caller_file", rows=rows).groupBy("raw", "caller_file").agg(least.alias("near"))
    first = names.groupBy("raw").agg(least.alias("first"))
    own = dealt(calls.select("caller", "raw"), "caller", rows=rows).distinct().join(merged(functions.select(F.col("id").alias("caller"), F.col("file").alias("caller_file"))), "caller")
    found = dealt(own, "raw", "caller_file", rows=rows).join(merged(near), ["raw", "caller_file"], "left").join(first, "raw").select(F.col("caller").alias("source"), F.coalesce("near", "first").alias("target"))
    return dealt(found.where("source <> target"), "source", "target", rows=rows).distinct()


def called_by(functions: DataFrame, call_edges: DataFrame, rows: int = 0) -> DataFrame:
    """(id, n_callers, nth, caller): the reverse index of calls, each function with each of its callers.

    ``functions`` has (id, ord), ``call_edges`` (source, target), of which
    repeated ones count once. The callers of a function are numbered from 1 in
    the order of functions (ord, then id), those that are no functions last; a
    function that nothing calls has one row, with 0 callers and nulls. Edges to
    what is no function are dropped. The list of a function's callers is given
    as rows, so they may be any number. Where functions have ``label``, ids may
    be numbers, and labels are given. ``rows`` is about how many edges there are.
    """
    label = "label" in functions.columns
    own = dealt(functions, "id", rows=rows).groupBy("id").agg(F.min("ord").alias("ord"), *[F.min(c).alias(c) for c in ["label"] if label])
    known = lambda end: merged(own.withColumnRenamed("id", end))
    e = dealt(call_edges.select("source", "target"), "source", rows=rows).distinct().join(known("source").drop("label"), "source", "left")
    of = Window.partitionBy("target")
    nth = F.row_number().over(of.orderBy(F.col("ord").asc_nulls_last(), "source"))
    e = dealt(e, "target", rows=rows).select(F.col("target").alias("id"), "source", F.count("*").over(of).alias("n"), nth.cast("long").alias("nth"))
    x = own.drop("ord").join(merged(e), "id", "left").withColumn("n_callers", F.coalesce("n", F.lit(0)).cast("long"))
    if not label:
        return x.select("id", "n_callers", "nth", F.col("source").alias("caller"))
    # what nothing calls goes by itself, as rows without caller would all meet in one task
    x = dealt(x.select(F.col("label").alias("id"), "n_callers", "nth", F.coalesce("source", "id").alias("by")), "by", rows=rows).join(known("by").drop("ord"), "by", "left")
    return x.select("id", "n_callers", "nth", F.when(F.col("nth").isNotNull(), F.col("label")).alias("caller"))


def caller_counts(functions: DataFrame, call_edges: DataFrame) -> DataFrame:
    """(id, n_callers, first_caller) of functions, for those who need no callers themselves (`called_by`)."""
    per = call_edges.select("source", "target").distinct().groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"), F.min("source").alias("first_caller"))
    return functions.select("id").join(merged(per), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_callers"), "first_caller")


def functions_of_files(functions: DataFrame) -> DataFrame:
    """(file, functions): the functions (file, name, ord) of each file as structs (ord, name) in their order."""
    return functions.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("functions"))


def edges_of_file(call_edges: DataFrame, functions: DataFrame) -> DataFrame:
    """(file, source, target): call edges with an end in each file, each once; every edge gets the files of both ends and has a row for each of these."""
    where = functions.groupBy("id").agg(F.collect_set("file").alias("files"))
    at = lambda end: where.select(F.col("id").alias(end), F.col("files").alias(f"{end}_files"))
    edges = call_edges.select("source", "target").distinct().join(merged(at("source")), "source", "left").join(merged(at("target")), "target", "left")
    none = F.array().cast("array<string>")
    return edges.select(F.explode(F.array_union(F.coalesce("source_files", none), F.coalesce("target_files", none))).alias("file"), "source", "target")


def most_connected(nodes: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """(id, degree) of the existing nodes with most edges at either end."""
    d = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return d.join(nodes.select("id").distinct(), "id", "left_semi").orderBy(F.desc("degree"), "id").limit(most)


def hub_threshold(degree: DataFrame, default: int = 3) -> DataFrame:
    """The degree at place floor(0.2 n) of all degrees in descending order (counted from 0), a single row (hub_threshold).

    Degrees are counted by value first, so no task sorts all nodes.
    """
    counts = degree.groupBy("degree").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("degree"))))  # a row for each distinct degree
    at = upto.crossJoin(F.broadcast(total)).where(F.col("upto") > F.floor(F.col("total") * 0.2))
    return at.agg(F.coalesce(F.max("degree"), F.lit(default)).cast("long").alias("hub_threshold"))


def histogram(nodes: DataFrame, column: str) -> DataFrame:
    """(value, n), the most frequent first."""
    return nodes.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def dominant(nodes: DataFrame, column: str) -> DataFrame:
    """The most frequent value of a column; of equals the one that comes first in order."""
    counts = nodes.groupBy(column).agg(F.count("*").alias("n"))
    return counts.agg(F.min_by(column, F.struct(-F.col("n"), column)).alias("value"), F.max("n").alias("n"))


def neighbours(edges: DataFrame, node: str, most: int = 5) -> DataFrame:
    """(id) of nodes joined to a node in either direction, ``most`` of them in order of id."""
    both = edges.where(F.col("source") == node).select(F.col("target").alias("id")).unionByName(edges.where(F.col("target") == node).select(F.col("source").alias("id")))
    return both.distinct().orderBy("id").limit(most)


def display_importance(in_degree: Column, out_degree: Column, is_representative: Column) -> Column:
    return in_degree * 1.2 + out_degree + F.when(is_representative, 5).otherwise(0)
