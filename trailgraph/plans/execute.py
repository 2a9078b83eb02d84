"""Paths over a graph: one join a step, distinct after each, nothing collected.

A frontier is ``query_id, entity, node``.  Steps read one label's slice of the edge table each; sides are never
broadcast by hint, the optimiser decides by their size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailgraph.operators.graph import Graph
from trailgraph.plans.steps import Combine, Filter, Hop, Select, Step, Trie, TypeKeep, TypeSeed, compile_path, is_dead, parse_path, path_trie
from trailgraph.sources.readers import in_order
from trailgraph.storage import stored

STATE = ["query_id", "entity", "node"]
#: Parts that rows which hold for all entities are dealt to where they are multiplied.
SHARED_PARTS = 64
#: Entities of one row of a batch's frontier, and nodes of one row of a counted hop's lists, at most.
BLOCK = 1 << 18
#: Nodes of all lists that one entity is counted by, at most; an entity that may have more is counted by rows.
LISTED = 1 << 22


def start(spark: SparkSession, entities: Sequence[str], query_id: int = 0) -> DataFrame:
    """Each entity as its own frontier.  It comes as an Arrow table, whose size the optimiser knows, so that a label's edges stay
    where they are for the first hop."""
    names = pa.array(list(dict.fromkeys(entities)), pa.string())
    rows = pa.table({"query_id": pa.array([query_id] * len(names), pa.int64()), "entity": names, "node": names})
    return spark.createDataFrame(rows, "query_id long, entity string, node string")


def _matches(text: Column, step: Filter) -> Column:
    """Literal substrings, never patterns."""
    hits = [F.contains(F.lower(text), F.lit(w)) for w in step.words]
    return reduce(lambda a, b: a & b if step.every else a | b, hits)


def hopped(graph: Graph, frontier: DataFrame, step: Hop) -> DataFrame:
    """Where a frontier's edges of a label lead, a row an edge."""
    return frontier.join(graph.slice(step.label), F.col("node") == F.col("src")).select("query_id", "entity", F.col("dst").alias("node"))


def advance(graph: Graph, frontier: DataFrame, step: Step) -> DataFrame:
    """The frontier after a step that changes it."""
    if isinstance(step, Hop):
        return hopped(graph, frontier, step).distinct()
    if isinstance(step, TypeKeep):
        return frontier.join(graph.slice(step.label), F.col("node") == F.col("src"), "left_semi")
    if isinstance(step, Filter):
        described = (graph.descriptions() if graph.index is None else graph.index.candidates(step.words, step.every)).filter(_matches(F.col("dst"), step))
        return frontier.join(described, F.col("node") == F.col("src"), "left_semi")
    return frontier


def blind_start(graph: Graph, first: Step, query_id: int = 0) -> DataFrame:
    """Without an entity: what the first step reaches from anywhere (a type step: its sources)."""
    if isinstance(first, Filter):
        label, column = f"filter {first.text}", "dst"
    else:
        label, column = first.label, "src" if isinstance(first, TypeKeep) else "dst"
    return graph.slice(label).select(F.lit(query_id).cast("long").alias("query_id"), F.lit(None).cast("string").alias("entity"), F.col(column).alias("node")).distinct()


def follow(graph: Graph, spark: SparkSession, entities: Sequence[str], path: str | Sequence[str], labels: frozenset[str] | None = None) -> DataFrame:
    """``node``: the final set of a path from one entity, or from a blind start.  ``labels``: all labels there are, to
    answer paths over missing ones without a scan."""
    steps = compile_path(path, "single")
    if labels is not None and is_dead(steps, labels):
        return spark.createDataFrame([], "node string")
    if len(entities) == 1:
        state = start(spark, entities)
    elif steps:
        state = blind_start(graph, steps[0])
    else:
        return spark.createDataFrame([], "node string")
    for number, step in enumerate(steps):
        if number and isinstance(step, Hop):
            state = stored(state)  # its size is known then: a small one goes to the label's edges, which are not moved
        state = advance(graph, state, step)
    return state.select("node").distinct()


def of_each_entity(shared: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows that hold for every entity, for each of them.

    The result is as large as is asked for; each row meets the entities by the number it is dealt to, one of
    ``SHARED_PARTS``, so that neither side is collected or broadcast because of its kind.
    """
    others = [c for c in shared.columns if c not in ("query_id", "entity")]
    dealt = shared.select(*others, F.pmod(F.xxhash64("node"), F.lit(SHARED_PARTS)).alias("__part"))
    each = entities.select("query_id", "entity", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARED_PARTS - 1).cast("long"))).alias("__of_part"))
    return dealt.join(each, F.col("__part") == F.col("__of_part")).select("query_id", "entity", *others)


@dataclass
class Frontier:
    """A state after a step: rows for an entity each or (``shared``) rows that hold for all of them."""

    rows: DataFrame
    shared: bool

    def expanded(self, entities: DataFrame) -> DataFrame:
        return of_each_entity(self.rows, entities) if self.shared else self.rows


@dataclass
class Traversal:
    """What a path reached from several entities, in factors: ``own`` has query_id, entity, node_type, node of the hops before a
    type seed, ``shared`` has node_type, node of those after it, which hold for each of ``entities`` (query_id, entity).
    ``combined``: the exec steps' sets by step number; ``frontiers``: the state after each step."""

    entities: DataFrame
    own: DataFrame
    shared: DataFrame
    combined: dict[int, DataFrame] = field(default_factory=dict)
    errors: dict[int, str] = field(default_factory=dict)
    frontiers: list[Frontier] = field(default_factory=list)
    has_shared: bool = False

    @property
    def results(self) -> DataFrame:
        """``query_id, entity, node_type, node`` over all hops: the factors multiplied."""
        if not self.has_shared:
            return self.own  # distinct already
        return self.own.unionByName(of_each_entity(self.shared, self.entities)).distinct()


def combine(own: DataFrame, shared: DataFrame, step: Combine, entities: DataFrame) -> DataFrame:
    """``query_id, node`` of an exec step over the results so far, in factors: what is shared, all entities of each query
    reached, and the others are counted."""
    n = entities.groupBy("query_id").agg(F.countDistinct("entity").alias("n_entities"))
    all_of = shared.filter(F.col("node_type") == step.node_type).select("node").distinct()
    counted = own.filter(F.col("node_type") == step.node_type).groupBy("query_id", "node").agg(F.countDistinct("entity").alias("n"))
    alone = counted.join(all_of, "node", "left_anti").join(n, "query_id").select("query_id", "node", "n", "n_entities")
    every = of_each_entity(all_of, n.withColumn("entity", F.lit(None).cast("string"))).drop("entity").join(n, "query_id").select("query_id", "node", F.col("n_entities").alias("n"), "n_entities")
    wanted = F.col("n") == F.col("n_entities") if step.operation == "common" else F.col("n") % 2 == 1
    return alone.unionByName(every).filter(wanted).select("query_id", "node")


def follow_many(graph: Graph, state: DataFrame, path: str | Sequence[str]) -> Traversal:
    """A path with a state for each entity of ``state`` (query_id, entity, node).

    After a type seed all entities are at the same nodes: frontier and results are kept once from there on, without an
    entity, and multiplied with the entities only where somebody asks for it.
    """
    entities = state.select("query_id", "entity").distinct()
    none = state.sparkSession.createDataFrame([], "query_id long, entity string, node_type string, node string")
    own: list[DataFrame] = []  # query_id, entity, node
    common = [none.select("node_type", "node")]

    def typed(hops: list[DataFrame]) -> DataFrame:
        """What hops reached, each once, with its type.  Most rows are different: none are merged before they are dealt, which
        would only fill and spill a task's memory."""
        if not hops:
            return none
        once = reduce(DataFrame.unionByName, hops).repartition(*STATE).distinct()
        return once.join(graph.types, F.col("node") == F.col("name"), "left").select("query_id", "entity", "node_type", "node")

    out = Traversal(entities, none, none.select("node_type", "node"))
    shared = False
    steps = compile_path(path, "multi")
    for number, step in enumerate(steps, 1):
        if isinstance(step, Combine):
            if step.operation in ("common", "difference"):
                out.combined[number] = combine(typed(own), reduce(DataFrame.unionByName, common), step, entities)
            else:
                out.errors[number] = f"Unknown operation '{step.operation}'."
        elif isinstance(step, TypeSeed):
            nowhere = [F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("string").alias("entity")]
            state, shared = graph.slice(step.label).select(*nowhere, F.col("src").alias("node")).distinct(), True
        elif not isinstance(step, Select):
            before, state = state, advance(graph, state, step)
            if isinstance(step, Hop):
                if shared:
                    common.append(state.join(graph.types, F.col("node") == F.col("name"), "left").select("node_type", "node"))
                else:
                    # Nothing goes on from the last hop: its rows are made distinct with those of the others alone.
                    goes_on = any(isinstance(s, Hop | Filter) for s in steps[number:])
                    own.append(state if goes_on else hopped(graph, before, step))
        out.frontiers.append(Frontier(state, shared))
    out.own = typed(own)
    out.shared = reduce(DataFrame.unionByName, common[1:] or common).distinct()
    out.has_shared = len(common) > 1
    return out


def _rows_counted(graph: Graph, rows: DataFrame) -> DataFrame:
    """``query_id, entity, node_type, n`` of rows (query_id, entity, node), each counted once."""
    typed = rows.repartition(*STATE).distinct().join(graph.types, F.col("node") == F.col("name"), "left")
    return typed.groupBy("query_id", "entity", "node_type").agg(F.count(F.lit(1)).alias("n"))


def count_many(graph: Graph, state: DataFrame, path: str | Sequence[str]) -> DataFrame:
    """``query_id, entity, node_type, n``: how many different nodes of each type every entity of ``state`` reaches over all hops, as
    counted over the results of ``follow_many``.

    The last hop, which reaches most, is followed by lists: its targets are numbered, each source has the numbers of its targets
    in rows of at most ``BLOCK``, and an entity's lists are dealt to it and made one.  No row is made for an entity and a node.
    Entities whose lists might hold more than ``LISTED`` numbers are counted by rows.
    """
    steps = [s for s in compile_path(path, "multi") if not isinstance(s, Select | Combine)]
    hops = [k for k, s in enumerate(steps) if isinstance(s, Hop)]
    if not hops or any(isinstance(s, TypeSeed) for s in steps):
        return follow_many(graph, state, path).results.groupBy("query_id", "entity", "node_type").agg(F.count(F.lit(1)).alias("n"))
    label = steps[hops[-1]].label
    earlier = [state.limit(0).select(*STATE)]
    for step in steps[: hops[-1]]:
        state = advance(graph, state, step)
        if isinstance(step, Hop):
            state = stored(state)  # read for the next hop and for what is counted
            earlier.append(state)
    rows = reduce(DataFrame.unionByName, earlier)
    targets = in_order(graph.slice(label).select("dst").distinct(), "dst").join(graph.types, F.col("dst") == F.col("name"), "left")
    targets = stored(targets.select(F.col("dst").alias("target"), "node_type", F.floor(F.col("number") / BLOCK).alias("block"), (F.col("number") % BLOCK).cast("int").alias("at")))
    edges = graph.slice(label).join(targets, F.col("dst") == F.col("target")).select("src", "node_type", "block", "at")
    lists = stored(edges.repartition("src").groupBy("src", "node_type", "block").agg(F.collect_list("at").alias("nodes")))
    longest = lists.groupBy("src").agg(F.sum(F.size("nodes")).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    sizes = state.select("query_id", "entity").unionByName(rows.select("query_id", "entity")).groupBy("query_id", "entity").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.filter(F.col("n") * F.lit(max(longest, 1)) > LISTED).select(F.col("query_id").alias("of_query"), F.col("entity").alias("of_entity"))
    mine = (F.col("query_id") == F.col("of_query")) & (F.col("entity") == F.col("of_entity"))
    found = []
    large = stored(large)
    if not large.isEmpty():
        by_rows = rows.unionByName(hopped(graph, state, Hop(label))).join(large, mine, "left_semi")
        found.append(_rows_counted(graph, by_rows))
        state, rows = state.join(large, mine, "left_anti"), rows.join(large, mine, "left_anti")
    # What earlier hops reached is counted by the same lists where it is a target of the last one too, else by rows.
    again = rows.join(targets, F.col("node") == F.col("target")).select("query_id", "entity", "node_type", "block", F.array("at").alias("nodes"))
    others = rows.join(targets, F.col("node") == F.col("target"), "left_anti")
    listed = state.join(lists, F.col("node") == F.col("src")).select("query_id", "entity", "node_type", "block", "nodes").unionByName(again)
    once = F.size(F.array_distinct(F.flatten(F.collect_list("nodes")))).cast("long").alias("n")
    found += [listed.repartition("query_id", "entity").groupBy("query_id", "entity", "node_type", "block").agg(once).drop("block"), _rows_counted(graph, others)]
    return reduce(DataFrame.unionByName, found).groupBy("query_id", "entity", "node_type").agg(F.sum("n").alias("n"))


def _reached(graph: Graph, asked: DataFrame, trie: Trie) -> tuple[DataFrame, DataFrame]:
    """``entity, number`` of all entities, and ``end, node, block, who``: which of them each path's end reaches.

    asked: entity, end.  What begins alike is followed once for an entity.  A frontier is kept by node: a row has the trie's node,
    the graph's node and the numbers of the entities that are there, in blocks of ``BLOCK``, so that a node that all reach is
    no single row; entities that ask for the same ends share rows.  A depth costs one join for all hops, one for all
    type steps and one for all filters; hops alone are dealt again.
    """
    spark = asked.sparkSession
    plans = asked.select("entity", "end").distinct().groupBy("entity").agg(F.sort_array(F.collect_list("end")).alias("ends"))
    numbered = in_order(plans, "entity")
    under = {s.node: [end for end in sorted(set(trie.ends.values())) if s.node in trie.route(end)] for s in trie.steps}
    state = numbered.select(F.lit(0).alias("trie"), "ends", F.col("entity").alias("node"), F.floor(F.col("number") / BLOCK).alias("block"), F.array((F.col("number") % BLOCK).cast("int")).alias("who"))
    parts = [spark.createDataFrame([], "end int, node string, block long, who array<int>")]
    last = max((s.depth for s in trie.steps), default=0)
    for depth in range(last + 1):
        if ended := [end for end in set(trie.ends.values()) if trie.depth(end) == depth]:
            parts.append(state.filter(F.col("trie").isin(ended) & F.array_contains("ends", F.col("trie"))).select(F.col("trie").alias("end"), "node", "block", "who"))
        at = [s for s in trie.steps if s.depth == depth + 1]
        if not at:
            break
        steps = spark.createDataFrame([(s.node, s.parent, *_as_row(s.step), under[s.node]) for s in at], "next int, parent int, kind string, label string, under array<int>")
        # One row a step: as bounded as the paths.
        going = state.join(F.broadcast(steps), (F.col("trie") == F.col("parent")) & F.arrays_overlap("ends", "under"))
        moved: list[DataFrame] = []
        for kind in dict.fromkeys(_as_row(s.step)[0] for s in at):
            mine = going.filter(F.col("kind") == kind)
            if kind == "filter":
                # The texts stay where they are: a description goes on as the steps that it meets.
                met = F.array_compact(F.array(*[F.when(_matches(F.col("dst"), s.step), F.lit(s.node)) for s in at if isinstance(s.step, Filter)]))
                described = graph.descriptions().select("src", F.explode(met).alias("of_next"))
                mine = mine.join(described, (F.col("next") == F.col("of_next")) & (F.col("node") == F.col("src")), "left_semi")
            else:
                labels = sorted({s.step.label for s in at if _as_row(s.step)[0] == kind})
                edges = graph.edges.filter(F.col("label").isin(labels)).select(F.col("label").alias("of_label"), "src", "dst")
                mine = mine.join(edges, (F.col("label") == F.col("of_label")) & (F.col("node") == F.col("src")), "inner" if kind == "hop" else "left_semi")
            rows = mine.select(F.col("next").alias("trie"), "ends", F.col("dst" if kind == "hop" else "node").alias("node"), "block", "who")
            # A type step or a filter keeps rows as they are, and each trie node has one kind.
            moved.append(_gathered(rows) if kind == "hop" else rows)
        state = reduce(DataFrame.unionByName, moved)
        if depth + 1 < last:
            state = stored(state)
    return numbered.select("entity", "number"), reduce(DataFrame.unionByName, parts)


def _gathered(rows: DataFrame) -> DataFrame:
    """Rows of a frontier of which there is one a trie node, node and block, with each entity once."""
    dealt = rows.repartition("trie", "node", "block")
    return dealt.groupBy("trie", "node", "block", "ends").agg(F.array_distinct(F.flatten(F.collect_list("who"))).alias("who")).select("trie", "ends", "node", "block", "who")


def _asked(queries: DataFrame, trie: Trie, *columns: str) -> DataFrame:
    """The columns of the queries, with the trie node where each one's path ends."""
    ends = queries.sparkSession.createDataFrame(list(trie.ends.items()), "path_id long, end int")
    return queries.filter("entity is not null").select(*columns).distinct().join(F.broadcast(ends), "path_id")  # one row a path


def follow_batch(graph: Graph, queries: DataFrame, paths: Mapping[int, Sequence[str]]) -> DataFrame:
    """``query_id, node``: the final sets of many single-entity queries at once.

    queries: query_id, entity and, where several queries have one path, path_id (else it is the query_id).
    """
    trie = path_trie(paths)
    own = queries.select(F.col("query_id").cast("long"), "entity", F.col("path_id" if "path_id" in queries.columns else "query_id").cast("long").alias("path_id"))
    asked = stored(_asked(own, trie, "query_id", "entity", "path_id"))
    numbered, reached = _reached(graph, asked, trie)
    of = asked.join(numbered, "entity").select("query_id", F.col("end").alias("of_end"), "number")
    each = reached.select("end", "node", "block", F.explode("who").alias("at")).select("end", "node", (F.col("block") * BLOCK + F.col("at")).alias("of_number"))
    # What an entity reaches at an end is there once, and a query has one end.
    return each.join(of, (F.col("end") == F.col("of_end")) & (F.col("of_number") == F.col("number"))).select("query_id", "node")


def count_batch(graph: Graph, queries: DataFrame, paths: Mapping[int, Sequence[str]]) -> DataFrame:
    """``path_id, node, n``: how many entities reach each node by each path.  queries: path_id, entity; who reaches a node is counted
    where it is gathered, and no row is made for it."""
    trie = path_trie(paths)
    asked = stored(_asked(queries.select(F.col("path_id").cast("long"), "entity"), trie, "path_id", "entity"))
    ends = queries.sparkSession.createDataFrame(list(trie.ends.items()), "path_id long, of_end int")
    # Paths that end alike share an end: an entity counts for those that it asked for.
    alike = {end for end in trie.ends.values() if list(trie.ends.values()).count(end) > 1}
    numbered, reached = _reached(graph, asked, trie)
    counted = reached.filter(~F.col("end").isin(list(alike))).join(F.broadcast(ends), F.col("end") == F.col("of_end")).select("path_id", "node", F.size("who").cast("long").alias("n"))
    if alike:
        of = asked.filter(F.col("end").isin(list(alike))).join(numbered, "entity").select("path_id", F.col("end").alias("of_end"), "number")
        each = reached.filter(F.col("end").isin(list(alike))).select("end", "node", "block", F.explode("who").alias("at")).select("end", "node", (F.col("block") * BLOCK + F.col("at")).alias("of_number"))
        counted = counted.unionByName(each.join(of, (F.col("end") == F.col("of_end")) & (F.col("of_number") == F.col("number"))).select("path_id", "node", F.lit(1).cast("long").alias("n")))
    return counted.groupBy("path_id", "node").agg(F.sum("n").alias("n"))


def _as_row(step: Step) -> tuple[str, str | None]:
    """A step's kind and label."""
    if isinstance(step, Filter):
        return "filter", None
    return "keep" if isinstance(step, TypeKeep) else "hop", step.label


def trace(graph: Graph, state: DataFrame, path: str | Sequence[str], relation_texts: DataFrame | None = None) -> DataFrame:
    """``step, ord, line``: what each step of a single-mode path reached, for reading, in order.

    relation_texts: source, target, description, line_no; the first text of a followed edge is added to its line.
    """
    steps = parse_path(path) if isinstance(path, str) else list(path)
    lines: list[DataFrame] = []
    for number, (text, step) in enumerate(zip(steps, compile_path(steps, "single")), 1):
        after = advance(graph, state, step)
        if isinstance(step, Filter):
            kind = after.join(graph.types, F.col("node") == F.col("name"), "left").agg(F.min("node_type").alias("t"))
            head = kind.select(F.concat(F.lit(f"[!] Step {number}: Filtering "), F.coalesce("t", F.lit("None")), F.lit(f" nodes by '{step.text}'.")).alias("line"))
        else:
            head = state.sparkSession.createDataFrame([(f"[!] Step {number}: Following relation '{text}'. Results:",)], "line string")
        body = after.select(F.concat(F.lit("   - "), "node").alias("line"))
        if isinstance(step, Hop) and relation_texts is not None:
            first = relation_texts.groupBy("source", "target").agg(F.min_by("description", "line_no").alias("description"))
            hop = state.join(graph.slice(step.label), F.col("node") == F.col("src"))
            told = hop.join(first, (F.col("src") == F.col("source")) & (F.col("dst") == F.col("target")), "left")
            body = told.select(F.concat(F.lit("   - "), "dst", F.coalesce(F.concat(F.lit(": "), "description"), F.lit(""))).alias("line")).distinct()
        for order, part in enumerate((head, body)):
            lines.append(part.select(F.lit(number).alias("step"), F.lit(order).alias("ord"), "line"))
        state = after
    return reduce(DataFrame.unionByName, lines).sort("step", "ord", "line")


def trace_many(graph: Graph, state: DataFrame, path: str | Sequence[str]) -> DataFrame:
    """``step, entity, ord, line`` of a multi-mode path, in order; entity is null for lines about all of them."""
    steps = parse_path(path) if isinstance(path, str) else list(path)
    entities = state.select("entity").distinct()
    out = follow_many(graph, state, steps)
    lines: list[DataFrame] = []

    def add(number: int, order: int, rows: DataFrame, line: Column, entity: Column | None = None) -> None:
        lines.append(rows.select(F.lit(number).alias("step"), (F.lit(None).cast("string") if entity is None else entity).alias("entity"), F.lit(order).alias("ord"), line.alias("line")))

    one = state.sparkSession.range(1)
    item = F.concat(F.lit("   - "), "node")
    for number, (text, step, frontier) in enumerate(zip(steps, compile_path(steps, "multi"), out.frontiers), 1):
        head, after = f"[!] Step {number}: ", frontier.expanded(state.select("query_id", "entity").distinct())
        if isinstance(step, Select):
            add(number, 0, one, F.lit(f"{head}Selecting entities. Results:"))
            add(number, 1, entities, F.concat(F.lit("   - "), "entity"))
        elif isinstance(step, Combine):
            if number in out.errors:
                add(number, 0, one, F.lit(f"[ERROR] {out.errors[number]}"))
            add(number, 1, one, F.lit(f"{head}{step.operation.capitalize()} results for type '{step.node_type}'."))
            if number in out.combined:
                add(number, 2, out.combined[number], item)
        elif isinstance(step, Hop):
            add(number, 0, entities, F.lit(f"{head}Following relation '{text}'."), F.col("entity"))
            typed = after.join(graph.types, F.col("node") == F.col("name"), "left")
            add(number, 1, typed, F.concat(item, F.lit(" ("), F.coalesce("node_type", F.lit("None")), F.lit(")")), F.col("entity"))
        else:
            n = entities.join(after.groupBy(F.col("entity").alias("of")).agg(F.count(F.lit(1)).alias("n")), F.col("entity") == F.col("of"), "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("string"))
            told = (f"{head}Filtering nodes by keywords '{step.text}'. Kept ", " nodes.") if isinstance(step, Filter) else (f"{head}Seeding from relation '{text}'. Found ", " sources.")
            add(number, 0, n, F.concat(F.lit(told[0]), "n", F.lit(told[1])), F.col("entity"))
            add(number, 1, after, item, F.col("entity"))
    return reduce(DataFrame.unionByName, lines).sort("step", "entity", "ord", "line")
