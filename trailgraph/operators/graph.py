"""The edge table: one label for each (source, target), and what is derived from it.

Every order-dependent choice is an aggregate over the edge's position, with a string as the last tie-break, so that
results don't depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailgraph.operators.text_index import TextIndex
from trailgraph.storage import stored
from trailgraph.vocabulary import DESCRIPTION

#: Edges to a target, on average, of a label whose edges are counted before they are dealt, and targets of all these labels, at most.
HUB_EDGES, HUB_TARGETS = 8, 1 << 20


def canonical(edges: DataFrame) -> DataFrame:
    """``src, dst, label, pos`` from ``src, dst, label, seq``: a later edge takes the label, the place stays the first's."""
    return edges.groupBy("src", "dst").agg(F.max(F.struct("seq", "label")).alias("last"), F.min("seq").alias("pos")).select("src", "dst", F.col("last.label").alias("label"), "pos")


def canonical_by_number(edges: DataFrame, labels: Iterable[str], last_place: int) -> DataFrame:
    """The same where all ``labels`` that may occur are known, and no place is negative or above ``last_place``.

    Labels are numbered in their order, and a number is packed with the place in one long, so that edges are aggregated by
    hash and shuffled without their labels; a text among the aggregates would have all edges sorted.  A label that wasn't
    stated fails the job.  Too many labels for one long are left to ``canonical``.
    """
    names = sorted(set(labels))
    bits = len(names).bit_length()
    if last_place >> (63 - bits):
        return canonical(edges)
    codes = edges.sparkSession.createDataFrame(list(enumerate(names, 1)), "code long, name string")
    unknown = F.raise_error(F.concat(F.lit("not among the stated labels: "), "label")).cast("long")
    code = F.when(F.col("label").isNull(), 0).otherwise(F.coalesce("code", unknown))
    packed = edges.join(codes, F.col("label") == F.col("name"), "left").select("src", "dst", "seq", (F.shiftleft("seq", bits) + code).alias("packed"))
    last = packed.groupBy("src", "dst").agg(F.max("packed").alias("last"), F.min("seq").alias("pos"))
    return last.join(codes, F.col("last").bitwiseAND(F.lit((1 << bits) - 1)) == F.col("code"), "left").select("src", "dst", F.col("name").alias("label"), "pos")


def multigraph(edges: DataFrame) -> DataFrame:
    """All different labels of a (source, target), each at its first place."""
    return edges.groupBy("src", "dst", "label").agg(F.min("seq").alias("pos"))


@dataclass(frozen=True)
class Labels:
    """All labels that may occur, numbered in their order from 1; a number is packed with the edge's place in one long, so that
    edges are aggregated by hash and shuffled without their labels."""

    names: tuple[str, ...]

    @classmethod
    def of(cls, labels: Iterable[str]) -> "Labels":
        return cls(tuple(sorted(set(labels))))

    @property
    def bits(self) -> int:
        return len(self.names).bit_length()

    def fit(self, last_place: int) -> bool:
        return not last_place >> (63 - self.bits)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.names, 1)), "code long, name string")

    def packed(self, seq: Column, code: Column | int) -> Column:
        return F.shiftleft(seq, self.bits) + code

    def named(self, edges: DataFrame, packed: Column) -> DataFrame:
        """Adds ``name``, the label that is packed; there are no more than fit beside a place."""
        return edges.join(F.broadcast(self.table(edges.sparkSession)), packed.bitwiseAND(F.lit((1 << self.bits) - 1)) == F.col("code"), "left").drop("code")


def both_ways(src: Column, dst: Column, packed: Column, back: Column | None = None) -> Column:
    """An edge, and the one that leads back where the same row gives both, as ``a, b, turned, packed, back``: from ``a`` to ``b``, or
    (``turned``) from ``b`` to ``a``; null without one of the ends.  The ends are in their order, so that all edges between two
    nodes meet; ``back`` is kept as a difference, which is one number for most rows."""
    other = F.lit(None).cast("long") if back is None else back - packed
    made = F.struct(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"), (src > dst).alias("turned"), packed.alias("packed"), other.alias("back"))
    return F.when(src.isNotNull() & dst.isNotNull(), made)


def _dealt(pairs: DataFrame, parts: int | None) -> DataFrame:
    """``a, b, turned, packed``, one row an edge, dealt by the two nodes.  Hardly any edge is there twice: what a task has is not
    merged before it is dealt, which would only fill and spill its memory.  A pair that very many rows have is one
    task's, which holds one row of it."""
    at = ["a", "b"] if parts is None else [parts, "a", "b"]
    one = F.struct("turned", "packed")
    other = F.when(F.col("back").isNotNull(), F.struct((~F.col("turned") & (F.col("a") != F.col("b"))).alias("turned"), (F.col("packed") + F.col("back")).alias("packed")))
    each = pairs.repartition(*at).select("a", "b", F.explode(F.array(one, other)).alias("e"))
    return each.filter("e is not null").select("a", "b", "e.turned", "e.packed")


def _ends() -> list[Column]:
    return [F.when(F.col("turned"), F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("b", "a", "src"), ("a", "b", "dst"))]


def canonical_of_pairs(pairs: DataFrame, labels: Labels, parts: int | None = None) -> DataFrame:
    """As ``canonical``, from rows of ``both_ways``, shuffled once: two edges that lead to and fro are one row until they are
    dealt.  parts: how many tasks merge; none: as many as a shuffle has."""
    last = _dealt(pairs, parts).groupBy("a", "b", "turned").agg(F.max("packed").alias("last"), F.min("packed").alias("first"))
    return labels.named(last, F.col("last")).select(*_ends(), F.col("name").alias("label"), F.shiftright("first", labels.bits).alias("pos"))


def multigraph_of_pairs(pairs: DataFrame, labels: Labels, parts: int | None = None) -> DataFrame:
    """As ``multigraph``, in the same way."""
    code = F.col("packed").bitwiseAND(F.lit((1 << labels.bits) - 1))
    each = _dealt(pairs, parts).groupBy("a", "b", "turned", code.alias("of_label")).agg(F.min("packed").alias("first"))
    return labels.named(each, F.col("first")).select(*_ends(), F.col("name").alias("label"), F.shiftright("first", labels.bits).alias("pos"))


@dataclass
class Graph:
    """``edges``: src, dst, label, pos.  ``types``: name, node_type.  Both may be tables written by label.  ``index``: of the
    descriptions, where there is one: keyword filters then read the candidates alone."""

    edges: DataFrame
    types: DataFrame
    index: TextIndex | None = None
    _kept: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that is derived from the graph, written when it is first asked for and read from then on."""
        if name not in self._kept:
            self._kept[name] = stored(make())
        return self._kept[name]

    @classmethod
    def of(cls, edges: DataFrame) -> "Graph":
        return cls(edges, node_types(edges))

    def slice(self, label: str) -> DataFrame:
        """Edges of one label: one directory of a store written by label."""
        return self.edges.filter(F.col("label") == label).select("src", "dst")

    def descriptions(self) -> DataFrame:
        return self.slice(DESCRIPTION)


def nodes(edges: DataFrame) -> DataFrame:
    """``name, first_pos`` of every node."""
    both = edges.select(F.col("src").alias("name"), "pos").unionByName(edges.select(F.col("dst").alias("name"), "pos"))
    return both.groupBy("name").agg(F.min("pos").alias("first_pos"))


def node_types(edges: DataFrame) -> DataFrame:
    """``name, node_type``: the target of a node's first edge whose label contains "type"."""
    typed = edges.filter(F.contains("label", F.lit("type")))
    return typed.groupBy(F.col("src").alias("name")).agg(F.min(F.struct("pos", "dst")).alias("first")).select("name", F.col("first.dst").alias("node_type"))


def names_of_type(edges: DataFrame, node_type: str) -> DataFrame:
    """``name, pos`` of the sources of any edge into the node of that name, ignoring case, by first place."""
    return edges.filter(F.lower("dst") == node_type.lower()).groupBy(F.col("src").alias("name")).agg(F.min("pos").alias("pos"))


def label_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("n_src"))


def hub_labels(edges: DataFrame) -> list[str]:
    """Labels whose edges lead to few targets, ``HUB_EDGES`` or more to one on average: those with most to one first, as long as
    they have ``HUB_TARGETS`` together."""
    counts = edges.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("dst").alias("d")).collect()  # one row a label
    found, targets = [], 0
    for row in sorted(counts, key=lambda r: (-r["n"] / max(r["d"], 1), r["label"])):
        targets += row["d"]
        if row["n"] < HUB_EDGES * row["d"] or targets > HUB_TARGETS:
            break
        found.append(row["label"])
    return found


def relation_histogram(graph: Graph) -> DataFrame:
    """``label, target_type, n, first_pos``: how often each relation leads to each type (or to an untyped target).

    Edges that many others share a target with are counted before they are dealt to the types; the others would only fill and
    spill a task's memory.  They are not sorted: a task holds its part of the types, one row a node, and edges pass by.
    """
    edges = graph.edges.filter(F.col("label").isNotNull() & (F.col("label") != ""))
    hubs = F.col("label").isin(hub_labels(edges))
    counted = edges.filter(hubs).groupBy("label", "dst").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    each = edges.filter(~hubs).select("label", "dst", F.lit(1).cast("long").alias("n"), F.col("pos").alias("first_pos"))
    typed = each.unionByName(counted).join(graph.types.hint("shuffle_hash"), F.col("dst") == F.col("name"), "left")
    target = F.coalesce("node_type", "dst")
    return typed.filter(target != "").groupBy("label", target.alias("target_type")).agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"))


def relation_top_type(histogram: DataFrame) -> DataFrame:
    """``label, top_type, n``: the most frequent type of each relation; of equals the first seen."""
    best = histogram.groupBy("label").agg(F.min(F.struct(-F.col("n"), F.col("first_pos"), F.col("target_type"))).alias("best"))
    return best.select("label", F.col("best.target_type").alias("top_type"), (-F.col("best.col1")).alias("n"))


def first_sources(edges: DataFrame) -> DataFrame:
    """``label, src``: the source of each label's first edge."""
    return edges.groupBy("label").agg(F.min(F.struct("pos", "src")).alias("first")).select("label", F.col("first.src").alias("src"))
