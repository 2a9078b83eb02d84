"""A property graph over relational tables (customers, orders, parts, documents, events), and its store.

A rule is a table, the source, target and label as SQL expressions, and a key that orders its edges.  An edge's place is
its rule's number times 10**12 plus the key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailgraph.operators import text_index
from trailgraph.operators.graph import Graph, Labels, both_ways, canonical, canonical_of_pairs, multigraph, multigraph_of_pairs, node_types
from trailgraph.sources.readers import read_edges
from trailgraph.sources.writers import write_sorted_edges
from trailgraph.storage import working_folder

RULE_PLACES = 10**12
#: Bytes of the tables whose edges one task merges: about 2 million edges of the densest.
PART_BYTES = 6 << 20
_CUSTOMER_NATION = "customer JOIN nation ON c_nationkey = n_nationkey"
_SUPPLIER_NATION = "supplier JOIN nation ON s_nationkey = n_nationkey"
_NATION_REGION = "nation JOIN region ON n_regionkey = r_regionkey"
_ORDER_CUSTOMER = "orders JOIN customer ON o_custkey = c_custkey"
_LINE_SUPPLIER = "lineitem JOIN supplier ON l_suppkey = s_suppkey"
_PART, _ORDER, _DOC = "concat('Part#', p_partkey)", "concat('Order#', o_orderkey)", "concat('Doc#', doc_id)"
_LINE_PART, _LINE_ORDER = "concat('Part#', l_partkey)", "concat('Order#', l_orderkey)"
_USER, _DAY = "concat('User#', user_id)", "concat('Day#', cast(cast(ts AS date) AS {string}))"

#: (tables, source, target, label expression, key)
RULES = [
    ("region", "r_name", "'region'", "'is_region_type'", "r_regionkey"),
    ("nation", "n_name", "'nation'", "'is_nation_type'", "n_nationkey"),
    ("customer", "c_name", "'customer'", "'is_customer_type'", "c_custkey"),
    ("supplier", "s_name", "'supplier'", "'is_supplier_type'", "s_suppkey"),
    ("part", _PART, "'part'", "'is_part_type'", "p_partkey"),
    ("orders", _ORDER, "'order'", "'is_order_type'", "o_orderkey"),
    ("documents", _DOC, "'document'", "'is_document_type'", "doc_id"),
    (_NATION_REGION, "n_name", "r_name", "'in_region'", "n_nationkey"),
    (_NATION_REGION, "r_name", "n_name", "'has_nation'", "n_nationkey"),
    (_CUSTOMER_NATION, "c_name", "n_name", "'from_nation'", "c_custkey"),
    (_CUSTOMER_NATION, "n_name", "c_name", "'home_of_customer'", "c_custkey"),
    ("customer", "c_name", "c_mktsegment", "'mktsegment'", "c_custkey"),
    (_SUPPLIER_NATION, "s_name", "n_name", "'located_in'", "s_suppkey"),
    (_SUPPLIER_NATION, "n_name", "s_name", "'home_of_supplier'", "s_suppkey"),
    (_ORDER_CUSTOMER, "c_name", _ORDER, "'placed_order'", "o_orderkey"),
    (_ORDER_CUSTOMER, _ORDER, "c_name", "'placed_by'", "o_orderkey"),
    ("orders", _ORDER, "o_orderpriority", "'priority'", "o_orderkey"),
    ("lineitem", _LINE_ORDER, _LINE_PART, "'uses_part'", "l_orderkey"),
    ("lineitem", _LINE_PART, _LINE_ORDER, "'used_by_order'", "l_orderkey"),
    (_LINE_SUPPLIER, "s_name", _LINE_PART, "'supplies'", "l_orderkey"),
    (_LINE_SUPPLIER, _LINE_PART, "s_name", "'supplied_by'", "l_orderkey"),
    ("part", _PART, "concat(p_name, ' ', p_brand, ' ', p_type)", "'description'", "p_partkey"),
    ("documents", _DOC, "text", "'description'", "doc_id"),
    ("documents", _DOC, "lang", "'lang'", "doc_id"),
    ("documents", _DOC, "source", "'source'", "doc_id"),
    ("events", _USER, _DAY, "event_type", "event_id"),
    ("events", _DAY, _USER, "'seen_user'", "event_id"),
]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "events")


def rule_sql(number: int, string: str) -> str:
    tables, src, dst, label, key = (x.format(string=string) for x in RULES[number])
    return f"SELECT {src} AS src, {dst} AS dst, {label} AS label, {(number + 1) * RULE_PLACES} + {key} AS seq FROM {tables} WHERE {src} IS NOT NULL AND {dst} IS NOT NULL"


def _by_tables(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, list[int]]]:
    """The rows of each rule's tables, and the rules over them.  Rules over the same tables are read, and joined, once."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}

    def rows(joined: str) -> DataFrame:
        names = joined.replace(" ON ", " JOIN ").split(" JOIN ")
        return tables[names[0]] if len(names) == 1 else tables[names[0]].join(tables[names[1]], F.expr(names[2]))

    return {joined: (rows(joined), [k for k, rule in enumerate(RULES) if rule[0] == joined]) for joined in dict.fromkeys(rule[0] for rule in RULES)}


def _edge(number: int) -> tuple[Column, Column, Column, Column]:
    """A rule's source, target, label and place."""
    _, src, dst, label, key = (x.format(string="string") for x in RULES[number])
    return F.expr(src), F.expr(dst), F.expr(label), (F.lit((number + 1) * RULE_PLACES) + F.expr(key)).cast("long")


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst, label, seq`` of all rules: a row gives an edge for each of those over its tables."""

    def edges_of(rows: DataFrame, numbers: list[int]) -> DataFrame:
        each = rows.select(*(F.struct(*(c.alias(n) for c, n in zip(_edge(k), ("src", "dst", "label", "seq")))).alias(f"e{k}") for k in numbers))
        found = each.select(F.explode(F.array(*each.columns)).alias("e")) if len(numbers) > 1 else each.toDF("e")
        return found.select("e.*").filter("src is not null and dst is not null")

    return reduce(DataFrame.unionByName, (edges_of(*own) for own in _by_tables(spark, sf_dir).values()))


def raw_pairs(spark: SparkSession, sf_dir: str, labels: Labels) -> DataFrame:
    """The same as rows of ``both_ways``: of two rules that lead to and fro between the same columns, a row gives one."""

    def pairs_of(rows: DataFrame, numbers: list[int]) -> DataFrame:
        if dynamic := [k for k in numbers if not RULES[k][3].startswith("'")]:
            rows = rows.withColumn("__label", F.expr(RULES[dynamic[0]][3])).join(labels.table(spark), F.col("__label") == F.col("name"), "left")

        def packed(number: int) -> Column:
            *_, seq = _edge(number)
            if number not in dynamic:
                return labels.packed(seq, labels.names.index(RULES[number][3].strip("'")) + 1)
            return labels.packed(seq, F.when(F.col("__label").isNull(), 0).otherwise(F.col("code")))

        made: list[Column] = []
        left = list(numbers)
        while left:
            k = left.pop(0)
            _, src, dst, _, key = RULES[k]
            back = next((j for j in left if RULES[j][1:3] == (dst, src) and RULES[j][4] == key), None)
            if back is not None:
                left.remove(back)
            made.append(both_ways(*_edge(k)[:2], packed(k), None if back is None else packed(back)))
        return rows.select(F.explode(F.array(*made)).alias("e")).filter("e is not null").select("e.*")

    return reduce(DataFrame.unionByName, (pairs_of(*own) for own in _by_tables(spark, sf_dir).values()))


def rule_labels(spark: SparkSession, sf_dir: str) -> set[str]:
    """The labels of all rules: what is stated, and the different values of the columns that give labels."""
    found = {rule[3].strip("'") for rule in RULES if rule[3].startswith("'")}
    for name, *_, label, _ in RULES:
        if not label.startswith("'"):
            values = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(F.expr(label).alias("label")).distinct()
            found |= {r["label"] for r in values.filter("label is not null").collect()}  # one row a label
    return found


def _parts(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks that merge edges, by the tables' bytes; none where a shuffle has as many anyway."""
    parts = sum(size for _, size, _ in _versions(spark, sf_dir)) // PART_BYTES
    return parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def canonical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = Labels.of(rule_labels(spark, sf_dir))
    if not labels.fit((len(RULES) + 1) * RULE_PLACES):  # too many to be packed
        return canonical(raw_edges(spark, sf_dir))
    return canonical_of_pairs(raw_pairs(spark, sf_dir, labels), labels, _parts(spark, sf_dir))


def multigraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = Labels.of(rule_labels(spark, sf_dir))
    if not labels.fit((len(RULES) + 1) * RULE_PLACES):
        return multigraph(raw_edges(spark, sf_dir))
    return multigraph_of_pairs(raw_pairs(spark, sf_dir, labels), labels, _parts(spark, sf_dir))


def _versions(spark: SparkSession, sf_dir: str) -> tuple:
    """The tables' files with their lengths and times: input that was written anew makes a new store."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    found = []
    for name in TABLES:
        at = path(f"{sf_dir}/{name}.parquet")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files = fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


@dataclass
class Store:
    """A graph's folder, the graph itself with what is kept with it, and its indexed form, made when it is asked for."""

    folder: str
    graph: Graph
    indexed: Graph | None = None


_STORES: dict[tuple, Store] = {}


def store(spark: SparkSession, sf_dir: str) -> Store:
    """The graph's store, built once a session and state of the input: canonical edges sorted by label, and the node types."""
    key = (spark.sparkContext.applicationId, _versions(spark, sf_dir))
    if key not in _STORES:
        folder = working_folder(spark)
        write_sorted_edges(canonical_edges(spark, sf_dir), f"{folder}/edges")
        edges = read_edges(spark, f"{folder}/edges")
        typed = [label for label in rule_labels(spark, sf_dir) if "type" in label]
        node_types(edges.filter(F.col("label").isin(typed))).write.option("compression", "zstd").parquet(f"{folder}/types")
        _STORES[key] = Store(folder, Graph(edges, spark.read.schema("name string, node_type string").parquet(f"{folder}/types")))
    return _STORES[key]


def load(spark: SparkSession, sf_dir: str) -> Graph:
    return store(spark, sf_dir).graph


def load_indexed(spark: SparkSession, sf_dir: str) -> Graph:
    """The same with an index of the descriptions."""
    own = store(spark, sf_dir)
    if own.indexed is None:
        own.indexed = Graph(own.graph.edges, own.graph.types, text_index.build(own.graph.descriptions(), f"{own.folder}/index"))
    return own.indexed


#: The same graph in SQL: ``edges(src, dst, label, pos)`` and ``node_type(name, node_type)``.
SQL = f"""WITH raw AS (
{' UNION ALL '.join(rule_sql(i, 'varchar') for i in range(len(RULES)))}
), edges AS (
SELECT src, dst, first(label ORDER BY seq DESC, label DESC) AS label, min(seq) AS pos FROM raw GROUP BY src, dst
), node_type AS (
SELECT src AS name, first(dst ORDER BY pos, dst) AS node_type FROM edges WHERE label LIKE '%type%' GROUP BY src
), d AS (SELECT src, dst FROM edges WHERE label = 'description')
"""
