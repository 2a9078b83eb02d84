"""Registered queries of the graph engine over the relational property graph, and the same in SQL (DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailgraph import relational_graph
from trailgraph.functions import text
from trailgraph.functions.match import closest
from trailgraph.operators import bundles, expand, graph as graphs, splits
from trailgraph.plans.execute import Graph, count_batch, count_many, follow, follow_batch, follow_many, start, trace, trace_many
from trailgraph.sources.readers import keyed_objects, target_map
from trailgraph.sources.writers import edge_lines
from trailgraph.storage import working_folder
from trailgraph.streaming.edges import EdgeStore, RelationStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
E_ = relational_graph.SQL


def query(sql: str | None = None, name: str | None = None):
    """Registers a query, and its SQL where there is one."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _graph(spark: SparkSession, sf_dir: str) -> Graph:
    return relational_graph.load(spark, sf_dir)


# -- the edge table ---------------------------------------------------------------------------------------------------


@query(E_ + "SELECT src, dst, label, pos FROM edges")
def edges_canonical(spark, sf_dir):
    return relational_graph.canonical_edges(spark, sf_dir)


@query(E_ + "SELECT src, dst, label, min(seq) AS pos FROM raw GROUP BY ALL")
def edges_multigraph(spark, sf_dir):
    return relational_graph.multigraph_edges(spark, sf_dir)


@query(E_ + "SELECT label, count(*) AS n, count(DISTINCT src) AS n_src FROM edges GROUP BY label")
def edge_label_counts(spark, sf_dir):
    return graphs.label_counts(_graph(spark, sf_dir).edges)


@query(E_ + "SELECT name, node_type FROM node_type")
def node_type_lookup(spark, sf_dir):
    return graphs.node_types(_graph(spark, sf_dir).edges)


@query(E_ + "SELECT name, min(pos) AS first_pos FROM (SELECT src AS name, pos FROM edges UNION ALL SELECT dst, pos FROM edges) GROUP BY name")
def node_table(spark, sf_dir):
    return graphs.nodes(_graph(spark, sf_dir).edges)


@query(E_ + "SELECT src AS name, min(pos) AS pos FROM edges WHERE lower(dst) = 'customer' GROUP BY src")
def names_by_type(spark, sf_dir):
    return graphs.names_of_type(_graph(spark, sf_dir).edges, "Customer")


_HISTOGRAM = "h AS (SELECT label, coalesce(node_type, dst) AS target_type, count(*) AS n, min(pos) AS first_pos FROM edges LEFT JOIN node_type ON dst = name WHERE label <> '' AND coalesce(node_type, dst) <> '' GROUP BY ALL)"
_TOP = "top AS (SELECT label, first(target_type ORDER BY n DESC, first_pos, target_type) AS top_type, max(n) AS n FROM h GROUP BY label)"


@query(f"{E_}, {_HISTOGRAM} SELECT * FROM h")
def relation_type_histogram(spark, sf_dir):
    return graphs.relation_histogram(_graph(spark, sf_dir))


@query(f"{E_}, {_HISTOGRAM}, {_TOP} SELECT * FROM top")
def relation_top_type(spark, sf_dir):
    return graphs.relation_top_type(graphs.relation_histogram(_graph(spark, sf_dir)))


@query(E_ + "SELECT label, first(src ORDER BY pos, src) AS src FROM edges GROUP BY label")
def first_source_of_relation(spark, sf_dir):
    return graphs.first_sources(_graph(spark, sf_dir).edges)


@query(E_ + "SELECT concat(src, ' - ', label, ' -> ', dst) AS line FROM edges")
def edge_log_lines(spark, sf_dir):
    return edge_lines(_graph(spark, sf_dir).edges).withColumnRenamed("value", "line")


# -- paths from one entity, or none -----------------------------------------------------------------------------------

CUSTOMER, CUSTOMER_2, CUSTOMER_3 = (f"Customer#{k:09d}" for k in (7, 8, 10))
SUPPLIER = f"Supplier#{3:09d}"


def _step_sql(source: str, step: str) -> str:
    """One step over a select of nodes, in SQL."""
    if step.startswith("filter "):
        words = step.removeprefix("filter ").lower()
        word = " and " if " and " in words else " or "
        tests = word.join(f"contains(lower(dst), '{w.strip()}')" for w in words.split(word))
        return f"SELECT node FROM ({source}) WHERE node IN (SELECT src FROM d WHERE {tests})"
    if "_type" in step:
        return f"SELECT node FROM ({source}) WHERE node IN (SELECT src FROM edges WHERE label = '{step}')"
    return f"SELECT DISTINCT dst AS node FROM ({source}) JOIN edges ON node = src WHERE label = '{step}'"


def _path_sql(entity: str | None, steps: list[str]) -> str:
    if entity is None:
        column = "src" if "_type" in steps[0] else "dst"
        sql = f"SELECT DISTINCT {column} AS node FROM edges WHERE label = '{steps[0]}'"
    else:
        sql = f"SELECT '{entity}' AS node"
    for step in steps:
        sql = _step_sql(sql, step)
    return f"{E_} SELECT DISTINCT node FROM ({sql})"


#: name: (entity or none, path)
PATHS: dict[str, tuple[str | None, list[str]]] = {
    "hop_single": (CUSTOMER, ["placed_order"]),
    "hop_multi_2": (CUSTOMER, ["placed_order", "uses_part"]),
    "hop_multi_3": (CUSTOMER, ["placed_order", "uses_part", "supplied_by"]),
    "hop_multi_4": (CUSTOMER, ["placed_order", "uses_part", "supplied_by", "located_in"]),
    "type_keep": (CUSTOMER, ["placed_order", "uses_part", "is_part_type"]),
    "filter_single": (SUPPLIER, ["supplies", "filter Ring"]),
    "filter_and": (SUPPLIER, ["supplies", "filter ring and ECONOMY"]),
    "filter_or": (SUPPLIER, ["supplies", "filter ring or widget"]),
    "filter_after_description": (SUPPLIER, ["supplies", "description", "filter ring"]),
    "hop_filter": (CUSTOMER, ["placed_order", "uses_part", "filter promo"]),
    "type_filter_hop": (None, ["is_part_type", "filter red and plate", "supplied_by"]),
    "type_filter_hop_hop": (None, ["is_part_type", "filter red and ring", "supplied_by", "located_in"]),
    "hop_filter_hop_hop": (SUPPLIER, ["supplies", "filter widget and large", "used_by_order", "placed_by"]),
    "blind_start_relation": (None, ["located_in", "in_region"]),
    "blind_start_type": (None, ["is_nation_type", "home_of_supplier"]),
    "document_filter": (None, ["is_document_type", "filter idiot or moron", "lang"]),
    "hub_value_hop": (None, ["mktsegment"]),
    "unknown_label": (CUSTOMER, ["placed_order", "show part"]),
}

for _name, (_entity, _steps) in PATHS.items():
    query(_path_sql(_entity, _steps), _name)(lambda spark, sf_dir, e=_entity, p=_steps: follow(_graph(spark, sf_dir), spark, [e] if e else [], p))

#: Keyword filters by the index of trigrams: words that are long, short, shared, in no text, with marks.
INDEXED = {
    "indexed_filter_and": (None, ["is_part_type", "filter red and plate", "supplied_by"]),
    "indexed_filter_or": (None, ["is_part_type", "filter red plate or economy brushed or zzzz"]),
    "indexed_filter_short_words": (SUPPLIER, ["supplies", "filter ri and ring"]),
    "indexed_filter_documents": (None, ["is_document_type", "filter idiot or moron", "lang"]),
    "indexed_filter_scan": (SUPPLIER, ["supplies", "filter ri or widget"]),
    "indexed_filter_twice": (None, ["is_part_type", "filter ring", "filter red and #1", "used_by_order"]),
}

for _name, (_entity, _steps) in INDEXED.items():
    query(_path_sql(_entity, _steps), _name)(lambda spark, sf_dir, e=_entity, p=_steps: follow(relational_graph.load_indexed(spark, sf_dir), spark, [e] if e else [], p))

BATCH = {k: v for k, v in enumerate(PATHS.values()) if v[0]}


@query(E_ + " UNION ALL ".join(f"SELECT {k} AS query_id, node FROM ({_path_sql(e, p).removeprefix(E_)})" for k, (e, p) in BATCH.items()))
def batch_paths(spark, sf_dir):
    queries = spark.createDataFrame([(k, e) for k, (e, _) in BATCH.items()], "query_id int, entity string")
    return follow_batch(_graph(spark, sf_dir), queries, {k: p for k, (_, p) in BATCH.items()})


#: Paths that share beginnings, followed from every customer or supplier.
FAMILY = {
    "customer": [["placed_order"], ["placed_order", "priority"], ["placed_order", "uses_part", "filter red"], ["placed_order", "uses_part", "filter red", "supplied_by"], ["placed_order", "is_order_type", "priority"], ["from_nation", "in_region"], ["from_nation"], ["mktsegment"]],
    "supplier": [["located_in"], ["located_in", "in_region"], ["supplies", "filter ring or rod"], ["supplies", "filter ring or rod", "used_by_order"], ["placed_order", "priority"]],
}
_FAMILY = [(kind, path) for kind, paths in FAMILY.items() for path in paths]


def _family_sql(path_id: int, kind: str, steps: list[str]) -> str:
    """One path from all entities of a kind, by its steps' joins."""
    sql = f"SELECT {kind[0]}_name AS entity, {kind[0]}_name AS node FROM {kind}"
    for step in steps:
        if step.startswith("filter "):
            words = step.removeprefix("filter ").split(" or ")
            sql = f"SELECT entity, node FROM ({sql}) WHERE node IN (SELECT src FROM d WHERE {' OR '.join(f"contains(lower(dst), '{w}')" for w in words)})"
        elif "_type" in step:
            sql = f"SELECT entity, node FROM ({sql}) WHERE node IN (SELECT src FROM edges WHERE label = '{step}')"
        else:
            sql = f"SELECT DISTINCT entity, dst AS node FROM ({sql}) JOIN edges ON node = src WHERE label = '{step}'"
    return f"SELECT {path_id} AS path_id, * FROM ({sql})"


@query(f"{E_}, reached AS ({' UNION ALL '.join(_family_sql(k, kind, path) for k, (kind, path) in enumerate(_FAMILY))}) SELECT path_id, node, count(*) AS n FROM reached GROUP BY ALL")
def batch_path_family(spark, sf_dir):
    """How many entities reach each node by each path: one batch of a query for every entity and path of its kind."""
    names = {kind: _table(spark, sf_dir, kind).select(F.col(f"{kind[0]}_name").alias("entity"), F.lit(kind).alias("kind")) for kind in FAMILY}
    routes = spark.createDataFrame([(k, kind) for k, (kind, _) in enumerate(_FAMILY)], "path_id long, kind string")
    asked = names["customer"].unionByName(names["supplier"]).join(F.broadcast(routes), "kind").select("path_id", "entity")
    return count_batch(_graph(spark, sf_dir), asked, {k: path for k, (_, path) in enumerate(_FAMILY)})


# -- paths from several entities --------------------------------------------------------------------------------------


def _many_sql(entities: list[str], steps: list[str]) -> str:
    """``acc(entity, node_type, node)`` of a path's hops, as CTEs after the graph's."""
    ctes = ["f0 AS (" + " UNION ALL ".join(f"SELECT '{e}' AS entity, '{e}' AS node" for e in entities) + ")"]
    hops, k = [], 0
    for step in steps:
        if step.startswith("select"):
            continue
        source, k = f"f{k}", k + 1
        if "_type" in step:
            body = f"SELECT DISTINCT entity, src AS node FROM (SELECT DISTINCT entity FROM f0), edges WHERE label = '{step}'"
        elif step.startswith("filter "):
            body = f"SELECT entity, node FROM {source} WHERE node IN (SELECT src FROM d WHERE contains(lower(dst), '{step.removeprefix('filter ').lower()}'))"
        else:
            body = f"SELECT DISTINCT entity, dst AS node FROM {source} JOIN edges ON node = src WHERE label = '{step}'"
            hops.append(k)
        ctes.append(f"f{k} AS ({body})")
    union = " UNION ".join(f"SELECT entity, node_type, node FROM f{k} LEFT JOIN node_type ON node = name" for k in hops)
    return f"{E_}, {', '.join(ctes)}, acc AS ({union})"


_TWO, _THREE = [CUSTOMER, CUSTOMER_2], [CUSTOMER, CUSTOMER_2, CUSTOMER_3]
_HOPS = ["select <<customer>> <<customer>>", "placed_order", "uses_part", "supplied_by"]


def _many(spark: SparkSession, sf_dir: str, entities: list[str], steps: list[str]):
    return follow_many(_graph(spark, sf_dir), start(spark, entities), steps)


def _combined(entities: list[str], steps: list[str], operation: str):
    path = [*steps, operation]
    return lambda spark, sf_dir: _many(spark, sf_dir, entities, path).combined[len(path)].select("node")


def _combined_sql(entities: list[str], steps: list[str], node_type: str, having: str) -> str:
    return f"{_many_sql(entities, steps)} SELECT node FROM acc WHERE node_type = '{node_type}' GROUP BY node HAVING {having}"


query(_combined_sql(_TWO, _HOPS, "supplier", "count(DISTINCT entity) = 2"), "exec_common_2")(_combined(_TWO, _HOPS, "exec_common supplier"))
query(_combined_sql(_TWO, _HOPS, "supplier", "count(DISTINCT entity) % 2 = 1"), "exec_difference_2")(_combined(_TWO, _HOPS, "exec_difference supplier"))
query(_combined_sql(_TWO, _HOPS, "part", "count(DISTINCT entity) % 2 = 1"), "exec_difference_2_parts")(_combined(_TWO, _HOPS, "exec_difference part"))
query(_combined_sql(_THREE, _HOPS, "part", "count(DISTINCT entity) % 2 = 1"), "exec_difference_3_parity")(_combined(_THREE, _HOPS, "exec_difference part"))
_SEEDED = ["placed_order", "is_nation_type", "in_region"]
query(f"{_many_sql(_TWO, _SEEDED)} SELECT entity, node_type, node FROM acc", "type_seed_multi")(lambda spark, sf_dir: _many(spark, sf_dir, _TWO, _SEEDED).results.drop("query_id"))
query(f"{_many_sql(_THREE, _HOPS)} SELECT entity, node_type, node FROM acc", "typed_results_multi")(lambda spark, sf_dir: _many(spark, sf_dir, _THREE, _HOPS).results.drop("query_id"))
_FILTERED = ["placed_order", "uses_part", "filter rod", "supplied_by"]
query(f"{_many_sql(_TWO, _FILTERED)} SELECT entity, node_type, node FROM acc", "filter_multi")(lambda spark, sf_dir: _many(spark, sf_dir, _TWO, _FILTERED).results.drop("query_id"))


@query(f"""{E_}, f1 AS (SELECT DISTINCT src AS entity, dst AS node FROM edges WHERE label = 'placed_order'
), f2 AS (SELECT DISTINCT entity, dst AS node FROM f1 JOIN edges ON node = src WHERE label = 'uses_part'
), f3 AS (SELECT DISTINCT entity, dst AS node FROM f2 JOIN edges ON node = src WHERE label = 'supplied_by'
), acc AS (SELECT * FROM f1 UNION SELECT * FROM f2 UNION SELECT * FROM f3)
SELECT entity, node_type, count(*) AS n FROM acc LEFT JOIN node_type ON node = name GROUP BY ALL""")
def hops_of_all_customers(spark, sf_dir):
    """How many nodes of each type every customer reaches: a frontier of all of them, its last hop by lists."""
    customers = _table(spark, sf_dir, "customer").select(F.lit(0).cast("long").alias("query_id"), F.col("c_name").alias("entity"), F.col("c_name").alias("node"))
    return count_many(_graph(spark, sf_dir), customers, ["placed_order", "uses_part", "supplied_by"]).drop("query_id")


# -- bundles ----------------------------------------------------------------------------------------------------------

_RELS_SQL = """rels AS (
SELECT concat('supplier--', l_suppkey) AS source_ref, concat('stock-part--', l_partkey) AS target_ref, 'uses' AS relation, l_orderkey * 100 + l_linenumber * 2 AS seq FROM lineitem
UNION ALL SELECT concat('supplier--', s_suppkey), concat('nation--', s_nationkey), CASE WHEN s_suppkey % 3 = 0 THEN 'mitigates' WHEN s_suppkey % 3 = 1 THEN 'attributed-to' ELSE 'detects' END, 1000000000000 + s_suppkey * 10 FROM supplier
UNION ALL SELECT 'supplier--none', concat('nation--', n_nationkey), 'detects', 2000000000000 + n_nationkey FROM nation
), names AS (
SELECT concat('supplier--', s_suppkey) AS id, s_name AS name FROM supplier UNION ALL SELECT concat('nation--', n_nationkey), n_name FROM nation
UNION ALL SELECT concat('stock-part--', p_partkey), p_name FROM part)"""
_RESOLVED_SQL = f"""WITH {_RELS_SQL}, named AS (
SELECT s.name AS source, t.name AS target, source_ref, seq, CASE WHEN relation = 'uses' THEN concat('uses_', replace(split_part(target_ref, '--', 1), '-', '_')) ELSE replace(relation, '-', '_') END AS label
FROM rels JOIN names s ON source_ref = s.id JOIN names t ON target_ref = t.id
), both_ways AS (
SELECT source AS src, target AS dst, label, seq + {bundles.PHASE} AS seq FROM named UNION ALL
SELECT target, source, CASE WHEN label = 'mitigates' THEN 'mitigated_by' WHEN label = 'detects' THEN 'detected_by' WHEN label LIKE 'attributed%' THEN 'is_responsible' WHEN label LIKE 'uses\\_%' ESCAPE '\\' THEN concat('used_by_', replace(split_part(source_ref, '--', 1), '-', '_')) END, seq + {bundles.PHASE} + 1 FROM named)"""


def _relation_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Relationships by reference, and names by id."""
    supplier, nation, part, line = (_table(spark, sf_dir, t) for t in ("supplier", "nation", "part", "lineitem"))
    uses = line.selectExpr("concat('supplier--', l_suppkey) AS source_ref", "concat('stock-part--', l_partkey) AS target_ref", "'uses' AS relation", "l_orderkey * 100 + l_linenumber * 2 AS seq")
    kind = "CASE WHEN s_suppkey % 3 = 0 THEN 'mitigates' WHEN s_suppkey % 3 = 1 THEN 'attributed-to' ELSE 'detects' END AS relation"
    there = supplier.selectExpr("concat('supplier--', s_suppkey) AS source_ref", "concat('nation--', s_nationkey) AS target_ref", kind, "1000000000000 + s_suppkey * 10 AS seq")
    lost = nation.selectExpr("'supplier--none' AS source_ref", "concat('nation--', n_nationkey) AS target_ref", "'detects' AS relation", "cast(2000000000000 + n_nationkey AS long) AS seq")
    names = supplier.selectExpr("concat('supplier--', s_suppkey) AS id", "s_name AS name").unionByName(nation.selectExpr("concat('nation--', n_nationkey) AS id", "n_name AS name"))
    names = names.unionByName(part.selectExpr("concat('stock-part--', p_partkey) AS id", "p_name AS name"))
    return uses.unionByName(there).unionByName(lost), names


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.relationship_edges(*_relation_rows(spark, sf_dir))


@query(f"{_RESOLVED_SQL} SELECT src, dst, label, seq FROM both_ways WHERE label IS NOT NULL")
def relationship_resolution(spark, sf_dir):
    return _relations(spark, sf_dir)


@query(f"{_RESOLVED_SQL} SELECT label, count(*) AS n, count(DISTINCT src) AS n_src FROM both_ways WHERE label IS NOT NULL AND (label LIKE '%\\_by%' ESCAPE '\\' OR label = 'is_responsible') GROUP BY label")
def inverse_edges(spark, sf_dir):
    return graphs.label_counts(_relations(spark, sf_dir).filter(F.col("label").contains("_by") | (F.col("label") == "is_responsible")))


@query(E_ + "SELECT src, dst, label, pos FROM edges")
def edges_upserted(spark, sf_dir):
    """All edges in three batches that don't follow the edges' order, with a compaction between."""
    store = EdgeStore(spark, working_folder(spark))
    raw = relational_graph.raw_edges(spark, sf_dir)
    for batch in range(3):
        store.upsert(raw.filter(F.pmod(F.xxhash64("seq", "src"), F.lit(3)) == batch), batch)
        if batch == 1:
            store.compact()
    return store.edges()


@query(f"""{_RESOLVED_SQL.replace("s_suppkey) AS id, s_name AS name FROM supplier", "s_suppkey) AS id, CASE WHEN s_suppkey % 2 = 0 THEN concat('new ', s_name) ELSE s_name END AS name FROM supplier WHERE s_suppkey % 7 > 0")}
SELECT src, dst, label, seq FROM both_ways WHERE label IS NOT NULL""")
def pending_relationships(spark, sf_dir):
    """Relationships first, the names of parts with the second batch and those of nations with the third; a supplier in two is
    called anew, and one in seven loses its name."""
    store = RelationStore(spark, working_folder(spark))
    rels, names = _relation_rows(spark, sf_dir)
    key = F.substring_index("id", "--", -1).cast("long")
    is_supplier, is_part = F.col("id").startswith("supplier"), F.col("id").startswith("stock-part")
    first = names.filter(is_supplier).withColumn("at", F.lit(1).cast("long"))
    again = first.withColumn("name", F.when(key % 7 == 0, "").when(key % 2 == 0, F.concat(F.lit("new "), "name")).otherwise(F.col("name"))).withColumn("at", F.lit(2).cast("long"))
    store.add(rels.filter(F.col("relation") == "uses"), first, 0)
    store.add(rels.filter(F.col("relation") != "uses"), names.filter(is_part).withColumn("at", F.lit(1).cast("long")), 1)
    store.add(rels.limit(0), names.filter(~is_supplier & ~is_part).withColumn("at", F.lit(1).cast("long")).unionByName(again), 2)
    return store.edges()


@query("""SELECT src, dst, label FROM (
SELECT concat('Event#', event_id) AS src, replace(event_type, '-', '_') AS dst, concat('is_', replace(event_type, '-', '_'), '_type') AS label FROM events
UNION ALL SELECT concat('Event#', event_id), concat('Event#', event_id), 'name' FROM events
UNION ALL SELECT concat('Event#', event_id), json_extract_string(props, '$.k'), 'k' FROM events)""")
def attribute_explode(spark, sf_dir):
    head = F.format_string('{"id":"event--%d","type":"%s","name":"Event#%d",', "event_id", "event_type", "event_id")
    made = _table(spark, sf_dir, "events").select(F.lit(0).alias("file_ord"), F.col("event_id").alias("obj_pos"), F.concat(head, F.expr("substring(props, 2)")).alias("object"))
    return bundles.attribute_edges(keyed_objects(made)).drop("seq")


#: An object with a value of each kind, and with repeated keys, of which the last counts: (key, its JSON from the table's
#: columns, the edge's target in SQL).
_VALUES = [
    ("description", ['"[', "p_name", "](https://example.org/", "p_partkey", r') is a part, \"new\"."'], "p_type"),
    ("link", ['"[', "p_name", "](https://example.org/", "p_partkey", r') is a part, \"new\"."'], """concat('[', p_name, '](https://example.org/', p_partkey, ') is a part, "new".')"""),
    ("platforms", ['["', "p_brand", '","other"]'], "p_brand"),
    ("nested", ['[ ["[', "p_brand", '"], 3]'], "concat('[', p_brand)"),
    ("spaced", [" [ ] "], "'Not Available'"),
    ("flags", ["[false,true]"], "'False'"),
    ("nothing", ["null"], "'None'"),
    ("no_items", ["[null]"], "'None'"),
    ("is_family", ["true"], "'True'"),
    ("word", ['"true"'], "'true'"),
    ("size", ["", "p_size", ""], "p_size::VARCHAR"),
    ("twice", ['{"a":1,"b":{"c":"', "p_brand", '","c":2},"a":"', "p_partkey", '"}'], """concat('{"a": "', p_partkey, '", "b": {"c": 2}}')"""),
    ("description", ['"', "p_type", '"'], None),
    ("references", ['[{"url":"https://x.org/a,b:', "p_partkey", '","n":[1,null],"a":{}},7]'], """concat('{"url": "https://x.org/a,b:', p_partkey, '", "n": [1, null], "a": {}}')"""),
]
_VALUES_SQL = " UNION ALL ".join(f"SELECT concat('Part#', p_partkey) AS src, {target} AS dst, '{key}' AS label FROM part" for key, _, target in _VALUES if target)


@query(f"""{_VALUES_SQL} UNION ALL SELECT concat('Part#', p_partkey), concat('Part#', p_partkey), 'name' FROM part
UNION ALL SELECT concat('Part#', p_partkey), 'stock_part', 'is_stock_part_type' FROM part""")
def bundle_values(spark, sf_dir):
    """A value's parts are text and columns in turn; lines are broken between keys."""
    parts = [F.lit('{"id":"stock-part--'), F.col("p_partkey"), F.lit('","type":"stock-part","name":"Part#'), F.col("p_partkey"), F.lit('"')]
    for key, pieces, _ in _VALUES:
        parts += [F.lit(f',\n  "{key}" : '), *(F.lit(x) if k % 2 == 0 else F.col(x) for k, x in enumerate(pieces))]
    made = _table(spark, sf_dir, "part").select(F.lit(0).alias("file_ord"), F.col("p_partkey").alias("obj_pos"), F.concat(*parts, F.lit("}")).alias("object"))
    return bundles.attribute_edges(keyed_objects(made)).drop("seq")


# -- texts ------------------------------------------------------------------------------------------------------------


@query("SELECT concat('<PATH>from_nation<SEP>', lower(c_mktsegment), '<SEP>', c_name, '</PATH>') AS path, 3 AS n_steps, lower(c_mktsegment) AS second FROM customer")
def path_parse_render(spark, sf_dir):
    rendered = _table(spark, sf_dir, "customer").select(text.path_text(F.array(F.lit("from_nation"), F.lower("c_mktsegment"), "c_name")).alias("path"))
    steps = text.path_steps(F.concat(F.lit("x "), F.col("path"), F.lit(" <PATH>y</PATH>")))
    return rendered.select(text.path_text(steps).alias("path"), F.size(steps).alias("n_steps"), steps[1].alias("second"))


def _one_cue() -> F.Column:
    return F.concat(
        F.lit("Let's reason step by step, starting from the entity '"), "c_name", F.lit("' (type: customer). Our goal is: x.\n<PATH>a<SEP>"), "c_name",
        F.lit("</PATH> The completed path is:\n\n<PATH>b<SEP>"), "c_mktsegment", F.lit("</PATH> "),
    )


def _many_cue() -> F.Column:
    return F.concat(F.lit("We are working with the following entities:\n- '"), "s_name", F.lit("' is a malware\n- '"), "n_name", F.lit("' is a tool.\n\n**Starting Point (START)** - no"))



@query("""SELECT c_name AS entities, 1 AS n FROM customer UNION ALL SELECT concat(s_name, '|', n_name, '.'), 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def entity_extract(spark, sf_dir):
    one = _table(spark, sf_dir, "customer").select(_one_cue().alias("t"))
    nation = _table(spark, sf_dir, "nation")
    many = _table(spark, sf_dir, "supplier").join(nation, F.expr("s_nationkey = n_nationkey")).select(_many_cue().alias("t"))
    found = one.unionByName(many).select(text.entities(F.col("t")).alias("e"))
    return found.select(F.concat_ws("|", "e").alias("entities"), F.size("e").alias("n"))


@query("SELECT c_custkey, concat('<PATH>b<SEP>', c_mktsegment, '</PATH>') AS path, true AS ends FROM customer")
def final_path_extract(spark, sf_dir):
    t = _one_cue()
    return _table(spark, sf_dir, "customer").select("c_custkey", text.final_path(t).alias("path"), text.ends_path(t).alias("ends"))


_CLEAN = r"regexp_replace(regexp_replace(text, '\(.*?\)', '', 'g'), '\[|\]', '', 'g')"


@query(rf"""SELECT doc_id, nullif(CASE WHEN m <> '' THEN trim(m, ' ' || chr(10) || chr(9) || chr(13)) ELSE c END, '') AS sentence
FROM (SELECT doc_id, c, regexp_extract(c, '([^.]*\.)(\s|$)', 1) AS m FROM (SELECT doc_id, {_CLEAN} AS c FROM documents))""")
def first_sentence(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


@query("SELECT p_partkey, len(p_name) > 0 AND contains(lower(p_name), 'rod') AS kept, contains(lower(p_name), 'rod') AS same_terms FROM part")
def bracket_validator(spark, sf_dir):
    asked = F.concat(F.lit("Which [part] is a rat like ["), "p_name", F.lit("]?"))
    varied = F.concat(F.lit("[part] like ["), F.when(F.lower("p_name").contains("rod"), F.concat("p_name", F.lit("] of a RAT"))).otherwise(F.lit("x]")))
    return _table(spark, sf_dir, "part").select("p_partkey", text.keeps_brackets(asked, varied).alias("kept"), text.valid_paraphrase(asked, varied).alias("same_terms"))


_TERMS = ", ".join(f"CASE WHEN contains(lower(text), '{t}') THEN '{t}' END" for t in text.MALWARE_TERMS)


@query(f"SELECT doc_id, concat_ws(',', {_TERMS}) AS terms FROM documents")
def malware_terms(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", text.malware_terms(F.col("text"))).alias("terms"))


@query("""SELECT p_partkey, concat('What is ', p_name, '?|', p_brand, '|12 ', p_type) AS lines FROM part""")
def question_lines(spark, sf_dir):
    raw = F.concat(F.lit("Sure!\n\n1. What is "), "p_name", F.lit("?\n  2. "), "p_brand", F.lit("  \r\nnothing here\n12 "), "p_type")
    return _table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", text.question_lines(raw)).alias("lines"))


_VARIED = "concat(' ', p_brand, '; ', p_name, ';', p_type, '; ')"


def _picked(policy: str):
    return lambda spark, sf_dir: target_map(_table(spark, sf_dir, "part").selectExpr("concat('q', p_partkey) AS question", f"{_VARIED} AS variations"), policy)


query("SELECT concat('q', p_partkey) AS question, p_brand AS new_target FROM part", "variation_pick_first")(_picked("first"))
query("""SELECT concat('q', p_partkey) AS question, CASE WHEN len(p_brand) >= len(p_name) AND len(p_brand) >= len(p_type) THEN p_brand
WHEN len(p_name) >= len(p_type) THEN p_name ELSE p_type END AS new_target FROM part""", "variation_pick_longest")(_picked("longest"))  # fmt: skip


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END AS target, p_partkey % 3 = 0 AS updated FROM part")
def target_update(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    rows = part.selectExpr("p_partkey", "concat('q', p_partkey) AS question", "p_type AS target")
    new = part.filter("p_partkey % 3 < 2").selectExpr("concat('q', p_partkey) AS question", "CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS new_target")
    return splits.update_targets(rows, new).drop("question")


@query("SELECT c_custkey, concat('system: You translate questions to paths.|human: ', c_name, '|gpt: <PATH>', c_mktsegment, '</PATH>') AS turns FROM customer")
def chat_records(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name AS question", "concat('<PATH>', c_mktsegment, '</PATH>') AS path")
    said = splits.chat_records(rows, "You translate questions to paths.")
    return said.select("c_custkey", F.concat_ws("|", F.transform("messages", lambda m: F.concat(m["from"], F.lit(": "), m["value"]))).alias("turns"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('a ', p_brand, ' worm [x]|[x] WORM ', p_type) ELSE '[x] worm|a worm [x]' END AS kept FROM part")
def top_paraphrases(spark, sf_dir):
    good = F.when(F.col("p_partkey") % 2 == 0, F.array(F.concat(F.lit("a "), "p_brand", F.lit(" worm [x]")), F.concat(F.lit("[x] WORM "), "p_type"))).otherwise(F.array(F.lit("[x] worm"), F.lit("a worm [x]")))
    bad = F.array(F.lit("a worm"), F.lit("a worm [y]"), F.lit("a [x]"), F.lit("a worm with a backdoor [x]"))
    offered = F.concat(bad, good, F.array(F.lit("one worm [x] more")))
    return _table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", text.top_paraphrases(F.lit("The worm [x]"), offered, 2)).alias("kept"))


# -- splits -----------------------------------------------------------------------------------------------------------


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").selectExpr("c_name AS question", "concat('s', c_custkey % 37 * (c_custkey % 7)) AS section")


_FRACTION = 0.15 / (0.05 + 0.15)
_SPLIT_SQL = f"""WITH ranked AS (
SELECT c_name AS question, concat('s', c_custkey % 37 * (c_custkey % 7)) AS section,
       row_number() OVER (PARTITION BY concat('s', c_custkey % 37 * (c_custkey % 7)) ORDER BY md5(concat('42|', c_name)), c_name) AS r,
       count(*) OVER (PARTITION BY concat('s', c_custkey % 37 * (c_custkey % 7))) AS n FROM customer
), sized AS (SELECT *, ceil({1.0 - 0.80!r}::DOUBLE * n)::BIGINT AS held FROM ranked
), cut AS (SELECT *, CASE WHEN n <= 1 THEN 0 WHEN n = 2 THEN 1 WHEN held <= 1 THEN 0 ELSE least(ceil({_FRACTION!r}::DOUBLE * held)::BIGINT, held - 1) END AS n_test FROM sized
), val AS (SELECT *, CASE WHEN n <= 2 THEN 0 WHEN held <= 1 THEN held ELSE held - n_test END AS n_val FROM cut
), assigned AS (SELECT question, section, CASE WHEN r <= n_val THEN 'validation' WHEN r <= n_val + n_test THEN 'test' ELSE 'train' END AS split FROM val)"""


@query(f"{_SPLIT_SQL} SELECT question, section, split FROM assigned")
def split_assign(spark, sf_dir):
    return splits.split(_customers(spark, sf_dir))


@query(f"{_SPLIT_SQL} SELECT split, section, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY split), 6)::DOUBLE AS percent FROM assigned GROUP BY split, section")
def split_distribution(spark, sf_dir):
    return splits.distribution(splits.split(_customers(spark, sf_dir))).withColumn("percent", F.round("percent", 6))


@query("SELECT c_name AS question, CASE WHEN c_custkey % 5 = 0 THEN 'Unknown' ELSE concat('b', c_nationkey) END AS section FROM customer")
def section_mapping_unmapped(spark, sf_dir):
    customer = _table(spark, sf_dir, "customer")
    sections = customer.filter("c_custkey % 5 > 0").selectExpr("c_name AS question", "explode(array(named_struct('s', concat('a', c_nationkey), 'o', 1), named_struct('s', concat('b', c_nationkey), 'o', 2))) AS e")
    return splits.with_sections(customer.selectExpr("c_name AS question"), sections.selectExpr("question", "e.s AS section", "e.o AS ord"), drop_unmapped=False)


# -- datasets ---------------------------------------------------------------------------------------------------------

_ONE = ("q_one", 0, "Which parts does [supplier] supply?", ["supplies", "filter ring", "used_by_order"], ["parts of [supplier]"])
_NONE = ("q_none", 0, "Which nations are there?", ["is_nation_type", "in_region"], ["nations"])
_PAIR = ("q_two", 0, "What do [customer] and [supplier] share?", ["select <<customer>> <<supplier>>", "placed_order", "uses_part", "exec_common part"], ["shared parts"])
_TRIPLE = ("entity_in_path", 0, "How do [region], [nation] and [supplier] relate?", ["select <<region>> <<nation>> <<supplier>>", "located_in", "in_region"], ["relation of [nation]"])


def _templates(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), "section string, idx int, question string, path array<string>, target array<string>")


@query(E_ + "SELECT 'q_one' AS section, 0 AS idx, concat('Which parts does ', s_name, ' supply?') AS question FROM supplier")
def placeholder_expand_1(spark, sf_dir):
    return expand.expand(spark, _templates(spark, _ONE), _graph(spark, sf_dir)).select("section", "idx", "question")


_TOPS = f"{E_}, {_HISTOGRAM}, {_TOP}"


@query(f"""{_TOPS} SELECT concat('Which parts does ', s_name, ' supply?') AS question, concat('**Task Analysis**

Let''s reason step by step, starting from the entity ''', s_name, ''' (type: supplier). Our goal is: parts of ', s_name, '.

**Starting Point (START)**

To begin, let''s focus on nodes of type ''supplier'' to establish our initial scope.


**Step-by-Step Analysis**


Step 1: Follow ''supplies'' relationship, leading us to nodes representing ', (SELECT top_type FROM top WHERE label = 'supplies'), '.
Step 2: By following the ''filter ring'' relationship, we proceed to the next relevant nodes, continuing our analysis within the cybersecurity context.
Step 3: Follow ''used_by_order'' relationship to reach parts of ', s_name, ', marking the conclusion of our path.


**Path Completion**

By following these steps, represented as <PATH>supplies<SEP>filter ring<SEP>used_by_order</PATH>, starting from ''', s_name, ''' nodes, we have successfully achieved our goal: parts of ', s_name, '.

**Final Path**

The completed path is:

<PATH>supplies<SEP>filter ring<SEP>used_by_order</PATH>') AS response FROM supplier""")
def cot_response(spark, sf_dir):
    return expand.expand(spark, _templates(spark, _ONE), _graph(spark, sf_dir)).select("question", "response")


def _drawn_sql(*keys: str) -> str:
    return f"('0x' || substr(md5(concat('42|', {", '|', ".join(keys)})), 1, 15))::BIGINT"


def _steps_sql(path: str, *steps: str) -> str:
    """The steps' sentences and the completion's beginning, as arguments of concat."""
    return ", chr(10), ".join(steps) + f", chr(10), chr(10), chr(10), '**Path Completion**', chr(10), chr(10), 'By following these steps, represented as ', {path}"


def _hop_sql(number: int, label: str) -> str:
    return f"'Step {number}: Follow ''{label}'' relationship, leading us to nodes representing ', (SELECT top_type FROM top WHERE label = '{label}'), '.'"


def _other_sql(number: int, step: str) -> str:
    return f"'Step {number}: By following the ''', {step}, ''' relationship, we proceed to the next relevant nodes, continuing our analysis within the cybersecurity context.'"


_WORKING = "chr(10), chr(10), '**Task Analysis**', chr(10), chr(10), 'Let''s reason step by step. We are working with the following entities:', chr(10)"
_START = "'**Starting Point (START)**', chr(10), chr(10), 'To begin, let''s focus on nodes of type "
_BEGUN = " to establish our initial scope.', chr(10), chr(10), '**Step-by-Step Analysis**', chr(10), chr(10)"
_ENDED = "chr(10), chr(10), '**Final Path**', chr(10), chr(10), 'The completed path is:', chr(10), chr(10)"
_NUMBERED = "numbered AS (SELECT lower(dst) AS of_type, src AS name, row_number() OVER (PARTITION BY lower(dst) ORDER BY md5(src), src) - 1 AS number FROM (SELECT DISTINCT src, dst FROM edges WHERE dst IN ('customer', 'supplier')))"
_PAIR_PATH = "concat('<PATH>select ', n1, ' ', n2, '<SEP>placed_order<SEP>uses_part<SEP>exec_common part</PATH>')"
_PAIRS_SQL = f"""{_TOPS}, {_NUMBERED}, sizes AS (
SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM supplier) AS s
), tries AS (SELECT {_drawn_sql("'q_two'", "'0'", "attempt")} % (c * s) AS index, attempt, c, s FROM sizes, range(1, 201) t(attempt)
), firsts AS (SELECT index, c, s, row_number() OVER (ORDER BY min(attempt)) AS r FROM tries GROUP BY index, c, s
), pairs AS (SELECT a.name AS n1, b.name AS n2 FROM firsts JOIN numbered a ON a.of_type = 'customer' AND a.number = index // s
JOIN numbered b ON b.of_type = 'supplier' AND b.number = index % s WHERE r <= least(50, c * s // 1000))"""


@query(f"""{_PAIRS_SQL} SELECT concat('What do ', n1, ' and ', n2, ' share?') AS question, concat({_WORKING}, '- ''', n1, ''' is a customer', chr(10), '- ''', n2, ''' is a supplier.', chr(10),
'Our goal is : shared parts.', chr(10), chr(10), '**Entity Description**', chr(10), chr(10), 'Description of ', n1, ': None', chr(10), 'Description of ', n2, ': None', chr(10), chr(10),
{_START}supplier{_BEGUN}, {_steps_sql(_PAIR_PATH, _other_sql(1, "'select ', n1, ' ', n2"), _hop_sql(2, "placed_order"), _hop_sql(3, "uses_part"), "'Step 4: Follow ''exec_common part'' relationship to reach shared parts, marking the conclusion of our path.'")},
', starting from ''', n2, ''' nodes, we have successfully achieved our goal: shared parts.', {_ENDED}, {_PAIR_PATH}) AS response FROM pairs""")
def placeholder_expand_2_sampled(spark, sf_dir):
    return expand.expand(spark, _templates(spark, _PAIR), _graph(spark, sf_dir)).select("question", "response")


_SLOTS = " UNION ALL ".join(f"SELECT {k} AS slot, {t[0]}_name AS name FROM {t}" for k, t in enumerate(("region", "nation", "supplier")))
_TRIPLE_PATH = "concat('<PATH>select ', n1, ' ', n2, ' ', n3, '<SEP>located_in<SEP>in_region</PATH>')"
_TRIPLES_SQL = f"""{_TOPS}, slots AS ({_SLOTS}
), ranked AS (SELECT slot, name, row_number() OVER (PARTITION BY slot ORDER BY {_drawn_sql("'entity_in_path'", "'0'", "slot", "name")}, name) AS r FROM slots
), triples AS (SELECT a.name AS n1, b.name AS n2, c.name AS n3 FROM ranked a JOIN ranked b ON a.r = b.r AND a.slot = 0 AND b.slot = 1 JOIN ranked c ON a.r = c.r AND c.slot = 2 WHERE a.r <= 16)"""


@query(f"""{_TRIPLES_SQL} SELECT concat('How do ', n1, ', ', n2, ' and ', n3, ' relate?') AS question, concat({_WORKING}, '- ''', n1, ''' is a region.', chr(10), '- ''', n2, ''' is a nation.', chr(10), '- ''', n3, ''' is a supplier.', chr(10),
'Our goal is to relation of ', n2, '.', chr(10), chr(10), '**Entity Descriptions**', chr(10), chr(10), 'Description of ', n1, ' (region): None', chr(10), 'Description of ', n2, ' (nation): None', chr(10), 'Description of ', n3, ' (supplier): None', chr(10), chr(10),
{_START}None{_BEGUN}, {_steps_sql(_TRIPLE_PATH, _other_sql(1, "'select ', n1, ' ', n2, ' ', n3"), _hop_sql(2, "located_in"), "'Step 3: Follow ''in_region'' relationship to reach relation of ', n2, ', marking the conclusion of our path.'")},
', we have successfully achieved our goal: relation of ', n2, '.', {_ENDED}, {_TRIPLE_PATH}) AS response FROM triples""")
def expand_3_disjoint(spark, sf_dir):
    return expand.expand(spark, _templates(spark, _TRIPLE), _graph(spark, sf_dir)).select("question", "response")


def _none_sql(asked: str) -> str:
    """The response of the template without an entity; its goal is described nowhere."""
    path = "'<PATH>is_nation_type<SEP>in_region</PATH>'"
    steps = f"{_hop_sql(1, 'is_nation_type')}, chr(10), 'Step 2: Follow ''in_region'' relationship to reach nations, marking the conclusion of our path.'"
    return f"""concat('**Task Analysis**', chr(10), chr(10), 'Let''s reason step by step.', chr(10), 'Our goal is to reach the nations.', chr(10), chr(10), {steps}, chr(10), chr(10), chr(10),
'**Path Completion**', chr(10), chr(10), 'By following these steps, represented as ', {path}, ', we have successfully achieved our goal: nations.', {_ENDED}, {path})"""


@query(f"{_TOPS} SELECT 'q_none' AS section, x AS question, {_none_sql('x')} AS response FROM (VALUES ('Name all nations.'), ('List the nations?')) t(x)")
def expand_0_variations(spark, sf_dir):
    varied = spark.createDataFrame([("Which nations are there?", ["Name all nations.", "List the nations?"])], "question string, variations array<string>")
    return expand.expand(spark, _templates(spark, _NONE), _graph(spark, sf_dir), varied).select("section", "question", "response")


_ASKED, _AIMS = ["What does [supplier] sell?", "Parts of [supplier]?", "[supplier]: which parts?"], ["parts of [supplier]", "what [supplier] supplies"]


def _chosen_sql(options: list[str], question: str, which: str) -> str:
    """One of the options by md5 of the seed, the template's question, the name and what is chosen."""
    drawn = _drawn_sql(f"'{question}'", "s_name", f"'{which}'")
    return f"replace(list_extract(['{"', '".join(options)}'], ({drawn} % {len(options)} + 1)::INTEGER), '[supplier]', s_name)"


@query(f"SELECT {_chosen_sql(_ASKED, _ONE[2], 'q')} AS question, concat('Our goal is: ', {_chosen_sql(_AIMS, _ONE[2], 't')}, '.') AS goal FROM supplier")
def expand_1_variations(spark, sf_dir):
    """The variations of question and goal that are drawn for each name."""
    varied = spark.createDataFrame([(_ONE[2], _ASKED), (_AIMS[0], _AIMS)], "question string, variations array<string>")
    made = expand.expand(spark, _templates(spark, _ONE), _graph(spark, sf_dir), varied)
    return made.select("question", F.regexp_extract("response", r"(Our goal is: [^\n]*)", 1).alias("goal"))


#: A step of each kind, and its sentence's end in SQL: type is the type it leads to, last whether it is the last one.
_KINDS = [
    ("supplies", "", "concat('Step ', n, ': Follow ''supplies'' relationship, leading us to nodes representing ', type, '.')"),
    ("page_rank 3", "", "concat('Step ', n, ': Follow ''page_rank 3'' relationship, leading us to nodes representing the top 3 ', type, '.')"),
    ("select rings", "", "concat('Step ', n, ': Follow ''select rings'' relationship, focusing on ', type, ' nodes and selecting ''rings''.')"),
    ("filter ring", "", "concat('Step ', n, ': Follow ''filter ring'' relationship, leading us to ', type, ' nodes having ring in their description.')"),
    ("description", "", "concat('Step ', n, ': Follow ''description'' relationship to retrieve the description of the previous node.')"),
    ("located_in", "last", "concat('Step ', n, ': Follow ''located_in'' relationship to reach ', type, ', marking the conclusion of our path.')"),
    ("show part", "untyped", "concat('Step ', n, ': By following the ''show part'' relationship, we proceed to the next relevant nodes, continuing our analysis within the cybersecurity context.')"),
]


@query(" UNION ALL ".join(f"SELECT p_partkey, {k} AS kind, {sql} AS line FROM (SELECT p_partkey, p_size::VARCHAR AS n, p_brand AS type FROM part)" for k, (_, _, sql) in enumerate(_KINDS)))
def step_sentences(spark, sf_dir):
    """All seven sentences of a step, with numbers and types of the table."""
    part = _table(spark, sf_dir, "part")

    def line(relation: str, how: str) -> F.Column:
        kind = F.lit(None).cast("string") if how == "untyped" else F.col("p_brand")
        return expand.step_line(F.col("p_size"), kind, F.lit(relation), F.lit(how == "last"))

    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), line(r, how).alias("line")) for k, (r, how, _) in enumerate(_KINDS)]))
    return part.select("p_partkey", each.alias("e")).select("p_partkey", "e.kind", "e.line")


@query("SELECT section, n FROM (VALUES ('q_one', (SELECT count(*) FROM supplier)), ('q_none', 1), ('empty', 0)) t(section, n)")
def section_question_counts(spark, sf_dir):
    made = expand.expand(spark, _templates(spark, _ONE, _NONE), _graph(spark, sf_dir))
    return splits.section_counts(made, spark.createDataFrame([("q_one",), ("q_none",), ("empty",)], "section string"))


#: 17 characters of 17 and 18 match: each entity lacks one.  The brand in capitals has its first letter alone in common with
#: the one that is spelled so; half of the characters of "Brnd" are in "B#1d", no more in any other name.
@query("""SELECT * FROM (VALUES ('custmer#000000007', 'Customer#000000007', 32::DOUBLE / 35), ('Suplier#000000003', 'Supplier#000000003', 34::DOUBLE / 35), ('Brnd', 'B#1d', 0.5::DOUBLE)) t(entity, name, score)
UNION ALL SELECT c_name, c_name, 1.0 FROM customer UNION ALL SELECT concat('x', c_name), c_name, 36::DOUBLE / 37 FROM customer WHERE c_custkey % 50 = 0""")
def fuzzy_match(spark, sf_dir):
    customer = _table(spark, sf_dir, "customer")
    wanted = spark.createDataFrame([("custmer#000000007",), ("Suplier#000000003",), ("zzzz",), ("Brnd",)], "entity string")
    wanted = wanted.unionByName(customer.selectExpr("c_name AS entity")).unionByName(customer.filter("c_custkey % 50 = 0").selectExpr("concat('x', c_name) AS entity"))
    names = customer.selectExpr("c_name AS name").unionByName(_table(spark, sf_dir, "supplier").selectExpr("s_name AS name")).unionByName(spark.createDataFrame([("B#1d",), ("BRND",)], "name string"))
    return closest(wanted, names)


# -- traces -----------------------------------------------------------------------------------------------------------

_TRACED = ["placed_order", "uses_part", "filter promo"]


def _reached_sql(steps: list[str]) -> str:
    sql = f"SELECT '{CUSTOMER}' AS node"
    for step in steps:
        sql = _step_sql(sql, step)
    return sql


@query(f"""{E_}, kept AS ({_reached_sql(_TRACED)})
SELECT 1 AS step, 0 AS ord, '[!] Step 1: Following relation ''placed_order''. Results:' AS line UNION ALL SELECT 1, 1, concat('   - ', node) FROM ({_reached_sql(_TRACED[:1])})
UNION ALL SELECT 2, 0, '[!] Step 2: Following relation ''uses_part''. Results:' UNION ALL SELECT 2, 1, concat('   - ', node) FROM ({_reached_sql(_TRACED[:2])})
UNION ALL SELECT 3, 0, concat('[!] Step 3: Filtering ', coalesce((SELECT min(node_type) FROM kept JOIN node_type ON node = name), 'None'), ' nodes by ''promo''.') UNION ALL SELECT 3, 1, concat('   - ', node) FROM kept""")
def trace_lines(spark, sf_dir):
    return trace(_graph(spark, sf_dir), start(spark, [CUSTOMER]), _TRACED)


_TRACED_MANY = ["select <<customer>> <<customer>>", "placed_order", "uses_part", "exec_common part"]
_TYPED = "SELECT {step} AS step, entity, 1 AS ord, concat('   - ', node, ' (', coalesce(node_type, 'None'), ')') AS line FROM {frontier} LEFT JOIN node_type ON node = name"
_SAID = "SELECT {step}, entity, 0, '[!] Step {step}: Following relation ''{label}''.' FROM f0"


@query(f"""{_many_sql(_TWO, _TRACED_MANY[:3])} {_TYPED.format(step=2, frontier="f1")} UNION ALL {_TYPED.format(step=3, frontier="f2")}
UNION ALL {_SAID.format(step=2, label="placed_order")} UNION ALL {_SAID.format(step=3, label="uses_part")}
UNION ALL SELECT 1, NULL, 0, '[!] Step 1: Selecting entities. Results:' UNION ALL SELECT 1, NULL, 1, concat('   - ', entity) FROM f0
UNION ALL SELECT 4, NULL, 1, '[!] Step 4: Common results for type ''part''.'
UNION ALL SELECT 4, NULL, 2, concat('   - ', node) FROM (SELECT node FROM acc WHERE node_type = 'part' GROUP BY node HAVING count(DISTINCT entity) = 2)""")
def trace_lines_many(spark, sf_dir):
    return trace_many(_graph(spark, sf_dir), start(spark, _TWO), _TRACED_MANY)
