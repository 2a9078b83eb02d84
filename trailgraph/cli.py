"""Command line: ``python -m trailgraph.cli build-graph | expand | to-csv | split | update-targets | follow``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from trailgraph.functions.match import closest
from trailgraph.operators import bundles, expand, graph as graphs, splits
from trailgraph.plans.execute import follow, follow_many, start
from trailgraph.sources import readers, writers


def build_graph(spark: SparkSession, a: argparse.Namespace) -> None:
    raw = bundles.bundle_edges(readers.read_bundles(spark, a.base), full=a.full)
    writers.write_edges(graphs.multigraph(raw) if a.full else graphs.canonical(raw), a.out)
    if a.log:
        writers.write_edge_log(raw, a.log)
    if a.graphml:
        writers.write_graphml(readers.read_edges(spark, a.out), a.graphml)


def make_questions(spark: SparkSession, a: argparse.Namespace) -> None:
    graph = graphs.Graph.of(readers.read_edges(spark, a.graph))
    varied = readers.read_variations(spark, a.variations) if a.variations else None
    targets = readers.read_variations(spark, a.targets, "last") if a.targets else None
    document = readers.read_document(spark, a.templates)
    templates = readers.templates_of(spark, document)
    if a.skip_path:
        templates = templates.filter(F.concat_ws("<SEP>", "path") != a.skip_path)
    items = expand.expand(spark, templates, graph, varied, targets, a.seed)
    writers.write_questions(items.select("question", "response"), a.out, a.document)
    if a.out_sections:
        writers.write_sections(items, a.out_sections, a.document, spark.createDataFrame([(s,) for s in document.get("templates") or {}], "section string"))
    if a.out_relations:
        writers.write_relation_map(graphs.relation_histogram(graph), a.out_relations, a.document)


def questions_to_csv(spark: SparkSession, a: argparse.Namespace) -> None:
    writers.write_csv(readers.questions_to_csv_columns(readers.read_questions(spark, a.input)), a.out)


def make_splits(spark: SparkSession, a: argparse.Namespace) -> None:
    splits.check_ratios(a.train, a.validation, a.test)
    rows = readers.read_csv(spark, a.csv)
    if "Question" not in rows.columns:
        raise ValueError("the CSV needs a column Question")
    mapped = splits.with_sections(rows, readers.read_sections(spark, a.sections), drop_unmapped=not a.keep_unmapped)
    writers.write_splits(splits.split(mapped, a.train, a.validation, a.test, a.seed), a.out)


def change_targets(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rewrites the targets of a question list, or of a template document."""
    columns = readers.read_csv(spark, a.csv).select(F.col("Original Question").alias("question"), F.col("Variations").alias("variations"))
    if a.templates:
        document = readers.read_document(spark, a.input)
        document, scanned, updated = writers.updated_document(spark, document, readers.target_map(columns, a.pick))
        print(f"scanned {scanned}, updated {updated}")
        if not a.dry_run:
            writers.write_document(spark, document, a.out, not a.no_backup)
        return
    rows = readers.read_questions(spark, a.input)
    updated = splits.update_targets(rows if "target" in rows.columns else rows.withColumn("target", F.lit(None).cast("string")), readers.target_map(columns, a.pick))
    counts = splits.update_counts(updated).first()
    print(f"scanned {counts['scanned']}, updated {counts['updated']}")
    writers.write_targets(updated.drop("updated"), a.out, a.dry_run, not a.no_backup)


def show_path(spark: SparkSession, a: argparse.Namespace) -> None:
    graph = graphs.Graph.of(readers.read_edges(spark, a.graph))
    entities = a.entity
    if a.names and entities:
        near = closest(spark.createDataFrame([(e,) for e in entities], "entity string"), readers.read_names(spark, a.names))
        found = {r["entity"]: r["name"] for r in near.collect()}
        entities = [found[e] for e in entities if e in found]
    if len(entities) > 1:
        follow_many(graph, start(spark, entities), a.path).results.drop("query_id").show(a.rows, truncate=False)
    else:
        follow(graph, spark, entities, a.path).show(a.rows, truncate=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="trailgraph")
    commands = top.add_subparsers(required=True)

    def command(name: str, run, required: Sequence[str], optional: Sequence[str] = (), flags: Sequence[str] = ()) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for option in required:
            p.add_argument(f"--{option}", required=True)
        for option in optional:
            p.add_argument(f"--{option}")
        for option in flags:
            p.add_argument(f"--{option}", action="store_true")
        p.set_defaults(run=run)
        return p

    command("build-graph", build_graph, ["base", "out"], ["log", "graphml"], ["full"])
    command("expand", make_questions, ["templates", "graph", "out"], ["out-sections", "out-relations", "variations", "targets", "skip-path"], ["document"]).add_argument("--seed", type=int, default=42)
    command("to-csv", questions_to_csv, ["input", "out"])
    p = command("split", make_splits, ["csv", "sections", "out"], flags=["keep-unmapped"])
    for option, share in (("train", 0.80), ("validation", 0.05), ("test", 0.15)):
        p.add_argument(f"--{option}", type=float, default=share)
    p.add_argument("--seed", type=int, default=42)
    command("update-targets", change_targets, ["csv", "input", "out"], flags=["dry-run", "no-backup", "templates"]).add_argument("--pick", choices=["first", "longest"], default="first")
    p = command("follow", show_path, ["graph", "path"], ["names"])
    p.add_argument("--entity", action="append", default=[])
    p.add_argument("--rows", type=int, default=100)
    return top


def main(arguments: Sequence[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(SparkSession.builder.appName("trailgraph").getOrCreate(), a)


if __name__ == "__main__":
    main()
