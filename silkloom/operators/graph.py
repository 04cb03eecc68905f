"""Concept graphs: expansion by a model's answers, relations and coverage.

A graph is nodes (concept, depth, examples, metadata) and edges (source, target, type).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silkloom.functions.responses import RELATIONS, relations
from silkloom.functions.text import first_words
from silkloom.storage import ensure_checkpoint_dir

NODES = "concept string, depth int, examples array<string>, metadata map<string,string>"
EDGES = "source string, target string, type string"
#: Answers a frame of concepts: concept -> (concept, response).
Answer = Callable[[DataFrame], DataFrame]


def empty_graph(spark) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES)


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """nodes and those of new that are not among them, each concept once at its least depth."""
    fresh = new.join(nodes.select("concept"), "concept", "left_anti").groupBy("concept").agg(F.min_by(F.struct("depth", "examples", "metadata"), "depth").alias("n"))
    return nodes.select("concept", "depth", "examples", "metadata").unionByName(fresh.select("concept", "n.*"))


def add_edges(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges and those of new whose two ends are nodes, each once."""
    names = nodes.select("concept")
    known = new.join(names, new["source"] == names["concept"], "left_semi").join(names, new["target"] == names["concept"], "left_semi")
    return edges.unionByName(known.where(F.col("type").isin(*RELATIONS)).select("source", "target", "type")).dropDuplicates()


def expand(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, answer: Answer, max_depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """The graph after breadth-first expansion of seeds (concept): depth 0 for seeds, at most max_depth levels.

    A concept is asked about once, at its least depth. Each level's answers are checkpointed: they are costly and may
    differ when asked again.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    bare = lambda df, depth: df.select("concept", F.lit(depth).alias("depth"), F.array().cast("array<string>").alias("examples"), F.create_map().cast("map<string,string>").alias("metadata"))
    frontier = seeds.select("concept").where("concept <> ''").distinct()
    nodes = add_nodes(nodes, bare(frontier, 0))
    asked = frontier.limit(0)
    for depth in range(max_depth):
        frontier = frontier.join(asked, "concept", "left_anti")
        told = answer(frontier).select("concept", F.explode(relations("response")).alias("r")).select(F.col("concept").alias("source"), F.col("r.concept").alias("target"), "r.type").checkpoint()
        if told.isEmpty():
            break
        asked = asked.union(frontier)
        found = told.select(F.col("target").alias("concept")).distinct()
        nodes = add_nodes(nodes, bare(found, depth + 1)).checkpoint()
        edges = add_edges(nodes, edges, told).checkpoint()
        frontier = found
    return nodes, edges


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int, concept: str = "concept") -> DataFrame:
    """concept, depth: all that is at most max_depth edges (source, target) from a seed, at its least depth; seeds at 0.

    Breadth-first: each level joins the edges to the concepts found last, leaves out by anti-join what is known already, and is
    stored before the next one reads it. Ends early when a level finds nothing. Null ends and seeds are left out.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    links = edges.select("source", "target").where("source is not null and target is not null and source <> target").distinct().checkpoint()
    last = seeds.select(F.col(concept).alias("concept")).where("concept is not null").distinct().checkpoint()
    found = last.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        near = links.join(last.withColumnRenamed("concept", "source"), "source").select(F.col("target").alias("concept")).distinct()
        last = near.join(found.select("concept"), "concept", "left_anti").checkpoint()
        if last.isEmpty():
            break
        found = found.unionByName(last.withColumn("depth", F.lit(depth)))
    return found


def concept_edges(texts: DataFrame, text: str = "text", n: int = 3) -> DataFrame:
    """source, target: each of the first n words of a text and the one after it."""
    first = first_words(text, n)
    after = F.arrays_zip(F.slice(first, F.lit(1), F.greatest(F.size(first) - 1, F.lit(0))).alias("source"), F.slice(first, F.lit(2), F.greatest(F.size(first) - 1, F.lit(0))).alias("target"))
    return texts.select(F.explode(after).alias("e")).select("e.source", "e.target").distinct()


def key_concepts(texts: DataFrame, text: str = "text", n: int = 3) -> DataFrame:
    """concept: the distinct first words of the texts."""
    return texts.select(F.explode(first_words(text, n)).alias("concept")).distinct()


def coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: totals, a count for each of the six relations (0 where there are none), averages by node."""
    counted = nodes.agg(F.count("*").alias("total_nodes"), F.coalesce(F.sum(F.greatest(F.size("examples"), F.lit(0))), F.lit(0)).alias("total_examples"))
    related = edges.agg(F.count("*").alias("total_relations"), *(F.count_if(F.col("type") == r).alias(r) for r in RELATIONS))
    both = counted.crossJoin(related)  # one row each
    by_node = lambda c: F.coalesce(F.col(c) / F.nullif("total_nodes", F.lit(0)), F.lit(0.0))
    return both.select("total_nodes", "total_relations", "total_examples", *RELATIONS, by_node("total_relations").alias("average_relations_per_node"), by_node("total_examples").alias("average_examples_per_node"))


def relation_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, depth, example_count) and (source, target, type)."""
    return nodes.select(F.col("concept").alias("id"), "depth", F.greatest(F.size("examples"), F.lit(0)).alias("example_count")), edges.select("source", "target", "type")


def to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """concept, json: one document a node, for a sink of JSON lines."""
    targets = edges.groupBy("source", "type").agg(F.sort_array(F.collect_set("target")).alias("t")).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("type", "t"))).alias("relations"))
    joined = nodes.join(targets, nodes["concept"] == targets["source"], "left")
    return joined.select("concept", F.to_json(F.struct("concept", "depth", "examples", "metadata", "relations")).alias("json"))


def from_json(lines: DataFrame, json: str = "json") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of to_json documents; edges of unknown type or to unknown nodes are dropped, whatever the order."""
    read = lines.select(F.from_json(json, "concept string, depth int, examples array<string>, metadata map<string,string>, relations map<string,array<string>>").alias("n")).select("n.*").where("concept is not null")
    nodes = read.select("concept", "depth", "examples", "metadata").dropDuplicates(["concept"])
    told = read.select(F.col("concept").alias("source"), F.explode("relations").alias("type", "targets")).select("source", F.explode("targets").alias("target"), "type")
    return nodes, add_edges(nodes, lines.sparkSession.createDataFrame([], EDGES), told)
