"""Training set of a graph network over documents, without leaks between folds.

Documents that share a rare line (a passage, a template, a whole copy) are
linked, each to the one of smallest id that has the line, so links grow with the
lines and not with the pairs. Connected documents are a cluster and go to one
fold together: no document is tested on what another one of its cluster has
taught. Every document gets the sampled neighbours of both layers of its
mini-batch. Output, below the target folder: ``examples``, partitioned by fold.

    spark-submit --py-files weftgraph.zip,jobs.zip jobs/document_graph.py --input DIR --output DIR [--config FILE]
"""

from __future__ import annotations

import sys
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log
from weftgraph.operators import graph
from weftgraph.operators.components import connected_components
from weftgraph.operators.sampling import sample_neighbours
from weftgraph.plans.lineage import discard, materialize
from weftgraph.sources import table

SCHEMA = "doc_id bigint, source string, lang string, cluster bigint, cluster_size bigint, degree bigint, first array<bigint>, second array<bigint>, fold int"


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, line): the distinct lines of at least ``min_words`` words of every document, by the MD5 of the line without blanks at its ends."""
    line = F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")
    each = docs.where("doc_id is not null").select("doc_id", line).select("doc_id", F.trim("line").alias("line"))
    return each.where(F.size(F.split("line", " +")) >= min_words).select("doc_id", F.md5(F.col("line").cast("binary")).alias("line")).distinct()


def links(lines: DataFrame, max_documents: int) -> DataFrame:
    """(src, dst): documents and the smallest one with which they share a line that 2 to ``max_documents`` documents have.

    Documents are counted before the shuffle; a line that more of them have, a
    licence say, links nothing.
    """
    rare = lines.groupBy("line").agg(F.count("*").alias("n"), F.min("doc_id").alias("dst")).where(F.col("n").between(2, max_documents))
    return lines.join(rare, "line").where("doc_id <> dst").select(F.col("doc_id").alias("src"), "dst").distinct()


def fold_of(cluster: str, folds: int, seed: int) -> Column:
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(cluster).cast("string")).cast("binary")), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(folds)).cast("int")


def run(spark: SparkSession, source: str, target: str, settings: dict) -> str:
    """Write the examples of the documents below ``source``; returns their path. A rerun replaces them with the same.

    Rows without an id are left out; rows that share an id are one vertex, with
    the smallest source and language, null last. Null and empty texts have no
    lines and are clusters of their own. An empty table gives an empty output.
    """
    if len(settings["fanouts"]) != 2:
        raise ValueError("a fan-out for each of two layers")
    docs = table(spark, source, "documents").select("doc_id", "text", "source", "lang")
    log.info("read %s/documents.parquet", source)
    lines = materialize(lines_of(docs, settings["min_words"]))
    edges = materialize(graph.symmetrize(links(lines, settings["max_documents"])))
    discard(lines)
    clusters = materialize(found := connected_components(edges))
    discard(found)
    sizes = clusters.groupBy("component").agg(F.count("*").alias("cluster_size"))
    drawn = sample_neighbours(edges, edges.select(F.col("src").alias("v")), settings["fanouts"], settings["seed"])
    lists = drawn.groupBy(F.col("src").alias("doc_id")).agg(*[F.sort_array(F.collect_list(F.when(F.col("hop") == h, F.col("dst")))).alias(name) for h, name in ((1, "first"), (2, "second"))])
    least = F.min(F.struct(F.col("source").isNull(), "source")).alias("s"), F.min(F.struct(F.col("lang").isNull(), "lang")).alias("l")
    vertices = docs.where("doc_id is not null").groupBy("doc_id").agg(*least).select("doc_id", "s.source", "l.lang")
    linked = clusters.join(sizes, "component").join(graph.degree(edges), "v").select(F.col("v").alias("doc_id"), F.col("component").alias("cluster"), "cluster_size", "degree")
    none = F.array().cast("array<bigint>")
    out = (
        vertices.join(linked, "doc_id", "left").join(lists, "doc_id", "left")
        .withColumns({"cluster": F.coalesce("cluster", "doc_id"), "cluster_size": F.coalesce("cluster_size", F.lit(1)).cast("bigint"), "degree": F.coalesce("degree", F.lit(0)).cast("bigint"), "first": F.coalesce("first", none), "second": F.coalesce("second", none)})
        .withColumn("fold", fold_of("cluster", settings["folds"], settings["seed"]))
    )
    path = f"{target.rstrip('/')}/examples"
    out.select("doc_id", "source", "lang", "cluster", "cluster_size", "degree", "first", "second", "fold").write.mode("overwrite").partitionBy("fold").parquet(path)
    for used in (edges, clusters, drawn):
        discard(used)
    written = read(spark, target).agg(F.count("*"), F.count_distinct("cluster"), F.sum("degree")).first()
    log.info("wrote %s: %s documents in %s clusters, %s links", path, written[0], written[1], (written[2] or 0) // 2)
    return path


def read(spark: SparkSession, target: str) -> DataFrame:
    """The examples as they stand."""
    return spark.read.schema(SCHEMA).parquet(f"{target.rstrip('/')}/examples")


#: What the job writes with the settings beside this file.
ORACLE = """
WITH RECURSIVE l AS (SELECT DISTINCT doc_id, md5(line) AS line FROM (SELECT doc_id, trim(unnest(string_split(coalesce(text, ''), chr(10)))) AS line FROM documents WHERE doc_id IS NOT NULL)
  WHERE len(regexp_split_to_array(line, ' +')) >= 4),
h AS (SELECT line, min(doc_id) AS dst FROM l GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50),
w AS (SELECT DISTINCT doc_id AS src, dst FROM l JOIN h USING (line) WHERE doc_id <> dst),
e AS (SELECT src, dst FROM w UNION SELECT dst, src FROM w),
r AS (SELECT src AS v, src AS o FROM e UNION SELECT r.v, e.dst FROM r JOIN e ON r.o = e.src),
c AS (SELECT v, min(o) AS cluster FROM r GROUP BY 1),
n AS (SELECT cluster, count(*) AS cluster_size FROM c GROUP BY 1),
d AS (SELECT src AS v, count(*) AS degree FROM e GROUP BY 1),
f AS (SELECT src, list_sort(list(dst)) AS first FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY md5('11|1|' || src || '|' || dst), dst) AS z FROM e) WHERE z <= 5 GROUP BY 1),
s AS (SELECT src, list_sort(list(dst)) AS second FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY md5('11|2|' || src || '|' || dst), dst) AS z FROM e WHERE src IN (SELECT unnest(first) FROM f)) WHERE z <= 3 GROUP BY 1),
v AS (SELECT doc_id, min(source) AS source, min(lang) AS lang FROM documents WHERE doc_id IS NOT NULL GROUP BY 1),
a AS (SELECT doc_id, source, lang, coalesce(c.cluster, doc_id) AS cluster, coalesce(cluster_size, 1)::BIGINT AS cluster_size, coalesce(degree, 0)::BIGINT AS degree,
  array_to_string(coalesce(first, []), ',') AS first, array_to_string(coalesce(second, []), ',') AS second
  FROM v LEFT JOIN c ON c.v = doc_id LEFT JOIN n ON n.cluster = c.cluster LEFT JOIN d ON d.v = doc_id LEFT JOIN f ON f.src = doc_id LEFT JOIN s ON s.src = doc_id)
SELECT *, (('0x' || substr(md5('11|' || cluster), 1, 8))::BIGINT % 10)::INT AS fold FROM a
"""

if __name__ == "__main__":
    command_line(__file__, __doc__.splitlines()[0], run)
