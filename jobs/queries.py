"""The jobs as queries: each runs twice into the same new folder, and its output is read back."""

from __future__ import annotations

import uuid
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import activity_graph, document_graph
from jobs.common import settings
from weftgraph.plans.lineage import shared_dir


def twice(job: ModuleType, spark: SparkSession, sf_dir: str) -> DataFrame:
    target = f"{shared_dir(spark).rstrip('/')}/{job.__name__.rpartition('.')[2]}-{uuid.uuid4().hex}"
    for _ in range(2):
        job.run(spark, sf_dir, target, settings(job.__file__))
    return job.read(spark, target)


def job1_document_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters, folds and sampled neighbours of all documents; the lists as text."""
    out = twice(document_graph, spark, sf_dir)
    return out.withColumns({c: F.array_join(c, ",") for c in ("first", "second")})


def job2_activity_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily edges of users and kinds of all events."""
    return twice(activity_graph, spark, sf_dir)


QUERIES = {"job1_document_graph": job1_document_graph, "job2_activity_graph": job2_activity_graph}
ORACLES = {"job1_document_graph": document_graph.ORACLE, "job2_activity_graph": activity_graph.ORACLE}
