"""What the jobs share: settings, logging, and reading what may not be there yet."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("weftgraph.jobs")


def settings(file: str, given: str | None = None) -> dict:
    """The settings beside a job's file, and over them those of the config file ``given`` on the command line."""
    found = json.loads(Path(file).with_suffix(".json").read_text())
    if given:
        named = json.loads(Path(given).read_text())
        if unknown := set(named) - set(found):
            raise ValueError(f"no such settings: {', '.join(sorted(unknown))}")
        found |= named
    return found


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def command_line(file: str, about: str, run: Callable[[SparkSession, str, str, dict], object]) -> None:
    """``--input``, ``--output`` and ``--config``, in a session of its own."""
    parser = argparse.ArgumentParser(description=about)
    parser.add_argument("--input", required=True, help="folder of the input tables; any path that Spark can read")
    parser.add_argument("--output", required=True, help="folder of the output; any path that Spark can write")
    parser.add_argument("--config", help="JSON file of settings that differ from the job's own")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(Path(file).stem).getOrCreate()
    try:
        run(spark, args.input, args.output, settings(file, args.config))
    finally:
        spark.stop()
