"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words end at these characters only: space, tab, newline, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, through Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(columns: list[str], name: str) -> str:
    """``name``, made longer until no column has it, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: Column | str) -> Column:
    """The words of a text, natively. Null and blank texts have none."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.filter(F.split(t, SPACES), lambda w: w != "")


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` whose workers on this machine find the package even if only the driver's path names it; clusters ship it with --py-files."""
    df.sparkSession.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return df.mapInArrow(whole, schema)


def trim() -> None:
    """Give a worker's free memory back: it lives on for other tasks, beside those of other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict] | dict | None], schema: str | T.StructType, after: Callable[[], None] | None = None) -> DataFrame:
    """``mapInArrow`` where ``fn`` turns one batch into columns (a dict of arrays), or several of them, or none. ``after``: what a task does at its end."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                out = fn(batch)
                for cols in [out] if isinstance(out, dict) else out or ():
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type, from_pandas=False) for c, f in ((cols[f.name], f) for f in arrow)], schema=arrow)
        finally:
            if after is not None:
                after()

    return in_arrow(df, run, kind)


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """The texts of a batch one at a time; null is the empty text. Few are Python strings at once."""
    for v in batch.column(name):
        yield v.as_py() or ""


def blocks(batch: pa.RecordBatch, chars: int, name: str = "text") -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts): a batch's texts in runs of about ``chars`` characters, at least one text each."""
    first, held, n = 0, [], 0
    for i, t in enumerate(texts(batch, name)):
        held.append(t)
        n += len(t)
        if n >= chars:
            yield first, held
            first, held, n = i + 1, [], 0
    if held:
        yield first, held


def list_array(flat: np.ndarray, sizes: list[int] | np.ndarray) -> pa.Array:
    """Arrow lists of the given sizes over one flat array."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
