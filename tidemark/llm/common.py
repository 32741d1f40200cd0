"""What the operators share: text columns, columns carried past Python, word hashes and samples."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tidemark.scratch import discard, materialize, shared_folder

__all__ = ["bounded_sample", "carry", "discard", "fold_words", "fresh_name", "held_out", "materialize", "mix", "shared_folder", "slices", "table", "whole_text"]

#: A Python worker turns so many bytes of a batch into Python objects at a time, or one row.
SLICE_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fold_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8 (bytes methods touch ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(values: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over the word."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def held_out(modulus: int, remainder: int) -> Column:
    """True for rows held out: crc32(doc_id as text) mod ``modulus`` is ``remainder``. A null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def bounded_sample(df: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows, the same ones at every run: those with the smallest hash of doc_id."""
    return df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def slices(batch: pa.RecordBatch, used: list[str], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes in the columns ``used``, one row at least."""
    if not len(batch):
        return
    step = max(1, len(batch) * limit // max(1, sum(batch.column(c).nbytes for c in used)))
    for at in range(0, len(batch), step):
        part = batch.slice(at, step)
        if len(part) > 1 and sum(part.column(c).nbytes for c in used) > 2 * limit:
            half = len(part) // 2
            yield from slices(part.slice(0, half), used, limit)
            yield from slices(part.slice(half), used, limit)
        else:
            yield part


def carry(rows: DataFrame, carried: list[str], used: list[str], made: str, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame | pa.Table]]) -> DataFrame:
    """The columns ``carried`` of ``rows``, which never pass through pandas, beside the columns ``made`` of ``run``.

    ``run`` gets pandas frames of the columns ``used`` and gives frames, or Arrow tables, of the columns made, for the same rows in
    the same order but cut as it likes. A nullable 64-bit number among ``carried`` stays what it is.
    """
    made_type = StructType.fromDDL(made)
    made_schema = to_arrow_schema(made_type)
    names = [*carried, *made_type.names]
    plain = {c: f"c{k}" for k, c in enumerate(dict.fromkeys([*carried, *used]))}  # names that Python functions can't take are set aside
    held, read = [plain[c] for c in carried], [plain[c] for c in used]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[pa.RecordBatch] = deque()

        def feed() -> Iterator[pd.DataFrame]:
            for batch in batches:
                for part in slices(batch, read):
                    waiting.append(part.select(held))
                    yield part.select(read).to_pandas().set_axis(used, axis=1)

        for frame in run(feed()):
            whole = frame.select(made_type.names).cast(made_schema) if isinstance(frame, pa.Table) else pa.Table.from_pandas(frame, made_schema, preserve_index=False)
            found = whole.combine_chunks()
            at = 0
            while at < len(frame):
                head = waiting.popleft()
                n = min(len(head), len(frame) - at)
                if n < len(head):
                    waiting.appendleft(head.slice(n))
                own = found.slice(at, n).to_batches()[0]
                yield pa.RecordBatch.from_arrays([*head.slice(0, n).columns, *own.columns], names=names)
                at += n

    kept = rows.select(*(F.col(f"`{c}`").alias(k) for c, k in plain.items()))
    schema = StructType([StructField(c, kept.schema[plain[c]].dataType) for c in carried] + made_type.fields)
    return kept.mapInArrow(task, schema)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores where ``df`` has it already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
