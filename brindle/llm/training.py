"""Bounded training samples and one-task fits, shared by the classifiers.

Cases: labels other than 0 and 1, null ids and held-out rows teach nothing; of labels that disagree
about an id the smaller counts; a null text is an empty one; rows that repeat an id are all taken;
without any labelled row the model is that of an empty sample; an empty table gives empty scores.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import slices
from .shared import text_or_empty

FOLDS = 5


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y) of at most ``per_class`` labelled rows of either class, never of the held-out fold.

    Those with the smallest hash of the id are taken, so the choice is the same on every run.  The
    sample of ids is bounded and so may be broadcast; the texts come from one scan without a shuffle.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 0))
    rows = rows.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("y"))
    some = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy(F.xxhash64("__id"), "__id").limit(per_class)
        some = part if some is None else some.unionByName(part)
    some = some.groupBy("__id").agg(F.min("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("text"))
    return texts.join(F.broadcast(some), "__id").select("__id", "text", "y")


def fit(rows: DataFrame, learn: Callable[[pa.Table], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Run ``learn`` on the bounded sample in one task; its arrays come back as one small row."""

    def packed(table: pa.Table) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **learn(table.sort_by("__id")))
        return out.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([packed(pa.Table.from_batches(got))], pa.binary())], names=["model"])

    models = rows.repartition(1).mapInArrow(run, "model binary").collect()
    nothing = pa.table({"__id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "y": pa.array([], pa.int32())})
    with np.load(io.BytesIO(models[0]["model"] if models else packed(nothing))) as z:
        return {k: z[k] for k in z.files}


def scored(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every text; ``score`` takes the bytes and offsets of a slice."""
    kept = docs.select(F.col(id_col).alias(id_col), F.coalesce(fold(F.col(id_col)) == 0, F.lit(False)).alias("held_out"), text_or_empty(text_col).alias("__text"))
    schema = f"`{id_col}` {kept.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [score(buf, off) for _, _, buf, off in slices(batch.column(2))]
            p = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    return kept.mapInArrow(run, schema)


def accepted(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, all columns unchanged, without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [score(buf, off) for _, _, buf, off in slices(batch.column(at))]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
