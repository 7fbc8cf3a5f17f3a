"""Vertex labels: one boolean column each, one list, or bitmaps.

A bitmap says for one label which of BITS consecutive ids have it. Conjunctions, disjunctions and counts of labels read
bitmaps, a bit for a vertex, and no rows; only where ids are asked for do set bits become rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import names
from ..errors import InvalidError, MissingKeyError
from ..functions import scalars
from ..session import ship


def flags(labels: list[str], column: str = names.LABELS) -> list[Column]:
    """One boolean per label, from the list of labels."""
    return [scalars.has_label(F.col(f"`{column}`"), x).alias(x) for x in labels]


def to_flags(df: DataFrame, labels: list[str], column: str = names.LABELS) -> DataFrame:
    """id and one boolean per label, from the list of labels."""
    if not labels:
        raise InvalidError("the type declares no labels")
    return df.select(names.VERTEX, *flags(labels, column))


def to_list(flags: DataFrame, labels: list[str], column: str = names.LABELS) -> DataFrame:
    """id and the list of labels that hold, from one boolean per label."""
    return flags.select(names.VERTEX, scalars.label_list({x: F.col(f"`{x}`") for x in labels}).alias(column))


def _known(labels: list[str], known: list[str]) -> None:
    if missing := [x for x in labels if x not in known]:
        raise MissingKeyError(f"unknown labels {missing}")


def with_all(df: DataFrame, labels: list[str], known: list[str]) -> DataFrame:
    """Rows of `known` boolean columns at which all of `labels` hold; the filters reach the scan."""
    _known(labels, known)
    return df.filter(scalars.all_of([F.col(f"`{x}`") for x in labels]))


def with_any(df: DataFrame, labels: list[str], known: list[str]) -> DataFrame:
    _known(labels, known)
    return df.filter(scalars.any_of([F.col(f"`{x}`") for x in labels]))


def counts(df: DataFrame, labels: list[str]) -> DataFrame:
    """(label, n) over boolean columns, in one pass."""
    one = df.agg(*(F.count_if(F.col(f"`{x}`")).alias(x) for x in labels))
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, labels)), F.array(*(F.col(f"`{x}`") for x in labels)))).alias("label", "n"))


#: Fixed value: ids that share a bitmap, as the bitmap functions have it.
BITS = 32_768
LABEL, BUCKET, BITMAP = "label", "bucket", "bitmap"


def to_bitmaps(flags: DataFrame, labels: list[str]) -> DataFrame:
    """(label, bucket, bitmap) of one boolean column per label; buckets in which no vertex has a label are left out.

    Tasks set the bits of their own rows first, so what is shuffled are bitmaps.
    """
    held = flags.select(names.VERTEX, F.explode(scalars.label_list({x: F.col(f"`{x}`") for x in labels})).alias(LABEL))
    place = F.col(names.VERTEX) + 1  # the functions count from 1
    return held.groupBy(LABEL, (F.bitmap_bucket_number(place) - 1).alias(BUCKET)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias(BITMAP))


def bitmaps_with_all(bitmaps: DataFrame, labels: list[str], known: list[str]) -> DataFrame:
    """(bucket, bitmap) of the ids that have all the labels; the choice of labels reaches the scan."""
    _known(labels, known)
    wanted = list(dict.fromkeys(labels))
    both = bitmaps.filter(F.col(LABEL).isin(wanted)).groupBy(BUCKET).agg(F.count("*").alias("n"), F.bitmap_and_agg(BITMAP).alias(BITMAP))
    return both.filter(F.col("n") == len(wanted)).select(BUCKET, BITMAP)


def bitmaps_with_any(bitmaps: DataFrame, labels: list[str], known: list[str]) -> DataFrame:
    _known(labels, known)
    return bitmaps.filter(F.col(LABEL).isin(labels)).groupBy(BUCKET).agg(F.bitmap_or_agg(BITMAP).alias(BITMAP))


def bitmap_total(bitmaps: DataFrame) -> DataFrame:
    """One row, n: the bits that are set."""
    return bitmaps.agg(F.coalesce(F.sum(F.bitmap_count(BITMAP)), F.lit(0)).alias("n"))


def bitmap_counts(bitmaps: DataFrame, labels: list[str]) -> DataFrame:
    """(label, n) of all labels, those that no vertex has included."""
    found = bitmaps.groupBy(LABEL).agg(F.sum(F.bitmap_count(BITMAP)).alias("found"))
    every = bitmaps.sparkSession.createDataFrame([(x,) for x in labels], f"{LABEL} string")
    return every.join(found, LABEL, "left").select(LABEL, F.coalesce("found", F.lit(0)).alias("n"))


def ids_of(bitmaps: DataFrame) -> DataFrame:
    """The ids whose bits are set, a bitmap's in one pass."""

    def run(batches):
        for batch in batches:
            for bucket, bitmap in zip(batch.column(BUCKET).to_pylist(), batch.column(BITMAP).to_pylist(), strict=True):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little"))
                yield pa.RecordBatch.from_arrays([pa.array(at + bucket * BITS)], names=[names.VERTEX])

    ship(bitmaps.sparkSession)
    return bitmaps.select(BUCKET, BITMAP).mapInArrow(run, f"{names.VERTEX} long")
