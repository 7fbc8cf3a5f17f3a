"""Scalar functions of the format, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidError


def split_values(column: Column, separator: str = ";") -> Column:
    """Labels or many-valued properties in one string; null stays null, an empty string is no value."""
    return F.when(column == "", F.array().cast("array<string>")).otherwise(F.split(column, "\\" + separator))


def has_label(labels: Column, label: str) -> Column:
    """Membership in a label list; no list is no label."""
    return F.coalesce(F.array_contains(labels, label), F.lit(False))


def label_list(flags: dict[str, Column]) -> Column:
    """One boolean per label to the list of those that hold, in the given order."""
    if not flags:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*(F.when(flag, F.lit(label)) for label, flag in flags.items())))


def chunk_of(index: Column, size: int) -> Column:
    if size <= 0:
        raise InvalidError("chunk size must be positive")
    return F.floor(index / F.lit(size)).cast("long")


def place_in_chunk(index: Column, size: int) -> Column:
    return F.pmod(index, F.lit(size)).cast("long")


def is_set(values: Column) -> Column:
    """Whether no value repeats; null is a set."""
    return F.coalesce(F.size(values) == F.size(F.array_distinct(values)), F.lit(True))


def element(values: Column, place: int) -> Column:
    """Element at a place from 0, null beyond the end."""
    return F.try_element_at(values, F.lit(place + 1))


def date_from_days(days: Column) -> Column:
    return F.date_from_unix_date(days.cast("int"))


def timestamp_from_millis(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def to_millis_precision(ts: Column) -> Column:
    """A timestamp cut to whole milliseconds, as stored."""
    return F.timestamp_millis(F.unix_millis(ts))


def little_endian_long(binary: Column) -> Column:
    """The long in eight bytes, lowest first."""
    signed = lambda b: F.conv(F.hex(F.substring(binary, b, 1)), 16, 10).cast("long")
    low = reduce(lambda a, b: a.bitwiseOR(F.shiftleft(signed(b), 8 * (b - 1))), range(2, 9), signed(1))
    return low


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
