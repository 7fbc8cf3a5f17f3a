"""Reserved column names.

Archives prefix their reserved columns in their own way; only the endings are fixed. Readers recognise a prefix by the
index columns under it and rename to the ones below, writers use these unless told another prefix.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .errors import InvalidError

PREFIX = "_gl"
#: Endings of reserved columns.
ENDINGS = ("VertexIndex", "SrcIndex", "DstIndex", "Offset", "Primary", "VertexChunkIndex", "EdgeIndex")
VERTEX, SRC, DST, OFFSET, PRIMARY, VERTEX_CHUNK, EDGE = (PREFIX + e for e in ENDINGS)
LABELS = ":LABEL"
SEPARATOR = "_"
#: Defaults of the format.
VERTEX_CHUNK_SIZE, EDGE_CHUNK_SIZE, FILE_TYPE = 2**18, 2**22, "parquet"
#: Beginning of the names of helper columns; no column of a user's table may begin so.
HIDDEN = "__gl_"


def hidden(name: str) -> str:
    """The name of a helper column."""
    return HIDDEN + name


def refuse_hidden(columns: list[str]) -> None:
    if bad := [c for c in columns if c.startswith(HIDDEN)]:
        raise InvalidError(f"column names can't begin with {HIDDEN!r}: {bad}")


def renames(columns: list[str], expected: list[str]) -> dict[str, str]:
    """Reserved columns of a table to their names under our prefix; all other columns are the user's.

    A prefix is recognised by the index columns that are expected in such a table, all of which it must have there.
    """
    wanted = [e[len(PREFIX) :] for e in expected]
    prefixes = [c[: -len(wanted[0])] for c in columns if c.endswith(wanted[0])] if wanted else []
    fine = [p for p in prefixes if re.fullmatch("_[A-Za-z]*", p) and all(p + e in columns for e in wanted)]
    own = min(fine, key=lambda p: (p != PREFIX, len(p)), default=None)
    return {own + e: PREFIX + e for e in ENDINGS if own + e in columns} if own is not None else {}


def to_own(df: DataFrame, expected: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in renames(df.columns, expected).items() if k != v})


def to_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Reserved columns under an archive's prefix."""
    return df.withColumnsRenamed({PREFIX + e: prefix + e for e in ENDINGS if PREFIX + e in df.columns and prefix != PREFIX})
