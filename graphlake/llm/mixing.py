"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the wanted mix in proportion to its weight. A source never gives more than
`max_epochs` times its own size; what a capped source can't take is dealt to the others by weight until no source
is above its cap. The fixed point is found in closed form: with sources ordered by cap/weight, the capped ones are a
prefix, and the rest share what remains at one common level.

A source's target becomes whole repetitions of all its documents plus a seeded fractional repetition: documents
stand in the order of a hash, and are taken until the rest of the target is used up. The last one is taken in part,
so each source meets its target to the word. The order is cut into cells of the hash: sums per (source, cell) find
the cell in which the rest ends, and only that cell's documents are put in order, so no task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
#: Hexadecimal digits of the hash that name a cell.
CELL_DIGITS = 3
#: So many sources' plans are broadcast at most; more are joined by shuffle.
BROADCAST_SOURCES = 10_000


def water_fill(sources: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds `target` to one row per source (`weight` double, `source_size` long).

    Sources of size 0 get 0. The table has a row per source, so one ordered window over it is small.
    """
    order = Window.orderBy("_ratio", "_null", "source").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("_ratio", "_null", "source").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = Window.partitionBy()
    level = (share * F.sum("source_size").over(total) - F.coalesce(F.sum("_cap").over(order), F.lit(0.0))) / F.sum("weight").over(rest)
    df = (
        sources.withColumn("_cap", (F.col("source_size") * max_epochs).cast("double"))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_null", F.col("source").isNull())
        .withColumn("_level", level)
        .withColumn("_open", F.col("_level") * F.col("weight") < F.col("_cap"))
    )
    common_level = F.min_by(F.when(F.col("_open"), F.col("_level")), F.when(F.col("_open"), F.col("_ratio"))).over(total)
    return df.withColumn("target", F.when(F.col("_open"), common_level * F.col("weight")).otherwise(F.col("_cap"))).drop("_cap", "_ratio", "_null", "_level", "_open")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, size=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken and the columns in `keep`.

    `size` is a Column (default: the number of words; null text has 0). A null source is a source of its own, ranked
    last. Rows that are equal, ids included, are told apart by nothing, so any of them may be the one taken in part.
    An empty table gives an empty result.
    """
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(common.WORD)), F.lit(0)) if size is None else size
    def sized(columns):
        own = docs.select(*columns, "doc_id", F.col("source"), words.cast("long").alias("size"))
        return own.withColumn("_h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("_cell", F.substring("_h", 1, CELL_DIGITS))

    base = common.cut(sized(()))
    cells = base.groupBy("source", "_cell").agg(F.sum("size").alias("_n"))
    sources = cells.groupBy("source").agg(F.sum("_n").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    filled = water_fill(sources.withColumn("weight", weight), share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    filled = filled.withColumn("_epochs", epochs.cast("long")).withColumn("_rest", F.round("target").cast("long") - F.col("_epochs") * F.col("source_size"))
    filled = filled.withColumn("_rest", F.greatest(F.col("_rest"), F.lit(0)))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keyed = cells.withColumn("_before", before).withColumnRenamed("source", "_s")
    cells_of = filled.join(keyed, F.col("source").eqNullSafe(F.col("_s")))
    ends = cells_of.filter((F.col("_before") < F.col("_rest")) & (F.col("_rest") <= F.col("_before") + F.col("_n")))
    ends = ends.select(F.col("_s").alias("_e"), F.col("_cell").alias("_end"), (F.col("_rest") - F.col("_before")).alias("_rest_in"))
    plan = filled.withColumnRenamed("source", "_s").join(ends, F.col("_s").eqNullSafe(F.col("_e")), "left").drop("_e", "weight", "_rest")
    plan = common.cut(plan)
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    placed = (sized(keep) if keep else base).join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    inside = F.col("_cell") == F.col("_end")
    order = Window.partitionBy("source", "_cell").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    cutoff = placed.filter(inside).withColumn("_b", F.coalesce(F.sum("size").over(order), F.lit(0)))
    cutoff = cutoff.withColumn("_extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest_in") - F.col("_b")))).drop("_b")
    others = placed.filter(~F.coalesce(inside, F.lit(False))).withColumn("_extra", F.when(F.col("_cell") < F.col("_end"), F.col("size")).otherwise(F.lit(0)))
    out = others.unionByName(cutoff)
    return out.select(*keep, "doc_id", "source", "size", "source_size", "target", (F.col("_epochs") * F.col("size") + F.col("_extra")).cast("long").alias("taken"))


def repeat(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: `columns` of each taken row once per repetition, a partial one with its first words and n_chars.

    `mixed` is a result of mix() that kept the text. Rows of no words are not taken.
    """
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rest = (F.col("taken") - whole * F.col("size")).cast("int")
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(common.WORD), F.lit(0)), F.lit(1), F.greatest(rest, F.lit(1))), " ")
    texts = F.filter(F.concat(F.array_repeat(F.col("text"), whole), F.array(F.when(rest > 0, part))), lambda t: t.isNotNull())
    out = mixed.withColumn("_text", F.explode(texts))
    own = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return out.select(*(own.get(c, F.col(c)).alias(c) for c in columns))
