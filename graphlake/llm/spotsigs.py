"""SpotSigs document fingerprints, with DataFrame functions only.

A spot is a common word (the anchor); its signature is the anchor with the chain of the next content words. A text's
fingerprint is the set of its signatures. Two fingerprints are alike by their Jaccard index, which the ratio of their
lengths bounds from above: lengths are cut into partitions such that only sets of the same or the next partition can
be alike enough.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "the a an of and to in is that it for on was be as with by this are at from "
    "le la les un une des du de et en que qui est pour dans sur pas "
    "der die das den dem ein eine und von zu mit auf ist nicht sich im "
    "el los las y del se por con para su al como"
).split()
CHAIN = 2
THRESHOLD = 0.8
NOT_WORDS = r"[^\p{L}\p{N}]+"
#: Documents that stand in one window to find each one's next; windows grow in number with the documents, cut twice into
#: this many parts at most (2^20 windows: about 100 MB of text each at 100 TB).
WINDOW_ROWS, SPLITS = 256, 1_024


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct signatures (64-bit hashes). A text of words without a spot has the chain of all its words as its only one."""
    words = F.split(F.lower(text), NOT_WORDS)
    anchor = lambda w: w.isin(ANCHORS)

    def of(state):
        words = state["w"]
        content = F.filter(words, lambda w: (w != "") & ~anchor(w))
        spots = F.filter(F.transform(words, lambda w, i: F.when(anchor(w), i).otherwise(-1)), lambda i: i >= 0)
        return F.struct(words.alias("w"), content.alias("c"), spots.alias("s"), F.when(words[0] == "", 1).otherwise(0).alias("skip"))

    def sign(state):
        at = lambda p, j: p - j - state["skip"]
        listed = F.transform(state["s"], lambda p, j: F.when(at(p, j) + chain <= F.size(state["c"]), F.xxhash64(F.element_at(state["w"], p + 1), F.slice(state["c"], at(p, j) + 1, F.lit(chain)))))
        whole = F.filter(state["w"], lambda w: w != "")
        own = F.array_sort(F.array_distinct(F.filter(listed, lambda x: x.isNotNull())))
        return F.when(F.size(own) > 0, own).when(F.size(whole) > 0, F.array(F.xxhash64(whole))).otherwise(F.array().cast("array<bigint>"))

    # each step is bound once, as the only element of an array
    bound = F.transform(F.transform(F.array(F.struct(words.alias("w"))), of), sign)
    return bound[0]


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two fingerprints (1 for two empty ones)."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def as_text(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lower(F.hex(x))), " ")


def length_partition(length: Column, threshold: float = THRESHOLD) -> Column:
    """Number of a set's length partition: alike sets are in the same or in neighbouring ones."""
    return F.when(length > 0, F.floor(F.log(length.cast("double")) / math.log(1 / threshold) + 1e-9)).otherwise(-1).cast("int")


def alike(prints: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """id_a, id_b, likeness of pairs of distinct fingerprints (`id`, `signature`) alike at least `threshold`.

    Rows with equal fingerprints count as one, under their smallest id; empty fingerprints pair with none. A set's
    rarest signatures are its prefix: alike sets share one of them, so pairs are only made from these, within a set's
    partition and the next, and only where the lengths allow.
    """
    sets = prints.filter(F.size("signature") > 0).groupBy("signature").agg(F.min("id").alias("id")).withColumn("n", F.size("signature"))
    each = sets.select("id", "n", F.explode("signature").alias("sig"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "sig"))
    prefix = each.join(each.groupBy("sig").agg(F.count("*").alias("df")), "sig").withColumn("_r", rank).filter(F.col("_r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    prefix = prefix.withColumn("part", length_partition(F.col("n"), threshold)).select("id", "n", "sig", "part")
    left = prefix.select(F.col("id").alias("id_a"), F.col("n").alias("n_a"), "sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = prefix.select(F.col("id").alias("id_b"), F.col("n").alias("n_b"), "sig", "part")
    pairs = left.join(right, ["sig", "part"]).filter((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b"))))
    pairs = pairs.filter(F.col("n_a") >= F.col("n_b") * threshold - 1e-9).select("id_a", "id_b").distinct()
    sig = sets.select("id", "signature")
    pairs = pairs.join(sig.withColumnsRenamed({"id": "id_a", "signature": "_a"}), "id_a").join(sig.withColumnsRenamed({"id": "id_b", "signature": "_b"}), "id_b")
    return pairs.select("id_a", "id_b", likeness(F.col("_a"), F.col("_b")).alias("likeness")).filter(F.col("likeness") >= threshold - 1e-12)


def _bucket(value: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds are at most the value, by two short searches."""
    step = max(1, math.isqrt(len(bounds)))
    rows = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    full = [r + [None] * (step - len(r)) for r in rows]
    literal = F.array(*[F.array(*[F.lit(x).cast("double") for x in r]) for r in full])
    heads = F.array(*[F.lit(r[0]).cast("double") for r in rows])
    row = F.size(F.filter(heads, lambda b: b <= value))
    return F.when(row == 0, 0).otherwise((row - 1) * step + F.size(F.filter(F.element_at(literal, F.greatest(row, F.lit(1))), lambda b: b <= value)))


def _along(doc_id: Column, tie: Column) -> Column:
    """A number that never falls along (doc_id, tie), nulls first; it tells rows of one id apart where the id is below 2^53."""
    share = tie.cast("double") / float(1 << 64) + 0.5
    return F.when(doc_id.isNull(), (share - 2.0) * 1e300).otherwise(doc_id.cast("double") + share)


def _windows(rows: DataFrame, window_rows: int, splits: int) -> DataFrame:
    """Adds `_bucket`: the number of the window of about `window_rows` rows along `_along`, ascending with it.

    Quantiles cut the rows into parts and each part again; at most `splits` each time. The driver holds the bounds of
    the first cut, and those of the second are a table of one row per part (8 MB at most), checkpointed, as merged
    quantiles depend on the order of tasks.
    """
    windows = max(1, rows.count() // window_rows)
    if windows == 1:
        return rows.withColumn("_bucket", F.lit(0).cast("long"))
    outer = min(splits, math.isqrt(windows - 1) + 1)
    inner = min(splits, -(-windows // outer))
    shares = lambda k: [i / k for i in range(1, k)]
    bounds = sorted(set(rows.agg(F.percentile_approx("_along", shares(outer), 10_000)).first()[0] or [])) if outer > 1 else []
    parted = rows.withColumn("_part", _bucket(F.col("_along"), bounds).cast("long") if bounds else F.lit(0).cast("long"))
    if inner == 1:
        return parted.withColumnRenamed("_part", "_bucket")
    cuts = common.cut(parted.groupBy("_part").agg(F.percentile_approx("_along", shares(inner), 10 * inner).alias("_cuts")))
    within = F.size(F.filter("_cuts", lambda b: b <= F.col("_along")))
    return parted.join(F.broadcast(cuts), "_part").withColumn("_bucket", F.col("_part") * inner + within).drop("_part", "_cuts")


def with_next(docs: DataFrame, columns: list[str], window_rows: int = WINDOW_ROWS, splits: int = SPLITS) -> DataFrame:
    """Adds `next_<c>` for each column: of the row with the next smaller doc_id, and after the smallest that of the largest.

    Rows are cut by quantiles of (doc_id, `_tie`) into windows, so that rows of one id needn't share one; the largest row
    of a window is also sent to the next higher one. Null ids rank lowest. A single row is its own next. Rows that are
    equal in both are in one window, whatever their number, and next to each other.
    """
    own = docs.withColumn("_id", F.col("doc_id").cast("long"))
    own = _windows(own.withColumn("_along", _along(F.col("_id"), F.col("_tie"))), window_rows, splits).drop("_along")
    at = F.struct("_id", "_tie")
    tops = own.groupBy("_bucket").agg(F.max(at).alias("_top"))
    everything = Window.orderBy("_bucket")  # over one row per window, of which there are splits ** 2 at most
    above = F.lead("_bucket").over(everything)
    tops = tops.withColumn("_to", F.coalesce(above, F.first("_bucket").over(everything))).withColumn("_wraps", above.isNull())
    sent = F.when(at.eqNullSafe(F.col("_top")), F.struct(F.col("_to").alias("to"), F.lit(True).alias("ghost"), F.col("_wraps").alias("wraps")))
    stays = F.struct(F.col("_bucket").alias("to"), F.lit(False).alias("ghost"), F.lit(False).alias("wraps"))
    placed = own.join(F.broadcast(tops), "_bucket").withColumn("_at", F.explode(F.filter(F.array(stays, sent), lambda x: x.isNotNull()))).drop("_bucket", "_top", "_to", "_wraps")
    order = Window.partitionBy("_at.to").orderBy("_at.wraps", F.col("_id").desc_nulls_last(), F.col("_tie").desc())
    out = placed.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return out.filter(~F.col("_at.ghost")).drop("_at", "_id")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited text, both fingerprints and their likenesses, for every row.

    The edited text has the last half of the code points replaced by the first as many of the next document. Null text
    is empty, and its fingerprint too; two empty fingerprints are alike. Rows that repeat a doc_id are rows of their
    own, in the order of a hash of their texts; a null id ranks lowest. An empty table gives an empty result.
    """
    own = docs.select("doc_id", common.text_or_empty().alias("_text")).withColumn("_sig", signatures(F.col("_text"))).withColumn("_tie", F.xxhash64("_text"))
    rows = with_next(own, ["_text", "_sig"])
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("_text", F.lit(1), n - half), F.substring("next__text", F.lit(1), half)))
    rows = rows.withColumn("_edited_sig", signatures(F.col("edited")))
    return rows.select("doc_id", "n_chars", "edited", F.col("_sig").alias("signature"), F.col("_edited_sig").alias("edited_signature"), likeness(F.col("_sig"), F.col("_edited_sig")).alias("near_edited"), likeness(F.col("_sig"), F.col("next__sig")).alias("near_next"))
