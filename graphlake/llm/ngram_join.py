"""Jaccard self-join of word n-gram sets by PartEnum signatures, and its connected components.

Sets of sizes a and b with a Jaccard index of at least 0.8 differ in at most (a + b) / 9 elements. Sizes are cut into
bands; a pair belongs to the band of its larger set, and each band has its own partition of the feature domain into
more parts than the largest difference. A set's signatures are its projections onto the parts, so two sets that are
similar enough agree on at least one. Two exact rules keep this cheap:

- a pair whose sets hold more non-empty parts than they may differ in agrees on a non-empty one, so empty parts give
  no signature but for the few sets that can't rely on this (`slack` below 1);
- in the same way a set may do without signatures that many sets share, as long as more than it may differ in remain;
  sets that can't are matched with each other by their rarest features instead.

Sets of equal features are one. Signatures pass a filter of those seen twice before anything is shuffled. In each
group of a shared signature all sets are compared with one; only where a group is not yet in one component are the
pairs across components compared too. Features are 64-bit hashes, and so are set identities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, common, counts, textops
from .components import components, extended

WORDS = 5
#: A pair links when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Parts for each element of the largest difference, and sets that may share a signature before it counts as common.
PARTS, COMMON = 1.5, 24
#: Bits of the filter for each document and its largest size (256 MB are broadcast at most).
BITS_PER_DOC, MIN_BITS, MAX_BITS = 1_024, 1 << 20, 1 << 31
CELLS = 256
#: Sets of a large group that its others are compared with in a round, and rounds, before all open pairs are compared.
PIVOTS, ROUNDS = 8, 2
_BANDS = np.unique(np.ceil(1.5 ** np.arange(0, 80)).astype(np.int64))[:60]
_TAG = np.uint64(63)


def _largest_difference(total):
    """Elements in which sets of this total size may differ at most."""
    return total * (100 - PERCENT) // (100 + PERCENT)


def _own_band(size: np.ndarray) -> np.ndarray:
    return np.searchsorted(_BANDS, np.maximum(size, 1), side="right") - 1


def _parts_of(band: np.ndarray) -> np.ndarray:
    most = _largest_difference(2 * (_BANDS[band + 1] - 1))
    return np.where(most == 0, 1, np.ceil(PARTS * most).astype(np.int64) + 2)


def feature_sets(texts) -> object:
    """Yields (first row, features, row of each, set size per row, set identity per row) over slices of a text column."""
    for lo, hashes, row, count in textops.word_hashes(texts):
        features, of = textops.distinct(*textops.shingle_hashes(hashes, row, count, WORDS))
        size = np.bincount(of, minlength=len(count))
        sums = np.zeros(len(features) + 1, np.uint64)
        np.cumsum(textops.mix(features + np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
        ends = np.cumsum(size)
        identity = textops.mix((sums[ends] - sums[ends - size]) + size.astype(np.uint64))
        yield lo, features, of, size, identity


def signatures(features: np.ndarray, of: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, their rows and their rows' slack: non-empty parts beyond the largest difference."""
    out = []
    own_band = _own_band(size)
    mixed = textops.mix(features)
    for up in (0, 1):
        band = own_band + up
        partner = np.minimum(size * 100 // PERCENT, _BANDS[band + 1] - 1)
        rows = (size > 0) & (partner >= np.where(up, _BANDS[band], 1))
        if not rows.any():
            continue
        parts = np.where(rows, _parts_of(band), 0)
        base = np.cumsum(parts) - parts
        taken = rows[of]
        f, o = mixed[taken], of[taken]
        part = textops.mix(f ^ (band[o].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % parts[o].astype(np.uint64)
        cell = base[o] + part.astype(np.int64)
        order = np.argsort(cell)
        cell, f, o = cell[order], f[order], o[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        row, place = o[first], cell[first] - base[o[first]]
        name = (band[row].astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64)
        sig = textops.mix(np.add.reduceat(f, first) ^ textops.mix(name))
        slack = np.bincount(row, minlength=len(size)) - _largest_difference(size + partner)
        out.append((sig & ~_TAG | band[row].astype(np.uint64), row, slack[row]))
        for r in np.flatnonzero(rows & (slack < 1)):
            empty = np.setdiff1d(np.arange(parts[r]), place[row == r])
            name = (np.uint64(band[r]) << np.uint64(32)) | empty.astype(np.uint64)
            out.append((textops.mix(textops.mix(name) + np.uint64(1)) & ~_TAG | np.uint64(band[r]), np.full(len(empty), r), np.full(len(empty), slack[r])))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_FIRST = f"doc_id long, set_id long, n long, {bloom.PARTS_SCHEMA}"


def _first_pass(bits: int):
    """Rows (doc_id, set_id, n) of all texts, and a task's parts of the filters of their sets' signatures."""

    def run(batches):
        met, seen = set(), []
        names = [f.split()[0] for f in _FIRST.split(", ")]
        for batch in batches:
            for lo, features, of, size, identity in feature_sets(batch.column(1)):
                n, ids = len(size), batch.column(0).slice(lo, len(size))
                fresh = _fresh(size, identity, met)
                seen.append(signatures(features[fresh[of]], (np.cumsum(fresh) - 1)[of[fresh[of]]], size[fresh])[0])
                none = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays([ids, pa.array(identity.view(np.int64)), pa.array(size.astype(np.int64)), *none], names=names)
        for segment, once, twice in bloom.parts(seen, bits):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(3)), pa.array([segment], pa.int64()), pa.array([once], pa.binary()), pa.array([twice], pa.binary())], names=names)

    return run


def _fresh(size: np.ndarray, identity: np.ndarray, met: set) -> np.ndarray:
    """Which sets aren't empty and are the first of equal ones in a task."""
    _, first = np.unique(identity, return_index=True)
    fresh = np.zeros(len(size), dtype=bool)
    fresh[[i for i in first if size[i] and int(identity[i]) not in met]] = True
    met.update(identity[fresh].tolist())
    return fresh


_ROWS = "set_id long, sig long, n long, band int, slack array<int>, cells binary, features binary"


def _suspected_rows(bitmap_of):
    """Rows (set, signature) of suspected signatures; and one row of each set that has any, with its slack in both its bands."""

    def run(batches):
        met: set = set()
        names = [f.split()[0] for f in _ROWS.split(", ")]
        for batch in batches:
            for _, features, of, size, identity in feature_sets(batch.column(0)):
                fresh = _fresh(size, identity, met)
                features, of, size, identity = features[fresh[of]], (np.cumsum(fresh) - 1)[of[fresh[of]]], size[fresh], identity[fresh]
                sig, row, slack = signatures(features, of, size)
                ok = bloom.suspected(sig, bitmap_of.value)
                sig, row, slack = sig[ok], row[ok], slack[ok]
                # sets that link share as many signatures of their band as their slack: with fewer, there is no partner
                place = row * 64 + (sig & _TAG).astype(np.int64)
                able = np.bincount(place, minlength=1)[place] >= slack if len(place) else np.zeros(0, dtype=bool)
                sig, row, slack = sig[able], row[able], slack[able]
                held = np.unique(row)
                ends = np.cumsum(size)
                own = _own_band(size)
                slacks = np.zeros((len(size), 2), np.int32)
                slacks[row, (sig & _TAG).astype(np.int64) - own[row]] = slack
                slacks = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * 2, pa.int32()), pa.array(slacks[held].ravel()))
                cells = [np.minimum(np.bincount((features[ends[r] - size[r] : ends[r]] >> np.uint64(7)) % np.uint64(CELLS), minlength=CELLS), 255).astype(np.uint8).tobytes() for r in held]
                packed = [features[ends[r] - size[r] : ends[r]].tobytes() for r in held]
                k, h = len(sig), len(held)
                none = lambda kind, n: pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(identity.view(np.int64)[row]), pa.array(sig.view(np.int64)), none(pa.int64(), k), none(pa.int32(), k), none(pa.list_(pa.int32()), k), none(pa.binary(), k), none(pa.binary(), k)], names=names
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(identity.view(np.int64)[held]), none(pa.int64(), h), pa.array(size[held].astype(np.int64)), pa.array(own[held].astype(np.int32)), slacks, pa.array(cells, pa.binary()), pa.array(packed, pa.binary())],
                    names=names,
                )

    return run


def _near_cells(batches):
    """Pairs whose counts of features by cell don't already differ in too much."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for n in ("cells_a", "cells_b"))
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            ok = np.abs(a - b).sum(axis=1) <= _largest_difference(total)
            yield batch.select(["a", "b"]).filter(pa.array(ok))


def _linked(batches):
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("features_a"), batch.column("features_b"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _verified(pairs: DataFrame, rows: DataFrame, cells: DataFrame, path: str) -> DataFrame:
    """The pairs (a < b) that link, by their whole sets. Features are read for sets of pairs that pass all bounds only."""
    side = lambda df, columns, x: df.select(*(F.col(c).alias({"set_id": x}.get(c, f"{c}_{x}")) for c in columns))
    near = pairs.join(side(cells, ["set_id", "n", "cells"], "a"), "a").join(side(cells, ["set_id", "n", "cells"], "b"), "b")
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT
    near = common.written(near.filter(fits).mapInArrow(_near_cells, "a long, b long"), f"{path}/near")
    wanted = near.select(F.col("a").alias("set_id")).union(near.select(F.col("b").alias("set_id"))).distinct()
    held = rows.filter("features is not null").select("set_id", "features").join(wanted, "set_id", "left_semi")
    held = common.written(held.groupBy("set_id").agg(F.first("features").alias("features")), f"{path}/held")
    whole = near.join(side(held, ["set_id", "features"], "a"), "a").join(side(held, ["set_id", "features"], "b"), "b").select("a", "b", "features_a", "features_b")
    with common.small_batches(rows.sparkSession):
        return common.cut(whole.mapInArrow(_linked, "a long, b long"))


def _shared_least(total):
    """Features that linked sets of this total size share at least."""
    return F.ceil(total * PERCENT / (100 + PERCENT) - 1e-9)


def _rare_features(rows: DataFrame, weak: DataFrame, path: str) -> DataFrame:
    """(sig, set_id, rank) for sets whose signatures are too common to do without: their rarest features.

    Linked sets share the larger's size times PERCENT / 100 at least, so they share one of the larger's rarest
    n - PERCENT n / 100 + 1 features; common ones come last and mostly fall away. Any one order of all features will do,
    so they are ordered by counts in cells, and only the rarest ones leave a task.
    """
    held = rows.filter("features is not null").select("set_id", "n", "features").join(weak, "set_id", "left_semi").groupBy("set_id").agg(F.first("n").alias("n"), F.first("features").alias("features"))
    held = common.written(held, f"{path}_sets")
    total = held.agg(F.sum("n")).first()[0] or 0
    levels = rows.sparkSession.sparkContext.broadcast(counts.counted(held, lambda batch: _features(batch)[0], counts.cells_for(total)))
    rare = common.written(held.mapInArrow(_rarest(levels), "sig long, set_id long, rank int"), path)
    levels.unpersist()
    return rare


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The features of a batch's sets, and their sets' sizes by row."""
    return np.frombuffer(b"".join(batch.column("features").to_pylist()), np.uint64), batch.column("n").to_numpy()


def _rarest(levels_of):
    """Each set's rarest features, with their ranks in the order of levels and features."""

    def run(batches):
        for batch in batches:
            features, n = _features(batch)
            if not len(features):
                continue
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((features, counts.levels_of(features, levels_of.value), row))
            rank = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + 1
            fine = rank <= n[row] + (-n * PERCENT // 100)[row] + 1
            ids = batch.column("set_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(features[order][fine].view(np.int64)), pa.array(ids[row[fine]]), pa.array(rank[fine].astype(np.int32))], names=["sig", "set_id", "rank"])

    return run


def _with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found, F.col("set_id") == F.col("node"), "left").withColumn("_c", F.coalesce("component", "set_id")).drop("node", "component")


def _worth(a, b):
    """Whether two sets (structs of n, c, rank) of one group may link and aren't linked yet."""
    low, high = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
    small = F.when(a["n"] <= b["n"], a["rank"]).otherwise(b["rank"])
    still = 1 + F.least(a["n"] - a["rank"], b["n"] - b["rank"])  # features that may be shared from here on
    able = a["rank"].isNull() | ((small <= low - _shared_least(low + low) + 1) & (still >= _shared_least(a["n"] + b["n"])))
    return (a["c"] != b["c"]) & (low * 100 >= high * PERCENT) & able


def _pivot_pairs(large: DataFrame, found: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b): the sets of groups that are in several components, each with the group's few pivots of this round.

    A hash deals a group's sets into PIVOTS classes, and each class's pivot is the set that has most company in all its
    groups: the original of a family of copies is in most of their groups.
    """
    company = large.groupBy("set_id").agg(F.sum("_sets").alias("_w"))
    own = F.struct("n", F.col("_c").alias("c"), "rank").alias("own")
    rows = _with_component(large, found).join(sizes, "set_id").join(company, "set_id").select("sig", "set_id", "_w", own)
    dealt = F.pmod(F.xxhash64(F.lit(k), "set_id"), F.lit(PIVOTS))
    best = lambda j: F.max(F.when(dealt == j, F.struct("_w", "set_id", "own")))
    pivots = rows.groupBy("sig").agg(F.array(*map(best, range(PIVOTS))).alias("_p"), F.min("own.c").alias("_lo"), F.max("own.c").alias("_hi")).filter("_lo < _hi").select("sig", "_p")
    pair = F.explode(F.filter("_p", lambda p: p.isNotNull() & _worth(p["own"], F.col("own"))))
    pairs = rows.join(pivots, "sig").select("set_id", pair.alias("_q")).select("set_id", F.col("_q.set_id").alias("_b"))
    return pairs.select(F.least("set_id", "_b").alias("a"), F.greatest("set_id", "_b").alias("b")).distinct()


def cluster(docs: DataFrame, common_sets: int = COMMON, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, set_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) and component_set
    (the same of set_id), for every row.

    Rows with no words (null or empty text) have no features, link with nothing and are their own component. Rows of
    equal features are linked. Rows with a null doc_id take part; a component's id is its smallest id that isn't null.
    Rows that repeat a doc_id are rows of their own, told apart by set_id, the identity of a row's features; if they are
    in several components, these have one component_id, and component_set tells them apart.
    """
    spark = docs.sparkSession
    texts = docs.select(common.text_or_empty().alias("text"))
    bits = min(max_bits, max(MIN_BITS, common.pow2_at_least(docs.count() * BITS_PER_DOC)))
    with common.scratch(spark) as path:
        with common.small_batches(spark, 1_024):
            first = common.written(docs.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text")).mapInArrow(_first_pass(bits), _FIRST), f"{path}/first")
        base = first.filter("segment is null").select("doc_id", "set_id", "n")
        bitmap = spark.sparkContext.broadcast(bloom.merged(first.filter("segment is not null").select("segment", "once", "twice"), bits))
        with common.small_batches(spark, 1_024):
            rows = common.written(texts.mapInArrow(_suspected_rows(bitmap), _ROWS), f"{path}/rows")
        bitmap.unpersist()
        sigs = rows.filter("sig is not null").select("set_id", "sig").repartition("sig")  # one exchange for the groups and for what is joined with them
        sets = rows.filter("features is not null")
        cells = common.written(sets.groupBy("set_id").agg(*(F.first(c).alias(c) for c in ("n", "band", "slack", "cells"))), f"{path}/cells")
        sizes = cells.select("set_id", "n")
        shared = sigs.groupBy("sig").agg(F.min("set_id").alias("a"), F.max("set_id").alias("_q"), F.count("*").alias("_sets")).filter("a < _q").select("sig", "a", "_sets")
        members = common.written(sigs.join(shared, "sig"), f"{path}/members")
        often = members.filter(F.col("_sets") > common_sets)
        lost = often.groupBy("set_id", F.col("sig").bitwiseAND(F.lit(63)).cast("int").alias("_band")).agg(F.count_distinct("sig").alias("_lost"))
        weak = lost.join(cells.select("set_id", "band", "slack"), "set_id").filter(F.get("slack", F.col("_band") - F.col("band")) - F.col("_lost") < 1).select("set_id").distinct()
        with common.small_batches(spark):
            rare = _rare_features(rows, weak, f"{path}/rare")
        groups = rare.groupBy("sig").agg(F.min("set_id").alias("a"), F.max("set_id").alias("_q"), F.count("*").alias("_sets")).filter("a < _q").select("sig", "a", "_sets")
        members = members.filter(F.col("_sets") <= common_sets).select("sig", "a", "_sets", "set_id", F.lit(None).cast("int").alias("rank"))
        members = members.unionByName(rare.join(groups, "sig").select("sig", "a", "_sets", "set_id", "rank"))
        star = common.cut(members.filter("a < set_id").select("a", F.col("set_id").alias("b")).distinct())
        found = components(_verified(star, rows, cells, f"{path}/star"))
        # groups of two are done; in large ones, sets are compared with a few pivots for some rounds before all that are
        # still in different components are compared with each other
        wide = members.filter("_sets > 2")
        for k in range(ROUNDS):
            pairs = common.written(_pivot_pairs(wide.filter(F.col("_sets") > 2 * PIVOTS), found, sizes, k), f"{path}/pivots{k}")
            links = _verified(pairs, rows, cells, f"{path}/round{k}")
            if links.isEmpty():
                break
            found = extended(found, links, f"{path}/found{k}")
        of = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"_c{x}"))
        apart = star.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("_ca", "a") != F.coalesce("_cb", "b"))
        split = wide.join(apart.select("a", F.col("b").alias("set_id")), ["a", "set_id"], "left_semi").select("sig").distinct()
        open_rows = _with_component(wide.filter("a < set_id").join(split, "sig", "left_semi"), found).join(sizes, "set_id")
        x, y = (open_rows.select("sig", F.col("set_id").alias(s), F.struct("n", F.col("_c").alias("c"), "rank").alias(f"_{s}")) for s in "ab")
        same_kind = F.col("_a.rank").isNull().eqNullSafe(F.col("_b.rank").isNull())
        across = x.join(y, "sig").filter((F.col("a") < F.col("b")) & same_kind & _worth(F.col("_a"), F.col("_b"))).select("a", "b").distinct()
        found = extended(found, _verified(common.written(across, f"{path}/pairs"), rows, cells, f"{path}/across"), f"{path}/found")
        # ids by sets first: a component is then joined by its sets, not by its rows
        of_sets = _with_component(base.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("_id")), found)
        smallest = of_sets.join(of_sets.groupBy("_c").agg(F.min("_id").alias("component_id")), "_c").select("set_id", "component_id", F.col("_c").alias("component_set"))
        named = base.filter("n > 0").join(smallest, "set_id").select("doc_id", "set_id", F.col("n").alias("n_shingles"), "component_id", "component_set")
        alone = base.filter("n = 0").select("doc_id", "set_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component_set"))
        return common.cut(named.unionByName(alone))


def _identified(batches):
    """The rows with the identity of each text's set after them."""
    for batch in batches:
        ids = np.concatenate([np.zeros(0, np.uint64), *(identity for _, _, _, _, identity in feature_sets(batch.column(batch.num_columns - 1)))])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids.view(np.int64))], names=[*batch.schema.names[:-1], "_set"])


def one_of_each(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, doc_id among them, of one row of each component: that of the smallest doc_id.

    Of rows that repeat this id within the component, the least of all columns stays, so that reruns agree. Rows
    without words stay, all of them; an empty table gives an empty result.
    """
    found = cluster(docs).withColumn("_kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    ids = common.cut(found.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_all"), F.max("_kept").alias("_kept")).filter("_kept"))
    own = F.col("doc_id").eqNullSafe(F.col("_id"))
    several = ids.filter("_all > 1")
    one = docs.select(*columns).join(ids.filter("_all = 1").select("_id"), own, "left_semi")
    if several.isEmpty():
        return one
    rows = docs.select(*columns, common.text_or_empty().alias("_set")).join(several.select("_id"), own, "left_semi")
    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in columns)
    with common.small_batches(docs.sparkSession, 1_024):
        rows = common.cut(rows.mapInArrow(_identified, f"{schema}, _set long"))
    kept = found.filter("_kept").select(F.col("doc_id").alias("_id"), F.col("set_id").alias("_s"), F.col("component_set").alias("_c"), (F.col("n_shingles") == 0).alias("_empty")).distinct()
    rows = rows.join(kept, own & (F.col("_set") == F.col("_s")))
    first = rows.filter("not _empty").groupBy("_id", "_c").agg(F.min(F.struct(*columns)).alias("_r")).select("_r.*")
    return one.unionByName(first).unionByName(rows.filter("_empty").select(*columns))
