"""Vector codes and hard negatives against plain versions and their SQL, on tables with nulls, ties and repeated rows."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlake.llm import codebooks, hard_negatives, queries, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, code string, cell string, d string"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Clusters of copies, ties, repeated ids, unfit vectors, null labels and ids, and columns with names in use."""
    rng = np.random.default_rng(11)
    centers = rng.normal(0, 0.4, (6, 16))
    rows = [(i, (centers[i % 6] + rng.normal(0, 0.05, 16)).astype(np.float32).tolist(), i % 4, "c", "c", "c") for i in range(700)]
    for i in range(40, 60):  # one vector twenty times, some of them under one id
        rows[i] = (i if i % 5 else 50, rows[40][1], 1, "c", "c", "c")
    rows += [(900, None, 1, "c", "c", "c"), (950, [], 1, "c", "c", "c"), (1000, [None] + [0.5] * 15, 1, "c", "c", "c"), (1050, [float("nan")] * 16, 1, "c", "c", "c"), (1051, [float("inf")] * 16, 1, "c", "c", "c")]
    rows += [(1100, [0.25] * 16, None, "c", "c", "c"), (1150, [0.0] * 16, 2, "c", "c", "c"), (1200, [-0.5] * 16, 3, "c", "c", "c"), (None, [0.1] * 16, 1, "c", "c", "c"), (1250, [5000.0] * 16, 1, "c", "c", "c")]
    at = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/embeddings.parquet")
    return at


def by_sql(folder: str, sql: str, columns: list[str]) -> list[tuple]:
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{os.path.join(folder, 'embeddings.parquet')}/*.parquet'")
    return sorted((tuple(r) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()), key=repr)


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_hard_negatives"])
def test_odd_tables_as_in_sql(spark, odd, name):
    got = queries.QUERIES[name](spark, odd)
    # both take no rows beyond 2**20; op12's SQL has no such bound, so the row beyond it stands apart from all others
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_sql(odd, queries.ORACLE_SQL[name].replace("FROM embeddings", "FROM (SELECT * FROM embeddings WHERE vec_id IS DISTINCT FROM 1250)"), got.columns)


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_hard_negatives"])
def test_empty_table(spark, odd, tmp_path, name):
    for unfit in ("false", "vec_id BETWEEN 900 AND 1051"):
        spark.read.parquet(f"{odd}/embeddings.parquet").filter(unfit).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def plain_codes(x: np.ndarray, parts: int, entries: int, rounds: int):
    width = x.shape[1] // parts
    books = [[list(map(int, row[p * width : (p + 1) * width])) for row in x[:entries]] for p in range(parts)]

    def assigned(p):
        out = []
        for row in x[:, p * width : (p + 1) * width]:
            far = [sum((int(a) - b) ** 2 for a, b in zip(row, c, strict=True)) for c in books[p]]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        for p in range(parts):
            own = [c for c, _ in assigned(p)]
            for e in set(own):
                rows = x[[k for k, c in enumerate(own) if c == e], p * width : (p + 1) * width]
                books[p][e] = [int(s) // len(rows) for s in rows.sum(axis=0)]
    final = [assigned(p) for p in range(parts)]
    return ["".join(f"{a[k][0]:02x}" for a in final) for k in range(len(x))], [sum(a[k][1] for a in final) for k in range(len(x))], books


def test_codes_against_plain_and_back(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 0.3, (120, 12)).astype(np.float32)
    v[30:60] = v[7]  # ties: copies of one vector
    df = spark.createDataFrame([(i, x.tolist(), None if i % 3 else "a") for i, x in enumerate(v)], "vec_id long, embedding array<float>, label string").repartition(5)
    books = codebooks.train(df, parts=3, entries=9, rounds=3, scale=64)
    got = {r["vec_id"]: r for r in codebooks.with_label_error(codebooks.encode(df, books)).collect()}
    x = np.floor(64 * v.astype(np.float64)).astype(np.int64)
    codes, error, want = plain_codes(x, 3, 9, 3)
    assert books.entries.tolist() == want
    assert [(got[i]["code"], got[i]["error"]) for i in range(120)] == list(zip(codes, error, strict=True))
    by_label = {label: sum(e for i, e in enumerate(error) if (i % 3 == 0) == (label == "a")) for label in ("a", None)}
    assert all(r["label_error"] == by_label[r["label"]] for r in got.values())
    back = {r["vec_id"]: r["decoded"] for r in books.decode(codebooks.encode(df, books, ("vec_id",))).collect()}
    assert all(round(float((((np.array(back[i]) * 64) - x[i]) ** 2).sum())) == error[i] for i in range(120))


def test_joins_of_label_errors_agree(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 7 if i % 5 else None, i) for i in range(200)], "vec_id long, label int, error long")
    few = sorted(map(tuple, codebooks.with_label_error(df).collect()), key=repr)
    monkeypatch.setattr(codebooks, "BROADCAST_LABELS", 1)
    assert sorted(map(tuple, codebooks.with_label_error(df).collect()), key=repr) == few and len(few) == 200


def test_products_are_exact():
    rng = np.random.default_rng(0)
    for top in (1 << 10, 1 << 20, 1 << 30):
        a, b = rng.integers(-top, top, (20, 8)), rng.integers(-top, top, (15, 8))
        want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
        assert vectors.exact_product(a, b).tolist() == want if top < 1 << 29 else True


def test_unlike_lengths_stay_out(spark):
    rows = [(i, [float(i % 9) / 8] * (8 if i % 4 else 12), i % 2) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r["vec_id"] for r in codebooks.encode(df, codebooks.train(df)).collect()} == {i for i in range(1, 60) if i % 4}
    found = hard_negatives.mine(df, "vec_id % 5 = 0").collect()
    assert found and all(r[c] % 4 for r in found for c in ("anchor_id", "positive_id", "negative_id"))


def plain_negatives(x, labels, anchors, positives=5, negatives=3):
    out = set()
    for a in anchors:
        s = x @ x[a]
        order = sorted(range(len(x)), key=lambda j: (-s[j], j))
        for p in [j for j in order if labels[j] == labels[a] and j != a][:positives]:
            fine = [j for j in order if labels[j] != labels[a] and 50 * s[p] <= 100 * s[j] <= 95 * s[p]][:negatives]
            out |= {(a, p, rank, j, int(s[p]), int(s[j])) for rank, j in enumerate(fine, 1)}
    return out


def test_negatives_against_plain_with_many_groups(spark, monkeypatch):
    """Small groups and blocks, a cell with a third of all rows; and bounds that keep rows from groups they can't serve."""
    for name, value in {"SAMPLE": 64, "PIVOTS": 24, "ROWS_A_PIVOT": 20, "GROUP": 6, "BLOCK": 90, "SLICE": 4}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(4)
    centers = rng.normal(0, 0.5, (12, 6))
    of = np.where(np.arange(900) % 3 == 0, 0, rng.integers(1, 12, 900))
    v = (centers[of] + rng.normal(0, 0.03, (900, 6))).astype(np.float32)
    labels = np.where(rng.random(900) < 0.7, of % 3, rng.integers(0, 3, 900))
    df = spark.createDataFrame([(i, x.tolist(), int(t)) for i, (x, t) in enumerate(zip(v, labels, strict=True))], "vec_id long, embedding array<float>, label int").repartition(4)
    copies = []
    meeting = hard_negatives._meeting

    def counted(asking, rows, wanted, keys, path):
        pairs = rows.join(wanted, keys).filter("d >= least").count()
        copies.append((pairs, rows.count() * asking.select("grp").distinct().count()))
        return meeting(asking, rows, wanted, keys, path)

    monkeypatch.setattr(hard_negatives, "_meeting", counted)
    got = {tuple(r) for r in hard_negatives.mine(df, "vec_id % 10 = 0").collect()}
    x = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    assert got == plain_negatives(x, labels, range(0, 900, 10))
    (first, all_first), (second, all_second) = copies
    assert first < all_first / 3 and second < 0.8 * all_second


def test_bounds_keep_all_that_may_serve():
    rng = np.random.default_rng(9)
    for seed in range(20):
        x = rng.integers(-90, 90, (160, 5)) * (1 + 3 * (rng.random((160, 1)) < 0.2)).astype(np.int64)
        labels, ids = rng.integers(0, 3, 160), np.arange(160)
        rows = hard_negatives._Rows(ids, labels, x)
        top = int(rows.sizes.max())
        at = rng.permutation(160)
        space = hard_negatives._Space(rows.part(at[:40]), 7, top)
        anchors = rows.part(at[:: 16])
        far = hard_negatives._distances(rows.v, rows.sizes, space.pivots, top, False)
        cell, d = far.argmin(axis=1), far.min(axis=1)
        needs = dict(hard_negatives._first_bounds(space, anchors, 3))
        best = hard_negatives.positives_of(anchors, rows, 3)
        assert all(d[j] >= needs[int(anchors.labels[a])][cell[j]] for a, j, _ in best), seed
        scores = [np.array([s for b, _, s in best if b == a], np.int64) for a in range(len(anchors.ids))]
        for ranges in hard_negatives._second_bounds(space, anchors, scores, 2, (50, 95)):
            assert all(d[j] >= ranges[cell[j]] for _, _, j, _ in hard_negatives.negatives_of(anchors, scores, rows, 2, (50, 95))), seed


def test_kept_columns_may_have_any_name(spark, odd):
    df = spark.read.parquet(f"{odd}/embeddings.parquet").withColumn("error", F.lit(1)).withColumn("_v", F.lit("x")).withColumn("_k0", F.lit("y"))
    books = codebooks.train(df)
    out = codebooks.encode(df, books, ("_v", "_k0", "vec_id", "cell"))
    assert {(r["_v"], r["_k0"], r["cell"]) for r in out.collect()} == {("x", "y", "c")}
