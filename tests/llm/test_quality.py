"""The classifier of positives and unlabelled text: its risk, its prior, held-out rows of a small table, and odd tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphlake.llm import quality, queries


def prose(n, rng):
    words = ["".join(rng.choice(list("aeioulnrst"), rng.integers(2, 8))) for _ in range(n)]
    return " ".join(w.capitalize() + "," if k % 9 == 0 else w for k, w in enumerate(words)) + "."


def junk(n, rng, kind):
    text = prose(n, rng)
    return [text.upper() + "!!", " ".join(w + "###" for w in text.split()), " ".join([text.split()[0]] * n), " | ".join(text.split())][kind % 4]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, at = np.random.default_rng(3), str(tmp_path_factory.mktemp("quality"))
    bad = {i for i in range(900) if i % 5 == 2}
    rows = [(i, junk(int(rng.integers(20, 120)), rng, i) if i in bad else prose(int(rng.integers(20, 300)), rng), "en", "s", 0) for i in range(900)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    # labels of 0 are wrong where they may be learnt from: nothing may come of them
    spark.createDataFrame([(i, int(i not in bad), 0) for i in range(0, 900, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, bad


def test_held_out_rows(spark, folder):
    at, bad = folder
    got = queries.QUERIES["op13_quality"](spark, at).collect()
    assert len(got) == 900 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"]]
    assert 100 < len(held) < 260
    assert np.mean([r["predicted"] == int(r["doc_id"] not in bad) for r in held]) >= 0.97


def test_negative_labels_are_not_learnt(spark, folder):
    at, _ = folder
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    model = quality.train(docs, labels)
    for other in (labels.filter("quality = 1"), labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))):
        same = quality.train(docs, other)
        assert np.array_equal(same.weights, model.weights) and same.prior == model.prior
    assert 0.7 < model.prior < 0.9  # 0.8 in truth


def test_prior_of_mixtures():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        good = rng.normal(0, 1, (3_000, 6)).astype(np.float32) + 2
        every = np.concatenate([rng.normal(0, 1, (int(4_000 * share), 6)) + 2, rng.normal(0, 1, (4_000 - int(4_000 * share), 6)) - 2]).astype(np.float32)
        rng.shuffle(every)
        assert abs(quality.estimated_prior(good, every) - share) < 0.05


def test_risk_does_not_overfit():
    """With few rows of many features the plain unbiased risk falls far below 0, and its scores say nothing but 0 and 1."""
    rng = np.random.default_rng(6)
    n, width = 60, 200
    signal = np.zeros(width)
    signal[:10] = 1.0
    draw = lambda good: (rng.normal(0, 1, (len(good), width)) + np.where(good, 1, -1)[:, None] * signal).astype(np.float32)
    good, every = draw(np.ones(n, bool)), draw(rng.random(2 * n) < 0.5)
    truth = rng.random(2_000) < 0.5
    x = draw(truth)

    def cost(margins):
        return np.mean(np.logaddexp(0, np.where(truth, -margins, margins)))

    def bad_risk(w):
        loss = lambda rows: np.mean(np.logaddexp(0, rows @ w[:-1] + w[-1]))
        return loss(every) - 0.5 * loss(good)

    def unbiased(w):
        g, e = quality._through(good, w), quality._through(every, w)
        return 0.5 * quality._mean(good, g - 1) + quality._mean(every, e) - 0.5 * quality._mean(good, g)

    plain, model = quality._descend(unbiased, width, 300, 0.1), quality.non_negative(good, every, 0.5)
    assert bad_risk(plain) < -1 < -0.3 < bad_risk(np.append(model.weights, model.bias))
    assert cost(model.margins(x)) < cost(x @ plain[:-1] + plain[-1]) / 5
    assert np.mean((model.margins(x) > 0) == truth) > 0.75


def test_features_are_those_of_a_plain_count(monkeypatch):
    rng = np.random.default_rng(8)
    texts = ["", "a", "É! é?\n12", prose(50, rng), junk(40, rng, 1), "x " * 4_000]
    x = quality.features(pa.array([None, *texts]))
    assert x.shape == (7, quality.WIDTH) and np.array_equal(x[0], x[1]) and not x[0].any()
    kinds = quality._classes()
    for text, row in zip(texts, x[1:], strict=True):
        cells = np.zeros(quality.BUCKETS)
        for n in quality.RUNS:
            for i in range(len(text) - n + 1):
                h = 0
                for c in text[i : i + n]:
                    h = (h * 0x01000193 + int(kinds[min(ord(c), 0x10000)])) & 0xFFFFFFFF
                cells[(((h ^ n) * 0x85EBCA6B) & 0xFFFFFFFF) >> 22] += 1
        assert np.allclose(row[: quality.BUCKETS], np.sqrt(cells / max(cells.sum(), 1)), atol=1e-6)
        words = text.split()
        if words:
            assert abs(row[quality.BUCKETS] - sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)) < 1e-6
            assert abs(row[quality.BUCKETS + 1] - len({w.lower() for w in words}) / len(words)) < 1e-6
    monkeypatch.setattr(quality, "CHUNK", 64)  # long texts in pieces: only runs across their ends differ
    assert np.abs(quality.features(pa.array(texts)) - x[1:]).max() < 0.2


def test_odd_tables(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (4, "a b"), (5, "word " * 200_000), (None, "x y z"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("_text", "_id", "score", "x", "_good", "_k0", "predicted")})
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (4, 0), (None, 1), (5, None), (99, 1)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        model = quality.train(docs, known)
        got = quality.score(docs, model, ("doc_id", "x", "_k0")).collect()
        assert len(got) == 8 and all(0 <= r["score"] <= 1 and r["x"] == "clash" for r in got)
        by_text = {r["doc_id"]: r["score"] for r in got}
        assert by_text[1] == by_text[2] == by_text[7]
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0
