"""The pipeline's stages on a small folder of tables: each takes what its predecessor kept, and its decisions hold."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from graphlake.llm import common

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(n, seed):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**9, n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows, labels = [], []
    for i in range(120):
        toxic = i % 6 == 0
        lines = [words(40, i), "A line that many of the documents share, long enough to count" if i % 4 == 1 else words(12, 1000 + i)]
        rows.append((i, "\n".join(lines) + (" vilefilth" if toxic else ""), "en", "ab"[i % 2], 0))
        labels.append((i, 1, int(toxic)))
    rows += [(200, rows[1][1].split("\n")[0] + " more", "en", "a", 0), (201, None, None, None, None), (202, "", "en", "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "source_mixing", "best_fit_packing"] and entry.queries()["pipeline"] is corpus_pipeline.run
    docs = common.table(spark, folder, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, folder), f"{tmp_path}/{name}")
        kept.append([r.asDict() for r in docs.collect()])
        assert name == "best_fit_packing" or docs.columns == COLUMNS
    clean, lines, single, mixed, packed = kept
    ids = lambda rows: {r["doc_id"] for r in rows}
    assert ids(clean) == {i for i in range(120) if i % 6} | {200, 201, 202}
    assert ids(lines) == ids(clean)
    shared = [r["doc_id"] for r in lines if r["text"] and "many of the documents" in r["text"]]
    assert set(shared) == {117} and all(r["n_chars"] == len(r["text"]) for r in lines)
    assert ids(single) == ids(lines) - {200}
    assert ids(mixed) <= ids(single)
    sizes, taken = {r["doc_id"]: len(r["text"].split()) for r in single}, defaultdict(int)
    for r in mixed:
        taken[r["doc_id"]] += len(r["text"].split())
    assert all(n <= 2 * sizes[i] for i, n in taken.items()) and abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 3
    bins = defaultdict(int)
    for r in packed:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 1024 and len([r for r in packed if r["piece"] == 0]) == len(mixed)
    assert len(bins) <= sum(bins.values()) // 1024 + 2


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100
