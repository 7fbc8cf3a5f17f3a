"""The dealt methods at work: what they find beyond the plain part of each operator, against brute force."""

import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphlake.llm import common, html_text, ngram_join, passages, pii, spotsigs, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCS)


def words(n, seed):
    return [f"w{'abcdefghij'[x % 10]}{'klmnopqrst'[x // 10 % 10]}{x // 100}" for x in np.random.default_rng(seed).integers(0, 10**7, n).tolist()]


# ---- personal data


def spans_of(text, terms):
    return [(m.start(), m.end()) for m in re.finditer(r"\w+", text) if m[0].lower() in terms or ("#6" in terms and 32 < len(m[0]) <= 64 and re.search("[a-z]", m[0]) and re.search("[0-9]", m[0]))]


def test_disclosing_terms_against_plain(spark):
    """Terms about a class are found in all texts, also in those without personal data; rare chance meetings tell nothing."""
    texts = []
    for i in range(600):
        own = words(20, i)
        if i % 20 == 0:
            own[3] = f"+1 (555) 010-{1000 + i}"
            own[7:8] = ["Callback", "line"] if i % 40 else ["line"]
        if i == 7:
            own[5] = "callback"
        if i % 30 == 0:
            own[9] = f"{'ab' * 18}{i:04d}"
        texts.append((i, " ".join(own)))
    rows = {r["doc_id"]: r for r in pii.find(docs(spark, texts), min_texts=5).collect()}
    plain = {i: set(re.findall(r"\w+", t.lower())) for i, t in texts}
    shaped = {i: {f"#{math.ceil(math.log2(len(w)))}" if len(w) > 8 and re.search("[a-z]", w) and re.search("[0-9]", w) else w for w in own} for i, own in plain.items()}
    phone = {i for i, t in texts if "+1 (555)" in t}
    count = Counter(w for own in shaped.values() for w in own)
    both = Counter(w for i in phone for w in shaped[i] if not w.isdigit())
    n, z = len(texts), pii.CONFIDENCE
    want = set()
    for w, k in both.items():
        p, t = k / count[w], count[w]
        low = (p + z * z / (2 * t) - z * math.sqrt(p * (1 - p) / t + z * z / (4 * t * t))) / (1 + z * z / t)
        if k >= 5 and 1 + math.log2(low) / math.log2(n / len(phone)) >= pii.GENERALISE:
            want.add(w)
    assert {"line", "callback"} <= want
    for i, t in texts:
        got = sorted((s["start"], s["end"]) for s in rows[i]["extra"])
        base = [(s["start"], s["end"]) for s in rows[i]["base"]]
        assert got == [s for s in spans_of(t, want) if not any(a < s[1] and s[0] < b for a, b in base)], (i, t)
        assert len(base) == (i in phone)


def test_values_that_texts_share_are_one_entity(spark):
    """A list of addresses that is found again and again is counted once, and what tells of it goes."""
    listed = " ".join(f"p{i}@mail.example.org" for i in range(150))
    texts = [(i, f"{listed} project mercury {' '.join(words(9, i))}") for i in range(6)] + [(100 + i, " ".join(words(30, 100 + i))) for i in range(400)]
    found = pii.find(docs(spark, texts)).filter("size(base) > 0").collect()
    assert len(found) == 6 and all(len(r["base"]) == 150 for r in found)
    assert all({s["value"] for s in r["extra"]} == {"project", "mercury"} for r in found)


def test_many_spans_in_one_text(spark):
    text = " ".join(f"a{i}@b.cd" for i in range(20_000))
    began = time.time()
    row = pii.find(docs(spark, [(1, text), (2, None), (3, "")])).withColumn("clean", pii.sanitise(F.lit(text), F.col("base"), F.col("extra"))).filter("doc_id = 1").first()
    assert len(row["base"]) == 20_000 and row["base"][-1]["end"] == len(text) and time.time() - began < 60
    assert row["clean"] == " ".join(["[EMAIL]"] * 20_000)


def test_fold_joins_blocks(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(1_000)), lambda x: F.struct(x.alias("x"))).alias("a"), F.array().cast("array<struct<x:int>>").alias("none"))
    step = lambda s, x: F.struct((s + x["x"]).alias("state"), F.when(x["x"] % 2 == 0, F.array(s)).otherwise(F.array().cast("array<int>")).alias("out"))
    row = df.select(*(common.fold(F.col(c), F.lit(0), F.array().cast("array<int>"), step).alias(c) for c in ("a", "none"))).first()
    assert row["a"] == [x * (x - 1) // 2 for x in range(2, 1_001, 2)] and row["none"] == []


# ---- fingerprints


def test_signatures_against_plain(spark):
    anchors = set(spotsigs.ANCHORS)
    texts = ["", None, "The cat, and the dog of Rome.", "no anchors here", "the", "the cat", "  ...the big (red) fox is in THE house", " ".join(["the", *words(3, 1), "of", *words(2, 2)] * 30)]
    rows = spotsigs.fingerprint_edits(docs(spark, list(enumerate(texts)))).collect()
    sets = {}
    for i, t in enumerate(texts):
        own = [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
        content = [(k, w) for k, w in enumerate(own) if w not in anchors]
        chains = set()
        for k, w in enumerate(own):
            after = [c for at, c in content if at > k][: spotsigs.CHAIN]
            if w in anchors and len(after) == spotsigs.CHAIN:
                chains.add((w, *after))
        sets[i] = chains or ({tuple(own)} if own else set())
    by = {r["doc_id"]: r for r in rows}
    for i, chains in sets.items():
        assert len(by[i]["signature"]) == len(chains), (i, texts[i])
        for j, other in sets.items():
            both = len(set(by[i]["signature"]) & set(by[j]["signature"]))
            assert both == len(chains & other)


# ---- pages


def page(*parts):
    return "<body>" + "".join(parts) + "</body>"


def test_suffix_array_against_plain():
    rng = np.random.default_rng(3)
    for _ in range(60):
        streams = [rng.integers(0, 3, rng.integers(0, 25)).astype(np.int64) for _ in range(rng.integers(1, 6))]
        order, common_, of, at = html_text.suffix_array(streams)
        suffixes = [tuple(streams[s][p:]) for s, p in zip(of, at, strict=True)]
        assert suffixes == sorted(tuple(x[p:]) for x in streams for p in range(len(x)))
        for a, b, n in zip(suffixes, suffixes[1:], common_[1:], strict=False):
            k = 0
            while k < min(len(a), len(b)) and a[k] == b[k]:
                k += 1
            assert n == k


def test_articles_stay_whole(spark):
    """What a host's pages have outside of their articles stays where a marked article has it too."""
    menu = "Home News Sport Weather Travel Culture Music Film Theatre"
    rows = [(i, f"http://h.org/{i}", page(f"<nav>{menu}</nav><article><div>{menu}</div><p>{' '.join(words(15, i))}</p></article>")) for i in range(12)]
    rows += [(91, "http://h.org/91", page(f"<p>{menu}</p><p>x y</p>")), (92, None, None), (93, "http://h.org/93", ""), (92, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("c")).withColumn("_html", F.lit("c"))
    for shard in (256, 5):
        got = {r["page_id"]: r for r in html_text.extract(df, keep=("page_id", "key", "_html"), shard_pages=shard).collect()}
        assert all(got[i]["text"] == f"{menu}\n{' '.join(words(15, i))}" for i in range(12))
        assert got[91]["text"] == "x y" and got[92]["text"] == got[93]["text"] == ""
        assert got[5]["key"] == got[5]["_html"] == "c"


def test_pages_against_plain(spark):
    """Pages with and without marked articles, against counting all stretches of a host by hand."""
    rng = np.random.default_rng(8)
    pool = [" ".join(words(10, 500 + k)) for k in range(6)]
    rows = []
    for i in range(60):
        parts = [str(x) for x in rng.choice(pool, 3)] + [" ".join(words(12, i))]
        rng.shuffle(parts)
        body = "".join(f"<div>{x}</div>" for x in parts)
        rows.append((i, f"http://h{i % 3}.org/{i}", page(f"<article>{body}</article><footer>{rng.choice(pool)}</footer>" if i % 2 else body)))
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), shard_pages=7).collect()}
    run, least = html_text.RUN, html_text.MIN_PAGES
    seen = defaultdict(set)
    for i, url, html in rows:
        tokens, _ = html_text.stream(html_text.blocks(html))
        for k in range(len(tokens) - run + 1):
            seen[url[:10], tuple(tokens[k : k + run])].add(i)
    for i, url, html in rows:
        found = html_text.blocks(html)
        if i % 2:
            assert got[i] == "\n".join(text for role, text in found if role == "main"), i
            continue
        listed = html_text.stream(found)[0]
        covered = np.zeros(len(listed), bool)
        for k in range(len(listed) - run + 1):
            if len(seen[url[:10], tuple(listed[k : k + run])]) >= least:
                covered[k : k + run] = True
        want, at = [], 0
        for _, text in found:
            own = text.split(" ")
            left = [w for w, c in zip(own, covered[at : at + len(own)], strict=True) if not c]
            at += len(own)
            want += [" ".join(left)] if left else []
        assert got[i] == "\n".join(want), i


# ---- search


def test_max_score_keeps_all_that_may_win():
    rng = np.random.default_rng(0)
    pruned = 0
    for trial in range(200):
        d, n, k = int(rng.integers(1, 20)), int(rng.integers(1, 400)), int(rng.integers(1, 8))
        terms, query = rng.integers(-9, 9, (d, n)).astype(float), rng.integers(-5, 6, d).astype(float)
        if trial % 7 == 0:
            terms[:] = 3
        rows, scores = topk.max_score(query, terms, terms.min(1), terms.max(1), k, traversed=37)
        full = query @ terms
        assert (full[rows] == scores).all() and set(np.flatnonzero(full >= np.sort(full)[-min(k, n)])) <= set(rows)
        pruned += n - len(rows)
    assert pruned > 10_000


def test_queries_that_repeat_an_id_ask_once(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    rows = topk.top_k(df, df.filter("vec_id = 0"), k=2).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows] == [(0, 1, 2, 65_536), (0, 2, 2, 65_536)]


# ---- near duplicates


def test_one_row_of_each_component(spark):
    a, b = " ".join(words(40, 1)), " ".join(words(40, 2))
    rows = [(1, a), (1, a), (1, b), (2, a + " x"), (3, b), (4, None), (4, None), (5, ""), (None, a), (None, " ".join(words(9, 3))), (None, " ".join(words(9, 3)))]
    got = Counter((r["doc_id"], r["text"]) for r in ngram_join.one_of_each(docs(spark, rows), ["doc_id", "text"]).collect())
    assert got == Counter({(1, a): 1, (1, b): 1, (4, None): 2, (5, ""): 1, (None, " ".join(words(9, 3))): 1})
    assert ngram_join.one_of_each(docs(spark, []), ["doc_id", "text"]).count() == 0


def test_pivots_close_a_large_group(spark):
    """Copies that link with their original but seldom with each other, found through few pivots."""
    rng = np.random.default_rng(4)
    origin = words(120, 77)
    texts = [(0, " ".join(origin))]
    for i in range(1, 90):
        own = list(origin)
        for k in rng.choice(120, 2, replace=False):
            own[k] = f"edit{i}x{k}"
        texts.append((i, " ".join(own)))
    far = list(origin)
    for k in range(0, 120, 9):
        far[k] = f"far{k}"
    texts.append((500, " ".join(far)))
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.cluster(docs(spark, texts), common_sets=4).collect()}
    assert {found[i] for i in range(90)} == {0} and found[500] == 500


def fifty(text):
    own = text.split()
    return {k: tuple(own[k : k + 50]) for k in range(len(own) - 49)}


def groups(found, ids):
    by = defaultdict(set)
    for i in ids:
        by[found[i]["class_id"]].add(i)
    return by.values()


def classes_of(texts):
    """Classes of texts by aligning all pairs."""
    names = {}
    shingles = {}
    for i, t in texts.items():
        own = t.split()
        shingles[i] = np.array([names.setdefault(tuple(own[k : k + 5]), len(names) + 1) for k in range(len(own) - 4)], np.uint32)
    parent = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and passages.align(shingles[i], shingles[j]):
                a, b = parent[i], parent[j]
                parent = {k: a if v == b else v for k, v in parent.items()}
    by = defaultdict(set)
    for i, p in parent.items():
        by[p].add(i)
    return {frozenset(g) for g in by.values()}


def test_only_rarest_features_leave_a_task(spark, monkeypatch):
    """Of 300 near copies, whose signatures are all common, each gives its rarest features only; they are one component."""
    rng, base, texts, made = np.random.default_rng(3), words(100, 5_656), [], []
    for i in range(300):
        own = list(base)
        own[int(rng.integers(0, 100))] = f"near{i}"
        texts.append((i, " ".join(own)))

    def written(df, path, plain=common.written):
        if path.endswith("/rare"):
            made.append((df.count(), "MapInArrow" in df._jdf.queryExecution().analyzed().getClass().getSimpleName()))
        return plain(df, path)

    monkeypatch.setattr(common, "written", written)
    assert {r["component_id"] for r in ngram_join.cluster(docs(spark, texts)).collect()} == {0}
    assert made[0][1] and 0 < made[0][0] <= 300 * 21  # of about 96 features, with none left to drop after the task


def test_passages_of_many_surroundings(spark, monkeypatch):
    """Near passages around minima with more than UNLIKE surroundings are those that all pairs of a group give."""
    rng = np.random.default_rng(5)
    family, phrase, texts = words(75, 1_212), words(24, 3_434), []
    for i in range(260):
        own = words(40, 200_000 + i)
        middle = list(family)
        for k in rng.choice(75, 4, replace=False):
            middle[k] = f"near{i}x{k}"
        own[20:20] = middle if i < 160 else phrase
        texts.append((i, " ".join(own)))
    table = docs(spark, texts)
    listed = lambda: sorted((r["doc_id"], r["class_id"], tuple(r["repeated"]), tuple(r["dropped"])) for r in passages.find(table).collect())
    found = listed()
    monkeypatch.setattr(passages, "UNLIKE", 10**9)
    assert found == listed()
    assert {c for i, c, *_ in found if i >= 160} == set(range(160, 260))  # the phrase is no passage


@pytest.mark.parametrize("seed", [1])
def test_passages_recall(spark, seed):
    """Exact repeats of 50 words are found wholly in 1,000 texts with stock phrases and a family of near copies; near passages to 0.9 at least."""
    rng = np.random.default_rng(seed)
    phrases = [words(int(rng.integers(5, 9)), 9_000 + k) for k in range(15)]
    stock = [words(int(rng.integers(50, 90)), 7_000 + k) for k in range(40)]
    texts, near = [], []
    family = words(150, 4_242)
    for i in range(1_000):
        own = words(int(rng.integers(20, 160)), 100_000 + i)
        for _ in range(3):
            at = int(rng.integers(0, len(own)))
            own[at:at] = phrases[int(rng.integers(0, 15))]
        if i % 4 == 0:
            at, passage = int(rng.integers(0, len(own))), list(stock[int(rng.integers(0, 40))])
            if i % 12 == 0:  # a near one: a word in the middle is another
                passage[len(passage) // 2] = f"other{i}"
                near.append((i, at, len(passage)))
            own[at:at] = passage
        if i < 25:
            own = list(family)
            for k in rng.choice(150, 4, replace=False):
                own[k] = f"near{i}x{k}"
        texts.append((i, " ".join(own)))
    found = {r["doc_id"]: r for r in passages.find(docs(spark, texts)).collect()}
    held = defaultdict(set)
    for i, t in texts:
        for k, run in fifty(t).items():
            held[run].add(i)
    linked = {}
    for i, t in texts:
        spans = [(s["start"], s["end"]) for s in found[i]["repeated"]]
        for k, run in fifty(t).items():
            if len(held[run]) > 1:
                assert any(a <= k and k + 50 <= b for a, b in spans), (i, k)
                linked.setdefault(run, set()).add(found[i]["class_id"])
    assert all(len(c) == 1 for c in linked.values())
    assert classes_of({i: t for i, t in texts[:25]}) == {frozenset(g) for g in groups(found, range(25))}
    near = [(i, at, n) for i, at, n in near if i >= 25 and n >= 60]
    caught = sum(any(a <= at + 2 and at + n - 2 <= b for a, b in ((s["start"], s["end"]) for s in found[i]["repeated"])) for i, at, n in near)
    assert caught >= 0.9 * len(near) > 20


# ---- column names and stages


def test_kept_columns_may_have_any_name(spark):
    df = docs(spark, [(1, "a b c"), (2, None), (3, "x@y.zz and more")])
    for name in ("size", "_text", "_key", "base", "score", "_keep", "piece", "kept", "_h", "text_id"):
        own = df.withColumn(name, F.col("doc_id") * 10)
        runs = {"pii": lambda d, n=name: pii.find(d, keep=(n,)), "toxicity": lambda d, n=name: toxicity.score(d, toxicity.fit([], np.zeros(0)), keep=("doc_id", n))}
        if name not in ("base", "score"):
            for kind, run in runs.items():
                assert {r["doc_id"]: r[name] for r in run(own).collect()} == {1: 10, 2: 20, 3: 30}, (kind, name)


def test_stages_take_odd_tables(spark, tmp_path):
    import corpus_pipeline

    t = " ".join(words(60, 1))
    rows = [(1, t, "en", "s", 3), (1, t, "en", "s", 3), (2, None, None, None, None), (2, None, None, None, None), (3, "", "en", None, 0), (None, t, "en", "s", 3), (4, " ".join(words(5_000, 2)), "en", "s", 3)]
    df = spark.createDataFrame(rows, DOCS).withColumn("extra", F.lit(1))
    at = str(tmp_path)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    sizes = {"toxicity": 7, "line_dedup": 7, "ngram_join": 5, "source_mixing": None, "best_fit_packing": None}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, at)
        n = out.count()
        assert sizes[name] is None or n == sizes[name], name
        assert name == "best_fit_packing" or out.columns == corpus_pipeline.COLUMNS
        assert stage(spark, df.limit(0), at).count() == 0, name


def test_lines_of_repeated_ids_as_in_sql(spark, tmp_path):
    """Rows that repeat a doc_id, or have none, count as documents of their own, in SQL as in the operator."""
    import duckdb

    from graphlake.llm import queries

    line = "a line that is long enough to be a key of its own here"
    rows = [(1, line), (1, line), (2, f"{line}\nother"), (2, f"x\n{line.upper()}"), (None, line), (None, f"{line}\n{line}"), (3, "other"), (4, None)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.ORACLE_SQL["op7_line_dedup"])
    got = queries.op7_line_dedup(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall())) and sum(r["n_dropped"] for r in got) == 5


def test_passages_of_frequent_stretches(spark, monkeypatch):
    """Stretches that are dealt as frequent ones give the rows that they give otherwise."""
    rng = np.random.default_rng(23)
    phrase = [f"p{x}" for x in range(70)]
    own = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    table = docs(spark, [(i, " ".join(own(20) + (phrase if i % 3 else own(60)) + own(20))) for i in range(400)])
    listed = lambda: sorted((r["doc_id"], r["class_id"], tuple(r["repeated"]), tuple(r["dropped"])) for r in passages.find(table).collect())
    plain = listed()
    assert sum(bool(r[2]) for r in plain) == 266
    many = lambda rows, key: [r[0] for r in rows.groupBy(key).count().filter("count > 100").collect()]
    asked = []
    monkeypatch.setattr(passages, "_frequent", lambda rows, key: asked.append((key, many(rows, key))) or asked[-1][1])
    assert listed() == plain and "run" in [key for key, often in asked if often]


def test_frequent_keys_are_found(spark):
    rows = spark.range(200_000).selectExpr("id AS text_id", "if(id % 3 = 0, 5, id) AS run")
    assert passages._frequent(rows, "run") == [5] and passages._frequent(rows.filter("run <> 5"), "run") == []


def test_passages_of_families_meet_in_blocks(spark):
    """Blocks give the pairs that the groups give, each once, though each pair shares many minima."""
    rng = np.random.default_rng(21)
    rows = []
    for text in range(60):
        component = int(rng.integers(0, 12))
        for key in rng.permutation(8)[:6].tolist():
            near = np.unique(rng.integers(0, 3, 8) * 64 + np.arange(8)).tolist()
            rows.append((key, 60, text, component, bool(rng.random() < 0.6), bool(rng.random() < 0.4), near, 0, 0))
    rows += [(100 + text % 2, 3, text, text, True, True, list(range(8)), 0, 0) for text in range(200, 206)]
    df = spark.createDataFrame(rows, passages._OPEN)
    expected = sorted((r["a"], r["b"]) for r in passages._met_pairs(df).collect())
    assert len(expected) > 100
    for block in (7, 1_024):
        assert sorted({(r["a"], r["b"]) for r in passages._block_pairs(df, block).collect()}) == expected
    assert len(passages._block_pairs(df).filter("a >= 200").collect()) == sum(a >= 200 for a, _ in expected) == 6


def _near_shingles(rng, n, shared, repeat):
    """Texts as shingles (0: hidden) with pieces of `shared` in them, changed, cut and moved."""
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.integers(1, 4)):
            a, b = np.sort(rng.integers(0, len(shared) + 1, 2))
            part = shared[a:b].copy()
            hit = rng.random(len(part)) < rng.choice([0, 0.02, 0.1, 0.25])
            part[hit] = rng.integers(0, 2, hit.sum()) * rng.integers(10**6, 10**9, hit.sum())
            parts += [part, rng.integers(10**6, 10**9, rng.integers(0, 20)).astype(np.uint32)]
        text = np.concatenate(parts)
        if not repeat:
            seen = np.unique(text, return_index=True)[1]
            text[np.setdiff1d(np.arange(len(text)), seen)] = 0
        out.append(text)
    return out


def test_passages_of_blocks_are_those_of_pairs():
    """Aligned at once, texts have what pairs have; summed up, they keep the spans, what smaller texts have, and the links."""
    rng = np.random.default_rng(3)
    shared = rng.integers(1, 10**6, 220).astype(np.uint32)
    xs, ys = ([t for repeat in (False, True) for t in _near_shingles(rng, 25, shared, repeat)] + [np.zeros(0, np.uint32), np.zeros(60, np.uint32)] for _ in range(2))
    wanted = rng.random((len(xs), len(ys))) < 0.7
    expected = sorted((p, q, *f) for p, q in zip(*(x.tolist() for x in np.nonzero(wanted)), strict=True) for f in passages.align(xs[p], ys[q]))
    got = passages.align_all(xs, ys, wanted)
    assert sorted(map(tuple, got.T.tolist())) == expected and len(expected) > 200 and len({p for p, *_ in expected if p < 25}) > 10

    p, q, *spans = got
    a, b = np.minimum(p, 1000 + q), np.maximum(p, 1000 + q)
    pairs = [(int(t), int(o), int(s), int(s + n)) for x, y, u, v, w, z in zip(a, b, *spans, strict=True) for t, o, s, n in ((x, y, u, v), (y, x, w, z))]

    def told(rows):
        every, gone, to = defaultdict(set), defaultdict(set), {t: t for t, *_ in rows}
        for t, o, s, e in rows:
            every[t] |= set(range(2 * s, 2 * e + 1))
            gone[t] |= set(range(2 * s, 2 * e + 1)) if o < t else set()
        for _ in to:
            for t, o, *_ in rows:
                to[t] = to[o] = min(to[t], to[o])
        return every, gone, to

    summed = list(zip(*(c.tolist() for c in passages._summed_up(a, b, np.stack(spans))), strict=True))
    assert told(summed) == told(pairs) and 4 * len(summed) < len(pairs)


def test_passages_of_families_are_rows_of_texts(spark):
    """Blocks of a family say what all its pairs say, in rows that grow with its texts."""
    rng = np.random.default_rng(8)
    base = rng.integers(1, 2**32, 130).astype(np.uint32)
    whole, rows = [], []
    for text in range(150):
        mine = base.copy()
        for k in (36 + text % 14, 81 + text % 14):  # no unbroken passage, and unlike where the changes lie apart
            mine[k : k + 5] = rng.integers(1, 2**32, 5)
        whole.append((text, bytearray(mine.tobytes())))
        rows.append((7, 150, text, text, True, True, list(range(8)), 0, 0))
    whole, df = spark.createDataFrame(whole, "text_id long, shingles binary"), spark.createDataFrame(rows, passages._OPEN)
    pairs = passages._sides(passages._block_pairs(df), whole, 50, 0.8)
    told = lambda sides: [sorted(map(repr, x.collect())) for x in (passages._spans_of(sides), passages.components(passages._links(sides)))]
    assert pairs.count() > 40 * 150
    for block, most in ((64, 6 * 150), (1_024, 2 * 150)):
        sides = passages._block_sides(df, whole, 50, 0.8, block)
        assert told(sides) == told(pairs) and 150 <= sides.count() <= most


def test_a_task_holds_few_minima(monkeypatch):
    """A task makes filters of its minima as it goes; what it has in two of them was seen twice."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 120)) for _ in range(40)]
    texts += [f"{t} {i}" for i, t in enumerate(texts[::4])]
    batches = [pa.record_batch({"doc_id": pa.array([i], pa.int64()), "text": [t]}) for i, t in enumerate(texts)]
    parts, most, bits = passages.bloom.parts, [], 1 << 20
    monkeypatch.setattr(passages.bloom, "parts", lambda seen, bits: most.append(sum(map(len, seen))) or parts(seen, bits))

    def let_through() -> np.ndarray:
        most.clear()
        rows = [r for out in passages._first_pass(bits, 8, 50)(iter(batches)) for r in out.to_pylist()]
        assert [r["doc_id"] for r in rows if r["segment"] is None] == list(range(50))
        held = pa.RecordBatch.from_pylist([{n: r[n] for n in ("segment", "once", "twice")} for r in rows if r["segment"] is not None])
        (out,) = passages.bloom._merge([held])
        return np.frombuffer(zlib.decompress(out.column("twice")[0].as_py()), np.uint8)

    whole = let_through()
    assert len(most) == 1 and most[0] > 800
    monkeypatch.setattr(passages.bloom, "HELD", 200)
    divided = let_through()
    assert len(most) > 3 and max(most) < 300 and (divided & whole == whole).all() and np.unpackbits(divided & ~whole).sum() < 100


def test_blocks_are_small_where_much_is_near(spark, monkeypatch):
    """Texts with much around their minima fill a block sooner; pairs stay the same."""
    rows = [(7, 40, text, text, True, True, list(range(64 * 40)), 0, 0) for text in range(40)]
    df = spark.createDataFrame(rows, passages._OPEN).repartition(2)
    one = passages._in_blocks(df, 1_024).count()
    pairs = sorted(map(tuple, passages._block_pairs(df).collect()))
    monkeypatch.setattr(passages, "NEAR_BYTES", 40 * 64 * 40)
    assert one == 1 and passages._in_blocks(df, 1_024).count() > 3 and sorted(map(tuple, passages._block_pairs(df).collect())) == pairs
