"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against plain versions."""

import hashlib
import math
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlake.llm import bloom, common, components, html_text, line_dedup, mixing, ngram_join, packing, passages, pii, spotsigs, textops, topk, toxicity
from graphlake.llm.queries import tokenizer_paths

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, "s"), len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def words(n, seed):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 10**9, n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, repeated and long texts; a null id; columns named like those the operators make."""
    long = " ".join(words(30_000, 5))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (4, "a b"), (5, long), (None, "x y z"), (6, long + " end"), (7, None)]
    df = docs(spark, rows)
    return df.withColumns({c: F.lit("clash") for c in ("size", "_text", "_key", "n", "score", "base", "key", "sig", "start", "_h", "component_id", "kept")})


def test_all_take_odd_tables(spark, odd):
    empty = odd.limit(0)
    vectors = spark.createDataFrame([(0, [1.0, 0.5], "c"), (50, [1.0, None], "c"), (100, None, "c"), (150, [float("nan"), 1.0], "c"), (1, [0.5, 0.5], "c"), (1, [0.5, 0.5], "c"), (None, [1.0, 1.0], "c"), (2, [], "c")], "vec_id long, embedding array<float>, score string")
    pages = spark.createDataFrame([(1, "http://a.b/c", None, "c"), (2, None, "", "c"), (None, "http://a.b/", "<p>x", "c"), (2, None, "", "c")], "page_id long, url string, html string, text string")
    constant = toxicity.fit([], np.zeros(0))
    runs = {
        "pii": lambda d: pii.find(d), "toxicity": lambda d: toxicity.score(d, constant), "spotsigs": lambda d: spotsigs.fingerprint_edits(d), "ngram": lambda d: ngram_join.cluster(d), "mixing": lambda d: mixing.mix(d),
        "lines": lambda d: line_dedup.dedup_lines(d), "packing": lambda d: packing.pack(packing.tokenize(d, *tokenizer_paths()), 9), "passages": lambda d: passages.find(d),
    }
    for name, run in runs.items():
        rows = run(odd).collect()
        assert len({r["doc_id"] for r in rows}) == 8 and (name == "packing" or len(rows) == 9), name
        assert run(empty).count() == 0, name
    assert html_text.extract(pages).count() == 4 and html_text.extract(pages.limit(0)).count() == 0
    found = topk.top_k(vectors, vectors.filter("vec_id % 50 = 0")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == [(0, 1, 1, 256 * 128 + 128 * 128), (0, 2, 1, 256 * 128 + 128 * 128)]
    assert topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


# ---- packing


def test_tree_finds_tightest_bin():
    rng = np.random.default_rng(1)
    tree, held = packing.FreeSpace(64), []
    for k in range(600):
        if held and rng.random() < 0.5:
            least = int(rng.integers(0, 65))
            fits = [c for c, _ in held if c >= least]
            got = tree.take(least)
            assert (got is None) == (not fits) and (got is None or got[0] == min(fits))
            if got:
                held.remove(got)
        else:
            c = int(rng.integers(0, 65))
            tree.add(c, k), held.append((c, k))


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer

    texts = [(i, " ".join(words(n, i))) for i, n in enumerate([0, 1, 5, 900, 400, 37, 1024, 300, 20])] + [(50, "<|endoftext|> x"), (51, "日本   é"), (52, None)]
    pieces = packing.tokenize(docs(spark, texts), *tokenizer_paths(), with_ids=True)
    rows = packing.pack(pieces, len(texts)).collect()
    whole = Tokenizer.from_file(tokenizer_paths()[0])
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r), by_bin[r["sequence_id"]].append(r)
    for i, t in texts:
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [x for r in own for x in r["ids"]] == [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        assert [r["length"] for r in own[1:]] == [1024] * (len(own) - 1) and [r["start"] for r in own] == list(np.cumsum([0, *(r["length"] for r in own)])[:-1])
    for b in by_bin.values():
        at = 0
        for r in sorted(b, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert len(by_bin) <= math.ceil(sum(r["length"] for r in rows) / 1024) + 1


# ---- mixing


def test_mix_meets_targets(spark):
    sources = {i: [None, "a", "b", "c"][i % 4] if i % 10 else "b" for i in range(200)}
    df = docs(spark, [(i, " ".join(words(i % 23, i))) for i in range(200)], sources)
    rows = mixing.mix(df).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert r["size"] == r["doc_id"] % 23 and 0 <= r["taken"] <= 2 * r["size"]
    total = sum(r["size"] for r in rows)
    want = dict.fromkeys(by, 0.0)
    names = sorted([s for s in by if s is not None]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    size = {s: sum(r["size"] for r in by[s]) for s in by}
    capped: set = set()
    while True:
        rest = 1.5 * total - sum(2 * size[s] for s in capped)
        for s in by:
            want[s] = 2 * size[s] if s in capped else rest * weight[s] / sum(weight[x] for x in by if x not in capped)
        over = {s for s in by if want[s] > 2 * size[s] + 1e-9}
        if not over:
            break
        capped |= over
    for s in by:
        assert abs(by[s][0]["target"] - want[s]) < 1e-6 and abs(sum(r["taken"] for r in by[s]) - want[s]) <= 1
    assert sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    copies = mixing.repeat(mixing.mix(df, keep=("text",)), ["doc_id", "text", "n_chars"]).collect()
    got = Counter()
    for r in copies:
        got[r["doc_id"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert got == Counter({r["doc_id"]: r["taken"] for r in rows if r["taken"]})


# ---- lines


def test_lines_against_plain(spark):
    rng = np.random.default_rng(3)
    pool = ["short"] + [("Line %d " % i) * 8 for i in range(12)] + ["é" * 39, "é" * 40]
    texts = [(i, "\n".join(str(x) if rng.random() < 0.5 else f"  {str(x).upper()}\t" for x in rng.choice(pool, rng.integers(0, 9)))) for i in range(40)] + [(100, None), (101, "")]
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for i, t in texts:
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and len(held[key(x)]) >= 5 and i != max(held[key(x)]))]
        assert (rows[i]["n_lines"], rows[i]["n_dropped"], rows[i]["kept"]) == (len(lines), len(lines) - len(kept), "\n".join(kept))


def test_lines_of_hot_keys_and_any_names(spark):
    """A line that two thirds of all rows have, which is broadcast, and many that few have; ids that are null or repeated; names used inside."""
    rng = np.random.default_rng(29)
    pool = [f"line number {i} of those that some documents share" for i in range(60)]
    hot = "a line that very many of the documents have, in all sources"
    texts = [(None if i % 5 == 0 else i // 2, "\n".join([rng.choice(pool), *([hot] if i % 3 else [])])) for i in range(400)]
    names = ("_row", "_id", "_own", "_text", "_drop", "key", "text_id", "a.b c")
    table = docs(spark, texts).withColumns({c: F.col("n_chars") for c in names if "." not in c}).withColumn("a.b c", F.col("text"))
    held = defaultdict(list)
    for i, t in texts:
        for x in set(t.split("\n")):
            held[x].append(-1 if i is None else i)
    want = Counter()
    for i, t in texts:
        lines = t.split("\n")
        kept = [x for x in lines if len(held[x]) < 5 or max(held[x]) == (-1 if i is None else i)]
        want[(i, *[len(t)] * (len(names) - 1), t, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    got = line_dedup.dedup_lines(table, keep=names)
    assert got.columns == ["doc_id", *names, "n_lines", "n_dropped", "kept"]
    assert Counter(map(tuple, got.collect())) == want and {r[-2] for r in want} == {0, 1, 2}


def test_filter_lets_repeats_through():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 62, 5_000, dtype=np.uint64)
    both = np.concatenate([h, h[:500]])
    import pyarrow as pa

    def parts(x):
        batch = pa.RecordBatch.from_pydict({"x": pa.array([0])})
        return list(bloom._parts(lambda _: iter([x]), 1 << 20)([batch]))

    merged = list(bloom._merge(sorted(parts(both[:2_600]) + parts(both[2_600:]), key=lambda b: b.column(0)[0].as_py())))
    import zlib

    bitmap = b"".join(zlib.decompress(b.column("twice")[0].as_py()) for b in merged)
    ok = bloom.suspected(h, bitmap)
    assert ok[:500].all() and ok[500:].mean() < 0.05


# ---- shingles and joins


def plain_sets(texts):
    out = {}
    for i, t in texts:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def near_texts(seed, groups=25, base=40):
    rng = np.random.default_rng(seed)
    texts, at = [], 0
    shared = words(25, 999)
    for g in range(groups):
        own = words(int(rng.integers(3, base)), 1000 * seed + g) + (shared if g % 3 == 0 else [])
        for _ in range(int(rng.integers(1, 6))):
            copy = list(own)
            for _ in range(int(rng.integers(0, 3))):
                copy[int(rng.integers(0, len(copy)))] = f"edit{rng.integers(0, 10**9)}"
            if rng.random() < 0.3:
                copy = copy[: max(1, len(copy) - int(rng.integers(0, 4)))]
            texts.append((at, " ".join(copy).upper() if rng.random() < 0.2 else "\t".join(copy)))
            at += 1
    return texts


@pytest.mark.parametrize("common_sets", [24, 2])
def test_join_against_plain(spark, common_sets):
    texts = near_texts(1) + [(900, None), (901, ""), (902, "one"), (903, "One"), (904, "one two")]
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.cluster(docs(spark, texts), common_sets=common_sets).collect()}
    sets, parent = plain_sets(texts), {i: i for i, _ in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert rows == {i: (len(sets[i]), root(i)) for i in sets}
    assert len({c for _, c in rows.values()}) < len(rows)


def test_signatures_lose_no_pair():
    """Any two sets that link share a signature, and each as many of a band as its slack."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        base = rng.integers(0, 1 << 63, n + 40, dtype=np.uint64)
        cut = int(rng.integers(0, max(1, n // 8) + 1))
        x, y = np.unique(base[:n]), np.unique(np.concatenate([base[cut:n], base[n : n + int(rng.integers(0, max(1, n // 8) + 1))]]))
        both = len(np.intersect1d(x, y))
        if not len(y) or 100 * both < 80 * (len(x) + len(y) - both):
            continue
        sig, row, slack = ngram_join.signatures(np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)]), np.array([len(x), len(y)]))
        same = set(sig[row == 0].tolist()) & set(sig[row == 1].tolist())
        assert same
        for band in {s & 63 for s in same}:
            for r in (0, 1):
                assert sum(s & 63 == band for s in same) >= slack[(row == r) & ((sig & np.uint64(63)) == np.uint64(band))].max()


def test_components_of_few_links(spark):
    """Few links are contracted in a few jobs, whatever their paths; rounds before that give the same."""
    rng = np.random.default_rng(8)
    ids = rng.permutation(10**6)[:600].tolist()
    pairs = [*zip(ids[:300], ids[1:300]), *((ids[300 + 2 * k], ids[301 + 2 * k]) for k in range(100)), (ids[500], ids[500]), (ids[501], None)]  # noqa: B905
    links = spark.createDataFrame(pairs, "a long, b long")
    expected = dict.fromkeys(ids[:300], min(ids[:300])) | {x: min(ids[300 + k // 2 * 2], ids[301 + k // 2 * 2]) for k, x in enumerate(ids[300:500])}
    sc, group = spark.sparkContext, "few links"
    sc.setJobGroup(group, group)
    few = components.components(links)
    jobs = len(sc.statusTracker().getJobIdsForGroup(group))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 10
    for found in (few, components.components(links, few=0), components.components(links, few=50)):
        assert {r["node"]: r["component"] for r in found.collect()} == expected
    assert components.components(links.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(8)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (35, 2))] + [(i, i + 1) for i in range(100, 140)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}
    for a, b in links:
        if a != b:
            parent.setdefault(a, a), parent.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if a != b and parent[a] != parent[b]:
                parent[a] = parent[b] = min(parent[a], parent[b])
                changed = True
    assert found == parent


def test_components_of_long_chains(spark):
    ids = np.random.default_rng(9).permutation(5_000)[:3_000].tolist()  # in no order along the chains
    links = [(ids[k], ids[k + 1]) for k in range(2_999) if k != 1_000]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: min(part) for part in (ids[:1_001], ids[1_001:]) for x in part}


def test_word_hashes_match_words():
    import pyarrow as pa

    texts = ["A b\tc", None, "", "a  B\x0bc d", "é É", "x" * 3_000_000 + " y"]
    seen, counts = {}, []
    for _, h, _, count in textops.word_hashes(pa.array(texts)):
        counts += count.tolist()
        at = len(seen)
        seen[at] = h.tolist()
    flat = [x for v in seen.values() for x in v]
    plain = [w.translate({c: c + 32 for c in range(65, 91)}) for t in texts for w in WORD.findall(t or "")]
    assert counts == [len(WORD.findall(t or "")) for t in texts] and len(set(zip(flat, plain, strict=True))) == len(set(plain)) == len(set(flat))


# ---- passages


def test_windows_and_alignment():
    rng = np.random.default_rng(1)
    v, row = rng.integers(0, 1 << 63, 400, dtype=np.uint64), np.sort(rng.integers(0, 5, 400))
    u, want = v >> np.uint64(32), set()
    for k in range(400):  # nodes of the Cartesian tree, wide enough, and where stretches of 20 in them begin
        a = b = k
        while a > 0 and row[a - 1] == row[k] and u[a - 1] > u[k]:
            a -= 1
        while b < 399 and row[b + 1] == row[k] and u[b + 1] >= u[k]:
            b += 1
        if b - a + 1 >= 20:
            want.add((k, max(a, k - 19), min(k, b - 19)))
    assert set(zip(*(x.tolist() for x in passages.window_intervals(v, row, 5, 20)), strict=True)) == want
    x = rng.integers(1, 1 << 30, 200).astype(np.uint32)
    y = np.concatenate([rng.integers(1, 1 << 30, 30).astype(np.uint32), x[50:120], rng.integers(1, 1 << 30, 9).astype(np.uint32)])
    assert passages.align(x, y) == [(50, 74, 30, 74)] and passages.align(x[:60], y) == []


def test_alignment_of_repeated_phrases():
    rng = np.random.default_rng(4)
    new = lambda n: rng.integers(1, 1 << 30, n).astype(np.uint32)
    p, inside = new(56), []
    for phrases in ([p[26:32]], [p[:6]], [p[50:]], [p[:6], p[26:32], p[50:]], [p[:30], p[20:]]):
        before = np.concatenate([np.concatenate([new(9), q]) for q in phrases])
        x, y = np.concatenate([new(20), p, new(20)]), np.concatenate([before, new(15), p, new(5)])
        at = len(before) + 15
        for found in (passages.align(x, y), [(b, m, a, n) for a, n, b, m in passages.align(y, x)]):
            inside.append((20, 60, at, 60) in found)
        changed = np.concatenate([p[:12], new(5), p[17:]])  # a word is another one: no long run is left
        x = np.concatenate([new(20), changed, new(20)])
        for found in (passages.align(x, y), [(b, m, a, n) for a, n, b, m in passages.align(y, x)]):
            inside.append(any(a <= 20 and a + n >= 80 and b <= at and b + m >= at + 60 for a, n, b, m in found))
    assert inside == [True] * 20
    lines = np.tile(new(7), 3000)
    found = passages.align(np.concatenate([lines, p]), np.concatenate([p, lines[:9000], new(4)]))
    assert {(a, n) for a, n, _, _ in found} >= {(21_000, 60)} and min(a for a, *_ in found) == 0 and len(found) < 50


def test_passages_are_found(spark):
    passage = words(60, 77)
    texts = [(i, " ".join(words(80, i) + (passage if i % 2 else []) + words(50, 500 + i))) for i in range(12)] + [(50, " ".join(words(70, 900)))] * 1 + [(51, " ".join(words(70, 900))), (52, None), (53, " ".join(passage[:30]))]
    rows = {r["doc_id"]: r for r in passages.find(docs(spark, texts)).collect()}
    for i in range(12):
        assert [(s["start"], s["end"]) for s in rows[i]["repeated"]] == ([(80, 140)] if i % 2 else [])
        assert rows[i]["class_id"] == (1 if i % 2 else i)
    assert sum(bool(rows[i]["dropped"]) for i in range(12)) == 5
    assert [(s["start"], s["end"]) for s in rows[51]["dropped"]] == [(0, 70)] and not rows[50]["dropped"] and rows[51]["class_id"] == 50
    assert not rows[52]["repeated"] and not rows[53]["repeated"]
    df = docs(spark, texts[1:2]).withColumn("d", F.array(F.struct(F.lit(80).cast("long").alias("start"), F.lit(140).cast("long").alias("end"))))
    assert df.select(passages.remove(F.col("text"), F.col("d"), F.lit(190).cast("long"))).first()[0].split() == texts[1][1].split()[:80] + texts[1][1].split()[140:]


def test_passages_are_found_among_outsiders(spark):
    exact, near = words(50, 78), words(60, 79)
    changed = [*near[:30], "changed", *near[31:]]
    texts = [(i, " ".join(words(60, i) + p + words(60, 500 + i))) for i, p in [(0, exact), (1, exact), (2, near), (3, changed)]]
    pieces = [x[a : a + 30] for x in (exact, near) for a in (0, len(x) - 30)]  # shorter than a passage, but they hold its minima
    texts += [(i, " ".join(words(70, 1000 + i) + pieces[i % 4] + words(70, 2000 + i))) for i in range(10, 170)]
    rows = {r["doc_id"]: r for r in passages.find(docs(spark, texts)).collect()}
    assert [[(s["start"], s["end"]) for s in rows[i]["repeated"]] for i in range(4)] == [[(60, 110)]] * 2 + [[(60, 120)]] * 2
    assert [rows[i]["class_id"] for i in range(4)] == [0, 0, 2, 2] and not any(r["repeated"] for i, r in rows.items() if i > 3)
    for i in (0, 2):
        assert sorted(len(rows[k]["dropped"]) for k in (i, i + 1)) == [0, 1]


def test_runs_of_shingles():
    x = np.array([5, 6, 7, 0, 5, 6, 7, 8], np.uint32)
    h = passages.run_hashes(x, 3)
    assert len(h) == 6 and h[0] == h[4] and len(set(h.tolist())) == 5


# ---- personal data


def plain_spans(t):
    out = []
    digits = lambda m: re.sub("[^0-9]", "", m)

    def luhn(d):
        return sum(int(x) if k % 2 == 0 else (2 * int(x) - 9 * (int(x) > 4)) for k, x in enumerate(reversed(d))) % 10 == 0

    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    for kind, (pattern, ok) in rules.items():
        out += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, t or "") if ok(m[0])]
    return ",".join(out)


def test_base_spans_against_plain(spark):
    rng = np.random.default_rng(6)
    alphabet = ["a", "é", "𝒳", "@", ".", "_", " ", "-", "+", "(", ")", "1", "4", "25", "192.168.0.1", "a.b@c.de", "a@b", "4111 1111 1111 1111", "+1 (743) 555-3824", "0", "\n", "300.1.1.1", "007.1.2.3", "4111111111111112"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(400)] + [None, "", "a@b.com_x@y.org", "1.2.3.4.5.6.7.8", "x" * 20_000 + "@", "1" * 5_000, "+1" + "2" * 200]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", pii.span_list(pii.base_spans(F.coalesce("text", F.lit("")))).alias("s")).collect()
    assert {r["i"]: r["s"] for r in rows} == {i: plain_spans(t) for i, t in enumerate(texts)}


def test_disclosing_terms(spark):
    texts = [(i, f"Report {i} by Zorblax about {' '.join(words(8, i))} mail zor@mail.example.com now") for i in range(8)] + [(100 + i, f"report about mail now {' '.join(words(9, 100 + i))}") for i in range(600)]
    rows = pii.find(docs(spark, texts), min_texts=5).collect()
    for r in rows:
        text = dict(texts)[r["doc_id"]]
        terms = {text[s["start"] : s["end"]] for s in r["extra"]}
        assert terms == ({"Zorblax", "by"} if r["doc_id"] < 100 else set())
    one = pii.find(docs(spark, texts), keep=("text",), min_texts=5).filter("doc_id = 3").select(pii.sanitise(F.col("text"), F.col("base"), F.col("extra"))).first()[0]
    assert "Zorblax" not in one and "zor@" not in one and "[EMAIL]" in one and one.startswith("Report 3 [WORD] [NAME] about")


# ---- fingerprints


def test_edits_and_next(spark):
    texts = [(3 * i, " ".join(words(int(5 + i % 7), i) + ["the", "red", "house", "of", "old", "stone"])) for i in range(500)] + [(2, ""), (4, None)]
    rows = {r["doc_id"]: r for r in spotsigs.fingerprint_edits(docs(spark, texts)).collect()}
    order = sorted((i for i, _ in texts), reverse=True)
    known = {i: t or "" for i, t in texts}
    for k, i in enumerate(order):
        t, nxt = known[i], known[order[(k + 1) % len(order)]]
        h = len(t) // 2
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited"] == t[: len(t) - h] + nxt[:h]
        a, b = set(rows[i]["signature"]), set(rows[order[(k + 1) % len(order)]]["signature"])
        assert abs(rows[i]["near_next"] - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12
    assert spotsigs.fingerprint_edits(docs(spark, [(1, "a b")])).first()["edited"] == "a a"[:2] + "a"


@pytest.mark.parametrize(("window_rows", "splits"), [(2, 1), (2, 4), (7, 3), (1, 50)])
def test_next_rows_over_many_windows(spark, window_rows, splits):
    """The next row in order, whatever the windows: gaps between ids, an id of many rows, null ids."""
    rng = np.random.default_rng(window_rows)
    rows = [(int(i), int(t)) for i, t in zip(np.cumsum(rng.integers(1, 10**6, 90)), rng.integers(-(1 << 62), 1 << 62, 90), strict=True)]
    rows += [(77, int(t)) for t in rng.integers(-(1 << 62), 1 << 62, 60)] + [(None, int(t)) for t in rng.integers(-(1 << 62), 1 << 62, 40)] + [(-5, 1), (1 << 60, 2), (1 << 60, 2)]
    df = spark.createDataFrame(rows, "doc_id long, _tie long")
    out = spotsigs.with_next(df, ["doc_id", "_tie"], window_rows, splits).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = sorted(map(repr, zip(order, order[1:] + order[:1], strict=True)))
    assert sorted(repr(((r["doc_id"], r["_tie"]), (r["next_doc_id"], r["next__tie"]))) for r in out) == want


def test_windows_hold_few_rows(spark):
    """Windows stay small where one id has a third of all rows, and are cut twice."""
    df = spark.range(30_000).selectExpr("if(id % 3 = 0, 7, id * id) AS doc_id", "xxhash64(id) AS _tie").withColumn("_along", spotsigs._along(F.col("doc_id"), F.col("_tie")))
    sizes = [r["count"] for r in spotsigs._windows(df, 100, 1_024).groupBy("_bucket").count().collect()]
    assert sum(sizes) == 30_000 and len(sizes) > 200 and max(sizes) < 500


def test_similar_fingerprints(spark):
    rng = np.random.default_rng(9)
    sets = [sorted(set(rng.integers(0, 40, rng.integers(1, 14)).tolist())) for _ in range(120)]
    sets += [s[:-1] for s in sets if len(s) > 6]
    rows = spark.createDataFrame(list(enumerate(sets)), "id long, signature array<int>")
    got = {(r["id_a"], r["id_b"]) for r in spotsigs.alike(rows, 0.7).collect()}
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    want = set()
    for s, i in first.items():
        for t, j in first.items():
            if i != j and s and t and len(set(s) & set(t)) / len(set(s) | set(t)) >= 0.7 and (len(s), i) < (len(t), j):
                want.add((i, j))
    assert got == want and want


# ---- pages


def test_blocks():
    page = "<html><head><title>t</title></head><body><header>h</header><nav><a>n</a></nav><main><article><header><h1>T &amp; t</h1></header><p>one<br>two<p>three <b>x</b>\n y<div class='advert'>ad</div><ul><li>a<li>b</ul><aside>s</aside><form>f</form><section id=comments><p>c</p></section></article></main><footer>f</footer></body></html>"
    assert html_text.main_text(html_text.blocks(page)) == "T & t\none two\nthree x y\na\nb"
    assert html_text.main_text(html_text.blocks("<body><p>a<script>if(a<b)</script>b<style>p{}</style><!-- x --><p>c &lt;d&gt; <i>e</i></body>")) == "ab\nc <d> e"
    for odd in ("", "<", "<p", "a<b", "</p></div>x", "<p title='a>b'>y</p>", "<!doctype html>z", "&amp &eacute;&#233;", "<div" * 2_000, "<b>" * 5_000 + "q"):
        html_text.main_text(html_text.blocks(odd))
    assert html_text.main_text(html_text.blocks("<p title='a>b'>y</p>")) == "y"


@pytest.mark.parametrize("made", ["<b>|</i>", "<a |\"", "<b>|<hr>", "<a \"x\" |'", "<a \"x' |", "</b |\"", "<li>|</p>", "<a \"|", "<title>|", "<!--|"])
def test_malformed_pages_take_time_by_their_size(made):
    """Pages of 1 MB whose tags or quotes stay open; 2 seconds of processor time are many times what they need."""
    one, end = made.split("|")
    n = 1_000_000 // len(one + end if len(end) > 1 else one)
    page = "<p>begin</p>" + one * n + (end * n if len(end) > 1 else end) + "<p>end</p>"
    began = time.process_time()
    found = html_text.blocks(page)
    assert time.process_time() - began < 2 and found[0] == ("body", "begin")


def test_only_what_the_contract_names_goes():
    page = "<article><p hidden>a</p><p aria-hidden='true'>b</p><button>c</button><div class='widget-x'>d</div><div id=respond>e</div><form>f</form><div class=cookie-bar>g</div><p>h</article>"
    assert html_text.main_text(html_text.blocks(page)) == "a\nb\nc\nd\ne\nh"


def test_repeats_of_a_host(spark):
    menu, foot = "Home News Sport Weather Travel Culture Music Film", "all rights reserved by the people who made this page"
    rows = [(i, f"http://h{'' if i % 5 else i}.org/{i}", f"<body><div>{menu}</div><p>{' '.join(words(12, i))}</p><div>{foot}</div></body>") for i in range(40)]
    for shard in (256, 4):
        got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), shard_pages=shard).collect()}
        for i in range(40):
            own = " ".join(words(12, i))
            assert got[i] == (own if i % 5 else f"{menu}\n{own}\n{foot}"), (shard, i)


def test_covered_against_plain():
    rng = np.random.default_rng(3)
    streams = [rng.integers(0, 3, rng.integers(0, 40)) for _ in range(12)]
    got = html_text.covered_tokens(streams, 5, 3)
    held = defaultdict(set)
    for p, s in enumerate(streams):
        for k in range(len(s) - 4):
            held[tuple(s[k : k + 5])].add(p)
    for s, mask in zip(streams, got, strict=True):
        want = np.zeros(len(s), bool)
        for k in range(len(s) - 4):
            if len(held[tuple(s[k : k + 5])]) >= 3:
                want[k : k + 5] = True
        assert (mask == want).all()


# ---- search and toxicity


def test_top_k_against_plain(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 0.3, (300, 24)).astype(np.float32)
    v[10:20] = v[10]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = topk.top_k(df, df.filter("vec_id % 50 = 0"), shard_rows=70, block_queries=2).collect()
    q = np.floor(256 * v.astype(np.float64)).astype(np.int64)
    for i in range(0, 300, 50):
        s = q @ q[i]
        want = sorted(((-int(s[j]), j) for j in range(300) if j != i))[:5]
        assert [(-r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == i), key=lambda r: r["rank"])] == want


def test_toxicity_learns_and_shares_subwords():
    rng = np.random.default_rng(0)
    texts = [" ".join(words(30, i)) for i in range(300)]
    labels = np.zeros(300)
    for i in range(0, 300, 3):
        labels[i] = 1
        w = texts[i].split()
        w[int(rng.integers(0, 30))] = str(rng.choice(["dreadfuls", "dreadful", "undreadful", "dreadfully"]))
        texts[i] = " ".join(w)
    model = toxicity.fit(texts, labels, epochs=60)
    unseen = model.score([" ".join(words(30, 900)) + " dreadfulx", " ".join(words(500, 901)), "", " ".join(words(600, 902)) + " dreadful " + " ".join(words(600, 903))])
    assert unseen[0] > 0.7 and unseen[1] < 0.5 and unseen[2] < 0.5 and unseen[3] > 0.7
    assert abs(model.score(["a b", "c"])[1] - model.score(["c"])[0]) < 1e-9


def test_checkpoint_folder_is_the_sessions(spark):
    common.ensure_checkpoint_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir") in spark.sparkContext._jsc.sc().getCheckpointDir().get()


def test_digest_is_stable():
    assert line_dedup.digest(b"x") == hashlib.blake2b(b"x", digest_size=16).digest()
