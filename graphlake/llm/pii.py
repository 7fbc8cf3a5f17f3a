"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Fixed patterns find the protected entities: single values, and the classes of all values of a kind. How much a term
tells about an entity is estimated from co-occurrence over the corpus: the pointwise mutual information of the two
against the entity's own information content, where the share of the term's texts that hold the entity is taken at the
lower end of its confidence interval, so that chance meetings of rare words tell little. Where the share that a term
discloses reaches a threshold, the term is generalised, and beyond a higher one removed: terms about a value in the
texts that hold it, terms about a class wherever they stand. Words of letters and digits rarely occur twice, so they
stand for their shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: What each kind looks like. Runs are entered at their start only, and never given back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_PARTS = rf"^{_PART}(?:\.{_PART}){{3}}$"
WORDS = r"[^\p{L}\p{N}]+"
#: Distinct texts in which a term and an entity must meet; shares of an entity's information that call for action.
MIN_TEXTS, GENERALISE, REMOVE = 5, 0.85, 0.98
#: Standard deviations between an observed frequency and the lower end of its confidence interval.
CONFIDENCE = 2.0
#: So many terms or texts are broadcast at most; more are joined by shuffle.
BROADCAST_TERMS = 200_000
#: Words of letters and digits, longer than this, are terms by the power of two that their length is within.
SHAPED = 8
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _spans(text: Column, pattern: Column, kind: str) -> Column:
    """All matches with their places in code points, from the matches and the pieces between them."""
    found, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    zipped = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("hit")))

    def step(at, x):
        start = at + x["gap"]
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["hit"].alias("value"))
        return F.struct(end.alias("state"), F.when(x["hit"].isNull(), F.array().cast(_SPAN)).otherwise(F.array(span)).alias("out"))

    return F.transform(F.array(zipped), lambda z: common.fold(z, F.lit(0), F.array().cast(_SPAN), step))[0]


def _luhn(digits: Column) -> Column:
    """Whether the check digit holds: from the right, every second digit is doubled, and 9 taken off above 9."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _valid_span(kind: str):
    return lambda s: _valid(kind, s["value"])


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>> of the personal data in a text, by kind and start (end exclusive)."""
    kinds = []
    for kind, pattern in PATTERNS.items():
        spans = _spans(text, F.lit(pattern), kind)
        if kind != "email":
            spans = F.filter(spans, _valid_span(kind))
        hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS[kind])
        kinds.append(F.when(hint, spans).otherwise(F.array().cast(_SPAN)))
    return F.concat(*kinds)


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def terms_of(text: Column) -> Column:
    """Distinct lower-cased words; a longer word of letters and digits is `#` and the power of two its length is within."""
    mixed = lambda w: (F.length(w) > SHAPED) & w.rlike(r"\p{L}") & w.rlike(r"\p{N}")
    shape = lambda w: F.concat(F.lit("#"), F.ceil(F.log2(F.length(w).cast("double")) - 1e-9).cast("string"))
    words = F.filter(F.split(F.lower(text), WORDS), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.when(mixed(w), shape(w)).otherwise(w)))


def _lower_end(hits: Column, of: Column, z: float = CONFIDENCE) -> Column:
    """Lower end of the confidence interval of a frequency (Wilson's)."""
    n, p = of.cast("double"), hits / of
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _met(found: DataFrame, min_texts: int) -> tuple[DataFrame, DataFrame]:
    """(entity, _c: rows that hold it, _key, _rows: of this text), and (value, entity) of the values among the entities.

    Values that the same texts hold tell the same and are one entity, under the least of them, so a long list of
    addresses that is found again and again is one entity too. Classes are named by their kind and a colon.
    """
    each = lambda names: found.select("_key", F.explode(names).alias("value")).groupBy("value", "_key").agg(F.count("*").alias("_rows"))
    values = each(F.array_distinct(F.transform("base", lambda s: s["value"])))
    known = values.groupBy("value").agg(F.sum("_rows").alias("_c"), F.count("*").alias("_texts"), F.bit_xor(F.xxhash64("_key")).alias("_sig"), F.bit_xor(F.xxhash64(F.lit(1), "_key")).alias("_sig2"))
    known = known.filter(F.col("_texts") >= min_texts)
    one = known.groupBy("_sig", "_sig2", "_c", "_texts").agg(F.min("value").alias("entity"))
    named = known.join(one, ["_sig", "_sig2", "_c", "_texts"]).select("value", "entity")
    values = values.join(known.join(one, ["_sig", "_sig2", "_c", "_texts"]).filter("value = entity").select("value", "_c"), "value")
    classes = each(F.array_union(F.array_distinct(F.transform("base", lambda s: F.concat(s["kind"], F.lit(":")))), F.array(F.lit("any:"))))
    classes = classes.join(classes.groupBy("value").agg(F.sum("_rows").alias("_c")), "value")
    return values.select("value", "_c", "_key", "_rows").unionByName(classes.select("value", "_c", "_key", "_rows")).withColumnRenamed("value", "entity"), named


def disclosing_terms(found: DataFrame, docs: DataFrame, rows: int, min_texts: int = MIN_TEXTS, generalise: float = GENERALISE, remove: float = REMOVE) -> tuple[DataFrame, DataFrame]:
    """(entity, term, share, action) of terms that disclose at least `generalise` of an entity's information, and the
    values (value, entity) that stand behind entities; classes are named by their kind and a colon.

    `found`: rows with `base` spans, their `_key` and `_text`; `docs`: the corpus that term counts are taken over.
    """
    met, named = _met(found, min_texts)
    # a group of copies is one text: the rows of each are counted before terms are listed
    once = found.groupBy("_key").agg(F.first("_text").alias("_text"), F.first("base").alias("base"))
    # parts of an entity tell nothing new of it: they are taken out first
    texts = once.select("_key", terms_of(_replaced(F.col("_text"), F.col("base"), lambda s: F.lit(" "))).alias("_terms"))
    both = met.join(texts, "_key").select("entity", "_c", "_rows", F.explode("_terms").alias("term")).groupBy("entity", "_c", "term").agg(F.sum("_rows").alias("_ct"), F.count("*").alias("_n"))
    n = F.lit(float(max(rows, 1)))
    information = -F.log2(F.col("_c") / n)
    share = lambda t: F.when(information > 0, 1 + F.log2(_lower_end(F.col("_ct"), t)) / information).otherwise(F.lit(0.0))
    # a term is in as many rows of the corpus as meet the entity at least: few meetings can't reach the threshold
    both = common.cut(both.filter((F.col("_n") >= min_texts) & (share(F.col("_ct")) >= generalise)))
    wanted = both.select("term").distinct()
    small = wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    words = docs.select(F.explode(terms_of(common.text_or_empty())).alias("term"))
    if small:
        counts = words.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count("*").alias("_t"))
    else:
        counts = words.groupBy("term").agg(F.count("*").alias("_t")).join(wanted, "term", "left_semi")
    # a term may be in a text apart from what the patterns match, and within it too: it counts once
    out = both.join(counts, "term").select("entity", "term", share(F.greatest("_t", "_ct")).alias("share"))
    return out.filter(F.col("share") >= generalise).withColumn("action", F.when(F.col("share") >= remove, "remove").otherwise("generalise")), named


def _listed(held_by: DataFrame) -> DataFrame:
    """_k, generalise, remove: the terms of each text by their action."""
    return held_by.groupBy(F.col("_key").alias("_k")).agg(*(F.array_sort(F.collect_set(F.when(F.col("action") == a, F.col("term")))).alias(a) for a in ("generalise", "remove")))


def _extra(text: Column, base: Column) -> Column:
    """Spans of the terms in `generalise` and `remove`, apart from those in `base`."""
    extra = []
    removed = F.coalesce("remove", F.array().cast("array<string>"))
    power = lambda t: F.substring(t, 2, 3).cast("int")
    shape = lambda t: F.concat(F.lit(r"(?=\p{N}*+\p{L})(?=\p{L}*+\p{N})[\p{L}\p{N}]{"), (F.pow(F.lit(2), power(t) - 1) + 1).cast("int").cast("string"), F.lit(","), F.pow(F.lit(2), power(t)).cast("int").cast("string"), F.lit("}+"))
    for action, listed in (("generalise", F.array_except(F.coalesce("generalise", F.array().cast("array<string>")), removed)), ("remove", removed)):
        either = F.array_join(F.transform(listed, lambda t: F.when(t.startswith("#"), shape(t)).otherwise(t)), "|")
        pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), either, F.lit(r")(?![\p{L}\p{N}])"))
        extra.append(F.when(F.size(listed) > 0, _spans(text, pattern, action)).otherwise(F.array().cast(_SPAN)))
    return F.filter(F.concat(*extra), lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def find(docs: DataFrame, keep: tuple[str, ...] = (), min_texts: int = MIN_TEXTS, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """One row per input row: doc_id, `keep`, `base` and `extra` spans (kind `generalise` or `remove`).

    Null text is empty. Spans of the method never overlap those of the patterns. Rows that repeat an id keep their own
    spans: all is decided by text. An empty table gives an empty result.
    """
    carried = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("int")  # names inside can't clash
    src = docs.select("doc_id", carried.alias("_keep"), common.text_or_empty().alias("_text")).withColumn("_key", F.sha2("_text", 256))
    spans = src.withColumn("base", base_spans(F.col("_text")))
    spans = common.cut(spans.withColumn("_text", F.when(F.size("base") > 0, F.col("_text"))))
    found, clean = spans.filter(F.col("_text").isNotNull()), spans.filter(F.col("_text").isNull())
    terms, named = disclosing_terms(found, docs, docs.count(), min_texts, generalise, remove)
    terms = common.cut(terms)
    of_class = common.cut(terms.filter(F.col("entity").endswith(":")).groupBy("term").agg(F.max("action").alias("action")))  # 'remove' is the larger
    # which texts hold a term about a class: a pass over the words of all of them
    words = src.select("_key", F.explode(terms_of(F.col("_text"))).alias("term"))
    small = of_class.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    hits = words.join(F.broadcast(of_class) if small else of_class, "term").select("_key", "term", "action").distinct()
    once = found.groupBy("_key").agg(F.first("base").alias("base"), F.first("_text").alias("_text"))
    by_value = once.select("_key", "_text", F.explode(F.array_distinct(F.transform("base", lambda s: s["value"]))).alias("value")).join(named, "value").join(terms, "entity")
    by_value = by_value.filter(F.array_contains(terms_of(F.col("_text")), F.col("term"))).select("_key", "term", "action")
    per_text = common.cut(_listed(hits.unionByName(by_value)))
    own = F.col("_key") == F.col("_k")
    within = lambda df: df.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    rows = found.join(F.broadcast(per_text) if within(per_text) else per_text, own, "left")
    rows = rows.select("doc_id", "_keep", "base", _extra(F.col("_text"), F.col("base")).alias("extra"))
    # texts without personal data that hold a term about it are read again; the others are done
    outside = common.cut(per_text.join(once.select("_key"), own, "left_anti"))
    listed = F.broadcast(outside) if within(outside) else outside
    none = F.array().cast(_SPAN)
    again = src.join(listed, own)
    again = again.select("doc_id", "_keep", none.alias("base"), _extra(F.col("_text"), none).alias("extra"))
    others = clean.join(listed, own, "left_anti").select("doc_id", "_keep", "base", none.alias("extra"))
    out = rows.unionByName(again).unionByName(others)
    return out.select("doc_id", *(F.col("_keep")[c].alias(c) for c in keep), "base", "extra")


def _replaced(text: Column, spans: Column, new) -> Column:
    """The text with what stands in the spans replaced by new(span); of spans that overlap the one that begins first counts."""
    listed = F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(b["end"] - a["end"]))

    def rebuilt(x):
        def step(at, s):
            skip = s["start"] < at
            more = F.array(F.array_join(F.slice(x["chars"], at + 1, s["start"] - at), ""), new(s))
            return F.struct(F.when(skip, F.greatest(at, s["end"])).otherwise(s["end"]).alias("state"), F.when(skip, F.array().cast("array<string>")).otherwise(more).alias("out"))

        last = F.array_max(F.transform(x["spans"], lambda s: s["end"]))
        parts = common.fold(x["spans"], F.lit(0), F.array().cast("array<string>"), step)
        return F.concat(F.array_join(parts, ""), F.array_join(F.slice(x["chars"], last + 1, F.size(x["chars"])), ""))

    whole = F.transform(F.array(F.struct(F.split(text, "").alias("chars"), listed.alias("spans"))), rebuilt)[0]
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def sanitise(text: Column, base: Column, extra: Column) -> Column:
    """The text with its spans replaced: personal data by its kind, generalised terms by what they are, others by nothing."""
    shape = lambda v: F.when(v.rlike("^[0-9]+$"), "[NUMBER]").when(v.rlike("[0-9]"), "[CODE]").when(v.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    new = lambda s: F.when(s["kind"] == "remove", "").when(s["kind"] == "generalise", shape(s["value"])).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    return _replaced(text, F.concat(base, extra), new)
