"""Language identification (operator 7) by Bayesian evidence fusion.

log P(language | row) adds up, apart from a constant:
- the text's log-likelihood under a model of hashed byte trigrams, tempered so that a long text is no stronger than TEMPER trigrams;
- the declared markup language: P(declared | language), a smoothed table that grouped aggregation learns from the rows themselves;
- the address suffix: P(suffix | language), learned alike;
- the host's prior, smoothed hierarchically: host towards registered domain towards all rows, without the row's own share.

What is bounded: the trigram model is fitted on about FIT_PER_LANGUAGE labelled rows for each language, picked by a hash at rates
that follow from the counts; over MAX_LANGUAGES languages are an error. Every other statistic is a grouped aggregation over all rows.

Nulls and edge cases: a missing or empty text has an even likelihood, so the other evidence decides; a missing declaration, host or
suffix is evidence of its own kind (a value of its own); a row without any letter in its text gets language "und" and posterior 0;
an empty table gives an empty result; repeated rows are all returned.

Scale: the sums of a host, domain, declaration or suffix go to its rows by a join. Values with over HOT_SHARE of all rows, fewer than
1 / HOT_SHARE of them, are broadcast; their rows are dealt evenly in the join with the others.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common

FIT_PER_LANGUAGE, MAX_LANGUAGES, HOT_SHARE = 500, 256, 1e-3
TABLE, TEMPER = 1 << 16, 60
PRIOR_WEIGHT, EVIDENCE_SMOOTHING = 5.0, 1.0
MIN_POSTERIOR = 0.5
#: Marks whose content is not text, and what ends them.
CLOSED = re.compile(r"<(?:(script|style|noscript)\b|!--)", re.IGNORECASE)
ENDS = {k: re.compile(rf"</{k}\s*>", re.IGNORECASE) for k in ("script", "style", "noscript")} | {"": re.compile("-->")}


def visible(page: str | None) -> str:
    """Text of a page without markup, scripts, styles and comments; entities decoded.

    What is never closed is taken as a plain mark up to the next >, and a < without one as text. Each ending is missed once, so the
    time is linear in the page.
    """
    parts, at, missing = [], 0, set()
    page = page or ""
    while (start := page.find("<", at)) >= 0:
        parts.append(page[at:start])
        mark, end = CLOSED.match(page, start), -1
        kind = (mark.group(1) or "").lower() if mark else None
        if mark and kind not in missing:
            if found := ENDS[kind].search(page, mark.end()):
                end = found.end()
            else:
                missing.add(kind)
        if end < 0:
            end = page.find(">", start) + 1
            if not end:
                at = start
                break
        parts.append(" ")
        at = end
    return html_lib.unescape("".join([*parts, page[at:]]))


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased letters, where all else is one space. Empty if there is no letter."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    letter = (raw >= 128) | ((raw >= 97) & (raw <= 122))
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    raw = np.where(letter, raw, 32).astype(np.uint32)
    raw = raw[np.r_[True, (raw[1:] != 32) | (raw[:-1] != 32)]]
    raw = np.r_[np.uint32(32), raw, np.uint32(32)].astype(np.uint32)
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


@dataclass
class TextModel:
    languages: list[str]
    logs: np.ndarray  # languages by hashed trigrams

    def likelihood(self, text: str) -> list[float] | None:
        """Tempered log-likelihood per language, best 0; None without a letter, or if no language is known."""
        grams = trigrams(text)
        if not len(grams) or not self.languages:
            return None
        mean = self.logs[:, grams].mean(axis=1, dtype=float)
        total = mean * min(len(grams), TEMPER)
        return (total - total.max()).tolist()


def fit_text(labelled: DataFrame) -> TextModel:
    """Trigram frequencies of a bounded sample of labelled rows (doc_id, text, lang), each row weighing alike."""
    common.prepare(labelled.sparkSession)
    known = labelled.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return TextModel([], np.zeros((0, TABLE)))
    rate = F.lit(0.0)
    for r in counts:
        rate = F.when(F.col("lang") == r["lang"], F.lit(1e6 * FIT_PER_LANGUAGE / r["count"])).otherwise(rate)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for at, texts in common.texts_of(batch.column(1)):
                for lang, text in zip(batch.column(0).slice(at, len(texts)).to_pylist(), texts, strict=True):
                    if len(grams := trigrams(text)):
                        total[lang] = total.get(lang, 0.0) + np.bincount(grams, minlength=TABLE) / len(grams)
        for lang, t in total.items():
            hit = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit)), pa.array(hit), pa.array(t[hit])], ["lang", "gram", "weight"])

    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate).select("lang", "text")
    rows = sample.mapInArrow(count, "lang string, gram long, weight double").groupBy("lang", "gram").agg(F.sum("weight").alias("weight")).collect()
    languages = sorted({r["lang"] for r in rows})
    table = np.full((len(languages), TABLE), 1e-5)
    for r in rows:
        table[languages.index(r["lang"]), r["gram"]] += round(r["weight"], 9)
    return TextModel(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def evidence(rows: DataFrame, model: TextModel, markup: bool) -> DataFrame:
    """(row columns without text, a likelihood of each language, has_text): rows need a column text; markup: it holds a page's HTML."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # MAX_LANGUAGES * 65,536 numbers at most
    others = [f for f in rows.schema.fields if f.name != "text"]
    even = [0.0] * len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found: list[list[float] | None] = []
            for _, texts in common.texts_of(batch.column(batch.schema.get_field_index("text"))):
                found += [m.likelihood(visible(t) if markup else t or "") for t in texts]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in others]
            each = np.array([even if x is None else x for x in found]).reshape(len(found), len(even))
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(each[:, i].copy()) for i in range(len(even))), pa.array([x is not None for x in found], pa.bool_())], [*(f.name for f in others), *(f"likelihood{i}" for i in range(len(even))), "has_text"])

    schema = T.StructType([*others, *(T.StructField(f"likelihood{i}", T.DoubleType()) for i in range(len(even))), T.StructField("has_text", T.BooleanType())])
    return rows.mapInArrow(run, schema)


def domain_of(host: Column) -> Column:
    """The last two labels of a host name."""
    return F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)


def _softmax(scores: np.ndarray) -> np.ndarray:
    parts = np.exp(scores - scores.max(axis=1, keepdims=True))
    return parts / parts.sum(axis=1, keepdims=True)


def posteriors(likelihood: np.ndarray, has_text: np.ndarray, sums: dict[str, np.ndarray], total: np.ndarray, kinds: dict[str, int]) -> np.ndarray:
    """Posterior of each language in each row. sums: per host, domain, declared and suffix the shares by text alone over its rows."""
    own = _softmax(likelihood) * has_text[:, None]
    less = {k: np.maximum(v - own, 0.0) for k, v in sums.items()}  # without the row itself
    prior = np.broadcast_to((total + EVIDENCE_SMOOTHING) / (total.sum() + EVIDENCE_SMOOTHING * len(total)), own.shape)
    for level in ("domain", "host"):
        prior = (less[level] + PRIOR_WEIGHT * prior) / (less[level].sum(axis=1, keepdims=True) + PRIOR_WEIGHT)
    rest = np.maximum(total - own, 0.0)
    score = likelihood + np.log(prior)
    for kind in ("declared", "suffix"):
        score = score + np.log((less[kind] + EVIDENCE_SMOOTHING) / (rest + EVIDENCE_SMOOTHING * max(1, kinds[kind])))
    return _softmax(score)


def with_sums(rows: DataFrame, key: str, sums: DataFrame, hot: float) -> DataFrame:
    """rows with the sums of their key. sums: (key, rows, numbers); those with over hot rows are broadcast, the others' rows dealt by key."""
    numbers = [c for c in sums.columns if c not in (key, "rows")]
    few = sums.where(F.col("rows") > hot).select(F.col(key).alias("__few"), *[F.col(c).alias(f"__few_{c}") for c in numbers])  # under 1 / HOT_SHARE rows
    many = sums.where(F.col("rows") <= hot).select(F.struct(F.lit(0).cast("long").alias("at"), F.col(key).alias("key")).alias("__many"), *numbers)
    met = rows.join(F.broadcast(few), rows[key] == few["__few"], "left")
    # a hot row meets nothing in the second join, so its key there is anything that is even
    own = F.struct(F.when(F.col("__few").isNull(), F.lit(0)).otherwise(F.col("__spread")).cast("long").alias("at"), F.when(F.col("__few").isNull(), F.col(key)).alias("key"))
    met = met.withColumn("__own", own).join(many, F.col("__own") == F.col("__many"), "left")
    return met.withColumns({c: F.coalesce(f"__few_{c}", c) for c in numbers}).drop("__few", "__many", "__own", *[f"__few_{c}" for c in numbers])


def fuse(seen: DataFrame, languages: list[str]) -> DataFrame:
    """Evidence rows (keys, declared, suffix, host, likelihoods, has_text) with language and posterior; nothing is joined per pair of rows."""
    n = range(len(languages))
    if not languages:
        return seen.withColumns({"language": F.lit("und"), "posterior": F.lit(0.0)})
    seen = seen.withColumns({c: F.coalesce(F.lower(c), F.lit("")) for c in ("declared", "suffix", "host")}).withColumn("domain", domain_of(F.col("host")))
    # the share of each language by text alone; rows without text say nothing
    most = F.greatest(*[F.col(f"likelihood{i}") for i in n]) if len(languages) > 1 else F.col("likelihood0")
    whole = sum((F.exp(F.col(f"likelihood{i}") - most) for i in n), F.lit(0.0))
    shares = [F.when(F.col("has_text"), F.exp(F.col(f"likelihood{i}") - most) / whole).otherwise(F.lit(0.0)) for i in n]
    levels = ("host", "domain", "declared", "suffix")
    grouped = {k: seen.groupBy(k).agg(F.count("*").alias("rows"), *[F.sum(x).alias(f"{k}_{i}") for i, x in enumerate(shares)]) for k in levels}
    first = seen.agg(F.count("*"), *[F.coalesce(F.sum(x), F.lit(0.0)) for x in shares], *[F.count_distinct(c) for c in ("declared", "suffix")]).first()
    rows, total, kinds = first[0], np.array(first[1 : len(languages) + 1], dtype=float), dict(zip(("declared", "suffix"), first[len(languages) + 1 :], strict=True))
    joined = seen.withColumn("__spread", F.xxhash64(*[c for c in seen.columns if not c.startswith("likelihood")], "likelihood0"))
    for k, sums in grouped.items():
        joined = with_sums(joined, k, sums, HOT_SHARE * rows)
    kept = [f for f in seen.schema.fields if not f.name.startswith("likelihood")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            matrix = lambda c: np.stack([column(f"{c}{i}").to_numpy(zero_copy_only=False) for i in n], axis=1)
            has = column("has_text").to_numpy(zero_copy_only=False).astype(bool)
            if not batch.num_rows:
                continue
            p = posteriors(matrix("likelihood"), has, {k: matrix(f"{k}_") for k in levels}, total, kinds)
            best = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*(column(f.name) for f in kept), pa.array([languages[k] if h else "und" for k, h in zip(best, has, strict=True)], pa.string()), pa.array(np.where(has, p.max(axis=1), 0.0))], [*(f.name for f in kept), "language", "posterior"])

    return joined.mapInArrow(run, T.StructType([*kept, T.StructField("language", T.StringType()), T.StructField("posterior", T.DoubleType())]))


def identify(rows: DataFrame, model: TextModel, markup: bool = False) -> DataFrame:
    """rows: text, declared, suffix, host and any key columns. Returns the keys, the evidence, language and posterior."""
    seen = evidence(rows, model, markup).checkpoint()  # texts are read once; later steps need a few numbers of each
    return fuse(seen, model.languages)


def page_rows(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select("page_id", F.col("html").alias("text"), F.lower(F.regexp_extract("html", r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)).alias("declared"), F.regexp_extract(host, r"\.([^.]+)$", 1).alias("suffix"), host.alias("host"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page: page_id, host, suffix, declared, language, posterior. The trigram model is fitted on labelled documents."""
    model = fit_text(common.table(spark, sf_dir, "documents"))
    return identify(page_rows(common.table(spark, sf_dir, "pages")), model, True).select("page_id", "host", "suffix", "declared", "language", F.round("posterior", 9).alias("posterior"))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: rows without a letter, or whose best language has a posterior under MIN_POSTERIOR, go.

    A document's source stands for its host and its lang for the declared language; it has no address suffix.
    """
    model = fit_text(docs)
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), "text", F.col("lang").alias("declared"), F.lit("").alias("suffix"), F.col("source").alias("host"))
    found = identify(rows, model)
    rejected = found.where((F.col("posterior") < MIN_POSTERIOR) | ~F.col("has_text")).select("_id", "_hash").distinct()
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["_id"]) & F.xxhash64(docs["text"]).eqNullSafe(rejected["_hash"]), "left_anti")
