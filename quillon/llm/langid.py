"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.textkit import chunks, code_points, letters, lower_map, narrow_batches, utf8_parts

ORDERS = (1, 2, 3)
LOG_BUCKETS = 16
BUCKETS = 1 << LOG_BUCKETS
UNKNOWN = "und"


def ngram_buckets(raw: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(buckets of the 1-, 2- and 3-grams that start at each kept character, offsets, whether a document has a letter).

    Characters are lower-cased letters; any run of others counts as one space. An n-gram that would leave its document
    has bucket BUCKETS, which carries no weight.
    """
    points, cut = code_points(raw, ends)
    low = lower_map()[points]
    letter = letters()[points]
    after = np.zeros(len(points), bool)
    after[1:] = letter[:-1]
    after[cut[:-1][cut[:-1] < len(points)]] = False
    keep = letter | after
    low = np.where(letter, low, 32)[keep].astype(np.uint32)
    cut = np.concatenate([[0], np.cumsum(keep)])[cut]
    grams, h = [], np.zeros(len(low), np.uint32)
    for n in ORDERS:
        shifted = np.zeros(len(low), np.uint32)
        shifted[: len(low) - n + 1] = low[n - 1 :]
        h = (h ^ shifted) * np.uint32(0x9E3779B1) + np.uint32(n)
        h ^= h >> np.uint32(15)
        bucket = ((h * np.uint32(0x85EBCA77)) >> np.uint32(32 - LOG_BUCKETS)).astype(np.int32)
        for k in range(1, n):
            at = cut[1:] - k
            bucket[at[at >= cut[:-1]]] = BUCKETS
        grams.append(bucket)
    return grams, cut, np.diff(cut) > 0


@dataclass(frozen=True)
class LanguageModel:
    """labels, sorted; log prior by label; log probability by label and bucket."""

    labels: tuple[str, ...]
    log_prior: np.ndarray
    log_prob: np.ndarray


def fit(df: DataFrame, text: str = "text", lang: str = "lang", max_docs_per_label: int = 2000, max_labels: int = 64, alpha: float = 0.1) -> LanguageModel:
    """Learn from rows with a label. Priors count all of them; n-grams are counted on a bounded sample.

    max_docs_per_label bounds the sample: rows whose hash falls below bound / count of their label (all, if fewer), so
    about that many of each label whatever the table's size. The driver gets at most max_labels x 65,536 counts; more
    labels are an error. No labelled row gives a model without labels.
    """
    rows = df.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = sorted((r["lang"], r["count"]) for r in rows.groupBy("lang").count().limit(max_labels + 1).collect())
    if len(counts) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    labels = tuple(x for x, _ in counts)
    if not labels:
        return LanguageModel((), np.zeros(0), np.zeros((0, BUCKETS + 1)))
    share = F.create_map(*[x for label, n in counts for x in (F.lit(label), F.lit(min(1.0, max_docs_per_label / n)))])
    sample = rows.where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).repartition(4)
    number = {x: k for k, x in enumerate(labels)}

    def count(batches):
        total = np.zeros((len(labels), BUCKETS + 1), np.int64)
        for batch in batches:
            raw, ends = utf8_parts(batch.column("text"))
            which = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for lo, hi, data, cut in chunks(raw, ends):
                grams, at, _ = ngram_buckets(data, cut)
                row = np.repeat(which[lo:hi], np.diff(at)) * (BUCKETS + 1)
                for g in grams:
                    total += np.bincount(row + g, minlength=total.size).reshape(total.shape)
        a, b = np.nonzero(total[:, :BUCKETS])
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], names=["label", "bucket", "n"])

    got = sample.mapInArrow(count, "label int, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    seen = np.full((len(labels), BUCKETS + 1), alpha)
    seen[np.asarray(got["label"]), np.asarray(got["bucket"])] += np.asarray(got["n"])
    log_prob = np.log(seen) - np.log(seen[:, :BUCKETS].sum(axis=1, keepdims=True))
    log_prob[:, BUCKETS] = 0
    n = np.array([x for _, x in counts], float)
    return LanguageModel(labels, np.log(n / n.sum()), log_prob)


def scores(raw: np.ndarray, ends: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """(number of the most probable label, its posterior) per document; -1 and 0 for one without letters."""
    best, score = np.full(len(ends) - 1, -1), np.zeros(len(ends) - 1)
    for lo, hi, data, cut in chunks(raw, ends):
        grams, at, has = ngram_buckets(data, cut)
        if not has.any() or not model.labels:
            continue
        joint = np.empty((len(model.labels), int(has.sum())))
        for k, weights in enumerate(model.log_prob):
            joint[k] = model.log_prior[k] + sum(np.add.reduceat(weights[g], at[:-1][has]) for g in grams)
        top = joint.argmax(axis=0)
        best[lo:hi][has] = top
        score[lo:hi][has] = 1 / np.exp(joint - joint.max(axis=0)).sum(axis=0)
    return best, score


def predict(df: DataFrame, model: LanguageModel, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with lang_pred and score, the posterior of the prediction (0 to 1), from the whole text alone.

    `und` with score 0 for a null text, one without a letter, or a model without labels. Ties go to the first label.
    Other columns pass through; columns already so named are replaced. The model (bounded, see fit) is broadcast; one
    pass, no shuffle.
    """
    held = [c for c in df.columns if c not in (label, score)]
    schema = T.StructType([*(df.schema[c] for c in held), T.StructField(label, T.StringType(), False), T.StructField(score, T.DoubleType(), False)])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        names = np.array([*shared.value.labels, UNKNOWN], object)
        for batch in batches:
            best, p = scores(*utf8_parts(batch.column(text)), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.select(held).columns, pa.array(names[best], pa.string()), pa.array(p)], names=[*held, label, score])

    return narrow_batches(df.select(*held)).mapInArrow(run, schema)


def held_out():
    """The rows that the query never learns from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def identified(df: DataFrame) -> DataFrame:
    """Per document doc_id, held_out, lang_pred, score; learned from the labelled rows outside the held-out fold.

    A document with a null doc_id belongs to neither fold's remainder; it is predicted, never learned from, and its
    held_out is false.
    """
    model = fit(df.where(~held_out()))
    return predict(df.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text"), model).drop("text")
