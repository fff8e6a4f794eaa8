"""Operator 10: a quality classifier by co-training of a text view and a metadata view."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldaudit.llm.common import Scratch, cut, free, keep
from fieldaudit.llm.hashing import chunks, shingles, utf8, words

#: Labelled documents of the fit at most, those of the lowest hashes of their ids. Documents without a label in this sample are all used.
LABELLED = 20_000
#: Rounds of exchange and how sure (after calibration) a view must be to label a document for the other.
ROUNDS, SURE = 2, 0.97
#: Features of each view.
TEXT, META = 96, 64
_PLAIN = 24
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&|<>", b"!", b".", b",;:", b"?", b"\n", b"\"'()[]{}", b"@/\\_=+~^`"]


def text_features(texts: pa.Array) -> np.ndarray:
    """Per text: shares of kinds of characters, figures of words, lines and repeats, and shares of words by hash. A null text is empty."""
    data, at = utf8(texts)
    out = np.zeros((len(at) - 1, TEXT), np.float32)
    kind = np.full(256, len(_CLASSES), np.uint8)
    for i, c in enumerate(_CLASSES):
        kind[list(c)] = i
    kind[128:] = len(_CLASSES) + 1
    for lo, hi in chunks(at):
        hashes, starts, ends, first = words(data, at[lo : hi + 1])
        for k in range(lo, hi):
            a, b = int(at[k]), int(at[k + 1])
            w = slice(first[k - lo], first[k - lo + 1])
            h, n = hashes[w], first[k - lo + 1] - first[k - lo]
            if not n:
                continue
            x = out[k]
            x[: len(_CLASSES) + 2] = np.bincount(kind[data[a:b]], minlength=len(_CLASSES) + 2) / (b - a)
            size = ends[w] - starts[w]
            last = data[ends[w] - 1]
            s = shingles(h)
            x[14:_PLAIN] = (
                math.log1p(n) / 10, size.mean() / 10, min(size.std() / 10, 5), len(np.unique(h)) / n, len(np.unique(s)) / len(s),
                np.isin(last, list(b".!?")).mean(), np.isin(last, list(b"#*$%&!|")).mean(), (size == 1).mean(), (kind[data[starts[w]]] == 0).mean(), 1.0,
            )
            x[_PLAIN:] = np.sqrt(np.bincount((h % np.uint64(TEXT - _PLAIN)).astype(np.int64), minlength=TEXT - _PLAIN) / n)
    return out


def meta_features(columns: list[pa.Array], sizes: pa.Array) -> np.ndarray:
    """Per row: the hashed values of the metadata columns and the size by powers of two. A null is a value."""
    out = np.zeros((len(sizes), META), np.float32)
    for c, column in enumerate(columns):
        seen: dict[object, int] = {}
        for i, v in enumerate(column.to_pylist()):
            if v not in seen:
                seen[v] = zlib.crc32(f"{c}|{v}".encode("utf-8", "replace")) % (META - 24)
            out[i, seen[v]] = 1
    for i, v in enumerate(sizes.to_pylist()):
        out[i, META - 24 + min(22, int(v or 0).bit_length())] = 1
    out[:, META - 1] = 1
    return out


def _views(docs: DataFrame, meta: list[str]) -> list[Column]:
    """The text of docs and its metadata as strings; a column that docs lack is null."""
    return [F.coalesce(F.col("text").cast("string"), F.lit("")), *(F.col(f"`{c}`").cast("string") if c in docs.columns else F.lit(None).cast("string") for c in meta)]


def _logit(x: np.ndarray, w: tuple[np.ndarray, float]) -> np.ndarray:
    return np.clip(x.astype(np.float64) @ w[0] + w[1], -30, 30)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of Platt's line from a view's log-odds to calibrated ones, by Newton's steps."""
    z, w = np.stack([x, np.ones(len(x))], 1), np.array([1.0, 0.0])
    pull = np.array([1e-3 * len(x), 1e-9])
    for _ in range(50):
        p = _sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(pull), z.T @ (y - p) - pull * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def auc(y: np.ndarray, score: np.ndarray) -> float:
    """The share of pairs of a good and a bad row that score puts in order, ties half."""
    different, back, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[back]
    good = y > 0
    return float((rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum()))


def co_train(rows: DataFrame, rounds: int = ROUNDS, sure: float = SURE) -> dict:
    """Weights and Platt's lines of the text view t and the metadata view m of rows (y, held, t and m as vectors); y is null where no label is known.

    Held-out labels (at most LABELLED) calibrate. In each round, each view labels every other row that it is sure of for the other's next
    fit. These labels weigh together at most as much as the known ones, each at most as much as one, and good and bad ones as known ones do.
    Every fit is Spark's, over all rows that have a label then.
    """
    known = {(r.y, r.held): r["count"] for r in rows.where("y IS NOT NULL").groupBy("y", "held").count().collect()}
    total = sum(known.values())
    if any((y, h) not in known for y in (0.0, 1.0) for h in (True, False)):
        return {"prior": sum(n for (y, _), n in known.items() if y) / total if total else 1.0, "views": None}
    prior = sum(n for (y, _), n in known.items() if y) / total
    given: dict[str, DataFrame] = {v: rows.where("y IS NOT NULL AND NOT held").select(F.col("y").alias("label"), F.lit(1.0).alias("weight"), v) for v in "tm"}
    out: dict[str, tuple] = {}
    for turn in range(rounds + 1):
        fitted = {}
        for v in "tm":
            fitted[v] = LogisticRegression(featuresCol=v, labelCol="label", weightCol="weight", maxIter=25, regParam=1e-3, tol=1e-4).fit(given[v])
            w = np.array(fitted[v].coefficients.toArray()), float(fitted[v].intercept)
            held = [(r.y, r.z) for r in fitted[v].transform(rows.where("held AND y IS NOT NULL")).select("y", F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("z")).collect()]
            out[v] = (w, _line(np.clip([z for _, z in held], -30, 30), np.array([y for y, _ in held])))
        if turn == rounds:
            break
        for v, to in (("t", "m"), ("m", "t")):
            a, b = out[v][1]
            z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.get(vector_to_array("rawPrediction"), F.lit(1))))
            p: Column = 1 / (1 + F.exp(-(z * a + b)))
            told = fitted[v].transform(rows.where("y IS NULL")).select(F.when(p >= sure, 1.0).when(p <= 1 - sure, 0.0).alias("label"), to).where("label IS NOT NULL")
            count = {r.label: r["count"] for r in told.groupBy("label").count().collect()}
            worth = {y: min(1.0, total * share / count[y]) if count.get(y) else 0.0 for y, share in ((1.0, prior), (0.0, 1 - prior))}
            sides = told.select("label", F.when(F.col("label") == 1.0, worth[1.0]).otherwise(worth[0.0]).alias("weight"), to)
            given[to] = rows.where("y IS NOT NULL AND NOT held").select(F.col("y").alias("label"), F.lit(1.0).alias("weight"), to).union(sides)
    return {"prior": float(np.clip(prior, 0.001, 0.999)), "views": out}


def fit(docs: DataFrame, labels: DataFrame, meta: list[str], labelled: int = LABELLED) -> dict:
    """Weights and calibration of both views. labels: doc_id, quality (0 or 1); rows with a null are skipped, of several the lowest counts.

    A third of the labelled sample is held out and calibrates the views (Platt's lines from log-odds to probability); auc is the area under
    the curve of the combined score on it. Without both classes among the labels there is no fit: every document then gets the share of good
    labels, or 1 without labels. Features of all documents are written once to the shared folder and gone when the fit ends.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("double").alias("y"))
    some = cut(known.orderBy(F.xxhash64("id"), "id").limit(labelled))
    names = ["text", *(f"m{i}" for i in range(len(meta)))]
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), *(v.alias(n) for v, n in zip(_views(docs, meta), names)))

    def run(batches):
        keep("quality_classifier")
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                p = b.slice(lo, 1000)
                parts = [text_features(p.column("text")), meta_features([p.column(n) for n in names[1:]], pc.utf8_length(p.column("text")))]
                arrays = [pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel())) for x in parts]
                yield pa.RecordBatch.from_arrays([p.column("id"), *arrays], ["id", "t", "m"])

    with Scratch(docs.sparkSession) as scratch:
        features = scratch.table(rows.mapInArrow(run, "id long, t array<float>, m array<float>"), "features")
        tagged = features.join(F.broadcast(some), "id", "left").withColumn("held", F.pmod(F.xxhash64("id", F.lit("held")), F.lit(3)) == 0)
        tagged = tagged.select("y", F.coalesce("held", F.lit(False)).alias("held"), *(array_to_vector(v).alias(v) for v in "tm"))
        model = co_train(tagged)
        if model["views"]:
            seen = tagged.where("held AND y IS NOT NULL").select("y", *(vector_to_array(v).alias(v) for v in "tm")).collect()
            log_odds = sum(_logit(np.array([r[v] for r in seen]), w) * a + b for v, (w, (a, b)) in model["views"].items())
            model["auc"] = auc(np.array([r.y for r in seen]), log_odds)
    return model


def score(docs: DataFrame, model: dict, meta: list[str], threshold: float = 0.5) -> DataFrame:
    """docs with p_text, p_meta, score and keep (score >= threshold), which replace columns of those names: one pass, no shuffle.

    score combines the calibrated log-odds of the views, taken as independent: their sum less the prior's. Null and empty texts are
    scored as texts without words; repeated rows get equal scores.
    """
    results = ("p_text", "p_meta", "score")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (*results, "keep")]
    if not model["views"]:
        return docs.select(*kept, *(F.lit(float(model["prior"])).alias(c) for c in results), F.lit(model["prior"] >= threshold).alias("keep"))
    base = math.log(model["prior"] / (1 - model["prior"]))
    views = model["views"]

    @F.arrow_udf(", ".join(f"{c} double" for c in results))
    def judged(text: pa.Array, *others: pa.Array) -> pa.Array:
        keep("quality_classifier")
        out = []
        for lo in range(0, len(text), 1000):
            t = text.slice(lo, 1000)
            parts = {"t": text_features(t), "m": meta_features([o.slice(lo, 1000) for o in others], pc.utf8_length(t))}
            z = {v: _logit(parts[v], w) * a + b for v, (w, (a, b)) in views.items()}
            out.append(np.stack([_sigmoid(z["t"]), _sigmoid(z["m"]), _sigmoid(z["t"] + z["m"] - base)]))
        return pa.StructArray.from_arrays([pa.array(x) for x in np.concatenate([*out, np.zeros((3, 0))], 1)], results)

    (found,) = free(docs.columns, "judged")
    told = docs.withColumn(found, judged(*_views(docs, meta)))
    return told.select(*kept, *(F.col(f"{found}.{c}").alias(c) for c in results), (F.col(f"{found}.score") >= threshold).alias("keep"))


#: Columns of documents that the metadata view reads, beside the size of the text.
COLUMNS = ["lang", "source"]


def judge(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), COLUMNS), COLUMNS)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the classifier keeps. Columns of any names pass through."""
    have = [c for c in COLUMNS if c in docs.columns]
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), COLUMNS)
    rows = docs.select("text", *have, F.struct(*docs.columns).alias("row"))
    return score(rows, model, COLUMNS).where("keep").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *COLUMNS)
    return judge(spark, docs, sf_dir).select("doc_id", "p_text", "p_meta", "score", "keep")
