"""Document quality by hierarchical empirical Bayes.

A logistic classifier on measures of the text gives a document's own evidence.  Hosts and the paths below
them have rates of good documents, from labels and, at a lower weight, from the classifier's probabilities of
the unlabelled.  A host's posterior shrinks towards the global rate, a path's towards its host's, the more
the fewer documents it has; how strongly comes from the spread of the rates round these priors.  The log odds
of both add up, less the global log odds, which both hold.  A document's own label or evidence is left out of
the rates that score it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import in_slices
from .common import stored

#: At most about so many labelled rows, chosen by the hash of their id, fit the classifier.
SAMPLE = 20_000
#: Weight of an unlabelled document, against 1 for a labelled one; ridge of the fit.
UNLABELLED, RIDGE = 0.1, 1.0
#: Documents that a prior counts as where no group tells, and the limits of what groups tell.
UNKNOWN_SPREAD, STRENGTHS = 100.0, (2.0, 10_000.0)
MEASURES = 10
_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 end of sentence, 6 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 10, 13, 32]], _CLASS[[33, 44, 46, 63]], _CLASS[128:] = 1, 2, 3, 4, 5, 6


def measures(text: str | None) -> list[float]:
    """Shares of kinds of characters, lengths, and shares of repeated lines and words of a whole text."""
    if not text:
        return [0.0] * MEASURES
    data = np.frombuffer(text.encode(), np.uint8)
    share = np.bincount(_CLASS[data], minlength=7) / len(data)
    lines, words = text.split("\n"), text.split()
    n = max(1, len(words))
    return [*share.tolist()[:4], share[5], np.log1p(len(data)), min(30.0, len(data) / n), 1 - len(set(lines)) / len(lines), len(set(words)) / n**0.75, words[0][:1].isupper() * 1.0 if words else 0.0]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace ``text`` by ``x``, its measures."""
    kept = [c for c in docs.columns if c not in (text, "x")]

    def run(batches):
        for batch in batches:
            for a, b, texts in in_slices(batch.column(len(kept))):
                x = pa.array([measures(t) for t in texts], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[:-1], x], names=[*kept, "x"])

    return docs.select(*kept, text).mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept)]).add("x", T.ArrayType(T.DoubleType())))


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # the last is the constant

    def logit(self, x: Column) -> Column:
        w = self.weight[:-1] / self.scale
        out = F.lit(float(self.weight[-1] - (w * self.mean).sum()))
        for i, v in enumerate(w.tolist()):
            out = out + F.get(x, F.lit(i)) * v
        return F.least(F.greatest(out, F.lit(-12.0)), F.lit(12.0))


def fit(x: np.ndarray, y: np.ndarray) -> Classifier:
    """Ridge logistic regression by Newton steps; without rows, no evidence either way."""
    if not len(y):
        return Classifier(np.zeros(MEASURES), np.ones(MEASURES), np.zeros(MEASURES + 1))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    ridge = np.diag([RIDGE] * (len(w) - 1) + [1e-3])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -12, 12)))
        w -= np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge, z.T @ (p - y) + ridge @ w)
    return Classifier(mean, scale, w)


def _strength(rates: DataFrame) -> float:
    """Documents that a prior counts as, from groups (n, k) round their priors, by the method of moments.

    Groups of up to one document say nothing about the spread; where there are no others it is ``UNKNOWN_SPREAD``.
    """
    p, n = F.col("prior"), F.col("n")
    found = rates.where("n > 1").agg(F.sum(n), F.sum(n * n), F.sum((F.col("k") - p * n) ** 2), F.sum(n * p * (1 - p)), F.count("*")).first()
    total, squares, deviation, binomial, groups = (float(v or 0) for v in found)
    if groups < 2 or binomial <= 0:
        return UNKNOWN_SPREAD
    spread = (deviation - binomial) / (squares - total)  # variance of the groups' own rates round their priors
    return float(np.clip(binomial / total / spread - 1, *STRENGTHS)) if spread > 0 else STRENGTHS[1]


def score(docs: DataFrame, labels: DataFrame, host: str, path: str, keep: float = 0.5) -> DataFrame:
    """(doc_id, evidence, host_rate, path_rate, score, keep) of documents.

    Labels are (doc_id, quality 0 or 1); null or absent ones count as unlabelled, of repeated ones the largest
    counts.  ``score`` is the probability of quality 1, and a row is kept from ``keep`` on.  Null hosts and
    paths are groups of their own.  Null and empty texts have measures of 0.  Repeated rows get equal scores.
    """
    of = labels.select("doc_id", F.col("quality").cast("double").alias("quality")).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), "text")
    rows = stored(measured(rows).join(of, "doc_id", "left"), "measures")
    labelled = rows.where("quality is not null")
    share = min(1.0, SAMPLE / max(1, labelled.count()))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000).select("x", "quality").toPandas()
    classifier = fit(np.array(sample.x.tolist()).reshape(-1, MEASURES), sample.quality.to_numpy(float))
    rows = rows.withColumn("evidence", classifier.logit(F.col("x"))).drop("x")

    soft = 1 / (1 + F.exp(-F.col("evidence")))
    n, k = F.when(F.col("quality").isNull(), UNLABELLED).otherwise(1.0), F.when(F.col("quality").isNull(), soft * UNLABELLED).otherwise(F.col("quality"))
    rows = rows.withColumns({"own_n": n, "own_k": k})
    paths = stored(rows.groupBy("host", "path").agg(F.sum("own_n").alias("n"), F.sum("own_k").alias("k")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = paths.agg(F.sum("n"), F.sum("k")).first()
    mean = float(np.clip((total[1] or 0.0) / total[0], 1e-3, 1 - 1e-3)) if total[0] else 0.5
    rate = lambda n, k, prior, s: (k + prior * s) / (n + s)
    of_host = hosts.withColumn("prior", F.lit(mean))
    by_host = _strength(of_host)
    # a path's spread is that round its host's posterior
    of_path = paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("k").alias("host_k")), "host").withColumn("prior", rate(F.col("host_n"), F.col("host_k"), F.lit(mean), by_host))
    by_path = _strength(of_path)

    # a document is no evidence for itself
    each = rows.join(of_path.drop("prior"), ["host", "path"])
    others = lambda x: F.greatest(F.col(x) - F.col(f"own_{x[-1]}"), F.lit(0.0))
    each = each.withColumn("host_rate", rate(others("host_n"), others("host_k"), F.lit(mean), by_host))
    each = each.withColumn("path_rate", rate(others("n"), others("k"), F.col("host_rate"), by_path))
    odds = F.col("evidence") + F.log(F.col("path_rate") / (1 - F.col("path_rate"))) - float(np.log(mean / (1 - mean)))
    return each.withColumn("score", 1 / (1 + F.exp(-odds))).select("doc_id", "evidence", "host_rate", "path_rate", "score", (F.col("score") >= keep).alias("keep"))


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without port; null of a null."""
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1))


def path_of(url: Column) -> Column:
    """The first step of a URL's path, without query and fragment."""
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)
