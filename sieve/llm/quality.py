"""Quality classifier: document evidence combined with host and path posteriors.

1. A classifier of document evidence is trained on a bounded sample of labelled
   documents (``max_train``, the ids with the least hashes).  Good means quality 1
   and not toxic.  Features are shares of character classes, word statistics, and
   the summed weights of a lexicon of words that mark bad documents; a ridge
   logistic regression turns them into ``p``, the chance that a document is good.
2. ``p`` of every document is summed per path and host.  The spread between hosts
   (and between paths of a host) against the spread within them gives, by the
   method of moments, how many documents the prior is worth (empirical Bayes):
   sparse hosts shrink to the global rate, sparse paths to their host.
3. A document's posterior starts from its path's rate without the document itself
   and adds its own evidence as log odds.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import fresh, lookup, quoted, texts_of, word_table

MAX_TRAIN = 20_000
LEXICON = 4_096
THRESHOLD = 0.5
EDGE = 1e-4
WORDS = word_table()
#: character classes by bytes, in order; the rest is "other"
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\t\n\x0b\x0c\r",
           bytes(range(128, 256)), b"!", b"|", b"#$%&*", b"<>{}[]=\\/_@^~+`", b".,;:?'\"()-")


def class_matrix() -> np.ndarray:
    m = np.zeros((256, len(CLASSES) + 1))
    m[:, -1] = 1
    for k, chars in enumerate(CLASSES):
        m[list(chars), -1], m[list(chars), k] = 0, 1
    return m


def features(text: bytes, lexicon: dict[bytes, float], matrix: np.ndarray) -> list[float]:
    """Feature row of a text with at least one word."""
    words = text.translate(WORDS).split()
    own = set(words)
    marks = [lexicon[w] for w in own & lexicon.keys()]
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ matrix / len(text)
    return [*shares, math.log1p(len(words)), len(own) / len(words), sum(map(len, words)) / len(words),
            min(sum(marks), 20.0), math.log1p(len(marks)), float(bool(marks)), sum(marks) / len(own), math.sqrt(sum(marks) / len(own))]


@dataclass
class Evidence:
    """A trained document classifier: plain numbers, shipped with the job."""

    lexicon: dict[bytes, float]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the first is the intercept
    prior: float         # share of good documents among those trained on

    def column(self, text: Column) -> Column:
        """Chance that a text is good; :data:`EDGE` for one without words."""
        model, matrix = self, class_matrix()

        def run(texts: pd.Series) -> pd.Series:
            rows, at, out = [], [], np.full(len(texts), EDGE)
            for k, t in enumerate(texts):
                data = (t or "").encode()
                if data.translate(WORDS).strip():
                    rows.append(features(data, model.lexicon, matrix))
                    at.append(k)
            if rows:
                x = (np.array(rows) - model.mean) / model.scale
                z = np.clip(x @ model.weights[1:] + model.weights[0], -30, 30)
                out[at] = np.clip(1 / (1 + np.exp(-z)), EDGE, 1 - EDGE)
            return pd.Series(out)

        return F.pandas_udf(run, "double")(text)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept is not shrunk."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, keep = np.zeros(x.shape[1]), np.r_[0.0, np.full(x.shape[1] - 1, ridge)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep + 1e-6), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> Evidence:
    """Train on at most ``max_train`` labelled documents.

    ``labels`` has ``doc_id, quality, toxic``; rows with a null id or quality are
    left out, a null ``toxic`` counts as 0, and of several labels of an id the
    worst holds.  With no label, or only one class, the evidence is neutral: every
    text with a word gets the same chance, the share of good ones (1 if none)."""
    sample = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id") \
        .agg(F.min(F.when((F.col("quality") > 0) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    sample = sample.select(F.col("doc_id").alias("_label_id"), F.col("good").cast("int").alias("_good"))
    texts = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("text")).where("text IS NOT NULL")
    joined = texts.join(F.broadcast(sample), F.col("_id") == F.col("_label_id")).select("text", F.col("_good").alias("good"))
    labelled, seen = materialize(joined, "labelled", {"n": F.count(F.lit(1)), "good": F.sum("good")})
    n, good = seen["n"] or 0, seen["good"] or 0
    width = len(CLASSES) + 9
    if good in (0, n):
        prior = good / n if n else 1 - EDGE
        prior = min(max(prior, EDGE), 1 - EDGE)
        return Evidence({}, np.zeros(width), np.ones(width), np.r_[math.log(prior / (1 - prior)), np.zeros(width)], prior)
    lexicon = _lexicon(labelled, n, n - good)
    x, y = _matrix(labelled, lexicon)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    return Evidence(lexicon, mean, scale, logistic((x - mean) / scale, y), y.mean())


def _lexicon(labelled: DataFrame, n: int, bad: int) -> dict[bytes, float]:
    """Words that significantly more bad than good texts hold, and the log of the
    ratio of their rates.  Equal texts count once."""

    def run(batches):
        for batch in batches:
            good, both = Counter(), Counter()
            for text, g in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                own = set(text.translate(WORDS).split())
                both.update(own)
                if g:
                    good.update(own)
            yield pa.RecordBatch.from_arrays([pa.array(list(both), pa.binary()), pa.array([both[w] - good[w] for w in both], pa.int64()),
                                              pa.array(list(both.values()), pa.int64())], ["word", "bad", "n"])

    once = labelled.groupBy(F.sha2("text", 256).alias("h")).agg(F.first("text").alias("text"), F.min("good").alias("good"))
    counted = once.select("text", "good").mapInArrow(run, "word binary, bad long, n long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    share = bad / n
    z = (F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)))
    marks = counted.where(F.col("bad") >= 8).withColumn("z", z).where("z >= 5").orderBy(F.desc("z"), "word").limit(LEXICON).collect()
    weight = lambda r: math.log((r["bad"] + 0.5) / (bad + 1) / ((r["n"] - r["bad"] + 0.5) / (n - bad + 1)))
    return {bytes(r["word"]): weight(r) for r in marks}


def _matrix(labelled: DataFrame, lexicon: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of the bounded sample."""
    matrix = class_matrix()

    def run(batches):
        for batch in batches:
            rows = [(features(t, lexicon, matrix), g) for t, g in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()) if t.translate(WORDS).strip()]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.list_(pa.float64())), pa.array([g for _, g in rows], pa.int32())], ["x", "good"])

    rows = labelled.mapInArrow(run, "x array<double>, good int").collect()
    return np.array([r["x"] for r in rows]), np.array([r["good"] for r in rows], float)


def site_columns(source: Column, lang: Column) -> tuple[Column, Column]:
    """Host and path of a document: of a URL its host and first path segment,
    of any other source the source itself and, as its path, the language."""
    url = source.contains("://")
    host = F.lower(F.regexp_extract(source, r"://([^/?#]*)", 1))
    segment = F.regexp_extract(source, r"://[^/?#]*/([^/?#]*)", 1)
    return F.when(url, host).otherwise(source), F.when(url, segment).otherwise(lang)


def strength(sites: DataFrame, parent_rate: Column) -> Column:
    """Documents that a prior is worth: variance within sites over variance
    between them (method of moments), as one aggregate over sites with columns
    ``n, s, q`` (documents, sum and sum of squares of p)."""
    total, groups = F.sum("n"), F.count(F.lit(1))
    within = F.greatest(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.greatest(total - groups, F.lit(1)), F.lit(1e-9))
    spread = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - parent_rate, 2)) - (groups - 1) * within
    between = spread / F.greatest(total - F.sum(F.col("n") * F.col("n")) / total, F.lit(1))
    return F.least(F.greatest(within / F.greatest(between, F.lit(1e-9)), F.lit(1.0)), F.lit(1e6))


def site_table(scored: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Per ``host, path`` the sums of path and host, and the numbers
    ``rate, k_host, k_path``.  ``scored`` has ``host, path, p``."""
    paths = materialize(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "paths")
    hosts = materialize(paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in "nsq"]), "hosts")
    rate, n = hosts.agg(F.sum("s") / F.sum("n"), F.sum("n")).head()
    if not n:
        return paths.select("host", "path", F.col("n").alias("n_path"), F.col("s").alias("s_path"), F.col("n").alias("n_host"), F.col("s").alias("s_host")), \
            {"rate": 0.5, "k_host": 1.0, "k_path": 1.0}
    wide = paths.withColumnRenamed("host", "_h").join(hosts.select("host", F.col("n").alias("n_host"), F.col("s").alias("s_host")), F.col("_h").eqNullSafe(F.col("host"))).drop("_h")
    k_host = hosts.agg(strength(hosts, F.lit(rate))).head()[0]
    k_path = wide.agg(strength(wide, F.col("s_host") / F.col("n_host"))).head()[0]
    return wide.select("host", "path", F.col("n").alias("n_path"), F.col("s").alias("s_path"), "n_host", "s_host"), \
        {"rate": rate, "k_host": k_host, "k_path": k_path}


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def with_posterior(scored: DataFrame, prior: float, spread: Column, host: str, path: str, p: str, out: dict[str, str]) -> DataFrame:
    """``scored`` with the columns named in ``out`` (``host_rate``, ``path_rate``,
    ``posterior``), from its columns ``host``, ``path`` and ``p``."""
    sites, k = site_table(scored.select(F.col(host).alias("host"), F.col(path).alias("path"), F.col(p).alias("p")))
    names = {c: fresh(scored, "site_" + c) for c in ("n_path", "s_path", "n_host", "s_host")}
    sites = sites.select(F.col("host").alias(host), F.col("path").alias(path), *[F.col(c).alias(v) for c, v in names.items()])
    met = lookup(scored, sites, [host, path], spread)
    n_path, s_path, n_host, s_host = (F.col(v) for v in names.values())
    inside = lambda c: F.least(F.greatest(c, F.lit(EDGE)), F.lit(1 - EDGE))
    of_host = inside((s_host - F.col(p) + k["k_host"] * k["rate"]) / (n_host - 1 + k["k_host"]))
    of_path = inside((s_path - F.col(p) + k["k_path"] * of_host) / (n_path - 1 + k["k_path"]))
    z = logit(of_path) + logit(F.col(p)) - math.log(prior / (1 - prior))
    return met.withColumns({out["host_rate"]: of_host, out["path_rate"]: of_path, out["posterior"]: 1 / (1 + F.exp(-z))}).drop(*names.values())


def classify(docs: DataFrame, model: Evidence, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             lang_col: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: ``id_col, evidence, host_rate, path_rate, posterior, keep``.

    Texts are scored once; ids, sites and chances go on.  Rows with a null source
    or language share a site of their own.  A null text, or one without words, has
    the least evidence and is not kept unless its site outweighs that."""
    host, path = site_columns(quoted(source_col), quoted(lang_col))
    scored = materialize(docs.select(quoted(id_col).alias("id"), host.alias("host"), path.alias("path"), model.column(quoted(text_col)).alias("p")), "evidence")
    out = with_posterior(scored, model.prior, F.xxhash64("id"), "host", "path", "p", {c: c for c in ("host_rate", "path_rate", "posterior")})
    return out.select(F.col("id").alias(id_col), F.col("p").alias("evidence"), "host_rate", "path_rate", "posterior", (F.col("posterior") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, model: Evidence, text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
              threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, with all their columns.

    The texts are scored twice, once for the site sums and once to decide, which
    costs less than writing and shuffling them."""
    host, path = site_columns(quoted(source_col), quoted(lang_col))
    names = {}
    for stem in ("host", "path", "p", "host_rate", "path_rate", "posterior"):
        names[stem] = fresh(docs, stem)
    scored = docs.withColumns({names["host"]: host, names["path"]: path, names["p"]: model.column(quoted(text_col))})
    met = with_posterior(scored, model.prior, F.xxhash64(quoted(text_col)), names["host"], names["path"], names["p"],
                         {c: names[c] for c in ("host_rate", "path_rate", "posterior")})
    return met.where(F.col(names["posterior"]) >= threshold).drop(*names.values())
