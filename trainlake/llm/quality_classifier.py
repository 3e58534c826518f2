"""Document quality by hierarchical empirical Bayes: a text classifier's evidence for each document, combined with host and
path posteriors that shrink sparse sites toward the global rate."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_batches, materialize

#: Bytes dropped before words are taken for the lexicon.
PUNCTUATION = b".,;:!?\"'()[]{}|#$%&*<>"
#: Bytes of word beginnings that the lexicon knows beside whole words.
BEGINNINGS = (4, 6, 8)
FEATURES = ("log_words", "symbols", "upper", "pipes", "dup_lines", "repetition", "word_length", "digits", "marks") + tuple(f"{kind}_{x}" for kind in ("toxic", "bad") for x in ("count", "weight", "top", "density"))
SCALE = 1_000_000
SITE = ("host", "path", "n", "s", "host_n", "host_s", "global_rate", "host_weight", "path_weight")


@dataclass(frozen=True)
class Model:
    """Two logistic heads over FEATURES, and the learned word weights."""

    mean: np.ndarray
    std: np.ndarray
    quality: np.ndarray
    toxic: np.ndarray
    toxic_words: dict
    bad_words: dict


def doc_tokens(raw: bytes) -> set[bytes]:
    """The distinct words of a text in lower case, and their beginnings marked with ^."""
    words = set(raw.translate(None, PUNCTUATION).lower().split())
    return words.union(*[[w[:n] + b"^" for w in words if len(w) > n] for n in BEGINNINGS])


def _lexicon_features(tokens: set[bytes], lexicon: dict) -> list[float]:
    found = [lexicon[t] for t in tokens if t in lexicon]
    return [float(min(len(found), 8)), float(min(sum(found), 40)), float(max(found, default=0)), float(sum(found) / np.log(2 + len(tokens)))]


def features(raw: bytes, toxic_words: dict, bad_words: dict) -> list[float]:
    """FEATURES of a whole text as UTF-8 bytes; an empty text has zeros."""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    b = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(b, minlength=256)
    upper, lower = kinds[65:91].sum(), kinds[97:123].sum()
    pipes, symbols = kinds[124], kinds[[35, 42, 36, 37, 38, 60, 62]].sum()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    tokens = doc_tokens(raw)
    return [
        float(np.log1p(n)),
        min(symbols / n, 4.0),
        upper / max(upper + lower, 1),
        min(pipes / n, 1.0),
        1 - len(set(lines)) / len(lines),
        1 - len(set(words)) / n,
        min(len(raw) / n, 40.0) / 10,
        kinds[48:58].sum() / len(raw),
        min(kinds[33] / n, 4.0),
        *_lexicon_features(tokens, toxic_words),
        *_lexicon_features(tokens, bad_words),
    ]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Newton's method for ridge logistic regression; the first weight is the intercept and is not shrunk."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    shrink = np.r_[1e-6, np.full(a.shape[1] - 1, ridge)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(shrink), a.T @ (p - y) + shrink * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """doc_id, text, quality and toxic of at most about max_labelled labelled documents, picked by a hash of doc_id.

    Labels are thinned before the join, so the broadcast side holds max_labelled rows whatever the size of either table.
    Labels with a null doc_id or null classes are left out; a document labelled twice counts twice."""
    lab = labels.select("doc_id", "quality", "toxic").dropna()
    n = lab.count()
    share = min(1.0, max_labelled / max(n, 1))
    lab = lab.where(F.pmod(F.xxhash64("doc_id", F.lit("labelled")), F.lit(SCALE)) < int(share * SCALE))
    return docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id")


def _lexicon(sample: DataFrame, min_share: float = 0.01, min_docs: int = 5, min_lift: float = 1.5, top: int = 200) -> tuple[dict, dict]:
    """Words and beginnings far likelier in toxic (or bad) documents than in the others, with their log lift. Counts are grouped on Spark;
    at most 2 * top words reach the driver."""

    def words(batches):
        for b in batches:
            out = {"word": [], "quality": [], "toxic": []}
            for t, q, x in zip(b.column("text"), b.column("quality").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                ws = doc_tokens(t.as_buffer().to_pybytes()) if t.is_valid else ()
                out["word"] += ws
                out["quality"] += [q] * len(ws)
                out["toxic"] += [x] * len(ws)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("word", pa.binary()), ("quality", pa.int32()), ("toxic", pa.int32())]))

    total = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.coalesce(F.sum(1 - F.col("quality")), F.lit(0)).alias("b")).first()
    counts = map_batches(sample.select("text", F.col("quality").cast("int"), F.col("toxic").cast("int")), words, "word binary, quality int, toxic int").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"), F.sum(1 - F.col("quality")).alias("b"))
    out = []
    for hits, n_hit in (("t", total["t"]), ("b", total["b"])):
        lift = F.log((F.col(hits) + 0.5) / (n_hit + 1)) - F.log((F.col("n") - F.col(hits) + 0.5) / (total["n"] - n_hit + 1))
        kept = counts.where(F.col(hits) >= max(min_docs, min_share * n_hit)).withColumn("lift", lift).where(F.col("lift") >= min_lift)
        out.append({bytes(r["word"]): float(r["lift"]) for r in kept.orderBy(F.desc("lift"), "word").limit(top).select("word", "lift").collect()})
    return out[0], out[1]


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> Model:
    """Learns the lexicon and both heads from labelled_sample(); the driver sees feature rows of that sample only
    (max_labelled * len(FEATURES) numbers). Without labels every document gets an even score."""
    sample = materialize(labelled_sample(docs, labels, max_labelled), "quality-sample")
    toxic_words, bad_words = _lexicon(sample)

    def rows(batches):
        for b in batches:
            x = [features(t.as_buffer().to_pybytes() if t.is_valid else b"", toxic_words, bad_words) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("quality").cast(pa.int32()), b.column("toxic").cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["quality", "toxic", "x"])

    got = map_batches(sample, rows, "quality int, toxic int, x array<double>").toPandas()
    k = len(FEATURES)
    if not len(got):
        return Model(np.zeros(k), np.ones(k), np.zeros(k + 1), np.zeros(k + 1), {}, {})
    x = np.array(got["x"].tolist(), float)
    mean, std = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / std
    return Model(mean, std, _logistic(z, got["quality"].to_numpy(float)), _logistic(z, got["toxic"].to_numpy(float)), toxic_words, bad_words)


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """Adds quality_logit and toxic_logit, the classifier's evidence for each whole text, to every row."""
    keep = [c for c in docs.columns if c.lower() not in ("quality_logit", "toxic_logit")]
    docs = docs.select(*keep)
    at = docs.columns.index("text")

    def score(batches):
        for b in batches:
            x = np.array([features(t.as_buffer().to_pybytes() if t.is_valid else b"", model.toxic_words, model.bad_words) for t in b.column(at)]).reshape(-1, len(FEATURES))
            z = np.c_[np.ones(len(x)), np.clip((x - model.mean) / model.std, -20, 20)]
            logits = [pa.array(np.clip(z @ w, -20, 20)) for w in (model.quality, model.toxic)]
            yield pa.RecordBatch.from_arrays([*b.columns, *logits], [*b.schema.names, "quality_logit", "toxic_logit"])

    return map_batches(docs, score, T.StructType([*docs.schema.fields, T.StructField("quality_logit", T.DoubleType()), T.StructField("toxic_logit", T.DoubleType())]))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(q / (1 - q))


def _own() -> Column:
    """A row's own evidence of being good, in whole millionths, so that sums don't depend on the order of rows."""
    return F.round(_sigmoid(F.col("quality_logit")) * (1 - _sigmoid(F.col("toxic_logit"))) * SCALE).cast("long")


def _posterior(s: Column, n: Column, weight: str, prior) -> Column:
    return (s / SCALE + F.col(weight) * prior) / (n + F.col(weight))


def site_posteriors(scored: DataFrame, host: str, path: str) -> DataFrame:
    """One row a (host, path): n, s, host_n, host_s (documents and summed evidence), global_rate, the prior weights host_weight
    and path_weight, and the posteriors host_rate and path_rate of good documents.

    Host rates are beta posteriors around the global rate, path rates around their host's. The prior's weight at each level
    comes from the variance of rates around their own parent's (method of moments, less what sampling adds), so differences
    between hosts don't count as differences within them and a site with few documents stays near its parent. All counting
    is partial before it is shuffled."""
    paths = materialize(scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count(F.lit(1)).alias("n"), F.sum(_own()).alias("s")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.count(F.lit(1)).alias("host_paths"))
    total = hosts.agg((F.sum("host_s") / F.sum("host_n") / SCALE).alias("global_rate"), F.count(F.lit(1)).alias("hosts"))
    hosts = materialize(hosts.crossJoin(F.broadcast(total)), "quality-hosts")

    def weight(table: DataFrame, n: str, s: str, parent: Column, siblings: str, name: str) -> DataFrame:
        """Pseudo-count of the prior: mean variance of a document around its parent's rate / variance between siblings."""
        within = parent * (1 - parent)
        sums = table.agg(
            F.sum(F.col(n)).alias("n"),
            F.sum(F.col(n) * within).alias("within"),
            F.sum(F.col(n) * (F.col(s) / F.col(n) / SCALE - parent) ** 2).alias("around"),
            F.sum(within * (1 - 1 / F.col(siblings))).alias("noise"),
        )
        between = F.greatest((F.col("around") - F.col("noise")) / F.col("n"), F.lit(1e-9))
        return sums.select(F.greatest(F.least(F.col("within") / F.col("n") / between, F.lit(1e6)), F.lit(1.0)).alias(name))

    out = paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    top = weight(hosts, "host_n", "host_s", F.col("global_rate"), "hosts", "host_weight")
    sub = weight(out, "n", "s", F.col("host_s") / F.col("host_n") / SCALE, "host_paths", "path_weight")
    out = out.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(sub)).drop("hosts", "host_paths")
    out = out.withColumn("host_rate", _posterior(F.col("host_s"), F.col("host_n"), "host_weight", F.col("global_rate")))
    return out.withColumn("path_rate", _posterior(F.col("s"), F.col("n"), "path_weight", F.col("host_rate")))


def classify(docs: DataFrame, model: Model, host: str = "source", path: str = "lang", min_quality: float = 0.5, max_toxic: float = 0.5, keep_text: bool = True) -> DataFrame:
    """Every row of docs (without its text if keep_text is false) with p_quality, p_toxic, host_rate, path_rate and accepted.

    host and path name the columns of the site: `source` and `lang` where there is no address; functions of an url column can
    be given as columns made before. host_rate and path_rate are the posteriors without the row's own evidence, which p_quality
    adds once: logit(evidence) + logit(path rate) - logit(global rate). A row is accepted if p_quality >= min_quality and
    p_toxic < max_toxic. Null and empty texts have zero features and are scored like any; null hosts and paths are sites of
    their own; repeated rows are scored each; long texts are read whole; an empty table stays empty; input columns named like
    an output are replaced. The scored table is written once in the shared folder, since the site rates need all evidence
    before the first verdict."""
    outputs = ("p_quality", "p_toxic", "host_rate", "path_rate", "accepted")
    docs = docs.select(*[c for c in docs.columns if c.lower() not in outputs])
    scored = evidence(docs, model)
    scored = materialize(scored if keep_text else scored.drop("text"), "quality-evidence")
    names = dict(zip(SITE, fresh(scored, *SITE), strict=True))
    sites = materialize(site_posteriors(scored, host, path), "quality-sites").select(*[F.col(c).alias(names[c]) for c in SITE])
    both = scored.join(sites, scored[host].eqNullSafe(sites[names["host"]]) & scored[path].eqNullSafe(sites[names["path"]]), "left")
    x = {c: F.col(names[c]) for c in SITE}
    both = both.withColumn("host_rate", _posterior(x["host_s"] - _own(), x["host_n"] - 1, names["host_weight"], x["global_rate"]))
    both = both.withColumn("path_rate", _posterior(x["s"] - _own(), x["n"] - 1, names["path_weight"], F.col("host_rate")))
    quality = _sigmoid(F.col("quality_logit") + _logit(F.col("path_rate")) - _logit(x["global_rate"]))
    out = both.withColumn("p_quality", F.round(quality, 6)).withColumn("p_toxic", F.round(_sigmoid(F.col("toxic_logit")), 6))
    out = out.withColumn("accepted", (F.col("p_quality") >= min_quality) & (F.col("p_toxic") < max_toxic))
    return out.drop(*names.values(), "quality_logit", "toxic_logit")
