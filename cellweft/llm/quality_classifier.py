"""Quality classifier by hierarchical empirical Bayes: document evidence with host and path posteriors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweft.llm.common import WORD, pick
from cellweft.runtime import materialize

#: Labelled rows that the document classifier is fitted on, at most: those with the smallest hashes of their ids.
FIT_ROWS = 20_000
#: Bounds of a group's prior strength, in documents.
STRENGTH = (2.0, 500.0)


def features(text: Column) -> dict[str, Column]:
    """What the document classifier sees: lengths and shares of characters, by built-in functions."""
    chars = F.length(text)
    count = lambda pattern: chars - F.length(F.regexp_replace(text, pattern, ""))
    words, visible = F.regexp_count(text, F.lit(WORD)), F.greatest(chars, F.lit(1))
    lines = F.split(text, "\n")
    return {
        "log_words": F.log1p(words.cast("double")),
        "chars_a_word": F.least(chars / F.greatest(words, F.lit(1)), F.lit(30.0)),
        "symbol_share": count(r"[#*$%&|<>]+") / visible,
        "mark_share": count("[!?]+") / visible,
        "upper_share": count("[A-Z]+") / visible,
        "digit_share": count("[0-9]+") / visible,
        "stop_share": count("[.,]+") / visible,
        "same_line_share": 1 - F.size(F.array_distinct(lines)) / F.size(lines),
        "distinct_share": F.size(F.array_distinct(F.split(F.lower(text), " "))) / F.size(F.split(text, " ")),
    }


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights, the last one the bias, of a ridge logistic regression, by Newton's method; x is not standardised yet."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([(x - mean) / scale, ((x - mean) / scale) ** 2, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        penalty = np.full(len(w), ridge * len(x) / 100)
        penalty[-1] = 1e-9
        grad = z.T @ (p - y) + penalty * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate([w, mean, scale])


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, prior: float) -> float:
    """Prior strength by the method of moments: few documents suffice where groups' rates differ more than chance makes them."""
    r = groups.agg(F.sum("n").alias("n"), F.count("*").alias("g"), F.sum(F.col("n") * (F.col("s") / F.col("n") - prior) ** 2).alias("v"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not r["n"] or r["g"] < 2:
        return STRENGTH[1]
    chance = prior * (1 - prior)
    spread = (r["v"] - (r["g"] - 1) * chance) / max(r["n"] - r["nn"] / r["n"], 1e-9)
    return float(np.clip(chance / max(spread, 1e-9) - 1, *STRENGTH))


def classify_quality(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row for each row of ``docs``: id, doc_score, host_rate, path_rate, score, kept (score >= 0.5).

    ``host`` and ``path`` are columns of ``docs`` (by default its source, and its language within the source, for corpora
    without addresses). A logistic regression on ``features``, fitted by the driver on at most ``fit_rows`` labelled documents, gives each document's evidence.
    Sums over all documents of their labels, or of these scores where there is none, per host and per path within the host, give posterior rates: a path's rate is shrunk towards its host's,
    and a host's towards that of all, by prior strengths that the method of moments takes from the groups' own spread. A document's own
    part is taken out of its groups' sums, so its label does not reach its own score by them. Its score adds, in log-odds, what its path's rate has above that of all.

    Groups are summed in partial aggregates before the shuffle, so a hot host costs no more than others; texts are read once and do not
    cross a shuffle. Joins with the groups can be split.

    Null text is empty text. Null hosts and paths are groups. Labels of null, or with null ids, are unused; of repeated labels the largest counts. With
    labels of one class only, or none, doc_score is the smoothed rate of the labels. Null ids and repeated rows are passed through.
    Extra columns are ignored. An empty table gives an empty result.
    """
    own = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"), (docs["source"] if host is None else host).alias("host"), (docs["lang"] if path is None else path).alias("path"))
    named = features(F.col("text"))
    rows = materialize(own.select("id", "host", "path", *[c.cast("double").alias(k) for k, c in named.items()]), "quality-features")
    known = pick(labels, of=id_col, label=label_col).dropna().groupBy("of").agg(F.max("label").cast("double").alias("label"))
    sample = rows.join(known, rows["id"] == known["of"]).select("id", "label", *named).orderBy(F.xxhash64("id"), *named).limit(fit_rows).toPandas()
    y, x = sample["label"].to_numpy(float), sample[list(named)].to_numpy(float)
    if len(y) and 0 < y.mean() < 1:
        w = fit(x, y)
        k = len(named)
        terms = [w[2 * k].item() + F.lit(0.0)]
        for i, name in enumerate(named):
            z = (F.col(name) - w[2 * k + 1 + i].item()) / w[3 * k + 1 + i].item()
            terms.append(z * w[i].item() + z * z * w[k + i].item())
        logit = sum(terms[1:], terms[0])
    else:
        rate = (y.sum() + 1) / (len(y) + 2)
        logit = F.lit(float(np.log(rate / (1 - rate))))
    rows = rows.select("id", "host", "path", (1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-12.0)), F.lit(12.0))))).alias("doc_score"))
    rows = rows.join(known, rows["id"] == known["of"], "left").withColumn("seen", F.coalesce("label", "doc_score")).drop("of", "label")
    rows = materialize(rows, "quality-scores")
    paths = materialize(rows.groupBy("host", "path").agg(F.sum("seen").alias("s"), F.count("*").alias("n")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    of_all = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    prior = ((of_all["s"] or 0.0) + 1) / ((of_all["n"] or 0) + 2)
    by_host, by_path = _strength(hosts, prior), _strength(paths, prior)
    groups = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host")))
    groups = groups.select(F.col("p.host").alias("h_"), F.col("p.path").alias("p_"), F.col("p.s").alias("ps"), F.col("p.n").alias("pn"), F.col("h.s").alias("hs"), F.col("h.n").alias("hn"))
    groups = materialize(groups, "quality-groups")
    out = rows.join(groups, rows["host"].eqNullSafe(groups["h_"]) & rows["path"].eqNullSafe(groups["p_"]), "left")
    host_rate = (F.col("hs") - F.col("seen") + by_host * prior) / (F.col("hn") - 1 + by_host)
    out = out.withColumn("host_rate", host_rate)
    out = out.withColumn("path_rate", (F.col("ps") - F.col("seen") + by_path * F.col("host_rate")) / (F.col("pn") - 1 + by_path))
    total = _logit(F.col("doc_score")) + _logit(F.col("path_rate")) - F.lit(float(np.log(prior / (1 - prior))))
    out = out.withColumn("score", 1 / (1 + F.exp(-total)))
    return out.select(F.col("id").alias(id_col), "doc_score", "host_rate", "path_rate", "score", (F.col("score") >= 0.5).alias("kept"))
