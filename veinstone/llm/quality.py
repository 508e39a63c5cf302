"""Quality scores by positive-unlabelled learning with the non-negative risk.

Features of whole texts are column expressions; the learner is a small network in numpy, fitted on
a bounded sample of feature rows and then written out as a column expression again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinstone.llm.langid import held_out
from veinstone.llm.samples import sampled

SYMBOLS = "#$%&*|~^<>{}[]@=_+\\/"
FEATURES = ("symbols", "bangs", "bars", "upper", "digits", "stops", "commas", "breaks", "word_length", "size", "distinct", "repeats", "lines", "ends", "letters")


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id, row (a struct of all columns), text's features as columns f_*; a null text counts as empty, whose features
    are all 0 or 1."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.struct(*[docs[c] for c in docs.columns]).alias("row"), text.alias("t"), F.greatest(F.length(text), F.lit(1)).alias("n"))
    d = d.withColumn("words", F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    d = d.withColumn("rows", F.split("t", r"\n")).withColumn("m", F.greatest(F.size("words"), F.lit(1)))
    count = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    kept = lambda pattern: F.length("t") - F.length(F.regexp_replace("t", pattern, ""))
    pairs = F.zip_with("words", F.expr("slice(words, 2, size(words))"), lambda a, b: F.when(a == b, 1).otherwise(0))
    cols = {
        "symbols": count(SYMBOLS) / F.col("n"),
        "bangs": count("!?") / F.col("n"),
        "bars": count("|") / F.col("m"),
        "upper": kept(r"\p{Lu}+") / F.col("n"),
        "digits": count("0123456789") / F.col("n"),
        "stops": count(".") / F.col("m"),
        "commas": count(",") / F.col("m"),
        "breaks": count("\n") / F.col("m"),
        "word_length": F.log1p((F.length("t") - F.size("words")) / F.col("m")),
        "size": F.log1p(F.size("words")),
        "distinct": F.size(F.array_distinct("words")) / F.col("m"),
        "repeats": F.aggregate(pairs, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) / F.col("m"),
        "lines": F.size(F.array_distinct("rows")) / F.size("rows"),
        "ends": F.size(F.filter("words", lambda w: w.rlike(r"[#$%&*!|]{1,3}$"))) / F.col("m"),
        "letters": kept(r"\p{L}+") / F.col("n"),
    }
    return d.select("doc_id", "row", *[F.coalesce(cols[n].cast("double"), F.lit(0.0)).alias(f"f_{n}") for n in FEATURES])


class Scorer:
    """One hidden layer of tanh units over standardised features, a sigmoid on top."""

    def __init__(self, mean, scale, w1, b1, w2, b2, prior: float):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.prior = mean, scale, w1, b1, w2, b2, prior

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(np.tanh(self.inputs(x) @ self.w1 + self.b1) @ self.w2 + self.b2)))

    def column(self) -> Column:
        """The same, over columns f_*."""
        z = [F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (F.col(f"f_{n}") - float(m)) / float(s))) for n, m, s in zip(FEATURES, self.mean, self.scale)]
        hidden = [F.tanh(sum((zi * float(w) for zi, w in zip(z, self.w1[:, j])), F.lit(float(self.b1[j])))) for j in range(len(self.b1))]
        return 1 / (1 + F.exp(-sum((h * float(w) for h, w in zip(hidden, self.w2)), F.lit(float(self.b2)))))


def train(pos: np.ndarray, unl: np.ndarray, prior: float, hidden: int = 8, steps: int = 1500, batch: int = 512, rate: float = 0.01, seed: int = 3) -> Scorer:
    """Minimises prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)) for the logistic loss.

    Where the bracket of a batch falls below 0 the step goes the other way on it, so that the estimate
    of the risk on negatives can't be driven below nothing by overfitting.
    """
    rng = np.random.default_rng(seed)
    both = np.concatenate([pos, unl])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    net = Scorer(mean, scale, rng.standard_normal((pos.shape[1], hidden)) * 0.3, np.zeros(hidden), rng.standard_normal(hidden) * 0.3, 0.0, prior)
    p, u = net.inputs(pos), net.inputs(unl)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, s = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    sig = lambda x: 1 / (1 + np.exp(-x))
    for i in range(1, steps + 1):
        a, b = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]
        x = np.concatenate([a, b])
        h = np.tanh(x @ params[0] + params[1])
        f = h @ params[2] + params[3][0]
        fp, fu = f[:batch], f[batch:]
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        dp, du = -prior * sig(-fp) / batch, np.zeros(batch)
        way = 1.0 if negative >= 0 else -1.0
        if way < 0:
            dp = np.zeros(batch)
        dp = dp - way * prior * sig(fp) / batch
        du = du + way * sig(fu) / batch
        d = np.concatenate([dp, du])
        dh = d[:, None] * params[2] * (1 - h * h)
        grads = [x.T @ dh + 1e-4 * params[0], dh.sum(0), h.T @ d + 1e-4 * params[2], np.array([d.sum()])]
        lr = rate * (1 - i / (steps + 1)) ** 0.5
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            params[k] = params[k] - lr * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.999**i)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    return net


def class_prior(pos: np.ndarray, unl: np.ndarray, least: float = 0.05) -> float:
    """The share of positives among the unlabelled, from scores of held-out positives and unlabelled rows.

    Best-bin estimate: above any score, the unlabelled hold at least the prior times what the positives hold, so the smallest
    ratio over scores bounds the prior from above; both shares widened by how far they may be off by chance. Scores
    above which fewer than `least` of the positives lie are not asked.
    """
    cuts = np.quantile(pos, np.linspace(0, 1 - least, 200))
    p, u = ((x[:, None] >= cuts[None, :]).mean(0) for x in (pos, unl))
    off = lambda x: np.sqrt(np.log(40) / (2 * len(x)))
    ratio = u / p
    best = int(np.argmin(ratio + ((1 + off(pos)) * off(unl) + off(pos)) / p))
    return float(np.clip(ratio[best], 0.01, 0.99))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 15_000) -> Scorer | None:
    """Learns from docs(doc_id, text) and labels(doc_id, quality), of rows not held out.

    Trusted positives are documents labelled 1, the unlabelled are all without a label; of either at
    most max_rows, sampled by hash of doc_id: a doc_id counts once, with the least hash of its texts, and rows without one are not
    learned from. Labels of 0 are not used. The class prior is estimated from the scores that networks learned on either half of the
    sample give the other half. None if there are no positives, or nothing is unlabelled.
    """
    told = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = docs.select("doc_id").where(~held_out(F.col("doc_id"))).join(told, "doc_id", "left")
    ids = ids.where("quality = 1 or quality is null").select("doc_id", F.coalesce("quality", F.lit(0)).alias("good"))
    few = sampled(ids, max_rows, ["doc_id"], F.col("good"), seed=23)
    # at most twice max_rows ids
    mine = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    x = with_features(mine.withColumn("place", F.xxhash64("text"))).select("doc_id", "row.good", "row.place", *[f"f_{f}" for f in FEATURES])
    x = x.groupBy("doc_id").agg(F.min(F.struct("place", "good", *[f"f_{f}" for f in FEATURES])).alias("m")).select("doc_id", "m.*")
    rows = x.toPandas().sort_values("doc_id", kind="stable")
    features, good = rows[[f"f_{f}" for f in FEATURES]].to_numpy(float), (rows["good"] == 1).to_numpy()
    if not good.any() or good.all():
        return None
    pos, unl = features[good], features[~good]
    if min(len(pos), len(unl)) < 20:
        prior = 0.5
    else:
        # each half is scored by the network of the other
        nets = [train(pos[k::2], unl[k::2], 0.5, steps=800) for k in (0, 1)]
        prior = class_prior(*(np.concatenate([nets[1](x[::2]), nets[0](x[1::2])]) for x in (pos, unl)))
    return train(pos, unl, prior)


def scored(docs: DataFrame, scorer: Scorer | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text); other columns are ignored.

    A null text is scored as an empty one. Without a scorer every score is 0.5. Repeated rows each
    give a row. Nothing is shuffled.
    """
    score = F.lit(0.5) if scorer is None else scorer.column()
    out = with_features(docs).select(F.col("doc_id").cast("long").alias("doc_id"), score.alias("score"))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, scorer: Scorer | None, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that score at least threshold; all without a scorer. Nothing is shuffled."""
    if scorer is None:
        return docs
    return with_features(docs).where(scorer.column() >= threshold).select("row.*")
