"""Statistics and simple probes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quern.functions.text import word_set

#: Rows of a probe's training vectors that a worker multiplies at once.
PROBE_ROWS = 4096


def word_counts(docs: DataFrame, *, id: str = "id", side: str = "side", text: str = "text") -> DataFrame:
    """(word, yp, yc): texts of the candidate (p) and control (c) side that have each word."""
    words = docs.select(side, F.explode(word_set(F.col(text))).alias("word"))
    return words.groupBy("word").agg(F.count_if(F.col(side) == "p").alias("yp"), F.count_if(F.col(side) == "c").alias("yc"))


def distinctive_words(counts: DataFrame, *, prior: float = 500.0, least: int = 10) -> DataFrame:
    """(word, yp, yc, z): log-odds with an informative Dirichlet prior, as a z score.

    The prior of a word is ``prior`` times its share of both sides together.
    """
    totals = counts.agg(F.sum("yp").alias("np"), F.sum("yc").alias("nc"))
    c = counts.where(F.col("yp") + F.col("yc") >= least).crossJoin(F.broadcast(totals))
    a = prior * (F.col("yp") + F.col("yc")) / (F.col("np") + F.col("nc"))
    odds = lambda y, n: F.log((y + a) / (n + prior - y - a))
    delta = odds(F.col("yp"), F.col("np")) - odds(F.col("yc"), F.col("nc"))
    return c.select("word", "yp", "yc", (delta / F.sqrt(1 / (F.col("yp") + a) + 1 / (F.col("yc") + a))).alias("z"))


def welch(stats: DataFrame, *, arm: str = "arm", value: str = "rate", a: str, b: str) -> DataFrame:
    """One row: means, t and Welch's degrees of freedom of arm a over arm b, one-sided p.

    ``plateau``: p is 0.1 or more, or b is less than 20 % below a.
    """
    on = lambda s: F.when(F.col(arm) == s, F.col(value))
    one = stats.agg(*[f(on(s)).alias(f"{n}_{k}") for s, k in ((a, "a"), (b, "b")) for f, n in ((F.avg, "mean"), (F.var_samp, "var"), (F.count, "n"))])
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(va + vb))
    df = F.try_divide((va + vb) * (va + vb), va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1))
    one = one.select("mean_a", "mean_b", "n_a", "n_b", t.alias("t"), df.alias("df"))
    out = one.withColumn("p", student_tail(F.col("t"), F.col("df")))
    fall = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.col("mean_a"))
    return out.withColumn("plateau", (F.col("p") >= 0.1) | (F.coalesce(fall, F.lit(0.0)) < 0.2))


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    f = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def t_tail(t: float, df: float) -> float:
    """P(T > t) of Student's t with df degrees of freedom."""
    half = 0.5 * beta_fraction(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


@F.pandas_udf(DoubleType())
def student_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_tail(x, d) if x == x and d == d and x is not None and d is not None else None for x, d in zip(t, df)])


def mean_difference_probe(train: DataFrame, *, label: str = "y", vector: str = "v") -> DataFrame:
    """(dim, mu, sd, d): pooled mean, population sd + 1e-6, difference of standardised class means."""
    x = train.select(label, F.posexplode(vector).alias("dim", "x"))
    g = x.groupBy("dim").agg(F.avg("x").alias("mu"), (F.stddev_pop("x") + 1e-6).alias("sd"), F.avg(F.when(F.col(label) == 1, F.col("x"))).alias("m1"), F.avg(F.when(F.col(label) == 0, F.col("x"))).alias("m0"))
    return g.select("dim", "mu", "sd", ((F.col("m1") - F.col("m0")) / F.col("sd")).alias("d"))


def probe_scores(rows: DataFrame, probe: DataFrame, *, id: str = "id", vector: str = "v") -> DataFrame:
    """``rows`` with ``score`` = standardised vector . d; the probe is one small array literal a row."""
    p = probe.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mu", "sd", "d"))), lambda s: s).alias("p"))
    both = rows.crossJoin(F.broadcast(p))
    terms = F.zip_with(vector, "p", lambda x, s: (x - s["mu"]) / s["sd"] * s["d"])
    return both.withColumn("score", F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)).drop("p")


def auc(df: DataFrame, *, label: str = "y", score: str = "score") -> DataFrame:
    """One row: ROC AUC.  Counts per distinct score are summed first; ranks run over those."""
    per = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = per.withColumn("won", F.col("p") * (below + F.col("n") / 2.0))
    return won.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.try_divide(F.sum("won"), F.sum("p") * F.sum("n").cast("double")).alias("auc"))


def roc_points(df: DataFrame, *, label: str = "y", score: str = "score", points: int | None = None) -> DataFrame:
    """(threshold, fpr, tpr) from the highest score down, thinned to ``points`` evenly spaced rows."""
    per = df.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    w, whole = Window.orderBy(F.desc(score)), Window.partitionBy(F.lit(1))
    out = per.select(F.col(score).alias("threshold"), F.try_divide(F.sum("n").over(w).cast("double"), F.sum("n").over(whole)).alias("fpr"), F.try_divide(F.sum("p").over(w).cast("double"), F.sum("p").over(whole)).alias("tpr"), F.row_number().over(w).alias("i"), F.count("*").over(whole).alias("m"))
    if points:
        # row i is kept if it is floor(j (m - 1) / (points - 1)) for some j
        step = F.greatest(F.lit(1.0), (F.col("m") - 1) / F.lit(points - 1.0))
        out = out.where((F.floor(F.ceil((F.col("i") - 1) / step) * step) == F.col("i") - 1) | (F.col("i") == F.col("m")))
    return out.drop("i", "m")


def _sums(data: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the slices of ``data(y, x)`` of the numbers that ``of(y, x)`` gives for one; a row of numbers a task is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for at in range(0, b.num_rows, PROBE_ROWS):
                y, x = (b.slice(at, PROBE_ROWS).column(n) for n in ("y", "x"))
                sizes = pc.unique(pc.list_value_length(x)).to_pylist()
                if len(sizes) != 1:
                    raise ValueError(f"vectors of different lengths: {sorted(sizes)}")
                part = of(y.to_numpy(), x.flatten().to_numpy(zero_copy_only=False).reshape(len(y), sizes[0]))
                if total is not None and len(part) != len(total):
                    raise ValueError("vectors of different lengths")
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = [np.frombuffer(r["sums"]) for r in data.mapInArrow(run, "sums binary").toLocalIterator()]
    if len({len(x) for x in parts}) > 1:
        raise ValueError("vectors of different lengths")
    return sum(parts) if parts else np.zeros(0)


def _least(value: Callable[[np.ndarray], tuple[float, np.ndarray]], at: np.ndarray, steps: int = 200, close: float = 1e-8, memory: int = 20) -> np.ndarray:
    """Minimum of a convex function, given with its gradient, by L-BFGS with halved steps."""
    f, g = value(at)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(g).max() <= close:
            break
        way, alphas = -g, []
        for s, y in reversed(past):
            alphas.append(s @ way / (s @ y))
            way = way - alphas[-1] * y
        if past:
            s, y = past[-1]
            way = way * (s @ y / (y @ y))
        for (s, y), alpha in zip(past, reversed(alphas)):
            way = way + (alpha - y @ way / (s @ y)) * s
        step = 1.0 if past else min(1.0, 1 / np.abs(g).sum())
        while True:
            new, grad = value(at + step * way)
            if new <= f + 1e-4 * step * (g @ way) or step < 1e-10:
                break
            step /= 2
        if step < 1e-10:  # no smaller value can be told
            break
        if (step * way) @ (grad - g) > 0:
            past = [*past[-memory + 1 :], (step * way, grad - g)]
        at, f, g = at + step * way, new, grad
    return at


def logistic_probe(train: DataFrame, test: DataFrame, *, label: str = "y", vector: str = "v", c: float = 1.0) -> DataFrame:
    """``test`` with ``score``: standardised logistic regression with an L2 penalty of 1 / (c n).

    Labels are 0 and 1; training rows without a label or a vector are left out.  A step sends sums as
    long as a vector, whatever the rows.  With one label alone the score is that label's infinity.
    """
    data = train.select(F.col(label).cast("double").alias("y"), F.col(vector).cast("array<double>").alias("x")).dropna().cache()
    try:
        first = _sums(data, lambda y, x: np.concatenate([[len(y), y.sum(), ((y != 0) & (y != 1)).sum()], x.sum(0)]))
        if not len(first):
            raise ValueError("no row to learn from")
        (n, ones, odd), mu = first[:3], first[3:] / first[0]
        if odd:
            raise ValueError("labels other than 0 and 1")
        sd = np.sqrt(_sums(data, lambda y, x: ((x - mu) ** 2).sum(0)) / max(1.0, n - 1))
        per = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 0)  # what does not vary says nothing

        def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
            def of(y, x):
                x = (x - mu) * per
                z = x @ w[1:] + w[0]
                off = 1 / (1 + np.exp(-np.clip(z, -700, 700))) - y
                return np.concatenate([[(np.logaddexp(0, z) - y * z).sum(), off.sum()], off @ x])

            got = _sums(data, of) / n
            penalty = np.concatenate([[0.0], w[1:]]) / (c * n)
            return got[0] + penalty @ w / 2, got[1:] + penalty

        w = np.zeros(len(mu) + 1)
        if 0 < ones < n:
            w[0] = math.log(ones / (n - ones))
            w = _least(loss, w)
        else:
            w[0] = math.inf if ones else -math.inf
    finally:
        data.unpersist()
    probe = train.sparkSession.createDataFrame(pa.table({"dim": np.arange(len(mu)), "mu": mu, "sd": np.where(sd > 0, sd, 1.0), "d": w[1:]}))
    return probe_scores(test, probe, vector=vector).withColumn("score", F.col("score") + float(w[0]))


def accuracy(df: DataFrame, correct: Column) -> DataFrame:
    return df.agg(F.count(correct).alias("n"), F.avg(correct.cast("double")).alias("accuracy"))
