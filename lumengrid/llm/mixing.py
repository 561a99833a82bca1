"""Operator 5: mixing domains to target weights, with DataFrame functions only.

A labelled table (a key and a domain of it) teaches a naive Bayes classifier of words from a documented bounded
sample: of each domain the SAMPLE rows that come first in a seeded hash order.  Every word counts, in one of BUCKETS
hash buckets, so the model's size is fixed.  It gives every document posteriors p(d) over the domains: documents are
soft members of all of them.  Rates x >= least for the documents are then fitted so that the expected token totals
sum_i x_i n_i p_i(d) equal the targets, where n_i are the document's tokens (its words).  This is least
squares in the metric of the Gram matrix G = sum_i n_i p_i p_i', solved by projected gradient steps

    x_i <- max(least, x_i - s p_i' G^-1 r),   r = sum_i x_i n_i p_i - targets,

which start from x_i = 1.  The step size s is 1 at first (the Hessian's largest eigenvalue is one in this metric), then
the last move's squared length over its curvature (Barzilai and Borwein), and 1 again whenever the misfit r' G^-1 r is
above that of all the last WINDOW steps.  Each step is one aggregation over a table of tokens and posteriors; a document's
rate is replayed from the short list of the steps' vectors, so no state is carried over and a lost task only replays.
The steps end when every total is within TOLERANCE of all tokens, or, where the targets can't be met, when the last
WINDOW steps have made the misfit smaller by less than a thousandth (the best step's rates are returned, and the gap is
reported); if neither is so after STEPS steps, that is an error.

Defined results: a null or empty text has no tokens, its posteriors are the class shares; texts are whole, however long;
words of equal hash count as one; without labels there is the one domain `all`; targets of unknown domains are an error;
a domain without a target aims at 0; repeated rows count each; with an empty table there are no rows; columns other than
key and text are ignored, and travel along in `mixed`, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE, BUCKETS, STEPS, WINDOW, TOLERANCE = 1_000, 1 << 16, 500, 30, 1e-4
#: Shares of the languages that the queries aim at; English is shrunk in favour of the others.
TARGETS = {"en": 0.64, "de": 0.13, "fr": 0.13, "es": 0.10}
_WORDS = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _WORDS), lambda w: w != "")


def buckets(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


class Classifier:
    """Naive Bayes over BUCKETS buckets of words: log shares of the domains, and the log likelihoods of buckets that were seen."""

    def __init__(self, domains: list[str], prior: list[float], weights: list[tuple]):
        self.domains, self.prior, self.weights = domains, prior, weights

    def table(self, spark: SparkSession) -> DataFrame:
        """A row for each bucket seen: BUCKETS at most."""
        return spark.createDataFrame(self.weights, ", ".join(["bucket int", *[f"w{i} double" for i in range(len(self.domains))]]))


def classifier(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text") -> Classifier:
    """Learnt from labelled (columns `key` and `domain`)."""
    known = labelled.select(F.col("key").alias("_k"), F.col("domain").alias("_d")).filter("_k is not null and _d is not null")
    sizes = {r["_d"]: r["count"] for r in known.groupBy("_d").count().collect()}
    if not sizes:
        return Classifier(["all"], [0.0], [])
    domains = sorted(sizes)
    chosen = [tuple(r) for d in domains for r in known.filter(F.col("_d") == d).orderBy(F.xxhash64(F.lit(17), "_k"), "_k").limit(SAMPLE).collect()]
    sample = F.broadcast(docs.sparkSession.createDataFrame(chosen, known.schema))  # SAMPLE rows of each domain at most
    seen = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(sample, "_k").select("_d", F.explode(buckets(F.col("_t"))).alias("bucket"))
    names = [f"c{i}" for i in range(len(domains))]
    counts = seen.groupBy("bucket").agg(*[F.count(F.when(F.col("_d") == d, 1)).alias(n) for d, n in zip(domains, names, strict=True)]).collect()  # BUCKETS rows at most
    sums = [sum(r[n] for r in counts) for n in names]
    weights = [(r["bucket"], *[float(np.log((r[n] + 0.5) / (s + 0.5 * BUCKETS))) for n, s in zip(names, sums, strict=True)]) for r in counts]
    return Classifier(domains, [float(np.log(sizes[d] / sum(sizes.values()))) for d in domains], weights)


def with_posteriors(docs: DataFrame, model: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: key, `_h` (a hash of its text), its tokens `n` and posteriors `p0`, `p1`, ..., as a table."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("_h"), F.monotonically_increasing_id().alias("_row"), buckets(F.col(text)).alias("_buckets"))
    rows = rows.select("key", "_h", "_row", F.explode_outer("_buckets").alias("bucket"))
    ws = [f"w{i}" for i in range(len(model.domains))]
    weighed = rows.join(F.broadcast(model.table(spark)), "bucket", "left")
    sums = weighed.groupBy("_row", "key", "_h").agg(F.count("bucket").alias("n"), *[F.coalesce(F.sum(w), F.lit(0.0)).alias(w) for w in ws])
    logs = [F.col(w) + p for w, p in zip(ws, model.prior, strict=True)]
    most = F.greatest(*logs) if len(logs) > 1 else logs[0]
    raw = sums.select("key", "_h", "n", *[F.exp(x - most).alias(w) for x, w in zip(logs, ws, strict=True)])
    total = sum((F.col(w) for w in ws[1:]), F.col(ws[0]))
    return common.written(raw.select("key", "_h", "n", *[(F.col(w) / total).alias(f"p{i}") for i, w in enumerate(ws)]), "posteriors")


def replayed(steps: list[np.ndarray], least: float, domains: int) -> Column:
    """A document's rate `now` after the steps and `before` the last of them, replayed from its posteriors."""
    one = F.lit(1.0)
    start = F.struct(one.alias("now"), one.alias("before"))
    if not steps:
        return start
    moves = F.array(*[F.array(*[F.lit(float(v)) for v in s]) for s in steps])
    dot = lambda m: sum((F.col(f"p{i}") * m[i] for i in range(1, domains)), F.col("p0") * m[0])
    return F.aggregate(moves, start, lambda x, m: F.struct(F.greatest(F.lit(float(least)), x["now"] - dot(m)).alias("now"), x["now"].alias("before")))


def fitted(rows: DataFrame, domains: list[str], targets: dict[str, float], total: float | None = None, least: float = 0.0) -> tuple[Column, dict[str, float], float]:
    """The rate of each row of with_posteriors, the expected tokens of each domain under these rates, and the largest
    gap of one of them to its target, as a share of all tokens aimed at.

    targets are shares; they are met for `total` tokens: by default as many as there are, or with least > 0
    as many as no domain has to shrink for.
    """
    if unknown := set(targets) - set(domains):
        raise ValueError(f"targets for unknown domains: {sorted(unknown)}")
    k = len(domains)
    n = F.col("n").cast("double")
    products = [F.coalesce(F.sum(n * F.col(f"p{i}") * F.col(f"p{j}")), F.lit(0.0)) for i in range(k) for j in range(k)]
    gram = np.array(rows.agg(*products).first(), float).reshape(k, k)
    have = gram.sum(1)  # posteriors sum to one
    share = np.array([targets.get(d, 0.0) for d in domains]) / (sum(targets.values()) or 1)
    if total is None:
        total = have.sum() if least <= 0 else max((h / s for h, s in zip(have, share, strict=True) if s > 0), default=0.0)
    aim = share * total
    inverse = np.linalg.pinv(gram, rcond=1e-12, hermitian=True)
    steps: list[np.ndarray] = []
    now, size, misfits, best, ended = have, 1.0, [], (np.inf, 0, have), False
    while True:
        gap = now - aim
        misfits.append(float(gap @ inverse @ gap))
        if misfits[-1] < best[0]:
            best = (misfits[-1], len(steps), now)
        ended = ended or np.abs(gap).max() <= TOLERANCE * max(total, 1)
        if ended or len(misfits) > WINDOW and min(misfits[-WINDOW:]) >= 0.999 * min(misfits[:-WINDOW]):
            break
        if len(steps) == STEPS:
            raise ArithmeticError(f"the rates have not converged in {STEPS} steps; the totals are {now.tolist()}, the targets {aim.tolist()}")
        if len(misfits) > WINDOW and misfits[-1] > max(misfits[-WINDOW - 1 : -1]):
            size = 1.0
        steps.append(size * (inverse @ gap))
        x = replayed(steps, least, k)
        moved = F.sum(n * F.pow(x["now"] - x["before"], 2))
        *then, length = (float(v or 0) for v in rows.agg(*[F.sum(x["now"] * n * F.col(f"p{i}")) for i in range(k)], moved).first())
        change = np.array(then) - now
        bent = float(change @ inverse @ change)
        now = np.array(then)
        ended = length <= 1e-12 * max(float(have.sum()), 1)  # no rate moves any more: the least-squares solution
        size = min(max(length / bent, 1.0), 1e4) if bent > 0 else 1.0
    _, used, now = best
    gap = float(np.abs(now - aim).max() / max(total, 1))
    return replayed(steps[:used], least, k)["now"], dict(zip(domains, now.tolist(), strict=True)), gap


def language_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents with their language as the domain."""
    return docs.select(F.col("doc_id").alias("key"), F.col("lang").alias("domain")).join(labels.select(F.col("doc_id").alias("key")).distinct(), "key", "left_semi")


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], key: str = "doc_id", text: str = "text", seed: int = 29) -> DataFrame:
    """docs with every row repeated at its rate, at least once: the whole part, and once more by a seeded hash for the rest.

    No document is lost: the total is as large as the domain that is most over its target asks for.
    """
    model = classifier(docs, labelled, key, text)
    rows = with_posteriors(docs, model, key, text)
    goals = {d: s for d, s in targets.items() if d in model.domains} or dict.fromkeys(model.domains, 1.0)
    rate, _, _ = fitted(rows, model.domains, goals, least=1.0)
    chance = F.pmod(F.xxhash64(F.lit(seed), "key", "_h"), F.lit(1_000_000)) / 1e6
    times = rows.select("key", "_h", (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).alias("_times")).dropDuplicates(["key", "_h"])
    bundle = common.bundled(docs, key=key, text=text).withColumn("_h", F.xxhash64("text"))
    times = times.select(F.col("key").alias("_k"), F.col("_h").alias("_h2"), "_times")
    joined = bundle.join(times, F.col("key").eqNullSafe(F.col("_k")) & (F.col("_h") == F.col("_h2")))
    one = F.lit(1).cast("long")
    return common.unbundled(joined.select("text", "rest", F.explode(F.sequence(one, F.greatest("_times", one)))), docs, text)


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates at which the documents' expected tokens match the languages' targets, and the largest gap that is left."""
    docs = common.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    with common.scratch(spark) as kept:
        model = classifier(docs, language_labels(docs, labels))
        rows = with_posteriors(docs, model)
        goals = {d: s for d, s in TARGETS.items() if d in model.domains} or dict.fromkeys(model.domains, 1.0)
        rate, _, gap = fitted(rows, model.domains, goals)
        posteriors = [F.round(f"p{i}", 6).alias(f"p_{d}") for i, d in enumerate(model.domains)]
        return kept(rows.select(F.col("key").alias("doc_id"), F.col("n").alias("n_tokens"), *posteriors, F.round(rate, 6).alias("rate"), F.lit(gap).alias("gap")), "rates")
