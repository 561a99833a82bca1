"""Operator 10: toxicity by nearest labelled examples.

Terms are lower-case words and their first 4, 5 and 6 characters.  Examples are a documented, bounded sample of
labelled rows (at most SAMPLE and of quality.SAMPLE_BYTES bytes, half of each class, first in a seeded hash order of
their keys; near copies of an earlier one, similar to it by COPY or more on the full sets of word pairs, are left
out).  The vocabulary holds all terms of the examples.  A term's weight in a text is
(1 + log count) * idf * rf: the inverse document frequency comes from all documents, the relevance frequency
rf = log2(2 + rows of label 1 with it / max(1, rows of label 0 with it, at equal class sizes)) lets terms that mark
label 1 count more; no term counts nothing.  Texts are compared by the cosine of these vectors, a text's own
over the vocabulary's terms in it.

The examples' vectors form an inverted index in blocks of 64 examples: the DENSE most frequent terms as a matrix
with the greatest weight of each term in each block, all others as postings.  Queries are answered in batches: the
postings' part of every cosine is summed, the block maxima bound the rest, and blocks whose bound is not
above the K-th best cosine so far are skipped.  Cosines are sums in single precision; where that can't tell which example
takes the K-th place, they are computed again in double precision: the K nearest examples are exact.  Each votes with
1 / (SOFT + distance), weighted to its class's own rate; a logistic curve fitted on the examples' leave-one-out
votes turns the vote into a score.  Each text is taken apart once: its terms and their counts are written as a table,
which both the document frequencies and the scores are made from.

The evidence of a score: the nearest examples of label 1 (`neighbours`) and of label 0 (`clean_neighbours`), and the
text's terms that mark label 1, significantly more frequent there (`terms`).

Defined results: null, empty and other texts that share no term with an example have no neighbours and get the
smoothed rate of label 1 among sampled rows without a term; without examples of both classes the score
is the single class's share (0.5 without labels); equal cosines at the K-th place: the example that comes first
in the index stays; repeated rows count each; labels other than 0 and 1, or null, teach nothing.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, quality

SAMPLE, LEAST_ROWS, LEAST_Z = 6_000, 5, 5.0
COPY, BAND_ROWS = 0.75, 4
K, BLOCK, SOFT = 24, 64, 0.05
#: Terms of the index that are kept as a matrix; queries answered at once; words whose terms a task remembers; error of single-precision cosines.
DENSE, QUERIES, WORDS, MARGIN = 3_072, 256, 150_000, 1e-5
_LOW = np.uint64(0xFFFFFFFF)
_MIX = [(np.uint64(2 * a + 1), np.uint64(2 * b + 1)) for a, b in np.random.default_rng(5).integers(1 << 20, 1 << 30, (160, 2))]
_WORD = re.compile(r"\w+")


def term_counts(text: str | None) -> Counter:
    """Terms of the text (prefixes end in a star) and how often they occur."""
    out: Counter = Counter()
    for w, n in Counter(_WORD.findall((text or "").lower())).items():
        out[w] += n
        for k in (4, 5, 6):
            if len(w) >= k:
                out[w[:k] + "*"] += n
    return out


class _Known(dict):
    """Word -> numbers of the vocabulary's terms in it (32-bit integers), for two generations of WORDS words."""

    def __init__(self, at: dict[str, int]):
        self.at, self.older = at, {}

    def __missing__(self, w: str) -> bytes:
        out = self.older.get(w)
        if out is None:
            out = self._of(w)
        if len(self) >= WORDS:
            self.older = dict(self)
            self.clear()
        self[w] = out
        return out

    def _of(self, w: str) -> bytes:
        get, k = self.at.get, len(w)
        if k < 4:
            whole = get(w)
            return b"" if whole is None else array("i", (whole,)).tobytes()
        four = get(w[:4] + "*")
        if four is None:  # no example has a word that begins so, and so neither this word nor a longer beginning
            return b""
        found = (get(w), four, get(w[:5] + "*") if k > 4 else None, get(w[:6] + "*") if k > 5 else None)
        return array("i", [x for x in found if x is not None]).tobytes()


class Vocabulary:
    def __init__(self, terms: list[str]):
        self.terms = terms
        self.at = {x: i for i, x in enumerate(terms)}
        self.known = _Known(self.at)

    def __reduce__(self):
        return Vocabulary, (self.terms,)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the vocabulary's terms in the text, ascending, and how often they occur."""
        found = b"".join(map(self.known.__getitem__, _WORD.findall((text or "").lower())))
        terms, counts = np.unique(np.frombuffer(found, np.int32), return_counts=True)
        return terms, counts.astype(np.int32)


def without_copies(examples: DataFrame) -> DataFrame:
    """examples (key, text, label) without near copies: those whose set of hashed word pairs has a Jaccard similarity of
    COPY or more to that of an earlier row kept of the same label.  Candidates share a band of BAND_ROWS minima (a pair at
    0.75 shares none of the bands with probability 3e-7) and have an estimate by all minima within five standard errors."""

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, minima = [], []
        for text in batch.column(1).to_pylist():
            words = (text or "").lower().split()
            pairs = np.unique(np.array([zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, [*words[1:], ""], strict=True)] or [0], np.uint64))
            minima.append(np.array([(pairs * m + (pairs >> np.uint64(7)) * m2 & _LOW).min() for m, m2 in _MIX], "<u4").tobytes())
            found.append(pairs.astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary()), pa.array(minima, pa.binary())], ["key", "label", "pairs", "minima"])

    kind = examples.schema["key"].dataType.simpleString()
    made = common.written(common.mapped(examples, f"key {kind}, label int, pairs binary, minima binary", sets), "toxicity-pairs")
    rows = sorted((key, label, bytes(pairs), bytes(low)) for key, label, pairs, low in made.toLocalIterator())
    signed = np.array([np.frombuffer(x[3], "<u4") for x in rows], np.uint32).reshape(len(rows), len(_MIX))
    n_bands = len(_MIX) // BAND_ROWS
    bands = np.array([[zlib.crc32(b) + (i + 1000 * label << 32) for i, b in enumerate(x.reshape(-1, BAND_ROWS))] for x, (_, label, *_) in zip(signed, rows, strict=True)], np.int64).reshape(-1, n_bands)
    _, places, times = np.unique(bands, return_inverse=True, return_counts=True)
    places = np.where(times[places.ravel()] > 1, places.ravel(), -1).reshape(-1, n_bands)  # bands of a single row make no candidates
    with_band: dict[int, list[int]] = {}
    kept, margin = [], 5 * (COPY * (1 - COPY) / len(_MIX)) ** 0.5
    for i, (key, _, raw, _) in enumerate(rows):
        pairs, marks = np.frombuffer(raw, "<u4"), [x for x in places[i].tolist() if x >= 0]
        near = np.array(sorted({j for m in marks for j in with_band.get(m, ())}), np.int64)
        near = near[(signed[near] == signed[i]).mean(1) >= COPY - margin]
        if any(_jaccard(pairs, np.frombuffer(rows[j][2], "<u4")) >= COPY for j in near.tolist()):
            continue
        for m in marks:
            with_band.setdefault(m, []).append(i)
        kept.append((key,))
    keys = examples.sparkSession.createDataFrame(kept, f"_kept {kind}")  # SAMPLE rows at most
    return examples.join(F.broadcast(keys.distinct()), F.col("key") == F.col("_kept"), "left_semi")


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def example_terms(examples: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All terms of examples (text, label); rows of label 0 and 1 that have each (2 x terms); rows of label 0 and 1."""

    def run(batches):
        with_term, rows = (Counter(), Counter()), [0, 0]
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with_term[y].update(term_counts(text).keys())
                rows[y] += 1
        # prefixes end in a star and words have none, so the empty term is free for the number of rows
        terms = ["", *{*with_term[0], *with_term[1]}]
        columns = [pa.array([rows[y], *[with_term[y][x] for x in terms[1:]]], pa.int64()) for y in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(terms), *columns], ["term", "n0", "n1"])

    counted = examples.select("text", "label").mapInArrow(run, "term string, n0 long, n1 long")
    found = counted.groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow().sort_by("term")
    terms, with_term = found["term"].to_pylist(), np.array([found["n0"].to_numpy(), found["n1"].to_numpy()], np.int64)
    if not terms:
        return [], with_term, np.zeros(2, np.int64)
    return terms[1:], with_term[:, 1:], with_term[:, 0]  # the empty term comes first


def marking(with_term: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether each term marks label 1: in LEAST_ROWS rows of it at least, and significantly more frequent there."""
    if not rows.min():
        return np.zeros(with_term.shape[1], bool)
    b, a = with_term.astype(float)
    p, q, both = a / rows[1], b / rows[0], (a + b) / rows.sum()
    z = (p - q) / np.sqrt(both * (1 - both) * (1 / rows[0] + 1 / rows[1]) + 1e-12)
    return (a >= LEAST_ROWS) & (z >= LEAST_Z) & (p >= 4 * q)


def relevance(with_term: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Relevance frequency of each term: see the module's text."""
    return np.log2(2 + with_term[1] / np.maximum(with_term[0] * (rows[1] / max(rows[0], 1)), 1))


def taken_apart(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text", label: str | None = None) -> DataFrame:
    """`key` (and `label`), and the text's `terms` (the first number, then the steps to the next, of 32 bits) and `counts`
    (of 8, 16 or 32 bits, as the largest asks for), as a table."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # terms of SAMPLE texts at most

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [shared.value.counts(x) for x in batch.column(1).to_pylist()]
        columns = [pa.array([np.diff(t, prepend=0).astype("<i4").tobytes() for t, _ in made], pa.binary()), pa.array([n.astype(np.min_scalar_type(n.max(initial=0))).tobytes() for _, n in made], pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[2:]], names)

    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "terms", "counts"] + ["label"] * bool(label)
    chosen = docs.select(F.col(key).alias("key"), text, *[F.col(x).cast("int").alias("label") for x in [label] if x])
    return common.written(common.mapped(chosen, f"key {kind}, terms binary, counts binary" + ", label int" * bool(label), each), "toxicity-terms")


def _parts(terms: list[bytes], counts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.cumsum(np.frombuffer(t, "<i4"), dtype=np.int32), np.frombuffer(n, f"<u{4 * len(n) // len(t)}" if n else "u1")) for t, n in zip(terms, counts, strict=True)]


def document_frequencies(apart: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """Documents that have each term, of all rows of `taken_apart`; and their number."""

    def run(batches):
        total, rows = np.zeros(n_terms + 1, np.int64), 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total[np.cumsum(np.frombuffer(x, "<i4"))] += 1
            rows += batch.num_rows
        total[-1] = rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["term", "n"])

    out = np.zeros(n_terms + 1, np.int64)
    # a few tasks for each core, each with a total of its own: the totals are what is shuffled
    found = apart.select("terms").coalesce(2 * apart.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return out[:-1], int(out[-1])


class BlockMaxIndex:
    """Unit vectors of examples as a matrix of the most frequent terms with block maxima, and postings of the others."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        # examples with the same leading term lie together, so that a block's maxima are tight
        order = sorted(range(len(vectors)), key=lambda i: (vectors[i][0][vectors[i][1].argmax()] if len(vectors[i][0]) else -1, i))
        self.order, self.n_terms = np.array(order, np.int64), terms
        self.starts = np.cumsum([0, *[len(vectors[i][0]) for i in order]])
        self.terms = np.concatenate([np.zeros(0, np.int32), *[vectors[i][0] for i in order]]).astype(np.int32)
        self.weights = np.concatenate([np.zeros(0, np.float32), *[vectors[i][1] for i in order]]).astype(np.float32)
        self._arrange()

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("order", "n_terms", "starts", "terms", "weights")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._arrange()

    def _arrange(self) -> None:
        n = len(self.order)
        self.blocks = -(-n // BLOCK)
        slots = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.starts))
        often = np.bincount(self.terms, minlength=self.n_terms)
        dense = np.argsort(-often, kind="stable")[:DENSE]
        self.row = np.full(self.n_terms, -1, np.int32)  # of each term in the matrix
        self.row[dense] = np.arange(len(dense))
        rows = self.row[self.terms]
        inside = rows >= 0
        self.matrix = np.zeros((self.blocks, len(dense), BLOCK), np.float32)  # a block's part lies together
        self.matrix[slots[inside] // BLOCK, rows[inside], slots[inside] % BLOCK] = self.weights[inside]
        self.maxima = np.ascontiguousarray(self.matrix.max(axis=2, initial=0).T)
        outside = np.flatnonzero(~inside)
        outside = outside[np.argsort(self.terms[outside], kind="stable")]
        self.slots, self.values = slots[outside], self.weights[outside]
        self.first = np.cumsum(np.concatenate([[0], np.bincount(self.terms[outside], minlength=self.n_terms)]))
        self.whole = np.zeros(self.n_terms)  # a query's weights while its cosines are computed

    def _from_postings(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The part of every example's cosine that these terms' postings give."""
        sizes = self.first[terms + 1] - self.first[terms]
        at = np.arange(sizes.sum()) + np.repeat(self.first[terms] - np.cumsum(sizes) + sizes, sizes)
        return np.bincount(self.slots[at], self.values[at] * np.repeat(weights.astype(np.float32), sizes), self.blocks * BLOCK)

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the k examples of the greatest positive cosine (but for its `without`), and these cosines, greatest first."""
        if not self.blocks:
            return [(np.zeros(0, np.int64), np.zeros(0)) for _ in queries]
        dense = np.zeros((len(queries), len(self.maxima)), np.float32)
        cosines = np.zeros((len(queries), self.blocks * BLOCK), np.float32)
        for i, (terms, weights) in enumerate(queries):
            rows = self.row[terms]
            dense[i, rows[rows >= 0]] = weights[rows >= 0]
            cosines[i] = self._from_postings(terms[rows < 0], weights[rows < 0])
        barred = np.full(len(queries), -1)
        if without is not None:
            place = np.argsort(self.order)
            barred = np.array([place[x] if x >= 0 else -1 for x in without])
        hidden = np.flatnonzero(barred >= 0)
        cosines[hidden, barred[hidden]] = -2
        bounds = dense @ self.maxima + cosines.reshape(len(queries), self.blocks, BLOCK).max(axis=2) + MARGIN
        order = np.argsort(-bounds.sum(axis=0), kind="stable")
        early = max(-(-self.blocks // 4), min(self.blocks, -(-2 * k // BLOCK)))
        least = np.zeros(len(queries))
        for turn, b in enumerate(order.tolist()):
            part = slice(b * BLOCK, (b + 1) * BLOCK)
            if turn == early:
                found = (order[:early, None] * BLOCK + np.arange(BLOCK)).ravel()
                if len(found) > k:
                    least = np.maximum(np.partition(cosines[:, found], -k, axis=1)[:, -k] - MARGIN, 0)
            open_ = np.flatnonzero(bounds[:, b] > least)
            if len(open_) == len(queries):
                cosines[:, part] += dense @ self.matrix[b]
            elif len(open_):
                cosines[open_, part] += dense[open_] @ self.matrix[b]
            if len(open_) < len(queries):
                cosines[np.flatnonzero(bounds[:, b] <= least), part] = 0
        return [self._best(q, row, k) for q, row in zip(queries, cosines, strict=True)]

    def _best(self, query: tuple[np.ndarray, np.ndarray], near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the greatest cosines: those within MARGIN of the k-th place are told apart in double precision."""
        last = float(np.partition(near, -k)[-k]) if len(near) > k else 0.0
        sure = np.flatnonzero(near > max(last + MARGIN, 0))
        close = np.flatnonzero((near > 0) & (near >= last - MARGIN) & (near <= last + MARGIN))
        if len(sure) + len(close) > k:
            self.whole[query[0]] = query[1]
            cosines = np.array([np.dot(self.whole[self.terms[a:b]], self.weights[a:b]) for a, b in zip(self.starts[close].tolist(), self.starts[close + 1].tolist(), strict=True)])
            self.whole[query[0]] = 0
            close = close[np.lexsort((close, -cosines))[: k - len(sure)]]
        found = np.concatenate([sure, close])
        found = found[np.lexsort((found, -near[found]))]
        return self.order[found], np.minimum(near[found].astype(float), 1.0)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_of([(terms, weights)], k, [without])[0]


class Model:
    """Everything that scoring needs; its size is bounded by the texts of SAMPLE rows."""

    def __init__(self, idf, marking, index, labels, keys, weight, rest, a=1.0, b=0.0):
        self.idf, self.marking, self.index = idf, marking, index  # marking: number -> term that marks label 1
        self.marks = np.zeros(len(idf), bool)
        self.marks[list(marking)] = True
        self.labels, self.keys, self.weight, self.rest, self.a, self.b = labels, keys, weight, rest, a, b

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts.astype(float))) * self.idf[terms]
        return terms, w / np.sqrt(np.dot(w, w)) if len(w) else w

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """For each vector the log odds of the neighbours' votes, the neighbours and their cosines."""
        out = []
        for at in range(0, len(vectors), QUERIES):
            for found, cosines in self.index.nearest_of(vectors[at : at + QUERIES], K, without and without[at : at + QUERIES]):
                votes = self.weight[self.labels[found]] / (SOFT + 1 - cosines)
                toxic = float(votes[self.labels[found] == 1].sum())
                out.append((float(np.log((toxic + 0.05) / (float(votes.sum()) - toxic + 0.05))), found, cosines))
        return out

    def scores(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
        """Of each text (its terms and counts) the score, and the evidence: keys and cosines of the neighbours of label 1,
        the terms that mark label 1, keys and cosines of the neighbours of label 0."""
        out: list[tuple] = [(self.rest, [], [], [], [], [])] * len(parts)
        if self.index is None:
            return out
        own = [i for i, x in enumerate(parts) if len(x[0])]
        for i, (vote, found, cosines) in zip(own, self.votes([self.vector(*parts[i]) for i in own]), strict=True):
            p = 1 / (1 + np.exp(-np.clip(self.a * vote + self.b, -35, 35)))
            toxic = self.labels[found] == 1
            sides = [([self.keys[j] for j in found[x].tolist()], cosines[x].tolist()) for x in (toxic, ~toxic)]
            terms = parts[i][0]
            out[i] = (float(p), *sides[0], [self.marking[j] for j in terms[self.marks[terms]].tolist()], *sides[1])
        return out


def fit(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> tuple[Model, DataFrame, Vocabulary]:
    """The model, all docs as `taken_apart` by its vocabulary, and the vocabulary."""
    examples, rows = quality.sampled(docs, labels, label, sample, key, text)
    examples = common.written(without_copies(examples), "toxicity-distinct")
    terms, by_label, drawn = example_terms(examples)
    vocabulary = Vocabulary(terms)
    apart = taken_apart(docs, vocabulary, key, text)
    with_term, n_docs = document_frequencies(apart, len(terms))
    idf = (np.log((1 + n_docs) / (1 + with_term)) + 1) * relevance(by_label, drawn)
    marks = {i: terms[i] for i in np.flatnonzero(marking(by_label, drawn)).tolist()}
    if not drawn.min():
        return Model(idf, marks, None, np.zeros(0, np.int64), [], np.ones(2), 0.5 if not drawn.sum() else float(drawn[1] > 0)), apart, vocabulary
    # read back a partition at a time: the driver holds the vectors once, not the JVM's copy of all of them too
    got = [(y, k, bytes(t), bytes(c)) for k, t, c, y in taken_apart(examples, vocabulary, "key", label="label").toLocalIterator()]
    got.sort()
    classes = np.array([x[0] for x in got], np.int64)
    weight = rows / rows.sum() / (drawn / drawn.sum())
    model = Model(idf, marks, None, classes, [x[1] for x in got], weight, 0.0)
    made = [(t, w.astype(np.float32)) for t, w in (model.vector(*x) for x in _parts([x[2] for x in got], [x[3] for x in got]))]
    got.clear()
    model.index = BlockMaxIndex(made, len(terms))
    bare = np.array([not len(x[0]) for x in made])
    mass = [float(weight[y] * (bare & (classes == y)).sum()) for y in (0, 1)]
    model.rest = (mass[1] + 0.05) / (mass[0] + mass[1] + 1)
    own = np.flatnonzero(~bare)
    if len(own):
        votes = np.array([x[0] for x in model.votes([made[i] for i in own.tolist()], own.tolist())])
        model.a, model.b = quality.logistic(votes, classes[own], weight[classes[own]])
    return model, apart, vocabulary


def scored(apart: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """key, `score`, `predicted`, and the evidence: `neighbours` of label 1 and their `cosines`, the marking `terms`
    found, and `clean_neighbours` of label 0 with `clean_cosines`, of all rows of `taken_apart`."""
    shared = apart.sparkSession.sparkContext.broadcast(model)
    kind = apart.schema["key"].dataType.simpleString()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = shared.value.scores(_parts(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
        score = pa.array([x[0] for x in made], pa.float64())
        predicted = pa.array([int(x[0] >= 0.5) for x in made], pa.int32())
        kinds = (batch.column(0).type, pa.float64(), pa.string(), batch.column(0).type, pa.float64())
        evidence = [pa.array([x[k] for x in made], pa.list_(t)) for k, t in enumerate(kinds, 1)]
        return pa.RecordBatch.from_arrays([batch.column(0), score, predicted, *evidence], [key, "score", "predicted", "neighbours", "cosines", "terms", "clean_neighbours", "clean_cosines"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:  # a pass over the index serves QUERIES texts
            held.append(batch)
            rows += batch.num_rows
            if rows >= QUERIES:
                yield each(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, rows = [], 0
        if rows:
            yield each(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    evidence = f"neighbours array<{kind}>, cosines array<double>, terms array<string>, clean_neighbours array<{kind}>, clean_cosines array<double>"
    return apart.select("key", "terms", "counts").mapInArrow(run, f"`{key}` {kind}, score double, predicted int, {evidence}")


def op10_nearest_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, with its nearest labelled examples as evidence."""
    docs = common.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.coalesce(common.crc_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    with common.scratch(spark) as kept:
        model, apart, _ = fit(docs, quality.not_held_out(labels, 5, 0), "toxic")
        found = scored(apart, model).select("doc_id", held.alias("held_out"), "score", "predicted", "neighbours", "terms", "clean_neighbours")
        return kept(found, "toxicity-scores")
