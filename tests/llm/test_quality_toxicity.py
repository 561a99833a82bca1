import zlib

import numpy as np
import pytest

from lumengrid.llm import quality, toxicity
from lumengrid.llm.registry import QUERIES

BIG = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("name", "label", "modulus", "held"), [("op1_nbsvm_quality", "quality", 3, 1), ("op10_nearest_toxic", "toxic", 5, 0)])
def test_held_out_accuracy(spark, name, label, modulus, held):
    rows = QUERIES[name](spark, BIG).collect()
    marks = {r.doc_id: r[label] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    good = [r.predicted == marks[r.doc_id] for r in rows if r.held_out and r.doc_id in marks]
    assert len(good) > 60 and np.mean(good) > 0.95


def test_labels_of_held_out_rows_teach_nothing(spark):
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.not_held_out(labels, 3, 1).collect()}
    assert kept == {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1}


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(30, 8, replace=False)) for _ in range(60)]
    signs = np.where(rng.random(60) < 0.5, -1.0, 1.0)
    values, cost = rng.normal(size=30), np.full(60, 0.5)
    w = quality.dual_coordinate_descent(rows, values, signs, cost, 400)

    def primal(w):
        margins = np.array([w[x] @ values[x] / np.sqrt(len(x)) + w[-1] for x in rows])
        return 0.5 * w @ w + (cost * np.maximum(0, 1 - signs * margins)).sum()

    best = primal(w)
    for _ in range(300):
        assert primal(w + rng.normal(size=31) * 0.01) >= best - 1e-3


def test_log_count_ratios():
    r = quality.log_count_ratios([np.array([1, 2]), np.array([2])], np.array([1, 0]))
    assert r[1] > r[2] and r[1] - r[2] == pytest.approx(np.log(2))


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_edge_rows(spark, edges, empty, no_labels):
    marks = spark.createDataFrame([(0, 1, 1), (4, 0, 0), (7, 1, 1), (5, 0, 0), (1, 1, None), (None, 0, 1), (2, 7, 7)], "doc_id long, quality int, toxic int")
    for labels in (marks, no_labels, marks.filter("quality = 1")):
        model = quality.fit(edges, labels, "quality")
        for docs in (edges, empty):
            rows = quality.scored(docs, model).collect()
            assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
            kept = quality.accepted(docs, model)
            assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)
        model, _, vocabulary = toxicity.fit(edges, labels, "toxic")
        for docs in (edges, empty):
            rows = toxicity.scored(toxicity.taken_apart(docs, vocabulary), model).collect()
            assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.scored(edges, quality.fit(edges, no_labels, "quality")).collect()} == {0.5}
    model, apart, _ = toxicity.fit(edges, no_labels, "toxic")
    assert {r.score for r in toxicity.scored(apart, model).collect()} == {0.5}
    model, apart, _ = toxicity.fit(empty, marks, "toxic")
    assert toxicity.scored(apart, model).collect() == []


def test_block_max_index_finds_the_nearest():
    rng = np.random.default_rng(8)

    def vector():
        t = np.sort(rng.choice(40, rng.integers(0, 7), replace=False)).astype(np.int32)
        w = rng.random(len(t)) + 0.1
        return t, w / np.sqrt(w @ w) if len(w) else w

    examples = [vector() for _ in range(700)]
    index = toxicity.BlockMaxIndex(examples, 40)
    dense = np.zeros((700, 40))
    for i, (t, w) in enumerate(examples):
        dense[i, t] = w
    for i in range(120):
        t, w = vector()
        without = i % 5 - 1
        found, cosines = index.nearest(t, w, 10, without)
        all_cosines = dense[:, t] @ w
        if without >= 0:
            all_cosines[without] = 0
        want = np.sort(all_cosines[all_cosines > 0])[::-1][:10]
        assert np.allclose(cosines, want) and np.allclose(all_cosines[found], cosines)


def test_toxic_words_and_evidence(spark):
    rng = np.random.default_rng(6)
    filler = lambda: " ".join(f"{a}{b}" for a, b in rng.choice(list("bdfglmnprst"), (14, 2)))
    clean = [(i, f"{filler()} barley {filler()}") for i in range(60)]
    toxic = [(100 + i, f"{filler()} wretched gribble {filler()}") for i in range(60)]
    docs = spark.createDataFrame(clean + toxic + [(500, "such a GRIBBLE"), (501, "barley fields")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in clean + toxic], "doc_id long, toxic int")
    model, apart, _ = toxicity.fit(docs, labels, "toxic")
    got = {r.doc_id: r for r in toxicity.scored(apart, model).collect()}
    assert got[500].predicted == 1 and "gribble" in got[500].terms and min(got[500].neighbours) >= 100
    assert got[501].predicted == 0 and got[501].neighbours == []


def test_texts_without_a_marking_term_have_neighbours(spark):
    rng = np.random.default_rng(9)
    filler = lambda: " ".join(f"{a}{b}" for a, b in rng.choice(list("bdfglmnprst"), (14, 2)))
    clean = [(i, f"{filler()} barley {filler()}") for i in range(60)]
    toxic = [(100 + i, f"{filler()} gribble {filler()}") for i in range(60)]
    docs = spark.createDataFrame(clean + toxic + [(500, "barley fields"), (501, filler()), (502, "zq")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in clean + toxic], "doc_id long, toxic int")
    model, apart, vocabulary = toxicity.fit(docs, labels, "toxic")
    got = {r.doc_id: r for r in toxicity.scored(apart, model).collect()}
    assert "barley" in vocabulary.terms and len(got[500].clean_neighbours) == toxicity.K and got[500].neighbours == []
    # no term of this text marks a label, but its nearest examples are known
    assert got[501].terms == [] and len(got[501].neighbours) + len(got[501].clean_neighbours) == toxicity.K
    assert got[502].neighbours == got[502].clean_neighbours == [] and got[502].score == model.rest


def test_only_confirmed_copies_are_left_out(spark):
    rng = np.random.default_rng(12)
    long = [" ".join(f"w{n}" for n in rng.integers(0, 100_000, 200)) for _ in range(60)]
    rows = [(i, f"{t} all rights reserved", 1) for i, t in enumerate(long)]
    rows += [(100, long[0] + " all rights reserved anyway", 1), (101, long[0] + " all rights reserved", 0), (102, "all rights reserved", 1)]
    kept = toxicity.without_copies(spark.createDataFrame(rows, "key long, text string, label int"))
    assert {r.key for r in kept.collect()} == {*range(60), 101, 102}


def test_texts_with_a_common_pair_stay(spark):
    rows = [(i, f"of the w{i} x{i} y{i}", 1) for i in range(200)]
    assert toxicity.without_copies(spark.createDataFrame(rows, "key long, text string, label int")).count() == 200


def test_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (10 if i % 7 else 500)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    rows = quality.sampled(docs, labels, "quality", 40, most_bytes=400)[0].collect()
    assert all(sum(r.label == y for r in rows) >= 16 for y in (0, 1)) and {len(r.text) for r in rows} == {10}
    assert quality.sampled(docs, labels, "quality", 40)[0].count() == 40


def naive_gram_ids(text):
    """Buckets of all byte n-grams and repetitions, one by one."""
    data, out = text.encode(), set()
    for n in range(1, 5):
        for i in range(len(data) - n + 1):
            code = 0
            for x in data[i : i + n]:
                code = (code * 257 + x + 1) % 2**32
            out.add((((code ^ code >> 15) * 0x9E3779B1) % 2**32) >> 15)
    words, run, longest = text.split(), 0, 0
    for a, b in zip(words, words[1:], strict=False):
        run = run + 1 if a == b else 0
        longest = max(longest, run)
    out |= {i for i, n in enumerate((1, 2, 4, 8, 16)) if longest >= n}
    lines = [x for x in text.split("\n") if x]
    return sorted(out | ({5} if len(set(lines)) < len(lines) else set()))


def test_quality_query_against_brute_force(spark, data, texts):
    """The whole of op1 again with plain loops over sets: features, ratios, hinge-loss model, curve."""
    marks = sorted((r.quality, r.doc_id) for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1)
    grams = {i: naive_gram_ids(t or "") for i, t in texts.items()}
    assert all(np.array_equal(quality.features(texts[i]), g) for i, g in grams.items())
    rows = sorted((y, np.array(grams[i], "<i4").tobytes(), i) for y, i in marks if i in grams)
    p, q = (1 + sum(np.bincount(grams[i], minlength=quality.BUCKETS) for y, _, i in rows if y == c) for c in (1, 0))
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    size = np.array([sum(1 for y, _ in marks if y == c) for c in (0, 1)])
    drawn = np.array([sum(1 for y, *_ in rows if y == c) for c in (0, 1)])
    natural = np.array([size[y] / size.sum() / (drawn[y] / drawn.sum()) for y, *_ in rows])
    w, alpha, rng, order = np.zeros(quality.BUCKETS), np.zeros(len(rows)), np.random.default_rng(7), np.arange(len(rows))
    bias = 0.0
    for _ in range(quality.EPOCHS):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            x, sign = grams[rows[i][2]], 1 if rows[i][0] else -1
            v = r[x] / np.sqrt(max(len(x), 1))
            old = alpha[i]
            alpha[i] = np.clip(old - (sign * (w[x] @ v + bias) - 1) / (v @ v + 1), 0, quality.COST * natural[i])
            w[x] += (alpha[i] - old) * sign * v
            bias += (alpha[i] - old) * sign
            moved = max(moved, abs(alpha[i] - old) / (quality.COST * natural[i]))
        if moved < 1e-3:
            break
    weights = (0.5 * np.abs(w).mean() + 0.5 * w) * r
    margin = lambda i: weights[grams[i]].sum() / np.sqrt(max(len(grams[i]), 1)) + bias
    a, b = quality.logistic(np.array([margin(i) for *_, i in rows]), np.array([y for y, *_ in rows]), natural)
    for row in QUERIES["op1_nbsvm_quality"](spark, data).collect():
        assert row.score == pytest.approx(1 / (1 + np.exp(-(a * margin(row.doc_id) + b))), abs=1e-4)


def test_toxicity_query_against_brute_force(spark, data, texts):
    """The whole of op10 again over dictionaries of all terms: weights, cosines to every example, votes, curve."""
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{data}/labels.parquet").collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    counts = {i: toxicity.term_counts(t) for i, t in texts.items()}
    pairs = {}
    for i in marks:
        words = (texts[i] or "").lower().split()
        pairs[i] = {zlib.crc32(f"{x} {y}".encode()) for x, y in zip(words, [*words[1:], ""], strict=True)} or {0}
    kept = []
    for i in sorted(marks):
        if not any(marks[j] == marks[i] and len(pairs[i] & pairs[j]) / len(pairs[i] | pairs[j]) >= toxicity.COPY for j in kept):
            kept.append(i)
    drawn = [sum(marks[i] == y for i in kept) for y in (0, 1)]
    rows = [sum(x == y for x in marks.values()) for y in (0, 1)]
    by_label = [{}, {}]
    for i in kept:
        for t in counts[i]:
            by_label[marks[i]][t] = by_label[marks[i]].get(t, 0) + 1
    df: dict = {}
    for c in counts.values():
        for t in c:
            df[t] = df.get(t, 0) + 1

    def vector(i):
        out = {}
        for t, n in counts[i].items():
            if t in by_label[0] or t in by_label[1]:
                rf = np.log2(2 + by_label[1].get(t, 0) / max(by_label[0].get(t, 0) * drawn[1] / drawn[0], 1))
                out[t] = (1 + np.log(n)) * (np.log((1 + len(texts)) / (1 + df[t])) + 1) * rf
        length = np.sqrt(sum(x * x for x in out.values()))
        return {t: x / length for t, x in out.items()}

    vectors = {i: vector(i) for i in texts}
    weight = [rows[y] / sum(rows) / (drawn[y] / sum(drawn)) for y in (0, 1)]

    def vote(i, without=None):
        cosines = {j: sum(x * vectors[j].get(t, 0) for t, x in vectors[i].items()) for j in kept if j != without}
        best = sorted((j for j in cosines if cosines[j] > 0), key=lambda j: -cosines[j])[: toxicity.K]
        side = [sum(weight[y] / (toxicity.SOFT + 1 - min(cosines[j], 1)) for j in best if marks[j] == y) for y in (0, 1)]
        return np.log((side[1] + 0.05) / (side[0] + 0.05)), {j for j in best if marks[j]}, {j for j in best if not marks[j]}

    own = sorted((i for i in kept if vectors[i]), key=lambda i: (marks[i], i))
    a, b = quality.logistic(np.array([vote(i, i)[0] for i in own]), np.array([marks[i] for i in own]), np.array([weight[marks[i]] for i in own]))
    same = 0
    for row in QUERIES["op10_nearest_toxic"](spark, data).collect():
        if vectors[row.doc_id]:
            v, toxic, clean = vote(row.doc_id)
            assert row.score == pytest.approx(1 / (1 + np.exp(-np.clip(a * v + b, -35, 35))), abs=1e-3)
            same += set(row.neighbours) == toxic and set(row.clean_neighbours) == clean
    assert same >= 0.98 * len(texts)  # the others have equal cosines at the last place


def test_equal_cosines_at_the_last_place(spark):
    clean = [(i, "barley fields") for i in range(3)] + [(10 + i, f"barley q{chr(97 + i)}{chr(98 + i)}") for i in range(toxicity.K + 4)]
    toxic = [(100 + i, f"gribble z{chr(97 + i)}{chr(98 + i)}") for i in range(toxicity.K + 4)]
    docs = spark.createDataFrame(clean + toxic + [(500, "barley")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in clean + toxic], "doc_id long, toxic int")
    found = []
    for parts in (1, 5):
        model, apart, _ = toxicity.fit(docs.repartition(parts), labels, "toxic")
        found.append({r.doc_id: (r.score, tuple(r.neighbours), tuple(r.clean_neighbours)) for r in toxicity.scored(apart, model).collect()})
    assert found[0] == found[1] and len(found[0][500][2]) == toxicity.K
