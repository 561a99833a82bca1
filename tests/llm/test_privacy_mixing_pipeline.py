import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumengrid.llm import mixing, privacy
from lumengrid.llm.registry import QUERIES

KINDS = ("email", "ip", "card", "phone")
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or "", re.A):
            d = re.sub("[^0-9]", "", m[0])
            good = (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15)[k]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_the_patterns(spark):
    rng = random.Random(1)
    hard = ["a@b.co_x@y.zz", "a@b..c@d.e", "_x a@b.c.d.", "1.2.3.4.5.6.7.8", "9.1.2.300 0001.2.3.4", "4111 1111 1111 1111 x", "4111-1111-1111-1111-", "+1 (386) 555-3733 4041894974608795", "", None, "é a@b.co é +123456789 ", "a@b.c.d", "a@b.c" + ".d" * 20000, "1" * 60000, "1 " * 30000, "a" * 100000 + "@b", "+1" + " " * 50000, "a@" * 20000]
    hard += ["".join(rng.choice("a1.@ +-(4_%é\n0") for _ in range(60)) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")
    for r in df.select("doc_id", privacy.base_spans(F.coalesce("text", F.lit(""))).alias("s")).collect():
        assert [(s.start, s.kind, s.end) for s in r.s] == brute(hard[r.doc_id]), hard[r.doc_id]


def test_query_against_the_patterns(spark, data, texts):
    rows = QUERIES["op6_disclosure"](spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        b = brute(texts[r.doc_id])
        listed = ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in b)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in b) for i in range(4)]
        assert set(listed.split(",")) <= set(r.spans.split(","))
        if not b:
            assert r.spans == ""


def disclosing(rows):
    """The docstring's formulas, word for word, in plain Python."""
    windows, counts, total = {}, {}, 0
    for t in rows:
        for w in re.split(r"[^a-z]+", t.lower()):
            counts[w] = counts.get(w, 0) + 1
            total += 1
        for a, k, e in brute(t):
            near = t[:a].lower().split()[-privacy.WORDS :] + t[e:].lower().split()[: privacy.WORDS]
            words = frozenset(w for w in (re.sub(r"^[^a-z]+|[^a-z]+$", "", w) for w in near) if re.fullmatch("[a-z]{3,}", w))
            windows.setdefault((k, t[a:e].lower()), set()).add(words)
    out = {}
    share = lambda n: min(1.0, n * 2 * privacy.WORDS / total)
    for entity, ws in windows.items():
        n, z = len(ws), privacy.CONFIDENCE
        for w in {w for x in ws for w in x}:
            both = sum(w in x for x in ws)
            p = both / n
            bound = (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            pmi, content = np.log2(bound / share(counts.get(w, 0) or np.nan)), -np.log2(share(n))
            if n >= privacy.LEAST_WINDOWS and both >= privacy.LEAST_WINDOWS and pmi > 0 and pmi >= privacy.DISCLOSURE * content:
                out.setdefault(entity, {})[w] = bool(pmi >= privacy.REMOVED * content)
    return out


def sanitised_by(want, text):
    """The text without base spans and terms, by the docstring."""
    spans = [(a, k, e) for a, k, e in brute(text)]
    terms: dict = {}
    for a, k, e in spans:
        for w, removed in want.get((k, text[a:e].lower()), {}).items():
            terms[w] = terms.get(w, False) or removed
    more = [(m.start(), 4 if terms[m[0].lower()] else 5 if m[0][0].isupper() else 6, m.end()) for m in re.finditer(r"[^\W\d_]+", text) if m[0].lower() in terms]
    more = [x for x in more if not any(b[0] < x[2] and x[0] < b[2] for b in spans)]
    out, at = "", 0
    for a, k, e in sorted(spans + more):
        if a >= at:
            out += text[at:a] + f"[{privacy.KINDS[k].upper()}]"
        at = max(at, e)
    return out + text[at:]


def test_disclosing_terms(spark):
    names = ["alpha", "bravo", "carol", "delta", "echoo", "foxes", "golfs", "hotel"]
    rows = [f"please contact {'Zorblatt' if i < 6 else 'someone'} at zb@corp.example.com about item {n} and order {n}{n} today" for i, n in enumerate(names)]
    rows += ["the quick and order today about contact someone please at brown item fox " * 20 for _ in range(30)]
    want = disclosing(rows)
    assert want == {(0, "zb@corp.example.com"): {"zorblatt": True}}
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in privacy.sanitised(docs).collect()}
    assert all("[EMAIL]" in got[i] and ("[TERM]" in got[i]) == (i < 6) for i in range(8))
    assert got == {i: sanitised_by(want, t) for i, t in enumerate(rows)}
    assert all(got[i] == rows[i] for i in range(8, len(rows)))


def test_two_windows_disclose_a_rare_name(spark):
    names = ["alpha", "bravo"]
    rows = [f"please contact Zorblatt at zb@corp.example.com about item {n} and order {n}{n} today" for n in names]
    rows += [f"please contact Quimby at {n}@corp.example.com about item and order today" for n in names[:1] * 2]  # one window, copied
    rows += ["the quick and order today about contact someone please at brown item fox " * 20 for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in privacy.sanitised(docs).collect()}
    assert all(got[i] == rows[i].replace("Zorblatt", "[TERM]").replace("zb@corp.example.com", "[EMAIL]") for i in (0, 1))
    assert all(got[i] == rows[i].replace("alpha@corp.example.com", "[EMAIL]") for i in (2, 3))
    assert all(got[i] == rows[i] for i in range(4, len(rows)))


def test_windows_are_of_whole_words(spark):
    """Words of any length: the window is ten words to each side, however far they reach."""
    long = ["donaudampfschifffahrtsgesellschaftskapitaensmuetze" * k for k in (1, 3, 50)]
    rows = []
    for i in range(6):
        rows.append(f"Zorblatt {' '.join(long[0] for _ in range(7))} {'filler' * i} at zb@corp.example.com   \n {long[1]} Gribble {long[2]} and {'other' * i} more")
        rows.append(f"Toofar {' '.join(f'{long[0]}{k}' for k in 'abcdefgh')} {'x' * i} one two zb@corp.example.com {' ' * 3000} {'far ' * 9} Inside Outside")
    rows += ["the quick and order today about contact someone please at brown item fox " * 20 for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    found = privacy.with_base_spans(docs, "text", False)
    seen = {(i, tuple(sorted(w))) for i, w in ((r.entity, r.words) for r in privacy.occurrences(found, "text").collect())}
    for t in rows:
        for a, k, e in brute(t):
            near = t[:a].lower().split()[-10:] + t[e:].lower().split()[:10]
            assert (f"{k}:{t[a:e]}", tuple(sorted({w for w in near if re.fullmatch("[a-z]{3,}", w)}))) in seen
    want = disclosing(rows)
    assert {"zorblatt", "gribble", "inside"} <= set(want[0, "zb@corp.example.com"]) and not {"toofar", "outside"} & set(want[0, "zb@corp.example.com"])
    assert {r.doc_id: r.text for r in privacy.sanitised(docs).collect()} == {i: sanitised_by(want, t) for i, t in enumerate(rows)}


def test_very_many_spans(spark):
    text = "".join(f"m{i}@corp.example.com and 10.0.{i % 200}.{i % 99} go on; " for i in range(1500))
    docs = spark.createDataFrame([(1, text), (2, "plain")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in privacy.sanitised(docs).collect()}
    assert got[1].count("[EMAIL]") == 1500 and got[1].count("[IP]") == 1500 and got[2] == "plain" and not brute(got[1])


def test_privacy_of_edge_rows(edges, empty):
    out = privacy.sanitised(edges)
    assert out.columns == edges.columns
    before, after = ({(str(r.doc_id), r.text, r._row) for r in df.collect()} for df in (edges, out))
    assert before == after
    assert privacy.sanitised(empty).count() == 0 and privacy.all_spans(empty).count() == 0


def test_overlapping_spans_become_one_gap(spark):
    df = spark.createDataFrame([(1, "ring +1.22.33.44.555 now, a@b.co.")], "doc_id long, text string")
    assert privacy.sanitised(df).first().text in ("ring [PHONE] now, [EMAIL].", "ring [IP] now, [EMAIL].")


@pytest.fixture(scope="module")
def mixed_rows(spark, data, small):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = mixing.classifier(small, mixing.language_labels(small, labels))
    return model, mixing.with_posteriors(small, model)


def buckets_of(spark, texts):
    """Word -> bucket, and the words of each text."""
    words = {k: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w] for k, t in texts.items()}
    every = spark.createDataFrame([(w,) for w in sorted({w for x in words.values() for w in x})], "w string")
    return {r.w: r.b for r in every.select("w", F.pmod(F.xxhash64("w"), F.lit(mixing.BUCKETS)).alias("b")).collect()}, words


def brute_posteriors(spark, data, texts):
    """Tokens and posteriors of every text by the docstring: all labelled rows are in the sample here."""
    bucket, words = buckets_of(spark, texts)
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    marked = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").collect()} & {k for k, x in lang.items() if x}
    domains = sorted({lang[k] for k in marked})
    counts = np.zeros((mixing.BUCKETS, len(domains)))
    for k in marked:
        for w in words[k]:
            counts[bucket[w], domains.index(lang[k])] += 1
    logs = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * mixing.BUCKETS)) * (counts.sum(1, keepdims=True) > 0)
    prior = np.log([sum(lang[k] == d for k in marked) / len(marked) for d in domains])
    n, p = {}, {}
    for k, x in words.items():
        total = prior + logs[[bucket[w] for w in x]].sum(0)
        e = np.exp(total - total.max())
        n[k], p[k] = len(x), e / e.sum()
    return domains, n, p


def test_mixing_query_against_brute_force(spark, data, texts):
    """op5 again in numpy: counts, posteriors, and the rates, whose expected totals are on target."""
    domains, n, p = brute_posteriors(spark, data, texts)
    rows = {r.doc_id: r for r in QUERIES["op5_soft_mixing"](spark, data).collect()}
    assert set(rows) == set(texts)
    for k, r in rows.items():
        assert r.n_tokens == n[k] and np.allclose([r[f"p_{d}"] for d in domains], p[k], atol=2e-6)
    keys = sorted(texts)
    size, post = np.array([n[k] for k in keys], float), np.array([p[k] for k in keys])
    aim = np.array([mixing.TARGETS[d] for d in domains]) * size.sum()
    rates, gap = plain_rates(size, post, aim, 0.0)
    assert np.allclose([rows[k].rate for k in keys], rates, atol=1e-5)
    assert all(r.gap == pytest.approx(gap, abs=1e-9) and r.gap <= mixing.TOLERANCE for r in rows.values())


def plain_rates(n, p, aim, least):
    """Projected gradient with the docstring's step sizes, over arrays."""
    inverse = np.linalg.pinv((p * n[:, None]).T @ p, rcond=1e-12, hermitian=True)
    x, size, misfits, best = np.ones(len(n)), 1.0, [], None
    while True:
        gap = (x * n) @ p - aim
        misfits.append(gap @ inverse @ gap)
        if best is None or misfits[-1] < best[0]:
            best = (misfits[-1], x, np.abs(gap).max() / aim.sum())
        if np.abs(gap).max() <= mixing.TOLERANCE * aim.sum() or len(misfits) > mixing.WINDOW and min(misfits[-mixing.WINDOW :]) >= 0.999 * min(misfits[: -mixing.WINDOW]):
            return best[1], best[2]
        if len(misfits) > mixing.WINDOW and misfits[-1] > max(misfits[-mixing.WINDOW - 1 : -1]):
            size = 1.0
        new = np.maximum(least, x - size * (p @ (inverse @ gap)))
        change = (new * n) @ p - (x * n) @ p
        bent, length = change @ inverse @ change, (n * (new - x) ** 2).sum()
        if length <= 1e-12 * n.sum():
            return best[1], best[2]
        size = min(max(length / bent, 1.0), 1e4) if bent > 0 else 1.0
        x = new


def test_rates_meet_targets_and_equal_plain_iteration(spark):
    """Half of the rows soft, one domain with 70 % of all tokens, targets far away: many steps with rates at their least."""
    rng = np.random.default_rng(4)
    k, rows = 4, 600
    n = rng.integers(0, 2000, rows).astype(float)
    p = np.eye(k)[rng.choice(k, rows, p=[0.7, 0.1, 0.1, 0.1])]
    soft = rng.random(rows) < 0.5
    p[soft] = 0.6 * rng.dirichlet(np.full(k, 0.6), soft.sum()) + 0.4 * p[soft]
    table = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(rows)], "key long, n long, p0 double, p1 double, p2 double, p3 double")
    domains = ["a", "b", "c", "d"]
    for share, total, least in (([0.05, 0.45, 0.25, 0.25], None, 0.0), ([0.7, 0.1, 0.1, 0.1], n.sum() * 1.05, 0.9)):
        rate, totals, gap = mixing.fitted(table, domains, dict(zip(domains, share, strict=True)), total, least)
        x = table.select("key", rate.alias("x")).toPandas().sort_values("key")["x"].to_numpy(float)
        aim = np.array(share) * (total or n.sum())
        assert x.min() >= least - 1e-12 and np.allclose((x * n) @ p, [totals[d] for d in domains], rtol=1e-9)
        y, left = plain_rates(n, p, aim, least)
        assert np.allclose((x * n) @ p, (y * n) @ p, rtol=1e-3) and gap == pytest.approx(left, abs=1e-4)
        if not least:  # these targets can be met
            assert gap <= mixing.TOLERANCE
        else:  # these can't: no plain small step makes the misfit notably smaller
            inverse = np.linalg.inv((p * n[:, None]).T @ p)
            misfit = lambda z: ((z * n) @ p - aim) @ inverse @ ((z * n) @ p - aim)
            z = x
            for _ in range(200):
                z = np.maximum(least, z - p @ inverse @ ((z * n) @ p - aim))
            assert misfit(z) >= 0.98 * misfit(x)


def test_steps_that_run_out_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 2)
    rows = spark.createDataFrame([(i, 100, 0.9 - 0.1 * (i % 3), 0.1 + 0.1 * (i % 3)) for i in range(20)], "key long, n long, p0 double, p1 double")
    with pytest.raises(ArithmeticError):
        mixing.fitted(rows, ["a", "b"], {"a": 0.75, "b": 0.25}, total=9000.0, least=3.0)


def test_mixed_keeps_every_row(spark, data, small):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    out = mixing.mixed(small, mixing.language_labels(small, labels), mixing.TARGETS)
    assert out.columns == small.columns
    assert out.select("doc_id").distinct().count() == small.count() and out.count() > small.count()


def test_mixing_of_edge_rows(spark, edges, empty):
    labelled = spark.createDataFrame([(0, "en"), (4, "de"), (None, "fr"), (7, None)], "key long, domain string")
    for marks in (labelled, labelled.limit(0)):
        for docs in (edges, empty):
            out = mixing.mixed(docs, marks, {"en": 0.5, "de": 0.5})
            assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
    with pytest.raises(ValueError):
        mixing.fitted(mixing.with_posteriors(edges, mixing.classifier(edges, labelled)), ["en", "de"], {"xx": 1.0})


def brute_repeats(spark, data, texts):
    """How often the mixing stage repeats each document, by the docstring."""
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    marked = {r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").collect()} & {k for k in texts if lang[k]}
    bucket, words = buckets_of(spark, texts)
    domains = sorted({lang[k] for k in marked})
    counts = np.zeros((mixing.BUCKETS, len(domains)))
    for k in marked:
        for w in words[k]:
            counts[bucket[w], domains.index(lang[k])] += 1
    logs = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * mixing.BUCKETS)) * (counts.sum(1, keepdims=True) > 0)
    prior = np.log([sum(lang[k] == d for k in marked) / len(marked) for d in domains])
    keys = sorted(texts)
    total = np.array([prior + logs[[bucket[w] for w in words[k]]].sum(0) for k in keys])
    p = np.exp(total - total.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    n = np.array([len(words[k]) for k in keys], float)
    goals = np.array([mixing.TARGETS.get(d, 0) for d in domains])
    share = goals / goals.sum()
    have = n @ p
    rates, _ = plain_rates(n, p, share * max(h / s for h, s in zip(have, share, strict=True) if s > 0), 1.0)
    table = spark.createDataFrame([(k, texts[k]) for k in keys], "key long, text string").withColumn("h", F.xxhash64("text"))
    chance = {r.key: r.c for r in table.select("key", (F.pmod(F.xxhash64(F.lit(29), "key", "h"), F.lit(1_000_000)) / 1e6).alias("c")).collect()}
    return {k: max(1, int(np.floor(x)) + (chance[k] < x - np.floor(x))) for k, x in zip(keys, rates.tolist(), strict=True)}


def test_pipeline_of_edge_rows(spark, edges, data, tmp_path):
    """Nulls, repeated rows, empty and very long texts, clashing names, and an empty table, through all five stages."""
    import corpus_pipeline as pipeline

    marks = [(0, 1, 0), (4, 0, 0), (7, 1, 0), (5, 0, 0), (9, 1, 1)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, docs in (("some", edges), ("none", edges.limit(0))):
        for step, (_, stage) in enumerate(pipeline.STAGES):
            before = {r.doc_id for r in docs.select("doc_id").collect()}
            columns = docs.columns
            docs = pipeline.common.written(stage(spark, docs, str(tmp_path)), f"edge-{name}")
            after = {r.doc_id for r in docs.select("doc_id").collect()}
            assert after <= before and (step == 4 or docs.columns == columns)
            assert step in (0, 1) or after == before
        assert name == "some" or docs.count() == 0


def test_pipeline_stages(spark, data, small):
    import corpus_pipeline as pipeline

    columns, docs, seen = small.columns, small, []
    for name, stage in pipeline.STAGES[:4]:
        docs = pipeline.common.written(stage(spark, docs, data), "test-stage")
        assert docs.columns == columns
        seen.append({r.doc_id: r.text for r in docs.collect()})
    scores = {r.doc_id: r.predicted for r in QUERIES["op1_nbsvm_quality"](spark, data).collect()}
    assert set(seen[0]) == {k for k, y in scores.items() if y}
    from test_neardup import brute as near

    _, component = near(seen[0])
    assert set(seen[1]) == {k for k in seen[0] if component[k] == k}
    assert set(seen[2]) == set(seen[1]) == set(seen[3])
    for k, t in seen[1].items():
        assert (seen[2][k] != t) == bool(brute(t)) and not brute(seen[2][k])
    counted = docs.groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in counted} == brute_repeats(spark, data, seen[2])
    rows = pipeline.run(spark, data)
    got = rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert got <= 2048 and {r.doc_id for r in rows.collect()} == set(seen[3])
