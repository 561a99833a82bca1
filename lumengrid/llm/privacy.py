"""Operator 6: information-theoretic sanitisation, with DataFrame functions only.

Base spans are e-mail addresses, IP addresses, payment card and phone numbers, found by regular expressions
without nested repetition (each scans a text once, whatever its length).  Every value found is a protected
entity e.  The WORDS whole words (what stands between white space) before an occurrence and the WORDS after it,
stripped of other characters than letters at both ends, make its window, as far as they are of letters only, three
at least; equal windows of an entity count once, so copies of a passage are one piece of evidence.
Over the whole corpus, with c(t) occurrences of term t among M words,
    p(t | e) = the lower confidence bound (Wilson, CONFIDENCE standard errors) of windows of e with t / windows of e,
    p(t) = min(1, c(t) * 2 * WORDS / M),
    PMI(t; e) = log2(p(t | e) / p(t)),  IC(e) = -log2(min(1, windows of e * 2 * WORDS / M)).
A term that stands in LEAST_WINDOWS different windows of e at least is sanitised wherever it stands in a document
with e: where it gives away the share REMOVED of e's information or more, PMI >= REMOVED * IC, it is removed to
`[TERM]`; from the share DISCLOSURE on, it is generalised to its class, `[NAME]` with a capital, `[WORD]` without.
`sanitised` puts the kind of a base span in its place.

Defined results: a null text is an empty one; overlapping spans are one gap with the kind of the first; of two
shares of a term in a document the larger holds; repeated rows count each (their windows once); an empty table gives
no rows; texts are whole, however long and however many spans they have; further columns travel along in
`all_spans` and `sanitised`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS, LEAST_WINDOWS, CONFIDENCE, DISCLOSURE, REMOVED = 10, 2, 1.645, 0.5, 0.8
KINDS = ("email", "ip", "card", "phone", "term", "name", "word")
#: A text is looked at in blocks of so many characters, so that what a span costs does not grow with its text.
PIECE = 4_096
#: Characters beside a span in which its words are looked for first; where they are too few, in the next number, at last in all.
REACH = (120, PIECE)
#: Spans are gathered in arrays of so many, and these in one, so that adding a span does not copy all before it.
_GROUP = 256
_EDGE, _STOP = "\ue000", "\ue001"  # these two characters of a text become "?" first: no pattern has either
_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _marked(text: Column, pattern: str) -> Column:
    """Parts of the text: those at odd places (from 0) match the pattern."""
    return F.split(F.regexp_replace(text, pattern, f"{_EDGE}$0{_EDGE}"), _EDGE)


def _gathered(items: Column, state: dict[str, Column], step, kind: str) -> Column:
    """An array (of type kind) of what step gives for each item: step(state, item) is the next state and an element or null."""
    none, nones = F.array().cast(kind), F.array().cast(f"array<{kind}>")
    start = F.struct(*[v.alias(k) for k, v in state.items()], none.alias("_now"), nones.alias("_done"))

    def add(acc: Column, item: Column) -> Column:
        new, element = step(acc, item)
        full = F.size(acc["_now"]) >= _GROUP
        done = F.when(full, F.concat(acc["_done"], F.array(acc["_now"]))).otherwise(acc["_done"])
        now = F.when(full, none).otherwise(acc["_now"])
        now = F.when(element.isNotNull(), F.concat(now, F.array(element))).otherwise(now)
        return F.struct(*[v.alias(k) for k, v in new.items()], now.alias("_now"), done.alias("_done"))

    return F.aggregate(items, start, add, lambda acc: F.flatten(F.concat(acc["_done"], F.array(acc["_now"]))))


def _spans(parts: Column, kind) -> Column:
    """Spans (code points from 0, end exclusive) of the parts at odd places; kind(part) is its number, null: no span."""
    sized = F.transform(parts, lambda x, i: F.struct(F.length(x).alias("n"), F.when(i % 2 == 1, kind(x)).cast("int").alias("kind"), F.when(i % 2 == 1, x).alias("value")))

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        end = acc["at"] + x["n"]
        span = F.struct(acc["at"].alias("start"), x["kind"].alias("kind"), end.alias("end"), x["value"].alias("value"))
        return {"at": end}, F.when(x["kind"].isNotNull(), span)

    return _gathered(sized, {"at": F.lit(0)}, step, _SPANS)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind."""
    none = F.array().cast(_SPANS)
    clean = F.replace(F.replace(text, F.lit(_EDGE), F.lit("?")), F.lit(_STOP), F.lit("?"))
    # a full stop that no domain can go on after is marked, so that a domain is one run of characters
    local = f"[A-Za-z0-9._%+{_STOP}-]"
    dotted = F.regexp_replace(clean, r"\.(?![A-Za-z0-9-])", _STOP)
    email = _spans(_marked(dotted, rf"(?:\G|(?<!{local})){local}++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"), lambda x: F.lit(0))
    ip = _spans(_marked(clean, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"), lambda x: F.when(F.concat(x, F.lit(".")).rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])\.){4}$"), 1))
    # separators that stand between two digits stay, the others are marked: a number is one run
    joined = F.regexp_replace(clean, "(?<![0-9])[ -]|[ -](?![0-9])", _STOP)
    digits = lambda x: F.regexp_replace(x, "[^0-9]", "")
    card = _spans(_marked(joined, "[0-9][0-9 -]++"), lambda x: F.when(F.length(digits(x)).between(12, 19) & F.call_function("luhn_check", digits(x)), 2))
    phone = _spans(_marked(clean, r"\+[0-9][ ().0-9-]+[0-9]"), lambda x: F.when(F.length(digits(x)).between(9, 15), 3))
    found = F.concat(
        F.when(F.contains(text, F.lit("@")), email).otherwise(none),
        F.when(text.rlike(r"[0-9]\.[0-9]"), ip).otherwise(none),
        F.when(text.rlike("[0-9][0-9 -]{10}"), card).otherwise(none),
        F.when(F.contains(text, F.lit("+")), phone).otherwise(none),
    )
    return F.when(text.rlike("[@0-9]"), F.array_sort(found)).otherwise(none)


def with_base_spans(docs: DataFrame, text: str, all_texts: bool) -> DataFrame:
    """docs with a row number `_row` and its base spans `_spans`, as a table; texts without spans become null unless all_texts."""
    found = docs.withColumn("_spans", base_spans(F.coalesce(text, F.lit("")))).withColumn("_row", F.monotonically_increasing_id())
    if not all_texts:
        found = found.withColumn(text, F.when(F.size("_spans") > 0, F.col(text)))
    return common.written(found, "base-spans")


def lower_bound(both: Column, windows: Column) -> Column:
    """Of the share both / windows: few windows prove little."""
    p, z = both / windows, CONFIDENCE
    return (p + z * z / (windows * 2) - z * F.sqrt(p * (1 - p) / windows + z * z / (windows * windows * 4))) / (1 + z * z / windows)


def _blocks(text: Column) -> Column:
    last = F.greatest(F.ceil(F.length(text) / PIECE).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * PIECE + 1, F.lit(PIECE)))


def _beside(text: Column, blocks: Column, place: Column, before: bool) -> Column:
    """The WORDS words, in lower case, that stand before (or from) a place of the text."""
    k = F.floor(place / PIECE).cast("int")
    first = F.greatest(k - 1, F.lit(0)) if before else k
    some = F.concat_ws("", F.get(blocks, first), F.when(first < k, F.get(blocks, k)) if before else F.get(blocks, k + 1))
    at = place - first * PIECE
    whole_side = first == 0 if before else k + 2 >= F.size(blocks)

    def within(string: Column, here: Column, width: Column, all_: Column) -> Column:
        cut = F.substring(string, F.greatest(here - width + 1, F.lit(1)), F.least(here, width)) if before else F.substring(string, here + 1, width)
        parts = F.split(F.lower(cut), r"\s+")
        inner = F.slice(parts, 2, F.size(parts)) if before else F.slice(parts, 1, F.size(parts) - 1)  # without the word that the cut may go through
        return F.filter(F.when(all_, parts).otherwise(inner), lambda w: w != "")

    length = F.length(text)
    out = within(text, place, length, F.lit(True))
    for width in reversed(REACH):
        ends = whole_side & (at <= width if before else F.length(some) - at <= width)
        near = within(some, at, F.lit(width), ends)
        out = F.when(ends | (F.size(near) >= WORDS), near).otherwise(out)
    n = F.size(out)
    return F.slice(out, F.greatest(n - WORDS + 1, F.lit(1)), F.lit(WORDS)) if before else F.slice(out, 1, WORDS)


def occurrences(found: DataFrame, text: str) -> DataFrame:
    """`_row`, `entity` and window `words` (sorted, distinct) of every base span, as a table."""

    def one(s: Column, blocks: Column) -> Column:
        value = F.when(s["kind"] == 0, F.lower(s["value"])).otherwise(F.regexp_replace(s["value"], "[^0-9]", ""))
        beside = F.concat(_beside(F.col(text), blocks, s["start"], True), _beside(F.col(text), blocks, s["end"], False))
        bare = F.transform(beside, lambda w: F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}]+$", ""))
        words = F.array_sort(F.array_distinct(F.filter(bare, lambda w: w.rlike(r"^\p{L}{3,}$"))))
        return F.struct(F.concat_ws(":", s["kind"].cast("string"), value).alias("entity"), words.alias("words"))

    # the text is cut into blocks once for all its spans
    made = F.flatten(F.transform(F.array(_blocks(F.col(text))), lambda blocks: F.transform("_spans", lambda s: one(s, blocks))))
    seen = found.filter(F.size("_spans") > 0).select("_row", F.explode(made).alias("s"))
    return common.written(seen.select("_row", "s.entity", "s.words"), "occurrences")


def revealing_terms(docs: DataFrame, seen: DataFrame, text: str) -> DataFrame:
    """`entity`, `term` and the `share` of the entity's information that the term gives away, from DISCLOSURE on."""
    windows = seen.groupBy("entity", "words").agg(F.lit(1).alias("one")).drop("one")
    pairs = windows.select("entity", F.explode("words").alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")).filter(F.col("both") >= LEAST_WINDOWS)
    pairs = common.written(pairs, "entity-terms")
    entities = windows.groupBy("entity").agg(F.count(F.lit(1)).alias("windows")).filter(F.col("windows") >= LEAST_WINDOWS)
    tokens = docs.select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("term"))
    terms = common.written(tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term-counts")
    corpus = max(1, int(terms.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]))
    share = lambda n: F.least(F.lit(1.0), n * 2.0 * WORDS / corpus)
    scored = pairs.join(entities, "entity").join(terms, "term").withColumn("pmi", F.log2(lower_bound(F.col("both"), F.col("windows")) / share(F.col("n"))))
    content = -F.log2(share(F.col("windows")))
    scored = scored.filter(F.col("pmi") > 0).withColumn("share", F.when(content > 0, F.col("pmi") / content).otherwise(F.lit(1.0)))
    return scored.filter(F.col("share") >= DISCLOSURE).select("entity", "term", "share")


def disclosing_terms(docs: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """`_row`, `_removed` and `_general`: the terms to sanitise in each row that has any."""
    seen = occurrences(found, text)
    revealing = revealing_terms(docs, seen, text)
    revealing = common.written(revealing.groupBy("entity").agg(F.collect_set(F.struct("term", (F.col("share") >= REMOVED).alias("removed"))).alias("terms")), "disclosing")
    rows = seen.select("_row", "entity").distinct().join(revealing, "entity").groupBy("_row").agg(F.array_distinct(F.flatten(F.collect_set("terms"))).alias("t"))
    of = lambda removed: F.transform(F.filter("t", lambda x: x["removed"] == removed), lambda x: x["term"])
    return rows.select("_row", of(True).alias("_removed"), of(False).alias("_general"))


def term_spans(text: Column, removed: Column, general: Column, base: Column) -> Column:
    clean = F.replace(text, F.lit(_EDGE), F.lit("?"))
    kind = lambda x: F.when(F.array_contains(removed, F.lower(x)), 4).when(F.array_contains(general, F.lower(x)), F.when(x.rlike(r"^\p{Lu}"), 5).otherwise(6))
    found = _spans(_marked(clean, r"\p{L}++"), kind)
    return F.filter(found, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def _all_spans(docs: DataFrame, all_texts: bool) -> DataFrame:
    """Bundled docs with `_base` and `_all`: their base spans, and these with the terms that disclose them."""
    found = with_base_spans(docs, "text", all_texts)
    terms = disclosing_terms(docs, found, "text")
    some = found.filter(F.size("_spans") > 0).join(terms, "_row", "left")
    more = F.when(F.col("_removed").isNull(), F.col("_spans")).otherwise(F.array_sort(F.concat("_spans", term_spans(F.coalesce("text", F.lit("")), F.col("_removed"), F.col("_general"), F.col("_spans")))))
    none = found.filter(F.size("_spans") == 0).withColumn("_all", F.col("_spans"))
    return some.withColumn("_all", more).drop("_removed", "_general").unionByName(none).withColumnRenamed("_spans", "_base").drop("_row")


def all_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs but for text, with `_base` and `_all` (one underscore more where docs has such a column): its
    base spans, and these with the terms that disclose them."""
    found = _all_spans(common.bundled(docs, text=text), False)
    others = [F.col("rest").getField(x).alias(x) for x in docs.columns if x != text]
    return found.select(*others, F.col("_base").alias(common.fresh(docs, "_base")), F.col("_all").alias(common.fresh(docs, "_all")))


def sanitised(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of its texts replaced by its kind; null texts stay."""
    found = _all_spans(common.bundled(docs, text=text), True)
    names = F.array(*[F.lit(f"[{x.upper()}]") for x in KINDS])

    def step(acc: Column, s: Column) -> tuple[dict[str, Column], Column]:
        gap = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        return {"at": F.greatest(acc["at"], s["end"])}, F.when(s["start"] >= acc["at"], gap).otherwise(F.when(s["end"] > acc["at"], F.struct(acc["at"].alias("start"), s["end"].alias("end"), F.lit(-1).alias("kind"))))

    # gaps in order, without overlaps; what a span adds to a gap before it has no name of its own
    gaps = _gathered(F.col("_all"), {"at": F.lit(0)}, step, "array<struct<start:int,end:int,kind:int>>")

    def block(text: Column, i: Column, all_gaps: Column) -> Column:
        """A block of the text with the names of the gaps that start in it instead of their characters."""
        low, high = i * PIECE, i * PIECE + PIECE
        own = F.filter(all_gaps, lambda g: (g["start"] < high) & (g["end"] > low))

        def part(acc: Column, g: Column) -> tuple[dict[str, Column], Column]:
            kept = F.substring(text, acc["at"] - low + 1, F.greatest(g["start"] - acc["at"], F.lit(0)))
            name = F.when((g["start"] >= low) & (g["kind"] >= 0), F.element_at(names, F.greatest(g["kind"], F.lit(0)) + 1)).otherwise("")
            return {"at": F.greatest(acc["at"], g["end"])}, F.concat(kept, name)

        end = F.greatest(low, F.coalesce(F.array_max(F.transform(own, lambda g: g["end"])), low))
        return F.concat(F.array_join(_gathered(own, {"at": low}, part, "array<string>"), ""), F.substring(text, end - low + 1, F.lit(PIECE)))

    made = F.flatten(F.transform(F.array(gaps), lambda g: F.transform(_blocks(F.col("text")), lambda t, i: block(t, i, g))))
    made = F.array_join(made, "")
    return common.unbundled(found.withColumn("text", F.when(F.size("_all") > 0, made).otherwise(F.col("text"))), docs, text)


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(x) for x in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, and the terms that disclose it."""
    with common.scratch(spark) as kept:
        found = all_spans(common.documents(spark, sf_dir).select("doc_id", "text"))
        count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
        counts = [count(k).alias(f"n_{x}") for k, x in enumerate(KINDS[:4])]
        return kept(found.select("doc_id", *counts, F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.col("_all")).alias("spans")), "spans")
