"""Quality rules as a short-circuit cascade over word and line statistics.

DataFrame functions only; all statistics of a text come from its own row, so
nothing is shuffled. Rules are ordered by rejections per cost, both estimated
on a sample of about ``SAMPLE_ROWS`` rows: a rule's selectivity is the share
that it rejects, its cost the time of an aggregate that runs it alone, warm,
less the time of the same aggregate without it. What is timed is what the
cascade runs: where the statistics are columns anyway (``judge``), the rules
over them, else (``keep_good``) the rules with the statistics that they need.
A text leaves at the first rule that rejects it. The order changes the time
and never the verdict.

Defined results. A null, empty or word-less text has zero words and fails the
base rule. Repeated rows are judged each; other input columns are ignored; an
empty table gives no rows and needs no sample. Words and eight-word windows
are named by 64-bit hashes.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.llm.columns import let, words
from tallgrass.llm.common import Workspace

WINDOW = 8
#: Rows, about, of the sample that orders the cascade; it decides nothing else.
SAMPLE_ROWS = 2000
#: Timed runs of a rule, after one to warm up; the shortest counts.
RUNS = 2
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def repeated_words(w: Column) -> Column:
    """Words inside windows of eight that occur twice or more in the text."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(p: Column) -> Column:
            flagged = F.transform(
                p,
                lambda x, j: F.when(
                    F.coalesce(F.get(p, j - 1)["h"] == x["h"], F.lit(False))
                    | F.coalesce(F.get(p, j + 1)["h"] == x["h"], F.lit(False)),
                    x["i"],
                ),
            )
            return F.sort_array(F.filter(flagged, lambda i: i.isNotNull()))

        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            let(pairs, twice),
            start,
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
            lambda acc: acc["n"],
        )

    def windows(v: Column) -> Column:
        # by place and not by slice, which copies the whole array each time
        return F.transform(
            F.sequence(F.lit(0), F.size(v) - WINDOW), lambda i: F.xxhash64(*[F.get(v, i + k) for k in range(WINDOW)])
        )

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    named = F.transform(w, lambda x: F.xxhash64(x))
    return let(named, lambda v: F.when(F.size(v) >= WINDOW, let(windows(v), count)).otherwise(0)).cast("long")


def _lines(body: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(body, "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))


def statistics(body: Column, w: Column) -> dict[str, Column]:
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.regexp_replace(body, "[ \\t-\\r]+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(body, "[^#*$%&|<>]+", "")).cast("long"),
        "lines": let(_lines(body), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))),
        "n_repeat_words": repeated_words(w),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rules(body: Column, w: Column, known: dict[str, Column] | None = None) -> dict[str, Column]:
    """Rejecting rules over a text and its words. Each computes what it needs,
    unless ``known`` gives the statistics."""
    own = known or statistics(body, w)
    n, chars = own["n_words"], own["word_chars"]
    letters = F.length(F.regexp_replace(body, "\\P{L}+", ""))
    capitals = F.length(F.regexp_replace(body, "\\P{Lu}+", ""))
    return {
        "few_words": n < MIN_WORDS,
        "repeated_words": 100 * own["n_repeat_words"] > MAX_REPEAT_PERCENT * n,
        "symbols": 10 * own["n_symbols"] > n,
        "word_length": let(chars, lambda c: (c < 2 * n) | (c > 15 * n)),
        "duplicate_lines": let(own["lines"], lambda x: (x["dup"] >= 3) & (100 * x["dup"] > 40 * x["n"])),
        "capitals": let(letters, lambda x: (x >= 40) & (10 * capitals > 5 * x)),
        "letters": 2 * letters < chars,
        "few_distinct_words": (n < 400) & (10 * F.size(F.array_distinct(w)) < n),
    }


BASE_RULES = ("few_words", "repeated_words")


def _over_words(text: Column, verdict) -> Column:
    """``verdict(body, words)`` of a text; both are evaluated once."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    return let(body, lambda b: let(words(b), lambda w: verdict(b, w)))


def _cascade(table: dict[str, Column], order: list[str]) -> Column:
    """True where no rule rejects; after a hit no later rule is evaluated."""
    out = None
    for name in order:
        hit = F.coalesce(table[name], F.lit(False))
        out = F.when(hit, False) if out is None else out.when(hit, False)
    return out.otherwise(True)


def passes(text: Column, order: list[str]) -> Column:
    """The cascade's verdict on a text."""
    return _over_words(text, lambda b, w: _cascade(rules(b, w), order))


def order_rules(sample: DataFrame, hits: dict[str, Column], base: Column) -> list[str]:
    """Names of ``hits`` by rejections per second over the sample's rows.

    ``base`` is what any rule has to compute first, as a boolean.
    """

    def timed(hit: Column) -> tuple[float, int]:
        query = sample.agg(F.count_if(hit).alias("out"))
        query.first()
        spent = []
        for _ in range(RUNS):
            began = time.perf_counter()
            out = query.first()["out"]
            spent.append(time.perf_counter() - began)
        return min(spent), out

    floor, _ = timed(base)
    rate = {}
    for name, hit in hits.items():
        cost, out = timed(F.coalesce(hit, F.lit(False)))
        rate[name] = (-out / max(cost - floor, 1e-4), cost)
    return sorted(hits, key=lambda name: (*rate[name], name))


def _sample(docs: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` texts, each row with the same chance, left in place."""
    n = docs.count()
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    return texts if n <= rows else texts.sample(rows / n, 11)


def plan_cascade(spark: SparkSession, docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[str]:
    """The order of all rules over bare texts."""
    space = Workspace(spark)
    sample = space.save(_sample(docs, rows))
    names = list(rules(F.lit(""), F.array(F.lit(""))))
    hits = {name: _over_words(F.col("body"), lambda b, w, name=name: rules(b, w)[name]) for name in names}
    order = order_rules(sample, hits, _over_words(F.col("body"), lambda b, w: F.size(w) < 0))
    space.drop(sample)
    return order


def _measured(texts: DataFrame) -> DataFrame:
    """``texts`` (with a column body) with words and statistics."""
    found = texts.withColumn("w", words(F.col("body")))
    return found.withColumns(statistics(F.col("body"), F.col("w")))


def _known_rules() -> dict[str, Column]:
    own = {name: F.col(name) for name in ("n_words", "word_chars", "n_symbols", "lines", "n_repeat_words")}
    return rules(F.col("body"), F.col("w"), own)


def plan_remainder(spark: SparkSession, docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[str]:
    """The order of the rules after the base ones over known statistics."""
    space = Workspace(spark)
    sample = space.save(_measured(_sample(docs, rows)))
    hits = {name: hit for name, hit in _known_rules().items() if name not in BASE_RULES}
    order = order_rules(sample.where(~base_failed()), hits, F.length("body") + F.size("w") < 0)
    space.drop(sample)
    return order


def judge(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept) for each row.

    The statistics are asked for each row; of the other rules' measures, each
    text gets those up to the first rule that rejects it.
    """
    order = plan_remainder(spark, docs)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    found = _measured(plain).withColumn("base_failed", base_failed())
    kept = F.when(F.col("base_failed"), False).otherwise(_cascade(_known_rules(), order))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", F.col("lines.dup").cast("long").alias("n_dup_lines"),
        "n_repeat_words", "base_failed", kept.alias("kept"),
    )


def keep_good(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass all rules, with their own columns."""
    return docs.where(passes(F.col("text"), plan_cascade(spark, docs)))
