"""Quality rules with thresholds whose risk is controlled on labelled documents.

DataFrame and SQL functions only.  Every count is taken over whole texts.

Two layers decide.  The base layer fails a document with fewer than 20 words or
with more than 30 % of its words in 8-word windows that occur twice or more.
The second layer has four scores; a document goes if a score is above its cutoff.
A cutoff is taken per stratum (``lang``) from a fixed grid, by fixed-sequence
testing: cutoffs are tried from the loosest to the strictest, and the last one
holds for which, as for all before it, the labelled good documents prove by an
exact binomial test that at most ``alpha / 4`` of the stratum's good documents are
rejected.  A sequence that stops at its first failure spends its level once,
however long its grid, so the level of a test is ``delta`` divided by the number of
sequences (scores times strata), and all chosen cutoffs hold together with
probability 1 - delta.  Good documents are those that pass the base layer: what
that rejects is fixed by its rules and not part of the guarantee.  A stratum
without enough labels to prove anything has no cutoff, and nothing in it is
rejected by layer 2; with four strata a score needs 1,151 labelled good documents
of which it rejects none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8

#: Share of good documents that layer 2 may reject in a stratum, and the chance that any cutoff breaks that.
ALPHA, DELTA = 0.02, 0.05

#: Score (an integer) -> cutoffs that may be chosen; a document above the cutoff goes.
GRID = {
    "symbols": [50, 100, 200, 300, 400],  # symbols per 1000 characters of words
    "dup_lines": [300, 400, 500, 600, 700],  # repeated lines per 1000 lines
    "repeats": [150, 200, 250],  # words in repeated windows per 1000 words
    "word_length": [120, 150, 200, 300, 500],  # tenths of a character per word
}

#: Strata up to which the table of cutoffs is broadcast; beyond, it is joined by its key.
BROADCAST_STRATA = 10_000


def base_counts(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, stratum, n_words, n_lines and the base counts of each row.

    A null text counts as empty.  Rows are judged one by one: repeated rows and
    null ids keep their rows.  ``more`` columns of ``docs`` go with their row.
    """
    names = docs.select(*more).columns if more else []
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.col("lang").alias("stratum"), text.alias("t"), *more)
    rows = rows.select(
        "doc_id",
        "stratum",
        F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        *names,
    )
    rows = rows.select(
        "doc_id",
        "stratum",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
        *names,
    )
    # Hashes of 2, 4 and then 8 words: each step joins a window with the one that follows it.
    step, span = rows, 1
    while span < WINDOW:
        n = F.greatest(F.size("h") - F.lit(span), F.lit(0))
        pairs = F.zip_with(F.slice("h", F.lit(1), n), F.slice("h", F.lit(span + 1), n), lambda a, b: F.xxhash64(a, b))
        step = step.withColumn("h", pairs)
        span *= 2
    step = step.withColumn("twice", F.size(F.array_distinct("h")) < F.size("h"))
    # Only where a window recurs: (hash, place) in order of hash, so equal windows are neighbours.
    byhash = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    step = step.withColumn("s", F.when(F.col("twice"), byhash)).drop("h")
    near = lambda e, j: (e["h"] == F.get(F.col("s"), j - 1)["h"]) | (e["h"] == F.get(F.col("s"), j + 1)["h"])
    places = F.transform("s", lambda e, j: F.when(F.coalesce(near(e, j), F.lit(False)), e["i"]))
    step = step.withColumn("p", F.array_sort(F.filter(places, lambda x: x.isNotNull()))).drop("s")
    # A window covers its words up to the next recurring window, at most its own length.
    covered = F.transform("p", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("p"), j + 1) - x, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return step.withColumn("n_repeat_words", F.coalesce(F.when(F.col("twice"), total), F.lit(0)).cast("long")).drop("p", "twice")


def scored(counts: DataFrame) -> DataFrame:
    """Adds base_failed and the four integer scores."""
    ratio = lambda by, a, b: F.expr(f"cast(least(coalesce(try_divide({by} * {a}, {b}), 0), 100000) as bigint)")
    return counts.select(
        "*",
        F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words").alias("base_failed"),
        ratio(1000, "n_symbols", "word_chars").alias("symbols"),
        ratio(1000, "n_dup_lines", "n_lines").alias("dup_lines"),
        ratio(1000, "n_repeat_words", "n_words").alias("repeats"),
        ratio(10, "word_chars", "n_words").alias("word_length"),
    )


def binomial_tail(n: str, k: str, p: float) -> str:
    """SQL for P(Binomial(n, p) <= k); 1 at once where k is at least the mean."""
    step = f"a.t + ln(({n} - j + 1) / j) + ln({p}D / (1 - {p}D))"
    return (
        f"case when {k} >= {p}D * {n} then 1D else aggregate("
        f"if({k} < 1, array(), sequence(1L, greatest({k}, 1L))), "
        f"named_struct('t', {n} * ln(1 - {p}D), 's', exp({n} * ln(1 - {p}D))), "
        f"(a, j) -> named_struct('t', {step}, 's', a.s + exp({step})), a -> a.s) end"
    )


def cutoffs(scores: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with a column per score: the chosen cutoff, null if none is proved.

    Labelled good documents are those whose labels all say quality 1 and that
    pass the base layer; a repeated label counts once.  What is collected per
    stratum is a histogram of each score, not rows.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    seen = scores.where("not base_failed").join(good, "doc_id", "left_semi")
    names = list(GRID)
    stack = ", ".join(f"'{n}', {n}" for n in names)
    bars = seen.selectExpr("stratum", f"stack({len(names)}, {stack}) as (rule, score)").groupBy("stratum", "rule", "score").agg(F.count(F.lit(1)).alias("c"))
    grid = F.expr("case rule " + " ".join(f"when '{k}' then array({', '.join(map(str, v))})" for k, v in GRID.items()) + " end")
    tests = bars.withColumn("cutoff", F.explode(grid)).groupBy("stratum", "rule", "cutoff")
    tests = tests.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("score") > F.col("cutoff"), F.col("c")).otherwise(0)).alias("k"))
    loosest = "case rule " + " ".join(f"when '{k}' then {max(v)}" for k, v in GRID.items()) + " end"
    proof = F.expr(f"({binomial_tail('n', 'k', alpha / len(names))}) <= {delta}D / count_if(cutoff = {loosest}) over ()")
    chosen = tests.withColumn("proved", proof).withColumn("proved", F.expr("bool_and(proved) over (partition by stratum, rule order by cutoff desc)"))
    return chosen.groupBy("stratum").agg(*[F.min(F.when(F.expr(f"proved and rule = '{n}'"), F.col("cutoff"))).alias(f"max_{n}") for n in names])


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, scratch: Scratch | None = None, more: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, n_words, the base counts, base_failed, kept and the stratum's proved cutoffs (max_) of every row.

    An empty table gives an empty result; without labels only the base layer
    rejects, and the cutoffs are null.  Extra columns of either table are not looked at; ``more`` columns of
    ``docs`` come last.
    """
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    scores = scratch.keep(scored(base_counts(docs, *more)), "scores")
    table = scratch.keep(cutoffs(scores, labels, alpha, delta), "cutoffs")
    if table.count() <= BROADCAST_STRATA:
        table = F.broadcast(table)
    above = F.expr(" or ".join(f"coalesce({n} > max_{n}, false)" for n in GRID))
    table = table.withColumnRenamed("stratum", "_stratum")
    out = scores.join(table, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~above).alias("kept"), *[f"max_{n}" for n in GRID], *(docs.select(*more).columns if more else []))


def keep_good(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; each row goes by its own verdict, whatever its id."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole")
    return judge(docs, labels, scratch=scratch, more=(whole,)).where("kept").select("_whole.*")
