"""Mixing sources to target weights by fitting token budgets to exact lengths.

Each source gets a share of the budget by weight, at most ``cap`` times its own
size; what it can't take is shared again by weight.  A target of t times the
size of a source means its documents are taken floor(t) times in full, and the
rest of the target is fitted: documents are counted by exact length, each length
gives its proportional part, rounded by largest remainders, so short and long
documents are taken alike, and a bounded knapsack over the counts that are left
closes the gap.  Which documents of a length are taken is decided by a seeded hash
of their ids and texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import kernels
from tidemark.llm.scratch import Scratch, free_name

SEED = 17
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2

#: Longest documents that the gap left to the knapsack can hold.
ROOM = 4
#: Parts into which the documents of one source and length are dealt, so that a hot length is ranked in parts.
DEALS = 1024
#: Sources, and quotas of deals, up to which their table is broadcast; beyond, it is joined.
BROADCAST_SOURCES, BROADCAST_QUOTAS = 10_000, 20_000


def sizes(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size (words) and ``more`` of every row; a null text has size 0."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select("doc_id", "source", words.alias("size"), *more)


def _dealt(seed: int) -> Column:
    """The seeded place of a row among those of its length; rows of one id, or none, are told apart by their texts."""
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row per source: place (1 for the first by code point, null last), source, source_size, target.

    Water filling: the sources in order of what their weight lets them take at
    most; all before the first that the remaining budget does not fill are
    capped, the others share by weight.
    """
    weight = "case (place - 1) % {} {} end".format(len(weights), " ".join(f"when {i} then {w}D" for i, w in enumerate(weights)))
    table = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = table.selectExpr("source", "source_size", "row_number() over (order by source asc nulls last) as place")
    table = table.selectExpr("*", f"{weight} as w", f"double({cap} * source_size) as most").withColumn("ratio", F.expr("most / w"))
    before = "over (order by ratio, place rows between unbounded preceding and 1 preceding)"
    table = table.selectExpr("*", f"({share}D * sum(source_size) over () - coalesce(sum(most) {before}, 0D)) / (sum(w) over () - coalesce(sum(w) {before}, 0D)) as level")
    table = table.selectExpr("*", "min_by(level, if(level <= ratio, struct(ratio, place), null)) over () as fill")
    return table.selectExpr("place", "source", "source_size", "least(most, coalesce(fill, ratio) * w) as target")


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come to ``budget`` or just below it."""
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    share = counts * (budget / total)
    take = np.minimum(counts, np.floor(share).astype(np.int64))
    while (gap := budget - int((lengths * take).sum())) < 0:  # only if the division rounded up
        take[np.argmax(take > 0)] -= 1
    # What rounding down has left goes to the lengths that lost most by it, one document each (lengths that lost as much in the
    # order of a hash), down to a few of the longest documents; of these sums the knapsack finds the nearest.
    order = np.lexsort((kernels.mix(lengths.astype(np.uint64)), np.round(take - share, 9)))
    room = ROOM * int(lengths.max())
    for i in order.tolist():
        if take[i] < counts[i] and gap - int(lengths[i]) >= room:
            take[i] += 1
            gap -= int(lengths[i])
    out = np.zeros(len(lengths), np.int64)
    out[order] = _knapsack(lengths[order], (counts - take)[order], gap)
    return take + out


def _knapsack(lengths: np.ndarray, counts: np.ndarray, gap: int) -> np.ndarray:
    """Bounded knapsack: the sum nearest to ``gap`` from below, as documents per length.

    The reachable sums are the bits of one number; each length goes in as
    bundles of 1, 2, 4, ... documents.  For each sum the bundle that first
    reached it is kept: taking it off leaves a sum reached by earlier bundles.
    """
    reach, full = 1, (1 << (gap + 1)) - 1
    first = np.full(gap + 1, -1, np.int32)
    bundles: list[tuple[int, int]] = []
    for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        left, n = min(count, gap // length) if length else 0, 1
        while left > 0 and not reach >> gap & 1:
            n = min(n, left)
            new = (reach << n * length) & full & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(gap // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(bundles)
                bundles.append((i, n))
                reach |= new
            left -= n
            n *= 2
    out = np.zeros(len(lengths), np.int64)
    at = reach.bit_length() - 1
    while at:
        i, n = bundles[first[at]]
        out[i] += n
        at -= n * int(lengths[i])
    return out


def _fit_group(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size")
    take = fit(rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), int(rows["rest"].iloc[0]))
    return pd.DataFrame({"place": rows["place"], "size": rows["size"], "take": take})


def mix(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, scratch: Scratch | None = None, more: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, times, taken of every row of ``docs``.

    ``times`` says how often the mix takes the row.  Null texts have no words and
    are taken as often as their source is in full; a null source is a source of
    its own.  Rows with one id and equal rows are told apart by nothing: as many
    of them are taken as the budget wants.  The same rows and seed give the same
    mix.  A source's lengths are fitted in one task, from one row per distinct
    length; its documents never meet in one task.  ``more`` columns of ``docs`` come last.
    """
    names = docs.select(*more).columns if more else []
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    place = free_name(docs, "_dealt")
    sized = scratch.keep(sizes(docs, _dealt(seed).alias(place), *more), "sizes")
    goals = scratch.keep(targets(sized, weights, share, cap).selectExpr("*", "coalesce(cast(floor(try_divide(target, source_size)) as int), 0) as passes"), "goals")
    goals = goals.withColumn("rest", F.floor(F.expr("target - passes * source_size")).cast("long"))
    near = F.broadcast(goals) if goals.count() <= BROADCAST_SOURCES else goals
    near = near.withColumnRenamed("source", "_source")
    dealt = F.col(place)
    rows = sized.join(near, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "size", "place", "source_size", "target", "passes", "rest", dealt.alias("h"), F.pmod(dealt, F.lit(DEALS)).cast("int").alias("deal"), *names)

    bylength = rows.where("rest > 0 and size > 0").groupBy("place", "size", "rest").agg(F.count(F.lit(1)).alias("n"))
    takes = bylength.groupBy("place").applyInPandas(_fit_group, "place int, size bigint, take bigint")
    deals = rows.where("rest > 0 and size > 0").groupBy("place", "size", "deal").agg(F.count(F.lit(1)).alias("n"))
    before = "coalesce(sum(n) over (partition by place, size order by deal rows between unbounded preceding and 1 preceding), 0)"
    quota = deals.join(takes, ["place", "size"]).selectExpr("place", "size", "deal", "n", f"greatest(0, least(n, take - {before})) as quota")
    quota = scratch.keep(quota.where("quota > 0"), "quota")
    quota = F.broadcast(quota) if quota.count() <= BROADCAST_QUOTAS else quota.hint("merge")
    out = rows.join(quota, ["place", "size", "deal"], "left")
    out = scratch.keep(out.select("doc_id", "size", "place", "source_size", "target", "passes", "deal", "h", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("quota", F.lit(0)).alias("quota"), *names), "rows")
    # Only the deal in which a length's quota ends is ranked.
    ranked = out.where("quota > 0 and quota < n").withColumn("more", F.expr("int(row_number() over (partition by place, size, deal order by h, doc_id) <= quota)"))
    whole = out.where("quota = 0 or quota = n").withColumn("more", F.expr("int(quota > 0)"))
    both = whole.unionByName(ranked).withColumn("times", F.col("passes") + F.col("more"))
    return both.select("doc_id", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).cast("long").alias("taken"), *names)


def repeat_rows(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all columns.

    Rows that share an id, or have none, are told apart by a digest of their columns;
    of equal rows as many are taken as the mix takes of them together.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    doc, row, n, copy = (free_name(docs, x) for x in ("_doc", "_row", "_times", "_copy"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    digest = F.xxhash64(*hashed, *[x.isNull() for x in hashed])
    taken = mix(docs, scratch=scratch, more=(digest.alias("_digest"),))
    taken = taken.groupBy(F.col("doc_id").alias(doc), F.col("_digest").alias(row)).agg(F.sum("times").alias("t"), F.count(F.lit(1)).alias("c"))
    taken = scratch.keep(taken, "times")
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (digest == F.col(row))

    def repeated(rows: DataFrame) -> DataFrame:
        out = rows.withColumn(copy, F.explode(F.expr(f"if(coalesce({n}, 1) < 1, array(), sequence(1L, coalesce({n}, 1L)))")))
        return out.select(*columns)

    out = repeated(docs.join(taken.selectExpr(doc, row, f"t div c as {n}"), same, "left"))
    # Of c equal rows t mod c are taken once more: one of them so many times.
    rest = taken.where("t % c > 0").selectExpr(doc, row, f"t % c as {n}")
    if rest.isEmpty():
        return out
    return out.unionAll(repeated(docs.join(rest, same).dropDuplicates([doc, row])))
