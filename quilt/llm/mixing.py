"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Token shares of the sources are raised to an exponent and normalised. Bisection finds the exponent: the largest (closest to the
corpus's own shares) at which the weights reach a target entropy without any source exceeding the repetition limit. A source's weight
times the budget is realised as whole epochs and a part of one more. In an epoch, blocks of documents, and the documents in a block,
come in an order drawn from a hash of seed, epoch and id; the part is the prefix of that order that fits the budget.

Block sums are aggregated before any ordering, and only the one block that a budget cuts is ordered by document, so no task holds a
source. Tokens here are words separated by ASCII white space.

Edge cases: a null source is a source of its own; null or empty texts have no tokens and are drawn as often as whole epochs say; ties in the
hash are broken by id; rows with equal ids share their order and are drawn each; one source gets weight 1; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quilt.llm.common import WORD_SPACE, fresh, materialise, small_table

_SPACE_CLASS = "[\\x20\\x09-\\x0D]+"


def count_words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WORD_SPACE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, _SPACE_CLASS))).cast("long")


def weights(tokens: list[float], exponent: float) -> list[float]:
    """Normalised powers of the shares; sources without tokens get none."""
    total = sum(tokens)
    powers = [math.exp(exponent * math.log(t / total)) if t > 0 else 0.0 for t in tokens]
    return [p / sum(powers) for p in powers]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def choose_exponent(tokens: list[float], target_entropy: float | None = None, repetition: float | None = None, floor_one: bool = False, budget: float | None = None, steps: int = 60) -> float:
    """The exponent in [0, 1] by bisection; a lower one flattens the weights and repeats small sources more.

    ``target_entropy`` is a share of the greatest possible entropy that the weights shall reach at least; ``repetition`` bounds the epochs of every
    source and prevails. With ``floor_one`` the budget is the least that gives every source one epoch.
    """
    live = [t for t in tokens if t > 0]
    if len(live) < 2:
        return 1.0

    def epochs(a: float) -> float:
        ratios = [w / t for w, t in zip(weights(live, a), live, strict=True)]
        return max(ratios) / min(ratios) if floor_one else max(ratios) * (budget or sum(live))

    def bisect(fits, low: float = 0.0, high: float = 1.0) -> float:
        """The largest a with fits(a) where fits holds up to some point, or 0."""
        if fits(high):
            return high
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if fits(mid) else (low, mid)
        return low

    best = math.log(len(live))
    wanted = bisect(lambda a: entropy(weights(live, a)) >= target_entropy * best) if target_entropy is not None else 0.0
    if repetition is not None and epochs(wanted) > repetition:
        low, high = wanted, 1.0
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if epochs(mid) > repetition else (low, mid)
        return high
    return wanted


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", target_entropy: float | None = 0.97, repetition: float | None = 4.0, budget: float | None = None, floor_one: bool = False, seed: int = 11, block_rows: int = 4096) -> DataFrame:
    """(row columns of the input's key, text hash and source, n_tokens, weight, copies): how often each row is drawn.

    Returned columns: key, source, n_tokens long, weight double (of the source), copies long, last_rank double (share of the source's
    budget at which the row's last draw starts; null where it isn't drawn).
    """
    rows = docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), count_words(F.col(text)).alias("n_tokens"), F.xxhash64(F.col(text)).alias("th"))
    rows = materialise(rows.withColumn("src", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))))
    totals = rows.groupBy("src").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    # one row a source; sources are few next to documents, and the exponent needs all shares
    found = totals.orderBy("src").collect()
    tokens = [float(r.t) for r in found]
    total = sum(tokens)
    if total == 0:
        return rows.select(F.col("id").alias(key), "source", "n_tokens", F.lit(0.0).alias("weight"), F.lit(1).cast("long").alias("copies"), F.lit(0.0).alias("last_rank"), "th")
    a = choose_exponent(tokens, target_entropy, repetition, floor_one, budget)
    w = weights(tokens, a)
    if floor_one:
        budget = max(t / x for t, x in zip(tokens, w, strict=True) if t > 0)
    spark = docs.sparkSession
    quota = [(r.src, x, int(min(x * (budget or total), (repetition or math.inf) * t + 0.5)), r.t, max(1, -(-r.n // block_rows))) for r, x, t in zip(found, w, tokens, strict=True)]
    if floor_one:
        quota = [(s, x, max(q, t), t, b) for s, x, q, t, b in quota]
    quota = small_table(spark, quota, "src string, weight double, quota long, t long, blocks long")
    small = len(found) <= 10_000
    rows = rows.join(F.broadcast(quota) if small else quota, "src")
    rows = rows.withColumn("epochs", F.when(F.col("t") > 0, F.expr("quota div t")).otherwise(F.lit(1).cast("long"))).withColumn("rest", F.when(F.col("t") > 0, F.expr("quota % t")).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumn("block", F.expr("pmod(xxhash64(id, th, src), blocks)"))
    order = lambda what: F.xxhash64(F.lit(seed), F.col("epochs"), *what)
    blocks = rows.where("rest > 0").groupBy("src", "block", "epochs", "rest").agg(F.sum("n_tokens").alias("bt"))
    run = Window.partitionBy("src").orderBy(order([F.col("src"), F.col("block")]), "block")
    blocks = materialise(blocks.withColumn("before", F.sum("bt").over(run) - F.col("bt")).select("src", "block", "before", F.when(F.col("before") + F.col("bt") <= F.col("rest"), F.lit("whole")).when(F.col("before") < F.col("rest"), F.lit("cut")).otherwise(F.lit("none")).alias("fate")))
    rows = rows.join(blocks, ["src", "block"], "left")
    inner = Window.partitionBy("src", "block").orderBy(order([F.col("id"), F.col("th")]), "id", "th")
    cut = rows.where("fate = 'cut'").withColumn("upto", F.col("before") + F.sum("n_tokens").over(inner))
    cut = cut.withColumn("extra", (F.col("upto") <= F.col("rest")).cast("long"))
    other = rows.where("fate is null or fate <> 'cut'").withColumn("upto", F.col("before") + F.col("n_tokens")).withColumn("extra", F.coalesce((F.col("fate") == "whole").cast("long"), F.lit(0).cast("long")))
    both = cut.unionByName(other).withColumn("copies", F.col("epochs") + F.col("extra"))
    rank = F.when(F.col("copies") > 0, F.least(F.lit(1.0), ((F.col("copies") - 1) * F.col("t") + F.when(F.col("extra") > 0, F.col("upto") - F.col("n_tokens")).otherwise(F.lit(0))) / F.greatest(F.col("quota"), F.lit(1))))
    return both.select(F.col("id").alias(key), "source", "n_tokens", "weight", "copies", rank.alias("last_rank"), "th")


def realise(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixture itself: rows of ``docs``, each as often as the plan draws it, with the columns of ``docs``."""
    k, s, h, n, th, copy = fresh(docs, "_k", "_s", "_h", "_n", "_th", "_copy")
    drawn = plan(docs, key, text, source, **options).where("copies > 0").select(F.col(key).alias(k), F.col("source").alias(s), F.col("th").alias(h), F.col("copies").alias(n))
    # rows with equal id, source and text share their plan, so one row of it stands for all of them
    drawn = drawn.groupBy(k, s, h).agg(F.max(n).alias(n))
    marked = docs.withColumn(th, F.xxhash64(F.col(text)))
    joined = marked.join(drawn, F.col(key).eqNullSafe(F.col(k)) & F.col(source).cast("string").eqNullSafe(F.col(s)) & (F.col(th) == F.col(h)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])
