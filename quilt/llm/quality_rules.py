"""Quality rules: counting rules, then robust multivariate outliers per language and source.

Counting rules reject texts that are very short or repeat themselves. The other rows of each language and source get a
minimum-covariance-determinant estimate. From two starts (medians with quartile spreads, without and with sign correlations), concentration steps
keep the share of rows that lie nearest and take mean and covariance of these anew; of the two ends, the one with the smaller determinant counts. Rows whose
transformed statistics lie beyond a Mahalanobis distance are rejected. Medians and quantiles come from histograms, moments from partial
sums, so a hot source is added up before anything is shuffled.

Every row is judged by its own language and source, however few rows these have. A group's mean and covariance are shrunk towards those of its
language as if ``prior`` further rows had them, a language's towards the corpus's, and the corpus's covariance towards twice the
floors. Each variance gets a floor, so that statistics that are equal nearly everywhere don't reject small deviations.

Edge cases: a null or empty text has no words and fails the base rules; texts of any length are counted whole; null language or source is a value of
its own; repeated rows count as often as they occur; ties in distance stay on one side, and of two starts with equal determinants the first counts; an
empty table gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quilt.llm.common import WORD_SPACE, materialise

_SPACE_CLASS = "[\\x20\\x09-\\x0D]+"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column, size: int) -> Column:
    """Words in windows of ``size`` words that are found at least twice, the first included."""

    def covered(sorted_windows: Column) -> Column:
        n = F.size(sorted_windows)
        same = lambda i, j: F.get(sorted_windows, i)["h"] == F.get(sorted_windows, j)["h"]
        at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)), F.get(sorted_windows, i)["i"]).otherwise(F.lit(-1)))
        starts = F.array_sort(F.filter(at, lambda x: x >= 0))
        # each start adds the words that no earlier window has covered
        step = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda s, x: F.struct((s["n"] + x + size - F.greatest(s["end"], x)).alias("n"), (x + F.lit(size)).alias("end")))
        return step["n"]

    def of_windows(windows: Column) -> Column:
        pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _let(F.sort_array(pairs), covered)).otherwise(F.lit(0))

    def of_hashes(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))
        return _let(windows, of_windows)

    return F.when(F.size(words) > size, _let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)).otherwise(F.lit(0))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(id, carried columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines), all counts long."""
    t = F.coalesce(F.col("t"), F.lit(""))
    bare = F.btrim(t, F.lit(WORD_SPACE))
    rows = docs.select(F.col(key).alias("id"), *[F.col(c) for c in carry or []], F.col(text).alias("t"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.concat_ws("", w)).cast("long").alias("word_chars"), _repeated(w, 8).cast("long").alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPACE_CLASS))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WORD_SPACE)) != "")
    rows = rows.withColumn("w", _let(words, of_words)).withColumn("l", _let(lines, of_lines)).withColumn("n_symbols", F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"))
    return rows.select("id", *(carry or []), "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")


def transformed() -> list[Column]:
    """The statistic vector: logarithms and shares, each roughly symmetric on ordinary prose."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(F.col("n_words").cast("double")),
        4 * F.log1p(F.col("word_chars") / n),
        F.log1p(100.0 * F.col("n_symbols") / n),
        4.0 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        8.0 * F.col("n_repeat_words") / n,
    ]


#: Least standard deviation of each transformed statistic.
FLOORS = (0.6, 0.15, 0.25, 0.4, 0.4)


def _cholesky(cov: list[list[Column]]) -> list[list[Column]]:
    """Lower triangular factor, as columns."""
    d = len(cov)
    low: list[list[Column]] = [[F.lit(0.0)] * d for _ in range(d)]
    for i in range(d):
        for j in range(i + 1):
            s = cov[i][j]
            for k in range(j):
                s = s - low[i][k] * low[j][k]
            low[i][j] = F.sqrt(F.greatest(s, F.lit(1e-9))) if i == j else s / low[j][j]
    return low


def chi_square(p: float, d: int) -> float:
    """Quantile of the chi-square distribution by the cube-root normal approximation."""
    from statistics import NormalDist

    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(p) * math.sqrt(2 / (9 * d))) ** 3


class Estimate:
    """Robust location and scatter of each group of ``rows`` (grp, x0..): :meth:`best` has a row a group: size, mean m0.., covariance c00.. and its log determinant."""

    def __init__(self, rows: DataFrame, d: int, floors: tuple[float, ...], share: float, steps: int, few: bool, bins: int = 32):
        self.rows, self.d, self.floors, self.share, self.steps, self.few, self.bins = rows, d, floors, share, steps, few, bins

    def best(self) -> DataFrame:
        params = self.starts()
        for _ in range(self.steps):
            near = self.distances(params).join(self.hint(self.quantile(self.distances(params), ["grp", "s"], self.share)), ["grp", "s"]).where("d2 < cut")
            params = self.moments(near)
        ranked = params.groupBy("grp").agg(F.min_by(F.struct(*params.columns), F.struct("logdet", "s")).alias("p"))
        return materialise(ranked.select("p.*"))

    def hint(self, small: DataFrame) -> DataFrame:
        """Broadcast a table of one row a group and start only where the groups are known to be few."""
        return F.broadcast(small) if self.few else small

    def starts(self) -> DataFrame:
        """(grp, s, m.., l..): medians, with quartile spreads (s = 0) and with sign correlations too (s = 1)."""
        d = self.d
        long = self.rows.select("grp", F.posexplode(F.array(*[F.col(f"x{i}") for i in range(d)])).alias("dim", "x"))
        counts = long.groupBy("grp", "dim", F.floor(F.col("x") * 64).alias("bin")).agg(F.count("*").alias("n"))
        run, whole = Window.partitionBy("grp", "dim").orderBy("bin"), Window.partitionBy("grp", "dim")
        cum = counts.withColumn("c", F.sum("n").over(run)).withColumn("all", F.sum("n").over(whole))
        q = lambda p: F.min(F.when(F.col("c") >= p * F.col("all"), (F.col("bin") + 0.5) / 64))
        got = cum.groupBy("grp", "dim").agg(q(0.5).alias("m"), (q(0.75) - q(0.25)).alias("iqr"))
        floor = F.element_at(F.array(*[F.lit(f) for f in self.floors]), F.col("dim") + 1)
        got = got.withColumn("s", F.greatest(F.col("iqr") / 1.349, floor))
        at = lambda c, i: F.max(F.when(F.col("dim") == i, F.col(c)))
        centre = materialise(got.groupBy("grp").agg(*[at("m", i).alias(f"m{i}") for i in range(d)], *[at("s", i).alias(f"s{i}") for i in range(d)]))
        sign = [F.signum(F.col(f"x{i}") - F.col(f"m{i}")) for i in range(d)]
        signs = self.rows.join(self.hint(centre), "grp").groupBy("grp").agg(*[F.avg(sign[i] * sign[j]).alias(f"r{i}{j}") for i in range(d) for j in range(i)])
        both = centre.join(self.hint(signs), "grp").crossJoin(F.broadcast(self.rows.sparkSession.range(2).select(F.col("id").cast("int").alias("s"))))
        # a hundredth off the diagonal's equality keeps the matrix of sign correlations positive definite enough
        turn = lambda i, j: F.when(F.col("s") == 1, 0.99 * F.sin(F.col(f"r{max(i, j)}{min(i, j)}") * (math.pi / 2))).otherwise(F.lit(0.0))
        cov = [[F.col(f"s{i}") * F.col(f"s{j}") * (F.lit(1.0) if i == j else turn(i, j)) for j in range(d)] for i in range(d)]
        return self.factored(both, cov, ["grp", "s"])

    def factored(self, rows: DataFrame, cov: list[list[Column]], keep: list[str]) -> DataFrame:
        """Kept columns, means, covariances c.., their factor l.. and log determinant."""
        d = self.d
        low = [(i, j) for i in range(d) for j in range(i + 1)]
        rows = materialise(rows.select(*keep, *[f"m{i}" for i in range(d)], *[cov[i][j].alias(f"c{i}{j}") for i, j in low]))
        factor = _cholesky([[F.col(f"c{max(i, j)}{min(i, j)}") for j in range(d)] for i in range(d)])
        rows = rows.select("*", *[factor[i][j].alias(f"l{i}{j}") for i, j in low])
        return materialise(rows.withColumn("logdet", 2 * sum((F.log(f"l{i}{i}") for i in range(1, d)), F.log("l00"))))

    def distances(self, params: DataFrame) -> DataFrame:
        """Rows with the squared Mahalanobis distance d2, by forward substitution; once for each start that ``params`` has."""
        joined = self.rows.join(self.hint(params.drop("logdet", *[c for c in params.columns if c.startswith("c")])), "grp")
        z: list[str] = []
        for i in range(self.d):
            s = F.col(f"x{i}") - F.col(f"m{i}")
            for j in range(i):
                s = s - F.col(f"l{i}{j}") * F.col(f"z{j}")
            joined = joined.withColumn(f"z{i}", s / F.col(f"l{i}{i}"))
            z.append(f"z{i}")
        return joined.withColumn("d2", sum((F.col(c) * F.col(c) for c in z[1:]), F.col(z[0]) * F.col(z[0])))

    def quantile(self, rows: DataFrame, by: list[str], p: float) -> DataFrame:
        """(by, cut): upper end of the logarithmic distance bin in which a group's share p of rows is reached."""
        counts = rows.groupBy(*by, F.floor(F.log(F.greatest("d2", F.lit(1e-9))) * self.bins).alias("bin")).agg(F.count("*").alias("n"))
        run, whole = Window.partitionBy(*by).orderBy("bin"), Window.partitionBy(*by)
        cum = counts.withColumn("c", F.sum("n").over(run)).withColumn("all", F.sum("n").over(whole))
        return cum.where(F.col("c") >= p * F.col("all")).groupBy(*by).agg(F.exp((F.min("bin") + 1) / F.lit(float(self.bins))).alias("cut"))

    def moments(self, rows: DataFrame) -> DataFrame:
        d = self.d
        sums = rows.groupBy("grp", "s").agg(F.count("*").alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(d)], *[F.covar_pop(f"x{i}", f"x{j}").alias(f"v{i}{j}") for i in range(d) for j in range(i + 1)])
        # the kept part of a normal cloud has less spread than the whole; this factor restores it
        q = chi_square(self.share, d)
        factor = self.share / _chi_share(q, d + 2)
        cov = [[F.col(f"v{max(i, j)}{min(i, j)}") * factor + F.lit(self.floors[i] ** 2 if i == j else 0.0) for j in range(d)] for i in range(d)]
        return self.factored(sums, cov, ["grp", "s", "n"])

    def shrunk(self, own: DataFrame, parents: DataFrame | None, above: DataFrame | None, prior: float) -> DataFrame:
        """``own`` drawn towards the rows of ``above`` (by ``parents``: grp, up), or towards twice the floors, as if ``prior`` rows more had these."""
        d, low = self.d, [(i, j) for i in range(self.d) for j in range(i + 1)]
        # arrays, since the optimiser's bookkeeping of dozens of renamed columns takes minutes
        packed = lambda rows, *keep: rows.select(*keep, F.array(*[F.col(f"m{i}") for i in range(d)]).alias("m"), F.array(*[F.col(f"c{i}{j}") for i, j in low]).alias("c"))
        rows = packed(own, "grp", "n")
        if above is None:
            rows = rows.select("*", F.col("m").alias("um"), F.array(*[F.lit((2 * self.floors[i]) ** 2 if i == j else 0.0) for i, j in low]).alias("uc"))
        else:
            named = packed(above, F.col("grp").alias("up")).withColumnsRenamed({"m": "um", "c": "uc"})
            rows = rows.join(self.hint(parents), "grp").join(self.hint(named), "up")
        mix = lambda x, y: (F.col("n") * x + prior * y) / (F.col("n") + prior)
        rows = materialise(rows.select("grp", "n", F.zip_with("m", "um", mix).alias("m"), F.zip_with("c", "uc", mix).alias("c")))
        rows = rows.select("grp", "n", *[F.col("m")[i].alias(f"m{i}") for i in range(d)], "c")
        at = {ij: k for k, ij in enumerate(low)}
        return self.factored(rows, [[F.col("c")[at[max(i, j), min(i, j)]] for j in range(d)] for i in range(d)], ["grp", "n"])


def _chi_share(x: float, d: int) -> float:
    """Share of a chi-square distribution below x, by the same approximation."""
    from statistics import NormalDist

    return NormalDist().cdf(((x / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", min_words: int = 20, max_repeat_percent: int = 30, tail: float = 1e-6, share: float = 0.75, steps: int = 3, prior: float = 50.0, broadcast_groups: int = 10_000) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept) for every row."""
    known = docs.select(F.col(key).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), F.col(text).alias("t"))
    stats = measure(known, "id", "t", ["lang", "source"])
    stats = stats.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    level = lambda n, *by: F.concat(F.lit(n), F.to_json(F.struct(*by)) if by else F.lit(""))
    stats = stats.withColumn("g0", level("0")).withColumn("g1", level("1", "lang")).withColumn("g2", level("2", "lang", "source"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    d = len(FLOORS)
    stats = materialise(stats.select("id", *base, "g0", "g1", "g2", *[x.alias(f"x{i}") for i, x in enumerate(transformed())]))
    sound = stats.where("not base_failed")
    tree = materialise(sound.select("g0", "g1", "g2").distinct())
    few = tree.count() <= broadcast_groups
    levels = sound.select(F.explode(F.array("g0", "g1", "g2")).alias("grp"), *[f"x{i}" for i in range(d)])
    estimate = Estimate(levels, d, FLOORS, share, steps, few)
    found = estimate.best()
    above = estimate.shrunk(found.where(F.col("grp").startswith("0")), None, None, prior)
    for n, up in (("1", "g0"), ("2", "g1")):
        parents = tree.select(F.col(f"g{n}").alias("grp"), F.col(up).alias("up")).distinct()
        above = estimate.shrunk(found.where(F.col("grp").startswith(n)), parents, above, prior)
    own = Estimate(sound.withColumnRenamed("g2", "grp"), d, FLOORS, share, steps, few)
    measured = materialise(own.distances(above.drop("n")).select("id", *base, "grp", "g1", "d2"))
    # distances are scaled so that their median is that of a normal cloud, but never blown up; few rows lean on their language's median
    sizes = measured.groupBy("grp", "g1").agg(F.count("*").alias("n"))
    middles = sizes.join(own.quantile(measured, ["grp"], 0.5), "grp").join(own.quantile(measured, ["g1"], 0.5).withColumnRenamed("cut", "wide"), "g1")
    middles = middles.select("grp", ((F.col("n") * F.col("cut") + prior * F.col("wide")) / (F.col("n") + prior)).alias("middle"))
    judged = measured.join(own.hint(middles), "grp")
    distance = F.sqrt(F.col("d2") / F.greatest(F.lit(1.0), F.col("middle") / chi_square(0.5, d)))
    limit = math.sqrt(chi_square(1 - tail, d))
    passed = judged.select("id", *base, distance.alias("distance")).withColumn("kept", F.col("distance") <= limit)
    failed = stats.where("base_failed").select("id", *base, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return passed.unionByName(failed).select(F.col("id").alias(key), *base, "distance", "kept")
