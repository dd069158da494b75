"""Spelling variant grouping by a rare-first q-gram prefix filter.

Two words are near if one inserted, deleted or replaced code point turns one into the other. A word is the multiset of its bigrams, each
with its position. All bigrams are ordered by how many words have them, rarest first. One edit touches at most two bigrams of a word, so of
the three rarest of either word one is left; the order being the same for both, the words share a bigram among the three rarest of each, at
positions at most one apart. As a single edit lies before or after that bigram, either all that precedes it or all that follows it is equal
too, and lengths differ by one at most: the join's key is the bigram with its length class and what stands before it, or what stands after
it. Pairs from the join are verified by their edit distance. Nothing is missed and nothing is capped.

Words and counts stay distributed; each step is a hash aggregate or an equi-join of the table of words. Of data only the frequencies of
bigrams are broadcast, at most the square of the alphabet. ``form`` leads to a word at least ``factor`` times as frequent, so that the walk
to the root ends; pointers double, and a few rounds suffice.

Null texts have no word. Null ids are like any other rows (the query leaves their runs alone). Repeated rows count again. Ties for the form
go to the smallest word in code-point order. Words of any length and texts of any length are taken whole. Further columns don't matter,
whatever their names; an empty table gives no words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quilt.llm.common import materialise

#: Shortest word and fewest occurrences; how much more frequent a form must be.
MIN_LENGTH, MIN_COUNT, FACTOR = 6, 5, 5
#: Bigrams of a word that enter the join: one more than an edit can touch.
PREFIX = 3
#: The letters of words, and the capitals that are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", at_least: int = MIN_LENGTH) -> DataFrame:
    """(id, run): each maximal run of at least ``at_least`` letters, A to Z lower-cased; a row for each occurrence."""
    pattern = F.lit(f"[{LETTERS}]{{{at_least},}}")
    return docs.select(F.col(f"`{key}`").alias("id"), F.explode(F.regexp_extract_all(F.translate(F.col(f"`{text}`"), CAPITALS, SMALL), pattern, F.lit(0))).alias("run"))


def frequent(words: DataFrame, word: str = "word", at_least: int = MIN_COUNT, length: int = MIN_LENGTH) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return words.where(F.length(word) >= length).groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def postings(words: DataFrame) -> DataFrame:
    """(word, side, class, gram, rest): the three rarest bigrams of each word, each with what stands before it and with what stands after it.

    A class is the length of the shorter word of a pair, so each word is in that of its own length and in the one below.
    """
    n = F.length("word")
    at = F.sequence(F.lit(1), n - 1)
    grams = words.select("word", F.explode(F.transform(at, lambda i: F.struct(F.col("word").substr(i, F.lit(2)).alias("gram"), i.alias("at")))).alias("g")).select("word", "g.gram", "g.at")
    # distinct words that hold a bigram; no more rows than pairs of letters
    often = grams.groupBy("gram").agg(F.count("*").alias("often"))
    ranked = grams.join(F.broadcast(often), "gram").groupBy("word").agg(F.slice(F.array_sort(F.collect_list(F.struct("often", "gram", "at"))), 1, PREFIX).alias("rare"))
    one = ranked.select("word", F.explode("rare").alias("g")).select("word", "g.gram", "g.at")
    before = F.struct(F.lit("before").alias("side"), F.col("word").substr(F.lit(1), F.col("at") - 1).alias("rest"))
    after = F.struct(F.lit("after").alias("side"), F.col("word").substr(F.col("at") + 2, n).alias("rest"))
    sided = one.select("word", "gram", F.explode(F.array(before, after)).alias("s")).select("word", "gram", "s.side", "s.rest")
    return sided.select("word", "side", "gram", "rest", F.explode(F.array(n, n - 1)).alias("class"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, other): every ordered pair of words at an edit distance of one."""
    p = postings(words)
    q = p.select(F.col("word").alias("other"), "side", "gram", "rest", "class")
    met = p.join(q, ["side", "gram", "rest", "class"]).where(F.col("word") < F.col("other"))
    once = met.where(F.levenshtein("word", "other", 1) == 1).select("word", "other").distinct()
    return once.union(once.select("other", "word"))


def roots(form: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form: the end of its chain, by doubling pointers."""
    now = materialise(form.select("word", F.col("form").alias("root")))
    while True:
        nxt = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = materialise(now.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def group(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table (word, n) of distinct words."""
    words = materialise(words.select("word", "n"))
    pairs = near_pairs(words)
    other = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    # the least struct is the most frequent word, then the first in code-point order
    best = pairs.join(other, "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("b"))
    best = best.select("word", "n_near", F.col("b.other").alias("best"), (-F.col("b.less")).alias("best_n"))
    good = F.col("best_n") >= factor * F.col("n")
    known = materialise(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")))
    end = roots(known.where("form is not null"))
    return known.join(end, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# the query


def misspelt(doc_id: Column, run: Column, every: int = 199) -> Column:
    """The run, short of one code point where a hash of id and run says so."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))).otherwise(run)


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Words of all texts after :func:`misspelt`, with forms and roots."""
    runs = letter_runs(docs, key, text)
    return group(frequent(runs.select(misspelt(F.col("id"), F.col("run")).alias("word"))))
