"""Past cases most alike in text: exact top-k by TF-IDF cosine over an inverted index.

Not every pair that shares a word is scored. A floor per query comes first, from the cases best in
each of its words and from those that share a least hash of their words with it. A query's
heaviest words then give candidates: as many as are needed that the others together stay below the
floor, by the length of the query's rest or by their blocks' largest weights. What is left out is so by proof.

Equal texts are one class on both sides, whatever their number. Everything stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialised

WORD = r"[\p{L}\p{N}]+"
#: Postings of a word are kept in this many blocks by weight; each block has its largest weight.
IMPACTS = 32
#: Least hashes of a text's words, by which alike texts meet for the first floor.
HASHES = 6
#: For each of the k wanted, so many pairs furthest ahead are scored to raise the floor.
LEADERS = 8
#: Scores are compared at this many decimals, so that sums in another order tie alike.
DECIMALS = 9
SLACK = 10.0**-DECIMALS


def _classes(rows: DataFrame, text: Column) -> DataFrame:
    """The different texts ``(cls, text, n)``; blank and NULL texts have no words and drop out later."""
    return rows.select(text.alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n")).select(F.md5("text").alias("cls"), "text", "n")


def _words(classes: DataFrame) -> DataFrame:
    """``(cls, n, word, tf)``: damped counts of each text's words."""
    words = classes.select("cls", "n", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word"))
    return words.groupBy("cls", "n", "word").agg((1 + F.log(F.count(F.lit(1)))).alias("tf"))


def _weighed(words: DataFrame, frequencies: DataFrame, cases: int) -> DataFrame:
    """``(cls, word, w)`` of unit length per class. A word no case has weighs most."""
    idf = F.log(F.lit(1.0 + cases) / (1.0 + F.coalesce("df", F.lit(0)))) + 1
    weighed = words.join(frequencies, "word", "left").withColumn("w", F.col("tf") * idf)
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("cls")))
    return weighed.select("cls", "word", (F.col("w") / size).alias("w"))


def _vectors(weights: DataFrame) -> DataFrame:
    return weights.groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("word", "w"))).alias("vec"))


def _signs(weights: DataFrame, cls: str) -> DataFrame:
    """``(cls, sign)``: the least hash of a text's words in each of HASHES orders."""
    least = [F.struct(F.lit(i).alias("i"), F.min(F.xxhash64(F.lit(i), "word")).alias("h")) for i in range(HASHES)]
    return weights.groupBy(cls).agg(F.array(*least).alias("signs")).select(cls, F.explode("signs").alias("sign"))


class CaseIndex:
    """Inverted index of cases ``(case_id, text)``, kept in the shared folder.

    ``k`` is the most cases a query can ask for.
    """

    def __init__(self, cases: DataFrame, k: int = 3, impacts: int = IMPACTS) -> None:
        self.k = k
        cases = cases.where("case_id is not null and text is not null")
        # A class holds the k least ids: of equal texts no others can be among the first k.
        first = F.row_number().over(W.partitionBy("cls").orderBy("case_id"))
        self.ids = materialised(
            cases.select(F.md5("text").alias("cls"), "case_id").distinct().withColumn("place", first).where(F.col("place") <= k), "cases-ids"
        )
        words = materialised(_words(_classes(cases, F.col("text"))), "cases-words")
        self.cases = cases.count()
        self.frequencies = words.groupBy("word").agg(F.sum("n").alias("df"))
        block = F.least(F.floor(F.col("w") * impacts), F.lit(impacts - 1)).cast("int")
        self.postings = materialised(_weighed(words, self.frequencies, self.cases).withColumn("block", block), "cases-postings")
        self.blocks = self.postings.groupBy("word", "block").agg(F.max("w").alias("top"))
        best = F.row_number().over(W.partitionBy("word").orderBy(F.desc("w"), "cls"))
        self.champions = self.postings.withColumn("place", best).where(F.col("place") <= k).select("word", "cls")
        some = F.row_number().over(W.partitionBy("sign").orderBy("cls"))
        self.signs = _signs(self.postings, "cls").withColumn("place", some).where(F.col("place") <= k).select("sign", "cls")

    def _scores(self, pairs: DataFrame, vectors: DataFrame) -> DataFrame:
        """Exact scores of ``(q, cls)`` pairs."""
        asked = vectors.select(F.col("cls").alias("q"), F.col("vec").alias("asked"))
        dot = F.aggregate(F.map_entries("asked"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.element_at("vec", e["key"]), F.lit(0.0)))
        return pairs.join(asked, "q").join(_vectors(self.postings), "cls").select("q", "cls", F.round(dot, DECIMALS).alias("score"))

    def _partial(self, weights: DataFrame, floor: DataFrame) -> DataFrame:
        """``(q, cls, part, most)`` of all pairs that may reach their query's floor: the score from
        the words looked at, and the most that all words can give."""
        tops = self.blocks.groupBy("word").agg(F.max("top").alias("top"))
        own = W.partitionBy("q")
        rising = own.orderBy("w", "word").rowsBetween(W.unboundedPreceding, W.currentRow)
        # Words up to here give at most their bounds, and at most the length of this part of the query.
        needed = F.least("upto", "length") >= F.col("floor") - SLACK
        below = {c: F.coalesce(F.max(F.when(~needed, F.col(c))).over(own), F.lit(0.0)) for c in ("upto", "length")}
        bounded = (
            weights.join(tops, "word").withColumn("bound", F.col("w") * F.col("top")).drop("top").join(floor, "q", "left")
            .withColumns({
                "floor": F.coalesce("floor", F.lit(0.0)), "others": F.sum("bound").over(own) - F.col("bound"),
                "upto": F.sum("bound").over(rising), "length": F.sqrt(F.sum(F.col("w") * F.col("w")).over(rising)),
            })
            .withColumns({"rest": below["upto"], "rest_length": below["length"]}).where(needed)
        )
        # A case in a block whose best weight is too little with all the other words is out as well.
        others = F.least(F.col("others"), F.sqrt(F.greatest(1 - F.col("own") * F.col("own"), F.lit(0.0))))
        asked = (
            bounded.withColumnRenamed("w", "own").join(self.blocks, "word").where(F.col("own") * F.col("top") + others >= F.col("floor") - SLACK)
            .select("q", "word", "block", "own", "rest", "rest_length")
        )
        gained = asked.join(self.postings, ["word", "block"]).groupBy("q", "cls").agg(
            F.sum(F.col("own") * F.col("w")).alias("part"), F.sum(F.col("w") * F.col("w")).alias("used"), F.max("rest").alias("rest"), F.max("rest_length").alias("rest_length")
        )
        left = F.col("rest_length") * F.sqrt(F.greatest(1 - F.col("used"), F.lit(0.0)))
        return gained.select("q", "cls", "part", (F.col("part") + F.least("rest", left)).alias("most"))

    def _floor(self, scored: DataFrame) -> DataFrame:
        """The k-th best score found so far: what a case must reach at least."""
        kth = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "cls"))
        return scored.withColumn("place", kth).where(F.col("place") == self.k).select("q", F.col("score").alias("floor"))

    def search(self, queries: DataFrame) -> DataFrame:
        """The k cases nearest each query ``(query_id, text)``: query_id, rank, case_id, score.

        Score: cosine of damped counts times ``ln((1 + cases) / (1 + cases with the word)) + 1``,
        at nine decimals; ties go to the smaller case_id. A case sharing no word is never found, so a query
        may have fewer than k rows; NULL, empty and wordless texts have none.
        """
        words = _words(_classes(queries.where("text is not null"), F.col("text")))
        weights = materialised(_weighed(words, self.frequencies, self.cases).withColumnRenamed("cls", "q"), "cases-asked")
        vectors = _vectors(weights.withColumnRenamed("q", "cls"))
        tried = weights.join(self.champions, "word").select("q", "cls").union(_signs(weights, "q").join(self.signs, "sign").select("q", "cls")).distinct()
        first = self._floor(self._scores(tried, vectors))
        partial = materialised(self._partial(weights, first), "cases-partial")
        # The pairs furthest ahead raise the floor before the others are scored.
        ahead = F.row_number().over(W.partitionBy("q").orderBy(F.desc("most"), "cls"))
        leaders = partial.withColumn("place", ahead).where(F.col("place") <= LEADERS * self.k)
        floor = first.union(self._floor(self._scores(leaders.select("q", "cls"), vectors))).groupBy("q").agg(F.max("floor").alias("floor"))
        may = F.col("most") >= F.coalesce("floor", F.lit(0.0)) - SLACK
        found = self._scores(partial.join(floor, "q", "left").where(may).select("q", "cls"), vectors).where("score > 0")
        # Of tied classes those with the least ids can matter; k classes hold all of the first k cases.
        least = self.ids.where("place = 1").select("cls", F.col("case_id").alias("least"))
        order = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "least"))
        near = found.join(least, "cls").withColumn("place", order).where(F.col("place") <= self.k).select("q", "cls", "score")
        rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "case_id")).alias("rank")
        ranked = near.join(self.ids.select("cls", "case_id"), "cls").select("q", "case_id", "score", rank).where(F.col("rank") <= self.k)
        return queries.select("query_id", F.md5("text").alias("q")).join(ranked, "q").select("query_id", "rank", "case_id", "score")


def top_cases_by_text(cases: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` past cases ``(case_id, text)`` most alike in text for each query ``(query_id, text)``."""
    return CaseIndex(cases, k).search(queries)
