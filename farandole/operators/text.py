"""Text search: a token index, prefix and fuzzy matches, scores and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farandole.functions.columns import bigrams, words


def token_index(rows: DataFrame, text: str = "name") -> DataFrame:
    """(id, word) of every distinct word of every text."""
    return rows.select("id", F.explode(words(F.col(text))).alias("word"))


def prefix_search(index: DataFrame, tokens: list[str]) -> DataFrame:
    """Ids that have, for every token, a word starting with it."""
    wanted = F.array(*[F.when(F.col("word").startswith(t), F.lit(t)) for t in tokens])
    hits = index.select("id", F.explode(F.filter(wanted, lambda t: t.isNotNull())).alias("token"))
    return hits.groupBy("id").agg(F.count_distinct("token").alias("n")).where(F.col("n") == len(set(tokens))).select("id")


def fuzzy_search(index: DataFrame, token: str, missing: int = 25) -> DataFrame:
    """(id, found): how many of the token's bigrams the object's words hold, where the share
    missing, in whole percent, is at most `missing`."""
    grams = sorted({token[k : k + 2] for k in range(max(1, len(token) - 1))})
    of = index.select("id", F.explode(bigrams(F.col("word"))).alias("gram")).where(F.col("gram").isin(grams))
    found = of.groupBy("id").agg(F.count_distinct("gram").alias("found"))
    return found.where(F.floor((len(grams) - F.col("found")) * 100 / len(grams)) <= missing)


def longest_common(rows: DataFrame, query: str, text: str = "name") -> DataFrame:
    """(id, lcs, position): length of the longest substring that the lower-case text shares with
    the query, and the last index in the text where the first such one ends (-1 if none)."""
    if not query:
        return rows.select("id", F.lit(0).alias("lcs"), F.lit(-1).alias("position"))
    letters = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), ""), lambda c: c != "")
    # row: for each letter of the query how long the common run is that ends at it and at this letter.
    start = F.struct(F.array_repeat(F.lit(0), len(query)).alias("row"), F.lit(0).alias("lcs"), F.lit(-1).alias("position"), F.lit(0).alias("at"))

    def step(held: Column, letter: Column) -> Column:
        run = lambda k: F.when(letter == query[k], (held["row"][k - 1] if k else F.lit(0)) + 1).otherwise(0)
        row = F.array(*[run(k) for k in range(len(query))])
        longest = F.array_max(row)
        better = longest > held["lcs"]
        return F.struct(row.alias("row"), F.greatest(longest, held["lcs"]).alias("lcs"), F.when(better, held["at"]).otherwise(held["position"]).alias("position"), (held["at"] + 1).alias("at"))

    found = F.aggregate(letters, start, step)
    return rows.select("id", found.alias("f")).select("id", "f.lcs", "f.position")


def quality(missing: Column, length_difference: Column, score: Column, best: Column, weight: int = 10) -> Column:
    return 100 - missing * weight - F.abs(length_difference) - F.floor((best - score) / 10)


def admin_score(n: Column) -> Column:
    return F.floor(F.log(n + 2) * 10).cast("int")


def stop_area_scores(areas: DataFrame) -> DataFrame:
    """Areas (id, admin_score, stops) scored by their admin and their share of the most stops."""
    most = areas.agg(F.max("stops").alias("most"))
    return areas.join(F.broadcast(most)).withColumn("score", F.col("admin_score") + F.floor(F.col("stops") * 100 / F.col("most")).cast("int")).drop("most")


def ranked_places(places: DataFrame, n: int) -> DataFrame:
    """The n best places: by type, score, quality, then name without case."""
    return places.orderBy("type_order", F.desc("score"), F.desc("quality"), F.lower("name"), "id").limit(n)


def exact_search(index: DataFrame, tokens: list[str], scores: DataFrame, names: DataFrame) -> DataFrame:
    """Objects that have every token as the start of a word, best first: id, quality (100), score, lcs and
    position; by score, then the longest common substring with the query, then its place."""
    hits = prefix_search(index, tokens).join(scores, "id")
    common = longest_common(names, " ".join(tokens))
    return hits.join(common, "id").select("id", F.lit(100).alias("quality"), "score", "lcs", "position").orderBy(F.desc("score"), F.desc("lcs"), "position", "id")
