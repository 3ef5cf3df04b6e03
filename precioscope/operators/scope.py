"""Which stores serve which queries, by an index of letter triples instead of a loop over all pairs.

Scope words and query words meet when one holds the other.  Only distinct words are compared: a word asks
the postings of its rarest triple of letters, since whatever holds the word holds that triple too.  Queries of
one set of words, and stores of one scope, are one class each; classes meet, and rows join their classes last,
so that every pair is put out once and nothing is compared row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEW = 400_000  # rows of stores that a broadcast may have
SHORTEST = 3  # words of fewer letters do not count; also the length of a triple


def _words(words: str) -> Column:
    kept = F.filter(F.col(words), lambda w: F.length(w) >= SHORTEST)
    return F.coalesce(F.array_sort(F.array_distinct(kept)), F.array().cast("array<string>"))


def _triples(word: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - SHORTEST + 1), lambda i: F.substring(word, i, F.lit(SHORTEST))))


def holding_words(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """(needle, word) for each word of ``hay`` (word) that holds a word of ``needles`` (word); both of distinct
    words of ``SHORTEST`` letters or more."""
    postings = hay.select("word", F.explode(_triples(F.col("word"))).alias("triple"))
    known = postings.groupBy("triple").agg(F.count(F.lit(1)).alias("n"))
    asked = needles.select(F.col("word").alias("needle"), F.explode(_triples(F.col("word"))).alias("triple"))
    # A triple that no word has ends the search: it is the rarest, and its postings are empty.
    rarest = asked.join(known, "triple", "left").groupBy("needle").agg(F.min_by("triple", F.struct(F.coalesce("n", F.lit(0)), "triple")).alias("triple"))
    return rarest.join(postings, "triple").filter(F.contains("word", F.col("needle"))).select("needle", "word")


def store_serves(queries: DataFrame, stores: DataFrame) -> DataFrame:
    """Query and store rows that the store's scope admits: an empty or null scope admits all, else a scope word
    (over 2 letters) equals, holds or is held by a word of the query.

    ``queries`` has tokens, ``stores`` scope_words, both arrays of words; all columns of both are kept, and
    repeated rows stay.
    """
    asked = queries.withColumn("_asked", _words("tokens"))
    # Null stands for "no scope"; a scope of short words only admits all as well.
    served = stores.withColumn("_scope", _words("scope_words"))
    asked_sets, scopes = asked.select("_asked").distinct(), served.select("_scope").distinct()
    tokens = asked_sets.select(F.explode("_asked").alias("word")).distinct()
    words = scopes.select(F.explode("_scope").alias("word")).distinct()
    held = holding_words(words, tokens).select(F.col("needle").alias("scope"), F.col("word").alias("token"))
    holds = holding_words(tokens, words).select(F.col("word").alias("scope"), F.col("needle").alias("token"))
    touching = held.union(holds).distinct()
    by_word = scopes.select("_scope", F.explode("_scope").alias("scope")).join(touching, "scope").select("_scope", "token").distinct()
    pairs = by_word.join(asked_sets.select("_asked", F.explode("_asked").alias("token")), "token").select("_asked", "_scope").distinct()
    unscoped = asked_sets.select("_asked", F.array().cast("array<string>").alias("_scope"))
    return _dealt(asked.join(pairs.union(unscoped), "_asked").drop("_asked"), served)


def _dealt(asked: DataFrame, served: DataFrame) -> DataFrame:
    """The join by ``_scope``.  Few scopes have most rows and the pairs are many times what comes in, so ``asked``
    is dealt over all tasks.  Up to ``FEW`` rows of stores go to every task; more come to each block of ``asked``
    by a shuffle, where a task holds the stores of one scope at a time and spills."""
    spark = asked.sparkSession
    blocks = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    row = F.xxhash64(*[c for c in asked.columns if c != "_scope"])
    if served.limit(FEW + 1).count() <= FEW:
        return asked.repartition(blocks, row).join(F.broadcast(served), "_scope").drop("_scope")
    left = asked.withColumn("_block", F.pmod(row, F.lit(blocks)).cast("int"))
    right = served.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["_block", "_scope"]
    return left.repartition(blocks, *keys).join(right.repartition(blocks, *keys).hint("merge"), keys).drop(*keys)
