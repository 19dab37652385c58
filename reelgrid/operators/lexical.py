"""A lexical index that is built once and searched many times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.functions.text import nfc
from reelgrid.operators.search import added_up, inverse_frequency, sparse_search, term_lists, term_weights
from reelgrid.session import kept, parallelism

#: An id of more rows than this is added up token by token; where the rows that share an id are more than this part of all, all are shuffled at once.
CROWD, MANY = 1_000, 8


class LexicalIndex:
    """Documents (id, tokens, weights), a row each, and each token's rarity.

    An index belongs to one state of its documents; changed documents need a new one.
    """

    def __init__(self, docs: DataFrame):
        """``docs``: id, t (raw text; null texts have no token); texts of one id are one document."""
        # A number of its own keeps the partitions: by size they would be joined into few.
        spread = docs.repartition(parallelism(docs.sparkSession))
        self.documents = kept(_one_per_id(kept(term_lists(spread.select("id", nfc("t").alias("t")), "id", "t"))))
        tokens = self.documents.select(F.explode("tokens").alias("token"))
        # Texts without an id are one document that is found, but not counted among all.
        self.idf = kept(inverse_frequency(tokens, self.documents.agg(F.count("id").alias("n"))))

    @property
    def postings(self) -> DataFrame:
        """(token, id, weight), a row for each token of each document."""
        return _exploded(self.documents)

    def search(self, words: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score, rank) of ``words``: query_id, token, weight."""
        return sparse_search(words, self.documents, self.idf, k)


def _exploded(documents: DataFrame) -> DataFrame:
    pairs = documents.select("id", F.explode(F.arrays_zip(F.col("tokens").alias("token"), F.col("weights").alias("weight"))).alias("x"))
    return pairs.select("x.token", "id", "x.weight")


def _one_per_id(rows: DataFrame) -> DataFrame:
    """Rows that share an id, or have none, are one document.

    Where few do, only theirs are shuffled, otherwise all, once and as they are. Only ids of very many
    rows are added up token by token before the shuffle, as many texts may have no id.
    """
    named = rows.where("id is not null")
    repeated = kept(named.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"))
    crowded = repeated.where(F.col("n") > CROWD).select("id")
    several, total = repeated.agg(F.sum("n"), F.max("n")).first()
    if (several or 0) * MANY > rows.count():
        alone, shared = None, named
    else:
        alone, shared = named.join(repeated, "id", "left_anti"), named.join(repeated, "id", "left_semi")
    added = rows.where("id is null")
    if (total or 0) > CROWD:
        added = added.unionByName(named.join(crowded, "id", "left_semi"))
        shared = shared.join(crowded, "id", "left_anti")
    pairs = _exploded(added).groupBy("id", "token").agg(F.sum("weight").alias("weight")).groupBy("id").agg(F.collect_list(F.struct("token", "weight")).alias("x"))
    lists = shared.groupBy("id").agg(F.collect_list(F.struct("tokens", "weights")).alias("x"))
    out = added_up(lists.select("id", F.flatten("x.tokens").alias("tokens"), F.flatten("x.weights").alias("weights")), "id")
    out = out.unionByName(pairs.select("id", F.col("x.token").alias("tokens"), F.col("x.weight").alias("weights")))
    return out if alone is None else alone.unionByName(out)


def query_terms(texts: DataFrame) -> DataFrame:
    """(query_id, token, weight) of (query_id, t), the words of queries; few, so they are written and broadcast where small."""
    return kept(term_weights(texts.where(F.col("t").isNotNull()).select("query_id", nfc("t").alias("t")), ["query_id"], "t"))
