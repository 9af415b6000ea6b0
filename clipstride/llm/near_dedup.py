"""One document of each group of near copies: five-word shingles with a Jaccard similarity of 0.8 or more.

First SimHash: fingerprints over five words link by the anchors of ``simhash`` at four bits or fewer. Equal fingerprints and
the edges that connect close ones are candidates, checked on full sets; they settle groups of many close copies. Few
bits differ only above a similarity of some 0.95, so what is left goes through the tables of ``tensored_minhash``, whose
docstring gives the odds that a pair at 0.8 is missed.

Sets are compared as sets of 64-bit shingle hashes. Letters A-Z count as lower case. A text of fewer than five words is
one shingle; texts without words equal each other here. Null text counts as empty. Rows without a doc_id are linked too
but are kept only where no row of a group has one. Other columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipstride.llm import simhash
from clipstride.llm.tensored_minhash import Links
from clipstride.operators.store import written

SHINGLE, LEAST = 5, 80


def close_fingerprints(links: Links) -> DataFrame:
    """Pairs of nodes (a, b) that connect what fingerprints of at most four differing bits connect."""
    marked = simhash.fingerprints(links.texts.select("key", "text"), SHINGLE).select("key", "fp")
    marked = written(links.nodes.where("size > 0").select("node", "key").join(marked, "key").select("node", "fp").distinct())
    first = written(marked.groupBy("fp").agg(F.min("node").alias("first")))
    close = simhash.links(first.select("fp"))
    left, right = (first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node")) for c in ("a", "b"))
    across = close.distinct().join(left, "a").join(right, "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return across.union(marked.join(first, "fp").where("node <> first").select("first", "node"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of each group of near copies; of rows that repeat it, one. A null id is the largest."""
    links = Links(docs, SHINGLE, LEAST)
    links.check(close_fingerprints(links))
    links.gather()
    rooted = links.rows.join(links.classes().select("one", "two", "root"), ["one", "two"])
    return simhash.first_rows(docs, rooted.select("doc_id", "key", "root"))
