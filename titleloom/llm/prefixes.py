"""Near-duplicate groups by shingle sets without a link missed: the exact form of `shingles`.

Candidates come from SimHash fingerprints by anchor covering (the method of `simhash`,
at the width of the shingles) and from MinHash bands, and are checked on whole sets.
Both check every text against a bounded number of others. What they found is
completed here by prefix filtering. The shingles of a set are put in one order, the same
for all sets; sets of n shingles that share at least `similarity` with another share
one of their first n - ceil(similarity * n) + 1 (otherwise the rest alone would have to
hold the whole overlap). So texts meet on those shingles. How many of them two texts
share bounds their overlap from above; most pairs that can't be similar are told by that,
before a whole set is read or moved. Shingles that only texts
of one group hold are dropped by one aggregation per shingle, before any join: a large
group of near copies, whose texts share all their shingles, makes no pair.

Any order gives the same groups. Shingles are ordered by their hash, common ones last and
the commonest at the very end, so that a passage of many documents joins them only where
it is most of the text. Which are common is told by a sample of the texts (one of
SAMPLED, at most COMMON shingles); every text and every shingle takes part all the same.

The price is a shuffle of about a fifth of the shingles, and pairs of texts of
different groups that share one of those; many short texts made of the same few
passages are the costly case, quadratic in their number.

Results are those of `shingles.similar`, with nulls, empty texts, ties, repeated
rows, empty tables and clashing names as stated there; sets without a shingle are
equal to each other. The group of a document is what all links connect.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleloom.llm import shingles
from titleloom.llm.common import batch, stored
from titleloom.llm.lines import text_key
from titleloom.llm.simhash import components, keep_first
from titleloom.workspace import shuffles_removed

SAMPLED, COMMON = 16, 1 << 14
HELD, LEAD = (T.StructField(n, T.ArrayType(T.LongType())) for n in ("held", "lead"))
N = T.StructField("n", T.IntegerType())


def sets_of(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """text_key and held (its distinct shingles) of each distinct text."""
    texts = docs.select(text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    rows = shingles._mapped(texts, [HELD], lambda t: (shingles.shingle_set(t, width).view("int64"),))
    return rows.groupBy("text_key").agg(F.first("held").alias("held"))


def common_shingles(sets: DataFrame) -> np.ndarray:
    """The shingles that most texts of a sample hold, the commonest last."""
    drawn = sets.where(F.pmod(F.xxhash64("text_key"), F.lit(SAMPLED)) == 0)
    seen = drawn.select(F.explode("held").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("seen")).where("seen > 2")
    rows = seen.orderBy(F.col("seen").desc(), "token").limit(COMMON).collect()
    return np.array([r.token for r in reversed(rows)], np.int64).view(np.uint64)


def lead_of(found: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set (sorted), of which it shares one with any similar set."""
    n = len(found)
    if not n:
        return found
    place = np.zeros(n, np.int64)
    if len(common):
        by = np.argsort(common)
        at = np.minimum(np.searchsorted(common, found, sorter=by), len(common) - 1)
        place = np.where(common[by[at]] == found, by[at] + 1, 0)
    # 1e-9: a product that rounds upwards must not shorten the prefix
    length = n - math.ceil(similarity * n - 1e-9) + 1
    return found[np.lexsort((found, place))[:length]]


def exploded(leads: DataFrame, *keep: str) -> DataFrame:
    return leads.select("text_key", "n", *keep, F.posexplode("lead").alias("place", "token"))


def leading(sets: DataFrame, similarity: float) -> DataFrame:
    """text_key, n, place, token: the first shingles of each set of n, of which any two similar sets share one."""
    return exploded(leads_in(sets, similarity))


def leads_in(sets: DataFrame, similarity: float) -> DataFrame:
    """text_key, n and lead (its first shingles) of each set."""
    common = common_shingles(sets)
    rows = sets.select("text_key", "held")
    schema = T.StructType([rows.schema["text_key"], N, LEAD])
    arrow = shingles.to_arrow_schema(schema)

    def per_partition(batches):
        for b in batches:
            held = [np.sort(np.array(h.as_py(), np.int64).view(np.uint64)) for h in b.column(1)]
            yield batch(arrow, [b.column(0), [len(h) for h in held], [lead_of(h, common, similarity).view(np.int64) for h in held]])

    return rows.mapInArrow(per_partition, schema)


def leads_of(docs: DataFrame, text_col: str, width: int, similarity: float) -> DataFrame:
    """`leads_in` of each distinct text, from the texts; their sets are not kept."""
    texts = docs.select(text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    drawn = texts.where(F.pmod(F.xxhash64("text_key"), F.lit(SAMPLED)) == 0)
    common = common_shingles(sets_of(drawn, "text", width))

    def of(text):
        found = shingles.shingle_set(text, width)
        return len(found), lead_of(found, common, similarity).view(np.int64)

    return shingles._mapped(texts, [N, LEAD], of).groupBy("text_key").agg(F.first("n").alias("n"), F.first("lead").alias("lead"))


def candidates(leads: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts of different groups that share a leading shingle and can be similar."""
    roots = stored(components(found), "roots")
    rows = leads.join(roots, F.col("text_key") == F.col("node"), "left").withColumn("group", F.coalesce("root", "text_key"))
    rows = exploded(rows, "group")  # after the join, which moves a row per text
    span = "OVER (PARTITION BY token)"
    rows = rows.withColumns({"low": F.expr(f"min(group) {span}"), "high": F.expr(f"max(group) {span}")}).where("low <> high")
    rows = stored(rows.drop("low", "high"), "leading")
    a, b = rows.alias("a"), rows.alias("b")
    other = (F.col("a.text_key") < F.col("b.text_key")) & (F.col("a.group") != F.col("b.group"))
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & other & shingles._near(F.col("a.n"), F.col("b.n"), similarity))
    met = met.groupBy(F.col("a.text_key").alias("a"), F.col("b.text_key").alias("b"), F.col("a.n").alias("n"), F.col("b.n").alias("m"))
    pairs = met.agg(F.count(F.lit(1)).alias("met"), F.max("a.place").alias("at_n"), F.max("b.place").alias("at_m"))
    return stored(pairs.where(can_be_similar(similarity)).select("a", "b"), "pairs")


def can_be_similar(similarity: float) -> Column:
    """Sets of n and m shingles whose prefixes share `met`, the last of them at places at_n and at_m, may have the overlap that similar sets need.

    The prefix that ends first in the order has all that it shares among `met`, so
    the rest of the overlap comes after that prefix, and after the last shared place of the other.
    """
    n, m = F.col("n"), F.col("m")
    past = lambda size: F.ceil(F.lit(similarity) * size - F.lit(1e-9)) - 1  # noqa: E731  # as in lead_of
    rest = F.greatest(F.least(past(n), m - F.col("at_m") - 1), F.least(n - F.col("at_n") - 1, past(m)))
    return F.col("met") + rest >= F.lit(similarity / (1 + similarity)) * (n + m) - F.lit(1e-9)


def missed(sets: DataFrame, found: DataFrame, similarity: float = shingles.SIMILARITY) -> DataFrame:
    """The links (a, b) between texts that the links found do not connect."""
    return shingles.checked(candidates(leads_in(sets, similarity), found, similarity), sets, similarity)


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = shingles.WIDTH, similarity: float = shingles.SIMILARITY) -> DataFrame:
    """doc_id, text_key, component (its smallest text key) of each document, by all links."""
    with shuffles_removed(docs.sparkSession):
        rows = stored(shingles.sketched(docs, id_col, text_col, width), "sketches")
        classes = stored(shingles.classes_of(rows), "classes")
        near = stored(shingles.anchored(classes, similarity), "anchored")
        found = shingles.links(docs, classes, text_col, width, similarity, near)
        pairs = candidates(leads_of(docs, text_col, width, similarity), found, similarity)
        members = stored(pairs.select("a").unionAll(pairs.select("b")).distinct().withColumnRenamed("a", "text_key"), "members")
        sets = stored(shingles.sets_for(docs, members, text_col, width), "sets")
        found = stored(found.unionAll(shingles.checked(pairs, sets, similarity)), "links")
        roots = components(found).withColumnRenamed("node", "text_key")
    return rows.select("doc_id", "text_key").join(roots, "text_key", "left").select("doc_id", "text_key", F.coalesce("root", "text_key").alias("component"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The first row of each group, as `shingles.drop_similar` keeps it."""
    return keep_first(docs, similar(docs, id_col, text_col, **options), id_col, text_col)
