"""Near-duplicate groups by the Jaccard similarity of sets of word shingles.

Two texts are linked where their sets of `width`-word shingles have at least
`similarity` in common; a group is what links connect. A 64-bit SimHash can't
tell this: at similarity 0.8 fingerprints differ in about ten bits and often in
more, which no covering of few blocks reaches. Candidates come from MinHash
bands instead: BANDS hashes of ROWS minima each. A pair at 0.8 shares none of
them with probability (1 - 0.8 ** 4) ** 20 = 0.00003, at 0.9 with 2e-10. Every
candidate is checked on its whole sets, so no pair below the bound is linked.

A bucket is never joined with itself: its texts are checked against leaders.
First its smallest text leads, the same one in all bands that it is in, which
settles most buckets. Those that hold more than one group then get STARS leaders of
their own, drawn by a hash of bucket and text, so that a text has other leaders
in every band. What is still mixed is cut by longer keys: two, then three bands of
the text together, in OFFSETS combinations for each band, with new leaders in each.
A text is checked against a bounded number of others however large its buckets are,
so a link between two texts that met the same leaders in vain can be missed where
no chain of other links joins them. Measured recall is in the README.

`anchored` gives the candidates of SimHash and anchor covering, at the same width: texts
of one fingerprint and those that its forest links. `links` checks them like the others.

Words are those of SimHash: lower case, white space between them. Texts of fewer
words are one shingle; those without a word are equal to each other.

Results: one row per input row. Null and empty texts are linked like any other.
Rows of equal text (by a 64-bit hash) are one class. Repeated rows and ids stay
rows of their own; null ids are passed on. An empty table gives no rows. Of a group
`drop_similar` keeps the first row by id, null last, then by text hash; of rows
alike in both it keeps one. It returns the columns of docs, whatever their names.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from titleloom.llm import simhash
from titleloom.llm.common import batch, pieces_of, stored
from titleloom.llm.lines import text_key
from titleloom.llm.simhash import components, keep_first, shingle_hashes

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
STARS, OFFSETS, DEPTH = 2, 5, 3
_DRAW = np.random.default_rng(20_260_801).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64)
_MUL, _ADD = _DRAW[0] * np.uint64(2) + np.uint64(1), _DRAW[1]


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def bands(found: np.ndarray) -> list[int]:
    """One signed key per band, of the smallest hash of the set under each of its orders."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 4096):
        least = np.minimum(least, (found[i : i + 4096, None] * _MUL + _ADD).min(axis=0))
    least = least.astype("<u8").reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least)]


def _mapped(rows: DataFrame, fields: list[T.StructField], of) -> DataFrame:
    """The columns of rows but the last, a text, with those that `of` makes of its text."""
    schema = T.StructType([*rows.schema.fields[:-1], *fields])
    arrow, at = to_arrow_schema(schema), len(rows.columns) - 1

    def per_partition(batches):
        for b in batches:
            for start, end in pieces_of(b.column(at), most=1024):
                part = b.slice(start, end - start)
                made = [of(t.as_py() or "") for t in part.column(at)]
                yield batch(arrow, [*part.columns[:at], *zip(*made, strict=True)])

    return rows.mapInArrow(per_partition, schema)


def sketched(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """doc_id, text_key, n (shingles), bands and print (SimHash, a signed long) of each row."""

    def of(text):
        every = shingle_hashes(text, width)
        found = np.unique(every)
        return len(found), bands(found), int(np.uint64(simhash.majority(every)).astype(np.int64))

    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    made = [T.StructField("n", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("print", T.LongType())]
    return _mapped(rows, made, of)


def classes_of(rows: DataFrame) -> DataFrame:
    """One row per text of the rows of `sketched`."""
    return rows.groupBy("text_key").agg(*[F.first(c).alias(c) for c in ("n", "bands", "print")])


def anchored(classes: DataFrame, similarity: float) -> DataFrame:
    """Candidates (a, b): each text with the first one of its fingerprint, and the first ones of fingerprints that anchors link."""
    first = stored(classes.groupBy("print").agg(F.min(F.struct("text_key", "n")).alias("least")), "prints")
    same = classes.join(first, "print").select(F.col("least").alias("x"), F.struct("text_key", "n").alias("y"))
    ends = lambda c: first.select(F.col("print").alias(c), F.col("least").alias("xy"[c == "b"]))
    near = simhash.links(first.select("print")).join(ends("a"), "a").join(ends("b"), "b").select("x", "y")
    pairs = same.unionAll(near).where((F.col("x.text_key") != F.col("y.text_key")) & _near(F.col("x.n"), F.col("y.n"), similarity))
    return pairs.select(F.least("x.text_key", "y.text_key").alias("a"), F.greatest("x.text_key", "y.text_key").alias("b")).distinct()


def checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of text keys whose sets are similar."""
    side = lambda c: sets.select(F.col("text_key").alias(c), F.col("held").alias(f"held_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    common = F.size(F.array_intersect("held_a", "held_b"))
    rows = both.select("a", "b", (F.size("held_a") + F.size("held_b")).alias("n"), common.alias("common"))
    alike = F.when(F.col("n") == 0, True).otherwise(F.col("common") / (F.col("n") - F.col("common")) >= similarity)
    return rows.where(alike).select("a", "b")


def _near(n: str | Column, m: str | Column, similarity: float) -> Column:
    """Sets of n and m shingles can be similar."""
    return F.least(n, m) >= similarity * F.greatest(n, m)


def mixed(crowd: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of crowd (key, text_key, ...) in buckets that hold more than one group of linked texts, with their group."""
    roots = components(found)
    rows = crowd.drop("group").join(roots, F.col("text_key") == F.col("node"), "left").withColumn("group", F.coalesce("root", "text_key")).drop("node", "root")
    rows = stored(rows, "grouped")
    several = rows.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("key")
    return stored(rows.join(stored(several, "several"), "key", "left_semi"), "mixed")


def longer(crowd: DataFrame, classes: DataFrame, depth: int) -> DataFrame:
    """The rows of crowd under keys of one band more; the first time in OFFSETS ways."""
    rows = crowd.join(classes.select("text_key", "bands"), "text_key")
    if depth == 2:
        rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(OFFSETS))))
    band = F.get("bands", F.pmod(F.col("band") + (depth - 1) * F.col("step"), F.lit(BANDS)).cast("int"))
    return rows.select(F.xxhash64("key", "step", band).alias("key"), "band", "step", "text_key", "n", "group")


def stars(crowd: DataFrame, similarity: float, leaders: int) -> DataFrame:
    """Pairs (a, b) of each text with the leaders of its buckets, where these are of another group."""
    drawn = [F.min(F.struct(F.xxhash64("key", "text_key", F.lit(k)).alias("draw"), "text_key", "n", "group")) for k in range(leaders)]
    heads = crowd.groupBy("key").agg(F.array(*drawn).alias("heads"), F.min("group").alias("low"), F.max("group").alias("high"))
    heads = stored(heads.where("low <> high").select("key", "heads"), "heads")
    rows = crowd.join(heads, "key")
    other = F.filter("heads", lambda h: (h.group != F.col("group")) & _near(h.n, F.col("n"), similarity))
    rows = rows.select("text_key", F.explode(other.getField("text_key")).alias("head"))
    return rows.select(F.least("text_key", "head").alias("a"), F.greatest("text_key", "head").alias("b")).distinct()


def sets_for(docs: DataFrame, members: DataFrame, text_col: str, width: int) -> DataFrame:
    """text_key and held (its distinct shingles) of the texts in members."""
    texts = docs.select(text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    held = T.StructField("held", T.ArrayType(T.LongType()))
    sets = _mapped(texts.join(members, "text_key", "left_semi"), [held], lambda t: (shingle_set(t, width).view(np.int64),))
    return sets.groupBy("text_key").agg(F.first("held").alias("held"))


def links(docs: DataFrame, classes: DataFrame, text_col: str, width: int, similarity: float, more: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between text keys that connect each group of similar texts; pairs in `more` are checked first, with those of the buckets."""
    placed = classes.select("text_key", "n", F.posexplode("bands").alias("band", "key"))
    shared = placed.groupBy("key").agg(F.min(F.struct("text_key", "n")).alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stored(shared.select("key", "least"), "buckets")
    crowd = stored(placed.join(shared, "key"), "crowd")
    members = crowd.select("text_key")
    if more is not None:
        members = members.unionAll(more.select("a")).unionAll(more.select("b"))
    sets = stored(sets_for(docs, stored(members.distinct(), "members"), text_col, width), "sets")
    first = crowd.where((F.col("text_key") != F.col("least.text_key")) & _near("n", F.col("least.n"), similarity))
    first = first.select(F.col("least.text_key").alias("a"), F.col("text_key").alias("b"))
    first = (first if more is None else first.unionAll(more)).distinct()
    found = stored(checked(stored(first, "pairs"), sets, similarity), "links")
    crowd = crowd.select("key", "band", F.lit(0).alias("step"), "text_key", "n")
    for depth in range(1, DEPTH + 1):
        crowd = mixed(crowd, found)
        if crowd.isEmpty():
            break
        if depth > 1:
            crowd = stored(longer(crowd, classes, depth), "longer")
        more = stored(stars(crowd, similarity, STARS if depth == 1 else 1), "pairs")
        found = stored(found.unionAll(checked(more, sets, similarity)), "links")
    return found


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_key, component (its smallest text key) of each document."""
    rows = stored(sketched(docs, id_col, text_col, width), "sketches")
    classes = stored(classes_of(rows), "classes")
    roots = components(links(docs, classes, text_col, width, similarity)).withColumnRenamed("node", "text_key")
    return rows.select("doc_id", "text_key").join(roots, "text_key", "left").select("doc_id", "text_key", F.coalesce("root", "text_key").alias("component"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The first row of each group, by id (nulls last) and text hash; of rows alike in both, one."""
    return keep_first(docs, similar(docs, id_col, text_col, **options), id_col, text_col)
