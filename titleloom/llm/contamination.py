"""Benchmark passages in documents by greedy string tiling.

Seeds are equal runs of MIN_MATCH words, or of all words of an item that has fewer:
the word grams of all documents are joined with those of the benchmark by hash and
checked word by word. For each
document and item that share seeds, tiles are marked: the longest common run of
words in which no word is marked yet, found with Karp-Rabin hashes of falling
length, again and again until no run of MIN_MATCH words is left. Words that are
in no seed can't be in a tile, so the seeds carry all that tiling needs. Tiles
may lie in any order, so reordered passages count in full. An item is leaked
where its tiles cover at least `coverage` of its words.

Words: A-Z lower-cased, everything of ASCII but letters and digits between them.

Results: one row per leaked pair of document and item, nothing for clean
documents. Items with equal words are one item, named by the smallest id; item_ids
holds all of them. An item of fewer than MIN_MATCH words is leaked where all of it
stands together. Null or empty texts and items without a word have no seeds. Rows
alike in id and text are one document. Null ids are kept as null. Empty tables
give no rows. Other columns are not read.

The benchmark has one row per place of a gram. They are broadcast up to
BROADCAST_GRAMS rows, counted before; beyond that Spark joins them as it joins any
table. Only seeds are shuffled, by text, id and item.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from titleloom.llm.common import batch, documents, query
from titleloom.llm.licences import words_of
from titleloom.llm.lines import text_key

MIN_MATCH = 5
COVERAGE = 0.5
BROADCAST_GRAMS = 500_000
_MOD, _MUL = (1 << 61) - 1, 1_000_003


def rolling(tokens: list[int], marked: bytearray, size: int):
    """(start, Karp-Rabin hash) of each run of `size` tokens without a marked one."""
    high, value, length = pow(_MUL, size - 1, _MOD), 0, 0
    for end, token in enumerate(tokens):
        if marked[end]:
            value = length = 0
            continue
        if length == size:
            value -= (tokens[end - size] + 1) * high
            length -= 1
        value = (value * _MUL + token + 1) % _MOD
        length += 1
        if length == size:
            yield end - size + 1, value


def tiles(text: list[int], item: list[int], least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiling: (start in text, start in item, length) of tiles that overlap in neither; ties go to the first."""
    in_text, in_item = bytearray(len(text)), bytearray(len(item))
    out: list[tuple[int, int, int]] = []
    size = max(least, min(len(item), len(text), 4 * least))
    while True:
        at: dict[int, list[int]] = {}
        for start, value in rolling(item, in_item, size):
            at.setdefault(value, []).append(start)
        found = []
        for start, value in rolling(text, in_text, size):
            for other in at.get(value, ()):
                if start and other and text[start - 1] == item[other - 1] and not in_text[start - 1] and not in_item[other - 1]:
                    continue  # inside a longer match
                n = 0
                while start + n < len(text) and other + n < len(item) and text[start + n] == item[other + n] and not in_text[start + n] and not in_item[other + n]:
                    n += 1
                if n >= size:
                    found.append((-n, start, other))
        if not found:
            if size == least:
                return sorted(out)
            size = max(least, size // 2)
            continue
        for n, start, other in sorted(found):
            if not any(in_text[start : start - n]) and not any(in_item[other : other - n]):
                in_text[start : start - n] = in_item[other : other - n] = b"\1" * -n
                out.append((start, other, -n))


def tile_pair(seeds: list[tuple[int, int, list[str]]], size: int, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles of a document and an item of `size` words from their seeds (place in text, place in item, words)."""
    ids: dict[str, int] = {}
    text: dict[int, int] = {}
    item = [-1] * size
    for pos, at, words in seeds:
        for k, w in enumerate(words):
            text[pos + k] = item[at + k] = ids.setdefault(w, len(ids))
    places = sorted(text)
    tokens, back = [], []
    for k, p in enumerate(places):
        if k and p != places[k - 1] + 1:
            tokens.append(-2)  # words between that are in no seed
            back.append(-1)
        tokens.append(text[p])
        back.append(p)
    return [(back[a], b, n) for a, b, n in tiles(tokens, item, least)]


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", coverage: float = COVERAGE, least: int = MIN_MATCH,
) -> DataFrame:
    """id, text_key, item_id, item_ids, coverage and tiles (start in text, start in item, length; words from 0) of leaked items."""
    words = lambda n: [F.get("words", F.col("pos") + k) for k in range(n)]
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text)).alias("words")).where(F.size("words") > 0)
    ids = F.array_sort(F.collect_list("item_id"))  # null ids name nothing
    items = items.groupBy("words").agg(F.min("item_id").alias("item_id"), ids.alias("item_ids"), F.xxhash64("words").alias("item"))
    items = items.select("item", "item_id", "item_ids", "words", F.size("words").alias("m"), F.least(F.size("words"), F.lit(least)).alias("k"))
    grams = items.select("item", "item_id", "words", "m", "k", F.posexplode("words").alias("pos", "w")).where(F.col("pos") + F.col("k") <= F.col("m"))
    gram = F.slice("words", F.col("pos") + 1, F.col("k"))
    grams = grams.select("k", gram.alias("gram"), "item", "item_id", "m", F.col("pos").alias("at"))
    grams = grams.withColumn("h", F.xxhash64("gram"))
    sizes = sorted(r["k"] for r in grams.select("k").distinct().collect())  # `least` rows at most
    if grams.count() <= BROADCAST_GRAMS:
        grams = F.broadcast(grams)
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text_key"), words_of(F.col(text_col)).alias("words"))
    rows = rows.select("id", "text_key", "words", F.posexplode_outer("words").alias("pos", "w"))
    rows = rows.select("id", "text_key", "pos", *[g.alias(f"g{k}") for k, g in enumerate(words(least))])
    own = lambda k: F.array(*[F.col(f"g{j}") for j in range(k)])
    places = [F.struct(F.lit(k).alias("k"), own(k).alias("own")) for k in sizes or [least]]
    if len(places) > 1:
        rows = rows.select("id", "text_key", "pos", F.explode(F.array(*places)).alias("p")).select("id", "text_key", "pos", "p.*")
    else:
        rows = rows.select("id", "text_key", "pos", places[0]["k"].alias("k"), places[0]["own"].alias("own"))
    rows = rows.withColumn("h", F.xxhash64("own")).join(grams, ["k", "h"]).where(F.col("own") == F.col("gram"))
    seeds = rows.select("id", "text_key", "item", "item_id", "m", "pos", "at", "gram")
    order = ["text_key", "id", "item"]
    seeds = seeds.repartition(*order).sortWithinPartitions(*order)
    tile = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("text_start", "item_start", "length")]))
    kinds = seeds.schema
    schema = T.StructType(
        [kinds["id"], kinds["text_key"], kinds["item"], kinds["item_id"], T.StructField("coverage", T.DoubleType()), T.StructField("tiles", tile)]
    )
    arrow = to_arrow_schema(schema)

    def rows_of(batches):
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def per_partition(batches):
        out = []
        for (doc, key, item), group in groupby(rows_of(batches), key=lambda r: r[:3]):
            group = list(group)
            size = group[0][4]
            found = tile_pair([(r[5], r[6], r[7]) for r in group], size, min(least, size))
            covered = sum(t[2] for t in found) / size
            if covered >= coverage:
                out.append((doc, key, item, group[0][3], covered, [dict(zip(("text_start", "item_start", "length"), t, strict=True)) for t in found]))
            if len(out) >= 1024:
                yield batch(arrow, list(zip(*out, strict=True)))
                out = []
        if out:
            yield batch(arrow, list(zip(*out, strict=True)))

    found = seeds.mapInArrow(per_partition, schema)
    return found.join(items.select("item", "item_ids"), "item").select("id", "text_key", "item_id", "item_ids", "coverage", "tiles")


def drop_leaked(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs in which no item is leaked."""
    found = leaks(docs, benchmark, id_col, text_col, **options).select("id", "text_key").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("own_id"), text_key(F.col(text_col)).alias("own_key"))
    kept = rows.join(found, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("text_key")), "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


@query("op9_decontamination")
def op9_decontamination(spark, sf_dir):
    docs, benchmark = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return leaks(docs, benchmark).select(F.col("id").alias("doc_id"), "item_id", "coverage", "tiles")
