"""Near-duplicate groups by 64-bit SimHash and anchor-point covering.

Fingerprints of equal value are one class. Two fingerprints that differ in at
most four bits differ in at most one bit of one of three blocks (21, 21 and 22
bits). Per block the anchors are a covering code: the perfect Hamming code on
15 of the block's bits and every value of the others, so each block value lies
within one bit of an anchor (its home). Every fingerprint is replicated to all
anchors within covering radius plus threshold, 1 + 1 bits, about 15 a block,
so it meets at its neighbour's home whatever neighbour it has. Fingerprints at
home are compared with all that came to the same anchor.

An anchor returns a spanning forest of the links it found: groups are kept
whole without listing their pairs. Crowded anchors are cut into tiles of
bounded size, each of which is a group of its own; a forest of each tile keeps
every group whole as well. Groups of all anchors are joined by alternating
star contraction, whose rounds are written to the shared folder.

Results: one row per input row. Null and empty texts have fingerprint zero and
are linked like any other. Repeated rows and ids stay rows of their own; a
component's name is its smallest id, null ids aside, and null where it has no
other. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from titleloom.llm.common import batch, discard, documents, pieces_of, query, stored
from titleloom.llm.lines import row_key, text_key

SHINGLE, SEED, BITS = 4, 42, 4
BLOCKS = ((0, 21), (21, 21), (42, 22))  # first bit, bits
CODED = 15  # bits of a block under the Hamming code
TILE = 4096  # fingerprints of either side of a comparison


def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    """Hash of every word shingle; a shorter text is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    at = starts.tolist()
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(at, at[k:], strict=False)], "<u8")


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """Majority of the bits of the hashes of all word shingles."""
    return majority(shingle_hashes(text, width))


def majority(hashes: np.ndarray) -> int:
    ones, step = np.zeros(64, np.int64), 1 << 16
    for i in range(0, len(hashes), step):
        part = hashes[i : i + step]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """doc_id, text_key and print, the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("text_key"))
    schema = T.StructType([rows.schema["doc_id"], rows.schema["text_key"], T.StructField("print", T.LongType())])
    arrow = to_arrow_schema(schema)

    def per_partition(batches):
        for b in batches:
            for start, end in pieces_of(b.column(1)):
                prints = np.array([fingerprint(t.as_py() or "", width) for t in b.column(1)[start:end]], np.uint64)
                part = b.slice(start, end - start)
                yield batch(arrow, [part.column(0), part.column(2), prints.view(np.int64)])

    return rows.mapInArrow(per_partition, schema)


def _syndrome(value: int) -> int:
    """Xor of the places (from 1) of the set bits among the coded ones: zero on the code."""
    s = 0
    for i in range(CODED):
        if value >> i & 1:
            s ^= i + 1
    return s


def _masks(bits: int, radius: int) -> list[list[int]]:
    """By syndrome: every change of at most `radius` bits that leads to an anchor."""
    by: list[list[int]] = [[] for _ in range(CODED + 1)]
    singles = [1 << i for i in range(bits)]
    changes = [0, *singles]
    if radius > 1:
        changes += [a | b for i, a in enumerate(singles) for b in singles[i + 1 :]]
    for c in changes:
        by[_syndrome(c)].append(c)
    return by


def _anchors(prints: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, anchor key) pairs, block by block; a key holds the block in its highest bits."""
    out = []
    for number, (first, bits) in enumerate(BLOCKS):
        block = (prints >> np.uint64(first)) & np.uint64((1 << bits) - 1)
        syndrome = np.zeros(len(prints), np.int64)
        for i in range(CODED):
            syndrome ^= ((block >> np.uint64(i)) & np.uint64(1)).astype(np.int64) * (i + 1)
        for s, masks in enumerate(_masks(bits, radius)):
            rows = np.flatnonzero(syndrome == s)
            keys = block[rows][:, None] ^ np.array(masks, np.uint64)[None, :]
            out.append((np.repeat(rows, len(masks)), ((np.uint64(number) << np.uint64(32)) | keys.ravel()).astype(np.int64)))
    return out


def homes(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One anchor per print and block: itself where it is an anchor, else the one that its syndrome points at."""
    rows, keys = [], []
    for number, (first, bits) in enumerate(BLOCKS):
        block = (prints >> np.uint64(first)) & np.uint64((1 << bits) - 1)
        syndrome = np.zeros(len(prints), np.int64)
        for i in range(CODED):
            syndrome ^= ((block >> np.uint64(i)) & np.uint64(1)).astype(np.int64) * (i + 1)
        flip = np.where(syndrome > 0, np.uint64(1) << np.maximum(syndrome - 1, 0).astype(np.uint64), np.uint64(0))
        rows.append(np.arange(len(prints)))
        keys.append(((np.uint64(number) << np.uint64(32)) | (block ^ flip)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def forest(home: np.ndarray, near: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Links of a spanning forest of all pairs (home, near) that differ in at most `bits` bits."""
    every = np.unique(np.concatenate([home, near]))
    parent = list(range(len(every)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    at_home, at_near = np.searchsorted(every, home), np.searchsorted(every, near)
    step = max(1, 2_000_000 // max(1, len(near)))
    for i in range(0, len(home), step):
        close = np.bitwise_count(home[i : i + step, None] ^ near[None, :]) <= bits
        for a, b in zip(*(c.tolist() for c in np.nonzero(close)), strict=True):
            x, y = root(int(at_home[i + a])), root(int(at_near[b]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((int(every[x]), int(every[y])))
    return links


def links(classes: DataFrame, tile: int = TILE) -> DataFrame:
    """Links (a, b) between values of column `print` that keep every group of linked values connected.

    Anchors with more than `tile` fingerprints of a side are cut by their hash:
    each tile of homes meets each tile of the replicas.
    """
    schema = T.StructType([T.StructField(n, t) for n, t in (("key", T.LongType()), ("home", T.BooleanType()), ("print", T.LongType()))])
    arrow = to_arrow_schema(schema)

    def replicate(batches):
        for b in batches:
            every = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(0, len(every), 10_000):
                prints = every[i : i + 10_000].view(np.uint64)
                rows, keys = homes(prints)
                yield batch(arrow, [keys, np.ones(len(rows), bool), prints[rows].view(np.int64)])
                for rows, keys in _anchors(prints, 2):
                    yield batch(arrow, [keys, np.zeros(len(rows), bool), prints[rows].view(np.int64)])

    placed = classes.select("print").mapInArrow(replicate, schema)
    sizes = placed.groupBy("key").agg(F.count_if("home").alias("n_home"), F.count_if(~F.col("home")).alias("n_near"))
    # an anchor without a home, or with one fingerprint alone, links nothing
    sizes = sizes.where("n_home > 0 AND n_near > 1")
    crowded = sizes.where(F.greatest("n_home", "n_near") > tile)
    cuts = lambda n: F.ceil(F.col(n) / tile).cast("int")
    crowded = stored(crowded.select("key", cuts("n_home").alias("home_cuts"), cuts("n_near").alias("near_cuts")), "crowded")
    rows = placed.join(crowded, "key", "left")
    spread = lambda n: F.pmod(F.xxhash64("print"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    i = F.when(F.col("home_cuts").isNull(), F.array(F.lit(0))).when(F.col("home"), F.array(spread("home_cuts"))).otherwise(every("home_cuts"))
    j = F.when(F.col("near_cuts").isNull(), F.array(F.lit(0))).when(F.col("home"), every("near_cuts")).otherwise(F.array(spread("near_cuts")))
    rows = rows.withColumn("i", F.explode(i)).withColumn("j", F.explode(j)).select("key", "i", "j", "home", "print")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    pair = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    pair_arrow = to_arrow_schema(pair)

    def compare(batches):
        held: list[pa.RecordBatch] = []
        last = None

        def linked(group):
            key, home, prints = group
            if home.any() and not home.all():
                found = forest(prints[home], prints[~home])
                if found:
                    a, b = np.array(found, np.uint64).T
                    return batch(pair_arrow, [a.view(np.int64), b.view(np.int64)])
            return None

        carry = None
        for b in batches:
            key = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)], axis=1)
            home = b.column(3).to_numpy(zero_copy_only=False).astype(bool)
            prints = b.column(4).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            if carry is not None:
                key, home, prints = (np.concatenate(p) for p in zip(carry, (key, home, prints), strict=True))
            if not len(key):
                continue
            ends = np.append(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key))
            start = 0
            for end in ends[:-1].tolist():
                if end - start > 1 and (out := linked((key[start:end], home[start:end], prints[start:end]))) is not None:
                    held.append(out)
                start = end
            carry = (key[start:], home[start:], prints[start:])
            if held:
                yield from held
                held = []
        if carry is not None and len(carry[0]) > 1 and (last := linked(carry)) is not None:
            yield last

    return rows.mapInArrow(compare, pair).distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node reachable over edges (a, b), for every node that has an edge.

    Large-star and small-star rounds; each is written to the shared folder, where the one
    before is removed, and the last one changes nothing. Hot nodes are aggregated map-side and split in joins.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("least"))
        least = stored(least, "least")  # a table of its own: adaptive execution can then split a hot node's links
        large = both.join(least, F.col("a") == F.col("node")).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        large = stored(large, "large")
        lower = large.groupBy("a").agg(F.min("b").alias("least")).withColumnRenamed("a", "node")
        lower = stored(lower, "lower")
        small = large.join(lower, F.col("a") == F.col("node"))
        small = small.select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e"))
        last, edges = edges, stored(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        discard(last, least, large, lower)
        after = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = after
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """doc_id, text_key, print (signed long), component (its root print) and component_id of each document."""
    prints = stored(fingerprints(docs, id_col, text_col, width), "prints")
    classes = prints.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(classes, tile))
    named = classes.join(roots, F.col("print") == F.col("node"), "left").select("print", "first_id", F.coalesce("root", "print").alias("component"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "component").select("print", "component", "component_id")
    return prints.join(named, "print").select("doc_id", "text_key", "print", "component", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The first row of each component, by id (nulls last) and text hash; of rows alike in both, one."""
    return keep_first(docs, near_duplicates(docs, id_col, text_col, **options), id_col, text_col)


def keep_first(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The first row of each component of found (doc_id, text_key, component)."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    first = found.groupBy("component").agg(F.min(order).alias("first"))
    first = first.select(row_key(F.col("first.doc_id"), F.col("first.text_key")).alias("key"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), row_key(F.col(id_col), text_key(F.col(text_col))).alias("key"))
    kept = rows.join(first, "key", "left_semi").withColumn("n", F.expr("row_number() OVER (PARTITION BY key ORDER BY key)")).where("n = 1")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


@query("op6_simhash_near_dedup")
def op6_simhash_near_dedup(spark, sf_dir):
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
