"""Line dedup: later repeats of runs of lines that hold `run_words` words or more are deleted.

Units are whole lines. From every line a gram is the shortest run of lines with
`gram_words` words, and a window the shortest with `run_words` (also counted
backwards from every line, so that windows reach both ends of any run). Each
window selects the gram with the smallest hash inside it, so two equal runs of
`run_words` words always share a selected gram at the same place: the selected
grams are the document's fingerprints. Fingerprints that occur at one position
only end there. Every occurrence of the others brings the windows around it, which
reach as far on both sides as a match of `run_words` words can; equal windows are
grouped by digest, which takes the place of extending pairs of occurrences line by
line. Of equal windows the first one, by id, text hash and line, stays and the later
ones are deleted, overlapping ones as one run. A window that overlaps its own first
occurrence in the same document is no repeat of it. A passage that covers a part
of a line only stays.

Results: one row per input row with its columns; the text without the deleted
lines, and `removed_runs`, an array of (first, end) line numbers. Null texts
stay null, texts without repeats stay as they are. Null ids come last in the
order. Rows alike in id and text are one document and share its cuts. An empty
table gives no rows. A column of docs called removed_runs is replaced.

No pair of occurrences is ever made: equal hashes are grouped with map-side
combining, and the joins with the repeated ones are split when a key is hot. The
work on a text is in proportion to its lines.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from titleloom.llm.common import batch, documents, pieces_of, query, stored

GRAM_WORDS, RUN_WORDS = 25, 50
_PRIME, _BASE = (1 << 127) - 1, 0x5851F42D4C957F2D14057B7EF767814F


def text_key(text: str | Column) -> Column:
    return F.xxhash64(text)


def row_key(doc_id: str | Column, key: str | Column) -> Column:
    """One never-null join key of an id and a text key; a null id has a key of its own."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.concat_ws(":", doc_id.isNull(), doc_id, key)


def runs(words: list[int], least: int) -> list[tuple[int, int]]:
    """Shortest runs [start, end) with `least` words, from every line that has one."""
    out, end, held = [], 0, 0
    for start in range(len(words)):
        while held < least and end < len(words):
            held += words[end]
            end += 1
        if held < least:
            break
        out.append((start, end))
        held -= words[start]
    return out


def windows(text: str, gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS) -> list[tuple[int, int, int, int, bytes]]:
    """(start, end, gram hash, gram line, window hash) of every window of a text."""
    lines = [line.encode("utf-8", "surrogatepass") for line in text.split("\n")]
    words = [len(line.split()) for line in lines]
    if sum(words) < run_words:
        return []
    marks = [xxhash.xxh3_128_digest(line) for line in lines]
    n = len(lines)
    forward = runs(words, run_words)
    backward = [(n - end, n - start) for start, end in runs(words[::-1], run_words)]
    held, high = [0], [1]  # rolling hashes of the first lines, and powers
    for mark in marks:
        held.append((held[-1] * _BASE + int.from_bytes(mark, "little") + 1) % _PRIME)
        high.append(high[-1] * _BASE % _PRIME)
    digest = lambda a, b: ((held[b] - held[a] * high[b - a]) % _PRIME).to_bytes(16, "little")
    grams = [(xxhash.xxh64_intdigest(digest(a, b)) - (1 << 63), a, b) for a, b in runs(words, gram_words)]
    # starts and ends of windows both ascend: the smallest gram inside is at the front of a queue
    out, inside, upto = [], deque(), 0
    for start, end in sorted({*forward, *backward}):
        while upto < len(grams) and grams[upto][2] <= end:
            while inside and inside[-1] > grams[upto]:
                inside.pop()
            inside.append(grams[upto])
            upto += 1
        while inside[0][1] < start:
            inside.popleft()
        out.append((start, end, inside[0][0], inside[0][1], digest(start, end)))
    return out


def repeated_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram_words: int = GRAM_WORDS, run_words: int = RUN_WORDS
) -> DataFrame:
    """id, text_key and runs, an array of (first, end) lines to delete, of each document that has some."""
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    fields = [("first", T.IntegerType()), ("end", T.IntegerType()), ("gram", T.LongType()), ("at", T.IntegerType()), ("run", T.BinaryType())]
    schema = T.StructType([*rows.schema.fields[:2], *[T.StructField(n, t) for n, t in fields]])
    arrow = to_arrow_schema(schema)

    def per_partition(batches):
        for b in batches:
            for begin, stop in pieces_of(b.column(2), most=1024):
                part, found, owner = b.slice(begin, stop - begin), [], []
                for k, text in enumerate(part.column(2)):
                    held = windows(text.as_py() or "", gram_words, run_words)
                    found += held
                    owner += [k] * len(held)
                if found:
                    own = pa.array(owner, pa.int32())
                    yield batch(arrow, [part.column(0).take(own), part.column(1).take(own), *zip(*found, strict=True)])

    every = stored(rows.mapInArrow(per_partition, schema), "lines")
    places = every.select("gram", "id", "text_key", "at").distinct()
    shared = places.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    # tables of their own and merge joins, so that adaptive execution can split hot keys at every size
    shared = stored(shared, "grams").hint("merge")
    candidates = every.join(shared, "gram", "left_semi")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key", "first", "end")
    heads = candidates.groupBy("run").agg(F.min(place).alias("head"), F.max(place).alias("tail")).where("head <> tail").select("run", "head")
    later = candidates.join(stored(heads, "heads").hint("merge"), "run").where(place > F.col("head"))
    overlaps = F.col("id").eqNullSafe(F.col("head.id")) & (F.col("text_key") == F.col("head.text_key")) & (F.col("first") < F.col("head.end"))
    later = later.where(~overlaps).select("id", "text_key", "first", "end")
    reach = F.expr("max(end) OVER (PARTITION BY id, text_key ORDER BY first, end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    later = later.withColumn("new", F.when(F.col("first") <= reach, 0).otherwise(1))
    later = later.withColumn("island", F.expr("sum(new) OVER (PARTITION BY id, text_key ORDER BY first, end ROWS UNBOUNDED PRECEDING)"))
    merged = later.groupBy("id", "text_key", "island").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    return merged.groupBy("id", "text_key").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("runs"))


def drop_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed: str = "removed_runs", **options) -> DataFrame:
    """The columns of docs, the text without its repeated runs, and the column `removed`."""
    cuts = repeated_runs(docs, id_col, text_col, **options)
    names = [c for c in docs.columns if c != removed]
    rows = docs.select(F.struct(*names).alias("row"), F.col(id_col).alias("own_id"), text_key(F.col(text_col)).alias("own_key"))
    joined = rows.join(cuts, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("text_key")), "left")
    inside = lambda i: F.exists("runs", lambda r: (r.first <= i) & (i < r.end))
    kept = F.array_join(F.filter(F.split(F.col("row")[text_col], "\n", -1), lambda _, i: ~inside(i)), "\n")
    text = F.when(F.col("runs").isNull(), F.col("row")[text_col]).otherwise(kept)
    none = F.array().cast("array<struct<first:int,end:int>>")
    return joined.select(
        *[(text if c == text_col else F.col("row")[c]).alias(c) for c in names], F.coalesce("runs", none).alias(removed)
    )


# All windows of every text compared as text; ids are unique in documents.
ORACLE = f"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d WHERE text IS NOT NULL),
n AS (SELECT doc_id, i, len(list_filter(regexp_split_to_array(line, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS words FROM x),
c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM n),
r AS (SELECT a.doc_id, a.i AS s, min(b.i) + 1 AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.words >= {RUN_WORDS} GROUP BY 1, 2
 UNION SELECT b.doc_id, max(a.i), b.i + 1 FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.words >= {RUN_WORDS} GROUP BY b.doc_id, b.i),
q AS (SELECT doc_id, s, e, array_to_string(l[s : e - 1], chr(10)) AS run FROM r JOIN d USING (doc_id)),
h AS (SELECT run, min(struct_pack(d := doc_id, s := s, e := e)) AS h FROM q GROUP BY run HAVING count(*) > 1),
cut AS (SELECT doc_id, list(DISTINCT i) AS cut FROM (SELECT doc_id, unnest(range(s, e)) AS i FROM q JOIN h USING (run)
 WHERE struct_pack(d := doc_id, s := s, e := e) > h AND NOT (doc_id = h.d AND s < h.e)) y GROUP BY doc_id)
SELECT doc_id, CASE WHEN cut IS NULL THEN text ELSE coalesce(array_to_string(list_filter(l, lambda x, i: NOT list_contains(cut, i)), chr(10)), '') END AS text,
 coalesce(len(cut), 0) AS lines_removed FROM d LEFT JOIN cut USING (doc_id)"""


@query("op10_line_dedup", ORACLE)
def op10_line_dedup(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    removed = F.aggregate("removed_runs", F.lit(0), lambda n, r: n + r.end - r.first)
    return drop_repeated_runs(docs).select("doc_id", "text", removed.cast("long").alias("lines_removed"))
