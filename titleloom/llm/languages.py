"""Language by compression: the dictionary that encodes a text in the fewest bytes names its language.

Each language has a zstandard raw-content dictionary made of whole training
texts. A text is cut into pieces; its size under a language is the sum of the
compressed pieces plus the language's share of the training rows as code length
(-log2 share, in bytes). The smallest size wins; where the second is nearly as
small the row is marked as rejected. Texts and dictionaries are compared
as lower-cased letters, everything between letters being one blank.

Training reads a bounded sample: per language at most `texts` texts of at most
`bytes_per_language` bytes together. Texts are made distinct by hash first and
the smallest hashes are drawn, so copies neither fill the sample nor thin it;
texts that alone are longer, or hold no letter, are not sampled.

Results: one row per input row. Null texts and texts without a letter are
`und` with score 0 and rejected. Without training rows (empty table, no
language) every row is `und`. Ties go to the more frequent language, then to
the smaller name. Repeated rows get equal results; null ids are passed on.
Columns other than those named are not read.
"""

from __future__ import annotations

import math
import re
import zlib

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from titleloom.llm.common import batch, documents, pieces_of, query, remainder

TEXTS, BYTES_PER_LANGUAGE, PIECE, LEVEL = 400, 220_000, 2000, 3
SLICES = 16
UNKNOWN = "und"
MIN_MARGIN = 0.004
ADDED = ("lang_pred", "lang_score", "lang_rejected")
BETWEEN = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    return BETWEEN.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def learn(labelled: DataFrame, text_col: str, lang_col: str, texts: int = TEXTS, size: int = BYTES_PER_LANGUAGE) -> dict[str, tuple[bytes, int]]:
    """Dictionary content and number of training rows by language, from labelled rows."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    usable = rows.where(F.octet_length("text") <= size).where(F.col("text").rlike(r"\p{L}")).withColumn("key", F.xxhash64("text"))
    drawn = usable.select("lang", "key").distinct().withColumn("draw", F.pmod("key", F.lit(1 << 30)))
    # first within slices of the hashes: no task takes the draws of all partitions for a language
    drawn = drawn.withColumn("slice", F.pmod(F.shiftright("key", 40), F.lit(SLICES)))
    for group in ("lang, slice", "lang"):
        drawn = drawn.withColumn("k", F.expr(f"row_number() OVER (PARTITION BY {group} ORDER BY draw, key)")).where(F.col("k") <= texts)
    taken = F.broadcast(drawn.select("lang", "key", "k"))  # bounded by languages x texts
    first = usable.join(taken, ["lang", "key"]).select("lang", "k", "text").distinct()
    held: dict[str, list[bytes]] = {lang: [] for lang in counts}
    free = dict.fromkeys(counts, size)
    for r in first.orderBy("lang", "k").toLocalIterator():
        content = letters(r["text"])
        if 0 < len(content) < free[r["lang"]]:
            held[r["lang"]].append(content)
            free[r["lang"]] -= len(content) + 1
    return {lang: (b" ".join(held[lang]), n) for lang, n in counts.items()}


class Coder:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, models: dict[str, tuple[bytes, int]], level: int = LEVEL):
        total = sum(n for _, n in models.values())
        self.languages = []
        for lang, (content, n) in sorted(models.items(), key=lambda m: (-m[1][1], m[0])):
            options = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            if content:
                words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                words.precompute_compress(level=level)
                options["dict_data"] = words
            self.languages.append((lang, zstandard.ZstdCompressor(**options).compress, -math.log2(n / total) / 8))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the margin 1 - smallest/second smallest size; a single language has margin 1."""
        content = letters(text) if text else b""
        if not self.languages or not any(map(str.isalpha, content.decode())):
            return UNKNOWN, 0.0
        parts = [content[i : i + PIECE] for i in range(0, len(content), PIECE)]
        best, second, name = math.inf, math.inf, UNKNOWN
        for lang, compress, prior in self.languages:
            size = prior + sum([len(compress(p)) for p in parts])
            if size < best:
                best, second, name = size, best, lang
            elif size < second:
                second = size
        return name, 1.0 - best / second


_CODERS: dict[tuple, Coder] = {}


def coder_of(models: dict[str, tuple[bytes, int]]) -> Coder:
    """The coder of these models, kept by the worker process for its next tasks."""
    key = tuple((lang, zlib.crc32(content), n) for lang, (content, n) in sorted(models.items()))
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(models)
    return _CODERS[key]


def identify(docs: DataFrame, models: dict[str, tuple[bytes, int]], text_col: str = "text", min_margin: float = MIN_MARGIN, keep: list[str] | None = None, names_added: tuple[str, str, str] = ADDED) -> DataFrame:
    """The `keep` columns (all) with prediction, score and rejection, which replace columns of these names."""
    added = list(zip(names_added, (T.StringType(), T.DoubleType(), T.BooleanType()), strict=True))
    names = [c for c in (docs.columns if keep is None else keep) if c not in dict(added)]
    at = names.index(text_col) if text_col in names else len(names)  # the text goes to the workers once
    sent = names if at < len(names) else [*names, text_col]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(sent)])
    schema = T.StructType([*rows.schema.fields[: len(names)], *[T.StructField(n, t) for n, t in added]])
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by languages x bytes_per_language

    def per_partition(batches):
        coder = coder_of(shared.value)
        for b in batches:
            texts = b.column(at)
            for start, end in pieces_of(texts):
                found = [coder.predict(t.as_py()) for t in texts[start:end]]
                part = b.slice(start, end - start)
                yield batch(arrow, [*part.columns[: len(names)], [f[0] for f in found], [f[1] for f in found], [f[0] == UNKNOWN or f[1] < min_margin for f in found]])

    return rows.mapInArrow(per_partition, schema).toDF(*names, *[n for n, _ in added])


def keep_identified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of docs whose language is told clearly, learned from the labelled ones."""
    models = learn(docs, text_col, lang_col)
    names = tuple(f"__{n}" for n in ADDED)
    return identify(docs, models, text_col, names_added=names, **options).where(~F.col(names[2])).select(*[F.col(f"`{c}`") for c in docs.columns])


def training_rows(folds: int = 5) -> Column:
    return remainder("doc_id", folds) != 0


@query("op5_language_id")
def op5_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    models = learn(docs.where(training_rows()), "text", "lang")
    return identify(docs, models, keep=["doc_id"]).select(
        "doc_id", (~training_rows()).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
