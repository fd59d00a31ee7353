"""Linking wanted titles to listings: blocked joins, verified natively."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom.functions.text import normalise_title, single_spaced
from titleloom.operators.quality import blocked

GRAM_SIZES = (8, 3, 2, 1)
WORD_LENGTH = 8


# --- title linkage --------------------------------------------------------


def _words(collapsed: Column, longer_than: int) -> Column:
    return F.filter(F.split(collapsed, " "), lambda w: F.length(w) > longer_than)


def _long(words: Column) -> Column:
    return F.filter(words, lambda w: F.length(w) > 3)


def _padded(phrase: Column) -> Column:
    return F.concat(F.lit(" "), phrase, F.lit(" "))


def _marks(words: Column) -> Column:
    """A bit of 64 per word: lists without a bit in common have no word in common."""

    def mark(w: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))

    return F.aggregate(words, F.lit(0).cast("long"), lambda marks, w: marks.bitwiseOR(mark(w)))


def _wanted(queries: DataFrame, query_id: str, title: str) -> DataFrame:
    qn = normalise_title(F.col(title))
    df = queries.select(F.col(query_id).alias("query_id"), qn.alias("qn"))
    df = df.withColumn("qc", single_spaced(F.col("qn"))).withColumn("q_words", _words(F.col("qc"), 2))
    words, n = F.col("q_words"), F.size("q_words")
    lead, even = F.slice(words, 1, 4), F.filter(words, lambda w, i: i % 2 == 0)
    # A pair that matches shares a word longer than 3, or else one of the first
    # floor(n / 10) + 1 words: phrases start at the first word, and the looser
    # word rule allows at most a tenth of the words to be absent. Without a long
    # word in common, a phrase that has one does not match, nor does the word
    # rule where long words are more than a tenth: no first words then.
    prefix = F.slice(words, F.lit(1), F.floor(n / 10).cast("int") + 1)
    by_short = (
        ((n > 1) & (F.size(_long(lead)) == 0))
        | ((n >= 3) & (F.size(_long(even)) == 0))
        | (n - F.size(_long(words)) >= n * F.lit(0.9))
    )
    blocks = F.concat(F.array(F.concat(F.lit("="), F.col("qc"))), _long(words), F.when(by_short, prefix).otherwise(F.slice(prefix, 1, 0)))
    df = df.withColumn("q_blocks", F.array_distinct(blocks))

    def reach(phrase: Column) -> Column:
        """The last place in q_blocks at which a pair that has the phrase can meet: that of its first long word, which the pair shares."""
        first = F.get(_long(phrase), F.lit(0))
        return F.coalesce(F.array_position("q_blocks", first).cast("int") - 1, F.size("q_blocks"))

    return df.select(
        "query_id", "q_words", "q_blocks", F.length("qn").alias("qn_length"), _padded(F.col("qc")).alias("q_padded"),
        F.when(n > 0, reach(words)).alias("whole_reach"),
        F.when(n > 1, _padded(F.array_join(lead, " "))).alias("q_lead"), reach(lead).alias("lead_reach"),
        F.when(n >= 3, _padded(F.array_join(even, " "))).alias("q_even"), reach(even).alias("even_reach"),
    )


def _offered(titles: DataFrame, title: str, keep: Sequence[str]) -> DataFrame:
    rn = normalise_title(F.col(title))
    df = titles.select(F.col(title).alias("title"), rn.alias("rn"), *keep)
    df = df.withColumn("rc", single_spaced(F.col("rn"))).withColumn("r_words", _words(F.col("rc"), 2))
    blocks = F.array_distinct(F.concat(F.array(F.concat(F.lit("="), F.col("rc"))), F.col("r_words")))
    # Blocked titles lose their blocks instead of being filtered: a filter would
    # be pushed below the caller's distinct and run on every listing.
    allowed = ~blocked(F.col("rn")) & ~blocked(F.col("title"))
    df = df.select(
        "title", "r_words", _padded(F.col("rc")).alias("r_padded"), _marks(F.col("r_words")).alias("r_marks"), *keep,
        F.when(allowed, blocks).alias("r_blocks"),
    )
    # on its own: beside the generator the other columns would be worked out for each block
    return df.withColumn("block", F.explode_outer("r_blocks")).drop("r_blocks")


def _verdicts() -> Column:
    """All verdicts that a row of the index can come to, for _judged to pick from: array<struct<match_type, confidence>>.

    The match rules in order: at 0 to 2 if the title has q_whole, q_lead or q_even, and at 3 if it has the
    block only: same titles (at = 0) or a first long word in common. At a short word, where q_words are set,
    3 stands for all words and each place after it for one word less.
    """

    def verdict(match_type: str, confidence: Column) -> Column:
        return F.struct(F.lit(match_type).alias("match_type"), confidence.alias("confidence"))

    def by(hit: Column) -> Column:
        coverage = F.least(hit / F.col("qn_length"), F.lit(1.0))
        exact, partial = verdict("exact", F.greatest(coverage, F.lit(0.95))), verdict("partial", F.greatest(coverage, F.lit(0.8)))
        return F.when(hit > F.col("qn_length") * F.lit(0.8), exact).when(hit.isNotNull(), partial)

    n = F.size("q_words")

    def by_words(absent: Column) -> Column:
        shared = n - absent
        return (
            F.when((n >= 3) & (absent == 0), verdict("exact-words", F.lit(1.0)))
            .when((n >= 3) & (shared >= n * F.lit(0.9)), verdict("strict-keyword", F.greatest(shared / n, F.lit(0.9))))
            .when((n == 2) & (absent == 0), verdict("exact-short", F.lit(1.0)))
        )

    phrases = F.array(*[by(F.length(phrase) - 2) for phrase in ("q_whole", "q_lead", "q_even")])
    counted = F.transform(F.sequence(F.lit(0), F.floor(n / 10).cast("int")), by_words)
    lone = F.array(F.when(F.col("at") == 0, verdict("exact-clean", F.lit(1.0))).otherwise(by(F.length("block"))))
    return F.concat(phrases, F.when(F.col("q_words").isNotNull(), counted).otherwise(lone))


def _judged(pairs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The verdict of each pair, which comes at the first block that it shares: query_id, title, match_type, confidence.

    Pairs are far more than rows. What does not depend on the title is in
    q_verdicts, and no higher-order function is used here: it would take the pairs out of
    generated code, as would much more code than this.
    """
    padded, words, n = F.col("r_padded"), F.col("q_words"), F.size("q_words")

    def held(phrase: str, place: int) -> Column:
        return F.when(F.contains(padded, F.col(phrase)), F.lit(place))

    # the words that the title has, repeats counted; words are letters, digits and _ only
    there = F.concat(F.lit(" (?:"), F.array_join("r_words", "|"), F.lit(")(?= )"))
    absent = n - F.regexp_count(_padded(F.array_join(words, " ")), there)
    # with a word absent, the title may not hold a long word that the query lacks: at a short word, any
    counted = F.when((absent == 0) | ~padded.rlike("[^ ]{4}"), absent + 3)
    place = F.coalesce(held("q_whole", 0), held("q_lead", 1), held("q_even", 2), F.when(words.isNull(), F.lit(3)).otherwise(counted))
    judged = pairs.select("query_id", "title", "q_words", F.get("q_verdicts", place).alias("verdict"), *keep)
    judged = judged.where(words.isNull() | F.col("verdict").isNotNull())
    return judged.select("query_id", "title", F.col("verdict.match_type").alias("match_type"), F.col("verdict.confidence").alias("confidence"), *keep)


def link_titles(
    queries: DataFrame,
    titles: DataFrame,
    query_id: str = "query_id",
    query_title: str = "title",
    title: str = "title",
    min_confidence: float = 0.0,
    keep: Sequence[str] = (),
    tile: int | None = None,
) -> DataFrame:
    """(query_id, title, match_type, confidence, *keep) of all matching pairs.

    titles should hold each title once; keep names its columns to carry along,
    which saves joining them back. The pairs come from one equi-join on blocking
    words; a pair that shares several is kept only at its first shared one,
    which needs no second shuffle. The blocking is lossless. With tile, words
    that more than so many titles of a side hold are joined in tiles of about so
    many by so many titles, each on its own: for inputs where single words make a large
    part of the pairs. Both sides are then counted by word first.
    """
    index = query_index(queries, query_id, query_title)
    if tile is None:
        return link_indexed(index, titles, title, min_confidence, keep)
    offered, index = _tiled(_offered(titles, title, keep), index, tile)
    return _linked(offered, index, ["block", "q_tile", "r_tile"], min_confidence, keep)


def query_index(queries: DataFrame, query_id: str = "query_id", title: str = "title") -> DataFrame:
    """The wanted titles by blocking word (block), with what the match rules need of them."""
    # posexplode_outer: posexplode would infer a filter on the block list, which is
    # pushed down and computes the list for every listing. The join drops nulls.
    df = _wanted(queries, query_id, title).select("*", F.posexplode_outer("q_blocks").alias("at", "block"))
    at = F.col("at")
    earlier = F.slice("q_blocks", F.lit(2), F.greatest(at - 1, F.lit(0)))

    def tried(phrase: str, reach: str) -> Column:
        return F.when((at > 0) & (at <= F.col(reach)), F.col(phrase))

    df = df.select(
        "query_id", "block", "at", "qn_length", "q_padded", tried("q_padded", "whole_reach").alias("q_whole"),
        tried("q_lead", "lead_reach").alias("q_lead"), tried("q_even", "even_reach").alias("q_even"),
        F.when((at > 0) & (F.length("block") <= 3), F.col("q_words")).alias("q_words"), earlier.alias("q_earlier"),
    )
    return df.withColumn("q_marks", _marks(F.col("q_earlier"))).withColumn("q_verdicts", _verdicts()).drop("qn_length")


def link_indexed(index: DataFrame, titles: DataFrame, title: str = "title", min_confidence: float = 0.0, keep: Sequence[str] = ()) -> DataFrame:
    """link_titles with the output of query_index, which may be stored."""
    return _linked(_offered(titles, title, keep), index, ["block"], min_confidence, keep)


def _linked(offered: DataFrame, index: DataFrame, by: list[str], min_confidence: float, keep: Sequence[str]) -> DataFrame:
    apart = F.col("q_marks").bitwiseAND(F.col("r_marks")) == 0
    first = (F.col("q_padded") != F.col("r_padded")) & (apart | ~F.arrays_overlap("q_earlier", "r_words"))
    pairs = offered.join(index, by).where((F.col("at") == 0) | first)
    judged = _judged(pairs, keep)
    return judged.where(F.col("confidence") >= min_confidence) if min_confidence > 0 else judged


def _tiled(offered: DataFrame, index: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with q_tile and r_tile: a row has one tile of its own side and comes to all tiles of the other.

    Dealt by word and tiles into a fixed number of partitions, for their bytes
    do not tell how many pairs they make, and adaptive execution would join them.
    """

    def tiles(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("block").agg(F.ceil(F.count("*") / tile).cast("int").alias(name))

    # at most one word for every tile rows of a side: small beside either
    crowded = F.broadcast(tiles(index, "q_tiles").join(tiles(offered, "r_tiles"), "block").where("q_tiles > 1 OR r_tiles > 1"))
    parts = 4 * int(offered.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame, own: str, other: str, *key: str) -> DataFrame:
        count = {x: F.coalesce(f"{x}_tiles", F.lit(1)) for x in (own, other)}
        df = df.join(crowded, "block", "left").withColumn(f"{own}_tile", F.pmod(F.xxhash64(*key), count[own]).cast("int"))
        df = df.withColumn(f"{other}_tile", F.explode(F.sequence(F.lit(0), count[other] - 1)))
        return df.drop("q_tiles", "r_tiles").repartition(parts, "block", "q_tile", "r_tile")

    return dealt(offered, "r", "q", "title"), dealt(index, "q", "r", "query_id", "q_padded")


# --- substring joins ------------------------------------------------------


def _grams(text: Column, n: int) -> Column:
    # overlapping matches in one pass over the text; substring() would rescan it
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1))


def _anchor(needle: Column) -> Column:
    """struct<kind, anchor> by which a needle is looked up.

    A word with spaces on both sides inside the needle stands as a word in
    every text that contains the needle: long ones are the best anchor. Other
    needles use their first characters, as many as the largest gram that fits.
    """
    parts = F.split(needle, " ")
    inner = F.filter(parts, lambda w, i: (i > 0) & (i < F.size(parts) - 1))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    kind = F.when(longest["n"] >= WORD_LENGTH, F.lit(0))
    for n in GRAM_SIZES:
        kind = kind.when(F.length(needle) >= n, F.lit(n))
    return F.struct(
        kind.alias("kind"),
        F.when(longest["n"] >= WORD_LENGTH, longest["w"]).otherwise(F.substr(needle, F.lit(1), kind)).alias("anchor"),
    )


def _anchors(text: Column, kinds: Column) -> Column:
    """All anchors of a text, of the kinds that the needles use."""

    def of(kind: int) -> Column:
        found = _grams(text, kind) if kind else F.split(text, " ")
        return F.when(F.array_contains(kinds, kind), found).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(kind) for kind in (0, *GRAM_SIZES)]))


def contains_join(needles: DataFrame, texts: DataFrame, needle: str, text: str, key: str | None = None, sized_by: DataFrame | None = None) -> DataFrame:
    """All rows of needles x texts where text contains needle (as given, case matters).

    Equal anchors first, then a native contains: no cross join, nothing lost,
    and null or empty needles match nothing. Texts give anchors of the kinds
    that needles use, which a scalar subquery over the needles tells; the
    join is left to adaptive execution. With key (unique in texts) only keys and
    anchors take part in it, and the texts join back for the candidates.
    sized_by is a cheaper table that holds all the needles, for when they are
    themselves the result of a join.
    """

    def anchored(df: DataFrame) -> DataFrame:
        return df.where(F.length(needle) > 0).withColumn("_a", _anchor(F.col(needle)))

    kinds = anchored(needles if sized_by is None else sized_by).agg(F.sort_array(F.collect_set("_a.kind")).alias("kinds"))
    keyed = anchored(needles).withColumn("_anchor", F.col("_a.anchor")).drop("_a")
    anchor = F.explode_outer(_anchors(F.col(text), kinds.scalar()))  # outer: see link_titles
    found = F.contains(F.col(text), F.col(needle))
    if key is None:
        return texts.withColumn("_anchor", anchor).join(keyed, "_anchor").where(found).drop("_anchor")
    candidates = texts.select(key, anchor.alias("_anchor")).join(keyed, "_anchor").drop("_anchor")
    return texts.join(candidates, key).where(found)


def query_words(queries: DataFrame, longer_than: int = 2) -> DataFrame:
    """(query_id, word): the lower-case words of each query that count."""
    words = queries.select("query_id", F.explode(F.array_distinct(F.split(F.lower("title"), " "))).alias("word"))
    return words.where(F.length("word") > longer_than)


def titles_with_word(words: DataFrame, titles: DataFrame) -> DataFrame:
    """(word, title) pairs where the title contains the word; both distinct."""
    low = titles.select("title", F.lower("title").alias("low"))
    return contains_join(words.select("word").distinct(), low, "word", "low").select("word", "title")


def any_word_join(queries: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, title) pairs where the title contains any query word."""
    words = query_words(queries)
    return titles_with_word(words, titles).join(words, "word").select("query_id", "title").distinct()


def substring_search(requests: DataFrame, titles: DataFrame, sized_by: DataFrame | None = None) -> DataFrame:
    """(request_id, title) where the title contains the wanted text, case-insensitive."""

    def needles(df: DataFrame) -> DataFrame:
        return df.select("request_id", F.lower("wanted").alias("needle"))

    low = titles.select("title", F.lower("title").alias("low"))
    known = None if sized_by is None else needles(sized_by)
    return contains_join(needles(requests), low, "needle", "low", sized_by=known).select("request_id", "title")


def id_then_title(requests: DataFrame, listings: DataFrame, work_id: str, title: str) -> DataFrame:
    """Listings by work id; requests without any hit fall back to their title text.

    requests: request_id, work_id (may be null), wanted. Adds via = id | title.
    """
    by_id = listings.join(
        requests.select("request_id", F.col("work_id").alias("_wanted_id")),
        F.col(work_id) == F.col("_wanted_id"),
    ).drop("_wanted_id")
    # the requests that have a hit are told by the ids alone
    known = listings.select(F.col(work_id).alias("work_id")).distinct()
    without = requests.join(known, "work_id", "left_anti")
    titles = listings.select(F.col(title).alias("title")).distinct()
    pairs = substring_search(without, titles, sized_by=requests).withColumnRenamed("title", "_title")
    by_title = listings.join(pairs, F.col(title) == F.col("_title")).drop("_title")
    return by_id.withColumn("via", F.lit("id")).unionByName(by_title.withColumn("via", F.lit("title")))


def tag_by_dictionary(
    df: DataFrame, dictionary: DataFrame, text: str, key: str | None = None, generated_from: str | None = None
) -> DataFrame:
    """Add tag: id of the first dictionary phrase found in text, of dict_id's type.

    dictionary: priority, phrase, dict_id. The smallest priority comes first,
    then the smallest id; rows without a phrase, a priority or an id take no
    part. Looked up per row by its unique key, or without a key over the
    distinct texts (for short texts that repeat). generated_from names a column
    whose hash gives rows without a hit a stable generated id; tag is text then.
    """
    phrases = dictionary.select("priority", "phrase", "dict_id").where("priority IS NOT NULL AND dict_id IS NOT NULL")
    if key is None:
        texts = df.select(F.col(text).alias("_by"), F.col(text).alias("_text")).distinct()
        found = contains_join(phrases, texts, "phrase", "_text")
    else:
        texts = df.select(F.col(key).alias("_by"), F.col(text).alias("_text"))
        found = contains_join(phrases, texts, "phrase", "_text", key="_by")
    first = found.groupBy("_by").agg(F.min(F.struct("priority", "dict_id")).alias("_hit")).select("_by", F.col("_hit.dict_id").alias("tag"))
    tagged = df.join(first, F.col(key or text) == F.col("_by"), "left").drop("_by")
    if generated_from is None:
        return tagged
    made = F.concat(F.lit("auto-"), F.substring(F.md5(generated_from), 1, 12))
    return tagged.withColumn("tag", F.coalesce(F.col("tag").cast("string"), made))
