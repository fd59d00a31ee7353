"""Schemas of the keyed tables and of the JSON inputs."""

from pyspark.sql import types as T

_S, _I, _L, _D, _TS = (T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType())
_STRINGS = T.ArrayType(_S)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# keyed tables
LISTING = _struct(
    content_hash=_S, provider=_S, source_id=_S, title=_S, size_bytes=_L, type=_S,
    uploaded_at=_TS, seeders=T.ShortType(), trackers=_STRINGS, languages=_STRINGS, tier=_S,
)
LISTING_ITEM = _struct(
    item_id=_L, content_hash=_S, item_index=_I, title=_S, size_bytes=_L,
    work_id=_S, season=_I, episode=_I, alt_id=_I, alt_episode=_I,
)
ITEM_ATTACHMENT = _struct(content_hash=_S, item_index=_I, item_id=_L, title=_S, size_bytes=_L)

# one curated entry and the catalogue document that holds an array of them
CURATED = _struct(
    imdbId=_S, title=_S, magnet=_S, quality=_S, seeds=_L, size=_S,
    category=_S, language=_S, addedAt=_TS,
)
CATALOGUE = _struct(version=_S, magnets=T.ArrayType(CURATED))

# search payload: {"results": [...], "count": n}
SEARCH_RESULT = _struct(
    title=_S, magnet_link=_S, seed_count=_L, leech_count=_L, size=_S,
    info_hash=_S, date=_S, details=_S, original_title=_S, imdb=_S,
)
SEARCH_PAYLOAD = _struct(results=T.ArrayType(SEARCH_RESULT), count=_L)

# post payload: an array of posts with nested rendered fields
_RENDERED = _struct(rendered=_S)
POST = _struct(title=_RENDERED, content=_RENDERED, modified=_S)
POST_PAYLOAD = T.ArrayType(POST)

# every listing source maps to this
SCORED_LISTING = _struct(
    source_row=_S, title=_S, link=_S, seeders=_L, leechers=_L, size_text=_S, size_bytes=_D,
    tier=_S, provider=_S, language=_S, type=_S, relevance_score=_I, season=_L,
    updated_at=_TS, confidence=_D,
)
