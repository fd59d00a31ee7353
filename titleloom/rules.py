"""Word lists, tier tables, patterns and limits.

These are data, not logic. They have to hold exactly these values for results
to agree with catalogues produced elsewhere; the operators take them as
defaults and accept replacements.
"""

# --- fixed values: titles -------------------------------------------------

STOP_WORDS = ("o", "a", "os", "as", "the", "and", "de", "da", "do", "das", "dos")

SEARCH_FORMAT_WORDS = (
    "OPEN MATTE IMAX", "WEB-DL", "H264", "AC3", "DUAL", "1080p", "720p", "4K",
    "COMPLETA", "TEMPORADA", "SEASON",
)

BLOCKED_KEYWORDS = (
    "promo", "trailer", "sample", "1xbet", "bet", "propaganda",
    "apostas", "casino", "bônus", "aviator", "blaze", "bonus",
    "spam", "advertisement", "publicidade",
)

BLOCKED_FILE_KEYWORDS = (
    "promo", "1xbet", "bet", "propaganda", "publicidade", "advertisement",
    "sample", "trailer", "teaser", "preview", "torrentdosfilmes",
)

FUNCTION_WORDS = (
    "o", "a", "os", "as", "do", "da", "dos", "das",
    "no", "na", "nos", "nas", "pelo", "pela", "pelos", "pelas",
    "um", "uma", "uns", "umas", "é", "são", "foi", "foram",
)

# phrases that a main title loses, in this order
SEASON_PHRASES = (r"(?i)temporada\s*\d+", r"(?i)season\s*\d+", r"(?i)\s*\d+ª?\s*temp", r"(?i)s\d+")
# what a page title loses: "(dddd)" once; separators of a search title
YEAR_IN_BRACKETS = r"\([0-9]{4}\)"
TITLE_SEPARATORS = "[._+-]"

# (words or pattern, points) of the relevance score's title part
TITLE_BONUS_WORDS = ((("dual", "dublado"), 25), (("bluray", "web-dl"), 20))
TITLE_BONUS_PATTERN = (r"s[0-9]+e[0-9]+", 15)

ACCENTED_LETTERS = "áàâãéèêíïóôõöúüçñ"

# (keyword, language tag), first hit wins
LANGUAGE_KEYWORDS = (("dual", "pt-BR,en"), ("dublado", "pt-BR"), ("legendado", "pt"))
LANGUAGE_KEYWORDS_WITH_ENGLISH = LANGUAGE_KEYWORDS + (("english", "en"), ("eng", "en"))
DEFAULT_LANGUAGE = "pt-BR"

SUPPORTED_LANGUAGES = (
    "pt-BR", "pt", "en", "en-US", "es", "fr", "de", "it", "ja", "ja-JP",
    "ko", "zh", "zh-CN", "zh-TW", "ru", "ar", "hi", "multi", "dual",
)

# --- fixed values: tiers --------------------------------------------------

SEARCH_TIERS = ("2160p", "1080p", "720p", "HD")
SEARCH_TIER_BASE = {"2160p": 400, "1080p": 300, "720p": 200, "HD": 150}
SEARCH_TIER_BASE_DEFAULT = 100

CURATED_TIERS = ("4K", "1080p", "720p", "SD")
CURATED_TIER_SCORE = {"4K": 4, "1080p": 3, "720p": 2, "SD": 1}

DELIVERY_TIER_RANK = {"2160p": 6, "4k": 6, "1080p": 5, "720p": 4, "480p": 3, "hd": 2}

ESTIMATED_SEEDERS_DEFAULT = 30
TIER_SEEDER_MULTIPLIER = {"2160p": 1.5, "1080p": 1.3, "720p": 1.0, "HD": 1.1}

# --- fixed values: files, sizes, ids --------------------------------------

MEDIA_SUFFIXES = (
    "mp4", "mkv", "avi", "mov", "wmv", "flv", "webm", "m4v",
    "mpg", "mpeg", "3gp", "ts", "mts", "m2ts", "vob",
)

# the weighted main item takes all of them but these two
WEIGHTED_SUFFIXES = tuple(s for s in MEDIA_SUFFIXES if s not in ("3gp", "m2ts"))

DEFAULT_SIZE_BYTES = 1.5 * 1024 ** 3
SIZE_UNSPECIFIED = "Size not specified"
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")
DEFAULT_SEEDERS = 50
DEFAULT_TITLE = "Unknown title"

JOB_SUCCESS = "downloaded"
JOB_FAILURES = ("magnet_error", "virus", "dead", "error")
JOB_LIMIT_MINUTES = 30

# --- fixed values: limits -------------------------------------------------

TOP_PER_TIER = 3
LOOKUP_LIMIT = 500
DELIVERY_LIMIT = 15
SOURCE_CAP = 20
SAVE_CAP = 10
MIN_TITLE_LENGTH = 5
CACHE_TTL_SECONDS = 3600
SESSION_IDLE_SECONDS = 24 * 3600
