"""SQL text of the shared rules, for the oracle side."""

from titleloom import rules
from titleloom.functions.attributes import ORDINAL_PATTERNS, SEASON_PATTERNS
from titleloom.functions.text import alternation


def any_of(x: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def normalised(x: str) -> str:
    words = f"regexp_replace(strip_accents(lower({x})), '[^A-Za-z0-9_]+', ' ', 'g')"
    return rf"trim(regexp_replace({words}, '\b(?:{alternation(rules.STOP_WORDS)})\b', '', 'g'))"


def collapsed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def cleaned(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '\s+', ' ', 'g'), '\[[^\]]*\]', '', 'g'))"


def search_form(x: str) -> str:
    words = alternation(rules.SEARCH_FORMAT_WORDS)
    inner = rf"regexp_replace(regexp_replace({x}, '\d{{4}}', ''), '(?i){words}', '', 'g')"
    return collapsed(f"regexp_replace({inner}, '[._+-]', ' ', 'g')")


def tier(x: str) -> str:
    t = f"lower({x})"

    def word(body):
        return rf"regexp_matches({t}, '\b{body}\b')"

    return f"""CASE WHEN {any_of(t, '2160p', '4k')} THEN '2160p' WHEN {any_of(t, '1080p')} THEN '1080p'
 WHEN {any_of(t, '720p')} THEN '720p' WHEN {any_of(t, '.web-dl.')} THEN '1080p' WHEN {any_of(t, '.remux.')} THEN '2160p'
 WHEN {word('hd')} THEN 'HD' WHEN {word('(?:uhd|ultra.hd)')} THEN '2160p' WHEN {word('(?:fhd|full.hd)')} THEN '1080p'
 WHEN {word('hd.rip')} THEN '720p' WHEN {word('high.def')} THEN 'HD'
 WHEN {any_of(t, '.bluray.', '.blu-ray.', '.webrip.')} THEN '1080p' WHEN {any_of(t, '.hdtv.')} THEN '720p'
 WHEN {any_of(t, '.brrip.', '.bdrip.')} THEN '1080p' WHEN {any_of(t, 'remux', 'web-dl', 'bluray', 'blu-ray')} THEN '1080p'
 WHEN {any_of(t, 'hdtv')} THEN '720p' ELSE 'HD' END"""


def simple_tier(x: str) -> str:
    t = f"lower({x})"
    return f"""CASE WHEN {any_of(t, '2160p', '4k')} THEN '2160p' WHEN {any_of(t, '1080p')} THEN '1080p'
 WHEN {any_of(t, '720p')} THEN '720p' WHEN {any_of(t, '480p')} THEN '480p' ELSE 'HD' END"""


def curated_tier(x: str) -> str:
    m = f"lower(regexp_extract({x}, '(?i)(4K|2160p|1080p|720p|480p|SD)', 1))"
    return f"CASE {m} WHEN '' THEN '1080p' WHEN '2160p' THEN '4K' ELSE {m} END"


def tier_score(x: str) -> str:
    t = f"lower({x})"
    return f"""CASE WHEN {any_of(t, '4k', '2160p')} THEN 100 WHEN {any_of(t, '1080p')} THEN 80
 WHEN {any_of(t, '720p')} THEN 60 WHEN {any_of(t, '480p')} THEN 40 WHEN {any_of(t, 'bluray', 'web-dl')} THEN 30
 WHEN {any_of(t, 'dvdrip')} THEN 20 ELSE 10 END"""


def language(x: str, english: bool = False) -> str:
    t = f"lower({x})"
    extra = f" WHEN {any_of(t, 'english', 'eng')} THEN 'en'" if english else ""
    return f"""CASE WHEN {any_of(t, 'dual')} THEN 'pt-BR,en' WHEN {any_of(t, 'dublado')} THEN 'pt-BR'
 WHEN {any_of(t, 'legendado')} THEN 'pt'{extra} ELSE 'pt-BR' END"""


def number_in(x: str, pattern: str, group: int = 1) -> str:
    return f"TRY_CAST(regexp_extract({x}, '{pattern}', {group}) AS BIGINT)"


def season(x: str) -> str:
    parts = []
    for pattern in SEASON_PATTERNS:
        n = number_in(x, pattern)
        parts.append(f"CASE WHEN {n} > 0 THEN {n} END")
    return "coalesce(" + ", ".join(parts) + ")"


def ordinal(x: str, fix: bool = False) -> tuple[str, str, str]:
    """(season, episode, raw) expressions."""
    nxm, sxe, words, ep, pair, whole = ORDINAL_PATTERNS

    def both(p):
        return number_in(x, p, 1), number_in(x, p, 2), p

    def only(p):
        return "1", number_in(x, p, 1), p

    cases = [both(nxm), both(sxe), both(words) if fix else only(words), only(ep), both(pair), only(whole)]
    digits = rf"regexp_extract({x}, '\d+')"
    s = "CASE " + " ".join(f"WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a}" for a, b, _ in cases) + " ELSE 1 END"
    e = "CASE " + " ".join(f"WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {b}" for a, b, _ in cases)
    e += f" ELSE coalesce(TRY_CAST({digits} AS BIGINT), 0) END"
    r = "CASE " + " ".join(
        f"WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN regexp_extract({x}, '{p}')" for a, b, p in cases
    )
    r += f" WHEN {digits} = '' THEN 'unknown' ELSE {digits} END"
    return f"CAST({s} AS BIGINT)", f"CAST({e} AS BIGINT)", r


def size_bytes(x: str) -> str:
    p = r"(?i)(\d+\.?\d*)\s*(GB|MB|G|M)"
    v = f"TRY_CAST(regexp_extract({x}, '{p}', 1) AS DOUBLE)"
    u = f"upper(regexp_extract({x}, '{p}', 2))"
    return f"coalesce(CASE WHEN {u} IN ('GB','G') THEN {v}*1073741824 WHEN {u} IN ('MB','M') THEN {v}*1048576 END, 1610612736.0)"


def size_text(x: str, units: str) -> str:
    p = rf"(?i)(\d+\.?\d*)\s*({units})"
    return f"""CASE WHEN coalesce(regexp_extract({x}, '{p}', 1), '') = '' THEN 'Size not specified'
 ELSE concat(regexp_extract({x}, '{p}', 1), ' ', upper(regexp_extract({x}, '{p}', 2))) END"""


def bytes_text(x: str) -> str:
    i = f"least(CAST(floor(ln({x})/ln(1024)) AS INT), 4)"
    return f"""CASE WHEN coalesce({x},0)=0 THEN 'Unknown' ELSE
 concat(printf('%.1f', round({x}/pow(1024,{i}),1)), ' ', ['B','KB','MB','GB','TB'][{i}+1]) END"""


def blocked(x: str, words=rules.BLOCKED_KEYWORDS) -> str:
    return any_of(f"lower({x})", *words)


def title_bonus(x: str) -> str:
    t = f"lower({x})"
    return f"""(CASE WHEN {any_of(t, 'dual', 'dublado')} THEN 25 ELSE 0 END
 + CASE WHEN {any_of(t, 'bluray', 'web-dl')} THEN 20 ELSE 0 END
 + CASE WHEN regexp_matches({t}, 's[0-9]+e[0-9]+') THEN 15 ELSE 0 END)"""


def score(tier_col: str, confidence: str, title: str, seeders: str) -> str:
    return f"""CAST(round(CASE {tier_col} WHEN '2160p' THEN 400 WHEN '1080p' THEN 300 WHEN '720p' THEN 200 WHEN 'HD' THEN 150 ELSE 100 END
 + {confidence}*200 + {title_bonus(title)} + CASE WHEN {seeders} > 0 THEN least({seeders}*0.5::DOUBLE, 50.0::DOUBLE) ELSE 0 END) AS INT)"""


def multiplier(tier_col: str) -> str:
    return f"CASE {tier_col} WHEN '2160p' THEN 1.5::DOUBLE WHEN '1080p' THEN 1.3::DOUBLE WHEN '720p' THEN 1.0 WHEN 'HD' THEN 1.1::DOUBLE ELSE 1.0 END"


def search_tables(queries: str, titles: str) -> str:
    """Tables q, t and linked (query_id, title, match_type, confidence) by brute force.

    queries: SQL giving query_id, title. titles: SQL giving title, distinct.
    """
    return f"""q0 AS (SELECT query_id, {normalised('title')} AS qn FROM ({queries}) a),
q1 AS (SELECT *, {collapsed('qn')} AS qc FROM q0),
q AS (SELECT *, list_filter(string_split(qc,' '), lambda w: length(w)>2) AS qw FROM q1),
t0 AS (SELECT title, {normalised('title')} AS rn FROM ({titles}) a),
t1 AS (SELECT *, {collapsed('rn')} AS rc FROM t0 WHERE NOT {blocked('rn')} AND NOT {blocked('title')}),
t AS (SELECT *, concat(' ',rc,' ') AS rp, list_filter(string_split(rc,' '), lambda w: length(w)>2) AS rw FROM t1),
pair AS (SELECT query_id, title, qn, qc, rc, qw, rw, len(qw) AS n,
  CASE WHEN len(qw)>0 AND contains(rp, concat(' ',qc,' ')) THEN qc
   WHEN len(qw)>1 AND contains(rp, concat(' ',array_to_string(qw[1:4],' '),' ')) THEN array_to_string(qw[1:4],' ')
   WHEN len(qw)>=3 AND contains(rp, concat(' ',array_to_string(list_filter(qw, lambda w, i: i%2=1),' '),' ')) THEN array_to_string(list_filter(qw, lambda w, i: i%2=1),' ')
   ELSE list_filter(qw, lambda w: length(w)>3 AND list_contains(rw,w))[1] END AS phrase,
  len(list_filter(qw, lambda w: list_contains(rw,w))) AS shared,
  len(list_filter(rw, lambda w: length(w)>3 AND NOT list_contains(qw,w))) AS foreign_words
 FROM q, t),
judged AS (SELECT query_id, title,
  CASE WHEN qc=rc THEN 'exact-clean'
   WHEN phrase IS NOT NULL AND length(phrase) > length(qn)*0.8 THEN 'exact'
   WHEN phrase IS NOT NULL THEN 'partial'
   WHEN n>=3 AND shared=n THEN 'exact-words'
   WHEN n>=3 AND shared>=n*0.9 AND foreign_words=0 THEN 'strict-keyword'
   WHEN n=2 AND shared=2 THEN 'exact-short' END AS match_type,
  CASE WHEN qc=rc THEN 1.0::DOUBLE
   WHEN phrase IS NOT NULL AND length(phrase) > length(qn)*0.8 THEN greatest(least(length(phrase)/length(qn),1.0::DOUBLE),0.95::DOUBLE)
   WHEN phrase IS NOT NULL THEN greatest(least(length(phrase)/length(qn),1.0::DOUBLE),0.8::DOUBLE)
   WHEN n>=3 AND shared=n THEN 1.0::DOUBLE
   WHEN n>=3 AND shared>=n*0.9 AND foreign_words=0 THEN greatest(shared/n,0.9::DOUBLE)
   WHEN n=2 AND shared=2 THEN 1.0::DOUBLE END AS confidence
 FROM pair),
linked AS (SELECT * FROM judged WHERE match_type IS NOT NULL)"""
