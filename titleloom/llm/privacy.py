"""Personal data in texts, and the terms that give it away.

Direct identifiers are found by pattern: e-mail addresses, IP addresses, card
and phone numbers; each distinct value is a protected entity. The corpus then
tells how strongly a nearby term reveals an entity: with n documents, n_e of
them with the entity, n_t with the term anywhere and n_et with the term within
`reach` terms of the entity, the disclosure is

    pmi / ic = log2(n_et * n / (n_e * (n_t + UNSEEN))) / log2(n / n_e)

near 1 where the term occurs with the entity only, 0 where it says nothing. All
pairs are rated, those of one document too (`support` is 1). Terms near the
entity are generalised from `generalise` on and removed from `remove` on. UNSEEN
smooths the rating: of a few texts nearly every term is unique, which says little,
so a pair of one text is generalised from 7 texts on and removed from 9,200 on.
Documents of equal text (by hash) count as one, so copying changes no rating.

Offsets count code points, ends are exclusive. Terms are runs of three letters
or more, compared in lower case.

Results: one row per input row. Null and empty texts have no spans. Null and
repeated ids stay rows of their own; repeated texts get equal spans. An empty
table gives no rows. Other columns are not read; in `sanitise` they are kept,
and a column called spans is replaced.

One pass over the texts writes spans, contexts and term counts (combined per
task in a table of bounded size); all that follows joins and groups these. A
text with c copies adds 1 / c a copy to its terms' counts; the repeated texts'
hashes are broadcast up to BROADCAST_COPIES rows, counted before.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from titleloom.llm.common import batch, documents, query, stored
from titleloom.llm.lines import text_key

KINDS = ("email", "ip", "card", "phone")
REACH, SUPPORT, GENERALISE, REMOVE = 8, 1, 0.9, 0.98
BROADCAST_COPIES = 500_000
UNSEEN = 0.2  # texts with a term that the corpus does not show
MEMO = 250_000  # terms counted by a task before it passes its counts on
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match from inside a run of digits fails as the one from its start does.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
Span = tuple[str, int, int]


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain.domain, in one walk from @ to @."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = last + len(text[last:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def identifiers(text: str) -> list[Span]:
    """Base spans by kind, then start."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def entity(kind: str, text: str) -> str:
    return f"{kind}:{text.lower() if kind == 'email' else ''.join(c for c in text if c in '0123456789.' and (kind == 'ip' or c != '.'))}"


def contexts(text: str, spans: list[Span], reach: int = REACH) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end) of the terms next to each span that lie in no span."""
    out = []
    taken: list[list[int]] = []  # the spans' union, in order
    for a, b in sorted((a, b) for _, a, b in spans):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    closed = [b for _, b in taken]
    terms = [m.span() for m in TERM.finditer(text)] if spans else []
    starts, ends = [a for a, _ in terms], [b for _, b in terms]
    for kind, start, end in spans:
        own = entity(kind, text[start:end])
        i, j = bisect_left(starts, start), bisect_right(ends, end)
        # a term that the span cuts is one by what lies outside; one more is read in its place
        before = [(a, min(b, start)) for a, b in terms[max(0, i - reach - 1) : i]]
        behind = [(max(a, end), b) for a, b in terms[j : j + reach + 1]]
        for a, b in [*[t for t in before if t[1] - t[0] > 2][-reach:], *[t for t in behind if t[1] - t[0] > 2][:reach]]:
            k = bisect_right(closed, a)
            if k == len(taken) or taken[k][0] >= b:
                out.append((own, text[a:b].lower(), a, b))
    return out


SPAN = "array<struct<kind:string,start:int,end:int>>"
CONTEXT = "array<struct<entity:string,term:string,start:int,end:int>>"


def _facts(docs: DataFrame, id_col: str, text_col: str, reach: int) -> DataFrame:
    """One row per document (rid, id, text_key, base, contexts), and rows (term, n) of document counts."""
    key = text_key(F.col(text_col)).alias("text_key")
    copies = docs.select(key).groupBy("text_key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = stored(copies, "copies")
    if copies.count() <= BROADCAST_COPIES:
        copies = F.broadcast(copies)
    rows = docs.select(F.col(id_col).alias("id"), key, F.col(text_col).alias("text")).join(copies, "text_key", "left")
    rows = rows.select("id", "text_key", "text", F.coalesce("copies", F.lit(1)).alias("copies"))
    schema = T.StructType(
        [T.StructField("rid", T.LongType()), rows.schema["id"], T.StructField("text_key", T.LongType()), T.StructField("base", T._parse_datatype_string(SPAN)),
         T.StructField("contexts", T._parse_datatype_string(CONTEXT)), T.StructField("term", T.StringType()), T.StructField("n", T.DoubleType())]
    )
    arrow = to_arrow_schema(schema)

    def per_partition(batches):
        rid, seen = TaskContext.get().partitionId() << 33, Counter()

        def counts():
            terms, numbers = list(seen), list(seen.values())
            seen.clear()
            for i in range(0, len(terms), 20_000):
                part = terms[i : i + 20_000]
                none = [None] * len(part)
                yield batch(arrow, [none, none, none, none, none, part, numbers[i : i + 20_000]])

        for b in batches:
            base, near = [], []
            for text, copies in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                text = text.as_py() or ""
                spans = identifiers(text)
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans])
                near.append([dict(zip(("entity", "term", "start", "end"), c, strict=True)) for c in contexts(text, spans, reach)] if spans else [])
                found = {t.lower() for t in set(TERM.findall(text))}
                seen.update(found if copies == 1 else dict.fromkeys(found, 1 / copies))
                if len(seen) > MEMO:
                    yield from counts()
            n = b.num_rows
            yield batch(arrow, [range(rid, rid + n), b.column(0), b.column(1), base, near, [None] * n, [None] * n])
            rid += n
        yield from counts()

    return stored(rows.mapInArrow(per_partition, schema), "privacy")


def disclosing(facts: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """entity, term and disclosure of the pairs at or over the threshold."""
    docs = facts.where("rid IS NOT NULL")
    total = docs.select("text_key").distinct().count()
    near = docs.select("text_key", F.explode("contexts").alias("c")).select("text_key", "c.entity", "c.term").distinct()
    pairs = near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et")).where(F.col("n_et") >= support)
    entities = near.select("text_key", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    terms = facts.where("rid IS NULL").groupBy("term").agg(F.round(F.sum("n")).alias("n_t"))
    share = F.log2(F.lit(float(total)) / F.col("n_e"))
    pmi = F.log2(F.col("n_et") * float(total) / (F.col("n_e") * (F.col("n_t") + UNSEEN)))
    rated = pairs.join(entities, "entity").join(terms, "term").withColumn("disclosure", F.when(share > 0, pmi / share))
    return rated.where(F.col("disclosure") >= generalise).select("entity", "term", "disclosure")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """id, text_key, base and spans of each row; spans has the base ones and those of kind generalise and remove."""
    facts = _facts(docs, id_col, text_col, reach)
    rows = facts.where("rid IS NOT NULL")
    near = rows.select("rid", F.explode("contexts").alias("c")).select("rid", "c.*")
    found = near.join(disclosing(facts, support, generalise), ["entity", "term"])
    kind = F.when(F.max("disclosure") >= remove, "remove").otherwise("generalise")
    found = found.groupBy("rid", "start", "end").agg(kind.alias("kind"))
    found = found.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("terms"))
    none = F.array().cast(SPAN)
    return rows.join(found, "rid", "left").select("id", "text_key", "base", F.concat("base", F.coalesce("terms", none)).alias("spans"))


LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[TERM]", "remove": ""}


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its label; where spans overlap the earlier, longer one is taken."""
    if text is None:
        return None
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], LABELS[kind]]
            at = end
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The columns of docs with the text redacted, and spans."""
    found = find(docs, id_col, text_col, **options).dropDuplicates(["id", "text_key"]).select("id", "text_key", "spans").where(F.size("spans") > 0)
    names = [c for c in docs.columns if c != "spans"]
    rows = docs.select(F.struct(*names).alias("row"), F.col(id_col).alias("own_id"), text_key(F.col(text_col)).alias("own_key"))
    rows = rows.join(found, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("text_key")), "left")

    @F.pandas_udf("string")
    def redacted(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else redact(t, [(x["kind"], x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans, strict=True)], dtype=object)

    text = F.when(F.col("spans").isNull(), F.col("row")[text_col]).otherwise(redacted(F.col("row")[text_col], F.col("spans")))
    return rows.select(*[(text if c == text_col else F.col("row")[c]).alias(c) for c in names], F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


@query("op7_pii")
def op7_pii(spark, sf_dir):
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    number = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return find(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), *map(number, KINDS), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans")
    )
