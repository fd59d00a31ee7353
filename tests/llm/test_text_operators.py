"""op2, op4, op5, op7: licences, scores, languages, personal data."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import LONG, ODD
from titleloom.llm import languages as lang
from titleloom.llm import licences, privacy, scoring

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def in_fold(doc, n):
    return zlib.crc32(str(doc).encode()) % n == 0


# --- licences


def places(text):
    words = WORD.findall((text or "").translate(LOWER))
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    return words, sorted((i, label) for label, p in phrases.items() for i in range(len(words)) if words[i : i + len(p)] == p)


def test_op2_base(result, texts):
    rows = {r.doc_id: r for r in result("op2_license_scan")}
    assert set(rows) == set(texts)
    for doc, text in texts.items():
        words, found = places(text)
        r = rows[doc]
        starts = [i for i, _ in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(found), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in found}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        if re.search("Apache License, Version|under the MIT License|CC BY-NC 4.0", text):
            assert set(r.labels.split(",")) & {"apache-2.0", "mit", "cc-by-nc-4.0"}


def spans(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id LONG, text STRING")
    return [[tuple(s) for s in r.spans] for r in licences.scan(df).orderBy("doc_id").collect()]


def test_spans_are_placed_merged_and_verified(spark):
    notice = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    shifted = notice.replace("in source", "in any source")
    scattered = " filler ".join(notice.split())
    found = spans(spark, f"x y {notice} z", shifted, scattered, "cc by cc by. CC-BY", "all rights, RESERVED all rights reserve", "ALL RIGHTS reserved\nall rights reserved")
    assert found[0] == [(2, 23, "bsd", False, 1.0)]
    assert [(s[0], s[1], s[2]) for s in found[1]] == [(0, 22, "bsd")] and 0.8 <= found[1][0][4] < 1
    assert found[2] == []
    assert found[3] == [(0, 2, "cc-by", True, 1.0), (2, 4, "cc-by", True, 1.0), (4, 6, "cc-by", True, 1.0)]
    assert [s[0] for s in found[4]] == [0] and [s[0] for s in found[5]] == [0, 3]


def test_licence_odd_rows(odd, empty):
    rows = licences.scan(odd).collect()
    assert sorted(((r.doc_id, r.n_words) for r in rows), key=str) == sorted(((d, len(places(t)[0])) for d, t in ODD), key=str)
    assert licences.scan(empty).collect() == []


def test_licence_plan_is_native(spark, odd):
    plan = licences.scan(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


# --- scores


def test_op4_base_is_exact_and_the_model_beats_it(result, texts):
    counts = Counter()
    tokens = {d: [*(t or "").encode().lower().split(), b""] for d, t in texts.items()}
    for doc, words in tokens.items():
        if not in_fold(doc, 10):
            counts.update(words)
    total = sum(counts.values())
    base = math.log10(total + 0.1 * (len(counts) + 1))
    rows = {r.doc_id: r for r in result("op4_lm_scoring")}
    assert set(rows) == set(texts)
    for doc, words in tokens.items():
        r = rows[doc]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (in_fold(doc, 10), len(words), sum(counts[w] > 0 for w in words), total)
        assert r.base_score == pytest.approx(sum(math.log10(counts[w] + 0.1) - base for w in words), rel=1e-9)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def small_model(spark):
    rows = [(i, "the cat sat on the mat" if i % 2 else "der hund lag auf der matte") for i in range(200)]
    return scoring.learn(spark.createDataFrame(rows, "doc_id LONG, text STRING"))


def test_probabilities_sum_to_one_and_use_the_context(spark):
    model, vocabulary = small_model(spark)
    assert np.allclose((10**model.table).sum(axis=2), 1)
    own = {bytes(r.word): r.c for r in vocabulary.collect()}
    share = defaultdict(float)
    for w, c in own.items():
        k = int(model.classes([w])[0][0]) if w else model.end
        share[k] += (c + 0.1) / 10 ** model.share[k]
    unseen = 0.1 / 10**model.share
    assert np.allclose([share[k] + unseen[k] for k in range(model.size)], 1)
    df = spark.createDataFrame([(0, "the cat sat on the mat"), (1, "cat the mat sat the on")], "doc_id LONG, text STRING")
    right, mixed = (r.score for r in scoring.score(df, model, vocabulary).orderBy("doc_id").collect())
    assert right > mixed + 1


def test_score_equals_its_definition(spark, texts):
    """Every token's class and word probability from the model's vectors and the counts, one at a time."""
    ids = sorted(texts)[:60]
    train, test = ids[:50], ids[40:]
    frame = lambda part: spark.createDataFrame([(d, texts[d]) for d in part], "doc_id LONG, text STRING")
    model, vocabulary = scoring.learn(frame(train))
    split = {d: (texts[d] or "").encode().lower().split() + [b""] for d in ids}
    counts = Counter(w for d in train for w in split[d])
    ranked = sorted(((w, c) for w, c in counts.items() if c >= sum(counts.values()) / scoring.HEAVY or not w), key=lambda x: (-x[1], x[0]))
    classes = min(128, max(48, 8 * len(counts).bit_length() - 64))
    own = [w for w, _ in ranked[: classes * 5 // 8] if w]
    ends = Counter()
    for w, c in counts.items():
        if w and w not in own:
            ends[w[-2:]] += c
    suffixes = sorted((s for s in ends), key=lambda s: (-ends[s], s))[: classes - classes * 5 // 8 - 2]
    kind = lambda w: "end" if not w else w if w in own else ("s", w[-2:]) if w[-2:] in suffixes else "other"
    number = {**{("s", s): k for k, s in enumerate(suffixes)}, "other": len(suffixes), **{w: len(suffixes) + 1 + k for k, w in enumerate(own)}}
    number["end"] = len(number)
    size, held = Counter(), Counter()
    for w, c in counts.items():
        size[kind(w)] += 1
        held[kind(w)] += c
    given, out, maps, bias = model.vectors
    assert len(bias) == len(number) == model.size

    def told(words):
        far = near = number["end"]
        total = 0.0
        for w in words:
            scores = out @ (given[near] @ maps[0] + given[far] @ maps[1]) + bias
            now = number[kind(w)]
            total += (scores[now] - scores.max() - np.log(np.exp(scores - scores.max()).sum())) / math.log(10)
            total += math.log10(counts[w] + 0.1) - math.log10(held[kind(w)] + 0.1 * (size[kind(w)] + 1))
            far, near = near, now
        return total

    got = {r.doc_id: r.score for r in scoring.score(frame(test), model, vocabulary).collect()}
    short = [d for d in test if len(split[d]) < 2000]
    assert len(short) > 15 and all(got[d] == pytest.approx(told(split[d]), rel=1e-9) for d in short)


def test_passes_use_all_counts_and_classes_grow():
    assert [scoring.class_count(n) for n in (0, 1 << 10, 1 << 17, 1 << 20, 1 << 40)] == [48, 48, 80, 104, 128]
    draw = np.random.default_rng(4)
    words = [(b"%c%c" % (97 + i % 26, 97 + i // 26), 1000) for i in range(40)]
    model = scoring.Model([*words, (b"", 100)], {**{w: (c, 1) for w, c in words}, b"": (100, 1)})
    v = model.size
    codes = np.arange(v * v * 3)
    counts = draw.integers(1, 50, len(codes)).astype(float) * np.where(codes % v < 20, 9, 1)
    model.train(codes, counts)
    # a class that follows nine times as often is told so, in contexts that were counted
    table = 10 ** model.table[0, 1]
    assert table[:20].sum() > 5 * table[20:40].sum()


def test_rare_words_are_counted_across_chunks(spark, monkeypatch):
    rows = [(i, f"w{i} w{i} shared{i % 7} the") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)
    full = {r.doc_id: r.base_score for r in scoring.score(docs, *scoring.learn(docs)).collect()}
    monkeypatch.setattr(scoring, "HEAVY", 5)  # nearly every word is looked up by the join
    few = {r.doc_id: r.base_score for r in scoring.score(docs, *scoring.learn(docs)).collect()}
    assert few == pytest.approx(full)


def test_score_odd_rows(spark, odd, empty):
    for model, vocabulary in (small_model(spark), scoring.learn(empty)):
        rows = scoring.score(odd, model, vocabulary).collect()
        assert sorted(((r.doc_id, r.n_tokens) for r in rows), key=str) == sorted(((d, len((t or "").split()) + 1) for d, t in ODD), key=str)
        assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)
        assert scoring.score(empty, model, vocabulary).collect() == []
    assert {r.base_score for r in rows} == {0.0}


# --- languages


def test_op5_predicts_held_out_languages(result, languages, texts):
    rows = {r.doc_id: r for r in result("op5_language_id")}
    assert set(rows) == set(texts)
    held = [d for d in rows if rows[d].held_out]
    assert all(rows[d].held_out == in_fold(d, 5) and 0 <= rows[d].score <= 1 for d in rows)
    assert sum(rows[d].lang_pred == languages[d] for d in held) / len(held) >= 0.9


def test_language_equals_plain_compression(spark, texts, languages):
    docs = spark.createDataFrame([(d, t, languages[d]) for d, t in texts.items()], "doc_id LONG, text STRING, lang STRING")
    models = lang.learn(docs, "text", "lang")
    assert sum(len(c) for c, _ in models.values()) <= lang.BYTES_PER_LANGUAGE * len(models)
    coder = lang.Coder(models)
    for r in lang.identify(docs, models).collect():
        assert (r.lang_pred, r.lang_score) == coder.predict(r.text)
    assert lang.learn(docs, "text", "lang") == models


def test_language_draws_the_smallest_hashes_of_each_language(spark):
    rows = [(lang_name, f"{word} text {i:03d} " + word * (i % 7)) for lang_name, word in (("de", "wort"), ("en", "word")) for i in range(300)]
    rows = [(name, t.translate(str.maketrans("0123456789", "abcdefghij"))) for name, t in rows] * 2
    models = lang.learn(spark.createDataFrame(rows, "lang STRING, text STRING").repartition(40), "text", "lang", texts=60)

    def order(text):
        key = xxhash.xxh64_intdigest(text, 42)
        return key & ((1 << 30) - 1), key - (1 << 64 if key >> 63 else 0)

    for name in ("de", "en"):
        drawn = sorted({t for n, t in rows if n == name}, key=order)[:60]
        assert models[name] == (b" ".join(lang.letters(t) for t in drawn), 600)


def test_language_odd_rows(odd, empty, spark):
    rows = [(i, "the cat and the dog in the house") for i in range(5)] + [(i, "der hund und die katze im haus") for i in range(5)]
    labelled = spark.createDataFrame([(i, t, "en" if "cat" in t else "de") for i, t in rows], "doc_id LONG, text STRING, lang STRING")
    models = lang.learn(labelled, "text", "lang")
    found = lang.identify(odd, models)
    assert found.columns == [c for c in odd.columns if c != "lang_pred"] + list(lang.ADDED)
    for r in found.collect():
        letters = bool(r.text) and any(map(str.isalpha, r.text))
        assert (r.lang_pred == lang.UNKNOWN) == (not letters) and r.row == "x"
        assert letters or (r.lang_rejected and r.lang_score == 0)
    assert {r.lang_pred for r in lang.identify(odd, lang.learn(empty, "text", "lang")).collect()} == {lang.UNKNOWN}
    assert lang.identify(empty, models).collect() == []
    assert lang.keep_identified(odd).columns == odd.columns


def test_copies_do_not_thin_the_training_sample(spark):
    texts = ["copied many times over"] * 3000 + [f"wort nummer {'abcdefghij'[i] * 4} im haus" for i in range(10)] + ["123 456"] * 5
    docs = spark.createDataFrame([(t, "de") for t in texts], "text STRING, lang STRING").repartition(4)
    content, n = lang.learn(docs, "text", "lang", texts=11)["de"]
    assert n == len(texts) and content.count(b"im haus") == 10 and content.count(b"copied") == 1
    assert len(lang.learn(docs, "text", "lang", texts=2)["de"][0]) > 0


# --- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(n if i % 2 == 0 else sum(divmod(2 * n, 10)) for i, n in enumerate(map(int, digits[::-1]))) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}
            if ok[kind]:
                out.append((kind, m.start(), m.end()))
    return out


TRICKY = [
    "a@b.c d@e f.g+h@i-j.kl.mn@op.qr", "@x.y a@@b.cc a@b@c.dd", "1.2.3.4.5.6.7.8 999.1.1.1.1 00255.0.0.1 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112, 41111111111111111234",
    "+1 (743) 555-3824 +12 +1+2 345678 +1...... +4 55-66.77(88)9 9", "x" * 3000 + "@" + "1" * 3000, "é@b.cd \U0001f600 z@b.cd",
]


@pytest.mark.parametrize("text", TRICKY)
def test_identifiers_equal_the_patterns(text):
    assert privacy.identifiers(text) == base_spans(text)


def test_op7_base(result, texts):
    rows = {r.doc_id: r for r in result("op7_pii")}
    assert set(rows) == set(texts)
    for doc, text in texts.items():
        own = [f"{k}:{a}:{b}" for k, a, b in base_spans(text)]
        r = rows[doc]
        assert r.base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in own) for k in privacy.KINDS]
        assert r.spans.split(",")[: len(own)] == own if own else r.spans == ""


def around(text, spans, reach=8):
    """(entity, term, start, end) near each span, walking word by word from it."""
    taken = {i for _, a, b in spans for i in range(a, b)}
    out = []
    for kind, start, end in spans:
        value = text[start:end]
        if kind == "email":
            name = value.lower()
        else:
            name = "".join(c for c in value if c.isascii() and (c.isdigit() or (c == "." and kind == "ip")))
        before = [(m.start(), min(m.end(), start)) for m in re.finditer(r"[^\W\d_]{3,}", text) if m.start() < start]
        behind = [(max(m.start(), end), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", text) if m.end() > end]
        sides = [t for t in before if t[1] - t[0] > 2][-reach:] + [t for t in behind if t[1] - t[0] > 2][:reach]
        out += [(f"{kind}:{name}", text[a:b].lower(), a, b) for a, b in sides if not taken & set(range(a, b))]
    return out


def disclosed(texts):
    """Terms and spans by the definition, one document at a time; equal texts count once."""
    near, with_entity, with_term = defaultdict(set), defaultdict(set), defaultdict(set)
    found = {}
    for d, text in texts.items():
        found[d] = around(text or "", base_spans(text))
        for t in {t.lower() for t in re.findall(r"[^\W\d_]{3,}", text or "")}:
            with_term[t].add(text)
        for e, t, _, _ in found[d]:
            near[e, t].add(text)
            with_entity[e].add(text)
    n, out = len(set(texts.values())), defaultdict(dict)
    for d, held in found.items():
        for e, t, a, b in held:
            share = math.log2(n / len(with_entity[e]))
            if share > 0:
                value = math.log2(len(near[e, t]) * n / (len(with_entity[e]) * (len(with_term[t]) + 0.2))) / share
                if value >= 0.9:
                    out[d][a, b] = max(value, out[d].get((a, b), 0))
    return {d: sorted(("remove" if v >= 0.98 else "generalise", a, b) for (a, b), v in held.items()) for d, held in out.items()}


def test_op7_equals_the_definition(result, texts):
    wanted = disclosed(texts)
    got = {}
    for r in result("op7_pii"):
        terms = [s.split(":") for s in r.spans.split(",") if s.split(":")[0] in ("remove", "generalise")]
        if terms:
            got[r.doc_id] = sorted((k, int(a), int(b)) for k, a, b in terms)
    assert got == wanted and wanted


def test_many_addresses_take_time_in_proportion():
    start = time.monotonic()
    text = " ".join(f"name{chr(97 + i % 26) * 3} a{i}@mail.example.com" for i in range(30_000))
    spans = privacy.identifiers(text)
    assert len(spans) == 30_000 and len(privacy.contexts(text, spans)) > 30_000 and time.monotonic() - start < 30


def test_disclosing_terms_equal_the_definition(spark):
    mail = {i: f"common words here and there project zebra {('alpha', 'bravo', 'charlie')[i % 3]} lead ann{i % 3}@mail.example.com wrote about the harvest number {'abcdefgh'[i % 8] * 4}" for i in range(24)}
    rest = {100 + i: f"common words here and there {'zebra' if i < 2 else 'other'} about the weather and harvest {'xyz'[i % 3] * 5}" for i in range(60)}
    texts = {**mail, **rest}
    df = spark.createDataFrame(list(texts.items()), "doc_id LONG, text STRING")
    wanted = disclosed(texts)
    got = {r.id: [tuple(s) for s in r.spans[len(r.base) :]] for r in privacy.find(df).collect()}
    assert {d: s for d, s in got.items() if s} == wanted and wanted and not set(wanted) & set(rest)
    assert len(next(iter(wanted.values()))) < 8


def test_entities_of_one_document_are_protected_whatever_its_copies(spark):
    own = "the harvest of quillfeather was sent by ann@mail.example.com to the harvest"
    texts = [own, *[f"the harvest of the {'abcdefghij'[i % 10] * 4} {'klmnopqrst'[i // 10] * 4}" for i in range(100)]]
    found = []
    for copies in (1, 3):
        df = spark.createDataFrame(list(enumerate([own] * (copies - 1) + texts)), "doc_id LONG, text STRING").repartition(3)
        rows = [r for r in privacy.find(df).collect() if r.base]
        assert len(rows) == copies and len({str(r.spans) for r in rows}) == 1
        found.append([(s.kind, own[s.start : s.end]) for s in rows[0].spans[1:]])
    assert found[0] == found[1] and ("generalise", "quillfeather") in found[0]
    assert not {"the", "harvest"} & {t for _, t in found[0]}


def test_contexts_reach_back_over_any_distance():
    text = f"quillfeather {'1 ' * 900}a@b.cd {'2 ' * 900}behind"
    assert [t for _, t, _, _ in privacy.contexts(text, privacy.identifiers(text)[:1])] == ["quillfeather", "behind"]


def test_redacted_text(spark, odd, empty):
    assert privacy.redact("mail a@b.cd now", [("email", 5, 11), ("remove", 12, 15)]) == "mail [EMAIL] "
    df = spark.createDataFrame([(1, "mail a@b.cd now", "kept"), (2, None, "kept"), (3, "clean", None)], "doc_id LONG, text STRING, spans STRING")
    rows = {r.doc_id: r for r in privacy.sanitise(df).collect()}
    assert rows[1].text == "mail [EMAIL] now" and rows[2].text is None and rows[3].text == "clean"
    same = sorted(((r.doc_id, r.text) for r in privacy.sanitise(odd).collect()), key=str)
    assert same == sorted(ODD, key=str)
    assert privacy.sanitise(empty).collect() == [] and privacy.find(empty).collect() == []
    assert LONG
