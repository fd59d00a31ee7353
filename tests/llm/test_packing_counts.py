"""op1, op3: token ids, packing and totals."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import ODD
from titleloom.llm.counts import Rollup, count_tokens, signed
from titleloom.llm.packing import Packer, merge, pack, powers
from titleloom.llm.tokens import encoder
from titleloom.workspace import new_folder


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


SPACES = ["", " ", "  ", "a", " a", "a ", "a  b", "a \nb", "a\n b", "\n", "\na", "a\n", "a\n\nb", "it's  we'll 12 a,b", "x y\tz\r\nw", " a b", "<|endoftext|> a", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x\n\n<|endoftext|>  y", "<|endoftext|", "don't\n'd 've"]


@pytest.mark.parametrize("text", SPACES)
def test_word_memo_gives_the_tokenizers_ids(tokenizer, text):
    assert ids_of(encoder().encode(text)) == tokenizer(text)


def test_random_texts_give_the_tokenizers_ids(tokenizer, texts):
    draw = random.Random(5)
    made = ["".join(draw.choice([" ", "\n", "a", "Be", "é", "7", ".", "'s", "\t", "　", "<|endoftext|>"]) for _ in range(40)) for _ in range(400)]
    for text in [*made, *texts.values()]:
        assert ids_of(encoder().encode(text)) == tokenizer(text)


def check_pieces(rows, ids):
    """rows: (doc, start, ids, doc_tokens, sequence, offset); ids: doc -> list of its id lists."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, start, raw, total, sequence, offset in rows:
        by_doc[doc].append((start, raw, total))
        by_sequence[sequence].append((offset, len(raw) // 4))
    for doc, lists in ids.items():
        wanted = sorted((start, len(x)) for x in lists for start in [0])
        assert sorted((0, t) for s, _, t in by_doc[doc] if s == 0) == wanted
        if len(lists) == 1:
            assert ids_of(b"".join(r for _, r, _ in sorted(by_doc[doc]))) == lists[0]
            at = 0
            for start, raw, total in sorted(by_doc[doc]):
                assert start == at and total == len(lists[0])
                at += len(raw) // 4
    assert set(by_doc) == set(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == 1024 or at & (at - 1) == 0
    return by_sequence


def test_op1_keeps_every_id_once_without_padding(result, texts, tokenizer):
    rows = result("op1_packing")
    ids = {d: tokenizer(t or "") + [0] for d, t in texts.items()}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(piece) and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
    check_pieces([(r.doc_id, r.start, np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes(), r.doc_tokens, r.sequence_id, r.offset) for r in rows], {d: [x] for d, x in ids.items()})


def test_pack_odd_rows(odd, empty, tokenizer):
    rows = [(r.doc_id, r.start, bytes(r.ids), r.doc_tokens, r.sequence_id, r.offset) for r in pack(odd).collect()]
    ids = defaultdict(list)
    for doc, text in ODD:
        ids[doc].append(tokenizer(text or "") + [0])
    check_pieces(rows, ids)
    assert pack(empty).collect() == []


def test_pack_many_partitions_merges_leftovers(spark):
    docs = spark.createDataFrame([(i, "a " * (i % 50)) for i in range(300)], "doc_id LONG, text STRING").repartition(40)
    found = defaultdict(int)
    for r in pack(docs, window=64, windows=4, fan_in=8).collect():
        found[r.sequence_id] += r.length
    short = [n for n in found.values() if n != 64]
    assert all(n & (n - 1) == 0 for n in short) and len(short) <= 5 * 6
    assert sum(found.values()) == sum(len(encoder().encode("a " * (i % 50))) // 4 + 1 for i in range(300))


def test_packer_prefers_the_best_fit_and_bounds_open_windows():
    out = []
    p = Packer(8, 2, out.append)
    for doc, n in (("a", 5), ("b", 6), ("c", 2), ("d", 3)):
        p.add(doc, b"abcd" * n)
        assert len(p.room) <= 2
    assert [[x[0] for x in w] for w in out] == [["b", "c"], ["a", "d"]]
    p.add("e", b"abcd" * 7)
    p.add("f", b"abcd" * 6)
    p.add("g", b"abcd" * 4)  # fits nowhere: tops up the fullest
    assert [(x[0], x[1], len(x[2]) // 4) for x in out[-1]] == [("e", 0, 7), ("g", 0, 1)]
    left = p.finish()
    assert sum(len(x[2]) for x in left) // 4 == 1
    cut = []
    powers(merge([("z", 0, b"abcd" * 7, 7)], 8, cut.append), cut.append)
    assert [sum(len(x[2]) for x in w) // 4 for w in cut] == [4, 2, 1]


def test_op3_totals_are_those_of_distinct_texts(result, texts, tokenizer, spark):
    from tests.conftest import SF_DIR

    source = {r.doc_id: (r.source, r.lang) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    wanted, seen = defaultdict(lambda: [0, 0]), set()
    for doc, text in sorted(texts.items()):
        if (text or "") not in seen:
            seen.add(text or "")
            wanted[source[doc]][0] += 1
            wanted[source[doc]][1] += len(tokenizer(text or ""))
    assert {(r.source, r.lang): [r.docs, r.tokens] for r in result("op3_token_counts")} == wanted


def test_rollup_takes_a_batch_once_and_reads_no_dead_attempt(spark):
    rollup = Rollup(spark, new_folder(spark, "rollup"))
    rows = spark.createDataFrame([("s", None, "v1", 5), ("s", None, "v1", 7), (None, "en", "v2", 0)], "source STRING, lang STRING, version STRING, tokens LONG")
    assert rollup.apply("b1", signed(rows, 1)) and not rollup.apply("b1", signed(rows, 1))
    assert {tuple(r) for r in rollup.totals().collect()} == {("s", None, "v1", 2, 12), (None, "en", "v2", 1, 0)}
    signed(rows, 1).selectExpr("*", "'b2' AS batch_id", "'died' AS attempt").write.mode("append").parquet(f"{rollup.folder}/deltas")
    assert rollup.apply("b3", signed(rows.limit(0), 1))
    assert rollup.apply("b4", signed(rows.where("source = 's'"), -1))
    assert [tuple(r) for r in rollup.totals().collect()] == [(None, "en", "v2", 1, 0)]


def test_count_tokens_odd_rows(odd, empty, tokenizer):
    found = sorted(((r.doc_id, r.tokens) for r in count_tokens(odd).collect()), key=str)
    assert found == sorted(((d, len(tokenizer(t or ""))) for d, t in ODD), key=str)
    assert count_tokens(empty).collect() == []
