"""Log-probabilities of whole texts by a log-bilinear model over word classes.

Tokens are words (A-Z lower-cased, white space between them) and one end per
text. Counts of all training tokens give the unigram base. The model factors
a token into its class and the word in its class:

    P(word | context) = P(class | two classes before) * P(word | class)

The frequent words have a class each, other words go by their last two bytes;
there are more classes the more words the training texts have (class_count).
P(class | context) is a log-bilinear model (Mnih and Hinton): the vectors of
the two classes before are mapped by one matrix each and added, and the score
of a class is the product with its output vector plus its bias. It is trained
in numpy with noise-contrastive estimation against unigram noise. Every pass goes
over all counted class triples of the training texts, each with its count, and
over all noise with its probability, so nothing is drawn; a tenth of the counts is
held out, and passes end when it is told no better. For
scoring, one matrix product gives the scores of all contexts, normalised over
the classes. P(word | class) is the smoothed share of the word's count, with
one place per class for unseen words, so all tokens of a context sum to one.

Words with at least a HEAVY-th of all tokens, HEAVY at most, go to every task.
All other words are looked up by a join: each task gives its texts' words a
number per chunk of a bounded number of tokens and sends (chunk, number, word)
once; counts come back by chunk.

Results: one row per input row. Null and empty texts are one end token. Null
and repeated ids stay rows of their own; a null id is hashed as "null". Without
training rows N and all scores of the base are 0. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from titleloom.llm.common import batch, documents, pieces_of, query, remainder, stored

END = b""
FEWEST, MOST = 48, 128  # classes
HEAVY = 1 << 19
CHUNK = 2_000_000  # tokens
MEMO = 300_000  # words counted by a task before it passes its counts on
DIMENSIONS, NOISE, PASSES, RATE, DRAW = 24, 16, 600, 0.03, 20_260_801
LOOK, GAIN = 20, 1e-4  # passes between two looks at the held-out counts, and the gain (nats a token) that is worth more of them
SMOOTH = 0.1


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def class_count(words: int) -> int:
    """8 classes more for each doubling of the vocabulary."""
    return min(MOST, max(FEWEST, 8 * words.bit_length() - 64))


def _binary(column: pa.Array) -> pa.Array:
    return column.cast(pa.binary())


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word (the end is the empty word) and c, over all rows."""
    schema = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(schema)

    def per_partition(batches):
        seen: Counter = Counter()

        def counts():
            words, numbers = list(seen), list(seen.values())
            seen.clear()
            for i in range(0, len(words), 20_000):
                yield batch(arrow, [words[i : i + 20_000], numbers[i : i + 20_000]])

        for b in batches:
            for text in _binary(b.column(0)):
                seen.update(tokens(text.as_py()))
                seen[END] += 1
                if len(seen) > MEMO:
                    yield from counts()
        yield from counts()

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(per_partition, schema)
    return rows.groupBy("word").agg(F.sum("n").alias("c"))


class Model:
    """Counts, classes and class log-probabilities; its size is bounded by HEAVY words and MOST ** 3 numbers."""

    def __init__(self, words: list[tuple[bytes, int]], suffixes: dict[bytes, tuple[int, int]]):
        """words: the heavy ones with counts, most frequent first; suffixes: tokens and words by last two bytes."""
        counts = dict(words)
        self.total = sum(n for n, _ in suffixes.values())
        self.words = sum(n for _, n in suffixes.values())
        self.base = math.log10(self.total + SMOOTH * (self.words + 1))
        rest, classes = dict(suffixes), class_count(self.words)
        top = [w for w, _ in words[: classes * 5 // 8]]
        for w in {*top, END} & set(counts):
            n, v = rest[w[-2:]]
            rest[w[-2:]] = (n - counts[w], v - 1)
        ranked = sorted((s for s in rest if rest[s][1]), key=lambda s: (-rest[s][0], s))
        self.suffix = {s: k for k, s in enumerate(ranked[: classes - classes * 5 // 8 - 2])}
        self.other, first = len(self.suffix), len(self.suffix) + 1
        own = {w: first + k for k, w in enumerate(w for w in top if w != END)}
        self.end = first + len(own)
        own[END] = self.end
        self.size = self.end + 1
        held = np.zeros((self.size, 2))
        for s, (n, v) in rest.items():
            held[self.suffix.get(s, self.other)] += n, v
        for w, k in own.items():
            held[k] = counts.get(w, 0), w in counts
        self.share = np.log10(held[:, 0] + SMOOTH * (held[:, 1] + 1))
        self.frequency = held[:, 0]
        counts.setdefault(END, 0)
        self.number = {w: k for k, w in enumerate(counts)}
        self.count = np.array(list(counts.values()), np.int64)
        self.class_of = np.array([own.get(w, self.suffix.get(w[-2:], self.other)) for w in counts], np.int64)
        self.table = np.zeros((self.size,) * 3)

    def classes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class of each token of a text, the number of each heavy word (-1: none), and the places of the others."""
        get, suffix, other = self.number.get, self.suffix.get, self.other
        number = np.array([get(w, -1) for w in words] + [self.number[END]], np.int64)
        found = self.class_of[number]
        rare = np.flatnonzero(number < 0)
        if len(rare):
            found[rare] = [suffix(words[i][-2:], other) for i in rare.tolist()]
        return found, number, rare

    def triples(self, found: np.ndarray) -> np.ndarray:
        """Code of each token with its two classes before; texts start after two ends."""
        before = np.concatenate(([self.end, self.end], found))
        return (before[:-2] * self.size + before[1:-1]) * self.size + found

    def train(self, codes: np.ndarray, counts: np.ndarray) -> None:
        """Noise-contrastive estimation over all counted triples, then the normalised table."""
        rng, v, d = np.random.default_rng(DRAW), self.size, DIMENSIONS
        unigram = (self.frequency + 1) / (self.frequency + 1).sum()
        given, out = rng.normal(0, 0.1, (v, d)), rng.normal(0, 0.1, (v, d))
        self.vectors = [given, out, np.stack([np.eye(d), np.eye(d)]) * 0.5, np.log(unigram)]
        every = np.zeros(v**3)
        every[codes] = counts
        tested = rng.binomial(every.astype(np.int64), 0.1).reshape(v * v, v).astype(float)
        every = every.reshape(v * v, v) - tested
        total, asked = every.sum(), tested.sum()
        best, kept = -np.inf, [x.copy() for x in self.vectors]
        moments = [[np.zeros_like(x), np.zeros_like(x)] for x in self.vectors]
        offset, of_context = np.log(NOISE * unigram), NOISE * every.sum(axis=1, keepdims=True)
        for step in range(PASSES + 1 if total and asked else 0):
            if step % LOOK == 0:
                told = float((tested * self.normalised().reshape(v * v, v)).sum() / asked)
                if told > best:
                    kept = [x.copy() for x in self.vectors]
                if told < best + GAIN:
                    break
                best = told
            given, out, maps, bias = self.vectors
            mapped = self.mapped().reshape(v * v, d)
            true = 1 / (1 + np.exp(np.clip(offset - bias - mapped @ out.T, -30, 30)))
            slope = (every * (true - 1) + of_context * unigram * true) / total
            back = (slope @ out).reshape(v, v, d)  # by the class before the last, then by the last
            near, far = back.sum(axis=0), back.sum(axis=1)
            grads = [near @ maps[0].T + far @ maps[1].T, slope.T @ mapped, np.stack([given.T @ near, given.T @ far]), slope.sum(axis=0)]
            rate = RATE / (1 + step / 200)
            for value, (mean, square), grad in zip(self.vectors, moments, grads, strict=True):
                mean *= 0.9
                mean += 0.1 * grad
                square *= 0.99
                square += 0.01 * grad * grad
                value -= rate * (mean / (1 - 0.9 ** (step + 1))) / (np.sqrt(square / (1 - 0.99 ** (step + 1))) + 1e-9)
        self.vectors = kept
        self.table = self.normalised() / math.log(10)

    def mapped(self) -> np.ndarray:
        """The vector that each context (far class, near class) predicts."""
        given, _, maps, _ = self.vectors
        return (given @ maps[0])[None, :, :] + (given @ maps[1])[:, None, :]

    def normalised(self) -> np.ndarray:
        """Log-probability of each class in each context."""
        _, out, _, bias = self.vectors
        score = self.mapped() @ out.T + bias
        score -= score.max(axis=2, keepdims=True)
        return score - np.log(np.exp(score).sum(axis=2, keepdims=True))


def learn(docs: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, and the table (word, c) of all training words."""
    rows = docs.select(F.col(text_col).alias("text"))
    vocabulary = stored(word_counts(rows), "vocabulary")
    by_end = vocabulary.groupBy(F.expr("right(hex(word), 4)").alias("suffix")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"))
    suffixes = {bytes.fromhex(r["suffix"]): (r["c"], r["v"]) for r in by_end.collect()}  # 65,793 at most
    total = sum(c for c, _ in suffixes.values())
    heavy = vocabulary.where((F.col("c") >= total / HEAVY) | (F.col("word") == F.lit(END)))
    words = sorted(((bytes(r["word"]), r["c"]) for r in heavy.toLocalIterator()), key=lambda w: (-w[1], w[0]))
    model = Model(words, suffixes)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cells = model.size**3
    schema = T.StructType([T.StructField("code", T.IntegerType()), T.StructField("n", T.LongType())])
    arrow = to_arrow_schema(schema)

    def per_partition(batches):
        model, held, waiting, size = shared.value, np.zeros(cells, np.int64), [], 0
        for b in batches:
            for text in _binary(b.column(0)):
                waiting.append(model.triples(model.classes(tokens(text.as_py()))[0]))
                size += len(waiting[-1])
                if size > 500_000:
                    held += np.bincount(np.concatenate(waiting), minlength=cells)
                    waiting, size = [], 0
        if waiting:
            held += np.bincount(np.concatenate(waiting), minlength=cells)
        codes = np.flatnonzero(held)
        for i in range(0, len(codes), 50_000):
            yield batch(arrow, [codes[i : i + 50_000], held[codes[i : i + 50_000]]])

    counted = rows.mapInArrow(per_partition, schema).groupBy("code").agg(F.sum("n").alias("n")).toPandas().sort_values("code")
    model.train(counted["code"].to_numpy(np.int64), counted["n"].to_numpy(np.float64))
    return model, vocabulary


def score(docs: DataFrame, model: Model, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = [
        ("chunk", T.LongType()), ("n_tokens", T.LongType()), ("known", T.LongType()), ("counts", T.DoubleType()),
        ("classes", T.DoubleType()), ("rare", T.BinaryType()), ("number", T.IntegerType()), ("word", T.BinaryType()),
    ]
    id_type = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), *[T.StructField(n, t) for n, t in kinds]])
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def per_partition(batches):
        model = shared.value
        table = (model.table - model.share[None, None, :]).ravel()
        logs, is_known = np.log10(model.count + SMOOTH), model.count > 0
        chunk, held, local = TaskContext.get().partitionId() << 24, 0, {}

        def words():
            found = list(local)
            for i in range(0, len(found), 20_000):
                part = found[i : i + 20_000]
                none = [None] * len(part)
                yield batch(arrow, [none, [chunk] * len(part), none, none, none, none, none, range(i, i + len(part)), part])

        for b in batches:
            for start, end in pieces_of(b.column(1), most=2048, size=2_000_000):
                part, out = b.slice(start, end - start), []
                for text in _binary(part.column(1)):
                    words_ = tokens(text.as_py())
                    found, number, rare = model.classes(words_)
                    heavy = number[number >= 0]
                    places = [local.setdefault(words_[i], len(local)) for i in rare.tolist()]
                    out.append(
                        (chunk, len(found), int(is_known[heavy].sum()), float(logs[heavy].sum()), float(table[model.triples(found)].sum()), np.array(places, "<i4").tobytes())
                    )
                    held += len(found)
                none = [None] * len(out)
                yield batch(arrow, [part.column(0), *zip(*out, strict=True), none, none])
                if held >= CHUNK:
                    yield from words()
                    chunk, held, local = chunk + 1, 0, {}
        yield from words()

    facts = stored(rows.mapInArrow(per_partition, schema), "tokens")
    asked = facts.where("word IS NOT NULL").select("chunk", "number", "word")
    answers = asked.join(vocabulary, "word", "left").select(F.col("chunk").alias("of"), F.col("number").alias("number"), F.coalesce("c", F.lit(0)).alias("c"))
    texts = facts.where("word IS NULL").drop("number", "word")
    result = T.StructType(
        [T.StructField("doc_id", id_type), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
         T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    )
    result_arrow = to_arrow_schema(result)
    base = model.base

    def per_chunk(left: pa.Table, right: pa.Table) -> pa.Table:
        count = np.zeros(right.num_rows, np.int64)
        if right.num_rows:
            count[right["number"].to_numpy()] = right["c"].to_numpy()
        logs, known = np.log10(count + SMOOTH), count > 0
        n, own, counted, classes = (left[c].to_numpy() for c in ("n_tokens", "known", "counts", "classes"))
        more, seen = np.zeros(left.num_rows), np.zeros(left.num_rows, np.int64)
        for k, rare in enumerate(left["rare"]):
            places = np.frombuffer(rare.as_py() or b"", "<i4")
            if len(places):
                more[k], seen[k] = logs[places].sum(), known[places].sum()
        total = counted + more
        columns = [left["doc_id"].combine_chunks(), n, own + seen, total - n * base, total + classes]
        return pa.Table.from_batches([batch(result_arrow, columns)]) if left.num_rows else result_arrow.empty_table()

    return texts.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(per_chunk, result)


def held_out(folds: int = 10) -> Column:
    return remainder("doc_id", folds) == 0


@query("op4_lm_scoring")
def op4_lm_scoring(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model, vocabulary = learn(docs.where(~held_out()))
    return score(docs, model, vocabulary).select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score"
    )
