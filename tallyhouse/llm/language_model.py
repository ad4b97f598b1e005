"""Language-model scores from a log-bilinear model trained by noise-contrastive estimation.

The two tokens before predict the next one: score(w | u, v) = (c1[u] + c2[v]) . q[w] + b[w]. The model
knows the most frequent words and the end; every other word is a class of words with the same ending,
and within its class a word has its add-one share of the counts, as has any word never seen. So all
words, known or not, have probabilities that add up to one.

Counts cover every training token and are summed in Spark. The learners of a training round each start
from the same parameters and go once through their share of the texts; then every vector moves by the mean
of the learners' moves, each weighted by the steps in which it touched that vector, so that a word that
few learners met is not held back by the others. There is a learner per ``share`` training tokens, whatever
the number of partitions.
Training shares noise words within a batch, so it is matrix products. For scores, one product of the
context and the word vectors gives all score parts, and normalisers are computed once per context.

Only tables of a fixed size travel with tasks: the parameters and the counts of the ``frequent`` most
frequent words. Counts of rarer words are joined.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass
from itertools import islice
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.llm.common import SharedFolder, keyed

#: The end of a text: no word is empty.
END = b""


@dataclass(frozen=True)
class Settings:
    words: int = 1536  # in the model, the end included
    classes: int = 512  # of rarer words
    ending: int = 3  # bytes that make the class of a word
    frequent: int = 1 << 17  # words whose counts travel with tasks
    size: int = 32  # of a vector
    batch: int = 2048
    noise: int = 64  # noise words of a batch
    ratio: int = 8  # noise words per token
    rate: float = 0.1
    rounds: int = 3
    share: int = 1 << 22  # training tokens of a learner, over all rounds
    seed: int = 7


@dataclass(frozen=True)
class Vocabulary:
    """code: of a frequent word; counts: of frequent words; weights: tokens per code; denominators: per class."""

    code: dict[bytes, int]
    counts: dict[bytes, int]
    weights: np.ndarray
    denominators: np.ndarray
    tokens: int
    types: int


def class_of(word: bytes, s: Settings) -> int:
    return zlib.crc32(word[-s.ending :]) % s.classes


def held_out(id_: Column) -> Column:
    """crc32 of the id as text (NULL: empty), modulo 7, is 2."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All different tokens of the texts, which of them stands at each place, and how many each text has.

    The end of a text is the empty token: splitting gives one for a blank at either end of a text, so
    these are taken out and one is added behind every text."""
    # A new array: the string functions misread slices of another one.
    whole = pa.array([t or "" for t in texts.to_pylist()], pa.large_string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(whole))
    coded = pa.concat_arrays([split.flatten(), pa.array([""], pa.large_string())]).dictionary_encode()
    places, offsets = coded.indices.to_numpy()[:-1].astype(np.int64), split.offsets.to_numpy()
    end = int(coded.indices[-1].as_py())
    real = places != end
    before = np.concatenate(([0], np.cumsum(real)))[offsets]
    tokens = np.insert(places[real], before[1:], end)
    return coded.dictionary.cast(pa.large_binary()), tokens, np.diff(before) + 1


def _groups(batches: Iterator[pa.RecordBatch], column: int, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Parts of batches of at most ``rows`` rows and about 4 MB in ``column``; a longer text is a part by itself."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            stop = min(max(int(np.searchsorted(sizes, base + (1 << 22))), start + 1), start + rows)
            yield batch.slice(start, stop - start)
            start = stop


def token_counts(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """token, c over the column text, the end of each text included. Tasks count before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["token", "c"])

        for part in _groups(batches, 0):
            different, tokens, _ = tokens_of(part.column(0))
            for token, n in zip(different.to_pylist(), np.bincount(tokens, minlength=len(different)).tolist()):
                seen[token] += n
            if len(seen) > most:
                yield out()
                seen.clear()
        if seen:
            yield out()

    partial = docs.select("text").mapInArrow(count, "token binary, c bigint")
    return partial.groupBy("token").agg(F.sum("c").alias("c")).filter("c > 0")


def vocabulary(counts: DataFrame, s: Settings) -> Vocabulary:
    """From all counts; the driver gets a row per class and per grade of counts, and the frequent words."""
    class_ = F.crc32(F.when(F.length("token") <= s.ending, F.col("token")).otherwise(F.substring("token", -s.ending, s.ending)))
    sums = counts.groupBy((class_ % s.classes).cast("int").alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    n, v = np.zeros(s.classes, np.int64), np.zeros(s.classes, np.int64)
    for row in sums.collect():
        n[row.k], v[row.k] = row.n, row.v
    tokens, types = int(n.sum()), int(v.sum())
    # Frequent words are those of whole grades, from the top, as long as they are not too many.
    grade = F.floor(F.log2("c") * 64)
    chosen, room = F.lit(False), s.frequent
    for g, many in sorted(counts.groupBy(grade.alias("g")).count().collect(), reverse=True):
        if many > room:
            if s.frequent - room < s.words:
                chosen |= _part_of_grade(counts, grade == g, many, room)
            break
        chosen, room = grade >= g, room - many
    chosen = counts.filter(chosen).collect()
    frequent = dict(sorted(((bytes(w), c) for w, c in chosen), key=lambda x: (-x[1], x[0])))
    model = list(islice(frequent, s.words))
    for w in model:
        n[class_of(w, s)] -= frequent[w]
        v[class_of(w, s)] -= 1
    code = {w: i for i, w in enumerate(model)} | {w: s.words + class_of(w, s) for w in islice(frequent, s.words, None)}
    weights = np.concatenate((np.array([frequent[w] for w in model] + [0] * (s.words - len(model))), n))
    return Vocabulary(code, frequent, weights, n + v + 1, tokens, types)


def _part_of_grade(counts: DataFrame, in_grade: Column, many: int, room: int) -> Column:
    """Up to ``room`` of the ``many`` words of a grade, by their hashes: parts of about a sixteenth of the room."""
    part = F.pmod(F.xxhash64("token"), F.lit(1 << (16 * many // room).bit_length()))
    sizes = counts.filter(in_grade & (part < 32)).groupBy(part.alias("k")).count().collect()
    end = 0
    for k, size in sorted(sizes):
        if size > room:
            break
        end, room = k + 1, room - size
    return in_grade & (part < end)


class Model:
    """Vectors of the two contexts (the last row: before the text), vectors and biases of codes."""

    def __init__(self, weights: np.ndarray, s: Settings):
        self.s, m = s, len(weights)
        share = (weights + 1.0) / (weights + 1.0).sum()
        self.noise = share
        self.log_noise = np.log(s.ratio * share).astype(np.float32)
        rng = np.random.default_rng(s.seed)
        self.c = np.zeros((2, m + 1, s.size), np.float32)
        self.q = rng.normal(0, 0.1, (m, s.size)).astype(np.float32)
        self.b = np.log(share).astype(np.float32)
        # Sums of squared slopes per row: steps get shorter over all rounds.
        self.squares = [np.full(len(p), 1e-3, np.float32) for p in (*self.c, self.q, self.b)]
        # Steps that touched a row, since the model was sent.
        self.steps = [np.zeros(len(p), np.float32) for p in (*self.c, self.q, self.b)]

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.c[0], self.c[1], self.q, self.b]

    def moves(self, before: "Model") -> np.ndarray:
        """What was learned since ``before``, row by row times the steps behind it, and these steps."""
        moved = [
            n.reshape(-1, *[1] * (p.ndim - 1)) * (p - old)
            for own, base in ((self.parameters, before.parameters), (self.squares, before.squares))
            for n, p, old in zip(self.steps, own, base)
        ]
        return np.concatenate([x.ravel() for x in (*moved, *self.steps)]).astype(np.float64)

    def move(self, summed: np.ndarray) -> None:
        """Every row by the mean of the moves that ``summed`` adds up."""
        steps, at = [], len(summed) - sum(map(len, self.steps))
        summed, tail = summed[:at], summed[at:]
        for n in self.steps:
            steps.append(np.maximum(tail[: len(n)], 1))
            tail = tail[len(n) :]
        at = 0
        for n, p in zip(steps * 2, (*self.parameters, *self.squares)):
            p += (summed[at : at + p.size].reshape(p.shape) / n.reshape(-1, *[1] * (p.ndim - 1))).astype(np.float32)
            at += p.size

    def contexts(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before = np.concatenate((np.full(2, len(self.b), codes.dtype), codes))
        return before[1:-1], before[:-2]

    def train(self, texts: Iterator[np.ndarray], *seed: int) -> int:
        """One pass; returns the number of tokens."""
        s, seen = self.s, 0
        rng = np.random.default_rng([s.seed, *seed])
        edges = np.cumsum(self.noise)
        rest = np.zeros((3, 0), np.int64)
        for codes in texts:
            u, v = self.contexts(codes)
            rest = np.concatenate((rest, np.stack((u, v, codes))), axis=1)
            while rest.shape[1] >= s.batch:
                self._step(rest[:, : s.batch], edges, rng)
                rest = rest[:, s.batch :]
            seen += len(codes)
        if rest.shape[1]:
            self._step(rest, edges, rng)
        return seen

    def _step(self, batch: np.ndarray, edges: np.ndarray, rng: np.random.Generator) -> None:
        s, squares, (u, v, w) = self.s, self.squares, batch
        noise = np.minimum(np.searchsorted(edges, rng.random(s.noise)), len(edges) - 1)
        h, qw, qn = self.c[0][u] + self.c[1][v], self.q[w], self.q[noise]
        data = np.einsum("ij,ij->i", h, qw) + self.b[w] - self.log_noise[w]
        other = h @ qn.T + (self.b[noise] - self.log_noise[noise])
        # Errors: how far each is from being called data (1) and noise (0); noise words stand for ``ratio`` a token.
        data = -1 / (1 + np.exp(np.clip(data, -30, 30)))
        other = (s.ratio / s.noise) / (1 + np.exp(np.clip(-other, -30, 30)))
        dh = data[:, None] * qw + other @ qn
        words_, vectors = np.concatenate((w, noise)), np.concatenate((data[:, None] * h, other.T @ h))
        biases = np.concatenate((data, other.sum(axis=0)))
        for p, index, slope in ((0, u, dh), (1, v, dh), (2, words_, vectors), (3, words_, biases[:, None])):
            order = np.argsort(index, kind="stable")
            rows, starts = np.unique(index[order], return_index=True)
            sums = np.add.reduceat(slope[order], starts, axis=0)
            squares[p][rows] += (sums * sums).mean(axis=1)
            self.steps[p][rows] += 1
            moved = s.rate * sums / np.sqrt(squares[p][rows])[:, None]
            self.parameters[p][rows] -= moved if p < 3 else moved[:, 0]


class Scorer:
    """Normalised log-probabilities; normalisers are kept per pair of contexts."""

    def __init__(self, model: Model, chunk: int = 512):
        self.first, self.second = model.c[0] @ model.q.T + model.b, model.c[1] @ model.q.T
        self.contexts, self.chunk = model.contexts, chunk
        self.norms = np.full((len(self.first), len(self.second)), np.nan, np.float32)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        u, v = self.contexts(codes)
        norms = self.norms[u, v]
        if (new := np.isnan(norms)).any():
            pairs = np.unique(u[new] * self.norms.shape[1] + v[new])
            for i in range(0, len(pairs), self.chunk):
                x, y = np.divmod(pairs[i : i + self.chunk], self.norms.shape[1])
                scores = self.first[x] + self.second[y]
                top = scores.max(axis=1)
                scores -= top[:, None]
                np.exp(scores, out=scores)
                self.norms[x, y] = top + np.log(scores.sum(axis=1))
            norms = self.norms[u, v]
        return (self.first[u, codes] + self.second[v, codes] - norms).astype(np.float64) / np.log(10)


_scorers: dict[str, Scorer] = {}


def _scorer(name: str, model: Model) -> Scorer:
    """One per Python worker, so later tasks find its normalisers; that of an earlier model goes."""
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(model)
    return _scorers[name]


def encoded(docs: DataFrame, vocabulary_: Vocabulary, s: Settings) -> DataFrame:
    """Per row: row, id, held_out, n_tokens, codes (16-bit), the sums over frequent words, and the rarer words.

    all_logs and class_logs are sums of log10(c + 1), over all and over those that are not in the model."""
    shipped = docs.sparkSession.sparkContext.broadcast((vocabulary_.code, vocabulary_.counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, counts = shipped.value
        for part in _groups(batches, 3):
            different, tokens, lengths = tokens_of(part.column(3))
            listed = different.to_pylist()
            count = np.array([counts.get(w, -1) for w in listed])
            codes = np.array([code[w] if w in code else s.words + class_of(w, s) for w in listed], np.uint16)[tokens]
            logs = np.log10(np.where(count < 0, 0, count) + 1.0)[tokens]
            rare = (count < 0)[tokens]
            ends = np.concatenate(([0], np.cumsum(lengths)))
            sums = lambda x: np.diff(np.concatenate(([0.0], np.cumsum(x)))[ends])
            raw = codes.tobytes()
            rares = np.concatenate(([0], np.cumsum(rare)))[ends].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[:3], pa.array(lengths, pa.int64()),
                    pa.array([raw[2 * i : 2 * j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary()),
                    pa.array(sums(logs)), pa.array(sums(np.where(codes >= s.words, logs, 0.0))), pa.array(lengths - np.diff(rares), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(rares, pa.int32()), different.take(pa.array(tokens[rare])).cast(pa.binary())),
                ],
                names=names,
            )

    names = ["row", "id", "held_out", "n_tokens", "codes", "all_logs", "class_logs", "n_frequent", "rare"]
    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("row", "id", "held_out", "text").mapInArrow(
        run,
        f"row bigint, id {kind}, held_out boolean, n_tokens bigint, codes binary, all_logs double, class_logs double, "
        "n_frequent bigint, rare array<binary>",
    )


def trained(texts: DataFrame, vocabulary_: Vocabulary, s: Settings, sums: int = 8) -> Model:
    """Rounds over disjoint shares of the texts; each averages what its learners have learned.

    Learners are partitions dealt in turn, so neither equal texts nor long inputs make one of them larger.
    Rounds and the order inside a learner go by id and text, so one learner's result does not depend on how the
    input is divided; of several, which texts meet in one does."""
    model = Model(vocabulary_.weights, s)
    learners = -(-vocabulary_.tokens // s.share) or 1
    sums = min(max(sums, isqrt(learners)), learners)
    for number in range(s.rounds):
        sent = texts.sparkSession.sparkContext.broadcast(model)

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, number=number) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own, task = deepcopy(sent.value), TaskContext.get().partitionId()
            seen = own.train((np.frombuffer(x.as_py(), np.uint16).astype(np.int64) for b in batches for x in b.column(0)), number, task)
            if seen:
                yield _sum_row(task, seen, own.moves(sent.value))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, total = 0, 0.0
            for batch in batches:
                for n, flat in zip(batch.column(1), batch.column(2)):
                    seen += n.as_py()
                    total = total + np.frombuffer(flat.as_py())
            if seen:
                yield _sum_row(0, seen, total)

        order = F.xxhash64("id", "codes")
        share = texts.filter(~F.col("held_out") & (F.pmod(order, F.lit(s.rounds)) == number)).select(order.alias("order"), "codes")
        share = share.repartition(learners).sortWithinPartitions("order").select("codes")
        schema = "task int, seen bigint, flat binary"
        # In two steps, each a running sum: the driver gets one set of parameters, however many tasks there are.
        summed = share.mapInArrow(learn, schema).repartition(sums, "task").mapInArrow(add, schema)
        parts = summed.repartition(1).mapInArrow(add, schema).collect()
        for part in parts:  # one
            model.move(np.frombuffer(part.flat))
    return model


def _sum_row(task: int, seen: int, flat: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([seen], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["task", "seen", "flat"])


def model_scores(texts: DataFrame, model: Model, vocabulary_: Vocabulary, s: Settings) -> DataFrame:
    """row, model_score: log10 of the model's probabilities, but for the counts of words in classes."""
    sent = texts.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model, np.log10(vocabulary_.denominators)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, own, share = sent.value
        scorer = _scorer(name, own)
        for batch in batches:
            scores = []
            for x in batch.column(1):
                codes = np.frombuffer(x.as_py(), np.uint16).astype(np.int64)
                classes = codes[codes >= s.words] - s.words
                scores.append(float(scorer.log10(codes).sum() - share[classes].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["row", "model_score"])

    return texts.select("row", "codes").mapInArrow(run, "row bigint, model_score double")


def score(
    docs: DataFrame, folder: SharedFolder, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that are not held out, scores all. A NULL text has the end only; NULL ids count as
    an empty text for the split. An empty table gives an empty result; if nothing is left to learn from, all
    words are unknown ones. Other columns are ignored."""
    s = settings
    rows = keyed(docs, "row", id=id_col, text=text_col).withColumn("held_out", held_out(F.col("id")))
    counts = folder.keep(token_counts(rows.filter(~F.col("held_out"))), "token-counts")
    vocab = vocabulary(counts, s)
    texts = folder.keep(encoded(rows, vocab, s), "encoded")
    model = trained(texts, vocab, s)
    scores = folder.keep(model_scores(texts, model, vocab, s), "model-scores")
    # Words that no training text has add nothing to either sum.
    rare = (
        texts.select("row", F.explode("rare").alias("token"))
        .join(counts, "token")
        .groupBy("row")
        .agg(F.sum(F.log10(F.col("c") + 1)).alias("rare_logs"), F.count("*").alias("n_rare"))
    )
    nothing = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        texts.drop("codes", "rare")
        .join(scores, "row")
        .join(rare, "row", "left")
        .select(
            F.col("id").alias(id_col),
            "held_out",
            "n_tokens",
            (F.col("n_frequent") + nothing("n_rare")).alias("n_known"),
            F.lit(vocab.tokens).cast("long").alias("train_tokens"),
            (F.col("all_logs") + nothing("rare_logs") - F.col("n_tokens") * float(np.log10(vocab.tokens + vocab.types + 1))).alias("base_score"),
            (F.col("model_score") + F.col("class_logs") + nothing("rare_logs")).alias("score"),
        )
    )
