"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy, predicts every token from both sides.

The vocabulary is open. The most frequent words of the WHOLE corpus, counted by word, are tokens of their own; a rarer word is the token
of its length, and then spelled: a chain of characters, counted over all rarer words of the corpus, gives the probability of the word
among those of its length. So every word has its own probability, and a seldom but regular word is told from gibberish of that length.

For a masked position the network sums the embeddings of ``WINDOW`` tokens on each side, weighted by place, and a tanh layer predicts
the class of the token, then the token in its class, so each conditional probability is normalised over all tokens. A document's
score is the sum of the conditional log-probabilities of all its words, each with its true neighbours.

Texts are tokenised once, into stored chunks with a dictionary each; counting and numbering then touch a word once a chunk. The token
ids go in a stored table that training and scoring read. A hash of the row deals the texts to rounds
and, in a round, to shards of about ``SHARD_TOKENS`` tokens, and orders them; each shard starts from the shared weights, takes
Adagrad steps over all its texts, and the weights are averaged by the number of positions, in sums of blocks. Shards follow from the
corpus alone, not from how it is partitioned, and more data are more shards of the same length. So what is gathered grows with the
corpus, driver and tasks hold one set of weights, and every position is a target once.

Defined results: null and empty texts have no tokens, log-likelihood 0 and mean 0; texts are read whole and batch by batch;
repeated rows score alike; words of equal counts enter the vocabulary by code point; columns that clash with the added ones are
replaced; an empty corpus leaves the initial weights; other columns only deal rows to shards.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import BLOCK, LARGE_ROWS, block_rows, small_batches, stored, summed_blocks

WINDOW = 3
WIDTH = 24
CLASSES = 64
PER_CLASS = 64
VOCABULARY = CLASSES * PER_CLASS
#: Tokens 0 (edge) and 1 to 31 (rare words by length) come before the words.
RARE = 32
ROUNDS = 2
SHARD_TOKENS = 2_000_000
#: Positions of a step, at most; a shard takes 64 steps at least, of no fewer than LEAST_BATCH.
BATCH = 8_192
LEAST_BATCH = 256
RATE = 0.08
TOKEN = re.compile(r"\w+|[^\w\s]")
#: The weights in a row are padded to rows of so many numbers, to be averaged in blocks.
ROW = 256
#: Characters that the spelling tells apart; all others are one, shared by as many code points as there are.
CHARACTERS = 255
CODE_POINTS = 0x110000
#: Share of the long words that are longer still, by each character.
LONGER = 0.9
#: Tokens after which a chunk is closed.
CHUNK_TOKENS = 1_000_000


def spelled_out(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words that line breaks part, with one (they are in no word) before each; lengths of the words."""
    points = np.frombuffer(f"\n{joined}".encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.flatnonzero(points == 10)
    return points, np.diff(np.r_[starts, len(points)]) - 1


@dataclass
class Spelling:
    """A chain of characters: log probability of each after each (row and column ``CHARACTERS``: any other; row + 1: the start)."""

    alphabet: str
    chain: np.ndarray

    def __post_init__(self) -> None:
        self.places = alphabet_places(self.alphabet)

    def costs(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Of each of the words that line breaks part: negative log probability among all of its length (from ``RARE - 1`` on lengths are geometric), and length."""
        if not joined:
            return np.zeros(0), np.zeros(0, np.int64)
        points, lengths = spelled_out(joined)
        at = self.places[points]
        before, own = at[:-1], at[1:]
        # a step to a line break ends a word and costs nothing; a character that isn't told apart is one of all others
        step = np.where(own <= CHARACTERS, -self.chain[before, np.minimum(own, CHARACTERS)], 0.0)
        step += (own == CHARACTERS) * math.log(CODE_POINTS - len(self.alphabet))
        sums = np.r_[0.0, np.cumsum(step)]
        ends = np.cumsum(lengths + 1) - 1
        total = sums[ends] - sums[ends - lengths]
        long = lengths >= RARE - 1
        return total - np.where(long, math.log1p(-LONGER) + (lengths - RARE + 1) * math.log(LONGER), 0.0), lengths

    def cost(self, word: str) -> float:
        return float(self.costs(word)[0][0])

    @classmethod
    def of(cls, counted: DataFrame, words: list[str]) -> Spelling:
        """Counted over the words (``word, n``) that are not among ``words``, as often as they stand in the corpus."""
        carried = counted.sparkSession.sparkContext.broadcast(frozenset(words))

        def rare(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            names = batch.column(0).to_pylist()
            n = batch.column(1).to_numpy() * np.fromiter((w not in carried.value for w in names), bool, len(names))
            points, lengths = spelled_out("\n".join(names))
            return points, np.repeat(n, lengths + 1)

        def letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(CODE_POINTS, np.int64)
            for batch in batches:
                points, n = rare(batch)
                # counts are far below 2^53, so the sums are exact
                seen += np.bincount(points, n, CODE_POINTS).astype(np.int64)
            seen[10] = 0
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array([chr(x) for x in at], pa.string()), pa.array(seen[at], pa.int64())], names=["c", "n"])

        top = counted.mapInArrow(letters, "c string, n long").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(CHARACTERS).collect()
        alphabet = "".join(r.c for r in top)

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places = alphabet_places(alphabet)
            width = CHARACTERS + 2
            sums = np.zeros(width * width)
            for batch in batches:
                points, n = rare(batch)
                at = places[points].astype(np.int64)
                sums += np.bincount(at[:-1] * width + at[1:], n[1:], width * width)
            yield block_rows(sums.reshape(width, width)[:, : CHARACTERS + 1].astype(np.float32), 64, TaskContext.get().partitionId())

        sums = summed_blocks(counted.mapInArrow(pairs, BLOCK), (CHARACTERS + 2, CHARACTERS + 1), 64) + 0.1
        return cls(alphabet, np.log(sums / sums.sum(1, keepdims=True)))


def alphabet_places(alphabet: str) -> np.ndarray:
    """Place of each code point: in the alphabet, ``CHARACTERS`` for others, one more for the line break."""
    out = np.full(CODE_POINTS, CHARACTERS, np.int16)
    out[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
    out[10] = CHARACTERS + 1
    return out


class LocalIds(dict):
    """Token as written -> number of its lower case in the chunk's dictionary ``words``."""

    def __init__(self) -> None:
        super().__init__()
        self.words: dict[str, int] = {}

    def __missing__(self, token: str) -> int:
        out = self[token] = self.words.setdefault(token.lower(), len(self.words))
        return out


def token_chunks(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Texts in chunks of about ``CHUNK_TOKENS`` tokens, stored: the columns ``keep`` as lists, ``__words`` (a line each), ``__local`` (32-bit numbers of words), ``__lengths``."""
    schema = T.StructType([*(T.StructField(c, T.ArrayType(docs.schema[c].dataType)) for c in keep), T.StructField("__words", T.StringType()), T.StructField("__local", T.BinaryType()), T.StructField("__lengths", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, parts, kept, held = LocalIds(), [], [], 0
        for batch in batches:
            start = 0
            for i, text in enumerate(batch.column(len(keep)).to_pylist()):
                found = TOKEN.findall(text or "")
                parts.append(np.fromiter(map(codes.__getitem__, found), np.int32, len(found)))
                held += len(found) + 8
                if held >= CHUNK_TOKENS:
                    kept.append(batch.slice(start, i + 1 - start))
                    yield chunk(codes, parts, kept)
                    codes, parts, kept, held, start = LocalIds(), [], [], 0, i + 1
            if start < batch.num_rows:
                kept.append(batch.slice(start))
        if parts:
            yield chunk(codes, parts, kept)

    def chunk(codes: LocalIds, parts: list[np.ndarray], kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = []
        for k in range(len(keep)):
            values = pa.chunked_array([x.column(k) for x in kept]).combine_chunks()
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
        lengths = np.array([len(x) for x in parts], np.int64)
        blobs = ["\n".join(codes.words), np.concatenate(parts).tobytes(), lengths.tobytes()]
        return pa.RecordBatch.from_arrays([*columns, pa.array([blobs[0]], pa.string()), pa.array([blobs[1]], pa.binary()), pa.array([blobs[2]], pa.binary())], names=schema.fieldNames())

    return stored(small_batches(docs).select(*keep, text_col).mapInArrow(run, schema), "chunks", LARGE_ROWS)


def vocabulary(chunks: DataFrame) -> tuple[list[str], np.ndarray, Spelling, int]:
    """The most frequent words, the counts of all tokens, the spelling of the other words, and the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, local in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names = words.split("\n") if words else []
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.bincount(np.frombuffer(local, np.int32), minlength=len(names)), pa.int64())], names=["word", "n"])

    counted = stored(chunks.select("__words", "__local").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # a histogram of the counts finds what the wanted words have at least, so that each task sorts few words and the driver gets about as many as it wants
    size = F.floor(F.log2("n") * 32).cast("int")
    seen, least, total = 0, 0, 0
    for row in counted.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).orderBy(F.desc("size")).collect():
        total += row.n
        if seen < VOCABULARY - RARE:
            seen, least = seen + row.words, row["size"]
    top = counted.where(size >= least).orderBy(F.desc("n"), "word").limit(VOCABULARY - RARE).collect()
    counts = np.ones(VOCABULARY)
    for i, r in enumerate(top):
        counts[RARE + i] += r.n
    words = [r.word for r in top]
    for row in counted.groupBy(F.least(F.length("word"), F.lit(RARE - 1)).alias("size")).agg(F.sum("n").alias("n")).collect():
        counts[row["size"]] += row.n
    for i, word in enumerate(words):
        counts[min(len(word), RARE - 1)] -= counts[RARE + i] - 1
    return words, counts, Spelling.of(counted, words), total


def codes_of(joined: str, known: dict[str, int], spelling: Spelling) -> tuple[np.ndarray, np.ndarray]:
    """Token id of each of the words that line breaks part, and the cost of its spelling."""
    costs, lengths = spelling.costs(joined)
    ids = np.fromiter(map(known.get, joined.split("\n") if joined else [], repeat(0)), np.uint16, len(lengths))
    return np.where(ids == 0, np.minimum(lengths, RARE - 1), ids).astype(np.uint16), np.where(ids == 0, costs, 0.0)


def token_table(chunks: DataFrame, words: list[str], spelling: Spelling) -> DataFrame:
    """A row for each text: the kept columns, ``__tokens`` (its 16-bit token ids) and ``__spelled`` (log probability of its spellings); stored."""
    carried = chunks.sparkSession.sparkContext.broadcast((words, spelling))
    keep = [c for c in chunks.columns if c not in ("__words", "__local", "__lengths")]
    schema = T.StructType([*(T.StructField(c, chunks.schema[c].dataType.elementType) for c in keep), T.StructField("__tokens", T.BinaryType()), T.StructField("__spelled", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, spelling = carried.value
        known = {w: RARE + i for i, w in enumerate(words)}
        for batch in batches:
            for row in range(batch.num_rows):
                own, local, lengths = (batch.column(len(keep) + i)[row].as_py() for i in range(3))
                ids, costs = codes_of(own, known, spelling)
                local, ends = np.frombuffer(local, np.int32), np.cumsum(np.frombuffer(lengths, np.int64))
                tokens, sums = ids[local], np.r_[0.0, np.cumsum(costs[local])]
                starts = np.r_[0, ends[:-1]]
                blobs = [tokens[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                columns = [batch.column(k).slice(row, 1).flatten() for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(blobs, pa.binary()), pa.array(sums[starts] - sums[ends], pa.float64())], names=schema.fieldNames())

    return stored(chunks.mapInArrow(run, schema), "tokens")


def laid_out(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts with ``WINDOW`` edge tokens around each text; places of the tokens; numbers of tokens."""
    lengths = np.array([len(x) for x in lists], np.int64)
    out = np.zeros(int(lengths.sum()) + WINDOW * (len(lists) + 1), np.int32)
    at = np.arange(int(lengths.sum())) + WINDOW * (1 + np.repeat(np.arange(len(lists)), lengths))
    if len(at):
        out[at] = np.concatenate(lists)
    return out, at, lengths


def pieces(blobs: list[bytes], size: int = 60_000) -> Iterator[list[np.ndarray]]:
    """Token lists in runs of about ``size`` tokens."""
    run, held = [], 0
    for blob in blobs:
        run.append(np.frombuffer(blob, np.uint16))
        held += len(run[-1])
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


OFFSETS = np.array([d for d in range(-WINDOW, WINDOW + 1) if d])


@dataclass
class WindowNetwork:
    """Embeddings, output rows of words and classes with their biases, weights of places, hidden bias."""

    embed: np.ndarray
    word: np.ndarray
    word_bias: np.ndarray
    klass: np.ndarray
    klass_bias: np.ndarray
    place: np.ndarray
    bias: np.ndarray
    steps: int = 0
    safe: bool = False

    @classmethod
    def initial(cls, counts: np.ndarray, seed: int = 7) -> WindowNetwork:
        rng = np.random.default_rng(seed)
        by_class = counts.reshape(CLASSES, PER_CLASS)
        parts = [
            rng.normal(0, 0.3, (VOCABULARY, WIDTH)),
            rng.normal(0, 0.05, (VOCABULARY, WIDTH)),
            np.log(by_class / by_class.sum(1, keepdims=True)).reshape(-1),
            rng.normal(0, 0.05, (CLASSES, WIDTH)),
            np.log(by_class.sum(1) / by_class.sum()),
            np.full((2 * WINDOW, WIDTH), 0.5),
            np.zeros(WIDTH),
        ]
        return cls(*(x.astype(np.float32) for x in parts))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.word, self.word_bias, self.klass, self.klass_bias, self.place, self.bias]

    def flat(self) -> np.ndarray:
        """All weights in rows of ``ROW``, the last filled with zeros."""
        whole = np.concatenate([x.reshape(-1) for x in self.parts()])
        return np.concatenate([whole, np.zeros(-len(whole) % ROW, np.float32)]).reshape(-1, ROW)

    @classmethod
    def of(cls, flat: np.ndarray) -> WindowNetwork:
        shapes = [(VOCABULARY, WIDTH), (VOCABULARY, WIDTH), (VOCABULARY,), (CLASSES, WIDTH), (CLASSES,), (2 * WINDOW, WIDTH), (WIDTH,)]
        ends = np.cumsum([0, *(int(np.prod(x)) for x in shapes)])
        whole = flat.reshape(-1)
        return cls(*(np.ascontiguousarray(whole[a:b].reshape(x), np.float32) for a, b, x in zip(ends[:-1], ends[1:], shapes, strict=True)))

    def scorer(self) -> Scorer:
        return Scorer(self)

    def reach(self) -> float:
        """Hidden units are within 1, so logits are within this."""
        return float(max(np.abs(self.word).sum(1).max() + np.abs(self.word_bias).max(), np.abs(self.klass).sum(1).max() + np.abs(self.klass_bias).max()))

    def step(self, tokens: np.ndarray, squares: list[np.ndarray]) -> int:
        """One Adagrad step on the mean log loss of all tokens of a stretch but the ``WINDOW`` at its ends; how many they are.

        Neighbours are shifts of one table of embeddings, forward and back, so each token is looked up once.
        """
        n = len(tokens) - 2 * WINDOW
        own = tokens[WINDOW : WINDOW + n]
        real = np.flatnonzero(own)
        if not len(real):
            return 0
        real = real[np.argsort(own[real].astype(np.uint16), kind="stable")]
        target = own[real]
        klass = target // PER_CLASS
        m = len(real)
        ones = np.ones(n, np.float32)
        inputs = self.embed.take(tokens, 0)
        total = np.broadcast_to(self.bias, (n, WIDTH)).copy()
        room = np.empty_like(total)
        for d, w in zip(OFFSETS, self.place, strict=True):
            total += np.multiply(inputs[WINDOW + d : WINDOW + d + n], w, out=room)
        h = np.tanh(total.take(real, 0))
        grads = [None, np.zeros_like(self.word), np.zeros_like(self.word_bias), None, None, np.zeros_like(self.place), None]
        # a step moves a weight by RATE at most, a logit by less than 3, so the reach is looked at every eighth step
        if self.steps % 8 == 0:
            self.safe = self.reach() < 60
        self.steps += 1
        logits = h @ self.klass.T
        logits += self.klass_bias
        error = _shares(logits, self.safe)
        error[np.arange(m), klass] -= 1
        grads[3], grads[4] = error.T @ h, ones[:m] @ error
        back = error @ self.klass
        # products are by class, all else is over all classes at once
        runs = [(slice(c * PER_CLASS, (c + 1) * PER_CLASS), slice(low, high)) for c, low, high in _runs(klass)]
        logits = np.empty((m, PER_CLASS), np.float32)
        for rows, own in runs:
            part = np.matmul(h[own], self.word[rows].T, out=logits[own])
            part += self.word_bias[rows]
        error = _shares(logits, self.safe)
        error[np.arange(m), target % PER_CLASS] -= 1
        for rows, own in runs:
            part = error[own]
            grads[1][rows], grads[2][rows] = part.T @ h[own], ones[own] @ part
            back[own] += part @ self.word[rows]
        spread = np.zeros((n, WIDTH), np.float32)
        spread[real] = back * (1 - h * h)
        grads[6] = ones @ spread
        to_inputs = np.zeros_like(inputs)
        for i, d in enumerate(OFFSETS):
            near = slice(WINDOW + d, WINDOW + d + n)
            grads[5][i] = ones @ np.multiply(spread, inputs[near], out=room)
            to_inputs[near] += np.multiply(spread, self.place[i], out=room)
        order = np.argsort(tokens.astype(np.uint16), kind="stable")
        ordered = tokens[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        seen = ordered[first]
        for x, g, s in zip(self.parts()[1:], grads[1:], squares[1:], strict=True):
            g /= m
            s += g * g
            g /= np.sqrt(s)
            g *= RATE
            x -= g
        g = np.add.reduceat(to_inputs.take(order, 0), first, axis=0) / m
        s = squares[0][seen] + g * g
        squares[0][seen] = s
        self.embed[seen] -= RATE * g / np.sqrt(s)
        return m


class Scorer:
    """A network ready to score."""

    def __init__(self, network: WindowNetwork):
        self.network = network
        self.words = [np.ascontiguousarray(network.word[c * PER_CLASS : (c + 1) * PER_CLASS].T) for c in range(CLASSES)]
        self.biases = network.word_bias.reshape(CLASSES, PER_CLASS)
        self.classes = np.ascontiguousarray(network.klass.T)
        self.safe = network.reach() < 60

    def log_sum(self, logits: np.ndarray) -> np.ndarray:
        """Log of the summed exponentials of each row, which take the place of ``logits``."""
        if self.safe:
            return np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], np.float32))
        most = logits.max(1)
        logits -= most[:, None]
        return most + np.log(np.exp(logits, out=logits).sum(1))

    def log_probabilities(self, tokens: np.ndarray) -> np.ndarray:
        """Conditional log-probability of each token given both sides; 0 at edges and the ``WINDOW`` places at both ends."""
        out = np.zeros(len(tokens))
        for start in range(WINDOW, len(tokens) - WINDOW, 8_192):
            n = min(8_192, len(tokens) - WINDOW - start)
            part = tokens[start - WINDOW : start + n + WINDOW]
            inputs = self.network.embed.take(part, 0)
            h = np.broadcast_to(self.network.bias, (n, WIDTH)).copy()
            room = np.empty_like(h)
            for d, w in zip(OFFSETS, self.network.place, strict=True):
                h += np.multiply(inputs[WINDOW + d : WINDOW + d + n], w, out=room)
            own = part[WINDOW : WINDOW + n]
            real = np.flatnonzero(own)
            real = real[np.argsort(own[real].astype(np.uint16), kind="stable")]
            target = own[real]
            klass = target // PER_CLASS
            h = np.tanh(h.take(real, 0))
            each = np.arange(len(real))
            logits = h @ self.classes
            logits += self.network.klass_bias
            p = logits[each, klass] - self.log_sum(logits)
            # products are by class, all else is over all classes at once
            for c, low, high in _runs(klass):
                inner = np.matmul(h[low:high], self.words[c], out=logits[low:high])
                inner += self.biases[c]
            p += logits[each, target % PER_CLASS] - self.log_sum(logits)
            out[start + real] = p
        return out


def _shares(logits: np.ndarray, safe: bool) -> np.ndarray:
    """Softmax of each row, in place; ``safe``: no logit is so large that its exponential overflows."""
    if not safe:
        logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits *= 1 / (logits @ np.ones(logits.shape[1], np.float32))[:, None]
    return logits


def _runs(ordered: np.ndarray) -> list[tuple[int, int, int]]:
    cuts = np.r_[0, np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, len(ordered)]
    return [(int(ordered[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] if len(ordered) else []


@dataclass
class PseudoLikelihood:
    words: list[str]
    spelling: Spelling
    network: WindowNetwork

    @classmethod
    def fit(cls, docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS, epochs: int = 1, keep: list[str] | None = None, shard_tokens: int = SHARD_TOKENS) -> tuple[PseudoLikelihood, DataFrame]:
        """The model of all texts of ``docs``, and the stored token table (with the columns ``keep``) that it was trained on.

        The rounds part the texts among them, so an epoch has every position as a target once.
        """
        chunks = token_chunks(docs, keep or [], text_col)
        words, counts, spelling, total = vocabulary(chunks)
        tokens = token_table(chunks, words, spelling)
        flat = WindowNetwork.initial(counts).flat()
        shards = max(1, -(-total // (rounds * shard_tokens)))
        own = F.xxhash64(*[c for c in tokens.columns if c != "__spelled"])
        dealt = tokens.select("__tokens", own.alias("__order"))
        for turn in range(rounds * epochs):
            part = dealt.where(F.pmod("__order", F.lit(rounds)) == turn % rounds)
            flat = averaged(part.withColumn("__shard", F.pmod(F.xxhash64("__order"), F.lit(shards)).cast("int")), flat, shards)
        return cls(words, spelling, WindowNetwork.of(flat)), tokens

    def score(self, docs: DataFrame, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
        """``docs`` (or ``keep``) with ``n_tokens``, ``log_likelihood`` (sum over all tokens) and ``mean_log_likelihood``."""
        return self.score_tokens(token_table(token_chunks(docs, docs.columns if keep is None else keep, text_col), self.words, self.spelling))

    def score_tokens(self, tokens: DataFrame) -> DataFrame:
        """The same from a token table."""
        carried = tokens.sparkSession.sparkContext.broadcast(self.network)
        names = ["n_tokens", "log_likelihood", "mean_log_likelihood"]
        keep = [c for c in tokens.columns if c not in ("__tokens", "__spelled", *names)]
        schema = T.StructType([*(tokens.schema[c] for c in keep), T.StructField(names[0], T.LongType()), *(T.StructField(n, T.DoubleType()) for n in names[1:])])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = carried.value.scorer()
            for batch in batches:
                n, total = [], []
                for lists in pieces(batch.column(len(keep)).to_pylist()):
                    tokens, at, lengths = laid_out(lists)
                    ends = np.r_[0, np.cumsum(scorer.log_probabilities(tokens)[at])][np.r_[0, np.cumsum(lengths)]]
                    n += lengths.tolist()
                    total += np.diff(ends).tolist()
                total = [t + s for t, s in zip(total, batch.column(len(keep) + 1).to_pylist(), strict=True)]
                mean = [t / k if k else 0.0 for t, k in zip(total, n, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(mean, pa.float64())], names=schema.fieldNames())

        return tokens.select(*keep, "__tokens", "__spelled").mapInArrow(run, schema)


def averaged(source: DataFrame, flat: np.ndarray, shards: int) -> np.ndarray:
    """Weights after a round over ``__tokens, __order, __shard``: each shard trains from ``flat``; the mean is weighted by positions."""
    carried = source.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, lists = None, []
        for batch in batches:
            for own, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != shard and lists:
                    yield trained(shard, lists)
                    lists = []
                shard = own
                lists.append(np.frombuffer(blob, np.uint16))
        if lists:
            yield trained(shard, lists)

    def trained(shard: int, lists: list[np.ndarray]) -> pa.RecordBatch:
        network = WindowNetwork.of(carried.value)
        squares = [np.full_like(x, 1e-3) for x in network.parts()]
        tokens, at, _ = laid_out(lists)
        size = min(BATCH, max(LEAST_BATCH, len(at) // 64))
        done = sum(network.step(tokens[i : i + size + 2 * WINDOW], squares) for i in range(0, len(tokens) - 2 * WINDOW, size))
        return block_rows(np.concatenate([network.flat() * done, np.full((1, ROW), done, np.float32)]), 256, shard)

    dealt = source.repartition(shards, "__shard").sortWithinPartitions("__shard", "__order").select("__shard", "__tokens")
    total = summed_blocks(dealt.mapInArrow(run, BLOCK), (len(flat) + 1, ROW), 256)
    n = total[-1, 0]
    return (total[:-1] / n).astype(np.float32) if n else flat
