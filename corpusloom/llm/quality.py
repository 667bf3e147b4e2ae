"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with a temperature.

Random indexing: each token has a fixed sparse ternary index vector, found from its hash; the context vector of a token
is the sum of the index vectors of its neighbours over the WHOLE corpus. Tokens share ``BUCKETS`` hash buckets, so the
table that is broadcast has a fixed size (``BUCKETS * DIM`` floats) however large the corpus is. A document is the mean
of its tokens' vectors with the rates of capitals and repetitions; a network with one hidden layer, trained in numpy
on a bounded sample of labelled rows, gives a logit, and a temperature fitted on a calibration fifth makes it a probability.

Defined results: null and empty texts have no tokens and get the network's score of the zero vector; repeated rows
are scored alike, one by one; texts of any length are read whole; without labels of both classes the score is the
share of label 1 (0.5 without any). An empty table gives an empty result. Labelled rows come in order of id and vector, so equal
ones change nothing. Extra columns pass through; a column named like the output is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm.common import BLOCK, block_rows, labelled_texts, small_batches, summed_blocks, training_labels, with_text_columns

BUCKETS = 8192
DIM = 32
NONZERO = 6
WINDOW = 2
#: Labelled rows that the network is fitted on, at most.
MAX_LABELLED = 12_000
HIDDEN = 24
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
RATES = 7


class TokenCodes(dict):
    """Token -> 4 * bucket + case (1 capitalised, 2 all capitals); emptied when it grows large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 150_000:
            self.clear()
        word = "0" if token[0].isdigit() else token.lower()
        case = 2 if len(token) > 1 and token.isupper() else 1 if token[0].isupper() else 0
        code = self[token] = 4 * (zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS) + case
        return code


def index_vectors() -> np.ndarray:
    """Sparse ternary rows, the same for everyone; one row more, of zeros, stands between documents."""
    rng = np.random.default_rng(20_240_607)
    out = np.zeros((BUCKETS + 1, DIM), np.float32)
    columns = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    out[np.arange(BUCKETS)[:, None], columns] = rng.choice(np.array([-1, 1], np.float32), (BUCKETS, NONZERO))
    return out


def _pieces(texts: list[str], codes: TokenCodes, size: int = 60_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes of the texts' tokens in chunks of about ``size``: codes, number of the text, whether the chunk starts it."""
    parts: list[np.ndarray] = []
    numbers: list[int] = []
    held = 0
    for number, text in enumerate(texts):
        tokens = TOKEN.findall(text)
        parts.append(np.fromiter(map(codes.__getitem__, tokens), np.int32, len(tokens)))
        numbers.append(number)
        held += len(tokens)
        if held >= size:
            yield np.concatenate(parts), np.array(numbers), np.array([len(p) for p in parts])
            parts, numbers, held = [], [], 0
    if numbers:
        yield np.concatenate(parts), np.array(numbers), np.array([len(p) for p in parts])


def context_sums(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(BUCKETS, DIM + 1): sums of neighbours' index vectors, and token counts, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, index = TokenCodes(), index_vectors()
        sums = np.zeros((BUCKETS, DIM + 1), np.float64)
        for batch in batches:
            for tokens, _, lengths in _pieces([t or "" for t in batch.column(0).to_pylist()], codes):
                if not len(tokens):
                    continue
                ids = np.full(len(tokens) + WINDOW * (len(lengths) + 1), BUCKETS, np.int32)
                at = np.arange(len(tokens)) + WINDOW * (1 + np.repeat(np.arange(len(lengths)), lengths))
                ids[at] = tokens >> 2
                for i in range(0, len(at), 30_000):
                    a = at[i : i + 30_000]
                    near = index[ids[a - 1]]
                    for d in range(-WINDOW, WINDOW + 1):
                        if d not in (0, -1):
                            near += index[ids[a + d]]
                    own = ids[a]
                    order = np.argsort(own, kind="stable")
                    ordered = own[order]
                    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
                    sums[ordered[first], :DIM] += np.add.reduceat(near[order], first, axis=0)
                    sums[ordered[first], DIM] += np.diff(np.r_[first, len(ordered)])
        yield block_rows(sums.astype(np.float32), 1024, TaskContext.get().partitionId())

    return summed_blocks(small_batches(docs).select(text_col).mapInArrow(run, BLOCK), (BUCKETS, DIM + 1), 1024)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """A token's index vector plus its normalised context vector; a last row of zeros."""
    index = index_vectors()
    context = sums[:, :DIM] - (sums[:, :DIM].sum(0) / max(1.0, sums[:, DIM].sum())) * sums[:, DIM:]
    length = np.linalg.norm(context, axis=1, keepdims=True)
    out = index.copy()
    out[:BUCKETS] = index[:BUCKETS] / np.sqrt(NONZERO) + np.divide(context, length, out=np.zeros_like(context), where=length > 0)
    return out.astype(np.float32)


def pooled(texts: list[str], vectors: np.ndarray, codes: TokenCodes) -> np.ndarray:
    """(texts, DIM + RATES): mean vector, rates of capitals, of repetitions at distance 1 to 3, distinct rate, log length."""
    out = np.zeros((len(texts), DIM + RATES), np.float32)
    for tokens, numbers, lengths in _pieces(texts, codes):
        ids, case = tokens >> 2, tokens & 3
        start = np.cumsum(lengths) - lengths
        full = np.flatnonzero(lengths)
        if not len(full):
            continue
        rows, n = numbers[full], lengths[full].astype(np.float32)
        cut = start[full]

        def share(flags: np.ndarray, cut: np.ndarray = cut, n: np.ndarray = n) -> np.ndarray:
            return np.add.reduceat(flags.astype(np.float32), cut) / n

        for i, j in zip(range(0, len(full), 64), range(64, len(full) + 64, 64), strict=False):
            low, high = cut[i], cut[j] if j < len(full) else len(ids)
            out[rows[i:j], :DIM] = np.add.reduceat(vectors[ids[low:high]], cut[i:j] - low, axis=0) / n[i:j, None]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        out[rows, DIM] = share(case == 1)
        out[rows, DIM + 1] = share(case == 2)
        for d in (1, 2, 3):
            same = np.zeros(len(ids), bool)
            same[d:] = (ids[d:] == ids[:-d]) & (owner[d:] == owner[:-d])
            out[rows, DIM + 1 + d] = share(same)
        pairs = np.unique(owner.astype(np.int64) * BUCKETS + ids) // BUCKETS
        out[rows, DIM + 5] = np.bincount(pairs, minlength=len(lengths))[full] / n
        out[rows, DIM + 6] = np.log1p(n) / 8
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, epochs: int = 40, seed: int = 3) -> Network:
    """Adam on the log loss over four fifths of the rows, then the temperature of least log loss on the last fifth."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        prior = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
        return Network(np.zeros(DIM + RATES), np.ones(DIM + RATES), np.zeros((DIM + RATES, 1)), np.zeros(1), np.zeros(1), float(prior), 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held = order[: len(y) // 5] if len(y) >= 50 else order
    train = order[len(y) // 5 :] if len(y) >= 50 else order
    net = Network(x[train].mean(0), x[train].std(0) + 1e-3, rng.normal(0, 0.3, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), 0.0, 1.0)
    z = (x - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(max(epochs, min(400, 400_000 // len(train)))):
        shuffled = rng.permutation(train)
        for i in range(0, len(train), 256):
            at = shuffled[i : i + 256]
            hidden = np.tanh(z[at] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3][0], -30, 30))) - y[at]) / len(at)
            back = error[:, None] * params[2] * (1 - hidden**2)
            grads = [z[at].T @ back + 1e-4 * params[0], back.sum(0), hidden.T @ error + 1e-4 * params[2], np.array([error.sum()])]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(params[3][0])
    logits = net.logits(x[held])
    grid = np.geomspace(0.25, 8, 60)
    loss = [np.mean(np.logaddexp(0, np.clip(logits / t, -60, 60)) - y[held] * logits / t) for t in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


@dataclass
class QualityClassifier:
    vectors: np.ndarray
    network: Network

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> QualityClassifier:
        """Word vectors from all of ``docs``; the network from at most ``max_labelled`` labelled rows outside the held-out fold."""
        vectors = word_vectors(context_sums(docs, text_col))
        sample = training_labels(labels, label, max_labelled, id_col)
        width = DIM + RATES
        carried = docs.sparkSession.sparkContext.broadcast(vectors)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes = TokenCodes()
            for batch in batches:
                x = pooled([t or "" for t in batch.column(2).to_pylist()], carried.value, codes)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "label", "x"])

        texts = labelled_texts(docs, sample, id_col, text_col)
        schema = T.StructType([T.StructField("id", texts.schema["__id"].dataType), T.StructField("label", T.IntegerType()), T.StructField("x", T.BinaryType())])
        rows = texts.mapInArrow(run, schema).toPandas().sort_values(["id", "x"])
        x = np.frombuffer(b"".join(rows.x), np.float32).reshape(-1, width) if len(rows) else np.zeros((0, width), np.float32)
        return cls(vectors, fit_network(x, rows.label.to_numpy(np.float64)))

    def score(self, docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", score_col: str = "score") -> DataFrame:
        """``docs`` (or the columns ``keep``) with the probability of label 1 for each whole text."""
        carried = docs.sparkSession.sparkContext.broadcast((self.vectors, self.network))
        codes = TokenCodes()

        def score(texts: list[str]) -> list[pa.Array]:
            vectors, network = carried.value
            return [pa.array(network.probability(pooled(texts, vectors, codes)), pa.float64())]

        return with_text_columns(docs, text_col, keep, [(score_col, T.DoubleType())], score)
