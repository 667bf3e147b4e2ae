"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

``fit`` takes a bounded sample of labelled rows (``MAX_LABELLED``). Every lower-cased word of theirs is a term. A term weighs
``(1 + ln count) * idf * (FLOOR + relevance)``: the IDF is counted over the WHOLE corpus, the relevance is the lower confidence bound
of the word's log odds ratio between the labels, 0 where it is negative. So words that tell toxic texts stand out, and all others
still count, so that a copy of an example finds it whatever its words. (With relevance 0 for all, plain TF-IDF, the vote misses
half of the toxic texts: in long texts of rare words a few telling ones don't move the cosine.)

Examples go in an inverted index: postings by term, the examples in blocks of ``BLOCK_SIZE`` that share their most frequent words,
with the largest weight of each term in each block. A query bounds each block by the sum of its weights times the
block maxima, scores the blocks of the highest bounds first, and then those whose bound reaches its k-th similarity; so the k
nearest examples are exact. Each neighbour votes with the square of its cosine, which is a distance weight; the vote is calibrated
on the examples themselves, each left out of its own vote.

Defined results: null and empty texts, and texts without any word of an example, have no neighbours and score the smoothed share of
label 1 among examples alike. Ties in similarity go to the smaller example number. Texts of any length are read whole, repeated
rows are scored one by one, extra columns pass through, and a column named like an output is replaced. Without labelled rows every
score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm.common import BLOCK, block_rows, labelled_texts, small_batches, summed_blocks, training_labels, with_text_columns

#: Labelled rows that the model is fitted on, at most; it bounds the vocabulary and the index.
MAX_LABELLED = 4_000
#: Share of its TF-IDF that a word keeps whose relevance is 0.
FLOOR = 0.1
#: Standard errors below the log odds ratio at which relevance is taken.
ERRORS = 2.0
BLOCK_SIZE = 128
#: Share of the examples from which on a term is frequent.
FREQUENT = 1 / 16
#: Queries whose frequent terms are taken in one product.
TOGETHER = 64
#: Blocks that are scored before the k-th similarity cuts the others.
FIRST_BLOCKS = 2
NEIGHBOURS = 15
#: Numbers in a row of what is summed over the tasks.
ROW = 256
WORD = re.compile(r"[^\W\d_]+")


class TermIds(dict):
    """Word as written -> number of its term, ``len(terms)`` for words of no example; emptied when it grows large."""

    def __init__(self, terms: list[str]):
        super().__init__()
        self.ids = {t: i for i, t in enumerate(terms)}

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        out = self[word] = self.ids.get(word.lower(), len(self.ids))
        return out

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the text's terms and their counts."""
        found = WORD.findall(text)
        ids, n = np.unique(np.fromiter(map(self.__getitem__, found), np.int32, len(found)), return_counts=True)
        known = len(ids) - bool(len(ids) and ids[-1] == len(self.ids))
        return ids[:known], n[:known]


def document_frequencies(docs: DataFrame, terms: list[str], text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts of the whole corpus each term stands, and the number of texts."""
    carried = docs.sparkSession.sparkContext.broadcast(terms)
    rows = -(-(len(terms) + 2) // ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, found = TermIds(carried.value), np.zeros(rows * ROW)
        n = len(words.ids)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = set(WORD.findall(text or ""))
                # a number that comes twice, by two spellings, adds one
                found[np.fromiter(map(words.__getitem__, own), np.int64, len(own))] += 1
            found[n] = 0
            found[n + 1] += batch.num_rows
        yield block_rows(found.astype(np.float32).reshape(-1, ROW), 1024, TaskContext.get().partitionId())

    total = summed_blocks(small_batches(docs).select(text_col).mapInArrow(run, BLOCK), (rows, ROW), 1024).reshape(-1)
    return total[: len(terms)], int(total[len(terms) + 1])


def relevance(examples: list[np.ndarray], labels: np.ndarray, n_terms: int) -> np.ndarray:
    """Lower confidence bound of each term's log odds ratio between labels 1 and 0, not below 0."""
    seen = np.zeros((2, n_terms))
    for ids, label in zip(examples, labels, strict=True):
        seen[int(label), ids] += 1
    n = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
    if not n.all():
        return np.zeros(n_terms)
    inside, outside = seen + 0.5, n[:, None] - seen + 0.5
    ratio = np.log(inside[1] / outside[1]) - np.log(inside[0] / outside[0])
    return np.maximum(0.0, ratio - ERRORS * np.sqrt((1 / inside + 1 / outside).sum(0)))


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each start up to its end, and how many those are."""
    n = ends - starts
    return np.arange(int(n.sum())) + np.repeat(starts - np.cumsum(n) + n, n), n


@dataclass
class BlockMaxIndex:
    """Unit vectors by term. A frequent term's postings are a row of weights over all examples; another's are entries: a term in a block, with a
    maximum and a run of postings (example, weight)."""

    blocks: int = 1
    dense_of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # row of a frequent term, -1 of others
    dense: np.ndarray = field(default_factory=lambda: np.zeros((0, BLOCK_SIZE), np.float32))
    terms: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # first entry of each term
    block: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # of each entry
    most: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    runs: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # first posting of each entry
    examples: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    @classmethod
    def build(cls, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> BlockMaxIndex:
        blocks = max(1, -(-len(vectors) // BLOCK_SIZE))
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)]).astype(np.int64)
        example = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(t) for t, _ in vectors])
        weight = np.concatenate([np.zeros(0), *(w for _, w in vectors)]).astype(np.float32)
        often = np.flatnonzero(np.bincount(term, minlength=n_terms) >= max(FREQUENT * len(vectors), 1))
        dense_of = np.full(n_terms, -1, np.int32)
        dense_of[often] = np.arange(len(often))
        dense = np.zeros((len(often), blocks * BLOCK_SIZE), np.float32)
        is_dense = dense_of[term] >= 0
        dense[dense_of[term[is_dense]], example[is_dense]] = weight[is_dense]
        order = np.flatnonzero(~is_dense)
        order = order[np.argsort(term[order], kind="stable")]
        term, example, weight = term[order], example[order], weight[order]
        place = term * blocks + example // BLOCK_SIZE
        runs = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(weight, runs) if len(runs) else np.zeros(0, np.float32)
        return cls(blocks, dense_of, dense, np.searchsorted(term[runs], np.arange(n_terms + 1)), (place[runs] % blocks).astype(np.int32), most, np.r_[runs, len(term)], example, weight)

    def of_frequent(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the frequent terms add to the cosines of each query with all examples, in one product."""
        table = np.zeros((len(queries), len(self.dense)), np.float32)
        for i, (terms, values) in enumerate(queries):
            rows = self.dense_of[terms]
            table[i, rows[rows >= 0]] = values[rows >= 0]
        return table @ self.dense

    def nearest(self, terms: np.ndarray, values: np.ndarray, k: int, without: int = -1, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k examples nearest to a unit vector, exactly; those of cosine 0 don't count."""
        frequent = self.of_frequent([(terms, values)])[0] if frequent is None else frequent
        rare = self.dense_of[terms] < 0
        entries, n = ranges(self.terms[terms[rare]], self.terms[terms[rare] + 1])
        values, block = np.repeat(values[rare], n), self.block[entries]
        upper = frequent.reshape(self.blocks, BLOCK_SIZE).max(1) + np.bincount(block, values * self.most[entries], self.blocks)
        first = np.argsort(-upper, kind="stable")[:FIRST_BLOCKS]
        found, cosines = self._scored(entries, values, block, first, frequent, k, without)
        limit = cosines[k - 1] if len(cosines) == k else 0.0
        rest = upper >= limit - 1e-6
        rest[first] = False
        rest = np.flatnonzero(rest & (upper > 0))
        if not len(rest):
            return found, cosines
        more, others = self._scored(entries, values, block, rest, frequent, k, without)
        return _best(np.concatenate([found, more]), np.concatenate([cosines, others]), k)

    def _scored(self, entries: np.ndarray, values: np.ndarray, block: np.ndarray, chosen: np.ndarray, frequent: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best examples of the chosen blocks."""
        wanted = np.zeros(self.blocks, bool)
        wanted[chosen] = True
        keep = wanted[block]
        at, n = ranges(self.runs[entries[keep]], self.runs[entries[keep] + 1])
        sums = np.where(np.repeat(wanted, BLOCK_SIZE), frequent, 0.0) + np.bincount(self.examples[at], np.repeat(values[keep], n) * self.weights[at], self.blocks * BLOCK_SIZE)
        if without >= 0:
            sums[without] = 0
        found = np.flatnonzero(sums > 0)
        return _best(found, sums[found], k)


def _best(found: np.ndarray, cosines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(found) > 4 * k:
        least = np.partition(cosines, len(cosines) - k)[len(cosines) - k]
        found, cosines = found[cosines >= least], cosines[cosines >= least]
    order = np.lexsort((found, -cosines))[:k]
    return found[order], cosines[order]


@dataclass
class ToxicityNeighbours:
    terms: list[str]
    scale: np.ndarray
    index: BlockMaxIndex
    labels: np.ndarray
    ids: list
    zero_score: float
    slope: float
    offset: float

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> ToxicityNeighbours:
        texts = labelled_texts(docs, training_labels(labels, label, max_labelled, id_col), id_col, text_col)
        schema = T.StructType([T.StructField("id", texts.schema["__id"].dataType), T.StructField("label", T.IntegerType()), T.StructField("words", T.StringType()), T.StructField("counts", T.BinaryType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [sorted(Counter(w.lower() for w in WORD.findall(t or "")).items()) for t in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([" ".join(w for w, _ in x) for x in found], pa.string()), pa.array([np.array([n for _, n in x], np.int32).tobytes() for x in found], pa.binary())], names=schema.fieldNames())

        rows = sorted(texts.mapInArrow(run, schema).collect(), key=lambda r: r.id)
        terms = sorted({w for r in rows for w in r.words.split()})
        number = {w: i for i, w in enumerate(terms)}
        counted = [(np.array([number[w] for w in r.words.split()], np.int64), np.frombuffer(r["counts"], np.int32)) for r in rows]
        df, n = document_frequencies(docs, terms, text_col) if terms else (np.zeros(0), 0)
        given = np.array([r.label for r in rows], float)
        scale = (np.log((n + 1) / (df + 1)) + 1) * (FLOOR + relevance([t for t, _ in counted], given, len(terms)))
        share = float(given.mean()) if len(rows) else 0.0
        # examples that share their most frequent words stand together, so that bounds of blocks are tight
        full = sorted((i for i, (t, _) in enumerate(counted) if len(t)), key=lambda i: [terms[t] for t in counted[i][0][np.argsort(-df[counted[i][0]], kind="stable")[:6]]] + [str(i)])
        zero = given[[i for i, (t, _) in enumerate(counted) if not len(t)]]
        model = cls(terms, scale, BlockMaxIndex(), given[full], [rows[i].id for i in full], float((zero.sum() + share) / (len(zero) + 1)), 1.0, 0.0)
        vectors = [model.vector(*counted[i]) for i in full]
        model.index = BlockMaxIndex.build(vectors, len(terms))
        votes = np.array([model.vote(*v, without=i)[0] for i, v in enumerate(vectors)])
        model.slope, model.offset = logistic(votes, model.labels)
        return model

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vector over the terms of the examples."""
        weights = (1 + np.log(counts)) * self.scale[terms]
        return terms, weights / math.sqrt(float(weights @ weights))

    def vote(self, terms: np.ndarray, values: np.ndarray, without: int = -1, frequent: np.ndarray | None = None) -> tuple[float, list[tuple[int, float]]]:
        """Log odds of the distance-weighted vote, with the neighbours that cast it."""
        found, cosines = self.index.nearest(terms, values, NEIGHBOURS, without, frequent)
        weights = cosines**2 / max(float(cosines[0]) ** 2, 1e-12) if len(cosines) else cosines
        yes = float(weights @ self.labels[found]) if len(found) else 0.0
        return math.log((yes + 0.1) / (float(weights.sum()) - yes + 0.1)), list(zip(found.tolist(), cosines.tolist(), strict=True))

    def score_all(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[tuple[int, float]]]]:
        """Score and neighbours of each of some texts, by their terms and counts."""
        out: list[tuple[float, list[tuple[int, float]]]] = [(self.zero_score, [])] * len(counted)
        full = [i for i, (terms, _) in enumerate(counted) if len(terms)]
        for low in range(0, len(full), TOGETHER):
            vectors = [self.vector(*counted[i]) for i in full[low : low + TOGETHER]]
            for i, vector, frequent in zip(full[low : low + TOGETHER], vectors, self.index.of_frequent(vectors), strict=True):
                vote, found = self.vote(*vector, frequent=frequent)
                out[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * vote + self.offset)))), found
        return out

    def score(self, docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", score_col: str = "score", evidence_col: str = "evidence") -> DataFrame:
        """``docs`` (or the columns ``keep``) with the score and its evidence: the nearest examples' ids, labels and cosines."""
        carried = docs.sparkSession.sparkContext.broadcast(self)
        words: list[TermIds] = []
        seen: dict[bytes, tuple] = {}
        evidence = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("cosine", T.DoubleType())]))
        arrow = pa.list_(pa.struct([("id", pa.string()), ("label", pa.int32()), ("cosine", pa.float64())]))

        def score(texts: list[str]) -> list[pa.Array]:
            model = carried.value
            if not words:
                words.append(TermIds(model.terms))
            # copies are scored once; a hash of 128 bits stands for the text
            keys = [hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest() for text in texts]
            if len(seen) > 20_000:
                seen.clear()
            new = {key: text for key, text in zip(keys, texts, strict=True) if key not in seen}
            for key, (value, found) in zip(new, model.score_all([words[0].counts(t) for t in new.values()]), strict=True):
                seen[key] = value, [{"id": str(model.ids[i]), "label": int(model.labels[i]), "cosine": c} for i, c in found[:3]]
            scores, proofs = [seen[key][0] for key in keys], [seen[key][1] for key in keys]
            return [pa.array(scores, pa.float64()), pa.array(proofs, arrow)]

        return with_text_columns(docs, text_col, keep, [(score_col, T.DoubleType()), (evidence_col, evidence)], score)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of the ridge-penalised logistic fit of y on x, by Newton steps."""
    a, b = 1.0, 0.0
    if not len(y):
        return a, b
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        gradient = np.array([((p - y) * x).sum() + 0.01 * (a - 1), (p - y).sum() + 0.01 * b])
        hessian = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(hessian, gradient)
        scale = min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a - scale * step[0], b - scale * step[1]
    return max(float(a), 0.05), float(b)
