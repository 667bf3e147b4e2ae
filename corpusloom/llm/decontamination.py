"""Benchmark decontamination over a stored positional inverted index of the training corpus.

``build_index`` cuts the corpus in shards of about ``SHARD_WORDS`` words and writes one row for each shard to the shared
folder: the distinct terms with their counts, the position lists of ALL terms one after another (int32 positions in
the shard, a gap between documents), and the documents with their first positions. ``matches`` broadcasts a block of
benchmark items (at most ``ITEM_BLOCK_WORDS`` words; more items are taken block by block, so what is broadcast is
bounded), sums the terms' counts over all shards to order each window's terms from the rarest, and intersects the offset-adjusted
position lists of a shard until none is left or all terms agree: exact phrase matches. ``proximity`` does the same for
all terms of a window within a span, in any order. No posting is ever shuffled.

Words: A-Z lower-cased, then maximal runs of characters that are 0-9, a-z or above U+007F. A window is 10 consecutive
words of an item; an item of fewer words, but not none, is one window. Defined results: null and empty texts have no
words and no hits; items without words, and items with a null id, occur nowhere; several rows of one item_id are one
item with the windows of all; each document row is judged by itself, so repeated rows repeat their result. Texts of
any length are indexed whole. Without items nothing is hit, and an empty corpus has no rows. Of terms of equal count the one that comes
first in a window goes first, which changes no result. Columns other than id and text play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import small_batches, stored

WINDOW = 10
#: A shard is closed when it holds so many words (a longer document is a shard of its own).
SHARD_WORDS = 400_000
#: Benchmark words that are broadcast at a time, at most (or one item).
ITEM_BLOCK_WORDS = 500_000
WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")
GAP = 1


def words(text: str | None) -> list[str]:
    """Words of a text; bytes are lower-cased, which changes A-Z only."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")) if text else []


def index_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("shard", T.LongType()),
            T.StructField("terms", T.StringType()),
            T.StructField("counts", T.BinaryType()),
            T.StructField("positions", T.BinaryType()),
            T.StructField("doc_ids", T.ArrayType(id_type)),
            T.StructField("starts", T.BinaryType()),
            T.StructField("lengths", T.BinaryType()),
        ]
    )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The corpus's positional inverted index, one row for each shard, stored in the shared folder."""
    schema = index_schema(docs.schema[id_col].dataType)
    arrow_id = pa.list_(docs.select(id_col).limit(0).toArrow().schema.field(0).type)

    def shard(number: int, ids: list, tokens: list[list[str]]) -> pa.RecordBatch:
        vocabulary: dict[str, int] = {}
        lengths = np.array([len(t) for t in tokens], np.int32)
        starts = (np.cumsum(lengths + GAP) - lengths - GAP).astype(np.int32)
        codes = np.array([vocabulary.setdefault(w, len(vocabulary)) for t in tokens for w in t], np.int32)
        at = np.arange(len(codes), dtype=np.int32) + GAP * np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        order = np.argsort(codes, kind="stable")
        counts = np.bincount(codes, minlength=len(vocabulary)).astype(np.int32)
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (counts, at[order], starts, lengths)]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([" ".join(vocabulary)], pa.string()), blobs[0], blobs[1], pa.array([ids], arrow_id), blobs[2], blobs[3]], names=schema.fieldNames())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        tokens: list[list[str]] = []
        held = 0
        # a task that runs again gives its shards the same numbers
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                tokens.append(words(text))
                held += len(tokens[-1]) + 8
                if held >= shard_words:
                    yield shard(number, ids, tokens)
                    ids, tokens, held, number = [], [], 0, number + 1
        if ids:
            yield shard(number, ids, tokens)

    return stored(small_batches(docs).select(id_col, text_col).mapInArrow(run, schema), "postings")


def item_windows(items: list[tuple], window: int = WINDOW) -> tuple[dict[str, int], list[np.ndarray], list[str]]:
    """Terms of the items, and each distinct window with the item it is of (as text)."""
    vocabulary: dict[str, int] = {}
    windows: dict[tuple, None] = {}
    for item_id, text in items:
        found = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
        for i in range(max(1, len(found) - window + 1) if found else 0):
            windows[tuple(found[i : i + window]), str(item_id)] = None
    return vocabulary, [np.array(w, np.int32) for w, _ in windows], [i for _, i in windows]


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple]]:
    """The benchmark in blocks of at most ``most`` words (or one item), streamed to the driver a partition at a time."""
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col)
    block: list[tuple] = []
    held = 0
    for row in rows.toLocalIterator():
        n = len(words(row[1]))
        if block and held + n > most:
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += n
    yield block


def term_counts(index: DataFrame, vocabulary: dict[str, int]) -> np.ndarray:
    """How often each benchmark term stands in the whole corpus; only terms and counts are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([vocabulary.get(t, -1) for t in terms.split(" ")] if terms else [], np.int64)
                out[ids[ids >= 0]] += np.frombuffer(counts, np.int32)[ids >= 0]
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out[at], pa.int64())], names=["term", "n"])

    total = np.zeros(len(vocabulary), np.int64)
    for row in index.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        total[row.term] = row.n
    return total


class Postings:
    """Position lists of one shard for the terms of a benchmark block."""

    def __init__(self, terms: str, counts: bytes, positions: bytes, vocabulary: dict[str, int]):
        ends = np.cumsum(np.frombuffer(counts, np.int32), dtype=np.int64)
        at = np.frombuffer(positions, np.int32)
        self.lists: dict[int, np.ndarray] = {}
        for i, term in enumerate(terms.split(" ") if terms else []):
            if (k := vocabulary.get(term)) is not None:
                self.lists[k] = at[ends[i - 1] if i else 0 : ends[i]]

    def phrase(self, window: np.ndarray, order: np.ndarray) -> np.ndarray:
        """First positions of the window's occurrences: the rarest term's list, met with each other list less its offset."""
        found = None
        for k in order:
            own = self.lists.get(int(window[k]))
            if own is None:
                return np.zeros(0, np.int64)
            if found is None:
                found = own.astype(np.int64) - k
                continue
            at = np.searchsorted(own, found + k)
            at[at == len(own)] = len(own) - 1
            found = found[own[at] == found + k]
            if not len(found):
                break
        return found

    def near(self, window: np.ndarray, order: np.ndarray, span: int) -> np.ndarray:
        """Positions of the rarest term from which every other term of the window is less than ``span`` words away."""
        rarest = self.lists.get(int(window[order[0]]))
        if rarest is None:
            return np.zeros(0, np.int64)
        found = rarest.astype(np.int64)
        for k in order[1:]:
            own = self.lists.get(int(window[k]))
            if own is None:
                return np.zeros(0, np.int64)
            at = np.searchsorted(own, found - span + 1)
            at[at == len(own)] = len(own) - 1
            found = found[np.abs(own[at] - found) < span]
            if not len(found):
                break
        return found


def shards(batch: pa.RecordBatch) -> Iterator[list]:
    """Rows of a batch, one at a time: only one shard's lists are held as Python objects."""
    for i in range(batch.num_rows):
        yield [c[i].as_py() for c in batch.columns]


def live_windows(index: DataFrame, items: list[tuple], window: int) -> tuple[dict[str, int], list[np.ndarray], list[np.ndarray], list[str], dict[int, list[int]]]:
    """Terms, windows with their terms from the rarest, owners, and the windows by their rarest term; those whose rarest term is nowhere can't occur and go."""
    vocabulary, windows, owners = item_windows(items, window)
    counts = term_counts(index, vocabulary) if windows else np.zeros(0)
    orders = [np.argsort(counts[w], kind="stable") for w in windows]
    live = [i for i, w in enumerate(windows) if counts[w[orders[i][0]]] > 0]
    windows, orders, owners = [windows[i] for i in live], [orders[i] for i in live], [owners[i] for i in live]
    by_rarest: dict[int, list[int]] = {}
    for i, (w, order) in enumerate(zip(windows, orders, strict=True)):
        by_rarest.setdefault(int(w[order[0]]), []).append(i)
    return vocabulary, windows, orders, owners, by_rarest


def _hits(index: DataFrame, items: list[tuple], window: int, id_type: T.DataType) -> DataFrame:
    """For each document row: shard, number in it, id, n_words, the hit word positions, and the items with windows in it.

    A shard asks for the windows whose rarest term it has, so what a task does follows its own terms, not the benchmark's size.
    """
    carried = index.sparkSession.sparkContext.broadcast(live_windows(index, items, window))
    arrow_id = index.select("doc_ids").limit(0).toArrow().schema.field(0).type.value_type
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("number", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, windows, orders, owners, by_rarest = carried.value
        for batch in batches:
            for shard, terms, counts, positions, ids, starts, lengths in shards(batch):
                postings = Postings(terms, counts, positions, vocabulary)
                first, n = np.frombuffer(starts, np.int32), np.frombuffer(lengths, np.int32)
                hits: dict[int, set[int]] = {}
                found: dict[int, set[str]] = {}
                for i in (i for term in postings.lists for i in by_rarest.get(term, ())):
                    for p in postings.phrase(windows[i], orders[i]).tolist():
                        d = int(np.searchsorted(first, p, side="right")) - 1
                        hits.setdefault(d, set()).update(range(p - int(first[d]), p - int(first[d]) + len(windows[i])))
                        found.setdefault(d, set()).add(owners[i])
                columns = [pa.array([shard] * len(ids), pa.int64()), pa.array(np.arange(len(ids)), pa.int32()), pa.array(ids, arrow_id), pa.array(n, pa.int64()), pa.array([sorted(hits.get(i, ())) for i in range(len(ids))], pa.list_(pa.int32())), pa.array([sorted(found.get(i, ())) for i in range(len(ids))], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return index.mapInArrow(run, schema)


def matches(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text", block_words: int = ITEM_BLOCK_WORDS) -> DataFrame:
    """``doc_id, n_words, hits (word positions), items`` for each row that was indexed.

    A benchmark of several blocks gives one pass over the index for each; their results meet by the shard and the row's number in it.
    """
    id_type = index.schema["doc_ids"].dataType.elementType
    blocks = list(item_blocks(benchmark, item_col, text_col, block_words))
    out = ["doc_id", "n_words", "hits", "items"]
    if len(blocks) == 1:
        return _hits(index, blocks[0], window, id_type).select(out)
    both = _hits(index, blocks[0], window, id_type)
    for block in blocks[1:]:
        both = both.unionByName(_hits(index, block, window, id_type))
    merged = both.groupBy("shard", "number").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return merged.select("doc_id", "n_words", F.array_sort("hits").alias("hits"), F.array_sort("items").alias("items"))


def proximity(index: DataFrame, benchmark: DataFrame, span: int = 20, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, position``: where all terms of a window stand less than ``span`` words from its rarest term, within a document."""
    id_type = index.schema["doc_ids"].dataType.elementType
    out = None
    for items in item_blocks(benchmark, item_col, text_col, ITEM_BLOCK_WORDS):
        carried = index.sparkSession.sparkContext.broadcast(live_windows(index, items, window))
        arrow_id = index.select("doc_ids").limit(0).toArrow().schema.field(0).type.value_type
        schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("item_id", T.StringType()), T.StructField("position", T.LongType())])

        def run(batches: Iterator[pa.RecordBatch], carried=carried, arrow_id=arrow_id, schema=schema) -> Iterator[pa.RecordBatch]:
            vocabulary, windows, orders, owners, by_rarest = carried.value
            for batch in batches:
                for _, terms, counts, positions, ids, starts, lengths in shards(batch):
                    postings = Postings(terms, counts, positions, vocabulary)
                    first, n = np.frombuffer(starts, np.int32), np.frombuffer(lengths, np.int32)
                    rows = set()
                    for w, order, owner in ((windows[i], orders[i], owners[i]) for term in postings.lists for i in by_rarest.get(term, ())):
                        for p in postings.near(w, order, span).tolist():
                            d = int(np.searchsorted(first, p, side="right")) - 1
                            own = [postings.lists[int(k)] for k in w]
                            low, high = max(int(first[d]), p - span + 1), min(int(first[d] + n[d]), p + span)
                            if all(np.searchsorted(x, low) < np.searchsorted(x, high) for x in own):
                                rows.add((d, owner, p - int(first[d])))
                    rows = sorted(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d, _, _ in rows], arrow_id), pa.array([o for _, o, _ in rows], pa.string()), pa.array([p for _, _, p in rows], pa.int64())], names=schema.fieldNames())

        found = index.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def verdicts(found: DataFrame) -> DataFrame:
    """Digest of ``matches``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The verdicts by plain search, for tests."""
    out = []
    for doc_id, text in docs:
        w, hit, of = words(text), set(), set()
        for item_id, other in items:
            v = words(other) if item_id is not None else []
            for i in range(max(1, len(v) - window + 1) if v else 0):
                part = v[i : i + window]
                for j in range(len(w) - len(part) + 1):
                    if w[j : j + len(part)] == part:
                        hit.update(range(j, j + len(part)))
                        of.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit)))
    return out


ORACLE = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), v AS (
    SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(greatest(1, len(w) - 9)), lambda k: array_to_string(w[k + 1:k + least(10, len(w))], ' '))) AS g FROM i WHERE len(w) > 0
), win AS (
    SELECT DISTINCT item_id, n, g FROM v
), sizes AS (
    SELECT DISTINCT n FROM win
), grams AS (
    SELECT doc_id, n, unnest(range(len(w) - n + 1)) AS p, unnest(list_transform(range(len(w) - n + 1), lambda k: array_to_string(w[k + 1:k + n], ' '))) AS g FROM d, sizes WHERE len(w) >= n
), hit AS (
    SELECT doc_id, p, n, item_id FROM grams JOIN win USING (n, g)
), places AS (
    SELECT doc_id, item_id, unnest(range(p, p + n)) AS place FROM hit
), found AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS items FROM places GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN found USING (doc_id)
"""
