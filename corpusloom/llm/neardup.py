"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A text is its lower-cased words. Order MinHash: for each of ``SKETCHES`` hash functions the ``KEPT`` k-mers of ``K`` words
with the least hash are taken, each k-mer told from its repetitions by its number, and joined in the order they have
in the text; two texts agree in a sketch with a probability that grows with their edit similarity. Texts that
agree in a sketch are candidates; a pair is linked when banded alignment finds a similarity of ``SIMILARITY`` or more: words
are aligned by chains of shared shingles of ``SHINGLE`` words (told apart by number), increasing in both texts and no
further off the diagonal than the similarity allows, and the similarity is shared / (all of both - shared).

Exact copies meet first, by a 128-bit hash of their words, and go on as one text, so a group of copies of any size is one row.
In a bucket of at most ``SMALL`` texts every two are compared until they are linked. A larger one is first cut in chunks, each
with the bucket's pivot (the member whose buckets are largest, the likely original), and compared chunk by chunk, so that no task holds
the whole bucket. Links become classes by spreading the least label. What is then not of the bucket's largest class is the rest: it is
cut in blocks, and each block meets every block of the bucket, so that any two texts of a bucket are of one class or have been
compared. Two blocks are compared by the product of their 0/1 shingle tables, which bounds the similarity from above, and only
pairs that can be alike are aligned. Nothing of this reaches the driver but counts and a bitmap of bounded size.

Defined results: a text without words (null is the empty text) is a copy of equal raw texts only; texts of fewer than
``SHINGLE`` words have exact copies only; ``class_id`` is the least id of the class (null ids come last, so a class of null
ids has class null); rows that share an id keep a row each; extra columns play no part; texts of any length are read whole; an empty table has
no classes. ``deduplicated`` knows a row by its id and a hash of all its columns, so rows of one id or of none are told apart by
their texts, and of rows alike in all columns one stays.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import delete, small_batches, stored, stored_at

K = 3
KEPT = 2
SKETCHES = 8
SHINGLE = 5
SIMILARITY = 0.8
SMALL = 256
CHUNK = 256
#: From so many texts on, shared shingles are counted by products of tables.
TABLED = 12
#: Columns of such a table.
COLUMNS = 8192
#: Bits of the bitmap that is broadcast, at most (64 MB).
MAX_BITS = 1 << 29
WORD = re.compile(r"[^\W_]+")
SEEDS = np.array([zlib.crc32(f"sketch {i}".encode()) * 0x9E3779B97F4A7C15 % 2**64 for i in range(SKETCHES)], np.uint64)


class WordCodes(dict):
    """Word as written -> 32-bit hash of its lower case; emptied when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        code = self[word] = zlib.crc32(word.lower().encode("utf-8", "surrogatepass"))
        return code


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmers(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x100000001B3) + words[i : i + n])
    return out


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Each hash joined with how often it stood before."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    if first.all():
        return hashes
    at = np.arange(len(hashes))
    number = np.empty(len(hashes), np.uint64)
    number[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return np.where(number == 0, hashes, mixed(hashes + number * np.uint64(0x9E3779B97F4A7C15)))


def order_minhash(words: np.ndarray) -> list[int]:
    """``SKETCHES`` signed 64-bit sketches; none for texts of fewer than ``SHINGLE`` words."""
    if len(words) < SHINGLE:
        return []
    plain = kmers(words, K)
    scattered = mixed(numbered(plain)[None, :] ^ SEEDS[:, None])
    least = np.argpartition(scattered, KEPT - 1, axis=1)[:, :KEPT] if len(plain) > KEPT else np.broadcast_to(np.arange(len(plain)), (SKETCHES, len(plain)))
    least = np.sort(least, axis=1)
    out = SEEDS.copy()
    for i in range(least.shape[1]):
        out = mixed(out * np.uint64(0x100000001B3) + plain[least[:, i]])
    return out.view(np.int64).tolist()


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two numbered shingle lists by the longest chain within the band; 0 if it can't reach ``least``."""
    na, nb = len(a), len(b)
    if not na or not nb or min(na, nb) < least * max(na, nb):
        return 0.0
    need = least * (na + nb) / (1 + least)
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(at_a) < need - 1e-9:
        return 0.0
    band = int(np.ceil(na + nb - 2 * need)) + 1
    inside = np.abs(at_a - at_b) <= band
    at_a, at_b = at_a[inside], at_b[inside]
    chain = at_b[np.argsort(at_a, kind="stable")]
    if len(chain) and (chain[1:] > chain[:-1]).all():
        shared = len(chain)
    else:
        tails: list[int] = []
        for x in chain.tolist():
            i = bisect_left(tails, x)
            if i == len(tails):
                tails.append(x)
            else:
                tails[i] = x
        shared = len(tails)
    similarity = shared / (na + nb - shared)
    return similarity if similarity >= least - 1e-12 else 0.0


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, row (hash of all columns), print (hash of the words), sketches, words`` for each row, stored.

    ``words`` keeps 16 bits of each word's hash: a shingle of five then has 80, and alignment compares shingles.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("row", T.LongType()), T.StructField("print", T.BinaryType()), T.StructField("sketches", T.ArrayType(T.LongType())), T.StructField("words", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                prints, sketches, lists = [], [], []
                for text in part.column(2).to_pylist():
                    found = WORD.findall(text or "")
                    words = np.fromiter(map(codes.__getitem__, found), np.uint32, len(found))
                    data = words.tobytes()
                    prints.append(hashlib.blake2b(data if found else b"raw" + (text or "").encode("utf-8", "surrogatepass"), digest_size=16, person=b"words" if found else b"raw").digest())
                    sketches.append(order_minhash(words))
                    lists.append(words.astype(np.uint16).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(prints, pa.binary()), pa.array(sketches, pa.list_(pa.int64())), pa.array(lists, pa.binary())], names=schema.fieldNames())

    return stored(small_batches(docs).select(id_col, row_key(docs), text_col).mapInArrow(run, schema), "sketches")


def row_key(docs: DataFrame) -> Column:
    """Hash of all columns; with the id it names a row, or rows alike in all columns."""
    return F.xxhash64(*docs.columns).alias("row")


def bucket_members(rows: DataFrame) -> DataFrame:
    """``print, sketch, n, weight``: distinct texts in buckets of two and more; weight: how large a text's buckets are.

    Sketches of different hash functions have different seeds, so the value alone names the bucket.
    """
    texts = rows.groupBy("print").agg(F.first("sketches").alias("sketches"))
    members = texts.select("print", F.explode(F.array_distinct("sketches")).alias("sketch"))
    sizes = members.groupBy("sketch").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(members.join(sizes, "sketch"), "buckets")
    weights = shared.groupBy("print").agg(F.sum(F.log("n")).alias("weight"))
    return shared.join(weights, "print")


def chunks(members: DataFrame) -> DataFrame:
    """``sketch, chunk, print, first, side, label``: members of the buckets in chunks to compare; each chunk of a large one has its pivot, ``first``."""
    large = members.where(F.col("n") > SMALL)
    pivots = large.groupBy("sketch").agg(F.max_by("print", F.struct("weight", "print")).alias("pivot"))
    parts = F.ceil(F.col("n") / CHUNK).cast("int")
    spread = F.when(F.col("print") == F.col("pivot"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("print"), parts).cast("int")))
    cut = large.join(pivots, "sketch").select("sketch", F.explode(spread.cast("array<bigint>")).alias("chunk"), "print", (F.col("print") == F.col("pivot")).alias("first"))
    small = members.where(F.col("n") <= SMALL).select("sketch", F.lit(0).cast("long").alias("chunk"), "print", F.lit(False).alias("first"))
    return stored(small.unionByName(cut).withColumns({"side": F.lit(None).cast("int"), "label": F.lit(None).cast("binary")}), "chunks")


def block_pairs(members: DataFrame, labels: DataFrame) -> DataFrame | None:
    """``sketch, chunk, print, side, label`` of large buckets of more than one class: the rest's blocks with each other and with the largest class's.

    ``chunk`` names two blocks, and texts of side 0 are to be compared with those of side 1; a rest block meets itself without sides.
    """
    large = members.where(F.col("n") > SMALL)
    named = stored(large.join(labels.withColumnRenamed("node", "print"), "print", "left").select("sketch", "print", F.coalesce("label", "print").alias("label")), "named")
    sizes = named.groupBy("sketch", "label").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("sketch").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.max("n").alias("same"), F.sum("n").alias("n")).where("n > same")
    blocks = most.select("sketch", "most", F.ceil((F.col("n") - F.col("same")) / CHUNK).cast("int").alias("rests"), F.ceil(F.col("same") / CHUNK).cast("int").alias("mosts"))
    met = named.join(blocks, "sketch").withColumn("rest", F.col("label") != F.col("most"))
    own = F.pmod(F.xxhash64("print"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mosts"))).cast("int")
    pairs = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rests") - 1 + F.when(F.col("rest"), F.col("mosts")).otherwise(0))))
    place = F.when(F.col("rest"), F.col("own")).otherwise(F.col("rests") + F.col("own"))
    side = F.when(place < F.col("other"), 0).when(place > F.col("other"), 1)
    chunk = F.least(place, "other").cast("long") * F.lit(1 << 31) + F.greatest(place, "other")
    out = stored(pairs.select("sketch", chunk.alias("chunk"), "print", side.alias("side"), "label"), "pairs")
    return out if out.limit(1).count() else None


def candidate_texts(members: DataFrame, rows: DataFrame) -> DataFrame:
    """``print, words`` of the texts that share a bucket with another, once each, stored.

    A bitmap over hashes of the wanted prints, of ``MAX_BITS`` bits at most, lets most other rows out before the shuffle; the
    join removes those that it passes in error.
    """
    wanted = stored(members.select("print").distinct(), "wanted")
    size = 1 << min(MAX_BITS.bit_length() - 1, max(16, (16 * wanted.count()).bit_length()))
    place = F.xxhash64("print").bitwiseAND(F.lit(size - 1))
    words = wanted.select((place / 64).cast("long").alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    bits = np.zeros(size // 64, np.int64)
    for row in words.toLocalIterator():
        bits[row["at"]] = row.bits
    carried = rows.sparkSession.sparkContext.broadcast(bits)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            keep = (carried.value[at // 64] >> (at % 64)) & 1
            yield batch.select([0, 1]).filter(pa.array(keep.astype(bool)))

    likely = rows.select("print", "words", place.alias("place")).mapInArrow(passed, "print binary, words binary")
    # copies go before the shuffle: a task sends one row of each text
    return stored(likely.groupBy("print").agg(F.first("words").alias("words")).join(wanted, "print", "left_semi"), "texts")


def links(chunked: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b``: pairs of prints that are alike, enough of them to join what is alike in each chunk."""
    keys = ["sketch", "chunk"]
    together = chunked.join(texts, "print").select(*keys, "print", "side", "label", "first", "words").repartition(*keys).sortWithinPartitions(*keys, F.desc("first"), "print").drop("first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        out: set[tuple[bytes, bytes]] = set()
        for batch in batches:
            for sketch, chunk, *text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (sketch, chunk) != key:
                    out.update(compared(group))
                    key, group = (sketch, chunk), []
                group.append(text)
            if len(out) > 10_000:
                yield rows_of(out)
                out = set()
        out.update(compared(group))
        yield rows_of(out)

    def rows_of(found: set[tuple[bytes, bytes]]) -> pa.RecordBatch:
        ordered = sorted(found)
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in ordered], pa.binary()), pa.array([x[1] for x in ordered], pa.binary())], names=["a", "b"])

    return stored(together.mapInArrow(run, "a binary, b binary"), "found")


def can_be_alike(lists: list[np.ndarray], least: float = SIMILARITY) -> np.ndarray:
    """For every two shingle lists, whether their lengths and shared shingles, in whatever order, allow the similarity ``least``."""
    sizes = np.array([len(x) for x in lists], np.float64)
    _, column, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(lists)), sizes.astype(np.int64))
    of_two = counts > 1
    owner, column = owner[of_two[column]], (np.cumsum(of_two) - 1)[column[of_two[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(lists), len(lists)), np.float32)
    for start in range(0, int(of_two.sum()), COLUMNS):
        low, high = np.searchsorted(column, [start, start + COLUMNS])
        table = np.zeros((len(lists), COLUMNS), np.float32)
        table[owner[low:high], column[low:high] - start] = 1
        shared += table @ table.T
    both = sizes[:, None] + sizes
    near = np.minimum(sizes[:, None], sizes) >= least * np.maximum(sizes[:, None], sizes)
    return near & (shared >= least * both / (1 + least) - 1e-3)


def compared(group: list) -> list[tuple[bytes, bytes]]:
    """Links of a chunk of ``print, side, label, words``: every two texts (of different sides, where there are any) until they are of one class."""
    if len(group) < 2:
        return []
    shingles = [numbered(kmers(np.frombuffer(g[3], np.uint16), SHINGLE)) for g in group]
    first: dict[bytes, int] = {}
    root = [i if g[2] is None else first.setdefault(g[2], i) for i, g in enumerate(group)]
    sides = [g[1] for g in group]

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    alike = can_be_alike(shingles) if len(group) >= TABLED else np.ones((len(group), len(group)), bool)
    for i in range(len(group)):
        for j in (np.flatnonzero(alike[i, i + 1 :]) + i + 1).tolist():
            if sides[i] is not None and sides[i] == sides[j]:
                continue
            a, b = top(i), top(j)
            if a != b and aligned_similarity(shingles[i], shingles[j]):
                root[max(a, b)] = min(a, b)
                out.append((group[i][0], group[j][0]))
    return out


def spread_labels(edges: DataFrame) -> DataFrame:
    """``node, label``: least node of each component, by spreading least labels and jumping to labels' labels.

    A link that several sketches or chunks found counts once, so a round's join makes two rows for each link between different texts.
    """
    spark = edges.sparkSession
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y")))
    labels, path = stored_at(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        now = labels.join(near, "node", "left").join(jump, "label", "left")
        now, later = stored_at(now.select("node", F.least("label", "near", "jump").alias("label"), (F.least("label", "near", "jump") < F.col("label")).alias("moved")), "labels")
        delete(spark, path)
        labels, path = now.select("node", "label"), later
        if now.where("moved").limit(1).count() == 0:
            return labels


def joined_labels(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``node, label`` after further links: only classes that these join are spread again, each as one node, its label."""
    known = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    named = more.select("a", "b").distinct().join(known, "a", "left").join(known.toDF("b", "lb"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b")
    over = spread_labels(named)
    moved = labels.join(over.toDF("label", "least"), "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    return stored(moved.unionByName(over.join(labels.select("node"), "node", "left_anti")), "labels")


def grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``doc_id, row, print`` of the rows, and ``print, label`` of the texts that are like others; stored both."""
    rows = sketched(docs, id_col, text_col)
    members = stored(bucket_members(rows), "members")
    texts = candidate_texts(members, rows)
    edges = links(chunks(members), texts)
    labels = spread_labels(edges)
    pairs = block_pairs(members, labels) if members.where(F.col("n") > SMALL).limit(1).count() else None
    if pairs is not None:
        more = links(pairs.withColumn("first", F.lit(False)), texts)
        if more.limit(1).count():
            labels = joined_labels(labels, more)
    return rows.select("doc_id", "row", "print"), labels.withColumnRenamed("node", "print")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, print``: one row for each row of ``docs``."""
    rows, labels = grouped(docs, id_col, text_col)
    named = rows.groupBy("print").agg(F.min("doc_id").alias("least")).join(labels, "print", "left").withColumn("label", F.coalesce("label", "print"))
    ids = named.groupBy("label").agg(F.min("least").alias("class_id"))
    # stored, so that the last join is one of two tables whose large partitions adaptive execution can split: a print may be a third of all rows
    known = stored(named.join(ids, "label").select("print", "class_id"), "named")
    return rows.join(known, "print").select("doc_id", "class_id", "print")


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row, n`` of the row that stays of each class: the one of the least id (none comes last), then hash; ``n`` rows are alike in all columns."""
    rows, labels = grouped(docs, id_col, text_col)
    alike = rows.groupBy("print", "doc_id", "row").agg(F.count(F.lit(1)).alias("n"))
    first = alike.groupBy("print").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "n")).alias("kept"))
    named = first.join(labels, "print", "left").withColumn("label", F.coalesce("label", "print"))
    return named.groupBy("label").agg(F.min("kept").alias("kept")).select("kept.doc_id", "kept.row", "kept.n")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class."""
    kept = stored(kept_rows(docs, id_col, text_col), "kept").withColumnsRenamed({"doc_id": "__id", "row": "__row"})
    found = docs.withColumn("__own", row_key(docs)).join(kept, (F.col("__own") == F.col("__row")) & F.col(id_col).eqNullSafe(F.col("__id")))
    single = found.where("n = 1").select(docs.columns)
    if kept.where("n > 1").limit(1).count() == 0:
        return single
    return single.unionByName(found.where("n > 1").dropDuplicates(["__own", "__id"]).select(docs.columns))
