"""Quality, toxicity and language-model scoring: held-out accuracy, brute force, and odd inputs."""

import itertools
import math
import random
import urllib.parse
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from corpusloom.llm import lm, quality, toxicity
from corpusloom.llm.common import held_out, training_labels
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = "the quiet river runs past old stone houses and green fields toward a wide grey sea".split()


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(GOOD) for _ in range(rng.randint(20, 60))]
        bad, toxic = i % 4 == 0, i % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vileword", "vilename", "vilething"])
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + "."
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = corpus()
    odd = [(1000, None, "en", "s", None), (1001, "", "en", "s", 0), (None, "The river.", None, None, None), (1002, "word " * 60_000, "en", "s", 300_000), (1002, "word " * 60_000, "en", "s", 300_000)]
    return spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None), (7, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")


def test_folds(spark):
    ids = [None, *range(200)]
    rows = spark.createDataFrame([(i,) for i in ids], "i long").select("i", held_out(F.col("i")).alias("h")).collect()
    assert all(r.h == (r.i is not None and zlib.crc32(str(r.i).encode()) % 3 == 1) for r in rows)


def test_training_labels_leave_the_held_out_fold_and_count_ids_once(frames):
    _, labels = frames
    rows = training_labels(labels, "quality", 1000).collect()
    ids = [r["__id"] for r in rows]
    assert len(ids) == len(set(ids)) and None not in ids
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids)
    assert len(training_labels(labels, "quality", 10).collect()) == 10


def test_quality_on_held_out_rows(frames):
    docs, labels = frames
    model = quality.QualityClassifier.fit(docs, labels)
    clash = docs.withColumn("score", F.lit("old")).withColumn("other", F.lit(1))
    scored = model.score(clash)
    assert scored.columns == [*docs.columns, "other", "score"]
    rows = scored.collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 for r in rows)
    truth = {i: q for i, q, _ in corpus()[1]}
    known = [r for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in known]) > 0.95
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r.score)
    assert by_id[1000] == by_id[1001] and by_id[1002][0] == by_id[1002][1]


def test_quality_context_sums_are_the_plain_ones(spark):
    texts = ["a b c a", "b", "", None, "c c"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    sums = quality.context_sums(docs)
    index = quality.index_vectors()
    plain = np.zeros((quality.BUCKETS, quality.DIM + 1))
    code = lambda w: zlib.crc32(w.encode()) % quality.BUCKETS
    for t in texts:
        words = (t or "").split()
        for i, w in enumerate(words):
            plain[code(w), quality.DIM] += 1
            for d in (-2, -1, 1, 2):
                if 0 <= i + d < len(words):
                    plain[code(w), : quality.DIM] += index[code(words[i + d])]
    assert np.allclose(sums, plain, atol=1e-4)


def test_quality_without_rows_or_labels(spark, frames):
    docs, labels = frames
    empty = spark.createDataFrame([], DOCS)
    model = quality.QualityClassifier.fit(empty, labels)
    assert model.score(empty).count() == 0
    assert {r.score for r in model.score(docs.limit(3)).collect()} == {0.5}


def test_toxicity_on_held_out_rows(frames):
    docs, labels = frames
    model = toxicity.ToxicityNeighbours.fit(docs, labels)
    rows = model.score(docs.withColumn("evidence", F.lit(1))).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    truth = {i: t for i, _, t in corpus()[1]}
    known = [r for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([(r.score >= 0.7) == truth[r.doc_id] for r in known]) > 0.95
    assert any(r.evidence for r in known) and all(e.cosine > 0 for r in known for e in r.evidence)
    assert next(r for r in rows if r.doc_id == 1000).score == model.zero_score


@pytest.mark.parametrize("frequent", [0.0, 1 / 6, 2.0])
def test_block_max_search_is_exact(frequent, monkeypatch):
    monkeypatch.setattr(toxicity, "FREQUENT", frequent)
    rng = np.random.default_rng(2)
    for size in (0, 1, 63, 700):
        vectors = []
        for _ in range(size):
            terms = np.sort(rng.choice(40, rng.integers(1, 8), replace=False))
            w = rng.integers(1, 4, len(terms)).astype(float)
            vectors.append((terms, w / np.linalg.norm(w)))
        index = toxicity.BlockMaxIndex.build(vectors, 40)
        assert size < 2 or len(index.dense) == (40 if not frequent else 0 if frequent > 1 else len(index.dense))
        whole = np.zeros((size, 40))
        for i, (terms, w) in enumerate(vectors):
            whole[i, terms] = w
        for at, (terms, w) in enumerate(vectors[:60]):
            for without in (-1, at):
                cosines = whole @ whole[at]
                if without >= 0:
                    cosines[without] = 0
                plain = sorted((-c, i) for i, c in enumerate(cosines) if c > 1e-6)[: toxicity.NEIGHBOURS]
                found, got = index.nearest(terms, w, toxicity.NEIGHBOURS, without)
                assert np.allclose(got, [-c for c, _ in plain], atol=1e-5)
                cut = -plain[-1][0] + 1e-4 if plain else 0
                assert {i for i, c in zip(found.tolist(), got, strict=True) if c > cut} == {i for c, i in plain if -c > cut}


def test_toxicity_scores_are_those_of_a_plain_search(frames):
    docs, labels = frames
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    model = toxicity.ToxicityNeighbours.fit(docs, labels)
    words = lambda t: [w.lower() for w in toxicity.WORD.findall(t)]
    fold = lambda i: zlib.crc32(str(i).encode()) % 3 != 1
    given = {i: t for i, _, t in corpus()[1] if fold(i)}
    given.pop(None, None)
    sample = [(set(words(t)), given[i]) for i, t in rows if i in given]
    assert model.terms == sorted(set().union(*(w for w, _ in sample)))
    texts = [set(words(t)) for _, t in rows]
    n1 = sum(y for _, y in sample)
    n0 = len(sample) - n1

    def scale(term):
        df = sum(term in t for t in texts)
        a, b = (sum(term in w for w, y in sample if y == k) for k in (1, 0))
        low = math.log((a + 0.5) / (n1 - a + 0.5)) - math.log((b + 0.5) / (n0 - b + 0.5)) - 2 * math.sqrt(1 / (a + 0.5) + 1 / (n1 - a + 0.5) + 1 / (b + 0.5) + 1 / (n0 - b + 0.5))
        return (math.log((len(rows) + 1) / (df + 1)) + 1) * (0.1 + max(0.0, low))

    assert np.allclose(model.scale, [scale(t) for t in model.terms])
    place = {t: i for i, t in enumerate(model.terms)}

    def vector(text):
        out = np.zeros(len(place))
        own = [w for w in words(text) if w in place]
        for w in set(own):
            out[place[w]] = (1 + math.log(own.count(w))) * model.scale[place[w]]
        return out / (np.linalg.norm(out) or 1)

    text_of = {str(i): t for i, t in rows}
    examples = np.array([vector(text_of[str(i)]) for i in model.ids])
    scored = {r.doc_id: r.score for r in model.score(docs).collect()}
    for i, text in rows[::7]:
        cosines = examples @ vector(text)
        order = np.lexsort((np.arange(len(cosines)), -cosines))[: toxicity.NEIGHBOURS]
        order = order[cosines[order] > 0]
        if not len(order):
            assert scored[i] == model.zero_score
            continue
        weights = cosines[order] ** 2 / cosines[order[0]] ** 2
        yes = float(weights @ model.labels[order])
        vote = math.log((yes + 0.1) / (weights.sum() - yes + 0.1))
        assert scored[i] == pytest.approx(1 / (1 + math.exp(-(model.slope * vote + model.offset))), abs=0.02)


def test_a_copy_of_an_example_finds_it(spark):
    name = lambda i: "abcdefghij"[i % 10] * (3 + i // 10)
    texts = [f"{name(i)}x {name(i)}y {name(i)}z" for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.ToxicityNeighbours.fit(docs, labels)
    known = set(model.ids)
    for r in model.score(docs.where("doc_id >= 100")).collect():
        if r.doc_id - 100 in known:
            assert r.evidence[0].id == str(r.doc_id - 100) and r.evidence[0].cosine == pytest.approx(1, abs=1e-5)
        else:
            assert r.score == model.zero_score


def test_toxicity_without_rows_or_labels(spark, frames):
    docs, labels = frames
    assert toxicity.ToxicityNeighbours.fit(spark.createDataFrame([], DOCS), labels).score(docs.limit(2)).collect()[0].score == 0.0
    assert toxicity.ToxicityNeighbours.fit(docs, labels.where("toxic = 0")).score(docs.limit(2)).count() == 2


def test_pseudo_likelihood_is_normalised_and_prefers_the_corpus(spark):
    rng = random.Random(3)
    text = lambda: " ".join(" ".join(random.Random(rng.randrange(40)).choices(GOOD, k=6)) for _ in range(20))
    docs = spark.createDataFrame([(i, text(), "en", "s", 0) for i in range(150)], DOCS)
    model, _ = lm.PseudoLikelihood.fit(docs, epochs=4)
    ids, _ = lm.codes_of("the\nquiet\nriver\nruns\npast", {w: lm.RARE + i for i, w in enumerate(model.words)}, model.spelling)
    tokens, at, _ = lm.laid_out([ids])
    total = 0.0
    for w in range(lm.VOCABULARY):
        other = tokens.copy()
        other[at[2]] = w
        total += math.exp(model.network.scorer().log_probabilities(other)[at[2]]) if w else 0
    assert total == pytest.approx(1, abs=1e-3)
    words = text().split()
    mixed = words[:]
    random.Random(9).shuffle(mixed)
    odd = spark.createDataFrame([(1, " ".join(words), 5), (2, " ".join(mixed), 5), (3, None, 5), (4, "", 5), (5, "zzzz " * 50_000, 5), (5, "zzzz " * 50_000, 5)], "doc_id long, text string, n_tokens int")
    scored = model.score(odd)
    assert scored.columns == ["doc_id", "text", "n_tokens", "log_likelihood", "mean_log_likelihood"]
    rows = {}
    for r in scored.collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert rows[1][0].mean_log_likelihood > rows[2][0].mean_log_likelihood > rows[5][0].mean_log_likelihood
    assert rows[3][0].n_tokens == 0 and rows[3][0].log_likelihood == 0 and rows[4][0].mean_log_likelihood == 0
    assert rows[5][0].n_tokens == 50_000 and rows[5][0].log_likelihood == pytest.approx(rows[5][1].log_likelihood)
    assert lm.PseudoLikelihood.fit(odd.where("false"))[0].score(odd).count() == 6


def test_spelling_is_a_distribution_over_the_words_of_a_length(spark):
    counted = spark.createDataFrame([("ab", 5), ("ba", 2), ("abb", 1), ("the", 100)], "word string, n long")
    spelling = lm.Spelling.of(counted, ["the"])
    assert set(spelling.alphabet) == {"a", "b"}
    others = lm.CODE_POINTS - 2
    for length in (1, 2, 3):
        total = 0.0
        for word in itertools.product("abz", repeat=length):
            total += math.exp(-spelling.cost("".join(word))) * others ** word.count("z")
        unused = np.exp(spelling.chain)[:, 2 : lm.CHARACTERS].sum(1)
        assert total <= 1 + 1e-9 and total > (1 - unused.max()) ** length - 1e-9
    assert spelling.cost("ab") < spelling.cost("bb") < spelling.cost("zz")
    assert spelling.cost("a" * 40) > spelling.cost("a" * 30)


def test_a_rare_word_is_told_from_gibberish_of_its_length(spark):
    docs = spark.createDataFrame([(i, f"the stone{c}bridge") for i, c in enumerate("abcdefghij" * 3)], "doc_id long, text string")
    words, counts, spelling, total = lm.vocabulary(lm.token_chunks(docs, []))
    assert total == 60 and set(words) == {"the", *(f"stone{c}bridge" for c in "abcdefghij")} and counts[lm.RARE :].sum() == 60 + lm.VOCABULARY - lm.RARE
    rare = lm.Spelling.of(spark.createDataFrame([(f"stone{c}bridge", 3) for c in "abcdefghij"], "word string, n long"), [])
    assert rare.cost("stonezbridge") < rare.cost("xqzkjvwpqxzk") - 10


def test_gradient_step_is_the_derivative_and_lowers_the_loss():
    rng = np.random.default_rng(1)
    tokens = np.zeros(3000 + 2 * lm.WINDOW, np.int32)
    tokens[lm.WINDOW : -lm.WINDOW] = rng.integers(lm.RARE, lm.RARE + 20, 3000)
    tokens[lm.WINDOW : -lm.WINDOW : 2] = tokens[lm.WINDOW + 1 : -lm.WINDOW : 2]
    tokens[500:503] = 0
    network = lm.WindowNetwork.initial(np.ones(lm.VOCABULARY))
    squares = [np.full_like(x, 1e-3) for x in network.parts()]
    loss = lambda net: -net.scorer().log_probabilities(tokens).sum() / np.count_nonzero(tokens[lm.WINDOW : -lm.WINDOW])
    before = loss(network)
    # the first step moves a weight by rate * g / sqrt(g^2 + 1e-3): so g can be read from it and held against differences
    stepped = lm.WindowNetwork.of(network.flat())
    stepped.step(tokens, [np.full_like(x, 1e-3) for x in stepped.parts()])
    for part in range(7):
        old, new = network.parts()[part].reshape(-1), stepped.parts()[part].reshape(-1)
        for at in np.argsort(-np.abs(new - old))[:3]:
            move = (old[at] - new[at]) / lm.RATE
            own = move * np.sqrt(1e-3 / (1 - move**2))
            shifted = [lm.WindowNetwork.of(network.flat()) for _ in range(2)]
            for net, d in zip(shifted, (1e-2, -1e-2), strict=True):
                net.parts()[part].reshape(-1)[at] += d
            assert own == pytest.approx((loss(shifted[0]) - loss(shifted[1])) / 2e-2, rel=0.1, abs=2e-4)
    for _ in range(30):
        network.step(tokens, squares)
    assert loss(network) < before - 1


def test_pseudo_likelihood_is_trained_on_every_position_once(spark, monkeypatch):
    trained, add = [], lm.summed_blocks
    monkeypatch.setattr(lm, "summed_blocks", lambda *args: trained.append(add(*args)) or trained[-1])
    docs = spark.createDataFrame([(i, " ".join(GOOD), "en", "s", 0) for i in range(60)], DOCS)
    lm.PseudoLikelihood.fit(docs, keep=["doc_id"])
    trained = [x for x in trained if len(x) != lm.CHARACTERS + 2]
    assert len(trained) == lm.ROUNDS and all(x[-1, 0] > 0 for x in trained)
    assert sum(x[-1, 0] for x in trained) == sum(len(lm.TOKEN.findall(w)) for w in GOOD) * 60


def test_pseudo_likelihood_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).choices(GOOD, k=30))) for i in range(300)], "doc_id long, text string")
    scores = []
    for parts in (1, 7):
        model, tokens = lm.PseudoLikelihood.fit(docs.repartition(parts), keep=["doc_id"], shard_tokens=2_000)
        scores.append([r.log_likelihood for r in model.score_tokens(tokens).orderBy("doc_id").collect()])
    assert np.allclose(*scores, rtol=1e-3)


def test_pseudo_likelihood_scores_are_the_plain_ones(spark):
    """Every conditional of every token by a softmax over the whole vocabulary, and each rare word letter by letter."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(GOOD, k=rng.randint(0, 25))) + (f" zq{i}x" if i % 3 else "")) for i in range(40)], "doc_id long, text string")
    model, _ = lm.PseudoLikelihood.fit(docs, epochs=2)
    known = {w: lm.RARE + i for i, w in enumerate(model.words)}
    net = model.network

    def spelled(word):
        total, before = 0.0, lm.CHARACTERS + 1
        for c in word:
            at = model.spelling.alphabet.find(c)
            at = lm.CHARACTERS if at < 0 else at
            total += float(model.spelling.chain[before, at]) - (math.log(lm.CODE_POINTS - len(model.spelling.alphabet)) if at == lm.CHARACTERS else 0)
            before = at
        return total + (math.log(1 - lm.LONGER) + (len(word) - lm.RARE + 1) * math.log(lm.LONGER) if len(word) >= lm.RARE - 1 else 0)

    def plain(text):
        words = [w.lower() for w in lm.TOKEN.findall(text)]
        ids = [0] * lm.WINDOW + [known.get(w, min(len(w), lm.RARE - 1)) for w in words] + [0] * lm.WINDOW
        total = 0.0
        for k, w in enumerate(words):
            at = k + lm.WINDOW
            h = np.tanh(net.bias + sum(net.embed[ids[at + d]] * net.place[j] for j, d in enumerate(lm.OFFSETS)))
            c = ids[at] // lm.PER_CLASS
            rows = slice(c * lm.PER_CLASS, (c + 1) * lm.PER_CLASS)
            for logits, own in ((net.klass @ h + net.klass_bias, c), (net.word[rows] @ h + net.word_bias[rows], ids[at] % lm.PER_CLASS)):
                total += float(logits[own] - np.log(np.exp(logits).sum()))
            total += spelled(w) if w not in known else 0.0
        return total

    texts = [(1, "The quiet river, runs past"), (2, "zq1x unseen wörds " + "l" * 45), (3, ""), (4, "stone " * 40)]
    rows = {r.doc_id: r for r in model.score(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, text in texts:
        assert rows[i].log_likelihood == pytest.approx(plain(text), rel=1e-4, abs=1e-4)
        assert rows[i].n_tokens == len(lm.TOKEN.findall(text))


def test_quality_scores_are_the_plain_ones(frames):
    docs, labels = frames
    model = quality.QualityClassifier.fit(docs, labels)
    net = model.network

    def plain(text):
        tokens = quality.TOKEN.findall(text or "")
        words = ["0" if t[0].isdigit() else t.lower() for t in tokens]
        n = max(1, len(words))
        x = np.zeros(quality.DIM + quality.RATES)
        buckets = [zlib.crc32(w.encode()) % quality.BUCKETS for w in words]
        if words:
            x[: quality.DIM] = np.mean([model.vectors[b] for b in buckets], axis=0)
            caps = [len(t) > 1 and t.isupper() for t in tokens]
            rates = [sum(t[0].isupper() and not c for t, c in zip(tokens, caps, strict=True)) / n, sum(caps) / n]
            rates += [sum(buckets[i] == buckets[i - d] for i in range(d, len(buckets))) / n for d in (1, 2, 3)]
            x[quality.DIM :] = [*rates, len(set(buckets)) / n, math.log1p(n) / 8]
        logit = np.tanh((x - net.mean) / net.scale @ net.w1 + net.b1) @ net.w2 + net.b2
        return 1 / (1 + math.exp(-max(-30, min(30, logit / net.temperature))))

    for r in model.score(docs).collect()[::5]:
        assert r.score == pytest.approx(plain(r.text), abs=1e-4)


def test_a_chunk_table_has_small_row_groups(spark, monkeypatch):
    # writers hold a row group, and readers decode a whole one: groups of a hundred chunks don't fit in an executor
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 100)
    chunks = lm.token_chunks(spark.createDataFrame([(i, f"word{i} " * 50) for i in range(40)], "doc_id long, text string").repartition(1), ["doc_id"])
    sizes = []
    for path in chunks.inputFiles():
        meta = pq.ParquetFile(urllib.parse.unquote(urllib.parse.urlparse(path).path)).metadata
        sizes += [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
    assert sum(sizes) == chunks.count() >= 20 and max(sizes) <= 2
