"""Leaks, matrices and near prompts against plain loops over all pairs."""

import difflib
import random

from corpusloom.operators import contamination as con
from corpusloom.operators import dedup

WORDS = [f"{a}{b}" for a in ("ri", "ho", "gre", "sea", "fi") for b in ("ver", "use", "en", "side", "ld", "ing")]


def texts(seed, n, low=4, high=30):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(low, high))) for _ in range(n)]


def jaccard(a, b):
    a, b = set(a.split()), set(b.split())
    return len(a & b) / len(a | b) if a and b else 0.0


def similarity(a, b):
    j = jaccard(a, b)
    return j if j < 0.35 else max(j, difflib.SequenceMatcher(None, a, b).ratio())


def longest(target, reference):
    words, best = target.split()[:120], 0
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            if f" {' '.join(words[i:j])} " in f" {reference} ":
                best = max(best, j - i)
    return best


def frame(spark, rows):
    return con.records(spark.createDataFrame(rows, "id long, text string"), "id", "text")


def test_matrix_pair_is_the_plain_one(spark):
    rng = random.Random(3)
    references = texts(1, 25)
    targets = texts(2, 10) + [references[0], references[1] + " extra", " ".join(references[2].split()[2:]), references[3].replace("river", "rivers"), "short one"]
    rng.shuffle(targets)
    n, best, exact, near = 4, [], 0, 0
    for t in targets:
        grams = {tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)}
        found = []
        for r in references:
            other = {tuple(r.split()[i : i + n]) for i in range(len(r.split()) - n + 1)}
            hit = len(t) >= 24 and f" {t} " in f" {r} "
            s = similarity(t, r) if min(len(t), len(r)) >= 24 else float(hit)
            found.append((hit, len(grams & other) / len(grams) if grams else 0.0, longest(t, r), s, not hit and len(t) >= 24 and s >= 0.86))
        exact += any(f[0] for f in found)
        near += any(f[4] for f in found)
        best.append(max(f[:4] for f in found))
    row = con.matrix_pair("p", frame(spark, list(enumerate(references))), frame(spark, list(enumerate(targets))), n).first()
    assert (row.exact_hits, row.near_hits) == (exact, near) and exact >= 1 and near >= 1
    assert abs(row.max_overlap_rate - max(b[1] for b in best)) < 1e-9 and row.max_longest == max(b[2] for b in best) and abs(row.max_similarity - max(b[3] for b in best)) < 1e-9
    none = frame(spark, [(0, "")])
    assert con.matrix_pair("p", none, none).first().risk == "not_checked"


def test_phrases_within_texts(spark):
    bodies = texts(4, 30, 6, 20)
    rng = random.Random(5)
    phrases = []
    for b in bodies:
        low = rng.randrange(0, len(b) - 20)
        phrases.append(b[low : low + rng.randint(8, 40)].strip())
    phrases += ["ver", "river house", "nothing like it here at all"]
    p, t = frame(spark, list(enumerate(phrases))), frame(spark, list(enumerate(bodies)))
    got = {(r.phrase_id, r.text_id) for r in con.within(p, t).collect()}
    assert got == {(i, j) for i, x in enumerate(phrases) for j, b in enumerate(bodies) if x in b}
    assert con.phrases_in(["green seaside", "absent words"], "a green seaside walk", spark) == ["green seaside"]


def test_near_prompts_are_those_of_all_pairs(spark):
    rng = random.Random(6)
    base = texts(7, 40, 3, 16)
    prompts = base + [f"{b} please" for b in base[:12]] + [b.replace("e", "a", 1) for b in base[12:24]] + [b.upper() for b in base[24:28]] + [f"what {b}" for b in base[:10]] + [f"what {b}s" for b in base[:10]]
    rng.shuffle(prompts)
    rows = list(enumerate(prompts))
    got = {(r.left_id, r.right_id): r.similarity for r in dedup.near_prompts(spark.createDataFrame(rows, "id long, user string"), "id").collect()}
    want = {}
    for i, a in rows:
        for j, b in rows:
            a, b = a.lower(), b.lower()
            if i < j and a != b and a.split()[0] == b.split()[0]:
                s = jaccard(a, b)
                s = s if s >= 0.9 else difflib.SequenceMatcher(None, a, b).ratio()
                if s >= 0.9:
                    want[i, j] = s
    assert got.keys() == want.keys() and len(want) > 10 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_pack_rows_meet_their_bucket_or_all(spark):
    base = "tell me about the old stone houses by the river"
    train = [(1, base, "they are old", "domain"), (2, "other words entirely", "the long answer is 12345678 here", "math")]
    evaluation = [(10, base + " please", "x", "domain"), (11, base + " now", "x", "gone"), (12, base + " again", "x", "math"), (13, "nothing alike", "is 12345678 here", "math"), (14, "nothing too", "is 12345678 here", "refusal"), (15, base, "y", None)]
    schema = "id long, user string, assistant string, bucket string"
    got = {(r.kind, r.eval_id, r.train_id) for r in con.pack_contamination(spark.createDataFrame(evaluation, schema), spark.createDataFrame(train, schema)).collect()}
    assert got == {("near_prompt", 10, 1), ("near_prompt", 11, 1), ("answer_in_train", 13, 2), ("exact_prompt", 15, 1)}


def test_nested_phrases_takes_any_number_of_short_ones(spark):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("ab1") for _ in range(rng.randint(1, 5)))
    texts = [" ".join(word() for _ in range(rng.choice([1, 1, 2, 2, 3, 6]))) for _ in range(1_500)]
    phrases = con.records(spark.createDataFrame(list(enumerate(texts)), "i long, t string"), "i", "t")
    found = spark.createDataFrame([(i,) for i in range(0, 1_500, 100)], "phrase_id long")
    hit = [texts[i] for i in range(0, 1_500, 100)]
    want = {i for i, t in enumerate(texts) if any(t in h for h in hit)}
    assert {r.phrase_id for r in con.nested_phrases(found, phrases).collect()} == want and 100 < len(want) < 1_500
    pairs = {(r.phrase_id, r.text_id) for r in con.within(phrases, phrases.where("id % 100 = 0")).collect()}
    assert pairs == {(i, j) for i, t in enumerate(texts) for j in range(0, 1_500, 100) if t in texts[j]}


def test_alike_pairs_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(con, "BLOCK_TEXTS", 15)
    left, right = texts(11, 40, 1, 12), texts(12, 60, 1, 40)
    right[:10] = [f"{x} more" for x in left[:10]]
    got = sorted(tuple(r) for r in con.alike_pairs(frame(spark, list(enumerate(left))), frame(spark, list(enumerate(right)))).collect())
    want = [(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if jaccard(a, b) >= 0.35]
    assert got == want and len(want) > 10
    assert con.alike_pairs(frame(spark, [(0, "")]), frame(spark, [(0, "a b")])).count() == 0


def test_best_matches_compare_few_texts(spark, monkeypatch):
    # pairs that only share frequent words made rows on every word before, and each its matching ratio in Python
    laid = []
    ratio = con.sequence_ratio
    monkeypatch.setattr(con, "sequence_ratio", lambda a, b: laid.append((a, b)) or ratio(a, b))
    base = texts(13, 30, 20, 30)
    chat, generated = frame(spark, list(enumerate(base))), frame(spark, [(i, f"{b} indeed") for i, b in enumerate(base[:10])])
    found = con.record_matches(chat, generated, runs=False).where("exact or near").collect()
    assert {(r.target_id, r.reference_id) for r in found if r.near} >= {(i, i) for i in range(10)}
    a, b = laid[0]
    assert "CASE WHEN" in str(a) and "CASE WHEN" in str(b)


def test_a_target_without_ngrams_has_the_longest_run_of_all_references(spark):
    shared = [f"w{i}" for i in range(60)]
    references = [" ".join(["common", "phrase", *shared[i : i + 30]]) for i in range(0, 30, 10)] + ["other common words stand here", "a common phrase that ends here alone"]
    target = "common phrase that " + " ".join(f"x{i}" for i in range(40))
    rows = con.record_matches(frame(spark, list(enumerate(references))), frame(spark, [(0, target)]), 8).collect()
    best = max((r.longest, r.similarity, r.reference_id) for r in rows)
    want = max((longest(target, r), similarity(target, r), i) for i, r in enumerate(references))
    assert best[0] == want[0] == 3 and best[2] == want[2] and abs(best[1] - want[1]) < 1e-9
