"""Secret scan with built-in expressions only: candidates by pattern, false positives out by a random forest.

Candidates are runs of key-like characters with a letter and a digit, values assigned to names like ``token`` or
``password``, well-known key formats and private key headers. Each gets features: length, transitions between
character classes, share of digits, capitals and distinct characters, coverage by dictionary words, and words of the path
and beside it: by patterns, and by the log odds with which the labelled findings have them beside secrets. A forest of CART trees is trained on the driver from labelled findings (a table with a label for
each; ``example_findings`` makes the default ones) and is turned into arrays of nodes, which one expression walks in
each row. So scan, features and forest are one projection: no shuffle, no join, no Python on the executors, and a row's result
depends on that row only.

Defined results: null and empty texts have no findings; each occurrence of a repeated secret is a finding; repeated
rows repeat their findings; texts and runs of any length are scanned whole; a null path has no path words; an empty table has no
findings. Splits of equal gain are decided by the first feature drawn. Extra columns play no part in a scan and pass through ``masked``;
added columns replace columns of the same name.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_NAMES = "(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key|client[_-]?secret)"
ASSIGNED = f"(?i:{KEY_NAMES})[\"']?\\s{{0,3}}[:=]{{1,2}}>?\\s{{0,3}}[\"']?"
RUN = "[A-Za-z0-9_+/=\\-]"
#: A candidate: header of a private key, web token, assigned value, or a run of 16 characters and more with a letter and a digit.
CANDIDATE = (
    "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
    "|eyJ[A-Za-z0-9_\\-]{10,}\\.[A-Za-z0-9_\\-]{10,}\\.[A-Za-z0-9_\\-]{5,}"
    f"|\\b{ASSIGNED}[^\\s\"',;<>]{{6,}}"
    f"|(?<!{RUN})(?=[A-Za-z_+/=\\-]*+[0-9])(?=[0-9_+/=\\-]*+[A-Za-z]){RUN}{{16,}}"
)
#: Prefix of an assigned value, with the name and the quote.
PREFIX = f"\\A{ASSIGNED}"
MASK = "[SECRET]"

#: Words that make a run of characters look like names, not keys.
DICTIONARY = ["about", "access", "account", "active", "admin", "after", "align", "array", "auto", "bar", "base", "before", "block", "body", "bool", "border", "bottom", "box", "build", "button", "call", "case", "center", "change", "char", "chart", "check", "class", "click", "client", "code", "color", "column", "com", "config", "content", "copy", "count", "create", "data", "date", "default", "delete", "dev", "display", "doc", "error", "event", "example", "field", "file", "filter", "find", "first", "flag", "float", "font", "form", "format", "from", "func", "get", "group", "handle", "header", "height", "home", "host", "http", "image", "index", "info", "init", "input", "int", "item", "key", "label", "last", "left", "level", "line", "link", "list", "load", "local", "log", "main", "make", "map", "max", "menu", "message", "min", "mode", "model", "module", "name", "net", "node", "null", "number", "object", "old", "option", "order", "org", "out", "page", "panel", "param", "parent", "path", "point", "post", "print", "query", "read", "request", "reset", "result", "return", "right", "root", "row", "save", "search", "select", "send", "server", "set", "size", "sort", "source", "start", "state", "status", "string", "style", "sum", "table", "tag", "test", "text", "time", "title", "top", "type", "update", "url", "user", "utils", "value", "version", "view", "web", "width", "word", "write"]
SECRET_WORDS = "(?i)pass|pwd|secret|token|key|auth|credential|bearer|login"
DIGEST_WORDS = "(?i)sha-?(?:1|256|512)|md5|checksum|commit|digest|integrity|revision|hash|uuid|guid|etag|build|blob"
PLACEHOLDER = "(?i)your|xxx|change|example|sample|dummy|placeholder|test|todo|fake|redacted|secret|password|token|\\$\\{|%s|\\*\\*\\*|1234|abcd"
TEST_PATHS = "(?i)test|example|sample|mock|fixture|doc|readme|\\.md\\b"
DATA_PATHS = "(?i)\\.lock|\\.sum|\\.min\\.|\\.svg|\\.map\\b|vendor|node_modules"
KNOWN = "\\A(?:AKIA|ASIA|ghp_|gho_|ghs_|sk-|sk_live_|xox[abp]-|AIza|eyJ|glpat-|-----BEGIN)"

FEATURES = 20
#: Words whose weight is learned from the findings, at most, of each place.
MAX_TOLD = 400


Told = dict[str, dict[str, float]]


def told_words(rows: list, places: tuple[str, ...] = ("left", "right", "path")) -> Told:
    """For each place, the log odds with which its words stand beside secrets, from labelled findings, two standard errors nearer to 0.

    Words whose odds may be even are left out; the most frequent are taken, then by code point.
    """
    out: Told = {}
    for place in places:
        seen: dict[str, list[int]] = {}
        for row in rows:
            for word in set(re.findall("[a-z]+", (row[place] or "").lower())):
                seen.setdefault(word, [0, 0])[row["label"]] += 1
        most = sorted(seen, key=lambda w: (-sum(seen[w]), w))[:MAX_TOLD]
        odds = {w: (math.log((seen[w][1] + 0.5) / (seen[w][0] + 0.5)), 2 * math.sqrt(1 / (seen[w][1] + 0.5) + 1 / (seen[w][0] + 0.5))) for w in most}
        out[place] = {w: math.copysign(abs(x) - error, x) for w, (x, error) in odds.items() if abs(x) > error}
    return out


def _weight(of: Column, told: dict[str, float]) -> Column:
    """Sum of the learned weights of a text's words."""
    if not told:
        return F.lit(0.0)
    known = F.create_map(*[F.lit(x) for pair in told.items() for x in pair])
    return F.aggregate(F.split(F.lower(F.coalesce(of, F.lit(""))), "[^a-z]+"), F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at(known, w), F.lit(0.0)))


def candidates(text: Column, path: Column, told: Told) -> Column:
    """Array of structs, in text order: the candidate's start (code points from 0), prefix, value and features."""
    text = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), 0)
    gaps = F.split(text, CANDIDATE, -1)
    paired = F.transform(F.arrays_zip(found.alias("c"), F.slice(gaps, 1, F.greatest(F.lit(0), F.size(gaps) - 1)).alias("l"), F.slice(gaps, 2, F.greatest(F.lit(0), F.size(gaps) - 1)).alias("r")), lambda x: F.struct(x["c"].alias("c"), x["l"].alias("l"), x["r"].alias("r"), F.regexp_extract(x["c"], PREFIX, 0).alias("p")))
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<start:int,prefix:string,value:string,left:string,right:string>>").alias("out"))

    def add(state: Column, x: Column) -> Column:
        start = state["n"] + F.length(x["l"]) + F.length(x["p"])
        one = F.struct(start.cast("int").alias("start"), x["p"].alias("prefix"), F.substring(x["c"], F.length(x["p"]) + 1, F.length(x["c"])).alias("value"), F.concat(F.substring(x["l"], -40, 40), x["p"]).alias("left"), F.substring(x["r"], 1, 20).alias("right"))
        return F.struct((state["n"] + F.length(x["l"]) + F.length(x["c"])).alias("n"), F.concat(state["out"], F.array(one)).alias("out"))

    placed = F.aggregate(paired, zero, add, lambda s: s["out"])
    return F.transform(placed, lambda x: F.struct(x["start"].alias("start"), x["prefix"].alias("prefix"), x["value"].alias("value"), features(x["value"], x["left"], x["right"], path, told).alias("x")))


def features(value: Column, left: Column, right: Column, path: Column, told: Told) -> Column:
    """Array of ``FEATURES`` doubles."""
    n = F.greatest(F.lit(1), F.length(value))

    def count(pattern: str, of: Column = value) -> Column:
        return F.regexp_count(of, F.lit(pattern)).cast("double")

    def flag(of: Column, pattern: str) -> Column:
        return F.coalesce(of, F.lit("")).rlike(pattern).cast("double")

    runs = count("[a-z]+") + count("[A-Z]+") + count("[0-9]+") + count("[^A-Za-z0-9]+")
    letters = F.greatest(F.lit(1), F.length(F.regexp_replace(value, "[^A-Za-z]+", "")))
    uncovered = F.length(F.regexp_replace(F.regexp_replace(F.lower(value), "(?:" + "|".join(DICTIONARY) + ")", ""), "[^a-z]+", ""))
    return F.array(
        n.cast("double"),
        (runs - 1) / n,
        count("[0-9]") / n,
        count("[A-Z]") / n,
        count("[^A-Za-z0-9]") / n,
        F.size(F.array_distinct(F.split(value, ""))).cast("double") / n,
        (F.lit(1.0) - uncovered / letters),
        flag(value, "\\A[0-9a-f]+\\z"),
        flag(value, PLACEHOLDER),
        flag(value, KNOWN),
        flag(left, SECRET_WORDS),
        flag(left, DIGEST_WORDS),
        flag(left, "[:=]\\s{0,3}[\"']?\\z"),
        flag(right, "\\A[\"']"),
        flag(path, TEST_PATHS),
        flag(path, DATA_PATHS),
        flag(value, "[a-z]{5,}|[A-Z]{5,}"),
        _weight(left, told.get("left", {})),
        _weight(right, told.get("right", {})),
        _weight(path, told.get("path", {})),
    )


@dataclass
class Forest:
    """All trees' nodes one after another; ``feature`` is -1 at leaves."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def probability(self, x: Column) -> Column:
        """Mean of the leaves that the feature array ``x`` falls in, as an expression."""
        feature, threshold, left, right, value = (F.lit(a) for a in (self.feature, self.threshold, self.left, self.right, self.value))

        def at(array: Column, i: Column) -> Column:
            return F.element_at(array, i + 1)

        def step(n: Column, _: Column) -> Column:
            f = at(feature, n)
            return F.when(f < 0, n).when(at(x, F.greatest(f, F.lit(0))) <= at(threshold, n), at(left, n)).otherwise(at(right, n))

        def walk(root: Column) -> Column:
            return at(value, F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), root, step))

        return F.aggregate(F.lit(self.roots), F.lit(0.0), lambda s, root: s + walk(root)) / len(self.roots)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The same on the driver, for tests and reports."""
        out = np.zeros(len(x))
        for root in self.roots:
            n = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[n]
                go = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= self.threshold[n], self.left[n], self.right[n])
                n = np.where(f < 0, n, go)
            out += self.value[n]
        return out / len(self.roots)


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 7, seed: int = 11) -> Forest:
    """CART trees on bootstrap samples, each split over a random half of the features, by Gini impurity."""
    rng = np.random.default_rng(seed)
    nodes: list[list] = []
    roots = []

    def grow(at: np.ndarray, left_depth: int) -> int:
        node = len(nodes)
        share = float(y[at].mean()) if len(at) else 0.0
        nodes.append([-1, 0.0, 0, 0, share])
        if left_depth == 0 or len(at) < 4 or share in (0.0, 1.0):
            return node
        best = (1e-12, -1, 0.0)
        for f in rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False):
            order = at[np.argsort(x[at, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            n_left, n_right = cut + 1.0, len(at) - cut - 1.0
            a, b = ones[cut], ones[-1] - ones[cut]
            impurity = 2 * (a * (n_left - a) / n_left + b * (n_right - b) / n_right) / len(at)
            gain = 2 * share * (1 - share) - impurity
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), int(f), float((v[cut[i]] + v[cut[i] + 1]) / 2))
        if best[1] < 0:
            return node
        side = x[at, best[1]] <= best[2]
        low, high = grow(at[side], left_depth - 1), grow(at[~side], left_depth - 1)
        nodes[node] = [best[1], best[2], low, high, share]
        return node

    for _ in range(trees):
        roots.append(grow(rng.integers(0, len(y), len(y)), depth))
    columns = list(zip(*nodes, strict=True))
    return Forest(np.array(roots, np.int32), np.array(columns[0], np.int32), np.array(columns[1], np.float64), np.array(columns[2], np.int32), np.array(columns[3], np.int32), np.array(columns[4], np.float64), depth)


def example_findings(n: int = 2_400, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings (value, left, right, path, label): keys in the ways they leak, and look-alikes that are none."""
    rng = random.Random(seed)
    hexa, alnum, b64 = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    pick = lambda chars, low, high: "".join(rng.choice(chars) for _ in range(rng.randint(low, high)))
    words = lambda k: [rng.choice(DICTIONARY) for _ in range(k)]
    syllables = ["th", "er", "on", "an", "re", "ti", "es", "st", "ing", "ble", "ou", "ea", "ha", "nd", "le", "en", "de", "ie", "ch", "au"]
    invented = lambda k: "".join(rng.choice(syllables) for _ in range(k))
    prose = lambda: " ".join([*words(2), *(invented(rng.randint(1, 4)) for _ in range(3))])
    quote = lambda: rng.choice(['"', "'", ""])
    code_paths = ["src/app.py", "config/settings.yml", ".env", "deploy/prod.tf", "main.go", "web", "src0", "crawl", ""]
    other_paths = ["tests/test_login.py", "docs/readme.md", "package.lock", "go.sum", "assets/app.min.js", "examples/demo.py"]
    names = ["token", "password", "secret", "api_key", "apiKey", "access_key", "auth", "client_secret", "passwd", "AUTH_TOKEN"]
    out = []
    for i in range(n):
        path = rng.choice(code_paths if rng.random() < 0.8 else other_paths)
        if i % 2 == 0:
            q = quote()
            value = rng.choice([lambda: pick(hexa, 32, 64), lambda: pick(alnum, 20, 48), lambda: pick(b64, 24, 64), lambda: "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 16), lambda: "ghp_" + pick(alnum, 36, 36), lambda: "sk-" + pick(alnum, 32, 48), lambda: pick(alnum + "!@#$%^&*", 10, 16), lambda: pick(hexa, 40, 40)])()
            bare = value.startswith(("AKIA", "ghp_", "sk-")) and rng.random() < 0.4
            out.append((value, prose() + " " if bare else f"{prose()} {rng.choice(names)}{rng.choice([' = ', '=', ': ', ' := '])}{q}", (q if not bare else " ") + " " + prose(), path, 1))
            continue
        kind = rng.randrange(8)
        if kind == 0:
            value, left, right = pick(hexa, 40, 40), rng.choice(["commit ", "sha1: ", "revision ", "blob ", "checksum = "]), " " + prose()
        elif kind == 1:
            value, left, right = pick(hexa, 64, 64), rng.choice(["sha256: ", "digest: ", "integrity ", "hash = "]), "\n"
        elif kind == 2:
            value, left, right = "-".join(pick(hexa, k, k) for k in (8, 4, 4, 4, 12)), rng.choice(["uuid = ", "id: ", "guid ", prose() + " "]), " "
        elif kind == 3:
            value, left, right = rng.choice(["_", "-", ""]).join([*words(rng.randint(2, 4)), str(rng.randint(0, 99))]), prose() + " ", " " + prose()
        elif kind == 4:
            q = quote()
            value, left, right = rng.choice(["your_token_here1", "changeme123", "example-key-0000", "${SECRET_TOKEN}", "xxxxxxxxxxxxxxxx1", "<password>", "test_password_1", "dummy-secret-value"]), f"{rng.choice(names)} = {q}", q
        elif kind == 5:
            value, left, right = rng.choice([invented(6) + str(rng.randint(0, 99)), f"{rng.randint(1, 99)}-{invented(5)}-{invented(3)}", f"{invented(3)}_{invented(4)}{rng.randint(1, 9)}"]), prose() + " ", " " + prose()
        elif kind == 6:
            value, left, right = rng.choice([invented(rng.randint(3, 6)), rng.choice(words(1)), "".join(w.title() for w in words(2)), f"get_{rng.choice(words(1))}()"]), f"{rng.choice(names)}{rng.choice([' = ', ': '])}", " " + prose()
        else:
            value, left, right = rng.choice(["/".join([*words(3), "v2"]), "data/image/" + "/".join(words(2)) + "3", "2024-01-02T03-04-05Z", "=" * 14 + "a1", "aaaaaaaaaaaaaaa1"]), prose() + " ", " "
        out.append((value, left, right, path, 0))
    return out


def findings_table(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(example_findings() if rows is None else rows, "value string, left string, right string, path string, label int")


@dataclass
class SecretScanner:
    forest: Forest
    told: Told
    threshold: float = 0.5

    @classmethod
    def fit(cls, findings: DataFrame, limit: int = 20_000, threshold: float = 0.5) -> SecretScanner:
        """From ``findings(value, left, right, path, label)``; the first ``limit`` by a hash of the value, if there are more."""
        usable = findings.where(F.col("value").isNotNull() & F.col("label").isNotNull()).orderBy(F.xxhash64("value", "left"), "value", "left", "label").limit(limit)
        blank = lambda c: F.coalesce(F.col(c), F.lit(""))
        told = told_words(usable.select("left", "right", "path", "label").collect())
        rows = usable.select(features(F.col("value"), blank("left"), blank("right"), F.col("path"), told).alias("x"), "label").collect()
        if not rows:
            raise ValueError("no labelled findings")
        return cls(fit_forest(np.array([r.x for r in rows], np.float64), np.array([r.label for r in rows], np.float64)), told, threshold)

    def judged(self, text: Column, path: Column) -> Column:
        """Array of candidates with ``start, prefix, value, probability, secret``."""

        def judge(x: Column) -> Column:
            return F.struct(x["start"].alias("start"), x["prefix"].alias("prefix"), x["value"].alias("value"), self.forest.probability(x["x"]).alias("probability"))

        return F.transform(F.transform(candidates(text, path, self.told), judge), lambda x: x.withField("secret", x["probability"] >= self.threshold))

    def scan(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", rejected: bool = False) -> DataFrame:
        """One row for each secret (with ``rejected``: each candidate): id, start, value, probability, secret."""
        text, path = F.col(text_col), F.col(path_col) if path_col in docs.columns else F.lit(None).cast("string")
        found = docs.where(text.rlike(CANDIDATE)).select(F.col(id_col).alias("doc_id"), F.inline(self.judged(text, path)))
        return (found if rejected else found.where("secret")).select("doc_id", "start", "value", "probability", "secret")

    def masked(self, docs: DataFrame, text_col: str = "text", path_col: str = "source", mask: str = MASK) -> DataFrame:
        """``docs`` with each secret's value replaced by ``mask``; ``n_chars``, if there, follows."""
        text, path = F.col(text_col), F.col(path_col) if path_col in docs.columns else F.lit(None).cast("string")
        zero = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
        secrets = F.filter(self.judged(text, path), lambda x: x["secret"])

        def put(state: Column, x: Column) -> Column:
            return F.struct((x["start"] + F.length(x["value"]) + 1).alias("at"), F.concat(state["out"], F.substring(text, state["at"], x["start"] + 1 - state["at"]), F.lit(mask)).alias("out"))

        clean = F.aggregate(secrets, zero, put, lambda s: F.concat(s["out"], F.substring(text, s["at"], F.length(text))))
        out = docs.withColumn(text_col, F.when(text.rlike(CANDIDATE), clean).otherwise(text))
        return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
