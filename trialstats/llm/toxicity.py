"""Toxicity by a lexicon trie that Levenshtein automata walk, with context windows around each hit.

Learning (labels of rows that are not held out, a bounded sample of ``FIT_TOXIC`` and ``FIT_CLEAN`` of them):
words and word prefixes are counted by the documents of each class that hold them; those far more frequent in toxic
documents (log-likelihood ratio, odds) become the lexicon, as whole words or, where a prefix says as much as all its
continuations, as stems. Then a logistic model is fitted to the document features below.

Scoring: each distinct word of a task is looked up once. The trie gives exact words and stems; misspelled words are
found by intersecting the word's Levenshtein automaton (one edit for lexicon words of five letters or more, two from
nine) with the trie. A word is only tried if it shares a part of a term that the edits must leave untouched.
Around each hit a window of the text tells quotation (quote marks, words of reporting) from direct abuse (address),
and hits are summed separately as direct and as quoted.

Cases: null and empty texts have no hits and get the score of a text without hits; a missing label never teaches;
without labelled rows of both classes the score is 0; repeated rows are scored row by row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.llm.common import held_out, table
from trialstats.llm.neardup import WordHashes, shingles
from trialstats.session import cut

#: labelled rows that the model is fitted on, at most
FIT_TOXIC, FIT_CLEAN = 3000, 6000
#: terms of the lexicon, at most; the strongest are kept
TERMS = 20_000
LEAST_TOXIC, LEAST_RATIO, LEAST_SUPPORT = 3, 18.0, 30.0
PREFIXES = range(3, 9)
THRESHOLD = 0.7
#: characters on each side of a hit
CONTEXT = 60
RIDGE = 0.05
WORD_CACHE = 1 << 20
_TOKEN = re.compile(r"\w+(?:[@$!*]\w+)*")
_QUOTES = re.compile("[\"“”„«»‘’]|(?<!\\w)'|'(?!\\w)")
_REPORT = frozenset("said says say quote quoted quotes wrote writes called word term means example phrase insult".split())
_ADDRESS = frozenset("you your yours youre u ur".split())


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def stems(word: str) -> Iterator[str]:
    for k in PREFIXES:
        if k < len(word):
            yield word[:k] + "*"


class Automaton:
    """States of a Levenshtein automaton for one word: pairs of position and edits spent."""

    def __init__(self, word: str, edits: int):
        self.word, self.edits = word, edits

    def start(self) -> frozenset:
        return frozenset({(0, 0)})

    def step(self, state: frozenset, c: str) -> frozenset:
        out = set()
        for i, e in state:
            for skip in range(self.edits - e + 1):
                if i + skip < len(self.word) and self.word[i + skip] == c:
                    out.add((i + skip + 1, e + skip))
            if e < self.edits:
                out.add((i, e + 1))
                if i < len(self.word):
                    out.add((i + 1, e + 1))
        return frozenset(out)

    def distance(self, state: frozenset) -> int | None:
        return min((e + len(self.word) - i for i, e in state if e + len(self.word) - i <= self.edits), default=None)


def edits_for(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """Trie of weighted terms; a stem (``abc*``) matches every longer word that begins with it."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.trie = weights, {}
        self.heads: dict[int, set] = {}
        self.tails: dict[int, set] = {}
        self.middles: dict[int, set] = {}
        for term in weights:
            node = self.trie
            for c in term.rstrip("*"):
                node = node.setdefault(c, {})
            node["*" if term.endswith("*") else ""] = term
            if not term.endswith("*") and (k := edits_for(term)):
                cuts = [len(term) * j // (k + 1) for j in range(k + 2)]
                for j in range(k + 1):
                    part = term[cuts[j] : cuts[j + 1]]
                    by = self.heads if j == 0 else self.tails if j == k else self.middles
                    by.setdefault(len(part), set()).add(part)
        self.found: dict[str, tuple | None] = {}

    def lookup(self, word: str) -> tuple[str, float, int] | None:
        """Term, weight and edits of the best match."""
        node = self.trie
        best = None
        for k, c in enumerate(word, 1):
            node = node.get(c)
            if node is None:
                break
            if "*" in node and k < len(word):
                best = node["*"]
        else:
            best = node.get("", best)
        if best is not None:
            return best, self.weights[best], 0
        return self._misspelled(word) if self._may_be_near(word) else None

    def _may_be_near(self, word: str) -> bool:
        return (
            any(word[:k] in s for k, s in self.heads.items())
            or any(word[-k:] in s for k, s in self.tails.items())
            or any(word[i : i + k] in s for k, s in self.middles.items() for i in range(1, len(word) - k + 1))
        )

    def _misspelled(self, word: str) -> tuple[str, float, int] | None:
        automaton = Automaton(word, 2)
        best, open_ = None, [(self.trie, automaton.start())]
        while open_:
            node, state = open_.pop()
            term = node.get("")
            if term is not None:
                d = automaton.distance(state)
                if d is not None and d <= edits_for(term) and (best is None or (d, -self.weights[term]) < (best[2], -best[1])):
                    best = term, self.weights[term], d
            for c, child in node.items():
                if len(c) == 1 and c != "*" and (after := automaton.step(state, c)):
                    open_.append((child, after))
        return best

    def __getitem__(self, word: str) -> tuple | None:
        try:
            return self.found[word]
        except KeyError:
            if len(self.found) >= WORD_CACHE:
                self.found.clear()
            self.found[word] = out = self.lookup(word)
            return out


def directness(text: str, start: int, end: int) -> float:
    """1 for abuse, towards 0 for a quoted or reported word."""
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    before = before[before.rfind("\n") + 1 :]
    after = after.split("\n", 1)[0]
    out = 1.0
    if len(_QUOTES.findall(before)) % 2 and _QUOTES.search(after):
        out -= 0.6
    near = set(_TOKEN.findall((before[-40:] + " " + after[:25]).lower()))
    out -= 0.3 * bool(near & _REPORT)
    out += 0.2 * bool(near & _ADDRESS)
    return min(1.0, max(0.0, out))


N_FEATURES = 7


def features(text: str, lexicon: Lexicon) -> list[float]:
    found = tokens(text)
    hits = [(k, h) for k, h in enumerate(map(lexicon.__getitem__, found)) if h]
    if not hits:
        return [0.0] * N_FEATURES
    lower, direct, quoted, fuzzy, terms, strongest = text.lower(), 0.0, 0.0, 0, set(), 0.0
    spans = [m.span() for m in _TOKEN.finditer(lower)]
    for k, (term, weight, edits) in hits:
        share = directness(lower, *spans[k])
        if edits:
            fuzzy += 1
        else:
            direct += share
            quoted += 1 - share
            terms.add(term)
            strongest = max(strongest, weight * share)
    return [float(direct >= 0.5), math.log1p(direct), math.log1p(quoted), math.log1p(fuzzy), math.log1p(len(terms)),
            strongest, math.log1p(100 * direct / len(found))]


def _evidence(pos: int, neg: int, n_pos: int, n_neg: int) -> tuple[float, float]:
    """Log-likelihood ratio against equal rates, and log odds."""
    def part(k, n, p):
        return k * math.log(p) + (n - k) * math.log(1 - p) if 0 < p < 1 else 0.0

    both = (pos + neg) / (n_pos + n_neg)
    g2 = 2 * (part(pos, n_pos, pos / n_pos) + part(neg, n_neg, neg / n_neg) - part(pos, n_pos, both) - part(neg, n_neg, both))
    return g2, math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))


def choose_terms(counts: list[tuple[str, int, int]], n_pos: int, n_neg: int) -> dict[str, float]:
    """Lexicon of strong tokens: of a prefix and its continuations, the longest of the same support stands for all."""
    strong = {}
    for token, pos, neg in counts:
        g2, odds = _evidence(pos, neg, n_pos, n_neg)
        if pos / n_pos > neg / n_neg and g2 >= LEAST_RATIO and odds >= math.log(LEAST_SUPPORT):
            strong[token] = (pos, odds)
    below: dict[str, list[str]] = {}
    for token in strong:
        bare = token.rstrip("*")
        for k in range(1, len(bare) + 1):
            below.setdefault(bare[:k], []).append(token)
    out: dict[str, float] = {}
    for token in sorted(strong, key=lambda t: (len(t), t)):
        bare = token.rstrip("*")
        if any(bare[:k] + "*" in out for k in range(1, len(bare))):
            continue
        pos, odds = strong[token]
        if token.endswith("*"):
            if any(strong[t][0] >= 0.6 * pos and strong[t][1] >= odds for t in below[bare] if t != token):
                continue  # a longer stem or the word itself says as much
        out[token] = odds
    return out


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-penalized logistic coefficients, the intercept last."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.diag([RIDGE] * (x.shape[1] - 1) + [1e-6])
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out():
        keys = list(counts[0].keys() | counts[1].keys())
        got = pa.RecordBatch.from_arrays([
            pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()),
            pa.array([counts[0][k] for k in keys], pa.int64())], ["token", "pos", "neg"])
        counts[0].clear()
        counts[1].clear()
        return got

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            own = set(tokens(text.as_py() or ""))
            own.update([s for w in own for s in stems(w)])
            counts[toxic].update(own)
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield out()
    yield out()


@F.arrow_udf(T.LongType())
def least_shingle(texts: pa.Array) -> pa.Array:
    """Least shingle hash of each text: equal for most near copies."""
    hashes = WordHashes()
    sets = [shingles((t.as_py() or "").encode("utf-8", "replace"), hashes) for t in texts]
    return pa.array([int(s[0] >> np.uint64(1)) if len(s) else None for s in sets], pa.int64())


def _feature_column(shared):
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon = Lexicon(shared.value)
        for texts in batches:
            yield pa.array([features(t.as_py() or "", lexicon) for t in texts], pa.list_(pa.float64()))

    return column


def fit(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], np.ndarray | None]:
    """Lexicon and logistic coefficients (None without rows of both classes)."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(
        F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    mixed = F.xxhash64("doc_id")
    chosen = known.where("toxic = 1").orderBy(mixed, "doc_id").limit(FIT_TOXIC).unionAll(
        known.where("toxic = 0").orderBy(mixed, "doc_id").limit(FIT_CLEAN))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # FIT_TOXIC + FIT_CLEAN rows at most
    rows = rows.withColumn("_least", least_shingle("text")).dropDuplicates(["toxic", "_least"])  # copies teach once
    rows = cut(rows.select("text", "toxic"))
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not (size.get(0) and size.get(1)):
        return {}, None
    counts = rows.mapInArrow(_count_tokens, "token string, pos long, neg long").groupBy("token").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ahead = F.col("pos") / size[1] - F.col("neg") / size[0]
    counts = counts.where((F.col("pos") >= LEAST_TOXIC) & (F.col("pos") / size[1] > LEAST_SUPPORT / 2 * F.col("neg") / size[0]))
    best = counts.orderBy(ahead.desc(), "token").limit(TERMS).collect()
    terms = choose_terms([(r.token, r.pos, r.neg) for r in best], size[1], size[0])
    column = _feature_column(docs.sparkSession.sparkContext.broadcast(terms))
    got = rows.select("toxic", column("text").alias("x")).collect()  # short vectors of the bounded sample
    return terms, logistic(np.array([r.x for r in got]), np.array([float(r.toxic) for r in got]))


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text") -> Column:
    """Score column of ``docs`` from 0 to 1, learned from ``docs`` and ``labels``."""
    terms, beta = fit(docs, labels)
    if beta is None:
        return F.lit(0.0)
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    beta = beta.tolist()

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon, b = Lexicon(shared.value), np.array(beta)
        for texts in batches:
            x = np.array([features(t.as_py() or "", lexicon) for t in texts]).reshape(len(texts), N_FEATURES)
            yield pa.array(1 / (1 + np.exp(-np.clip(x @ b[:-1] + b[-1], -30, 30))), pa.float64())

    return score(docs[text])


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = toxicity(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
