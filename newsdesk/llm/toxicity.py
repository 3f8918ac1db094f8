"""Toxicity scores from a learned lexicon, matched with misspellings and in context (operator 4).

The lexicon's terms come from labelled rows.  They form a trie, which is
intersected with Levenshtein automata: a state is the set of (trie node, errors
so far) that a prefix of a word allows, made deterministic when first needed, so
that a word costs one look-up a character and most words die after a few.  Hits
are weighed by a window of words and signs around them: inside quotation marks or
beside a word of reporting they count apart from hits that address somebody.  A
logistic model joins these sums to a score.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_FOLD, folded_words, free_name, map_batches, staged, table, tidy, utf8, window_hashes
from .substring_dedup import _Words

#: Labelled rows that a model is fitted on at most: those with the smallest hash of doc_id.
SAMPLE = 20_000
#: Log likelihood by which a term's record must beat chance.
EVIDENCE = 7.5
#: Clean documents for each toxic one that a term may have at most.
CLEAN_SHARE = 0.2
#: Characters of a prefix term.
PREFIXES = (4, 5, 6, 7)
#: Score from which a document counts as toxic.
THRESHOLD = 0.3
#: Words on each side that make a hit's context.
CONTEXT = 6
#: Words with known answers, and states of the automaton, that a task keeps; both begin anew when full.
KNOWN, STATES = 300_000, 100_000

#: Words of reporting and of address in the languages of the corpus.
REPORTING = frozenset(b"said says wrote quoted quote called writes dijo escribi\xc3\xb3 dit \xc3\xa9crit sagte schrieb zitierte".split())
ADDRESS = frozenset("you your youre u ur du dich dein ihr tu toi vous te usted eres".encode().split())
#: Whole marks: a class of bytes would find parts of letters.
_QUOTES = re.compile('"|“|”|«|»|„'.encode())


def _cut(text: bytes | None) -> list[bytes]:
    """Folded words of a text, quotation marks being no part of them."""
    return folded_words(_QUOTES.sub(b" ", text)) if text else []


def _errors(length: int) -> int:
    """Errors that a term of so many characters may hold."""
    return 0 if length < 5 else 1 if length < 9 else 2


class LexiconAutomaton:
    """The union of the Levenshtein automata of all terms, as a lazily determinised automaton over their trie.

    A term that ends in ``*`` stands for all words with that prefix, without errors.
    """

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.prefix: list[str | None] = [None]
        self.reach: list[int] = [0]  # the most errors that a term below a node allows
        for t in sorted(terms):
            self._add(t)
        self._begin()

    def _begin(self) -> None:
        """Without any state but the first."""
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[int, str] | None] = []
        self.start = self._state(self._closed({(0, 0)}))

    def _add(self, term: str) -> None:
        word, wild = (term[:-1], True) if term.endswith("*") else (term, False)
        node, most = 0, 0 if wild else _errors(len(word))
        self.reach[0] = max(self.reach[0], most)
        for c in word:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.term.append(None)
                self.prefix.append(None)
                self.reach.append(0)
            node = self.children[node][c]
            self.reach[node] = max(self.reach[node], most)
        (self.prefix if wild else self.term)[node] = term

    def _closed(self, states: set[tuple[int, int]]) -> frozenset:
        """With the states that a missing character leads to; of a node only its fewest errors."""
        best: dict[int, int] = {}
        todo = sorted(states, key=lambda s: s[1])
        while todo:
            node, e = todo.pop(0)
            if e > self.reach[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            if e < self.reach[node]:
                todo += [(child, e + 1) for child in self.children[node].values()]
        return frozenset(best.items())

    def _state(self, states: frozenset) -> int:
        if states not in self.states:
            self.states[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
            found = [(e, self.term[n]) for n, e in states if self.term[n] is not None and e <= _errors(len(self.term[n]))]
            self.ends.append(min(found, default=None))
        return self.states[states]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            if c in self.children[node]:
                out.add((self.children[node][c], e))
            if e < self.reach[node]:
                out.add((node, e + 1))
                out |= {(child, e + 1) for child in self.children[node].values()}
        closed = self._closed(out)
        self.moves[state][c] = to = self._state(closed) if closed else -1
        return to

    def match(self, word: str) -> tuple[int, str] | None:
        """(errors, term) of the nearest term, exact before prefix before misspelt; None without one."""
        if len(self.sets) > STATES:
            self._begin()
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                break
        end = self.ends[state] if state >= 0 else None
        if end and end[0] == 0:
            return end
        node = 0
        for c in word:
            node = self.children[node].get(c)
            if node is None:
                break
            if self.prefix[node] is not None:
                return 0, self.prefix[node]
        return end


class Scorer:
    """Features and scores of texts, for a lexicon of weights and the words that only look like its terms."""

    def __init__(self, weights: dict[str, float], innocent: frozenset[str] = frozenset(), model: np.ndarray | None = None):
        self.weights, self.innocent, self.model = weights, innocent, model
        self.automaton = LexiconAutomaton(list(weights))
        self.known: dict[bytes, tuple[int, str] | None] = {}

    def hit(self, word: bytes) -> tuple[int, str] | None:
        if word in self.known:
            return self.known[word]
        if len(self.known) >= KNOWN:
            self.known.clear()
        text = word.decode("utf-8", "replace")
        found = self.automaton.match(text)
        self.known[word] = found = None if found and found[0] and text in self.innocent else found
        return found

    def features(self, text: bytes | None) -> np.ndarray:
        """Plain, misspelt, quoted and addressed hits by weight, distinct terms, and the share of hit words."""
        out = np.zeros(7)
        words = _cut(text)
        hit, known = self.hit, self.known
        hits = [(i, h) for i, w in enumerate(words) if (h := known[w] if w in known else hit(w))]
        if not hits:
            return out
        quoted = self._quoted(text, len(words))
        terms = set()
        for i, (errors, term) in hits:
            near = words[max(0, i - CONTEXT) : i + CONTEXT + 1]
            weight = max(self.weights[term], 0.0)
            terms.add(term)
            if quoted[i] or not REPORTING.isdisjoint(near):
                out[2] += weight
            else:
                out[1 if errors else 0] += weight
                out[3] += weight * (not ADDRESS.isdisjoint(near))
        out[4] = len(terms)
        out[5] = max(self.weights[t] for t in terms)
        out[:5] = np.log1p(out[:5])
        out[6] = min(1.0, 20 * len(hits) / len(words))
        return out

    @staticmethod
    def _quoted(text: bytes, n: int) -> np.ndarray:
        """For each word whether an odd number of quotation marks of its line precede it, the line closing them."""
        out = np.zeros(n, dtype=bool)
        if not _QUOTES.search(text):
            return out
        i = 0
        for line in text.split(b"\n"):
            parts = _QUOTES.split(line)
            for k, part in enumerate(parts):
                m = len(part.translate(ALNUM_FOLD).split())
                out[i : i + m] = k % 2 == 1 and k < len(parts) - 1
                i += m
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.model is None:
            return np.zeros(len(features))
        z = features @ self.model[1:] + self.model[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray | None:
    """Intercept and weights of a ridge-penalised logistic model by Newton steps; None unless both labels occur."""
    if len(y) == 0 or y.min() == y.max():
        return None
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + len(y) * 1e-6 * np.eye(len(w)) + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _terms(text: bytes | None) -> set[str]:
    """Words of a text and prefix terms of the longer ones."""
    words = {w.decode("utf-8", "replace") for w in set(_cut(text))}
    return words | {f"{w[:n]}*" for w in words for n in PREFIXES if len(w) > n}


def _signature(text: bytes | None, words: _Words) -> int:
    """The least hash of three words in a row: copies of a text mostly share it, other texts hardly."""
    w = _cut(text)
    return int(window_hashes(words.of(w), min(3, len(w))).min() >> np.uint64(1)) if w else 0


def _counts(sample: DataFrame) -> DataFrame:
    """(term, bad0, good0, bad1, good1): documents of each label and fold of sample(fold, text, toxic) that hold a term."""

    def make():
        def each(batch):
            counts: dict[str, list[int]] = {}
            for text, toxic, fold in zip(utf8(batch.column("text")), batch.column("toxic").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                for t in _terms(text):
                    counts.setdefault(t, [0, 0, 0, 0])[2 * fold + 1 - toxic] += 1
            return [list(counts), *([c[k] for c in counts.values()] for k in range(4))]

        return each

    names = ("bad0", "good0", "bad1", "good1")
    parts = map_batches(sample.select("text", "toxic", "fold"), make, "term string, " + ", ".join(f"{n} long" for n in names))
    return parts.groupBy("term").agg(*(F.sum(n).alias(n) for n in names))


def _lexicon(counts: DataFrame, folds: tuple[int, ...], totals: dict[tuple[int, int], int]) -> dict[str, float]:
    """Term weights (log odds) from the given folds, for all terms whose record is unlikely to be chance; the sample bounds their number."""
    n_bad, n_good = sum(totals.get((f, 1), 0) for f in folds), sum(totals.get((f, 0), 0) for f in folds)
    if not n_bad or not n_good:
        return {}
    share = n_bad / (n_bad + n_good)
    rows = counts.select("term", sum(F.col(f"bad{f}") for f in folds).alias("bad"), sum(F.col(f"good{f}") for f in folds).alias("good"))
    all_of = F.col("bad") + F.col("good")
    chance = F.col("bad") * F.log(F.col("bad") / (all_of * share)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (all_of * (1 - share)))).otherwise(0.0)
    weight = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
    picked = rows.filter("bad > 0").withColumn("chance", chance).withColumn("weight", weight).filter((F.col("chance") >= EVIDENCE) & (F.col("good") <= CLEAN_SHARE * F.col("bad")))
    found = {r["term"]: (r["weight"], r["bad"]) for r in picked.collect()}
    # A prefix that stands for one word only adds nothing to it.
    alone: Counter = Counter()
    for t, (_, n) in found.items():
        if not t.endswith("*"):
            for k in PREFIXES:
                alone[f"{t[:k]}*"] = max(alone[f"{t[:k]}*"], n)
    return {t: w for t, (w, n) in found.items() if not t.endswith("*") or n > alone[t]}


def _innocent(sample: DataFrame, weights: dict[str, float]) -> frozenset[str]:
    """Words of the sample's clean documents that only look like a term; the sample bounds their number."""
    held = sample.sparkSession.sparkContext.broadcast(LexiconAutomaton(list(weights)))

    def make():
        def each(batch):
            automaton, seen = held.value, set()
            for text in utf8(batch.column("text")):
                seen.update(set(_cut(text)) - seen)
            words = (w.decode("utf-8", "replace") for w in seen)
            return [[w for w in words if (found := automaton.match(w)) and found[0]]]

        return each

    words = map_batches(sample.filter("toxic = 0").select("text"), make, "word string").distinct()
    return frozenset(r["word"] for r in words.collect())


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """A scorer fitted on at most ``sample`` rows of labels(doc_id, toxic) and their texts.

    Of copies one counts.  The model learns from features that the lexicon of the
    other half of the sample gives, so that a lexicon's chance terms cannot
    flatter themselves.  Rows without doc_id or label don't count, of repeated
    doc_ids the worse label does.  Without rows of both labels every score is 0.
    """
    spark = docs.sparkSession
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # At most ``sample`` rows of two numbers: small enough to send to each task.
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def signed():
        words = _Words()
        return lambda batch: [batch.column("text"), batch.column("toxic"), [_signature(t, words) for t in utf8(batch.column("text"))]]

    marked = map_batches(texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), signed, "text string, toxic int, signature long")
    first = marked.groupBy("signature").agg(F.max_by("text", F.struct("toxic", F.xxhash64("text"))).alias("text"), F.max("toxic").alias("toxic"))
    sampled = staged(first.select("text", "toxic", F.pmod(F.xxhash64("signature"), F.lit(2)).cast("int").alias("fold")), "labelled")
    totals = {(r["fold"], r["toxic"]): r["n"] for r in sampled.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = staged(_counts(sampled), "terms")
    weights = _lexicon(counts, (0, 1), totals)
    if not weights:
        return Scorer({})
    halves = [_lexicon(counts, (f,), totals) for f in (0, 1)]
    held = spark.sparkContext.broadcast([Scorer(h, _innocent(sampled.filter(F.col("fold") == f), h) if h else frozenset()) for f, h in enumerate(halves)])

    def make():
        scorers = held.value

        def each(batch):
            found = [scorers[1 - f].features(t).tolist() for t, f in zip(utf8(batch.column("text")), batch.column("fold").to_pylist(), strict=True)]
            return [pa.array(found, pa.list_(pa.float64())), batch.column("toxic")]

        return each

    seen = map_batches(sampled, make, "x array<double>, y int").collect()
    model = fit_logistic(np.array([r["x"] for r in seen]), np.array([r["y"] for r in seen], dtype=np.float64))
    return Scorer(weights, _innocent(sampled, weights), model)


def score(docs: DataFrame, scorer: Scorer, name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 in column ``name``, replacing one of that name; null and empty texts get the score of no hit."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)
    kept = [c for c in docs.columns if c != name]

    def run(batches):
        own = held.value
        for batch in batches:
            x = np.array([own.features(t) for t in utf8(batch.column("text"))]).reshape(-1, 7)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(own.score(x), pa.float64())], [*kept, name])

    return docs.select(kept).mapInArrow(tidy(run), docs.select(kept).schema.add(name, "double"))


def in_training(doc_id: str = "doc_id") -> F.Column:
    """Rows that labels may be learned from: crc32 of doc_id, as text, is not 2 modulo 4."""
    return F.crc32(F.col(doc_id).cast("string")) % 4 != 2


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, columns unchanged, without those that score ``threshold`` or more."""
    name = free_name("_toxicity", docs.columns)
    scored = score(docs, fit(docs, labels.filter(in_training())), name)
    return scored.filter(F.col(name) < threshold).select(docs.columns)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels").filter(in_training())))
    return scored.select("doc_id", F.coalesce(~in_training(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
