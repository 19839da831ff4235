"""Toxicity scores of restored text: a noisy channel in front of a classifier.

A writer hides a word behind look-alike characters, single letters with gaps, and repeated letters.
Each token with a look-alike, a doubled letter or an inner gap mark, and each run of single characters, becomes a lattice of what its characters may stand for, and the
Viterbi path under a character trigram model (trained on the corpus) with channel costs restores it.
Words that stand in the text are counted once, restored ones besides where they differ.  The classifier is a logistic regression on words
and word beginnings of restored text, fitted on a bounded sample of labelled rows.

Edge cases: null and empty texts have no feature and get the score of the intercept; labels of a doc_id
that repeats count as toxic if one is; null labels are not learned from; with no usable label every
score is 0; repeated rows are separate rows; texts and stretches of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrack.llm.storage import written

#: What look-alike characters may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "£": "l",
}
GAPS = ".-_*~'’ \t"
_LETTER = r"[^\W\d_]"
_LEET = re.escape("".join(LOOKALIKES))
_SOLID = rf"(?:{_LETTER}|[{_LEET}])"
_INNER = re.escape("".join(c for c in GAPS if not c.isspace()))
#: What makes a lower-case token suspicious, wherever it stands: a look-alike, a doubled letter, or gap marks
#: between two letters or look-alikes.  The character model decides on the reading; tests are linear in the length.
_SUSPECT = re.compile(rf"[{_LEET}]|({_LETTER})\1|{_SOLID}[{_INNER}]+{_SOLID}")
_WORD = re.compile(rf"{_LETTER}+")
#: Parameters: channel costs (natural logs), beginnings of words used as features, cached words of a task.
READ, DROP, SPLIT = math.log(0.5), math.log(0.8), math.log(0.05)
DIGIT_KEPT, MARK_KEPT = math.log(1e-6), math.log(0.3)
FEWER = {2: math.log(0.05), 3: math.log(0.7)}
BEGINNINGS = range(3, 11)
CACHE = 1 << 18
#: Alphabet of the character model: boundary, letters that occur in European languages, and one for the rest.
_ALPHABET = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
_CODE = {c: i + 1 for i, c in enumerate(_ALPHABET)}
_SIZE = len(_ALPHABET) + 2
_OTHER, _SQUARE = _SIZE - 1, _SIZE * _SIZE


def _codes(word: str) -> list[int]:
    return [_CODE.get(c, _OTHER) for c in word]


def trigram_counts(words: Counter) -> np.ndarray:
    """Counts of character trigrams of words between boundaries, as a flat array."""
    return sum((n * text_trigrams(w) for w, n in words.items()), np.zeros(_SIZE**3, np.int64))


#: The code of each code point: 0 for what is no letter, 255 where it is not known yet.
_CODES = np.full(0x110000, 255, np.uint8)
#: Characters whose codes a task holds as arrays at once.
SLICE = 1 << 18


def _text_codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    codes = _CODES[points]
    if (codes == 255).any():
        for x in np.unique(points[codes == 255]).tolist():
            _CODES[x] = _CODE.get(chr(x), _OTHER) if _WORD.fullmatch(chr(x)) else 0
        codes = _CODES[points]
    return codes


def text_trigrams(text: str) -> np.ndarray:
    """The same of all words of a lower-case text."""
    x = np.concatenate([np.zeros(2, np.int32), _text_codes(text), np.zeros(1, np.int32)])
    a, b, c = x[:-2], x[1:-1], x[2:]
    three = (np.where(b > 0, a, 0) * _SIZE + b) * _SIZE + c
    return np.bincount(three[(b > 0) | (c > 0)], minlength=_SIZE**3)


def _cut(texts: Iterator[str | None]) -> Iterator[str]:
    """Lower-case texts in stretches of some SLICE characters, cut at spaces."""
    held, size = [], 0
    for text in texts:
        text, at = (text or "").lower(), 0
        while at < len(text):
            end = text.find(" ", at + SLICE)
            end = len(text) if end < 0 else end
            held.append(text[at:end])
            size, at = size + end - at, end
            if size >= SLICE:
                yield " ".join(held)
                held, size = [], 0
    yield " ".join(held)


class CharacterModel:
    """Interpolated character trigrams, as a dense table of log probabilities."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(_SIZE, _SIZE, _SIZE).astype(float)
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 0.5) / (c1.sum() + 0.5 * _SIZE)
        p2 = (c2 + 4 * p1) / (c2.sum(axis=1, keepdims=True) + 4)
        self.log = np.log((c3 + 4 * p2) / (c3.sum(axis=2, keepdims=True) + 4)).tolist()
        #: The same as one list, by code of the trigram.
        self.flat = [x for rows in self.log for row in rows for x in row]
        #: What a worker has restored so far: for each token, the words that do not stand there anyway.
        self.hidden: dict[str, tuple[str, ...]] = {}

    def restore(self, seen: str) -> str:
        """The likeliest reading of a suspicious stretch, words separated by spaces."""
        # state: the last two characters' codes as one number (0 after a boundary); value: log probability, and what was read last
        # with a link to what was read before, so that a step costs the same however long the stretch is
        states, log = {0: (0.0, None)}, self.flat
        for c, n in _runs(seen):
            options = _coded(c, n)
            nxt: dict[int, tuple[float, tuple]] = {}
            if len(options) == 1 and options[0][2][0]:  # a letter that stands for itself
                out, _, (code,) = options[0]
                if len(states) == 1:
                    s, (p, read) = states.popitem()
                    k = s * _SIZE + code
                    states[k % _SQUARE] = (p + log[k], (out, read))
                    continue
                for s, (p, read) in states.items():
                    k = s * _SIZE + code
                    q, k = p + log[k], k % _SQUARE
                    got = nxt.get(k)
                    if got is None or got[0] < q:
                        nxt[k] = (q, (out, read))
                states = nxt
                continue
            for s, (p, read) in states.items():
                for out, cost, codes in options:
                    k, q = s, p + cost
                    for code in codes:
                        if code:
                            k = k * _SIZE + code
                            q += log[k]
                            k %= _SQUARE
                        elif k:
                            q += log[k * _SIZE]
                            k = 0
                    got = nxt.get(k)
                    if got is None or got[0] < q:
                        nxt[k] = (q, (out, read))
            states = nxt
        ends = [(p + log[k * _SIZE], read) for k, (p, read) in states.items()]
        best = max(p for p, _ in ends)
        return max(_text(read) for p, read in ends if p == best)


def _text(read: tuple | None) -> str:
    """What a chain of links reads."""
    parts = []
    while read is not None:
        parts.append(read[0])
        read = read[1]
    return "".join(reversed(parts))


def _runs(seen: str) -> list[tuple[str, int]]:
    out: list[tuple[str, int]] = []
    for c in seen.lower():
        if out and out[-1][0] == c:
            out[-1] = (c, out[-1][1] + 1)
        else:
            out.append((c, 1))
    return out


def _options(c: str, n: int) -> list[tuple[str, float]]:
    """What a run of n equal characters may stand for, with channel costs."""
    if c in GAPS:
        return [("", DROP), (" ", SPLIT)]
    if c.isalpha():
        return [(c * k, FEWER[min(n, 3)] if k < n else 0.0) for k in range(1, min(n, 3) + 1)]
    if c in LOOKALIKES:
        # a mark may also be just a mark
        return [(x * k, READ) for x in LOOKALIKES[c] for k in range(1, min(n, 2) + 1)] + [(" ", DIGIT_KEPT if c.isdigit() else MARK_KEPT)]
    return [(" ", 0.0)]


@lru_cache(maxsize=1 << 14)
def _coded(c: str, n: int) -> list[tuple[str, float, list[int]]]:
    """The same with the codes of what they stand for."""
    return [(out, cost, [0 if o == " " else _CODE.get(o, _OTHER) for o in out]) for out, cost in _options(c, n)]


def _spelled(text: str) -> Iterator[str]:
    """Runs of three or more single characters with white space between them."""
    run: list[str] = []
    tokens = text.split()
    single = np.fromiter(map(len, tokens), np.int64, len(tokens)) == 1
    if not (single[1:] & single[:-1]).any():
        return
    for token in [*tokens, ""]:
        if len(token) == 1 and (token.isalpha() or token in LOOKALIKES):
            run.append(token)
            continue
        if len(token) == 2 and token[1] in ",.;:!?" and run and (token[0].isalpha() or token[0] in LOOKALIKES):
            run.append(token[0])
        if len(run) > 2:
            yield " ".join(run)
        run = []


def _hidden(seen: str, model: CharacterModel, cache: dict[str, tuple[str, ...]]) -> tuple[str, ...]:
    """Words of a suspicious stretch's likeliest reading that do not stand there anyway."""
    got = cache.get(seen)
    if got is None:
        plain, read = _WORD.findall(seen.lower()), _WORD.findall(model.restore(seen))
        got = () if read == plain else tuple((Counter(read) - Counter(plain)).elements())
        if len(cache) < CACHE and len(seen) < 200:
            cache[seen] = got
    return got


def words_of(text: str | None, model: CharacterModel | None, cache: dict[str, tuple[str, ...]]) -> Counter:
    """Words of the text and of its restored stretches, lower-case."""
    text = (text or "").lower()
    out = Counter(_WORD.findall(text))  # what stands there stays readable too
    if model is None:
        return out
    tokens, single = Counter(text.split()), 0
    for token, n in tokens.items():
        if len(token) == 1:
            single += n
            continue
        got = cache.get(token)
        if got is None:
            got = _hidden(token, model, cache) if _SUSPECT.search(token) else ()
        for w in got:
            out[w] += n
    if single > 1:
        for seen in _spelled(text):
            out.update(_hidden(seen, model, cache))
    return out


def features_of(word: str) -> list[str]:
    return [*(word[:k] for k in BEGINNINGS if k < len(word)), word + "$"]


def train_characters(docs: DataFrame) -> CharacterModel:
    """Character trigrams of all training texts; their table's size is fixed by the alphabet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE**3, np.int64)
        for part in _cut(t.as_py() for batch in batches for t in batch.column("text")):
            total += text_trigrams(part)
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(total[i])], ["code", "n"])

    sums = docs.select("text").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(_SIZE**3, np.int64)
    counts[sums.column("code").to_numpy()] = sums.column("n").to_numpy()
    return CharacterModel(counts)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text, toxic of about ``sample`` distinct labelled texts, chosen by a hash of doc_id; written once."""
    own = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = own.count()
    share = min(1.0, sample / max(1, n))
    own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    found = docs.select("doc_id", "text").join(own, "doc_id").dropDuplicates(["text"]).select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    return written(found, "toxic-sample")


def select_features(sample: DataFrame, characters: CharacterModel, most: int, support: int) -> list[str]:
    """The features most tied to toxic texts, by z-score of the log odds of their document counts."""
    shared = sample.sparkSession.sparkContext.broadcast(characters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = shared.value.hidden
        counts = {0: Counter(), 1: Counter()}

        def give() -> Iterator[pa.RecordBatch]:
            for label, c in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()) if label else [0] * len(c), pa.int64()), pa.array([0] * len(c) if label else list(c.values()), pa.int64())], ["feature", "toxic", "clean"])
                c.clear()

        for batch in batches:
            for t, y in zip(batch.column("text"), batch.column("toxic"), strict=True):
                counts[min(1, max(0, y.as_py()))].update({f for w in words_of(t.as_py(), shared.value, cache) for f in features_of(w)})
                if sum(map(len, counts.values())) > 4 * CACHE:
                    yield from give()
        yield from give()

    total = sample.agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")).first()
    a, n = total["a"] or 0, total["n"]
    if not a or a == n:
        return []
    counts = sample.mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(F.col("t") >= support)
    odds = F.log((F.col("t") + 0.5) / (a - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (n - a - F.col("c") + 0.5))
    spread = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    return [r[0] for r in counts.where(odds > 1.5).orderBy((odds / spread).desc(), "feature").limit(most).select("feature").collect()]


#: In place of a feature: a token of one character.
_SINGLE = -1


class Features:
    """Numbers of features, and what a worker has found of tokens so far."""

    def __init__(self, names: list[str]):
        self.known = {f: i for i, f in enumerate(names)}
        #: A word's features all begin as the word and its end do.
        self.starts = {f[:3] for f in names}
        self.by_token: dict[str, tuple[int, ...]] = {}

    def of(self, word: str) -> list[int]:
        if (word + "$")[:3] not in self.starts:
            return []
        return [self.known[f] for f in features_of(word) if f in self.known]

    def of_token(self, token: str, characters: CharacterModel) -> tuple[int, ...]:
        """Features of the token's words and of those that it hides, each as often as it occurs."""
        found = [i for w in _WORD.findall(token) for i in self.of(w)]
        if len(token) == 1:
            found.append(_SINGLE)
        elif _SUSPECT.search(token):
            found += [i for w in _hidden(token, characters, characters.hidden) for i in self.of(w)]
        if len(self.by_token) < 2 * CACHE and len(token) < 200:
            self.by_token[token] = tuple(found)
        return tuple(found)


def _values(text: str | None, characters: CharacterModel, features: Features) -> dict[int, float]:
    """Values of a text's features: occurrences, three at most."""
    text, out = (text or "").lower(), {}
    tokens = Counter(text.split())
    for (token, n), ids in zip(tokens.items(), map(features.by_token.get, tokens)):
        for i in features.of_token(token, characters) if ids is None else ids:
            out[i] = out.get(i, 0) + n
    if out.pop(_SINGLE, 0) > 1:
        for seen in _spelled(text):
            for i in (i for w in _hidden(seen, characters, characters.hidden) for i in features.of(w)):
                out[i] = out.get(i, 0) + 1
    return {i: min(3.0, float(n)) for i, n in out.items()}


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 400, ridge: float = 1e-3) -> np.ndarray:
    """Weights, the intercept last; accelerated gradient descent."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = v = np.zeros(x.shape[1])
    step = 4.0 / (np.square(x).sum(axis=1).max() + 1e-9)
    step = max(step, 4.0 * len(x) / (np.square(np.linalg.norm(x, 2)) + 1e-9))
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        g = x.T @ (p - y) / len(x) + ridge * np.concatenate([v[:-1], [0.0]])
        new = v - step * g
        v, w = new + k / (k + 3) * (new - w), new
    return w


class Model:
    def __init__(self, characters: CharacterModel, features: list[str], weights: np.ndarray):
        self.characters, self.features, self.weights = characters, features, weights


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000, features: int = 400, support: int = 5) -> Model:
    """``docs`` are the training rows.  ``sample`` bounds the labelled texts that the classifier is fitted on."""
    characters = train_characters(docs)
    rows = labelled_sample(docs, labels, sample)
    chosen = select_features(rows, characters, features, support)
    if not chosen:
        return Model(characters, [], np.array([-50.0]))
    shared = docs.sparkSession.sparkContext.broadcast((characters, Features(chosen)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value
        for batch in batches:
            got = [_values(t.as_py(), model, known) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([list(g) for g in got], pa.list_(pa.int32())), pa.array([list(g.values()) for g in got], pa.list_(pa.float64()))], ["toxic", "i", "x"])

    found = rows.mapInArrow(run, "toxic int, i array<int>, x array<double>").toArrow()
    x = np.zeros((len(found), len(chosen)))
    for k, (i, v) in enumerate(zip(found.column("i").to_pylist(), found.column("x").to_pylist(), strict=True)):
        x[k, i] = v
    return Model(characters, chosen, fit_logistic(x, found.column("toxic").to_numpy().astype(float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast((model, Features(model.features)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, features = shared.value
        w, b = m.weights[:-1].tolist(), float(m.weights[-1])
        for batch in batches:
            out = []
            for t in batch.column("text"):
                z = b + sum(w[i] * v for i, v in _values(t.as_py(), m.characters, features).items())
                out.append(1 / (1 + math.exp(-max(-700.0, min(700.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
