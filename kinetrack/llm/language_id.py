"""Language identification by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary (a SentencePiece model file; its path is a
parameter) that consist of letters, with or without the mark of a word's start, whatever their length,
and a fallback for any single character.  For each language, piece probabilities come from expectation-maximisation
over all segmentations (forward and backward sums) of the training documents' words, weighted by
their counts.  A word's probability is the forward sum over its segmentations; a text's score is
the posterior of its best language, from the log probabilities of all its words.

Words are runs of letters, lower-cased, and are summed over whole, whatever their length: what a task
holds at once is bounded by characters.  EM ends when a round gains little likelihood.  Edge cases: null texts and texts without a letter are ``und`` with score 0; null langs are not
learned from; without any training document everything is ``und``; languages are ordered by name
where posteriors tie; repeated rows are separate rows; no other column is read, so names cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrack.llm.storage import written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"

_LETTERS = re.compile(r"[^\W\d_]+")
_START = "▁"
#: Probability of a character that no piece covers, and the count added to each piece and language.
FLOOR, ADDED = 1e-7, 0.01
#: EM ends when the log likelihood gains less than this part of itself, or after so many rounds.
GAIN, ROUNDS = 0.02, 6
#: Words whose scores a task keeps; characters of the words that it sums over at once.
CACHE, BLOCK = 1 << 19, 1 << 17
#: Forward sums below this get a new scale.
TINY = 1e-100
#: Languages that a training table may have (each is a column of the piece probabilities).
MOST_LANGUAGES = 1000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)



def load_pieces(path: str = VOCABULARY) -> list[str]:
    """Usable pieces, in the vocabulary's order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    seen: dict[str, None] = {}
    for i in range(model.get_piece_size()):
        x = model.id_to_piece(i).lower()
        if x and not model.is_byte(i) and not model.is_control(i) and _LETTERS.fullmatch(x.removeprefix(_START) or "a"):
            seen.setdefault(x)
    return list(seen)


class Lattice:
    """Sums over all segmentations of many words at once, for all languages."""

    def __init__(self, pieces: list[str], probability: np.ndarray):
        """probability: pieces x languages."""
        self.pieces, self.p = len(pieces), np.vstack([probability, np.full(probability.shape[1], FLOOR)])
        self.longest = max(map(len, pieces), default=1)
        # every beginning of a piece has a name; a word's characters are followed as long as some piece goes on
        begun = {p[:k]: -1 for p in pieces for k in range(1, len(p) + 1)} | {p: i for i, p in enumerate(pieces)}
        key, self.piece = np.zeros(len(begun), np.uint64), np.fromiter(begun.values(), np.int64, len(begun))
        by: dict[int, list[tuple[int, str]]] = {}
        for i, x in enumerate(begun):
            by.setdefault(len(x), []).append((i, x))
        for same in by.values():
            key[[i for i, _ in same]] = self._name(np.array([[ord(c) for c in x] for _, x in same], np.uint64))
        # open addressing: beginnings by the top bits of their names, -1 where nothing is
        self.key, self.shift = key, np.uint64(64 - max(1, (8 * len(key)).bit_length()))
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        for i, at in enumerate((key >> self.shift).tolist()):
            while self.slots[at] >= 0:
                at = (at + 1) % len(self.slots)
            self.slots[at] = i

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The beginnings of names, -1 where there is none."""
        if not len(self.key):
            return np.full(len(h), -1, np.int64)
        at = (h >> self.shift).astype(np.int64)
        got = self.slots[at].astype(np.int64)
        wrong = np.flatnonzero((got >= 0) & (self.key[got] != h))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) % len(self.slots)
            got[wrong] = self.slots[at[wrong]]
            wrong = wrong[(got[wrong] >= 0) & (self.key[got[wrong]] != h[wrong])]
        return got

    @staticmethod
    def _name(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(codes.shape[0], np.uint64)
        for j in range(codes.shape[1]):
            h = (h ^ codes[:, j]) * _MIX
            h ^= h >> np.uint64(29)
        return h

    def _edges(self, words: list[str]) -> tuple[int, list[list[tuple[int, slice | np.ndarray, np.ndarray]]]]:
        """Words of one length: for each end the (length, words, piece ids) of the pieces that end there, the
        single character (of all words) first."""
        n = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).T.astype(np.uint64)
        ends: list[list[tuple[int, slice | np.ndarray, np.ndarray]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            h, on = np.zeros(len(words), np.uint64), np.arange(len(words))
            for j in range(i, min(n, i + self.longest)):
                h = (h ^ codes[j][on]) * _MIX
                h ^= h >> np.uint64(29)
                got = self._find(h)
                more = np.flatnonzero(got >= 0)
                h, on, piece = h[more], on[more], self.piece[got[more]]
                if j == i:
                    single = np.full(len(words), self.pieces)
                    single[on[piece >= 0]] = piece[piece >= 0]
                    ends[j + 1].insert(0, (1, slice(None), single))
                else:
                    whole = np.flatnonzero(piece >= 0)
                    if len(whole):
                        ends[j + 1].append((j + 1 - i, on[whole], piece[whole]))
                if not len(on):
                    break
        return n, ends

    @staticmethod
    def _moved(sums: list[np.ndarray], scales: list[np.ndarray], at: int, scale: np.ndarray) -> np.ndarray:
        """The sums of a place under another scale."""
        return sums[at] if scales[at] is scale else sums[at] * np.exp(scales[at] - scale)

    def _forward(self, n: int, ends: list, start: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Forward sums at each place and the logs of their scales (one array as long as nothing gets too small).

        ``ends`` has the pieces' probabilities last.
        """
        sums, scales = [start], [np.zeros_like(start)]
        for e in range(1, n + 1):
            scale = scales[e - 1]
            total = np.zeros_like(start)
            for size, own, *_, p in ends[e]:
                total[own] += self._moved(sums, scales, e - size, scale)[own] * p
            if total.min() < TINY:
                scale, total = scale + np.log(total), np.ones_like(total)
            sums.append(total)
            scales.append(scale)
        return sums, scales

    @staticmethod
    def _alike(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
        """Words with their start marks, those of one length together and of BLOCK characters at most: (places, words)."""
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w), []).append(k)
        for size, same in by.items():
            step = max(1, BLOCK // (size + 1))
            for i in range(0, len(same), step):
                yield np.array(same[i : i + step]), [_START + words[k] for k in same[i : i + step]]

    def log_probability(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's probability under each language (words x languages)."""
        out = np.zeros((len(words), self.p.shape[1]))
        for at, some in self._alike(words):
            n, ends = self._edges(some)
            ends = [[(size, own, self.p[piece]) for size, own, piece in e] for e in ends]
            sums, scales = self._forward(n, ends, np.ones((len(some), self.p.shape[1])))
            out[at] = scales[n] + np.log(sums[n])
        return out

    def expected(self, words: list[str], language: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, float]:
        """Expected uses of each piece in each language (pieces x languages) for counted words of a language,
        and the log likelihood of these words."""
        flat, wide = self.p.ravel(), self.p.shape[1]
        out, likelihood = np.zeros(len(flat)), 0.0
        for at, some in self._alike(words):
            n, ends = self._edges(some)
            spoken, c = language[at], count[at]
            # sums of each word's own language alone
            index = [[(size, own, piece * wide + spoken[own]) for size, own, piece in e] for e in ends]
            ends = [[(size, own, i, flat[i]) for size, own, i in e] for e in index]
            sums, scales = self._forward(n, ends, np.ones(len(some)))
            likelihood += float(c @ (scales[n] + np.log(sums[n])))
            # how often a segmentation has a border at a place; backwards, it splits over the pieces that end there
            border = np.zeros((n + 1, len(some)))
            border[n] = c
            used, weight = [], []
            for e in range(n, 0, -1):
                part = border[e] / sums[e]
                for size, own, i, p in ends[e]:
                    share = self._moved(sums, scales, e - size, scales[e])[own] * p * part[own]
                    border[e - size][own] += share
                    used.append(i)
                    weight.append(share)
            out += np.bincount(np.concatenate(used), np.concatenate(weight), len(flat))
        return out.reshape(self.p.shape)[: self.pieces], likelihood


def counted_words(docs: DataFrame) -> DataFrame:
    """lang, word, n over all training documents; counted in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def give() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                held.setdefault(lang.as_py(), Counter()).update(words_of(text.as_py()))
            if sum(map(len, held.values())) > CACHE:
                yield from give()
        yield from give()

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, rounds: int = ROUNDS, vocabulary: str = VOCABULARY) -> tuple[list[str], np.ndarray]:
    """Languages and the pieces' probabilities (pieces x languages), from rows with a non-null lang.

    What reaches the driver are sums for pieces and languages: the vocabulary bounds them.
    """
    spark = docs.sparkSession
    counts = written(counted_words(docs.where("lang IS NOT NULL")), "language-words")
    languages = sorted(r[0] for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"the training table has more than {MOST_LANGUAGES} languages")
    pieces = load_pieces(vocabulary)
    p = np.full((len(pieces), len(languages)), 1.0 / max(1, len(pieces)))
    before = None
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast((pieces, languages, p))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, known, now = shared.value
            lattice, place = Lattice(names, now), {x: i for i, x in enumerate(known)}
            total, likelihood = np.zeros(now.shape), 0.0
            for batch in batches:
                own = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
                some, gained = lattice.expected(batch.column("word").to_pylist(), own, batch.column("n").to_numpy(zero_copy_only=False).astype(float))
                total, likelihood = total + some, likelihood + gained
            i, j = np.nonzero(total)
            x = np.append(total[i, j], likelihood)  # piece -1 stands for the log likelihood
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1).astype(np.int32)), pa.array(np.append(j, 0).astype(np.int32)), pa.array(x)], ["piece", "language", "used"])

        sums = counts.mapInArrow(run, "piece int, language int, used double").groupBy("piece", "language").agg(F.sum("used").alias("used")).toArrow()
        piece, language, x = (sums.column(k).to_numpy() for k in ("piece", "language", "used"))
        used, at = np.full(p.shape, ADDED), piece >= 0
        used[piece[at], language[at]] += x[at]
        p = used / used.sum(axis=0) * (1 - FLOOR)
        now = float(x[~at].sum())
        if before is not None and now - before < GAIN * abs(now):
            break
        before = now
    return languages, p


def identify(docs: DataFrame, languages: list[str], p: np.ndarray, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, lang_pred, score for whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast((load_pieces(vocabulary), languages, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known, now = shared.value
        lattice, row = Lattice(pieces, now), {}
        table = np.zeros((0, len(known)))
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [words_of(t.as_py()) for t in part.column("text")]
                if len(row) > CACHE:
                    row, table = {}, np.zeros((0, len(known)))
                new = list({w for t in texts for w in t} - row.keys()) if known else []
                if new:
                    table = np.vstack([table, lattice.log_probability(new)])
                    row.update(zip(new, range(len(row), len(row) + len(new)), strict=True))
                best, score = [], []
                for raw, ws in zip(part.column("text"), texts, strict=True):
                    if not known or not has_letter(raw.as_py()):
                        best.append("und")
                        score.append(0.0)
                        continue
                    total = table[np.fromiter(map(row.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                    post = np.exp(total - total.max())
                    k = int(post.argmax())
                    best.append(known[k])
                    score.append(float(post[k] / post.sum()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")

