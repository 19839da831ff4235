"""Work for each distinct token instead of for each occurrence, with the results of the plain way."""

import random
import re
from collections import Counter

import numpy as np

from kinetrack.llm import toxicity

TEXTS = [
    "A sl1ck stu.pid w o r d, a b c. Plain words, plain words again", "İstanbul straße x ÿ ŧ 𝒳y 中文 one_two 3x", "", None, "e y o ab! l l a m a " * 3,
    " ".join(random.Random(1).choices(["words", "pla1n", "xx", "f.u.n", "a", "I", "ok!", "stupid,"], k=400)),
]


def by_characters(texts):
    out = np.zeros(toxicity._SIZE**3, np.int64)
    for t in texts:
        for w in toxicity._WORD.findall((t or "").lower()):
            x = [0, 0, *toxicity._codes(w), 0]
            for a, b, c in zip(x, x[1:], x[2:]):
                out[(a * toxicity._SIZE + b) * toxicity._SIZE + c] += 1
    return out


def test_toxicity_trigrams_of_whole_texts(monkeypatch):
    for size in (7, 1 << 18):
        monkeypatch.setattr(toxicity, "SLICE", size)
        assert (sum(toxicity.text_trigrams(x) for x in toxicity._cut(iter(TEXTS))) == by_characters(TEXTS)).all()


def test_toxicity_examines_a_token_once(monkeypatch):
    model = toxicity.CharacterModel(by_characters(TEXTS))
    seen, pattern = Counter(), re.compile(toxicity._SUSPECT.pattern)

    class Counted:
        def search(self, token):
            seen[token] += 1
            return pattern.search(token)

    monkeypatch.setattr(toxicity, "_SUSPECT", Counted())
    words = {w for t in TEXTS for w in toxicity.words_of(t, model, {})}
    names = sorted({f for w in words for f in toxicity.features_of(w)})[::2]
    features = toxicity.Features(names)
    seen.clear()
    for t in [*TEXTS, *TEXTS]:
        expected = Counter()
        for w, n in toxicity.words_of(t, None, {}).items():
            expected.update({f: n for f in toxicity.features_of(w)})
        got = toxicity._values(t, model, features)
        assert all(got[features.known[f]] >= min(3, n) for f, n in expected.items() if f in features.known)
    assert max(seen.values()) == 1
    for t in TEXTS:
        expected = Counter()
        for w, n in toxicity.words_of(t, model, {}).items():
            for f in toxicity.features_of(w):
                expected[f] += n
        assert toxicity._values(t, model, features) == {features.known[f]: min(3.0, n) for f, n in expected.items() if f in features.known}
