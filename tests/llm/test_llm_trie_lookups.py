"""Look-ups of the trie: hashes of words, neighbours in a sequence, and buckets that stay short however frequent a context is."""

import random

import numpy as np

from kinetrack.llm import lm_trie
from kinetrack.llm.elias_fano import EliasFano


def test_hashes_of_words():
    rng = random.Random(4)
    words = ["".join(rng.choices("ab", k=k)) for k in (1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 72, 73, 200, 3000) for _ in range(40)] + ["a" * 8, "a" * 9, "\0", "\0\0", "a\0"]
    hashes = lambda text: lm_trie.tokens_of(np.array([0, len(text)]), np.frombuffer(text, np.uint8))[0][:-1].tolist()
    plain, other = hashes(" ".join(words).encode()), hashes(b"x\n" + "\t \n".join(reversed(words)).encode())[1:]
    assert other[::-1] == plain and len(set(plain)) == len(set(words))
    assert lm_trie.tokens_of(np.zeros(3, np.int64), np.zeros(0, np.uint8))[0].tolist() == [int(lm_trie.END)] * 2


def test_neighbours_in_a_sequence():
    rng = np.random.default_rng(5)
    for top in (40, 3000, 1 << 40):
        v = np.sort(rng.integers(0, top, 2000, np.uint64))
        v[700:1300] += np.uint64(100 * top)
        v[1300:] += np.uint64(200 * top)
        i = np.arange(len(v) - 1)
        first, second = EliasFano.of(v).both(i)
        assert (first == v[:-1]).all() and (second == v[1:]).all()


def test_buckets_of_a_frequent_context_are_short(spark):
    words = [f"w{i}" for i in range(3000)]
    docs = spark.createDataFrame([(k, " ".join(f"the {w}" for w in words[k::4])) for k in range(4)], "doc_id long, text string")
    trie = lm_trie.train(docs, order=2)
    child = lm_trie._ef(dict(lm_trie.mapped(trie.children.files[0])), "child")
    assert child.n > 5000
    high = child.access(np.arange(child.n)) >> np.uint64(child.bits)
    assert np.unique(high, return_counts=True)[1].max() < 40
