"""Periodic runs, packing and Merkle manifests against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinetrack.llm import merkle, packing, periodic_runs, suffix_dedup, toxicity
from kinetrack.llm.queries import queries

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RNG = random.Random(11)
LINE = "the same line stands here again and again without end"
TEXTS = [
    None, "", " \n\t ", "one", "a b c a b c a b c a b c", "a a a a a a a a a a a a a", "x y " * 5, f"{LINE}\n" * 30, " ".join(RNG.choices("pqr", k=400)), "a b a b a a b a b a a b a b a b b",
    " ".join(f"w{i % 97}" for i in range(5000)), "Ä ö\x0bÄ\x0cö " * 9, "<|endoftext|> it's  two　spaces \x1c here now", "z" * 70_000, " ".join(f"word{RNG.randrange(900)}" for _ in range(3000)),
]


@pytest.fixture(scope="module")
def docs(spark):
    # clashing columns, a repeated row, repeated and null doc_ids
    rows = [(i, t, ["en", "de", None][i % 3], "src", len(t or ""), 1, "r", 2, "s") for i, t in enumerate(TEXTS)]
    rows += [rows[7], rows[7], (None, TEXTS[4], "en", None, None, 1, "r", 2, "s"), (7, "other", "en", "src", 5, 1, "r", 2, "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, start int, runs string, length int, path string").repartition(3).persist()


def brute_runs(words: list, shortest: int = 12) -> list[tuple[int, int, int]]:
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i > s and i + p - s >= max(shortest, 2 * p):
                found.setdefault((s, i + p), p)
            i += 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def test_runs_of_random_words(monkeypatch):
    for round_ in range(300):
        texts = []
        for _ in range(RNG.randint(1, 4)):
            w = [RNG.randrange(RNG.choice([1, 2, 3, 10])) for _ in range(RNG.randint(0, 60))]
            texts.append((w[: RNG.randint(1, 9)] * RNG.randint(1, 12) + w)[:110] if round_ % 2 and w else w)
        at = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        monkeypatch.setattr(periodic_runs, "PAIRS", RNG.choice([5, 1 << 19]))
        monkeypatch.setattr(periodic_runs, "PERIODS", RNG.choice([3, 1 << 18]))
        got = periodic_runs.runs_of(np.array(sum(texts, []), np.int64), at, 4)
        assert [tuple(x) for x in got.tolist()] == [(s + at[i], s + n + at[i], p) for i, w in enumerate(texts) for s, n, p in brute_runs(w, 4)]


def test_a_hash_that_errs_is_found_out(monkeypatch):
    ids, real, lies = np.array([1, 2, 3, 4] * 5 + list(range(10, 30))), periodic_runs.Prefixes.equal, []

    def equal(self, a, b, length):
        if len(lies) < 4:
            lies.append(1)
            return np.ones(len(a), bool)
        return real(self, a, b, length)

    monkeypatch.setattr(periodic_runs.Prefixes, "equal", equal)
    assert periodic_runs.runs_of(ids, np.array([0, len(ids)])).tolist() == [[0, 20, 4]]


def test_runs_of_documents(docs):
    got = periodic_runs.periodic_runs(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        text = "other" if r["n_words"] == 1 and r["doc_id"] == 7 else TEXTS[4] if r["doc_id"] is None else TEXTS[r["doc_id"]]
        words = (text or "").encode().split()
        runs = brute_runs(words) if len(words) < 1000 else [(0, len(words), 97)] if r["doc_id"] == 10 else []
        assert r["n_words"] == len(words) and [tuple(x) for x in r["runs"]] == runs
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        assert r["collapsed"].encode() == b" ".join(w for i, w in enumerate(words) if i not in gone)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_query_of_runs(spark, docs, tmp_path):
    more = spark.createDataFrame([(i, " ".join(f"v{i}x{k}" for k in range(i % 190)), "en", "s", 1, 1, "r", 2, "s") for i in range(100, 500)], docs.schema)
    docs.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {(r["doc_id"], r["text"]) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()}
    got = queries()["op11_periodic_runs"](spark, str(tmp_path)).collect()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want, planted = set(), 0
    for doc_id, text in rows:
        words = (text or "").encode().split()
        n, h = len(words), -1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g, planted = h // 10, planted + 1
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words) if n < 1000 else [(0, n, 97)] if doc_id == 10 else []
        gone = {i for s, m, p in runs for i in range(s + p, s + m)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        lines = "".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()
        want.add((doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha(lines), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert planted > 20 and {tuple(r) for r in got} == want and len(got) == docs.count() + 400


def test_the_tightest_window_takes_the_item():
    for _ in range(200):
        window = RNG.choice([16, 100, 1024])
        lengths = [RNG.randint(1, window - 1) for _ in range(RNG.randint(0, 60))]
        rooms, want = [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fits = [r for r in rooms if r >= lengths[i]]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else window) - lengths[i])
            want.append(rooms[-1])
        got = packing.best_fit(lengths, window)
        assert sorted(i for w in got for i in w) == list(range(len(lengths)))
        assert sorted(window - sum(lengths[i] for i in w) for w in got) == sorted(rooms)


def test_ids_are_those_of_the_tokenizers_file():
    tokens, plain = packing.Tokens(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    letters = "aB1 '\n\t　 .,\x1c\x85é́ß漢🙂" + "<|endoftext|>"
    texts = [t or "" for t in TEXTS] + ["".join(RNG.choices(letters, k=RNG.randint(0, 30))) for _ in range(2000)] + ["don't <|endoftext|>'s 've"]
    for text in texts:
        assert tokens.of(text).tolist() == [*plain.encode(text, add_special_tokens=False).ids, 0]
    other = packing.Tokens(public_tokenizers.path("word_bpe_49k.json"))  # not byte-level as a whole: read by its own library
    assert other.of("Two words").tolist() == [*Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode("Two words", add_special_tokens=False).ids, 0]


def whole_again(found, docs, window):
    """Checks a packing piece by piece against the tokenizer; sequences' lengths."""
    plain = Tokenizer.from_file(VOCABULARY)
    pieces, lengths = {}, {}
    for r in found.collect():
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], tuple(r["ids"])))
        lengths.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for parts in lengths.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= window
    for r in docs.select("doc_id", "text").collect():
        ids = tuple([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0])
        own, at = pieces[(r["doc_id"], len(ids))], 0
        while at < len(ids):  # repeated rows have pieces of their own
            piece = next(x for x in own if x[0] == at and x[1] == ids[at : at + len(x[1])])
            own.remove(piece)
            at += len(piece[1])
    assert not any(pieces.values())
    return [sum(n for _, n in parts) for parts in lengths.values()]


@pytest.mark.parametrize(("window", "block", "shred"), [(1024, 4096, 4), (64, 5, 1), (100, 3, 8)])
def test_packing(docs, window, block, shred):
    found = packing.pack(docs, VOCABULARY, window, block, shred)
    lengths = whole_again(found, docs, window)
    odd = [n for n in lengths if n <= window - shred]
    assert all(n & (n - 1) == 0 for n in odd) and len(odd) <= 3 * window.bit_length()
    total = packing.padding(found, window).first()
    assert (total["sequences"], total["tokens"]) == (len(lengths), sum(lengths)) and total["padding"] <= (shred - 1) * len(lengths)
    assert packing.pack(docs.limit(0), VOCABULARY, window, block, shred).count() == 0


def test_packing_of_equal_lengths_leaves_no_room(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit(" a"), 599).alias("text"))
    found = packing.pack(docs, VOCABULARY, with_ids=False)
    assert "ids" not in found.columns and packing.padding(found).first()["padding"] == 0


def tree(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and of each leaf what stands beside it level by level."""
    sha = lambda xs: hashlib.sha256("".join(xs).encode()).hexdigest()
    nodes, paths, of = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(nodes) > 1:
        for leaf, at in enumerate(of):
            lo = at // 8 * 8
            paths[leaf].append(("".join(nodes[lo:at]), "".join(nodes[at + 1 : lo + 8])))
        nodes, of = [sha(nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [at // 8 for at in of]
    return nodes[0], paths


@pytest.mark.parametrize("height", [1, 4])
def test_manifest(spark, docs, height):
    more = spark.createDataFrame([(i, f"Text {i}", ["en", "fr", "zz"][0 if i % 10 else 1], "s", i, 1, "r", 2, "s") for i in range(100, 250)] + [(5000, "Alone", "one", "s", 1, 1, "r", 2, "s")], docs.schema)
    every = docs.unionByName(more)
    got = merkle.manifest(merkle.document_leaves(every), with_paths=True, height=height).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, text: sha("".join(map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))
    lower = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    groups: dict = {}
    for r in every.collect():
        bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None
        own = leaf(r, r["text"])
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, own, leaf(r, r["text"].translate(lower)) if bad else own, r["doc_id"]))
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    inner = {k: tree([x[2] for x in sorted(groups[k])]) for k in order}
    root, tops = tree([inner[k][0] for k in order])
    want = []
    for k, top in zip(order, tops, strict=True):
        for (_, _, own, altered, doc_id), path in zip(sorted(groups[k]), inner[k][1], strict=True):
            folded = altered
            for left, right in [*path, *top]:
                folded = sha(left + folded + right)
            want.append((doc_id, own, inner[k][0], root, sha("".join(a + b for a, b in [*path, *top])), folded, folded == root))
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted(want, key=str)
    assert any(not r["verified"] for r in got) and any(r["verified"] for r in got)
    for r in got:
        node = r["leaf"]
        for pair in r["path"]:
            node = sha(pair["left"] + node + pair["right"])
        assert node == root


def test_manifest_of_little(spark, docs):
    assert merkle.manifest(merkle.document_leaves(docs.limit(0))).count() == 0
    one = merkle.manifest(merkle.document_leaves(docs.where("doc_id = 3"))).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["verified"]
    assert one["proof_sha256"] == hashlib.sha256(b"").hexdigest()


def test_names_tell_thue_morse_strings_apart():
    """Complementary strings of two symbols have one name modulo 2^64."""
    bits = [0]
    while len(bits) < 4096:
        bits += [1 - b for b in bits]
    for n in (256, 512, 1024, 2048, 4096):
        a, b = (np.array([65 + (x ^ flip) for x in bits[:n]], np.uint8) for flip in (0, 1))
        first, second = (suffix_dedup.Names(x).of(np.array([0]), n)[0] for x in (a, b))
        assert first != second and first == suffix_dedup.Names(a).every(n)[0]


def test_repeats_in_texts_of_very_different_length(spark):
    """The synchronised position of a repeat does not depend on the text that it stands in."""
    rng = random.Random(2)
    passage = "".join(rng.choices("abcdefgh ", k=430))
    filler = lambda n: "".join(rng.choices("ijklmnopqrstuvw ", k=n))
    texts = {0: passage, 1: filler(50) + passage, 2: filler(200_000) + passage + filler(70_000), 3: filler(3000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.digest(suffix_dedup.repeated_spans(docs)).collect()}
    assert all(430 <= got[k] < 440 for k in (0, 1, 2)) and got[3] == 0


def test_long_tokens_are_read_in_linear_time():
    counts = toxicity.trigram_counts(Counter({"stupid": 50, "fine": 80, "words": 70}))
    model = toxicity.CharacterModel(counts)
    token = "st0pid4me" * 60_000
    began = time.perf_counter()
    assert len(model.restore(token)) > 100_000
    assert time.perf_counter() - began < 30
