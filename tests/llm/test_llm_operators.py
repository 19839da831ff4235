"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import io
import random
import re
import zlib
from collections import Counter

import ahocorasick
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinetrack.llm import chat_format, components, decontaminate, language_id, lm_trie, mixing, quality_rules, simhash, suffix_dedup, toxicity, warc
from kinetrack.llm.elias_fano import EliasFano
from kinetrack.llm.queries import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
RNG = random.Random(5)
SYLLABLES = "ka lo mi ren tu sha pel dor vin gat".split()


def prose(n: int, rng: random.Random = RNG) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


BASE = prose(150)
TEXTS = [
    None, "", " \n\t ", "one", "Two words", BASE, BASE, BASE.replace("ka", "KA", 1), prose(120) + "\n" + BASE[:500] + "\n" + prose(60), "a b a b a b a b a b", "# * $ %% | " * 30,
    "same line here\n" * 40, prose(90) + " " + BASE[100:560], "x" * 30_000, prose(3000), "ÄÖ é ñandú über " * 30,
]


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names clash with what operators add, and a repeated row
    rows = [(i, t, "en", "src", 1.0, "q", 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, lang string, source string, score double, kept string, component_id int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_quality_rules(docs, none):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        text = TEXTS[r["doc_id"]] or ""
        words = WORD.findall(text)
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        cover = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover))
        assert want == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert r["base_failed"] == (len(words) < 50 or 100 * len(cover) > 50 * len(words)) and not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(none).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and {5, 14} <= {r["doc_id"] for r in kept.collect()}


def test_label_model_finds_accuracies(spark):
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.85
    rates = {"a": (0.98, 0.7), "b": (0.95, 0.5), "c": (0.9, 0.3), "d": (0.97, 0.6), "e": (0.99, 0.4)}
    votes = {k: np.where(rng.random(4000) < 0.2, -1, np.where(truth, rng.random(4000) < g, rng.random(4000) >= b)).astype(int) for k, (g, b) in rates.items()}
    patterns = spark.createDataFrame([(*map(int, r),) for r in zip(*votes.values())], ", ".join(f"{k} int" for k in rates)).groupBy(*rates).agg(F.count("*").alias("n"))
    model = quality_rules.fit_label_model(patterns, list(rates), rounds=40)
    assert abs(model.prior - 0.85) < 0.08 and all(abs(model.accuracies[k][0] - rates[k][0]) < 0.08 for k in rates)


@pytest.mark.parametrize("size", [20, 60])
def test_suffix_dedup(docs, none, size):
    rows = [(i, (t or "").encode()) for i, t in enumerate(TEXTS)] + [(5, BASE.encode())]
    want = {}
    for (i, t), spans in zip(rows, suffix_dedup.brute_force([t for _, t in rows], size), strict=True):
        edge = [0, *(x for s in spans for x in s), len(t)]
        want[i] = (len(t), [tuple(s) for s in spans], b"".join(t[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True)))
    got = suffix_dedup.repeated_spans(docs, size).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) == want[r["doc_id"]]
    assert suffix_dedup.repeated_spans(none, size).count() == 0
    carried = suffix_dedup.repeated_spans(docs, size, ["lang", "kept"]).collect()
    assert all(r["carried"]["kept"] == "q" and r["text"].encode() is not None for r in carried)


def test_suffix_dedup_without_ids(spark):
    df = spark.createDataFrame([(None, BASE), (None, BASE + "x"), (3, "short")], "doc_id long, text string")
    got = {(r["doc_id"], r["n_bytes"]): len(r["spans"]) for r in suffix_dedup.repeated_spans(df, 100).collect()}
    assert got == {(None, len(BASE)): 1, (None, len(BASE) + 1): 1, (3, 5): 0}


def test_language_id(spark, none):
    sets = {"aa": "ka lo mi ren tu".split(), "bb": "sha pel dor vin gat".split()}
    rows = []
    for i in range(60):
        lang = ("aa", "bb")[i % 2]
        rows.append((i, " ".join("".join(RNG.choices(sets[lang], k=2)) for _ in range(40)), None if i == 7 else lang))
    train = spark.createDataFrame(rows[:40], "doc_id long, text string, lang string")
    languages, p = language_id.train(train)
    assert languages == ["aa", "bb"] and np.allclose(p.sum(axis=0), 1, atol=1e-5)
    test = spark.createDataFrame([(i, t) for i, t, _ in rows[40:]] + [(100, None), (101, ""), (102, "123 !!"), (103, "k" * 5000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.identify(test, languages, p).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[40:]) and all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and got[103]["lang_pred"] in languages
    languages, p = language_id.train(none)
    assert {r["lang_pred"] for r in language_id.identify(test, languages, p).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    pieces = ["▁a", "▁ab", "b", "bc", "c", "▁"]
    p = np.array([[0.3], [0.2], [0.1], [0.15], [0.2], [0.05]])
    by = dict(zip(pieces, p[:, 0], strict=True))

    def brute(s):
        return 1.0 if not s else sum((by.get(s[:k], language_id.FLOOR if k == 1 else 0)) * brute(s[k:]) for k in range(1, len(s) + 1))

    lattice = language_id.Lattice(pieces, p)
    for w in ("abc", "b", "cab", "zz", "abc" * 4, "cabbc" * 7 + "z"):  # shorter and longer than any former limit
        got = lattice.log_probability([w])[0, 0]
        if len(w) < 20:
            assert got == pytest.approx(np.log(brute("▁" + w)))
        else:
            assert -np.inf < got < 0


def test_expected_pieces_equal_all_segmentations():
    pieces = ["▁a", "▁ab", "b", "bc", "c", "▁"]
    p = np.array([[0.3, 0.1], [0.2, 0.2], [0.1, 0.3], [0.15, 0.2], [0.2, 0.1], [0.05, 0.1]])
    words, language, count = ["abc", "b", "abcbc", "cz"], np.array([0, 1, 1, 0]), np.array([2.0, 1.0, 3.0, 1.0])

    def all_of(s):
        return [[]] if not s else [[s[:k], *rest] for k in range(1, len(s) + 1) if k == 1 or s[:k] in pieces for rest in all_of(s[k:])]

    want, likelihood = np.zeros(p.shape), 0.0
    for w, lang, c in zip(words, language, count, strict=True):
        weighed = [(s, np.prod([p[pieces.index(x), lang] if x in pieces else language_id.FLOOR for x in s])) for s in all_of("▁" + w)]
        total = sum(x for _, x in weighed)
        likelihood += c * np.log(total)
        for s, x in weighed:
            for piece in s:
                if piece in pieces:
                    want[pieces.index(piece), lang] += c * x / total
    got, gained = language_id.Lattice(pieces, p).expected(words, language, count)
    assert np.allclose(got, want) and gained == pytest.approx(likelihood)


def test_language_pieces_of_any_length():
    pieces = ["▁", "internationalization", "a"]
    p = np.array([[0.5], [0.4], [0.1]])
    got = language_id.Lattice(pieces, p).log_probability(["internationalization" * 3])[0, 0]
    assert got == pytest.approx(np.log(0.5 * 0.4**3), abs=1e-6)


def test_null_and_split_benchmark_items(spark):
    words = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(None, words), (4, words), (5, "short one"), (6, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {words} after, short ONE", "x"), (1, f"before {words} after, short ONE", "x"), (None, "nothing", "y"), (3, None, "z")], "doc_id long, text string, contamination string")
    whole = decontaminate.with_contamination(docs, items)
    parts = decontaminate.with_contamination(docs, items, block_bytes=20)
    shape = lambda df: sorted((str(r["doc_id"]), r["contamination"]["n_hit"], r["contamination"]["item_ids"], [tuple(s) for s in r["contamination"]["spans"]]) for r in df.collect())
    assert shape(whole) == shape(parts) and [x[1] for x in shape(whole)] == [14, 14, 0, 0]
    assert shape(whole)[0][2] == ["4", "5"]


def test_simhash_null_and_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(5, a), (None, a), (5, b), (7, b), (None, "c d e f g"), (None, "c d e f g")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted([("5", "5"), ("None", "5"), ("5", "5"), ("7", "5"), ("None", "None"), ("None", "None")])


def test_quality_keeps_columns_of_any_name(spark):
    good = " ".join(f"{x}{y}" for x in "walk talk find keep more".split() for y in "ing ed er est ly ness ful able ment ish ity ous al ive ation ure ance".split())
    docs = spark.createDataFrame([(1, good, "x", "y"), (None, good + " more", "x", "y")], "doc_id long, text string, q_id string, q_text string")
    got = quality_rules.keep_good(docs, threshold=0.0)
    assert got.columns == docs.columns and got.count() == docs.count()


def test_warc(spark):
    big, other = "<p>é" + "x" * 2000, "y" * 1500
    rows = [(1, "u1", big), (9, "u9", big), (4, "u4", big), (5, "u5", other), (6, None, None), (7, "u", "tiny"), (8, "u", "tiny"), (9, "again", big), (None, "n", other)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.archive(pages)
    got = warc.read_records(index).collect()
    assert len(got) == len(rows)
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == Counter({(1, "revisit", 9): 1, (4, "revisit", 9): 1, (9, "response", None): 1, (9, "revisit", 9): 1, (5, "response", None): 1, (6, "response", None): 1, (7, "response", None): 1, (8, "response", None): 1, (None, "revisit", 5): 1})
    for r in got:
        assert r["payload_digest"] in {hashlib.sha1((h or "").encode()).hexdigest() for _, _, h in rows}
        assert r["record_type"] == "revisit" or hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"]
    assert warc.read_records(warc.archive(pages.limit(0))).count() == 0


def test_warc_normaliser_inflates_any_gzip():
    raw = [warc.record(i, "u", b"payload" * i, None, False, "d") for i in range(50)]
    whole = zlib.compressobj(6, zlib.DEFLATED, 31)
    mono = whole.compress(b"".join(raw)) + whole.flush()
    members = b"".join((z := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(x) + z.flush() for x in raw)
    for data in (mono, members):
        for chunk in (7, 1 << 20):
            assert list(warc.records_of(io.BytesIO(data), chunk)) == raw
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(mono[:-200] if len(mono) > 400 else mono[:50])))


@pytest.mark.parametrize("n,top", [(0, 10), (1, 2**64 - 1), (1000, 1500), (20_000, 2**64 - 1), (5000, 10**9)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, top, n, np.uint64, endpoint=True))
    e = EliasFano.of(v)
    q = rng.integers(0, top, 2000, np.uint64, endpoint=True)
    at = np.searchsorted(v, q)
    found = np.where((at < len(v)) & (v[np.minimum(at, max(len(v) - 1, 0))] == q), at, -1) if len(v) else np.full(2000, -1)
    assert (e.find(q) == found).all()
    if len(v):
        assert (e.access(np.arange(len(v))) == v).all() and (e.successor(q) == at).all() and (e.find(v) == np.arange(len(v))).all()


def test_lm_trie(docs, none):
    trie = lm_trie.train(docs, piece=64, min_count=2, order=2)
    tokens = [[*WORD.findall((t or "").translate(LOWER)), None] for t in [*TEXTS, BASE]]
    c = Counter(w for t in tokens for w in t)
    pairs = Counter(p for t in tokens for p in zip(["<s>", *t], t))
    kept = {p: n for p, n in pairs.items() if n > 1}
    mass = Counter()
    for (u, _), n in kept.items():
        mass[u] += n - lm_trie.DISCOUNT
    big, types = sum(c.values()), len(c)
    total = lambda u: len(tokens) if u == "<s>" else c[u]
    for r in lm_trie.score(docs, trie).collect():
        t = tokens[r["doc_id"]]
        single = lambda w: (c[w] + 1) / (big + types + 1)
        base = sum(np.log10(single(w)) for w in t)
        full = sum(np.log10(max(kept.get((u, w), 0) - lm_trie.DISCOUNT, 0) / total(u) + (1 - mass[u] / total(u)) * single(w)) for u, w in zip(["<s>", *t], t))
        assert (r["n_tokens"], r["n_known"]) == (len(t), len(t)) and r["base_score"] == pytest.approx(base) and abs(r["score"] - full) <= 2e-4 * len(t)
    # each context's probabilities sum to one, over the words and one unknown word
    words = np.array(sorted({x for t in tokens for x in t if x} ), object)
    assert trie.types == len(words) + 1 and trie.tokens == big
    empty = lm_trie.score(docs, lm_trie.train(none)).collect()
    assert all(r["n_known"] == 0 and r["base_score"] == 0 for r in empty)


def test_lm_trie_parts_and_pieces_do_not_change_scores(spark):
    """A context that most tokens stand in is spread over many pieces; its weight is put together again."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, prose(80, rng) + " the the " * 20) for i in range(80)], "doc_id long, text string")
    whole, cut = lm_trie.train(docs), lm_trie.train(docs, piece=37)
    assert len(whole.children.files) == 1 and len(cut.children.files) > 20 < len(cut.triples.files)
    a, b = ({r["doc_id"]: tuple(r) for r in lm_trie.score(docs, t).collect()} for t in (whole, cut))
    assert all(a[i][:4] == b[i][:4] and abs(a[i][4] - b[i][4]) <= 2e-4 * a[i][1] for i in a) and len(a) == len(b) == 80


def test_lm_trie_query_keeps_single_pairs_and_triples(spark, tmp_path):
    rng = random.Random(7)
    texts = [(i, prose(60, rng)) for i in range(60)] + [(60, None), (61, ""), (None, "one two three one two four")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    split = lambda t: [*WORD.findall((t or "").translate(LOWER)), None]
    tokens = [split(t) for i, t in texts if not held(i)]
    one, d = Counter(w for t in tokens for w in t), lm_trie.DISCOUNT
    two, three = (Counter(g for t in tokens for g in zip(*(["<s>", *t][k:] for k in range(n)))) for n in (2, 3))
    follows = {n: Counter(g[:-1] for g in c) for n, c in ((2, two), (3, three))}
    total = Counter({("<s>",): len(tokens)}) + Counter({(w,): n for w, n in one.items()})
    p1 = lambda w: (one[w] + 1) / (sum(one.values()) + len(one) + 1)
    more = lambda n, c, g, size, low: low if not follows[n][g[:-1]] else (max(c[g] - d, 0) + d * follows[n][g[:-1]] * low) / size[g[:-1]]
    got = {r["doc_id"]: r for r in queries()["op5_lm_trie"](spark, str(tmp_path)).collect()}
    assert any(held(i) for i, _ in texts) and min(two.values()) == 1
    for i, text in texts:
        t, full = ["<s>", *split(text)], 0.0
        for k in range(1, len(t)):
            low = more(2, two, (t[k - 1], t[k]), total, p1(t[k]))
            full += np.log10(more(3, three, (t[k - 2], t[k - 1], t[k]), two, low) if k > 1 else low)
        assert got[i]["held_out"] == held(i) and abs(got[i]["score"] - full) <= 4e-4 * len(t)


def test_mixing(spark):
    rows, labels = [], []
    for i in range(240):
        kind = "clean" if i % 4 else ("toxic" if i % 8 else "low")
        extra = {"clean": "", "toxic": " scum moron" * 3, "low": " ### |||" * 20}[kind]
        rows.append((i, prose(40) + extra))
        labels.append((i, int(kind != "low"), int(kind == "toxic")))
    docs = spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (0, None, None)], "doc_id long, quality int, toxic int")
    targets = {"clean": 0.9, "low": 0.05, "toxic": 0.05}
    got = mixing.mix(docs, marks, targets, rounds=60).toPandas()
    assert len(got) == 242 and (got.rate >= 0).all() and (got[got.n_tokens == 0].rate == 1).all()
    p = got[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1)
    share = (got.rate * got.n_tokens).to_numpy() @ p
    assert np.allclose(share / share.sum(), [0.9, 0.05, 0.05], atol=0.01)
    # the fold over residuals is plain projected gradient
    live = got[got.n_tokens > 0]
    t, q = live.n_tokens.to_numpy(float), live[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    goal = np.array([targets[d] for d in mixing.DOMAINS])
    start = t @ q
    budget = mixing.HEADROOM * start[0] / goal[0]
    scale, r = np.maximum.reduce([start / budget, goal, np.full(3, 1e-3)]), np.ones(len(t))
    last = None
    for _ in range(60):
        e = (r * t) @ q / budget - goal
        if np.abs(e).max() < 1e-4 or (last is not None and np.abs(e - last).max() < 1e-5):
            break
        last = e
        r = np.maximum(0, r - (q @ (e / scale) + 1e-3 * (r - 1)) / (1 + 1e-3))
    assert np.allclose(np.sort(r), np.sort(live.rate.to_numpy()), atol=1e-6)
    assert mixing.mix(docs.limit(0), marks).count() == 0 and mixing.mix(docs, marks.limit(0)).count() == 242


@pytest.mark.parametrize("each", [1, 5])
def test_mixing_meets_shares_of_rare_domains(spark, each):
    """Production targets and rounds, on domains of 0.1 and 0.5 % of the tokens."""
    rare = {"low": [0.0, 1.0, 0.0], "toxic": [0.0, 0.0, 1.0]}
    rows = [(100, rare["low" if i < each else "toxic"] if i < 2 * each else [1.0, 0.0, 0.0]) for i in range(1000)]
    table = spark.createDataFrame(rows, "n_tokens long, p array<double>").withColumn("doc_id", F.monotonically_increasing_id())
    with pytest.MonkeyPatch.context() as m:
        m.setattr(mixing, "fit_classifier", lambda *a: ())
        m.setattr(mixing, "posteriors", lambda docs: docs)
        got = mixing.mix(table, None).toPandas()
    share = (got.rate * got.n_tokens).to_numpy() @ got[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    assert np.allclose(share / share.sum(), list(mixing.TARGETS.values()), atol=5e-4) and (got.rate >= 0).all()


def test_mixing_reports_shares_that_cannot_be_met(spark):
    table = spark.createDataFrame([(100, [0.98, 0.01, 0.01])] * 50, "n_tokens long, p array<double>")
    with pytest.warns(UserWarning, match="off their targets"):
        mixing.fit_rates(table, mixing.TARGETS)


def test_toxicity(spark):
    bad = ["moron", "scumbag", "idiot"]
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        rows.append((i, prose(40) + (" " + RNG.choice(bad) if toxic else "")))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows[:250], (900, None)], "doc_id long, text string")
    marks = spark.createDataFrame([*labels[:250], (1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks, support=3)
    test = [(1, "you m0r0n there"), (2, "what an i d i o t"), (3, "scuuuumbag!"), (4, "s.c.u.m.b.a.g"), (5, prose(60)), (6, None), (7, ""), (8, "a " * 400), (9, "1d10t"), (10, "x" * 20_000 + "4" * 5000)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(test, "doc_id long, text string"), model).collect()}
    assert all(got[i] >= 0.5 for i in (1, 2, 3, 4, 9)), got
    assert all(got[i] < 0.5 for i in (5, 6, 7, 8, 10)), got
    assert set(r["score"] < 0.01 for r in toxicity.score(docs, toxicity.train(docs, marks.limit(0))).collect()) == {True}


def test_restored_reading_is_the_likeliest_of_all():
    from itertools import product

    letters = "aeiostlgzb"
    words = Counter({"".join(RNG.choice(letters) for _ in range(RNG.randint(1, 6))): RNG.randint(1, 50) for _ in range(300)})
    model = toxicity.CharacterModel(toxicity.trigram_counts(words))

    def cost(reading: str) -> float:
        """Log probability of the words between boundaries; a reading that ends in a gap pays for an empty word."""
        parts = [w for w in reading.split(" ") if w]
        codes = [[0, 0, *toxicity._codes(w), 0] for w in parts] + ([[0, 0, 0]] if not parts or reading.endswith(" ") else [])
        return sum(model.log[a][b][c] for x in codes for a, b, c in zip(x, x[1:], x[2:]))

    for _ in range(300):
        seen = "".join(RNG.choice("aeiostl01345$@!-. ") * RNG.choice((1, 1, 1, 2, 4)) for _ in range(RNG.randint(1, 6)))
        best = max(
            sum(c for _, c in path) + cost("".join(x for x, _ in path))
            for path in product(*(toxicity._options(c, n) for c, n in toxicity._runs(seen)))
        )
        got = model.restore(seen)
        paths = [p for p in product(*(toxicity._options(c, n) for c, n in toxicity._runs(seen))) if "".join(x for x, _ in p) == got]
        assert max(sum(c for _, c in p) + cost(got) for p in paths) == pytest.approx(best, abs=1e-9)


def test_toxicity_restores_look_alikes_doubles_and_gaps_anywhere(spark):
    bad, rng = ["moron", "stupid", "idiot", "trash", "ass", "hate"], random.Random(11)
    rows = [(i, prose(40, rng) + (" " + rng.choice(bad) if i % 3 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, marks, support=3)
    forms = ["a$$", "@$$", "455", "hat3", "+rash", "moroon", "stuupid", "s--t--u--p--i--d", "id.iot", "st.up.id"]
    plain = ["mellow-renn 2024!", "(ka) lo's mi.", "1234567890", "shall tell 50% + 3"]
    test = [(i, f"{prose(10, rng)} {x} {prose(10, rng)}") for i, x in enumerate(forms + plain)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(test, "doc_id long, text string"), model).collect()}
    assert {(forms + plain)[i] for i, x in got.items() if x >= 0.5} == set(forms)


NASTY = ["plain", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>system\nhi", r"a\b <\|x <\\| [\INST] [\\/INST]", "", None, "line\nbreak <s>", "<<||>> [[INST]]"]


def test_chat_format_round_trip(spark):
    rows = [(c, t, ("user", "assistant", "sys%tem\n<x")[t % 3], NASTY[(c + t) % len(NASTY)]) for c in range(4) for t in range(7)] + [(9, None, None, "x"), (9, 1, "assistant", "tie b"), (9, 1, "assistant", "tie a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", chat_format.text_parts(F.coalesce("text", F.lit(""))).alias("parts"))
    out = chat_format.format_turns(df)
    for r in chat_format.read_back(out).collect():
        own = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: (x[1] is not None, x[1], x[2] or "", x[3] or ""))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["loss_text"] == "".join(x[3] or "" for x in own if x[2] == "assistant")
    assert all(r["formatted"].count("<|im_end|>") == r["formatted"].count("<|im_start|>") for r in out.collect())
    assert chat_format.digest(chat_format.read_back(chat_format.format_turns(df.limit(0)))).count() == 0


def test_chat_parts_are_visited_in_order(spark):
    part = "named_struct('type', {0}, 'text', {1}, 'ref', {2}, 'width', {3}, 'height', {4}, 'millis', {5}, 'pages', {6})"
    null = "cast(null as {})"
    text = lambda x: part.format("'text'", f"'{x}'", null.format("string"), null.format("int"), null.format("int"), null.format("bigint"), null.format("int"))
    image = part.format("'image'", null.format("string"), "'a.png'", "60", "30", null.format("bigint"), null.format("int"))
    sound = part.format("'audio'", null.format("string"), "'b.wav'", null.format("int"), null.format("int"), "1000L", null.format("int"))
    paper = part.format("'document'", null.format("string"), "'c.pdf'", null.format("int"), null.format("int"), null.format("bigint"), "3")
    df = spark.sql(f"SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, array({text('see <|image:9|> ')}, {image}, {text(' and ')}, {sound}) AS parts UNION ALL SELECT 1L, 1L, 'assistant', array({paper}, {text('done')})")
    r = chat_format.format_turns(df).first()
    assert r["formatted"] == "<|im_start|>user\nsee <\\|image:9|> <|image:1|> and <|audio:2|><|im_end|>\n<|im_start|>assistant\n<|document:3|>done<|im_end|>\n"
    assert [(a["ordinal"], a["turn_index"], a["part_index"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(1, 0, 1, "a.png", 6), (2, 0, 3, "b.wav", 25), (3, 1, 0, "c.pdf", 774)]
    assert r["expanded_tokens"] == 805


def test_decontaminate(spark, docs, none):
    items = [(1, prose(14)), (2, "Only four WORDS here"), (3, None), (4, "..."), (1, prose(11)), (12, "é über straße 5")]
    w1 = re.findall(decontaminate.WORD, items[0][1].translate(LOWER))
    hay = [(0, "x " + ", ".join(w1[2:13]).upper() + " y"), (1, "only-four words; HERE! only four words here"), (2, "É über straße 5 / é ÜBER straße 5 é über straße 5"), (3, None), (4, " ".join(w1[:9]))]
    df = spark.createDataFrame([(i, t, 1) for i, t in hay], "doc_id long, text string, contamination int")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert (got[0]["n_hit"], got[0]["item_ids"]) == (11, ["1"]) and (got[1]["n_hit"], got[1]["item_ids"]) == (8, ["2"])
    assert (got[2]["n_words"], got[2]["n_hit"], got[2]["item_ids"]) == (12, 4, ["12"]) and (got[3]["n_words"], got[4]["n_hit"]) == (0, 0)
    assert [hay[1][1][s["start"] : s["end"]] for s in got[1]["spans"]] == [hay[1][1].rstrip(".")]
    kept = decontaminate.with_contamination(df, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == ["doc_id", "text", "contamination"] and kept.count() == 5
    assert decontaminate.decontaminate(none, none.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    assert decontaminate.decontaminate(docs, none.select(F.col("doc_id").alias("item_id"), "text")).where("n_hit > 0").count() == 0
    assert decontaminate.redact("ab cd ef", [(3, 5)]) == "ab  ef" and isinstance(ahocorasick.Automaton, type)


def fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, none):
    prints = {i: fingerprint(t) for i, t in enumerate(TEXTS)}
    got = {r["doc_id"]: r for r in simhash.digest(simhash.near_duplicates(docs)).collect()}
    assert {i: f"{x:016x}" for i, x in prints.items()} == {i: r["fingerprint"] for i, r in got.items()}
    assert got[6]["component_id"] == 5 and got[1]["component_id"] == got[2]["component_id"] == 0
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("forest", [None, 4, 64])
def test_simhash_links_are_complete(spark, forest):
    rng = random.Random(11)
    centre = [rng.getrandbits(64) for _ in range(12)]
    values = {0, (1 << 64) - 1}
    for c in centre:
        for _ in range(60):
            values.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = {(a, b) if a < b else (b, a) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4}
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {(r["u"], r["v"]) for r in simhash.links(df, 4, forest).distinct().collect()}
    assert got <= want and (forest or got == want)
    assert partition(got, signed) == partition(want, signed)
    parts = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(sorted(got), "u long, v long")).collect()}
    for group in partition(want, signed):
        assert {parts.get(x, x) for x in group} == {min(group)}


def partition(links, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    out = {}
    for x in nodes:
        out.setdefault(find(x), set()).add(x)
    return sorted(map(frozenset, out.values()), key=min)


def test_components_of_chains_and_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 499), (499, 499), (7, 8)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.connected_components(chain).collect()}
    assert {got[i] for i in range(201)} == {0} and got[500] == got[499] == 499
    assert components.connected_components(chain.limit(0)).count() == 0
