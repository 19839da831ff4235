"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS head FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> head THEN head END AS refers_to
FROM g
"""

OP8 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(regexp_replace(text, '(<)(\\*)(\||/?s>)', '\1\\\2\3', 'g'), '(\[)(\\*)(/?INST\])', '\1\\\2\3', 'g') AS body,
  replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C') AS name FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(name) + 1 + length(body) + 11) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP9 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(x="coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(x="coalesce(text, '')")} AS w FROM benchmark),
n AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM n)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.s = iw.s),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, k)) AS j FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_RULES = {
    "length": ("n_words >= 80", "n_words < 50"),
    "word_length": ("m BETWEEN 3.5 AND 8.0", "m < 2.5 OR m > 14.0"),
    "symbols": ("n_symbols <= 0.01 * c", "n_symbols > 0.04 * c"),
    "marks": ("n_marks <= 0.01 * c", "n_marks > 0.05 * c"),
    "dup_lines": ("n_dup_lines <= 0.1 * greatest(n_lines, 1)", "n_dup_lines > 0.3 * n_lines"),
    "repeats": ("n_repeat_words <= 0.15 * w", "n_repeat_words > 0.4 * w"),
    "upper": ("n_upper <= 0.1 * c", "n_upper > 0.3 * c"),
    "letters": ("n_letters >= 0.85 * c", "n_letters < 0.65 * c"),
    "alpha_words": ("n_alpha >= 0.9 * w", "n_alpha < 0.8 * w"),
    "short_words": ("n_short >= 0.1 * w", "n_short < 0.02 * w"),
}


def _quality(rounds: int = 15) -> str:
    """Features, votes and expectation-maximisation over vote patterns, a round a pair of CTEs."""
    votes = ", ".join(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 ELSE -1 END AS v_{k}" for k, (good, bad) in _RULES.items())
    logit = "ln(prior / (1 - prior)) + " + " + ".join(f"CASE v_{k} WHEN 1 THEN ln(g_{k} / (1 - b_{k})) WHEN 0 THEN ln((1 - g_{k}) / b_{k}) ELSE 0 END" for k in _RULES)
    first = ", ".join(f"0.99::DOUBLE AS g_{k}, 0.3::DOUBLE AS b_{k}" for k in _RULES)
    good = {k: f"least(0.9995, greatest(0.6, (sum(CASE WHEN v_{k} = 1 THEN p * n ELSE 0 END) + 9.9) / (sum(CASE WHEN v_{k} >= 0 THEN p * n ELSE 0 END) + 10)))" for k in _RULES}
    bad = {k: f"least(0.99, greatest(0.05, (sum(CASE WHEN v_{k} = 0 THEN (1 - p) * n ELSE 0 END) + 3.0) / (sum(CASE WHEN v_{k} >= 0 THEN (1 - p) * n ELSE 0 END) + 10)))" for k in _RULES}
    means = ", ".join(f"{good[k]} AS g_{k}, greatest({bad[k]}, 1.02 - {good[k]}) AS b_{k}" for k in _RULES)
    em = ", ".join(
        f"e{i} AS MATERIALIZED (SELECT pat.*, 1 / (1 + exp(-({logit}))) AS p FROM pat, p{i - 1}), p{i} AS MATERIALIZED (SELECT least(0.99, greatest(0.05, sum(p * n) / sum(n))) AS prior, {means} FROM e{i})" for i in range(1, rounds + 1)
    )
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  len(l) AS n_lines, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS n_letters,
  len(list_filter(ws, lambda x: length(x) <= 3)) AS n_short, length(t) - length(translate(t, '!?', '')) AS n_marks, len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha
  FROM w LEFT JOIN cov USING (doc_id)),
v AS (SELECT *, {votes} FROM (SELECT *, greatest(n_words, 1) AS w, greatest(word_chars, 1) AS c, word_chars::DOUBLE / greatest(n_words, 1) AS m FROM f)),
pat AS MATERIALIZED (SELECT {", ".join(f"v_{k}" for k in _RULES)}, count(*) AS n FROM v GROUP BY ALL),
p0 AS MATERIALIZED (SELECT 0.8::DOUBLE AS prior, {first}), {em}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 1 / (1 + exp(-({logit}))) >= 0.5 AS kept
FROM v, p{rounds}
"""



def _merkle(levels: int = 7, tops: int = 3) -> str:
    """Trees of eight children level by level: up to 8^levels documents of a lang and 8^tops langs."""
    value = lambda x: f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || {x}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(value, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    crc = """4294967295 - list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT),
      lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"""
    parts = [
        f"d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf('text')} AS h, CASE WHEN doc_id IS NOT NULL AND ({crc}) % 3 = 0 THEN {leaf(_LOWER.format(x='text'))} END AS o FROM documents)",
        "a0 AS (SELECT doc_id, g, h, coalesce(o, h) AS f, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM d)",
    ]

    def climb(name: str, last: int) -> list[str]:
        """Nodes of each level, and of each node what stands left and right of it."""
        out = []
        for k in range(last):
            out.append(f"{name}b{k} AS (SELECT g, p // 8 AS b, n, list(h ORDER BY p) AS hs FROM {name}{k} GROUP BY g, p // 8, n)")
            out.append(f"{name}{k + 1} AS (SELECT g, b AS p, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {name}b{k})")
        return out

    parts += climb("a", levels)
    parts.append(f"t0 AS (SELECT 0 AS g, g AS name, h, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n FROM a{levels})")
    parts += climb("t", tops)
    state = "s0 AS (SELECT a0.doc_id, a0.h AS leaf, a0.g, a0.p, a0.f, '' AS proof FROM a0)"
    parts.append(state)
    step = "{x}.n > 1 THEN {then} ELSE {other} END"
    at = 0
    for name, last, key in (("a", levels, "s.g"), ("t", tops, "0")):
        if name == "t":
            parts.append(f"s{at + 1} AS (SELECT s.doc_id, s.leaf, s.g, t0.p, s.f, s.proof FROM s{at} s JOIN t0 ON t0.name = s.g)")
            at += 1
        for k in range(last):
            left, right = "array_to_string(x.hs[1:s.p % 8], '')", "array_to_string(x.hs[s.p % 8 + 2:], '')"
            up = step.format(x="x", then=f"sha256({left} || s.f || {right})", other="s.f")
            told = step.format(x="x", then=f"s.proof || {left} || {right}", other="s.proof")
            parts.append(f"s{at + 1} AS (SELECT s.doc_id, s.leaf, s.g, s.p // 8 AS p, CASE WHEN {up} AS f, CASE WHEN {told} AS proof FROM s{at} s JOIN {name}b{k} x ON x.g = {key} AND x.b = s.p // 8)")
            at += 1
    return "WITH " + ",\n".join(parts) + f"""
SELECT s.doc_id, s.leaf, t0.h AS subroot, r.h AS root, sha256(s.proof) AS proof_sha256, s.f AS folded_root, s.f = r.h AS verified
FROM s{at} s JOIN t0 ON t0.name = s.g, t{tops} r"""


ORACLES = {"op1_quality_rules": _quality(), "op4_warc": OP4, "op8_chat_format": OP8, "op9_decontaminate": OP9, "op13_merkle": _merkle()}
