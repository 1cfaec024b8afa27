"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .chat import KNOWN, MARKS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_RULES = rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
    windows AS (
        SELECT r, i, count(*) OVER (PARTITION BY r, g) AS times
        FROM (SELECT r, i, array_to_string(w[i:i+4], ' ') AS g
              FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d))),
    covered AS (
        SELECT r, sum(least(5, coalesce(next - i, 5)))::BIGINT AS n
        FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS next FROM windows WHERE times > 1) GROUP BY r),
    lines AS (
        SELECT r, sum(n - 1)::BIGINT AS dup, sum(n)::BIGINT AS n_lines
        FROM (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
              WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) GROUP BY r),
    m AS (
        SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
               len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
               coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
               len(w) < 10 OR 100 * coalesce(n, 0) > 20 * len(w) AS base_failed
        FROM d LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)),
    failed AS (
        SELECT source, rule, count(*) AS n, sum(f::INT) AS f FROM (
            SELECT source, 'base' AS rule, base_failed AS f FROM m
            UNION ALL SELECT source, 'symbols', n_symbols > 0.5 * n_words FROM m
            UNION ALL SELECT source, 'lines', n_dup_lines > 0.5 * n_lines FROM m) GROUP BY source, rule),
    moments AS (
        SELECT rule, sum(n) AS n, count(*) AS hosts, sum(f * f / n) AS square,
               least(greatest(sum(f) / sum(n), 0.5 / (sum(n) + 1)), 1 - 0.5 / (sum(n) + 1)) AS mean
        FROM failed GROUP BY rule),
    strengths AS (
        SELECT *, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 1), 1000) ELSE 1000 END AS strength
        FROM (SELECT *, square / n - mean * mean - mean * (1 - mean) * hosts / n AS spread FROM moments)),
    verdicts AS (
        SELECT source, bool_and((f + mean * strength) / (failed.n + strength) <= CASE rule WHEN 'base' THEN 0.8 ELSE 0.9 END) AS ok
        FROM failed JOIN strengths USING (rule) GROUP BY source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
    FROM m LEFT JOIN verdicts ON m.source IS NOT DISTINCT FROM verdicts.source
"""


def _quoted(mark: str) -> str:
    return mark.replace("'", "''")


_CONTROL = "|".join(MARKS)
_GROWTH = (
    rf"(list_sum(list_transform(regexp_extract_all(X, '\\*({_CONTROL})'), lambda m: 1 + length(regexp_extract(m, '^\\*')))))"
)
_KNOWN_CASE = " ".join(f"WHEN '{role}' THEN {len(mark)}" for role, mark in KNOWN.items())

_CHAT = rf"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
            SELECT conv_id, turn, role, text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')),
    t AS (
        SELECT *, length(text) + length('</turn>')
                  + coalesce({_GROWTH.replace("X", "text")}, 0) + length(regexp_extract(text, '\\*$'))
                  + CASE role {_KNOWN_CASE}
                    ELSE length('### Role:') + length(role) + length('</role>')
                         + coalesce({_GROWTH.replace("X", "role")}, 0) + length(regexp_extract(role, '\\*$')) END AS shown
        FROM c)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(shown)::BIGINT AS formatted_chars
    FROM t GROUP BY conv_id
"""

_RUNS = rf"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    windows AS (
        SELECT doc_id, i, count(*) OVER (PARTITION BY md5_number(array_to_string(w[i:i+34], ' '))) > 1 AS again
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM windows WHERE again),
    kept AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS y, count(*) AS n
        FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(y, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)
"""

_PHRASES = r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents),
    worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
    phrases AS (
        SELECT lang, size, phrase, count(*) AS a FROM (
            SELECT lang, size, array_to_string(w[i:i+size-1], ' ') AS phrase
            FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM worded, range(1, 6) AS s(size)))
        GROUP BY lang, size, phrase HAVING count(*) >= 100),
    cuts AS (
        SELECT lang, size, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k+1:size], ' ') AS y
        FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM phrases WHERE size > 1)),
    scored AS (
        SELECT lang, size, phrase, a, l, r, n, (1000::HUGEINT * a * n // (l::HUGEINT * r))::BIGINT AS score, k
        FROM cuts JOIN (SELECT lang, phrase AS x, a AS l FROM phrases) USING (lang, x)
                  JOIN (SELECT lang, phrase AS y, a AS r FROM phrases) USING (lang, y) JOIN totals USING (lang)),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (
        SELECT lang, array_to_string(w[i:i+k-1], ' ') AS phrase, max(a) AS times
        FROM (SELECT lang, a, w, k, unnest(range(1, size - k + 2)) AS i
              FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(2, size)) AS k FROM phrases WHERE size > 2))
        GROUP BY ALL)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE times IS NULL OR 100 * times < 100 * a
    QUALIFY rank <= 2000
"""

ORACLES = {
    "op6_quality_rules": _RULES,
    "op7_chat_formatting": _CHAT,
    "op9_substring_dedup": _RUNS,
    "op11_phrase_collocations": _PHRASES,
}
