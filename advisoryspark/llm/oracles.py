"""DuckDB SQL for the queries that SQL can express."""

from advisoryspark.llm import chat

_SPACE = r"[\x20\x09-\x0D]"

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               ((('0x' || substr(hex, (5 * (k // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (k % 4))::INT) & 31)::INT + 1, 1)),
        '') AS payload_digest,
    CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> last THEN last END AS refers_to
FROM r
"""

_CONTROL = "'</s>[INST] ok [/INST]'"
_ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\2\\\3', 'g')"

CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', {_CONTROL}), (-7, 1, 'assistant', {_CONTROL}))
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
    sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
    sum({len(chat.TURN + chat.BODY + chat.END)} + length({_ESCAPED.format('role')})
        + length({_ESCAPED.format('text')}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

_RULES = {
    "few_words": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "same_lines": "10 * n_dup_lines > 3 * n_lines",
}

QUALITY = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
    FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS k, words FROM d),
g AS (SELECT doc_id, k, array_to_string(words[k:k + 4], ' ') AS gram FROM w),
twice AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
hit AS (SELECT doc_id, count(DISTINCT k + o) AS n_repeat FROM twice, range(0, 5) o(o) GROUP BY doc_id),
f AS (SELECT d.doc_id, source, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat, 0)::BIGINT AS n_repeat_words
    FROM d LEFT JOIN hit USING (doc_id)),
h AS (SELECT source, count(*) AS n, {', '.join(f'sum(({c})::INT) AS k_{r}' for r, c in _RULES.items())}
    FROM f GROUP BY source),
m AS (SELECT {', '.join(f'avg(k_{r} / n) AS m_{r}, var_pop(k_{r} / n) AS v_{r}' for r in _RULES)} FROM h),
s AS (SELECT *, {', '.join(f'CASE WHEN v_{r} <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, m_{r} * (1 - m_{r}) / v_{r} - 1)) END AS s_{r}' for r in _RULES)} FROM m),
v AS (SELECT h.source, {' OR '.join(f'(k_{r} + m_{r} * s_{r}) / (n + s_{r}) > 0.5' for r in _RULES)} AS rejected FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT rejected AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
         "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATE = f"""
WITH b AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(words[k:k + least(10, len(words)) - 1], ' ') AS gram
    FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS k FROM b WHERE len(words) > 0)),
d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS k FROM d),
dw AS (SELECT doc_id, k, n, array_to_string(words[k:k + n - 1], ' ') AS gram
    FROM p, (SELECT DISTINCT n FROM bw) WHERE k + n - 1 <= len(words)),
found AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.gram = bw.gram),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM found)
    GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLES = {"op3_warc": WARC, "op4_chat": CHAT, "op5_quality": QUALITY, "op10_decontaminate": DECONTAMINATE}
