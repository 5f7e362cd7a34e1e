"""SQL twins of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

from tidemill.llm.host_rules import Rules
from tidemill.llm.sharding import ROUNDS

BLANK = r"[ \t\n\x0b\f\r]"
WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{BLANK}+'), lambda x: x <> '')"


def host_rules(rules: Rules = Rules()) -> str:
    return f"""WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, {WORDS} AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{BLANK}+', '', 'g') <> '') AS ls FROM documents),
win AS (SELECT doc_id, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS k FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, unnest([0, 1, 2]) AS o(j) GROUP BY doc_id),
c AS (SELECT w.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
f AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
    100 * n_symbols > {rules.symbol_percent} * n_words OR 100 * n_dup_lines > {rules.dup_line_percent} * n_words AS soft_failed FROM c),
h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (WHERE base_failed OR soft_failed)::DOUBLE AS k FROM f GROUP BY source),
p AS (SELECT sum(k) / sum(n) AS m, (sum(k * k / n) - sum(k) * sum(k) / sum(n) - (count(*) - 1) * (sum(k) / sum(n)) * (1 - sum(k) / sum(n)))
    / nullif(sum(n) - sum(n * n) / sum(n), 0) AS spread FROM h),
q AS (SELECT m, CASE WHEN spread > 0 THEN greatest(m * (1 - m) / spread - 1, 0) END AS weight FROM p),
r AS (SELECT source, rate, coalesce((rate - m) / nullif(sqrt(m * (1 - m) / (weight + 1)), 0), 0) AS margin
  FROM (SELECT source, m, weight, CASE WHEN weight IS NULL THEN m ELSE (k + weight * m) / (n + weight) END AS rate FROM h, q))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (margin >= {rules.host_margin} AND rate > {rules.host_limit}) AND NOT (soft_failed AND margin >= {rules.watch_margin}) AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source"""


def _pass(source: str, seed: int) -> str:
    """One pass of the network over column x of a relation that also has l, r and total."""
    for turn in range(ROUNDS):
        a, b, moved, width = ("x // r", "x % r", "b", "l") if turn % 2 == 0 else ("x // r", "x % r", "a", "r")
        noise = f"('0x' || substr(md5(concat_ws('|', {seed}, {turn}, {moved})), 1, 12))::BIGINT % {width}"
        new = f"(a + {noise}) % l * r + b" if turn % 2 == 0 else f"a * r + (b + {noise}) % r"
        source = f"(SELECT * EXCLUDE (x, a, b), {new} AS x FROM (SELECT *, {a} AS a, {b} AS b FROM {source}))"
    return source


def shards(count: int, seed: int = 0) -> str:
    return f"""WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, n + 8 AS size, xor(list_reduce(list_prepend(4294967295, list_transform(range(n), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, t),
g AS (SELECT total, l, (total + l - 1) // l AS r FROM (SELECT count(*) AS total, floor(sqrt(greatest(count(*) - 1, 0)))::BIGINT + 1 AS l FROM s)),
n AS (SELECT s.*, total, l, r, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS x FROM s, g),
walk AS (SELECT doc_id, size, text_crc32, total, l, r, x FROM {_pass("n", seed)}
  UNION ALL SELECT doc_id, size, text_crc32, total, l, r, x FROM {_pass("(SELECT * FROM walk WHERE x >= total)", seed)})
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (x % {count})::INTEGER AS shard, (x // {count})::BIGINT AS slot,
  NULL::INTEGER AS grown_shard FROM walk WHERE x < total"""


def articles() -> str:
    """The article of each page, for pages that mark it: blocks are what stands between tags of block elements."""
    named = {"quot": '"', "lt": "<", "gt": ">", "copy": "©", "middot": "·"}
    text = "regexp_replace(b, '<[^>]*(>|$)', ' ', 'g')"
    for name, sign in named.items():
        text = f"regexp_replace({text}, '&{name};?', '{sign}', 'g')"
    text = f"trim(regexp_replace(regexp_replace({text}, '&amp;?', '&', 'g'), '{BLANK}+', ' ', 'g'))"
    return f"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS h FROM pages),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(string_split_regex(h, '</?(p|h1)>'), lambda b: {text}), lambda b: b <> ''), chr(10) || chr(10)) AS text FROM a)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t"""


def ranked(k: int = 50) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    terms = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {terms} AS ts FROM documents),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS total FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest({terms}) AS t FROM benchmark),
p AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(ts)::BIGINT AS n, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, n, t),
w AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total))))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN w USING (t), s GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= {k}"""
