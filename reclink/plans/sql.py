"""Pieces of DuckDB SQL from which the queries' oracles are put together."""

from __future__ import annotations

from reclink.functions import features as T
from reclink.functions import text as X
from reclink.functions.hashing import STOPWORDS


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def words(column: str) -> str:
    return f"regexp_extract_all(coalesce({column}, ''), {quoted(X.WORD)})"


def full(column: str, pattern: str) -> str:
    return f"regexp_full_match({column}, {quoted(pattern)})"


def valid(word: str) -> str:
    return f"regexp_matches({word}, '[A-Za-z0-9]')"


def replaced(column: str, rules: list[tuple[str, str]]) -> str:
    for pattern, by in rules:
        column = f"regexp_replace({column}, {quoted(pattern)}, {quoted(by.replace('$1', chr(92) + '1'))}, 'g')"
    return column


def classes(column: str, rules: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {full(column, p)} THEN {quoted(n)}" for n, p in rules) + f" ELSE {otherwise} END"


def simplified_hotel(column: str) -> str:
    return classes(column, T.HOTEL_CLASSES, column)


def simplified_citation(column: str) -> str:
    plain = replaced(f"lower({column})", [(r"\s+", " "), (r"\d", "1"), (r"[^a-z0-9\s()\[\]]+", "")])
    return classes(column, T.CITATION_CLASSES, f"CASE WHEN {plain} = '' THEN {column} ELSE {plain} END")


def plain(word: str) -> str:
    return f"regexp_replace(lower({word}), '[^a-z0-9]+', ' ', 'g')"


def phrase_string(list_: str) -> str:
    return f"array_to_string([{plain('w')} FOR w IN {list_}], ' ')"


def term_set(list_: str) -> str:
    return f"list_distinct([trim({plain('w')}) FOR w IN {list_} IF trim({plain('w')}) <> ''])"


def terms(list_: str) -> str:
    """Distinct words of the phrase string."""
    return f"list_distinct([t FOR t IN regexp_split_to_array({phrase_string(list_)}, '\\s+') IF t <> ''])"


def lower_valid(list_: str) -> str:
    return f"[lower(w) FOR w IN {list_} IF {valid('w')}]"


def grams(list_: str, size: int, i: str = "i") -> str:
    return f"[array_to_string(list_slice({list_}, {i}, {i} + {size - 1}), '#') FOR {i} IN range(1, len({list_}) - {size - 2})]"


def padded(list_: str, size: int) -> str:
    before, after = ("['$begin$']", "['$end$']") if size == 2 else ("['$begin2$', '$begin$']", "['$end$', '$end2$']")
    return f"list_concat(list_concat({before}, {list_}), {after})"


def title_tokens(list_: str) -> str:
    stop = "[" + ", ".join(map(quoted, sorted(STOPWORDS))) + "]"
    return f"[lower(w) FOR w IN {list_} IF length(lower(w)) > 1 AND NOT list_contains({stop}, lower(w))]"


def title_keys(tokens: str) -> str:
    """Keys of a column of title tokens."""
    triple = f"list_distinct(['$TRIPLE$=' || g FOR g IN {grams(tokens, 3)}])"
    return f"CASE len({tokens}) WHEN 0 THEN ['$EMPTY$'] WHEN 1 THEN ['$SINGLE$=' || {tokens}[1]] WHEN 2 THEN ['$DOUBLE$=' || array_to_string({tokens}, '#')] ELSE {triple} END"


MENTIONS = """m AS (SELECT d.doc_id AS mention_id, l.quality IS NOT NULL AS is_record, d.source, l.quality::VARCHAR AS true_cluster, d.text
    FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id))"""

PARTS = """mention AS (
    SELECT 'r' || p_partkey AS mention_id, TRUE AS is_record, p_partkey::VARCHAR AS true_cluster, list_concat(string_split(p_name, ' '), [p_brand, p_type]) AS words,
           list_concat([CASE WHEN i = 1 THEN 'B-name' ELSE 'I-name' END FOR i IN range(1, len(string_split(p_name, ' ')) + 1)], ['B-brand', 'B-type']) AS labels FROM part
    UNION ALL
    SELECT 't' || p_partkey, FALSE, p_partkey::VARCHAR, list_concat([lower(p_type), p_brand, 'with'], string_split(p_name, ' ')),
           list_concat(['B-type', 'B-brand', 'O'], [CASE WHEN i = 1 THEN 'B-name' ELSE 'I-name' END FOR i IN range(1, len(string_split(p_name, ' ')) + 1)]) FROM part)"""

PLACES = """mention AS (
    SELECT 'r' || n_nationkey AS mention_id, TRUE AS is_record, n_nationkey::VARCHAR AS true_cluster, list_concat(string_split(r_name, ' '), [n_name]) AS words,
           list_concat([CASE WHEN i = 1 THEN 'B-region' ELSE 'I-region' END FOR i IN range(1, len(string_split(r_name, ' ')) + 1)], ['B-nation']) AS labels
    FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL
    SELECT 't' || n_nationkey, FALSE, n_nationkey::VARCHAR, list_concat([n_name, 'in'], string_split(r_name, ' ')),
           list_concat(['B-nation', 'O'], [CASE WHEN i = 1 THEN 'B-region' ELSE 'I-region' END FOR i IN range(1, len(string_split(r_name, ' ')) + 1)])
    FROM nation JOIN region ON n_regionkey = r_regionkey)"""

#: Tokens of mentions: (mention_id, is_record, position, word, bio, label).
TOKENS = """token AS (SELECT mention_id, is_record, i - 1 AS position, words[i] AS word, labels[i] AS bio, regexp_replace(labels[i], '^[BI]-', '') AS label
    FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM mention))"""

PAGE_TOKENS = f"""part AS (SELECT page_id, regexp_extract_all(regexp_replace(html, {quoted(X.NOT_TEXT)}, ' ', 'g'), {quoted(X.TAG + '|' + X.HOTEL_LEXER)}) AS parts FROM pages),
    place AS (SELECT page_id, parts[i] AS part, i FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM part)),
    marked AS (SELECT *, {full('part', X.TAG)} AS is_tag,
        CASE WHEN part LIKE '</%' THEN 'O' ELSE lower(regexp_extract(part, '<([A-Za-z][A-Za-z0-9\\-]*)', 1)) END AS tag FROM place),
    labelled AS (SELECT page_id, i, part, is_tag,
        coalesce(last_value(CASE WHEN is_tag THEN tag END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i ROWS UNBOUNDED PRECEDING), 'O') AS label FROM marked),
    numbered AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS position, part AS word, label,
        lag(label) OVER (PARTITION BY page_id ORDER BY i) AS before FROM labelled WHERE NOT is_tag),
    token AS (SELECT page_id, position, word, label, CASE WHEN label = 'O' THEN 'O' WHEN before = label THEN 'I-' || label ELSE 'B-' || label END AS bio FROM numbered)"""

#: Segments of page tokens, with the first and last token that isn't punctuation.
PAGE_SEGMENTS = PAGE_TOKENS + f""",
    started AS (SELECT *, sum(CASE WHEN bio = 'O' OR bio LIKE 'B-%' OR position = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS grp FROM token),
    segment AS (SELECT page_id, grp, min(position)::INT AS b, (max(position) + 1)::INT AS e, any_value(label) AS label,
        min(CASE WHEN {valid('word')} THEN position END) AS f, max(CASE WHEN {valid('word')} THEN position END) AS l FROM started GROUP BY page_id, grp)"""

#: The same after the punctuation at their ends has become O.
ADJUSTED = PAGE_SEGMENTS + """,
    adjusted AS (SELECT page_id, b, e, CASE WHEN f IS NULL THEN 'O' ELSE label END AS label FROM segment WHERE label = 'O' OR f IS NULL
        UNION ALL SELECT page_id, f, (l + 1)::INT, label FROM segment WHERE label <> 'O' AND f IS NOT NULL
        UNION ALL SELECT t.page_id, t.position, (t.position + 1)::INT, 'O' FROM started t JOIN segment s ON t.page_id = s.page_id AND t.grp = s.grp
                  WHERE s.label <> 'O' AND s.f IS NOT NULL AND (t.position < s.f OR t.position > s.l))"""


def prf(both: str, guess: str, true: str) -> str:
    p, r = f"({both}::DOUBLE / nullif({guess}, 0))", f"({both}::DOUBLE / nullif({true}, 0))"
    return f"{p} AS precision, {r} AS recall, 2 * {p} * {r} / nullif({p} + {r}, 0) AS f1"


def smoothed_emissions(smoothing: float) -> str:
    """CTE emission (label, key, value) from records' labelled tokens, over O and all labels and words of records."""
    return f"""seen AS (SELECT label, word AS key, count(*) AS n FROM token WHERE is_record GROUP BY label, word),
    cell AS (SELECT label, key FROM (SELECT DISTINCT label FROM seen UNION SELECT 'O') CROSS JOIN (SELECT DISTINCT key FROM seen)),
    full_count AS (SELECT c.label, c.key, coalesce(n, 0) + {smoothing} AS n FROM cell c LEFT JOIN seen USING (label, key)),
    emission AS (SELECT label, key, n / sum(n) OVER (PARTITION BY label) AS value FROM full_count)"""


def small_paths(longest: dict[str, int]) -> str:
    """CTEs that enumerate all segmentations of texts: path (mention_id, pos, score), span scores from ``emission``; even chains."""
    n = len(longest)
    return f"""name AS (SELECT unnest([{', '.join(map(quoted, longest))}]) AS label),
    score AS (SELECT t.mention_id, t.position, n.label, coalesce(ln(e.value), 0) AS s FROM token t CROSS JOIN name n LEFT JOIN emission e ON e.key = t.word AND e.label = n.label WHERE NOT t.is_record),
    size AS (SELECT mention_id, max(position) + 1 AS n FROM token WHERE NOT is_record GROUP BY mention_id),
    span AS (SELECT a.mention_id, a.position AS b, z.position + 1 AS e, a.label, sum(c.s) AS s
        FROM score a JOIN score z ON a.mention_id = z.mention_id AND a.label = z.label AND z.position >= a.position JOIN score c ON c.mention_id = a.mention_id AND c.label = a.label AND c.position BETWEEN a.position AND z.position
        GROUP BY ALL HAVING z.position + 1 - a.position <= (CASE a.label {' '.join(f'WHEN {quoted(k)} THEN {v}' for k, v in longest.items())} END)),
    path AS (SELECT mention_id, 0::BIGINT AS pos, 0.0::DOUBLE AS score FROM size
        UNION ALL SELECT p.mention_id, s.e::BIGINT, p.score + s.s + ln(1.0 / {n}) FROM path p JOIN span s ON s.mention_id = p.mention_id AND s.b = p.pos),
    whole AS (SELECT mention_id, score FROM path JOIN size USING (mention_id) WHERE pos = n)"""
