"""DuckDB SQL giving the same result as the registered queries, over the same tables."""

from __future__ import annotations

from threadloom.functions import stem
from threadloom.functions.text import BLANKS
from threadloom.schemas import SEARCH_STOP_WORDS, TOPIC_STOP_WORDS

# The redaction patterns, in order, with their markers.
REDACTIONS = [
    ("email", r"\S+@\S+", "«EMAIL»"),
    ("phone", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "«PHONE»"),
    ("ip", r"\b\d{1,3}(\.\d{1,3}){3}\b", "«IP»"),
    ("url", r"https?://[a-z!$-_]+", "«URL»"),
]

MESSAGES = """messages AS (
  SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS msg_id, role,
         TIMESTAMP '2024-01-01' + to_hours(conv_id::INT) + to_minutes(turn::INT) AS ts, text,
         CASE WHEN turn > 0 THEN ((turn - 1) // 2)::VARCHAR END AS parent_id
  FROM conversations)"""
CONVERSATIONS = """convs AS (
  SELECT conv_id::VARCHAR AS conv_id,
         CASE WHEN abs(conv_id) % 7 <> 0 THEN 'Chat ' || conv_id::VARCHAR END AS title,
         'owner_' || (abs(conv_id) % 5)::VARCHAR AS owner_id
  FROM (SELECT DISTINCT conv_id FROM conversations
        UNION ALL SELECT DISTINCT -1 - conv_id FROM conversations WHERE conv_id % 9 = 0))"""
DOCUMENTS = """messages AS (
  SELECT source AS conv_id, doc_id::VARCHAR AS msg_id, 'user' AS role,
         TIMESTAMP '2024-01-01' + to_minutes(doc_id::INT) AS ts, text, NULL::VARCHAR AS parent_id
  FROM documents)"""


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def stripped(text: str) -> str:
    return f"trim({text}, '{BLANKS}')"


def hashed(text: str) -> str:
    return f"sha256(lower({stripped(text)}))"


def trimmed(text: str) -> str:
    clean = stripped(text)
    return f"CASE WHEN length({clean}) > 280 THEN rtrim(left({clean}, 280), '{BLANKS}') || '…' ELSE {clean} END"


def redacted(text: str) -> list[str]:
    """The text after each redaction step."""
    steps = [text]
    for _, pattern, marker in REDACTIONS:
        steps.append(f"regexp_replace({steps[-1]}, '{pattern}', '{marker}', 'g')")
    return steps


# Topics

def _tokens(scope: str = "scope") -> str:
    return f"""tokens AS (
  SELECT DISTINCT conv_id, msg_id, ts, label
  FROM (SELECT conv_id, msg_id, ts, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9'']+'))) AS label
        FROM {scope})
  WHERE length(label) > 2 AND label NOT IN ({quoted(TOPIC_STOP_WORDS)}))"""


def _top(limit: int, least: int) -> str:
    return f"""top AS (
  SELECT label, count(*) AS occurrences, count(*) / (SELECT count(*) FROM scope)::DOUBLE AS weight,
         min(ts) AS first_seen_ts
  FROM tokens GROUP BY label HAVING count(*) >= {least}
  ORDER BY occurrences DESC, first_seen_ts, label LIMIT {limit})"""


_NUMBERED = """numbered AS (
  SELECT t.*, row_number() OVER (PARTITION BY label ORDER BY ts, msg_id, conv_id) AS anchor_no
  FROM tokens t WHERE label IN (SELECT label FROM top))"""


def topic_map(base: str, scope: str = "SELECT * FROM messages", limit: int = 10, least: int = 2,
              samples: int = 3) -> str:
    return f"""WITH {base}, scope AS ({scope}), {_tokens()}, {_top(limit, least)}, {_NUMBERED},
anchors AS (
  SELECT label, string_agg(conv_id || '/' || msg_id, ',' ORDER BY anchor_no) AS anchors
  FROM numbered WHERE anchor_no <= {samples} GROUP BY label)
SELECT top.label, occurrences, weight, first_seen_ts, anchors FROM top LEFT JOIN anchors USING (label)"""


# Threads

_UP = """up AS (
  SELECT a.conv_id, a.msg_id AS anchor_id, p.msg_id, p.parent_id, 1::BIGINT AS distance
  FROM messages a JOIN messages p ON p.conv_id = a.conv_id AND p.msg_id = a.parent_id
  UNION ALL
  SELECT u.conv_id, u.anchor_id, p.msg_id, p.parent_id, u.distance + 1
  FROM up u JOIN messages p ON p.conv_id = u.conv_id AND p.msg_id = u.parent_id)"""


def _down(depth: int) -> str:
    return f"""down AS (
  SELECT a.conv_id, a.msg_id AS anchor_id, c.msg_id, [(c.ts, c.msg_id)] AS path, 1 AS distance
  FROM messages a JOIN messages c ON c.conv_id = a.conv_id AND c.parent_id = a.msg_id
  UNION ALL
  SELECT d.conv_id, d.anchor_id, c.msg_id, list_append(d.path, (c.ts, c.msg_id)), d.distance + 1
  FROM down d JOIN messages c ON c.conv_id = d.conv_id AND c.parent_id = d.msg_id
  WHERE d.distance < {depth})"""


_ABOVE = """SELECT u.conv_id, u.anchor_id, u.msg_id, u.distance,
  count(*) OVER (PARTITION BY u.conv_id, u.anchor_id) - u.distance + 1 AS order_idx FROM up u"""
_BELOW = """SELECT d.conv_id, d.anchor_id, d.msg_id, d.distance,
  row_number() OVER (PARTITION BY d.conv_id, d.anchor_id ORDER BY d.path) AS order_idx FROM down d"""


def _thread(openings: str, depth: int) -> str:
    return f"""WITH RECURSIVE {MESSAGES}, {_UP}, {_down(depth)}, openings AS (
  SELECT conv_id, msg_id AS anchor_id FROM messages WHERE {openings}),
links AS (
  SELECT conv_id, anchor_id, anchor_id AS msg_id, 0 AS distance, 0 AS order_idx, 'anchor' AS relation FROM openings
  UNION ALL SELECT conv_id, anchor_id, msg_id, distance, order_idx, 'ancestor' FROM ({_ABOVE}) SEMI JOIN openings USING (conv_id, anchor_id)
  UNION ALL SELECT conv_id, anchor_id, msg_id, distance, order_idx, 'descendant' FROM ({_BELOW}) SEMI JOIN openings USING (conv_id, anchor_id))
SELECT l.conv_id, l.anchor_id, l.relation, l.distance, l.order_idx, l.msg_id, m.parent_id, m.role, m.ts, m.text
FROM links l JOIN messages m USING (conv_id, msg_id)"""


# Search


def _plain_words(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')"


def search(base: str, terms: list[str], k: int, where: str = "true", pad: bool = True) -> str:
    least = "" if pad else "WHERE score > 0"
    return f"""WITH {base}, scored AS (
  SELECT conv_id, msg_id, role, ts, left(text, 400) AS text,
         len(list_filter({_plain_words('text')}, lambda w: w IN ({quoted(terms)}))) / 10.0::DOUBLE AS score
  FROM messages WHERE {where})
SELECT * FROM scored {least} ORDER BY score DESC, ts DESC, conv_id, msg_id LIMIT {k}"""


def _light_stems(text: str) -> str:
    """English words without stop words, a final ed or s dropped."""
    words = rf"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+'), lambda w: w NOT IN ({quoted(SEARCH_STOP_WORDS)}))"
    return f"""list_transform({words}, lambda w: CASE WHEN w LIKE '%ed' THEN left(w, length(w) - 2)
  WHEN w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END)"""


def _many(base: str, k: int, lexemes=_plain_words) -> str:
    return f"""{base}, scope AS (SELECT * FROM messages), {_tokens()}, {_top(20, 2)},
wanted AS (SELECT DISTINCT label AS query_id, unnest({lexemes('label')}) AS lexeme FROM top),
words AS (SELECT conv_id, msg_id, ts, unnest({lexemes('text')}) AS lexeme FROM messages),
scored AS (
  SELECT query_id, conv_id, msg_id, ts, count(*) / 10.0::DOUBLE AS score
  FROM words JOIN wanted USING (lexeme) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ts DESC, conv_id, msg_id) AS rank
  FROM scored),
hits AS (
  SELECT r.query_id, r.rank, r.conv_id, r.msg_id, m.role, m.ts, left(m.text, 400) AS text, r.score
  FROM ranked r JOIN messages m USING (conv_id, msg_id) WHERE r.rank <= {k})"""


def search_many(base: str, k: int = 10, lexemes=_plain_words) -> str:
    return f"WITH {_many(base, k, lexemes)} SELECT * FROM hits"


def search_stemmer() -> str:
    return f"""WITH {MESSAGES}, scored AS (
  SELECT conv_id, msg_id, role, ts, left(text, 400) AS text,
         len(list_filter({_light_stems('text')}, lambda w: w IN ('tion', 'or'))) / 10.0::DOUBLE AS score
  FROM messages)
SELECT * FROM scored ORDER BY score DESC, ts DESC, conv_id, msg_id LIMIT 50"""


LETTERS = "abcdehinorstu"


def letter_counts(text: str) -> list[str]:
    return [f"length({text}) - length(replace({text}, '{c}', ''))" for c in LETTERS]


def letter_vector(text: str) -> str:
    return f"concat_ws(',', {', '.join(f'({c})::VARCHAR' for c in letter_counts(text))})"


def hybrid_search(depth: int, k: int) -> str:
    vector = lambda text: f"[{', '.join(letter_counts(text))}]::DOUBLE[]"
    return f"""WITH {_many(MESSAGES, depth)},
placed AS (SELECT conv_id, msg_id, {vector('text')} AS v FROM messages),
asked AS (SELECT label AS query_id, {vector('label')} AS v FROM top),
alike AS (
  SELECT query_id, conv_id, msg_id, round(list_cosine_similarity(placed.v, asked.v), 9) AS score
  FROM placed CROSS JOIN asked),
near AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, conv_id, msg_id) AS vector_rank FROM alike
  QUALIFY vector_rank <= {depth}),
fused AS (
  SELECT query_id, conv_id, msg_id, h.rank AS word_rank, n.vector_rank,
         round(coalesce(1 / (60.0 + h.rank), 0) + coalesce(1 / (60.0 + n.vector_rank), 0), 9) AS score
  FROM hits h FULL JOIN near n USING (query_id, conv_id, msg_id))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, conv_id, msg_id) AS rank,
       conv_id, msg_id, word_rank, vector_rank, round(score, 8) AS score
FROM fused QUALIFY rank <= {k}"""


def _english_words(text: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+'), lambda w: w NOT IN ({quoted(SEARCH_STOP_WORDS)}))"


def english_stems(words: str) -> str:
    """CTE stems(word, lexeme) for the distinct words that the query ``words`` gives: the published rules, step by step.

    r1 and r2 are the lengths of the word before its two regions.
    """
    region = "^.*?[aeiouy][^aeiouy]"
    short = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
    case = lambda table: " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items())
    ending = lambda suffixes: f"regexp_extract(w, '({'|'.join(suffixes)})$')"

    def swapped(before: str, after: str, table: dict[str, str], least: str, more: str = "true") -> str:
        return f"""{after} AS (
  SELECT word, r1, r2, CASE WHEN ending <> '' AND length(base) >= {least} AND {more}
         THEN base || CASE ending {case(table)} END ELSE w END AS w
  FROM (SELECT *, {ending(table)} AS ending, left(w, length(w) - length({ending(table)})) AS base FROM {before}))"""

    return f"""distinct_words AS (SELECT DISTINCT word FROM ({words})),
marked AS (
  SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM distinct_words
  WHERE length(word) > 2 AND word NOT IN ({quoted(stem._IRREGULAR)})),
first_region AS (
  SELECT *, CASE WHEN regexp_matches(w, '^(gener|commun|arsen)') THEN length(regexp_extract(w, '^(gener|commun|arsen)'))
    WHEN regexp_matches(w, '{region}') THEN length(regexp_extract(w, '{region}')) ELSE length(w) END AS r1 FROM marked),
regions AS (
  SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), '{region}') THEN r1 + length(regexp_extract(substr(w, r1 + 1), '{region}'))
    ELSE length(w) END AS r2 FROM first_region),
singular AS (
  SELECT word, r1, r2, CASE WHEN w LIKE '%sses' THEN left(w, length(w) - 2)
    WHEN w LIKE '%ied' OR w LIKE '%ies' THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
    WHEN w LIKE '%s' AND NOT regexp_matches(w, '(us|ss)$') AND regexp_matches(left(w, length(w) - 2), '[aeiouy]')
    THEN left(w, length(w) - 1) ELSE w END AS w FROM regions),
whole AS (SELECT word, w AS lexeme FROM singular WHERE w IN ({quoted(sorted(stem._KEPT_AFTER_PLURAL))})),
based AS (
  SELECT *, {ending(['eedly', 'eed', 'edly', 'ed', 'ingly', 'ing'])} AS ending,
         left(w, length(w) - length({ending(['eedly', 'eed', 'edly', 'ed', 'ingly', 'ing'])})) AS base
  FROM singular WHERE w NOT IN ({quoted(sorted(stem._KEPT_AFTER_PLURAL))})),
verbal AS (
  SELECT word, r1, r2, CASE WHEN ending = '' THEN w
    WHEN ending LIKE 'ee%' THEN CASE WHEN length(base) >= r1 THEN base || 'ee' ELSE w END
    WHEN NOT regexp_matches(base, '[aeiouy]') THEN w
    WHEN regexp_matches(base, '(at|bl|iz)$') THEN base || 'e'
    WHEN regexp_matches(base, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(base, length(base) - 1)
    WHEN regexp_matches(base, '{short}') AND r1 >= length(base) THEN base || 'e' ELSE base END AS w FROM based),
ended AS (SELECT word, r1, r2, regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\\1i') AS w FROM verbal),
{swapped('ended', 'derived', stem._DERIVED, 'r1',
         "(ending <> 'ogi' OR base LIKE '%l') AND (ending <> 'li' OR regexp_matches(base, '[cdeghkmnrt]$'))")},
{swapped('derived', 'adjectival', stem._ADJECTIVAL, "CASE ending WHEN 'ative' THEN r2 ELSE r1 END")},
{swapped('adjectival', 'residual', dict.fromkeys(stem._RESIDUAL, ''), 'r2', "(ending <> 'ion' OR regexp_matches(base, '[st]$'))")},
stems AS (
  SELECT word, replace(CASE
      WHEN w LIKE '%e' AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT regexp_matches(left(w, length(w) - 1), '{short}')))
        THEN left(w, length(w) - 1)
      WHEN w LIKE '%ll' AND length(w) - 1 >= r2 THEN left(w, length(w) - 1) ELSE w END, 'Y', 'y') AS lexeme
  FROM residual
  UNION ALL SELECT * FROM whole
  UNION ALL SELECT word, CASE word {case(stem._IRREGULAR)} ELSE word END FROM distinct_words
  WHERE length(word) <= 2 OR word IN ({quoted(stem._IRREGULAR)}))"""


def search_english() -> str:
    return f"""WITH {MESSAGES}, places AS (SELECT conv_id, msg_id, unnest({_english_words('text')}) AS word FROM messages),
asked AS (SELECT unnest(['tioned', 'things']) AS word),
{english_stems('SELECT word FROM places UNION ALL SELECT word FROM asked')},
counted AS (
  SELECT conv_id, msg_id, count(*) AS n FROM places JOIN stems USING (word)
  WHERE lexeme IN (SELECT lexeme FROM asked JOIN stems USING (word)) GROUP BY ALL)
SELECT conv_id, msg_id, role, ts, left(text, 400) AS text, coalesce(n, 0) / 10.0::DOUBLE AS score
FROM messages LEFT JOIN counted USING (conv_id, msg_id) ORDER BY score DESC, ts DESC, conv_id, msg_id LIMIT 50"""


def english_lexemes() -> str:
    return f"""WITH {DOCUMENTS}, places AS (SELECT unnest({_english_words('text')}) AS word FROM messages),
{english_stems('SELECT word FROM places')}
SELECT lexeme, count(*) AS positions FROM places JOIN stems USING (word) GROUP BY lexeme"""


def build_postings_english() -> str:
    return f"""WITH {MESSAGES}, places AS (
  SELECT conv_id, msg_id, role, ts, unnest({_english_words('text')}) AS word FROM messages),
{english_stems('SELECT word FROM places')}
SELECT lexeme, conv_id, msg_id, role, ts, count(*) AS tf FROM places JOIN stems USING (word) GROUP BY ALL"""


def new_words() -> str:
    return f"""WITH {MESSAGES}, places AS (SELECT role, unnest({_english_words('text')}) AS word FROM messages),
fresh AS (SELECT word FROM places WHERE role = 'assistant' EXCEPT SELECT word FROM places WHERE role = 'user'),
{english_stems('SELECT word FROM fresh')}
SELECT word, lexeme FROM stems"""


def search_many_english() -> str:
    """Lexemes of labels and messages, and excerpts for the terms of the labels."""
    return f"""WITH RECURSIVE {MESSAGES}, scope AS (SELECT * FROM messages), {_tokens()}, {_top(20, 2)},
places AS (SELECT conv_id, msg_id, ts, unnest({_english_words('text')}) AS word FROM messages),
asked AS (SELECT label AS query_id, unnest({_english_words("replace(label, '_', ' ')")}) AS word FROM top),
{english_stems('SELECT word FROM places UNION ALL SELECT word FROM asked')},
wanted AS (SELECT DISTINCT query_id, lexeme FROM asked JOIN stems USING (word)),
scored AS (
  SELECT query_id, conv_id, msg_id, ts, count(*) / 10.0::DOUBLE AS score
  FROM places JOIN stems USING (word) JOIN wanted USING (lexeme) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ts DESC, conv_id, msg_id) AS rank FROM scored QUALIFY rank <= 10),
hits AS (SELECT r.*, m.role, m.text AS snip, {_plain_words('query_id')} AS terms FROM ranked r JOIN messages m USING (conv_id, msg_id)),
{_excerpts('hits', ['query_id', 'conv_id', 'msg_id'])}
SELECT h.query_id, h.rank, h.conv_id, h.msg_id, h.role, h.ts, left(snip, 400) AS text, h.score, e.highlights
FROM hits h JOIN excerpts e USING (query_id, conv_id, msg_id)"""


def _excerpts(rows: str, key: list[str]) -> str:
    """Recursive CTEs up to excerpts(key, highlights): hits of the terms of a row in its snip, left to right while apart."""
    keys = ", ".join(key)
    return f"""places_of AS (
  SELECT {keys}, snip, terms, list_filter(range(1, length(snip) + 1),
      lambda i: len(list_filter(terms, lambda t: substr(lower(snip), i, length(t)) = t)) > 0) AS pos FROM {rows}),
picks AS (
  SELECT {keys}, snip, terms, pos, 0 AS n, 0::BIGINT AS taken, '' AS piece FROM places_of
  UNION ALL
  SELECT {keys}, snip, terms, pos, n + 1, high,
    CASE WHEN low > 0 THEN '…' ELSE '' END || substr(snip, low + 1, p - 1 - low) || '**' || substr(snip, p, size) || '**'
      || substr(snip, p + size, high - (p - 1 + size)) || CASE WHEN high < length(snip) THEN '…' ELSE '' END
  FROM (
    SELECT *, greatest(p - 41, 0)::BIGINT AS low, least(p - 1 + size + 40, length(snip))::BIGINT AS high FROM (
      SELECT *, length(list_filter(terms, lambda t: substr(lower(snip), p, length(t)) = t)[1]) AS size FROM (
        SELECT *, list_filter(pos, lambda i: greatest(i - 41, 0) >= taken)[1] AS p FROM picks WHERE n < 3)
      WHERE p IS NOT NULL))),
excerpts AS (SELECT {keys}, coalesce(string_agg(piece, chr(10) ORDER BY n) FILTER (n > 0), '') AS highlights FROM picks GROUP BY {keys})"""


def highlights() -> str:
    return f"""WITH RECURSIVE {MESSAGES}, snippets AS (SELECT conv_id, msg_id, text AS snip, ['tion', 'the'] AS terms FROM messages),
{_excerpts('snippets', ['conv_id', 'msg_id'])}
SELECT * FROM excerpts"""


def shortened(text: str) -> str:
    """One line of at most 220 characters, cut before a word (the given texts have no hyphens)."""
    line = f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"
    return (f"CASE WHEN length({line}) <= 220 THEN {line} "
            f"ELSE regexp_extract(left({line}, 220), '^(.*) ', 1) || '…' END")


def _memory(k: int) -> str:
    line = (f"'- [' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' | ' || role || ' | score ' || "
            f"printf('%.3f', score) || '] ' || {shortened('text')}")
    return f"""{_many(MESSAGES, k)}, memory AS (
  SELECT query_id, string_agg({line}, chr(10) ORDER BY rank) AS memory FROM hits WHERE text <> '' GROUP BY query_id)"""


# Packs

_LINE = "'[' || role || ' • ' || strftime(ts, '%Y-%m-%d %H:%M') || '] ' || text"


def context_pack(base: str, budget: int) -> str:
    return f"""WITH {base}, lines AS (
  SELECT conv_id AS pack_id, conv_id, msg_id, ts, {_LINE} AS line FROM messages),
summed AS (
  SELECT *, ceil(length(line) / 4.0)::INT AS tokens,
         sum(ceil(length(line) / 4.0)::INT) OVER (PARTITION BY pack_id ORDER BY ts, conv_id, msg_id
             ROWS UNBOUNDED PRECEDING) AS used
  FROM lines),
packed AS (
  SELECT pack_id, string_agg(line, chr(10) || chr(10) ORDER BY used) FILTER (used <= {budget}) AS body,
         coalesce(sum(tokens) FILTER (used <= {budget}), 0)::BIGINT AS token_count,
         count(*) FILTER (used <= {budget}) AS message_count, count(*) AS available
  FROM summed GROUP BY pack_id)
SELECT pack_id, coalesce(body, '') || CASE WHEN available > message_count
         THEN chr(10) || chr(10) || '-- Truncated at {budget} tokens --' ELSE '' END AS text_block,
       token_count, message_count FROM packed"""


def context_pack_budgets() -> str:
    return f"""WITH {MESSAGES}, lines AS (
  SELECT conv_id AS pack_id, conv_id::INT * 7 - 20 AS budget, conv_id, msg_id, ts, {_LINE} AS line FROM messages),
summed AS (
  SELECT *, ceil(length(line) / 4.0)::INT AS tokens,
         sum(ceil(length(line) / 4.0)::INT) OVER (PARTITION BY pack_id ORDER BY ts, conv_id, msg_id
             ROWS UNBOUNDED PRECEDING) AS used
  FROM lines WHERE budget BETWEEN 1 AND 400)
SELECT pack_id, coalesce(string_agg(line, chr(10) || chr(10) ORDER BY used) FILTER (used <= budget), '')
         || CASE WHEN count(*) > count(*) FILTER (used <= budget)
            THEN chr(10) || chr(10) || '-- Truncated at ' || any_value(budget)::VARCHAR || ' tokens --' ELSE '' END AS text_block,
       coalesce(sum(tokens) FILTER (used <= budget), 0)::BIGINT AS token_count,
       count(*) FILTER (used <= budget) AS message_count
FROM summed GROUP BY pack_id"""


_PACK_REJECTS = """WITH asked AS (
  SELECT conv_id::VARCHAR AS pack_id,
         CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN NULL WHEN conv_id % 5 = 1 THEN 200 + turn
              WHEN conv_id % 5 = 2 THEN conv_id - 50 WHEN conv_id % 5 = 3 THEN 16000 + 100 * conv_id ELSE 6000 END AS budget
  FROM conversations),
judged AS (
  SELECT pack_id, CASE WHEN count(*) > count(budget) THEN 'budget is missing'
                       WHEN count(DISTINCT budget) > 1 THEN 'budgets of the pack differ'
                       WHEN min(budget) NOT BETWEEN 1 AND 16384 THEN 'budget is not between 1 and 16384' END AS reason
  FROM asked GROUP BY pack_id)
SELECT * FROM judged WHERE reason IS NOT NULL"""


_SUMMARY = """summary AS (
  SELECT conv_id, count(*) AS message_count, min(ts) AS first_message_ts, max(ts) AS last_message_ts
  FROM {source} GROUP BY conv_id)"""


def conversation_list(source: str = "messages", where: str = "true", page: str = "LIMIT 50") -> str:
    return f"""WITH {MESSAGES}, {CONVERSATIONS}, {_SUMMARY.format(source=source)}
SELECT conv_id, title, owner_id, coalesce(message_count, 0) AS message_count, first_message_ts, last_message_ts
FROM convs LEFT JOIN summary USING (conv_id) WHERE {where}
ORDER BY last_message_ts DESC NULLS LAST, title ASC NULLS LAST, conv_id {page}"""


def _numbered_list(where: str, limit: int, offset: int) -> str:
    order = "ORDER BY last_message_ts DESC NULLS LAST, title ASC NULLS LAST, conv_id"
    return f"""SELECT *, row_number() OVER ({order}) + {offset} AS rank
FROM ({conversation_list(where=where, page=f"LIMIT {limit} OFFSET {offset}")})"""


def _normalised() -> str:
    return f"""SELECT source AS conv_id, doc_id::VARCHAR AS msg_id, 'assistant' AS role,
       TIMESTAMP '2024-01-01' + to_minutes(doc_id::INT) AS ts, {redacted('text')[-1]} AS text,
       'root' AS parent_id, {hashed('text')} AS hash, 'model-1' AS model, 'chatgpt_export' AS source
FROM documents"""


def _read_rows() -> str:
    """Messages of the archives, and the files that are none."""
    return f"""SELECT source AS conv_id, doc_id::VARCHAR AS msg_id, {hashed('text')} AS hash, NULL AS broken, NULL AS reason FROM documents
UNION ALL SELECT NULL, NULL, NULL, 'broken-' || (doc_id // 2000)::VARCHAR || '.zip', 'not a ZIP archive: no ZIP signature'
FROM documents WHERE doc_id % 2000 = 0"""


def nearest_to_labels() -> str:
    return """WITH parts AS (
  SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT label, i, avg(x) AS x FROM parts GROUP BY label, i),
asked AS (SELECT label AS query_id, list(x ORDER BY i) AS v FROM means GROUP BY label)""" + _NEAREST


# The ten nearest vectors of every query (query_id, v).
_NEAREST = """, scored AS (
  SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 9) AS score
  FROM embeddings CROSS JOIN asked),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank, vec_id, round(score, 6) AS score FROM ranked WHERE rank <= 10"""


def _shapes() -> str:
    return f"""WITH shaped AS (
  SELECT *, doc_id % 6 AS shape, CASE doc_id % 6 WHEN 0 THEN text || chr(10) || 'end' WHEN 1 THEN text
    WHEN 2 THEN '{{"n":' || doc_id::VARCHAR || '}}' WHEN 4 THEN text ELSE '' END AS raw
  FROM documents)
SELECT source AS conv_id, CASE WHEN shape = 1 THEN 'm' ELSE '' END || doc_id::VARCHAR AS msg_id,
  CASE shape WHEN 0 THEN 'assistant' WHEN 1 THEN 'tool' WHEN 4 THEN 'assistant' ELSE 'user' END AS role,
  CASE WHEN shape = 0 THEN TIMESTAMP '2024-01-01' + to_minutes(doc_id::INT) WHEN shape IN (1, 2) THEN TIMESTAMP '2024-02-03 04:05:06'
       WHEN shape = 3 THEN TIMESTAMP '2023-11-14 22:13:20' ELSE TIMESTAMP '2024-06-01' END AS ts,
  {redacted('raw')[-1]} AS text, CASE WHEN shape = 2 THEN 'p' || doc_id::VARCHAR ELSE 'root' END AS parent_id,
  {hashed('raw')} AS hash
FROM shaped"""


def _checksum_part(i: int) -> str:
    """Sum of the i-th 60 bits of the digests modulo 2^60, added up digit by digit."""
    nibbles = [f"sum(('0x' || substr(digest, {1 + 15 * i + k}, 1))::BIGINT)::HUGEINT * {16 ** (14 - k)}" for k in range(15)]
    return f"lower(lpad(hex((({' + '.join(nibbles)}) % {1 << 60})::BIGINT), 15, '0'))"


def all_sql() -> dict[str, str]:
    with_messages = f"WITH {MESSAGES} "
    steps = redacted("text")
    hits = ", ".join(
        f"sum(len(regexp_extract_all({step}, '{pattern}')))::BIGINT AS {kind}_hits"
        for step, (kind, pattern, _) in zip(steps, REDACTIONS))
    window = "ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-03'"
    return {
        "topic_map": topic_map(MESSAGES),
        "window_cap": topic_map(MESSAGES, "SELECT * FROM messages ORDER BY ts, conv_id, msg_id LIMIT 300"),
        "topic_map_range": topic_map(MESSAGES, f"SELECT * FROM messages WHERE {window}", limit=20),
        "indexed_topic_map": topic_map(MESSAGES, """SELECT * FROM messages
  WHERE ts >= TIMESTAMP '2024-01-01 07:02:00' AND ts <= TIMESTAMP '2024-01-03 00:03:00'""", limit=20),
        "topic_map_conv": topic_map(MESSAGES, "SELECT * FROM messages WHERE conv_id = '3'", least=1),
        "topic_map_documents": topic_map(DOCUMENTS, limit=50, samples=5),
        "topic_map_wide": topic_map(MESSAGES, limit=400, least=25, samples=8),
        "topic_anchors": f"""WITH {MESSAGES}, scope AS (SELECT * FROM messages), {_tokens()}, {_top(10, 2)}, {_NUMBERED}
SELECT n.label, n.conv_id, n.msg_id, m.role, n.ts, {trimmed('m.text')} AS text, n.anchor_no
FROM numbered n JOIN messages m USING (conv_id, msg_id) WHERE n.anchor_no <= 5""",
        "topic_document_frequency": f"""WITH {DOCUMENTS}, scope AS (SELECT * FROM messages), {_tokens()}
SELECT label, count(*) AS occurrences, min(ts) AS first_seen_ts FROM tokens GROUP BY label""",
        "topic_window_summary": with_messages + """SELECT count(*) AS total_messages,
  count(DISTINCT conv_id) AS distinct_conversations, min(ts) AS window_start, max(ts) AS window_end FROM messages""",
        "timeline_topics": f"""WITH {MESSAGES}, {_tokens('messages')}, counted AS (
  SELECT date_trunc('day', ts)::TIMESTAMP AS period, label, count(*) AS occurrences FROM tokens
  GROUP BY ALL HAVING count(*) >= 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY occurrences DESC, label) AS rank FROM counted)
SELECT period, label, occurrences, rank FROM ranked WHERE rank <= 10""",

        "redact_documents": f"SELECT doc_id, {steps[-1]} AS text FROM documents",
        "redact_counts": f"SELECT source, {hits} FROM documents GROUP BY source",
        "content_hash": f"SELECT doc_id, {hashed('text')} AS hash FROM documents",
        "duplicate_messages": f"""WITH {DOCUMENTS}, hashes AS (SELECT *, {hashed('text')} AS hash FROM messages)
SELECT hash, count(*) AS copies, count(DISTINCT conv_id) AS conversations,
       arg_min(conv_id, ts) AS first_conv_id, arg_min(msg_id, ts) AS first_msg_id
FROM hashes GROUP BY hash HAVING count(*) > 1""",
        "trim_text": f"SELECT doc_id, {trimmed('text')} AS preview FROM documents",
        "parse_search_terms": rf"""{with_messages}SELECT conv_id, msg_id,
  array_to_string(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda w: lower(w)), ' ') AS terms
FROM messages""",

        "count_conversations": f"WITH {CONVERSATIONS} SELECT count(*) AS total FROM convs WHERE owner_id = 'owner_3'",
        "conversation_summary": f"WITH {MESSAGES}, {_SUMMARY.format(source='messages')} SELECT * FROM summary",
        "list_conversations": conversation_list(),
        "list_page2": conversation_list(page="LIMIT 20 OFFSET 20"),
        "list_total": f"""SELECT *, (WITH {CONVERSATIONS} SELECT count(*) FROM convs WHERE owner_id = 'owner_1') AS total
FROM ({conversation_list(where="owner_id = 'owner_1'", page="LIMIT 5 OFFSET 2")})""",
        "listing_page": _numbered_list("true", 15, 52),
        "listing_page_owner": _numbered_list("owner_id = 'owner_1'", 8, 9),
        "list_owner": conversation_list(where="owner_id = 'owner_3'", page="LIMIT 2000"),
        "conversation_stats": with_messages + """SELECT conv_id, count(*) AS message_count,
  string_agg(DISTINCT role, ',' ORDER BY role) AS participant_roles, min(ts) AS first_message_ts,
  max(ts) AS last_message_ts, avg(length(text)) AS average_message_length FROM messages GROUP BY conv_id""",
        "timeline": with_messages + "SELECT conv_id, msg_id, role, ts, text, parent_id FROM messages",
        "timeline_conversation": with_messages
        + "SELECT conv_id, msg_id, role, ts, text, parent_id FROM messages WHERE conv_id = '5' ORDER BY ts, msg_id",
        "conversation_checksum": f"""{with_messages}, digests AS (
  SELECT conv_id, sha256(strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '|' || msg_id || '|' || {hashed('text')}) AS digest
  FROM messages)
SELECT conv_id, count(*)::VARCHAR || '-' || {' || '.join(_checksum_part(i) for i in range(4))} AS checksum FROM digests GROUP BY conv_id""",
        "table_counts": f"""WITH {CONVERSATIONS} SELECT 'conversations' AS table_name, count(*) AS row_count FROM convs
UNION ALL SELECT 'messages', count(*) FROM conversations""",

        "thread_ancestors": f"""WITH RECURSIVE {MESSAGES}, {_UP}
SELECT a.conv_id, a.msg_id, a.anchor_id, a.distance, a.order_idx, m.parent_id, m.role, m.ts
FROM ({_ABOVE}) a JOIN messages m USING (conv_id, msg_id)""",
        "thread_descendants": f"""WITH RECURSIVE {MESSAGES}, {_down(3)}
SELECT b.conv_id, b.msg_id, b.anchor_id, b.distance, b.order_idx, m.parent_id, m.role, m.ts
FROM ({_BELOW}) b JOIN messages m USING (conv_id, msg_id)""",
        "thread": _thread("role = 'assistant'", 1),
        "labelled_thread": _thread("true", 2),

        "thread_cycles": f"""WITH RECURSIVE {MESSAGES}, cyclic AS (
  SELECT conv_id, msg_id, CASE WHEN msg_id = '0' THEN '3' WHEN msg_id = '5' THEN '5' ELSE parent_id END AS parent_id
  FROM messages),
up AS (
  SELECT a.conv_id, a.msg_id AS anchor_id, p.msg_id, p.parent_id, 1::BIGINT AS distance, [a.msg_id, p.msg_id] AS seen
  FROM cyclic a JOIN cyclic p ON p.conv_id = a.conv_id AND p.msg_id = a.parent_id AND p.msg_id <> a.msg_id
  UNION ALL
  SELECT u.conv_id, u.anchor_id, p.msg_id, p.parent_id, u.distance + 1, list_append(u.seen, p.msg_id)
  FROM up u JOIN cyclic p ON p.conv_id = u.conv_id AND p.msg_id = u.parent_id AND NOT list_contains(u.seen, p.msg_id))
SELECT conv_id, anchor_id, msg_id, distance FROM up""",
        "thread_last_messages": f"""WITH RECURSIVE {MESSAGES}, {_UP}, {_down(2)}, openings AS (
  SELECT conv_id, arg_max(msg_id, ts) AS anchor_id FROM messages GROUP BY conv_id),
links AS (
  SELECT conv_id, anchor_id, anchor_id AS msg_id, 0 AS distance, 0 AS order_idx, 'anchor' AS relation FROM openings
  UNION ALL SELECT conv_id, anchor_id, msg_id, distance, order_idx, 'ancestor' FROM ({_ABOVE}) SEMI JOIN openings USING (conv_id, anchor_id)
  UNION ALL SELECT conv_id, anchor_id, msg_id, distance, order_idx, 'descendant' FROM ({_BELOW}) SEMI JOIN openings USING (conv_id, anchor_id))
SELECT l.conv_id, l.anchor_id, l.relation, l.distance, l.order_idx, l.msg_id, m.parent_id, m.role, m.ts
FROM links l JOIN messages m USING (conv_id, msg_id)""",

        "dynamic_where": with_messages + """SELECT * FROM messages WHERE role = 'user'
  AND ts >= TIMESTAMP '2024-01-01 12:00:00' AND ts <= TIMESTAMP '2024-01-04'""",
        "filter_ids": with_messages + """SELECT conv_id, msg_id, role, ts FROM messages WHERE (conv_id, msg_id) IN
  (SELECT (conv_id, parent_id) FROM messages WHERE role = 'assistant' AND parent_id IS NOT NULL)""",
        "tag_filter": with_messages
        + "SELECT conv_id, msg_id FROM messages WHERE role = 'assistant' AND length(text) > 500",
        "validate_messages": f"""WITH {MESSAGES}, {CONVERSATIONS}, checked AS (
  SELECT conv_id, msg_id, concat_ws(',', CASE WHEN role = 'system' THEN 'role not allowed' END,
           CASE WHEN length(text) < 100 THEN 'text is null' END,
           CASE WHEN owner_id = 'owner_2' THEN 'conversation is unknown' END) AS reason
  FROM messages JOIN convs USING (conv_id))
SELECT * FROM checked WHERE reason <> ''""",
        "fk_orphans": f"""WITH {MESSAGES}, {CONVERSATIONS}
SELECT m.conv_id, m.msg_id FROM messages m JOIN convs USING (conv_id) WHERE owner_id = 'owner_3'""",

        "filter_owner": f"WITH {CONVERSATIONS} SELECT * FROM convs WHERE owner_id = 'owner_1'",
        "filter_conv": f"WITH {DOCUMENTS} SELECT conv_id, msg_id, ts FROM messages WHERE conv_id = 'src3'",
        "filter_role": with_messages + "SELECT conv_id, msg_id FROM messages WHERE role = 'assistant'",
        "filter_ts_range": with_messages + """SELECT conv_id, msg_id, ts FROM messages
  WHERE ts BETWEEN TIMESTAMP '2024-01-01 04:00:00' AND TIMESTAMP '2024-01-02'""",
        "normalise_iso": with_messages + "SELECT conv_id, msg_id, ts AS moment FROM messages",
        "split_message_id": with_messages + """SELECT conv_id || '/' || msg_id || '/' || role AS message_id, conv_id,
  msg_id || '/' || role AS msg_id FROM messages""",
        "parent_child_self_join": with_messages + """SELECT p.conv_id, p.msg_id, c.msg_id AS reply_id, c.role AS reply_role
FROM messages p JOIN messages c ON c.conv_id = p.conv_id AND c.parent_id = p.msg_id""",
        "conv_left_join_messages": conversation_list(page=""),
        "message_orphans": with_messages + """SELECT conv_id, msg_id, role AS tag FROM messages
  WHERE length(text) <= 200""",
        "anchor": with_messages + "SELECT *, msg_id AS anchor_id FROM messages WHERE role = 'user'",
        "missing_anchors": with_messages + """, asked AS (
  SELECT conv_id, (msg_id::INT + 1)::VARCHAR AS anchor_id FROM messages
  UNION SELECT 'x' || conv_id, msg_id FROM messages)
SELECT conv_id, anchor_id, CASE WHEN conv_id IN (SELECT conv_id FROM messages)
       THEN 'message not found in conversation' ELSE 'conversation not found' END AS reason
FROM asked WHERE NOT EXISTS (SELECT 1 FROM messages m WHERE m.conv_id = asked.conv_id AND m.msg_id = asked.anchor_id)""",
        "tokenise": f"""WITH {DOCUMENTS}, scope AS (SELECT * FROM messages), {_tokens()}
SELECT m.msg_id, coalesce(t.tokens, '') AS tokens FROM messages m LEFT JOIN (
  SELECT conv_id, msg_id, string_agg(label, ' ' ORDER BY label) AS tokens FROM tokens GROUP BY ALL) t
  USING (conv_id, msg_id)""",
        "canonical_text": f"SELECT doc_id, lower({stripped('text')}) AS canonical FROM documents",
        "cover_density_score": f"""WITH {DOCUMENTS} SELECT conv_id, msg_id,
  len(list_filter({_plain_words('text')}, lambda w: w IN ('the', 'than', 'und'))) / 10.0::DOUBLE AS score FROM messages""",

        "search_english": search_english(),
        "search_highlights": highlights(),
        "english_lexemes": english_lexemes(),
        "build_postings_english": build_postings_english(),
        "new_words": new_words(),
        "search_many_english": search_many_english(),
        "search_stemmer": search_stemmer(),
        "search_many_stemmer": search_many(MESSAGES, lexemes=_light_stems),
        "search_none": "SELECT 0::BIGINT AS results",
        "unusable_queries": rf"""SELECT conv_id::VARCHAR || '/' || turn::VARCHAR AS query_id,
  'the query needs at least one term' AS reason
FROM conversations WHERE turn % 3 = 0 OR NOT regexp_matches(text, '[\p{{L}}\p{{N}}_]')""",
        "hybrid_search": hybrid_search(1 << 40, 10),
        "shorten": f"{with_messages}SELECT conv_id, msg_id, {shortened('text')} AS summary FROM messages",
        "memory_block": f"WITH {_memory(5)} SELECT * FROM memory",
        "build_prompts": f"""WITH {_memory(5)}
SELECT label AS query_id, 1 AS section, 0::BIGINT AS turn, 'system' AS role, 'Answer briefly.' AS content FROM top
UNION ALL SELECT query_id, 2, 0, 'system', 'Relevant memory:' || chr(10) || memory FROM memory
UNION ALL SELECT label, 3, 1, 'user', 'Hello' FROM top
UNION ALL SELECT label, 4, 0, 'user', label FROM top""",
        "search_simple": search(MESSAGES, ["the", "tion", "und", "der"], 50),
        "search_filtered": search(MESSAGES, ["est", "que"], 200,
                                  "role = 'system' AND ts >= TIMESTAMP '2024-01-01 06:00:00'"),
        "search_documents": search(DOCUMENTS, ["than", "from"], 100, pad=False),
        "search_many_simple": search_many(MESSAGES),
        "search_many_postings": search_many(DOCUMENTS),
        "build_postings": f"""{with_messages}SELECT lexeme, conv_id, msg_id, role, ts, count(*) AS tf
FROM (SELECT conv_id, msg_id, role, ts, unnest({_plain_words('text')}) AS lexeme FROM messages) GROUP BY ALL""",

        "context_pack": context_pack(MESSAGES, 6000),
        "context_pack_truncated": context_pack(MESSAGES, 200),
        "context_pack_documents": context_pack(DOCUMENTS, 16384),
        "context_pack_budgets": context_pack_budgets(),
        "pack_rejects": _PACK_REJECTS,
        "format_pack_line": f"""{with_messages}SELECT conv_id, msg_id, {_LINE} AS line,
  strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM messages""",

        "pack_running_tokens": f"""{with_messages}, sized AS (
  SELECT conv_id, msg_id, ts, ceil(length({_LINE}) / 4.0)::INT AS tokens FROM messages),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY ts, msg_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used
  FROM sized)
SELECT * FROM summed WHERE used <= 300""",

        "dedupe_by_key": f"""WITH {DOCUMENTS} SELECT {hashed('text')} AS hash, min(ts) AS ts, arg_min(msg_id, ts) AS msg_id
FROM messages GROUP BY 1""",
        "insert_ignore": with_messages + "SELECT * FROM messages WHERE role <> 'user'",
        "upsert_title": f"""WITH {CONVERSATIONS} SELECT conv_id,
  CASE WHEN owner_id = 'owner_0' THEN title ELSE 'New ' || conv_id END AS title,
  CASE WHEN owner_id IN ('owner_0', 'owner_1') THEN owner_id ELSE 'importer' END AS owner_id FROM convs""",
        "cascade_delete": with_messages + """SELECT conv_id, msg_id FROM messages
  WHERE conv_id NOT IN (SELECT conv_id FROM messages WHERE role = 'system')""",
        "normalise_export": _normalised(),
        "normalise_shapes": _shapes(),
        "ingest_export": f"""SELECT source AS conv_id, doc_id::VARCHAR AS msg_id, {hashed('text')} AS hash
FROM documents WHERE lang IS DISTINCT FROM 'en'""",
        "read_export_zip": f"SELECT source AS conv_id, doc_id::VARCHAR AS msg_id, {hashed('text')} AS hash FROM documents",
        "list_archives": """SELECT DISTINCT 'export-' || (doc_id // 200)::VARCHAR || '.zip' AS archive,
  'conversations.json' AS member, 'ok' AS status FROM documents
UNION ALL SELECT 'broken-' || (doc_id // 2000)::VARCHAR || '.zip', NULL, 'not a ZIP archive' FROM documents WHERE doc_id % 2000 = 0""",
        "chat_export": _read_rows(),
        "chat_export_stream": _read_rows(),
        "chat_export_pruned": """SELECT 'export-' || (doc_id // 200)::VARCHAR || '.zip' AS archive, count(*) AS conversations
FROM documents WHERE doc_id // 200 % 10 = 0 GROUP BY ALL""",
        "import_summary": """SELECT count(*) AS imported, count(*) FILTER (lang IS DISTINCT FROM 'en') AS inserted,
  count(*) AS conversations FROM documents""",
        "read_export_json": """SELECT source AS conv_id, 'From ' || source AS title, 'default' AS owner_id,
  count(*) AS conversations FROM documents GROUP BY source""",
        "stream_ingest": f"SELECT conv_id, msg_id, role, ts, text, hash FROM ({_normalised()})",
        "stream_ingest_conversations": """SELECT DISTINCT source AS conv_id, 'From ' || source AS title,
  'default' AS owner_id FROM documents""",
        "stream_embed": f"""SELECT conv_id, msg_id, 'letters' AS model, {letter_vector('text')} AS vector
FROM ({_normalised()})""",

        "embed_messages": with_messages
        + f"SELECT conv_id, msg_id, 'letters' AS model, {letter_vector('text')} AS vector FROM messages WHERE role <> 'user'",
        "vector_search": nearest_to_labels(),
        "vector_index_whole": nearest_to_labels(),
        "vector_search_many": "WITH asked AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0)"
                              + _NEAREST,
    }
