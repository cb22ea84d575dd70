"""The same results in SQL, by plainer means: all spans by list functions, all pairs by a join on shingles."""

from __future__ import annotations

from reqlens.llm import decontam, pii, spans

URL_FILTER = """
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), judged AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM named
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

NEAR_DUPLICATES = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), lists AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM lists),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM lists
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), components AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM lists JOIN components ON x = doc_id
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CONFIRMED = {
    "email": "true",
    "ip": "list_bool_and(list_transform(string_split(v, '.'), lambda o: length(ltrim(o, '0')) <= 3 AND CAST('0' || right(o, 3) AS INT) <= 255))",
    "card": "length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 14 AND 19 AND list_sum(list_transform("
            "range(1, length(regexp_replace(v, '[^0-9]', '', 'g')) + 1), lambda k: "
            "list_sum(list_transform(string_split(CAST((1 + (k + 1) % 2) * CAST(substr(reverse(regexp_replace(v, '[^0-9]', '', 'g')), k, 1) AS INT) AS VARCHAR), ''), lambda d: CAST(d AS INT))))) % 10 = 0",
    "phone": "length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 10 AND 15",
    "iban": "length(replace(v, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0::HUGEINT, list_transform("
            "string_split(substr(replace(v, ' ', ''), 5) || left(replace(v, ' ', ''), 4), ''), lambda c: "
            "CAST(CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS HUGEINT))), "
            "lambda r, d: (r * CASE WHEN d > 9 THEN 100 ELSE 10 END + d) % 97) = 1",
    "national_id": "regexp_matches(v, '^[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}$') AND NOT regexp_matches(v, '^(000|666)|-00-|-0000$')",
    "local_phone": "true",
}


def _pii() -> str:
    """One list of spans per kind; a match starts where the pieces and matches before it end."""
    ctes = ["texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"]
    names = []
    for rank, kind in enumerate(pii.KINDS):
        grammar = _quoted(kind.grammar)
        ctes.append(f"""m_{kind.name} AS (
  SELECT r, text, regexp_extract_all(text, {grammar}) AS m, string_split_regex(text, {grammar}) AS p FROM texts WHERE regexp_matches(text, {grammar})
), s_{kind.name} AS (
  SELECT r, text, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'start': coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0)
    + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'v': m[i]}}), recursive := true)
  FROM m_{kind.name}
), k_{kind.name} AS (
  SELECT r, CAST(start AS BIGINT) AS start, {rank} AS rank, CAST(start + length(v) AS BIGINT) AS stop, '{kind.name}' AS kind, {str(kind.base).lower()} AS base,
    {kind.score} + CASE WHEN regexp_matches(before, {_quoted(kind.context)}) OR regexp_matches(behind, {_quoted(kind.context)}) THEN 0.3 ELSE 0 END
    - CASE WHEN regexp_matches(before, {_quoted(pii.DOUBTS)}) THEN 0.2 ELSE 0 END AS score
  FROM (SELECT *, lower(substr(text, CAST(greatest(start - {spans.CONTEXT}, 0) AS BIGINT) + 1, CAST(least(start, {spans.CONTEXT}) AS BIGINT))) AS before,
      lower(substr(text, CAST(start AS BIGINT) + length(v) + 1, {spans.CONTEXT})) AS behind FROM s_{kind.name} WHERE {_CONFIRMED[kind.name]})
)""")
        names.append(f"SELECT * FROM k_{kind.name}")
    ctes.append("found AS (" + " UNION ALL ".join(names) + ")")
    ctes.append(f"""chosen AS (
  SELECT * FROM found f WHERE base OR score >= {pii.THRESHOLD} AND NOT EXISTS (
    SELECT 1 FROM found b WHERE b.base AND b.r = f.r AND b.start < f.stop AND f.start < b.stop))""")
    counts = ", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in pii.BASE)
    ctes.append(f"""per_text AS (
  SELECT r, {counts}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (base) AS base_spans,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM chosen GROUP BY r)""")
    wanted = ", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in pii.BASE)
    return ("WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, {wanted}, sha256(coalesce(base_spans, '')) AS base_sha256, "
            "coalesce(spans, '') AS spans FROM texts LEFT JOIN per_text USING (r)")


PII = _pii()

# Windows of words, joined as text. The tables' benchmark items hold no numbers and no names, so the
# plain form of the words is the template; places and items are counted as by the operator.
_TYPED = f"regexp_replace(coalesce(text, ''), '[0-9]+([.,][0-9]+)*', ' {decontam.NUMBER} ', 'g')"
_FORM = f"regexp_extract_all(lower({_TYPED}), '\\p{{L}}[\\p{{L}}\\p{{M}}]*|[0-9]')"
DECONTAMINATION = f"""
WITH items AS (SELECT DISTINCT item_id, {_FORM} AS w FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), {decontam.WINDOW}) AS size, array_to_string(w[i:i + least(len(w), {decontam.WINDOW}) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {decontam.WINDOW - 2}, 2))) AS i FROM items WHERE len(w) > 0)
), texts AS (SELECT doc_id, {_FORM} AS w FROM documents),
text_windows AS (
  SELECT doc_id, size, i AS place, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM (SELECT doc_id, w, size, unnest(range(1, greatest(len(w) - size + 2, 1))) AS i FROM texts, (SELECT DISTINCT size FROM item_windows))
), matched AS (SELECT doc_id, size, place, item_id FROM text_windows JOIN item_windows USING (size, words)),
found AS (
  SELECT doc_id, count(DISTINCT (size, place)) AS n_windows, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS items
  FROM matched GROUP BY doc_id
)
SELECT d.doc_id, f.doc_id IS NOT NULL AS contaminated, coalesce(f.n_windows, 0) AS n_windows, coalesce(f.items, '') AS items
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id
"""
