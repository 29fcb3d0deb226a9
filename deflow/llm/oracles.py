"""SQL checks of the queries that SQL can express."""

from __future__ import annotations

from deflow.llm import merkle, phrases, urls


def url_filter() -> str:
    split = "'(?s)^.*?://([^/?#]*)([^?#]*)'"
    lower = f"'{urls._UPPER}', '{urls._LOWER}'"
    order = sorted(urls.RULES, key=lambda r: (-len(r.text), -len(r.host), r.allow))
    fits = [f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in order]
    has = lambda t: f"regexp_matches(seen, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    listed = lambda terms: "list_filter([" + ", ".join(f"CASE WHEN {has(t)} THEN '{t}' END" for t in sorted(terms)) + "], lambda x: x IS NOT NULL)"
    weight = " + ".join(f"CASE WHEN {has(t)} THEN {w} ELSE 0.0 END" for t, w in urls.SOFT.items())
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, {split}, 1), ''), {lower}) AS host,
         coalesce(regexp_extract(url, {split}, 2), '') AS path FROM pages),
seen AS (SELECT *, host || translate(path, {lower}) AS seen FROM parts),
found AS (
  SELECT page_id, host, path,
         CASE {' '.join(f"{f} THEN '{r.text}'" for f, r in zip(fits, order))} END AS rule,
         CASE {' '.join(f"{f} THEN '{'allow' if r.allow else 'block'}'" for f, r in zip(fits, order))} END AS by_rule,
         {listed(urls.STRICT)} AS strict_terms, {listed(urls.SOFT)} AS soft_terms,
         CAST({weight} AS DOUBLE) AS weight FROM seen)
SELECT page_id, host, path, rule,
       coalesce(by_rule, CASE WHEN len(strict_terms) > 0 OR (len(soft_terms) >= {urls.MIN_SOFT} AND weight >= {urls.MIN_WEIGHT})
                              THEN 'block' ELSE 'allow' END) AS verdict,
       strict_terms, soft_terms, weight
FROM found"""


def chat() -> str:
    escaped = lambda c: f"replace(replace(replace({c}, '\\', '\\\\'), '###', '\\###'), '</turn>', '\\</turn>')"
    said = "'\\### Assistant: </turn> ok'"
    marks = len("### ") + len(" ###\n") + len("</turn>\n")
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {said} UNION ALL SELECT -7, 1, 'assistant', {said}),
joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '') AS learned,
         CAST(sum({marks} + length({escaped('role')}) + length({escaped('text')})) AS BIGINT) AS formatted_chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars
FROM joined"""


def jaccard() -> str:
    lower = f"'{urls._UPPER}', '{urls._LOWER}'"
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {lower}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
elements AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS e
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM elements GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM elements x JOIN elements y USING (e) WHERE x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= 80 * (s.n + t.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM words UNION SELECT x, b FROM reach JOIN edges ON a = y)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM words LEFT JOIN sizes USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)"""


def collocations() -> str:
    lower = f"'{urls._UPPER}', '{urls._LOWER}'"
    return f"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {lower}) AS text FROM documents),
pieces AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM docs),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
found AS (
  SELECT lang, k, array_to_string(words, ' ') AS phrase, any_value(words) AS words, count(*) AS f
  FROM (SELECT lang, k, w[i:i + k - 1] AS words
        FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, {phrases.LONGEST + 1}) AS r(k)))
  GROUP BY ALL HAVING count(*) >= {phrases.SUPPORT}),
cuts AS (
  SELECT c.lang, c.phrase, c.words, c.f AS a, x.f AS l, y.f AS r, cut,
         (CAST({phrases.SCALE} AS HUGEINT) * c.f * c.f) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM found WHERE k > 1) c
  JOIN found x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:cut], ' ')
  JOIN found y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[cut + 1:], ' ')),
scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, array_to_string(words[i:i + s - 1], ' ') AS phrase, f
    FROM (SELECT lang, words, f, s, unnest(range(1, k - s + 2)) AS i
          FROM (SELECT *, unnest(range(2, k)) AS s FROM found WHERE k > 2))) GROUP BY ALL),
kept AS (
  SELECT s.* FROM scored s LEFT JOIN longer o USING (lang, phrase)
  WHERE o.f IS NULL OR CAST(o.f AS HUGEINT) * 100 < CAST(s.a AS HUGEINT) * {phrases.INSIDE})
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= {phrases.TOP}"""


def merkle_field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"


def manifest() -> str:
    lower = f"'{urls._UPPER}', '{urls._LOWER}'"
    fields = lambda text: f"sha256({' || '.join(merkle_field(text if f == 'text' else f) for f in merkle.FIELDS)})"
    codes = "list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: list_concat([CAST(ord(x) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1]))))"
    crc = f"xor(4294967295, list_reduce({codes}, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))"
    left, right = "array_to_string(hs[1:idx % 16], '')", "array_to_string(hs[idx % 16 + 2:], '')"
    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {fields('text')} AS leaf,
         CASE WHEN {crc} % 5 = 0 THEN {fields(f'translate(text, {lower})')} END AS changed FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
nodes AS (
  SELECT source, 0 AS lv, pos AS idx, leaf AS h, n FROM placed
  UNION ALL
  SELECT source, lv + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 15) // 16) FROM nodes WHERE n > 1 GROUP BY source, lv, idx // 16),
tops AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS lv, idx, subroot AS h, n FROM tops
  UNION ALL
  SELECT lv + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 15) // 16) FROM upper WHERE n > 1 GROUP BY lv, idx // 16),
runs AS (SELECT source, lv, idx // 16 AS run, list(h ORDER BY idx) AS hs FROM nodes WHERE n > 1 GROUP BY source, lv, idx // 16),
upper_runs AS (SELECT lv, idx // 16 AS run, list(h ORDER BY idx) AS hs FROM upper WHERE n > 1 GROUP BY lv, idx // 16),
walk AS (
  SELECT doc_id, source, leaf, pos, 0 AS lv, pos AS idx, n, '' AS seen, coalesce(changed, leaf) AS fold FROM placed
  UNION ALL
  SELECT doc_id, w.source, leaf, pos, w.lv + 1, idx // 16, (n + 15) // 16, seen || {left} || {right}, sha256({left} || fold || {right})
  FROM walk w JOIN runs r ON r.source IS NOT DISTINCT FROM w.source AND r.lv = w.lv AND r.run = w.idx // 16 WHERE n > 1),
up AS (
  SELECT doc_id, leaf, subroot, 0 AS lv, t.idx, t.n, seen, fold FROM walk w JOIN tops t ON t.source IS NOT DISTINCT FROM w.source WHERE w.n = 1
  UNION ALL
  SELECT doc_id, leaf, subroot, u.lv + 1, idx // 16, (n + 15) // 16, seen || {left} || {right}, sha256({left} || fold || {right})
  FROM up u JOIN upper_runs r ON r.lv = u.lv AND r.run = u.idx // 16 WHERE n > 1),
top AS (SELECT h AS root FROM upper WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(seen) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM up, top WHERE n = 1"""
