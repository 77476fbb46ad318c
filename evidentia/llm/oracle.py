"""SQL that says what the corpus queries return, where SQL can express it."""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JACCARD = f"""
WITH RECURSIVE worded AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
placed AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM worded),
runs AS (
  SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM placed),
shingles AS (SELECT DISTINCT doc_id, s FROM runs WHERE i <= greatest(n - 4, 1)),
sizes AS (SELECT doc_id, count(*) AS k FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.k, q.k HAVING 100 * count(*) >= 80 * (p.k + q.k - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM worded UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT w.doc_id, coalesce(k, 0) AS n_shingles, least_id AS component_id
FROM worded w LEFT JOIN sizes USING (doc_id) JOIN (SELECT x, min(y) AS least_id FROM reach GROUP BY x) ON x = w.doc_id
"""

SUBSTRING_DEDUP = f"""
WITH worded AS (SELECT doc_id, {_WORDS.format(text="text")} AS w FROM documents),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM worded),
runs AS (
  SELECT doc_id, i, word, count(*) OVER ahead AS n, string_agg(word, ' ') OVER ahead AS s FROM placed
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
firsts AS (SELECT s, min(doc_id) AS f FROM runs WHERE n = 13 GROUP BY s),
marked AS (SELECT doc_id, i, word, n = 13 AND f < doc_id AS hit FROM runs LEFT JOIN firsts USING (s)),
judged AS (
  SELECT doc_id, i, word, coalesce(bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone FROM marked),
kept AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS t,
  count(*) FILTER (gone AND NOT coalesce(before, false)) AS spans
  FROM (SELECT *, lag(gone) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM judged) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, coalesce(spans, 0) AS n_spans
FROM worded LEFT JOIN kept USING (doc_id)
"""

_CONTROL = r"\|turn\|>|\|text\|>|\|next\|>|\|end\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>"
_ESCAPE = rf"regexp_replace({{x}}, '([<\[])(\\*)({_CONTROL})', '\1\\\2\3', 'g')"

CHAT_FORMAT = f"""
WITH turns AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 0, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (SELECT *, row_number() OVER o AS i, lag(role) OVER o AS before FROM turns WINDOW o AS (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text)),
sized AS (
  SELECT *, length({_ESCAPE.format(x="text")}) + CASE
    WHEN before = role THEN length('<|next|>')
    ELSE length('<|turn|><|text|><|end|>') + length({_ESCAPE.format(x="role")}) END AS size FROM marked)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id, alone
"""

MIXING = """
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(doc_id::VARCHAR) AS digest FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS nth FROM sources),
placed AS (SELECT *, [5.0, 2.0, 1.0][nth + 1]::DOUBLE AS weight, [0.5, 0.0, -0.5][nth + 1]::DOUBLE AS bend, (3 * source_size)::DOUBLE AS cap FROM ranked),
levels AS (
  SELECT *, cap / weight AS filled,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM placed WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
targets AS (
  SELECT source, source_size, bend,
    CASE WHEN filled <= level THEN cap ELSE weight * (min_by(level, filled) FILTER (filled > level) OVER ()) END AS target FROM levels),
ordered AS (
  SELECT d.*, t.source_size, t.target, t.bend, round(t.target)::BIGINT AS quota,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
taking AS (
  SELECT *, (quota // greatest(source_size, 1)) * size + least(size, greatest(quota - (quota // greatest(source_size, 1)) * source_size - start, 0)) AS taken,
    start / greatest(quota, 1)::DOUBLE AS used FROM ordered)
SELECT doc_id, size::BIGINT AS size, source_size, target, taken::BIGINT AS taken,
  CASE WHEN taken > 0 THEN round(2 * used / (1 + bend + sqrt(greatest((1 + bend) * (1 + bend) - 4 * bend * used, 0))), 6) END AS position
FROM taking
"""


def _matches(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, '{kind}' AS kind, {order} AS ord, start, stop FROM (
  SELECT doc_id, part, size, sum(piece + size) OVER (PARTITION BY doc_id ORDER BY i) - size AS start, sum(piece + size) OVER (PARTITION BY doc_id ORDER BY i) AS stop
  FROM (SELECT doc_id, generate_subscripts(m, 1) AS i, length(unnest(m)) AS size, length(unnest(g)) AS part, length(unnest(p[1:len(m)])) AS piece
    FROM (SELECT doc_id, regexp_extract_all(text, {quoted}) AS m, regexp_extract_all(text, {quoted}, {group}) AS g, string_split_regex(text, {quoted}) AS p
      FROM documents WHERE text IS NOT NULL AND regexp_matches(text, {quoted})))) WHERE part >= {least}"""


def _secret_scan() -> str:
    from .secret_scan import RULES

    found = " UNION ALL ".join(_matches(r.kind, k, r.pattern, r.group, r.least) for k, r in enumerate(RULES))
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    said = "string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, ord)"
    return f"""WITH found AS ({found})
SELECT d.doc_id, {counts}, sha256(coalesce({said} FILTER (kind IN ({base})), '')) AS base_sha256, coalesce({said}, '') AS spans
FROM documents d LEFT JOIN found USING (doc_id) GROUP BY d.doc_id"""


SECRET_SCAN = _secret_scan()

SUFFIX_DEDUP = """
WITH bytes AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
sized AS (SELECT doc_id, b, octet_length(b) AS n FROM bytes),
strings AS (SELECT doc_id, i, md5(b[i:i + 199]) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 198)) AS i FROM sized WHERE n >= 200)),
hits AS (SELECT doc_id, i FROM strings WHERE h IN (SELECT h FROM strings GROUP BY h HAVING count(*) > 1)),
marked AS (SELECT doc_id, i, sum(CASE WHEN i > coalesce(before, -1000) + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM hits)),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 199 AS z FROM marked GROUP BY 1, 2),
edges AS (
  SELECT doc_id, a, z FROM runs UNION ALL SELECT doc_id, 0, 0 FROM sized),
gaps AS (SELECT doc_id, z + 1 AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a) - 1, n) AS z, n, b FROM edges JOIN sized USING (doc_id)),
kept AS (SELECT doc_id, string_agg(CASE WHEN z >= a THEN hex(b[a:z]) ELSE '' END, '' ORDER BY a) AS h FROM gaps GROUP BY 1),
counted AS (SELECT doc_id, sum(z - a + 1)::BIGINT AS r, count(*) AS k FROM runs GROUP BY 1)
SELECT s.doc_id, n AS n_bytes, coalesce(r, 0) AS n_removed, coalesce(k, 0) AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM sized s JOIN kept USING (doc_id) LEFT JOIN counted USING (doc_id)
"""

DECONTAMINATION = r"""
WITH items AS (SELECT DISTINCT item_id, trim(text, ' ') AS x FROM benchmark WHERE item_id IS NOT NULL),
cut AS (SELECT item_id, x, regexp_extract(x, '(?s)^(.*[.!?])\s+(\S.*)$', 1) AS q, regexp_extract(x, '(?s)^(.*[.!?])\s+(\S.*)$', 2) AS a, list_filter(string_split_regex(x, '\s+'), lambda w: w <> '') AS ws FROM items),
sides AS (SELECT item_id, CASE WHEN q <> '' THEN q ELSE array_to_string(ws[1:ceil(len(ws) * 2 / 3)::INT], ' ') END AS q, CASE WHEN q <> '' THEN a ELSE array_to_string(ws[ceil(len(ws) * 2 / 3)::INT + 1:], ' ') END AS a FROM cut),
worded AS (SELECT item_id, regexp_extract_all(lower(q), '[\p{L}\p{M}\p{N}]+') AS q, regexp_extract_all(lower(a), '[\p{L}\p{M}\p{N}]+') AS a FROM sides),
bags AS (SELECT item_id, q, a, list_concat(q, a) AS w, len(q) + len(a) AS n, greatest(16, CASE WHEN len(q) + len(a) > 1 THEN (2 ** ceil(log2(len(q) + len(a))))::BIGINT ELSE 1 END) AS width FROM worded WHERE len(q) + len(a) > 0),
terms AS (SELECT item_id, width, n, term, count(*) AS tf FROM (SELECT item_id, width, n, unnest(w) AS term FROM bags) GROUP BY ALL),
known AS (SELECT term, count(*) AS df FROM terms GROUP BY term),
weights AS (SELECT item_id, width, term, ln(1 + ((SELECT count(*) FROM bags) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / greatest((SELECT avg(n) FROM bags), 1))) AS x FROM terms JOIN known USING (term)),
impacts AS MATERIALIZED (SELECT item_id, width, term, x / sum(x) OVER (PARTITION BY item_id) AS x FROM weights),
places AS MATERIALIZED (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL)),
hits AS (SELECT DISTINCT doc_id, item_id, width, p // width - back AS k, term, x FROM places JOIN impacts USING (term), (VALUES (0), (1)) b(back) WHERE p // width - back >= 0),
found AS MATERIALIZED (SELECT doc_id, item_id, width, k, sum(x) AS score FROM hits GROUP BY ALL HAVING sum(x) >= 0.5),
grams AS (SELECT DISTINCT item_id, side, least(3, len(w)) AS size, unnest(list_transform(range(1, len(w) - least(3, len(w)) + 2), lambda i: array_to_string(w[i:i + least(3, len(w)) - 1], ' '))) AS g
  FROM (SELECT item_id, 'q' AS side, q AS w FROM bags UNION ALL SELECT item_id, 'a', a FROM bags) WHERE len(w) > 0),
near AS (SELECT f.doc_id, f.item_id, f.k, list(term ORDER BY p) AS w FROM found f JOIN places l ON l.doc_id = f.doc_id AND p >= f.k * f.width - 2 AND p < (f.k + 2) * f.width + 2 GROUP BY ALL),
held AS (SELECT DISTINCT doc_id, item_id, k, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS g FROM near, (VALUES (1), (2), (3)) s(size) WHERE len(w) >= size),
shares AS (SELECT f.doc_id, f.item_id, f.k, g.side, count(h.g)::DOUBLE / count(*) AS share FROM found f JOIN grams g USING (item_id) LEFT JOIN held h ON h.doc_id = f.doc_id AND h.item_id = f.item_id AND h.k = f.k AND h.size = g.size AND h.g = g.g GROUP BY ALL),
judged AS (SELECT f.doc_id, f.item_id, score, coalesce(max(share) FILTER (side = 'q'), 1.0) AS q, coalesce(max(share) FILTER (side = 'a'), 1.0) AS a FROM found f LEFT JOIN shares s ON s.doc_id = f.doc_id AND s.item_id = f.item_id AND s.k = f.k GROUP BY f.doc_id, f.item_id, f.k, score),
best AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY least(q, a) DESC, score DESC) = 1)
SELECT doc_id, item_id, round(score, 6) AS score, q AS question_overlap, a AS answer_overlap FROM best WHERE q >= 0.5 AND a >= 0.5
"""

#: Edits are of characters: those beyond ASCII are written as ASCII signs that no line has, so that a distance of bytes is one of characters.
LINE_DEDUP = r"""
WITH lines AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
placed AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t FROM lines),
used AS (SELECT DISTINCT unnest(regexp_extract_all(t, '(?s).')) AS c FROM placed),
signs AS (SELECT c, row_number() OVER (ORDER BY c) AS k FROM used WHERE unicode(c) >= 128),
free AS (SELECT chr(x::INT) AS b, row_number() OVER (ORDER BY x) AS k FROM range(1, 128) r(x) WHERE chr(x::INT) NOT IN (SELECT c FROM used)),
one_byte AS (SELECT coalesce(string_agg(c, '' ORDER BY k), '') AS f, coalesce(string_agg(b, '' ORDER BY k), '') AS g FROM signs LEFT JOIN free USING (k)),
texts AS MATERIALIZED (SELECT t, length(t) AS n, translate(t, any_value(f), any_value(g)) AS m, min((doc_id, i)) AS first FROM placed, one_byte WHERE t <> '' GROUP BY t),
near AS (SELECT a.t, min(b.first) AS first FROM texts a JOIN texts b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND b.first < a.first
  AND abs(a.n - b.n) <= least(2, least(a.n, b.n) * 2 // 40) AND least(a.n, b.n) >= 20 AND levenshtein(a.m, b.m) <= least(2, least(a.n, b.n) * 2 // 40) GROUP BY a.t),
firsts AS (SELECT t, least(texts.first, coalesce(near.first, texts.first)) AS first FROM texts LEFT JOIN near USING (t)),
judged AS (SELECT doc_id, i, line, t <> '' AND first < (doc_id, i) AS gone FROM placed LEFT JOIN firsts USING (t))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT coalesce(gone, false)), '')) AS kept_sha256 FROM judged GROUP BY doc_id
"""


def _quality_rules() -> str:
    from . import quality_rules as q

    names = list(q.STATISTICS)
    both = [(a, b) for i, a in enumerate(names) for b in names[: i + 1]]
    factors = ", ".join([f"m_{a}" for a in names] + [f"l_{i}_{j}" for i in range(len(names)) for j in range(i + 1)])

    def factored(source: str, grown: float, by: str) -> str:
        sql = f"SELECT *, {', '.join(f's_{a}::DOUBLE / n::DOUBLE / {q.GRID} AS m_{a}' for a in names)} FROM ({source})"
        for j, b in enumerate(names):
            covs = []
            for i, a in list(enumerate(names))[j:]:
                cov = f"((s_{b}_{a}::DOUBLE / n::DOUBLE / {q.GRID} / {q.GRID} - m_{a} * m_{b}) * {grown}::DOUBLE)"
                if i == j:
                    cov = f"(greatest({cov}, 0.0::DOUBLE) + {q.STATISTICS[a] ** 2!r}::DOUBLE)"
                for k in range(j):
                    cov = f"({cov} - l_{i}_{k} * l_{j}_{k})"
                covs.append((i, cov))
            sql = f"SELECT *, sqrt(greatest({covs[0][1]}, 1e-6::DOUBLE)) AS l_{j}_{j} FROM ({sql})"
            if covs[1:]:
                sql = f"SELECT *, {', '.join(f'{cov} / l_{j}_{j} AS l_{i}_{j}' for i, cov in covs[1:])} FROM ({sql})"
        spread = " + ".join(f"ln(l_{i}_{i})" for i in range(len(names)))
        return f"SELECT {by}, {factors}, round({spread}, 6) AS spread FROM ({sql})"

    def far(cells: str, estimate: str, how: str = "JOIN", more: str = "") -> str:
        sql = f"SELECT c.*{more}, {factors} FROM {cells} c {how} {estimate} USING (grp)"
        for i, a in enumerate(names):
            z = f"({a}::DOUBLE / {q.GRID} - m_{a})"
            for j in range(i):
                z = f"({z} - l_{i}_{j} * z_{j})"
            sql = f"SELECT *, {z} / l_{i}_{i} AS z_{i} FROM ({sql})"
        return f"SELECT * EXCLUDE ({factors}), {' + '.join(f'z_{i} * z_{i}' for i in range(len(names)))} AS d2 FROM ({sql})"

    def rank(source: str, by: str, value: str, share: float) -> str:
        return f"SELECT {by}, {value} FROM (SELECT {by}, {value}, row_number() OVER (PARTITION BY {by} ORDER BY {value}) AS r, count(*) OVER (PARTITION BY {by}) AS k FROM {source}) WHERE r = ceil(k * {share})"

    moments = "count(*) AS n, " + ", ".join([f"sum({a}) AS s_{a}" for a in names] + [f"sum({a} * {b}) AS s_{b}_{a}" for a, b in both])
    begun = ", ".join([f"max(median) FILTER (name = '{a}') AS c_{a}, max(apart) FILTER (name = '{a}') AS d_{a}" for a in names])
    scale = {a: f"greatest(d_{a} * 1.4826::DOUBLE, {float(q.STATISTICS[a] * q.GRID)!r}::DOUBLE)" for a in names}
    around = ", ".join(f"c_{a}::DOUBLE AS s_{a}" for a in names)
    plain = ", ".join(f"c_{a}::DOUBLE * c_{b}" + (f" + d_{a} * d_{a} * {1.4826**2!r}::DOUBLE" if a == b else "") + f" AS s_{b}_{a}" for a, b in both)
    shaped = ", ".join(f"c_{a}::DOUBLE * c_{b} + u_{b}_{a}::DOUBLE / k / {q._SIGN**2 / q._P!r}::DOUBLE * {scale[a]} * {scale[b]} AS s_{b}_{a}" for a, b in both)
    whole = ", ".join([f"s_{a}::DOUBLE AS s_{a}" for a in names] + [f"s_{b}_{a}::DOUBLE AS s_{b}_{a}" for a, b in both])
    signs = ", ".join(f"CASE WHEN zz > 0 THEN round(z_{a} / zz * {q._SIGN})::BIGINT ELSE 0 END AS {a}" for a in names)
    apart = ", ".join(f"({a} - c_{a}) / {scale[a]} AS z_{a}" for a in names)
    sums = ", ".join(f"sum({a} * {b}) AS u_{b}_{a}" for a, b in both)
    cell = lambda v: f"round(({v}) * {q.GRID})::BIGINT"
    steps = "".join(
        f"""far{k} AS MATERIALIZED (SELECT *, least(floor(sqrt(d2) * {q._FINE}), {q.CELLS}) AS bin FROM ({far("cells", f"est{k}", more=", start")})),
est{k + 1} AS MATERIALIZED ({factored(f"SELECT grp, start, {moments} FROM far{k} JOIN ({rank(f'far{k}', 'grp, start', 'bin', q.SHARE)}) e USING (grp, start) WHERE far{k}.bin <= e.bin GROUP BY grp, start", q._GROWN, "grp, start")}),
"""
        for k in range(q.STEPS)
    )
    return f"""WITH worded AS (SELECT doc_id, coalesce('=' || lang, '-') AS lang, coalesce('=' || source, '-') AS source, coalesce(text, '') AS text, {_WORDS.format(text="text")} AS w FROM documents),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM worded),
windows AS (SELECT doc_id, i, count(*) OVER ahead AS n, string_agg(word, ' ') OVER ahead AS s FROM placed
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {q.WINDOW - 1} FOLLOWING)),
twice AS (SELECT doc_id, i, n = {q.WINDOW} AND count(*) FILTER (n = {q.WINDOW}) OVER (PARTITION BY doc_id, s) > 1 AS hit FROM windows),
repeats AS (SELECT doc_id, count(*) FILTER (c) AS n_repeat_words FROM (
  SELECT doc_id, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {q.WINDOW - 1} PRECEDING AND CURRENT ROW) AS c FROM twice) GROUP BY 1),
lined AS (SELECT doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM worded),
counted AS (SELECT * EXCLUDE (ls), len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM lined LEFT JOIN repeats USING (doc_id)),
judged AS MATERIALIZED (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  {cell("ln(1 + n_words)")} AS size, {cell("ln((word_chars + 1) / greatest(n_words, 1))")} AS word, {cell("ln((n_symbols + 1) / (greatest(n_words, 1) + 20))")} AS symbols,
  {cell("5 * n_dup_lines / greatest(n_lines, 1)")} AS lines, {cell("5 * n_repeat_words / greatest(n_words, 1)")} AS repeats FROM counted),
sizes AS (SELECT lang, source, count(*) AS k FROM judged WHERE NOT base_failed GROUP BY 1, 2),
grouped AS (SELECT lang, source, k, CASE WHEN k >= {q.LEAST} THEN lang || '/' || source
  WHEN sum(k) FILTER (k < {q.LEAST}) OVER (PARTITION BY lang) >= {q.LEAST} THEN lang || '//' ELSE '///' END AS grp FROM sizes),
totals AS (SELECT grp, sum(k) AS k FROM grouped GROUP BY 1),
groups AS (SELECT lang, source, CASE WHEN grp = '///' AND (SELECT k FROM totals WHERE grp = '///') < {q.LEAST} THEN (SELECT grp FROM totals ORDER BY k DESC, grp DESC LIMIT 1) ELSE grp END AS grp FROM grouped),
cells AS MATERIALIZED (SELECT grp, {", ".join(names)} FROM judged JOIN groups USING (lang, source) WHERE NOT base_failed),
long AS (SELECT grp, name, cell FROM cells UNPIVOT (cell FOR name IN ({", ".join(names)}))),
medians AS MATERIALIZED ({rank("long", "grp, name", "cell", 0.5)}),
spreads AS ({rank("(SELECT l.grp, l.name, abs(l.cell - m.cell) AS apart FROM long l JOIN medians m ON l.grp = m.grp AND l.name = m.name)", "grp, name", "apart", 0.5)}),
begun AS MATERIALIZED (SELECT grp, {begun} FROM (SELECT m.grp, m.name, cell AS median, apart FROM medians m JOIN spreads s ON m.grp = s.grp AND m.name = s.name) GROUP BY grp),
signs AS (SELECT grp, {signs} FROM (SELECT *, sqrt({" + ".join(f"z_{a} * z_{a}" for a in names)}) AS zz FROM (SELECT grp, {apart} FROM cells JOIN begun USING (grp)))),
shape AS (SELECT grp, count(*)::DOUBLE AS k, {sums} FROM signs GROUP BY grp),
est0 AS MATERIALIZED ({factored(f"""SELECT grp, '1 medians' AS start, 1 AS n, {around}, {plain} FROM begun
  UNION ALL SELECT grp, '2 all', n, {whole} FROM (SELECT grp, {moments} FROM cells GROUP BY grp)
  UNION ALL SELECT grp, '3 signs', 1, {around}, {shaped} FROM begun JOIN shape USING (grp)""", 1.0, "grp, start")}),
{steps}best AS MATERIALIZED (SELECT grp, {factors} FROM est{q.STEPS} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY spread, start) = 1),
last_est AS MATERIALIZED ({factored(f"SELECT grp, {moments} FROM ({far('cells', 'best')}) WHERE d2 <= {q._NEAR} GROUP BY grp", 1.0, "grp")}),
whole AS (SELECT * FROM judged LEFT JOIN groups USING (lang, source))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  CASE WHEN NOT base_failed THEN round(d2, 3) END AS distance, NOT base_failed AND NOT coalesce(d2 > {q.CUTOFF}, false) AS kept
FROM ({far("whole", "last_est", "LEFT JOIN")})"""


QUALITY_RULES = _quality_rules()

FILL_IN_MIDDLE = r"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT doc_id, text, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS d FROM hashed),
formed AS (SELECT *, least(a, b) AS i, greatest(a, b) AS j,
  CASE WHEN n = 0 OR c >= 90 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
cut AS (SELECT *, substr(text, 1, i) AS p, substr(text, i + 1, j - i) AS m, substr(text, j + 1) AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

LEXICAL_SEARCH = f"""
WITH worded AS (SELECT doc_id, {_TERMS} AS w FROM documents),
docs AS MATERIALIZED (SELECT doc_id, w, len(w) AS n FROM worded WHERE len(w) > 0),
totals AS (SELECT count(*) AS nd, sum(n)::BIGINT AS nt FROM docs),
occurring AS (SELECT doc_id, n, unnest(w) AS term FROM docs),
postings AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM occurring GROUP BY ALL),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term),
impacts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // nt))) AS impact FROM postings JOIN weights USING (term), totals),
scores AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM impacts JOIN asked USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
