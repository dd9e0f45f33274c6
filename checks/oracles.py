"""DuckDB SQL for the registered queries.

Each statement reaches its result another way than the Spark side: characters are taken one by
one and runs formed with window functions, tokens come from capture groups instead of
look-around, payloads and code findings from the recipe that planted them.
"""

from __future__ import annotations

from checks.planted import (
    ALPHABET,
    BROKEN_MARK,
    FOREIGN_MARK,
    HIDDEN,
    OWN_MARK,
    PLANTED_TEXT,
    SECRET_NAMES,
    SOURCES,
    SUFFIX_LINE,
    TREE_KEPT,
    TREE_PATH,
)



def base(table: str) -> str:
    return f"planted AS (SELECT doc_id AS id, {PLANTED_TEXT} AS text, {SUFFIX_LINE} AS start FROM ({SOURCES[table]}))"


# Expected values, written out: class of a code point, rank of a severity, names in use.
CATEGORY = """CASE
 WHEN cp BETWEEN 8203 AND 8205 OR cp BETWEEN 8288 AND 8292 OR cp = 65279 THEN 'zero_width'
 WHEN cp IN (8206, 8207, 1564) OR cp BETWEEN 8234 AND 8238 OR cp BETWEEN 8294 AND 8297 THEN 'bidi'
 WHEN cp BETWEEN 917504 AND 917631 THEN 'tag'
 WHEN cp IN (65038, 65039) THEN 'emoji_selector'
 WHEN cp BETWEEN 65024 AND 65037 OR cp BETWEEN 917760 AND 917999 THEN 'variation_selector'
 WHEN cp BETWEEN 57344 AND 63743 OR cp BETWEEN 983040 AND 1048573 OR cp BETWEEN 1048576 AND 1114109 THEN 'pua'
 WHEN cp IN (173, 847, 4447, 4448, 6068, 6069, 6158, 8232, 8233, 12644, 65440) THEN 'invisible_format'
 WHEN cp BETWEEN 0 AND 8 OR cp IN (11, 12) OR cp BETWEEN 14 AND 31 OR cp BETWEEN 127 AND 159 THEN 'control'
 END"""
RANK = """CASE category WHEN 'emoji_selector' THEN 0 WHEN 'variation_selector' THEN IF(cp < 70000, 1, 3)
 WHEN 'bidi' THEN 3 WHEN 'pua' THEN 3 WHEN 'tag' THEN 4 ELSE 2 END"""
SEVERITY = "['info', 'low', 'medium', 'high', 'critical'][rank + 1]"
NAMES = """names(cp, name) AS (VALUES
 (8203, 'ZERO WIDTH SPACE'), (8204, 'ZERO WIDTH NON-JOINER'), (8205, 'ZERO WIDTH JOINER'),
 (8288, 'WORD JOINER'), (8290, 'INVISIBLE TIMES'), (8291, 'INVISIBLE SEPARATOR'),
 (8292, 'INVISIBLE PLUS'), (65279, 'ZERO WIDTH NO-BREAK SPACE'),
 (8238, 'RIGHT-TO-LEFT OVERRIDE'), (8295, 'RIGHT-TO-LEFT ISOLATE'),
 (917569, 'TAG LATIN CAPITAL LETTER A'), (65039, 'VARIATION SELECTOR-16'),
 (65025, 'VARIATION SELECTOR-2'), (918001, 'VARIATION SELECTOR-258'),
 (917761, 'VARIATION SELECTOR-18'), (173, 'SOFT HYPHEN'), (8232, 'LINE SEPARATOR'),
 (6158, 'MONGOLIAN VOWEL SEPARATOR'))"""

LINES = """lines AS (SELECT id, unnest(generate_series(1, len(ls)))::INTEGER AS line, unnest(ls) AS s
 FROM (SELECT id, string_split(text, chr(10)) AS ls FROM planted))"""
CHARS = f"""chars AS (SELECT id, line, unnest(generate_series(1, len(cs)))::INTEGER AS col, unnest(cs) AS ch
 FROM (SELECT id, line, string_split(s, '') AS cs FROM lines WHERE s <> '')),
 classed AS (SELECT *, {CATEGORY} AS category FROM (SELECT *, unicode(ch) AS cp FROM chars)),
 marked AS (SELECT *, {RANK} AS rank,
  col - row_number() OVER (PARTITION BY id, line ORDER BY col) AS island FROM classed WHERE category IS NOT NULL)"""
RUNS = f"""{NAMES},
 labelled AS (SELECT DISTINCT cp, format('U+{{:04X}} {{}}', cp, coalesce(name, 'UNNAMED')) AS label
  FROM marked LEFT JOIN names USING (cp)),
 runs AS (SELECT id, line, min(col) AS col, count(*) AS n, max(rank) AS rank,
  list_sort(list_distinct(list(cp))) AS cps, min(category) AS category FROM marked GROUP BY id, line, island),
 run_names AS (SELECT id, line, col, string_agg(label, ', ' ORDER BY cp) AS shown
  FROM (SELECT id, line, col, unnest(cps[1:6]) AS cp FROM runs) JOIN labelled USING (cp) GROUP BY id, line, col),
 char_found AS (SELECT id, line, col, n,
  CASE WHEN n = 1 THEN 'unicode_' || category ELSE 'unicode_run' END AS kind, {SEVERITY} AS severity,
  CASE WHEN n = 1 THEN 'finding.' || category ELSE 'finding.invisible_run' END AS title_key,
  CASE WHEN n = 1 THEN shown ELSE '×' || n || ' · ' || shown || IF(len(cps) > 6, ' …', '') END AS detail,
  CASE WHEN n = 1 AND category = 'emoji_selector' THEN 'rec.emoji' ELSE 'rec.invisible' END AS rec_key
  FROM runs JOIN run_names USING (id, line, col))"""

_OWN, _NET, _BAD = (m.split("|") for m in (OWN_MARK, FOREIGN_MARK, BROKEN_MARK))
# What the recipe hides, by slot: line offset, kind, severity, title, detail, advice, fields.
HIDDEN_ROWS = f"""recipe(slot, off, kind, severity, title_key, detail, rec_key, length, domain, date, checksum, valid) AS (VALUES
 (11, 0, 'author_mark', 'info', 'finding.author_mark', '{OWN_MARK}', NULL, NULL, '{_OWN[1]}', '{_OWN[2]}', '{_OWN[3]}', true),
 (12, 1, 'author_mark', 'medium', 'finding.author_mark', '{FOREIGN_MARK}', 'rec.foreign_mark', NULL, '{_NET[1]}', '{_NET[2]}', '{_NET[3]}', true),
 (13, 0, 'author_mark', 'medium', 'finding.author_mark', '{BROKEN_MARK}', NULL, NULL, '{_BAD[1]}', '{_BAD[2]}', '{_BAD[3]}', false),
 (14, 0, 'hidden_string', 'high', 'finding.hidden_string', '{HIDDEN}', 'rec.hidden_string', {len(HIDDEN)}, NULL, NULL, NULL, NULL),
 (15, 0, 'author_mark', 'info', 'finding.author_mark', '{OWN_MARK}', NULL, NULL, '{_OWN[1]}', '{_OWN[2]}', '{_OWN[3]}', true)),
 hidden AS (SELECT id, (start + off)::INTEGER AS line, r.* EXCLUDE (slot, off)
  FROM planted JOIN recipe r ON id % 24 = slot)"""

# The roll-up appends its row after all others.
UNICODE = """kept AS (SELECT * FROM char_found c
  WHERE NOT EXISTS (SELECT 1 FROM hidden h WHERE h.id = c.id AND h.line = c.line)),
 emoji AS (SELECT id, count(*) AS n, list_sort(list_distinct(list(line))) AS places
  FROM kept WHERE kind = 'unicode_emoji_selector' GROUP BY id HAVING count(*) > 1),
 unicode_found AS (
  SELECT id, 0 AS part, line, col, kind, severity, title_key, detail, rec_key FROM kept
   WHERE kind <> 'unicode_emoji_selector' OR id NOT IN (SELECT id FROM emoji)
  UNION ALL SELECT id, 1, line, NULL, kind, severity, title_key, detail, rec_key FROM hidden
  UNION ALL SELECT id, 2, places[1], NULL, 'unicode_emoji_selector', 'info', 'finding.emoji_selector',
   '×' || n || ' · U+FE0F · @ ' || array_to_string(places[1:10], ', ') || IF(len(places) > 10, ' …', ''), 'rec.emoji' FROM emoji)"""

WORD = r"[\p{L}\p{Nl}\p{No}]"
HOMOGLYPH = rf"""plain AS (SELECT id, line,
  regexp_replace(regexp_replace(s, '\\x[0-9A-Fa-f]{{2}}', '    ', 'g'), '\\.', '  ', 'g') AS s
  FROM lines WHERE regexp_matches(s, '[Ͱ-ӿ]')),
 letters AS (SELECT id, line, unnest(generate_series(1, len(cs)))::INTEGER AS col, unnest(cs) AS ch
  FROM (SELECT id, line, string_split(s, '') AS cs FROM plain)),
 wordly AS (SELECT *, unicode(ch) AS cp, col - row_number() OVER (PARTITION BY id, line ORDER BY col) AS island
  FROM letters WHERE regexp_matches(ch, '{WORD}')),
 words AS (SELECT id, line, min(col) AS col, string_agg(ch, '' ORDER BY col) AS word, list_sort(list_distinct(list(
   CASE WHEN cp BETWEEN 65 AND 90 OR cp BETWEEN 97 AND 122 THEN 'Latin' WHEN cp BETWEEN 1024 AND 1279 THEN 'Cyrillic'
    WHEN cp BETWEEN 880 AND 1023 THEN 'Greek' END))) AS scripts FROM wordly GROUP BY id, line, island),
 homoglyph_found AS (SELECT id, line, col, word, word || '  (' || array_to_string(scripts, ' + ') || ')' AS detail
  FROM words WHERE len(scripts) > 1)"""

EDGE = r"[^\p{L}\p{N}_]"
TOKENS = {
    "aws_key": ("AKIA[0-9A-Z]{16}", "critical"),
    "telegram_token": (r"\p{Nd}{8,10}:[A-Za-z0-9_-]{35}", "critical"),
    "stripe_live": ("[sr]k_live_[0-9a-zA-Z]{16,}", "critical"),
    "github_token": ("gh[pousr]_[0-9A-Za-z]{36}", "critical"),
    "github_pat": ("github_pat_[0-9A-Za-z_]{60,}", "critical"),
    "google_api": ("AIza[0-9A-Za-z_-]{35}", "high"),
    "slack_token": ("xox[baprs]-[0-9A-Za-z-]{10,}", "high"),
    "private_key": ("-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----", "critical"),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "medium"),
}


def mask(value: str) -> str:
    return (
        f"CASE WHEN length({value}) <= 10 THEN substr({value}, 1, 2) || '***' "
        f"ELSE substr({value}, 1, 6) || '…' || right({value}, 4) END"
    )


def _token_select(name: str) -> str:
    pattern, severity = TOKENS[name]
    around = pattern if name == "private_key" else f"(?:^|{EDGE})({pattern})(?:$|{EDGE})"
    group = 0 if name == "private_key" else 1
    return (
        f"SELECT id, line, '{name}' AS name, {SECRET_NAMES.index(name)} AS part, '{severity}' AS severity, "
        f"unnest(regexp_extract_all(s, '{around}', {group})) AS token FROM lines"
    )


SECRETS = (
    "tokens AS (" + " UNION ALL ".join(_token_select(name) for name in SECRET_NAMES) + "),"
    + f"""
 token_found AS (SELECT id, line, part, severity, 'secret.' || name AS title_key, name, {mask('token')} AS detail FROM tokens)"""
)

KEYS = r"api[_-]?key|secret[_-]?key|secret|token|passwd|password|pwd|access[_-]?key|auth[_-]?token"
ASSIGN = rf'''((?:{KEYS})[ \t]*[:=][ \t]*[''"][^''"]{{6,}}[''"])'''
# Assignments on one line, and the one the recipe spreads over three lines.
GENERIC = rf"""assigned AS (
  SELECT id, line, unnest(regexp_extract_all(s, '(?i)(?:^|{EDGE}){ASSIGN}', 1)) AS m FROM lines
  UNION ALL SELECT id, (start + 4)::INTEGER, 'secret="aaaaaaab"' FROM planted WHERE id % 24 = 19),
 split_up AS (SELECT *, row_number() OVER () AS nr, regexp_extract(m, '^[A-Za-z_-]+') AS key,
  regexp_extract(m, '[''"]([^''"]+)[''"]$', 1) AS value FROM assigned),
 spoken AS (SELECT * FROM split_up WHERE NOT regexp_matches(value, '[\s\x{{a0}}]')),
 letter_counts AS (SELECT nr, ch, count(*) AS c FROM (SELECT nr, unnest(string_split(value, '')) AS ch FROM spoken) GROUP BY nr, ch),
 entropies AS (SELECT nr, sum(-c / t * log2(c / t)) AS e
  FROM (SELECT nr, c, sum(c) OVER (PARTITION BY nr) AS t FROM letter_counts) GROUP BY nr),
 generic_found AS (SELECT id, line, key, key || ' = ' || {mask('value')} AS detail,
  CASE WHEN len(list_filter(['your_key_here', 'changeme', 'xxxxxx', 'placeholder', 'example', 'todo', 'secret', 'password', '<your', '...'],
   lambda p: contains(lower(value), p))) > 0 THEN 'low'
   WHEN e >= 3.5 AND length(value) >= 12 THEN 'high' ELSE 'medium' END AS severity
  FROM spoken JOIN entropies USING (nr))"""


def _encoded(shape: str, decode: str, whole: int, name: str) -> str:
    return rf"""{name}_tokens AS (SELECT id, line, unnest(regexp_extract_all(s, '(?:^|{EDGE})({shape})(?:$|[^\p{{L}}\p{{N}}_=+/])', 1)) AS token FROM lines),
 {name}_texts AS (SELECT id, line, TRY(decode({decode}(token))) AS d FROM {name}_tokens WHERE length(token) % {whole} = 0),
 {name}_found AS (SELECT id, line, d, '[{name}] → ' || substr(d, 1, 160) AS detail FROM {name}_texts
  WHERE length(d) >= 3 AND (length(d) - length(regexp_replace(d, '[^\p{{C}}\p{{Z}}]', '', 'g'))
   + length(regexp_replace(d, '[^ \t\n]', '', 'g'))) / length(d) >= 0.85)"""


ENCODED = (
    _encoded("[A-Za-z0-9+/]{20,}={0,2}", "from_base64", 4, "base64")
    + ",\n "
    + _encoded("[0-9a-fA-F]{32,}", "unhex", 2, "hex")
)

DUNDER = r"""dunder_lines AS (SELECT id, line, s, max(CASE WHEN trim(s) <> '' THEN line END)
   OVER (PARTITION BY id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM lines),
 dunder_found AS (SELECT id, (coalesce(above, 0) + 1)::INTEGER AS line, name, val AS value, name || ' = ' || val AS detail FROM (
  SELECT id, above, regexp_extract(s, '^[ \t]*(__author__|__copyright__|__credits__|__maintainer__)[ \t]*=[ \t]*[''"]([^''"]+)[''"]', 1) AS name,
   regexp_extract(s, '^[ \t]*(__author__|__copyright__|__credits__|__maintainer__)[ \t]*=[ \t]*[''"]([^''"]+)[''"]', 2) AS val
  FROM dunder_lines) WHERE name <> '')"""

TEXT_CTES = ",\n ".join(
    [LINES, CHARS, RUNS, HIDDEN_ROWS, UNICODE, HOMOGLYPH, SECRETS, GENERIC, ENCODED, DUNDER]
)
# Detector number, place inside the detector, and the flat finding columns.
ALL_FOUND = """all_found AS (
 SELECT id, 0 AS detector, part, kind, severity, title_key, line, col, detail, rec_key FROM unicode_found
 UNION ALL SELECT id, 1, 0, 'homoglyph', 'high', 'finding.homoglyph', line, col, detail, 'rec.homoglyph' FROM homoglyph_found
 UNION ALL SELECT id, 2, part, 'secret', severity, title_key, line, NULL, detail, 'rec.secret' FROM token_found
 UNION ALL SELECT id, 2, 9, 'secret', severity, 'secret.generic', line, NULL, detail, 'rec.secret' FROM generic_found
 UNION ALL SELECT id, 3, 0, 'encoded_string', 'low', 'finding.encoded_string', line, NULL, detail, 'rec.encoded_string' FROM base64_found
 UNION ALL SELECT id, 3, 1, 'encoded_string', 'low', 'finding.encoded_string', line, NULL, detail, 'rec.encoded_string' FROM hex_found
 UNION ALL SELECT id, 4, 0, 'watermark', 'info', 'finding.watermark_dunder', line, NULL, detail, NULL FROM dunder_found),
 ranked AS (SELECT *, list_position(['info', 'low', 'medium', 'high', 'critical'], severity) - 1 AS rank FROM all_found)"""
REPORT = """report AS (SELECT p.id, count(r.rank)::INTEGER AS n_findings, (count(*) FILTER (r.rank >= 3))::INTEGER AS threats,
  (count(*) FILTER (r.kind = 'author_mark'))::INTEGER AS author_marks, coalesce(max(r.rank), 0) AS top
  FROM planted p LEFT JOIN ranked r ON p.id = r.id GROUP BY p.id),
 lit AS (SELECT *, ['info', 'low', 'medium', 'high', 'critical'][top + 1] AS max_severity,
  CASE WHEN top >= 3 THEN 'red' WHEN top >= 1 THEN 'yellow' ELSE 'green' END AS status FROM report)"""


def on_docs(select: str, *ctes: str, table: str = "documents") -> str:
    return "WITH " + ",\n ".join([base(table), *ctes]) + "\n" + select


def flat(source: str, kind: str, severity: str, title: str, rec: str, column: str = "NULL::INTEGER", extra: str = "") -> str:
    return (
        f"SELECT id AS doc_id, {kind} AS kind, {severity} AS severity, {title} AS title_key, line, "
        f'{column} AS "column", detail, {rec} AS rec_key{extra} FROM {source}'
    )


ALL = [TEXT_CTES, ALL_FOUND]

# Expected findings of the Python templates, by slot. Line and detail follow from the template;
# {k} stands for the order key. The second field is the rank in the emit order.
CODE_ROWS = [
    (1, "sensitive_import", "info", "finding.sensitive_import", 1, "requests", "rec.sensitive_import"),
    (1, "sensitive_import", "info", "finding.sensitive_import", 2, "urllib", "rec.sensitive_import"),
    (1, "sensitive_import", "info", "finding.sensitive_import", 5, "pickle", "rec.sensitive_import"),
    (2, "network_call", "info", "finding.network_calls", 1,
     "×3 · create_connection, requests.get, urllib.request.urlopen · @ 1, 4, 5", "rec.network_call"),
    (3, "shell_exec", "medium", "finding.shell_execs", 1,
     "×4 · check_call(...), os.path.popen(...), os.system(...), subprocess.run(...) · @ 1, 2, 4, 6", "rec.shell_exec"),
    (4, "dangerous_exec", "critical", "finding.exec_decoded", 1, "exec(base64.b64decode(s))", "rec.dangerous_exec"),
    (4, "dangerous_exec", "critical", "finding.exec_decoded", 3, "eval(b.decode())", "rec.dangerous_exec"),
    (5, "dangerous_exec", "high", "finding.exec_dynamic", 1, "eval(x + {k})", "rec.dangerous_exec"),
    (6, "dangerous_exec", "medium", "finding.exec_literal", 1, "eval('1')", "rec.dangerous_exec"),
    (6, "dangerous_exec", "medium", "finding.exec_literal", 4, "compile()", "rec.dangerous_exec"),
    (6, "dangerous_exec", "medium", "finding.exec_literal", 5, "__import__('os')", "rec.dangerous_exec"),
    (7, "parse_error", "low", "finding.parse_error", 1, None, "rec.parse_error"),
    (8, "watermark", "info", "finding.watermark_comment", 1, "# Author: No. {k}", None),
    (8, "watermark", "info", "finding.watermark_comment", 3, "# (c) 2020", None),
    (9, "watermark", "info", "finding.watermark_dunder", 1, "__author__ = n", None),
    (9, "watermark", "info", "finding.watermark_comment", 3, "# written by me", None),
    (9, "unicode_zero_width", "medium", "finding.zero_width", 2, "U+200B ZERO WIDTH SPACE", "rec.invisible"),
    (9, "unicode_zero_width", "medium", "finding.zero_width", 3, "U+200B ZERO WIDTH SPACE", "rec.invisible"),
    (10, "network_call", "info", "finding.network_calls", 1,
     "×18 · http.a, http.b, http.c, http.d, http.e, http.f … · @ 1, 2, 3, 4, 5, 6, 7, 8, 9, 10 …", "rec.network_call"),
    (11, "parse_error", "low", "finding.parse_error", 2, None, "rec.parse_error"),
]


def quote(value) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _zero_width_column(row) -> str:
    return "NULL" if row[1] != "unicode_zero_width" else ("10" if row[4] == 2 else "14")


CODE_FOUND = (
    "rules(slot, nr, kind, severity, title_key, line, col, detail, rec_key) AS (VALUES "
    + ", ".join(
        f"({r[0]}, {i}, {', '.join(map(quote, r[1:5]))}, {_zero_width_column(r)}, {', '.join(map(quote, r[5:]))})"
        for i, r in enumerate(CODE_ROWS)
    )
    + """),
 code_found AS (SELECT o_orderkey, nr, kind, severity, title_key, line::INTEGER AS line, col::INTEGER AS col,
  replace(detail, '{k}', cast(o_orderkey AS VARCHAR)) AS detail, rec_key,
  list_position(['info', 'low', 'medium', 'high', 'critical'], severity) - 1 AS rank
  FROM orders JOIN rules ON o_orderkey % 12 = slot)"""
)


def on_code(select: str, *ctes: str) -> str:
    return "WITH " + ",\n ".join([CODE_FOUND, *ctes]) + "\n" + select


def code_flat(where: str, extra: str = "") -> str:
    return on_code(
        f'SELECT o_orderkey, kind, severity, title_key, line, col AS "column", detail, rec_key{extra} '
        f"FROM code_found WHERE {where}"
    )


# Calls of the templates that some rule watches: slot, label, bare, shell, times per text.
_CALLS = [
    (2, "requests.get", 0, 0, 1), (2, "urllib.request.urlopen", 0, 0, 1), (2, "create_connection", 0, 0, 1),
    (3, "os.system", 0, 0, 1), (3, "subprocess.run", 0, 1, 1), (3, "subprocess.run", 0, 0, 1),
    (3, "os.path.popen", 0, 0, 1), (3, "x.call", 0, 0, 1), (3, "check_call", 0, 1, 1),
    (4, "exec", 1, 0, 1), (4, "eval", 1, 0, 1), (5, "eval", 1, 0, 1),
    (6, "eval", 1, 0, 1), (6, "re.compile", 0, 0, 1), (6, "obj.eval", 0, 0, 1), (6, "compile", 1, 0, 1),
    (6, "__import__", 1, 0, 1), (10, "requests.get", 0, 0, 12), (10, "http.a", 0, 0, 1),
    (10, "http.b", 0, 0, 1), (10, "http.c", 0, 0, 1), (10, "http.d", 0, 0, 1),
    (10, "http.e", 0, 0, 1), (10, "http.f", 0, 0, 1),
]
CALL_FACTS = (
    "SELECT label, bare = 1 AS bare, shell = 1 AS shell, sum(times)::BIGINT AS n FROM orders JOIN (VALUES "
    + ", ".join(f"({slot}, '{label}', {bare}, {shell}, {times})" for slot, label, bare, shell, times in _CALLS)
    + ") c(slot, label, bare, shell, times) ON o_orderkey % 12 = slot GROUP BY ALL"
)

CODE_REPORT = """code_report AS (SELECT o.o_orderkey, count(c.rank)::INTEGER AS n_findings,
  (count(*) FILTER (c.rank >= 3))::INTEGER AS threats, 0 AS author_marks, coalesce(max(c.rank), 0)::INTEGER AS top
  FROM orders o LEFT JOIN code_found c USING (o_orderkey) GROUP BY o.o_orderkey),
 code_lit AS (SELECT *, ['info', 'low', 'medium', 'high', 'critical'][top + 1] AS max_severity,
  CASE WHEN top >= 3 THEN 'red' WHEN top >= 1 THEN 'yellow' ELSE 'green' END AS status FROM code_report)"""

# CRC-32 in plain SQL: a table of 256 remainders, then one step per byte.
CRC = """remainders AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i::BIGINT], range(8)::BIGINT[]),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
 bases AS (SELECT c_custkey, lower(replace(c_name, '#', '-')) || '.test' AS domain,
  '2026-01-' || lpad(cast(c_nationkey + 1 AS VARCHAR), 2, '0') AS date FROM customer),
 marks AS (SELECT c_custkey, domain, date, 'SHASH|' || domain || '|' || date AS base FROM bases),
 built AS (SELECT c_custkey, domain, date, base || '|' || printf('%08X', xor(list_reduce(list_concat([4294967295::BIGINT],
   list_transform(string_split(base, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)) AS mark FROM marks, remainders)"""


def _invisible(value: str) -> str:
    """The invisible form of an ASCII text: its bits in threes."""
    bits = f"array_to_string(list_transform(string_split({value}, ''), lambda x: lpad(bin(ascii(x)), 8, '0')), '')"
    return (
        f"array_to_string(list_transform(regexp_extract_all({bits} || '00', '[01]{{3}}'), "
        f"lambda t: substr('{ALPHABET}', list_position(['000', '001', '010', '011', '100', '101', '110', '111'], t), 1)), '')"
    )


# English and Russian report texts used by the Python templates.
EN = {
    "finding.sensitive_import": "Sensitive library import",
    "finding.network_calls": "Network calls (normal for networked apps)",
    "finding.shell_execs": "System command execution",
    "finding.exec_decoded": "exec/eval with decoding — obfuscation!",
    "finding.exec_dynamic": "exec/eval with a dynamic argument",
    "finding.exec_literal": "exec/eval/compile call",
    "finding.parse_error": "Could not parse syntax (AST skipped)",
    "finding.watermark_dunder": "Watermark in code",
    "finding.watermark_comment": "Mark in a comment",
    "finding.zero_width": "Zero-width invisible character",
    "finding.bidi": "Bidirectional control (Trojan Source)",
    "finding.tag": "Hidden tag character (ASCII smuggling)",
    "finding.variation_selector": "Variation selector (payload carrier)",
    "finding.emoji_selector": "Emoji presentation selector (normal)",
    "finding.pua": "Private Use Area character",
    "finding.invisible_format": "Invisible formatting character",
    "finding.control": "Control character",
    "finding.invisible_run": "Run of invisible characters",
    "finding.hidden_string": "Decoded hidden string",
    "finding.author_mark": "Author mark detected",
    "finding.homoglyph": "Mixed scripts (homoglyph spoofing)",
    "finding.encoded_string": "Encoded string",
    "secret.aws_key": "AWS access key",
    "secret.telegram_token": "Telegram bot token",
    "secret.stripe_live": "Stripe live key",
    "secret.github_token": "GitHub token",
    "secret.github_pat": "GitHub personal token",
    "secret.google_api": "Google API key",
    "secret.slack_token": "Slack token",
    "secret.private_key": "Private key",
    "secret.jwt": "JWT token",
    "secret.generic": "Looks like a secret in code",
    "rec.sensitive_import": "Make sure the library is used legitimately.",
    "rec.network_call": "Verify where and why the code reaches the network.",
    "rec.shell_exec": "Running shell commands is risky — verify the source.",
    "rec.dangerous_exec": "Dynamic code execution is a classic malware trick. Review it by hand.",
    "rec.parse_error": "File does not parse as Python. Only text and invisible characters were checked.",
    "rec.invisible": "Invisible characters in source are an anomaly. Inspect the run and clean the file if needed.",
    "sev.info": "info", "sev.low": "low", "sev.medium": "medium", "sev.high": "high", "sev.critical": "critical",
}
RU = {
    "finding.sensitive_import": "Импорт чувствительной библиотеки",
    "finding.network_calls": "Сетевые вызовы (норма для сетевых программ)",
    "finding.shell_execs": "Запуск системных команд",
    "finding.exec_decoded": "exec/eval с декодированием — обфускация!",
    "finding.exec_dynamic": "exec/eval с динамическим аргументом",
    "finding.exec_literal": "Вызов exec/eval/compile",
    "finding.parse_error": "Синтаксис не разобран (AST пропущен)",
    "finding.watermark_dunder": "Водяной знак в коде",
    "finding.watermark_comment": "Метка в комментарии",
    "finding.zero_width": "Невидимый символ нулевой ширины",
    "sev.info": "инфо", "sev.low": "низкая", "sev.medium": "средняя", "sev.high": "высокая", "sev.critical": "критическая",
}
ICONS = (
    "CASE severity WHEN 'critical' THEN '🚨' WHEN 'high' THEN '⚠️' WHEN 'medium' THEN '⚠️' "
    "WHEN 'low' THEN '📌' ELSE '📝' END"
)
STATUS_ICONS = "CASE status WHEN 'green' THEN '✅' WHEN 'yellow' THEN '⚠️' ELSE '🚨' END"
COLORS = (
    "CASE severity WHEN 'critical' THEN '#f85149' WHEN 'high' THEN '#ff7b54' WHEN 'medium' THEN '#d29922' "
    "WHEN 'low' THEN '#58a6ff' ELSE '#8b949e' END"
)


def messages(name: str, table: dict) -> str:
    rows = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in table.items())
    return f"{name}(key, text) AS (VALUES {rows})"


ORDER = "ORDER BY rank DESC, line, nr"
PLACE = "line || coalesce(':' || col, '')"
BAR = "=" * 60


def _joined(entry: str) -> str:
    return f"""entries AS (SELECT o_orderkey, string_agg({entry}, chr(10) {ORDER}) AS body FROM code_found
  JOIN msg t ON t.key = title_key JOIN msg v ON v.key = 'sev.' || severity LEFT JOIN msg a ON a.key = rec_key GROUP BY o_orderkey)"""


def _report(language: dict, entry: str, block: str, head: str, foot: str) -> str:
    return on_code(
        f"""SELECT 0 AS part, 0 AS max_rank, '' AS path, {head} AS value
 UNION ALL SELECT 1, top, 'src/' || o_orderkey || '.py', {block} FROM code_lit LEFT JOIN entries USING (o_orderkey)
 UNION ALL SELECT 2, 0, '', {foot} FROM totals""",
        CODE_REPORT,
        messages("msg", language),
        _joined(entry),
        """totals AS (SELECT count(*) AS files, sum(threats) AS threats, sum(author_marks) AS marks,
  count(*) FILTER (n_findings > 0) AS issues FROM code_report)""",
    )


def _bar(*lines: str) -> str:
    return f"concat_ws(chr(10), '{BAR}', {', '.join(lines)}, '{BAR}')"


def text_report() -> str:
    detail = "CASE WHEN detail <> '' THEN chr(10) || '        → ' || detail ELSE '' END"
    advice = "CASE WHEN a.text IS NOT NULL THEN chr(10) || '        ⚑ ' || a.text ELSE '' END"
    entry = f"'    ' || {ICONS} || ' [' || v.text || '] ' || t.text || '  (' || {PLACE} || ')' || {detail} || {advice}"
    block = (
        f"{STATUS_ICONS} || ' src/' || o_orderkey || '.py  (encoding: utf-8)' || chr(10) || "
        "coalesce(body, '    ✅ No suspicious elements found') || chr(10)"
    )
    head = _bar("'  VEILSCAN — Hidden-mark scanner for Python code'") + " || chr(10)"
    foot = _bar(
        "'  Files scanned: ' || files", "'  Threats found: ' || threats",
        "'  Author marks: ' || marks", "'  Files with notes: ' || issues",
    )
    return _report(EN, entry, block, head, foot)


def console_report() -> str:
    detail = "CASE WHEN detail <> '' THEN chr(10) || '        -> ' || detail ELSE '' END"
    entry = f"'    [' || v.text || '] ' || t.text || '  (' || {PLACE} || ')' || {detail}"
    block = (
        "chr(10) || '● src/' || o_orderkey || '.py  (кодировка: utf-8)' || chr(10) || "
        "coalesce(body, '    ✓ Подозрительных элементов не найдено')"
    )
    head = _bar("'  VEILSCAN — Сканер скрытых меток в Python-коде'")
    foot = "chr(10) || " + _bar(
        "'  Проверено файлов: ' || files", "'  Найдено угроз: ' || threats", "'  Меток автора: ' || marks"
    )
    return _report(RU, entry, block, head, foot)


def html_report() -> str:
    def escape(x: str) -> str:
        for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
            x = f"replace({x}, '{old}', '{new}')"
        return x

    entry = (
        f"'<div class=\"row\"><span class=\"badge\" style=\"color:' || {COLORS} || '\">' || v.text || "
        f"'</span><div><div class=\"rtitle\">' || {escape('t.text')} || ' <span class=\"rloc\">· ' || {PLACE} || '</span></div>' || "
        f"CASE WHEN detail <> '' THEN '<div class=\"rdetail\">' || {escape('detail')} || '</div>' ELSE '' END || "
        f"CASE WHEN a.text IS NOT NULL THEN '<div class=\"rrec\">⚑ ' || {escape('a.text')} || '</div>' ELSE '' END || '</div></div>'"
    )
    color = "CASE status WHEN 'green' THEN '#3fb950' WHEN 'yellow' THEN '#d29922' ELSE '#f85149' END"
    return on_code(
        f"""SELECT 'src/' || o_orderkey || '.py' AS path, top AS max_rank,
  '<details class="file ' || status || '"' || IF(status = 'red', ' open', '') || '><summary><span class="dot" style="background:' || {color}
  || '"></span><span class="path">src/' || o_orderkey || '.py</span><span class="meta">encoding: utf-8</span></summary>'
  || coalesce('<div class="findings">' || body || '</div>', '<div class="ok">✅ No suspicious elements found</div>') || '</details>' AS value
  FROM code_lit LEFT JOIN entries USING (o_orderkey)""",
        CODE_REPORT,
        messages("msg", EN),
        _joined(entry),
    )


def decoded_sources() -> str:
    """Latin-1 bytes read as cp1251: the accented letters turn into other ones."""
    high = [bytes([b]) for b in range(0xA0, 0x100)]
    before = "".join(b.decode("latin-1") for b in high)
    after = "".join(b.decode("cp1251") for b in high)
    return rf"""WITH x AS (SELECT doc_id, text, doc_id % 4 = 3 AND NOT regexp_matches(text, '[^\x{{00}}-\x{{ff}}]') AS latin,
  CASE WHEN length(text) % 2 = 0 THEN text || '.' ELSE text END AS odd FROM documents),
 y AS (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'utf-8-sig' WHEN doc_id % 4 = 2 THEN 'utf-16'
   WHEN latin AND regexp_matches(text, '[^\x{{00}}-\x{{7f}}]') THEN 'cp1251' ELSE 'utf-8' END AS encoding,
  CASE WHEN latin THEN translate(odd, '{before}', '{after}') ELSE text END AS t FROM x)
 SELECT doc_id, encoding, length(t)::INTEGER AS n_chars, md5(t) AS digest FROM y"""


def statements() -> dict[str, str]:
    char_ctes = [LINES, CHARS]
    run_ctes = [LINES, CHARS, RUNS]
    flat_unicode = [*run_ctes, HIDDEN_ROWS, UNICODE]
    hidden_extra = ", 'v2_octal' AS x_scheme, length::INTEGER AS x_length, domain AS x_domain, date AS x_date, checksum AS x_checksum, valid AS x_valid_checksum"
    report_columns = "n_findings, threats, author_marks, max_severity, status"
    found = {
        "char_class_counts": on_docs(
            f"SELECT category, {SEVERITY} AS severity, count(*) AS n, count(DISTINCT cp) AS n_codepoints FROM marked GROUP BY ALL", *char_ctes
        ),
        "char_runs": on_docs(
            flat("char_found", "kind", "severity", "title_key", "rec_key", "col", ", CASE WHEN n > 1 THEN n::INTEGER END AS x_count"), *run_ctes
        ),
        "codepoint_names": on_docs(
            "SELECT cp, coalesce(name, 'UNNAMED') AS name, label, count(*) AS n FROM marked JOIN labelled USING (cp) LEFT JOIN names USING (cp) GROUP BY ALL",
            *run_ctes,
        ),
        "clean_text": on_docs(
            f"""SELECT doc_id, md5(array_to_string(kept, '')) AS digest, (length(text) - len(kept))::INTEGER AS removed FROM
 (SELECT id AS doc_id, text, list_filter(string_split(text, ''), lambda c: NOT coalesce({CATEGORY.replace('cp ', 'unicode(c) ')} IS NOT NULL, false)) AS kept FROM planted)"""
        ),
        "cleaned_sink": on_docs(
            f"""SELECT doc_id, 'docs/' || doc_id || '.cleaned.txt' AS path, (length(text) - len(kept))::INTEGER AS removed, len(kept)::INTEGER AS size,
 'Invisible characters removed: ' || (length(text) - len(kept)) || '. Saved: docs/' || doc_id || '.cleaned.txt' AS note FROM
 (SELECT id AS doc_id, text, list_filter(string_split(text, ''), lambda c: {CATEGORY.replace('cp ', 'unicode(c) ')} IS NULL) AS kept FROM planted)
 WHERE len(kept) < length(text)"""
        ),
        "emoji_rollup": on_docs(
            "SELECT id AS doc_id, line, col AS \"column\", detail, n::INTEGER AS n FROM unicode_found LEFT JOIN emoji USING (id) WHERE kind = 'unicode_emoji_selector'",
            *flat_unicode,
        ),
        "unicode_findings": on_docs(
            flat("unicode_found", "kind", "severity", "title_key", "rec_key", "col"), *flat_unicode
        ),
        "line_suppression": on_docs(
            flat("kept", "kind", "severity", "title_key", "rec_key", "col"), *flat_unicode
        ),
        "mark_build": f"WITH {CRC} SELECT c_custkey, mark FROM built",
        "mark_encode": f"WITH {CRC} SELECT c_custkey, {_invisible('mark')} AS hidden FROM built",
        "mark_round_trip": f"WITH {CRC} SELECT c_custkey, mark AS payload, 'v2_octal' AS scheme, domain, date, true AS valid_checksum FROM built",
        "scheme_round_trip": "SELECT p_partkey, p_name AS decoded, ceil(length(p_name) * 8 / 3)::INTEGER AS symbols FROM part",
        "hidden_payloads": on_docs(
            flat("hidden", "kind", "severity", "title_key", "rec_key", extra=hidden_extra), HIDDEN_ROWS
        ),
        "homoglyphs": on_docs(
            flat("homoglyph_found", "'homoglyph'", "'high'", "'finding.homoglyph'", "'rec.homoglyph'", "col", ", word AS x_word"), LINES, HOMOGLYPH
        ),
        "escape_neutral": on_docs(
            r"SELECT id AS doc_id, (line - 1)::INTEGER AS at, regexp_replace(regexp_replace(s, '\\x[0-9A-Fa-f]{2}', '    ', 'g'), '\\.', '  ', 'g') AS neutral FROM lines WHERE contains(s, chr(92))",
            LINES,
        ),
        "secrets_all": on_docs(
            flat("token_found", "'secret'", "severity", "title_key", "'rec.secret'", extra=", name AS x_secret_type")
            + " UNION ALL "
            + flat("generic_found", "'secret'", "severity", "'secret.generic'", "'rec.secret'", extra=", 'generic' AS x_secret_type"),
            LINES, SECRETS, GENERIC,
        ),
        "secrets_generic": on_docs(
            flat("generic_found", "'secret'", "severity", "'secret.generic'", "'rec.secret'", extra=", key AS x_key"), LINES, GENERIC
        ),
        "entropy": f"""WITH c AS (SELECT p_partkey, ch, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, '')) AS ch FROM part) GROUP BY ALL),
 e AS (SELECT p_partkey, sum(-n / t * log2(n / t)) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY p_partkey) AS t FROM c) GROUP BY p_partkey)
 SELECT p_partkey, round(e, 6) AS entropy, {mask('p_name')} AS masked FROM part JOIN e USING (p_partkey)""",
        "encoded_base64": on_docs(
            flat("base64_found", "'encoded_string'", "'low'", "'finding.encoded_string'", "'rec.encoded_string'", extra=", d AS x_decoded"), LINES, ENCODED
        ),
        "encoded_hex": on_docs(
            flat("hex_found", "'encoded_string'", "'low'", "'finding.encoded_string'", "'rec.encoded_string'", extra=", d AS x_decoded"), LINES, ENCODED
        ),
        "dunder_watermarks": on_docs(
            flat("dunder_found", "'watermark'", "'info'", "'finding.watermark_dunder'", "NULL::VARCHAR", extra=", name AS x_name, value AS x_value"), LINES, DUNDER
        ),
        "comment_watermarks": code_flat("title_key = 'finding.watermark_comment'"),
        "dangerous_exec": code_flat("kind = 'dangerous_exec'", ", regexp_extract(detail, '^[a-z_]+') AS x_call"),
        "sensitive_imports": code_flat("kind = 'sensitive_import'", ", detail AS x_module"),
        "network_calls": code_flat("kind = 'network_call'", ", regexp_extract(detail, '[0-9]+')::INTEGER AS x_count"),
        "shell_execs": code_flat("kind = 'shell_exec'", ", regexp_extract(detail, '[0-9]+')::INTEGER AS x_count"),
        "parse_errors": on_code(
            "SELECT o_orderkey, kind, severity, title_key, line, rec_key FROM code_found WHERE kind = 'parse_error'"
        ),
        "findings_all": on_docs(
            'SELECT id AS doc_id, detector::TINYINT AS detector, kind, severity, title_key, line, col AS "column", detail, rec_key FROM all_found', *ALL
        ),
        "findings_ordered": on_docs(
            """SELECT id AS doc_id, (row_number() OVER (PARTITION BY id ORDER BY rank DESC, line, detector, seq) - 1)::INTEGER AS "at",
 detector::TINYINT AS detector, seq::INTEGER AS seq, severity, line, detail FROM
 (SELECT *, row_number() OVER (PARTITION BY id, detector ORDER BY part, line, col) - 1 AS seq FROM ranked)""", *ALL,
        ),
        "call_facts": on_code(CALL_FACTS),
        "code_findings_all": on_code(
            'SELECT o_orderkey, kind, severity, line, col AS "column", detail FROM code_found'
        ),
        "file_report": on_docs(f"SELECT id AS doc_id, {report_columns} FROM lit", *ALL, REPORT),
        "file_report_of_findings": on_docs(f"SELECT id AS doc_id, {report_columns} FROM lit", *ALL, REPORT),
        "code_report": on_code(f"SELECT o_orderkey, {report_columns} FROM code_lit", CODE_REPORT),
        "traffic_light": on_docs("SELECT status, count(*) AS n_docs FROM lit GROUP BY status", *ALL, REPORT),
        "corpus_report": on_docs(
            """SELECT count(*) AS files_scanned, count(*) FILTER (n_findings > 0) AS files_with_issues, sum(n_findings)::BIGINT AS total_findings,
 sum(threats)::BIGINT AS threats, sum(author_marks)::BIGINT AS author_marks, sum(threats) > 0 AS has_threats FROM lit""", *ALL, REPORT,
        ),
        "severity_histogram": on_docs("SELECT kind, severity, count(*) AS n FROM all_found GROUP BY ALL", *ALL),
        "threat_findings": on_docs("SELECT id AS doc_id, kind, severity, line, detail FROM ranked WHERE rank >= 3", *ALL),
        "flagged_docs": on_docs("SELECT DISTINCT id AS doc_id FROM all_found", *ALL),
        "clean_docs": on_docs("SELECT id AS doc_id FROM planted WHERE id NOT IN (SELECT id FROM all_found)", *ALL),
        "messages_lookup": on_docs(
            "SELECT title_key, text AS title, count(*) AS n FROM all_found JOIN msg ON key = title_key GROUP BY ALL", *ALL, messages("msg", EN)
        ),
        "text_report": text_report(),
        "console_report": console_report(),
        "html_report": html_report(),
        "decoded_sources": decoded_sources(),
        "tree_paths": """WITH p AS (SELECT doc_id, source || '/' || CASE doc_id % 6 WHEN 0 THEN 'build/' WHEN 1 THEN 'pkg/venv/' WHEN 2 THEN 'building/' ELSE '' END
  || doc_id || CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.PYW' WHEN 2 THEN '.pyc' ELSE '/a.py' END AS path FROM documents)
 SELECT doc_id, path FROM p WHERE doc_id % 6 NOT IN (0, 1) AND doc_id % 5 <> 2""",
        "conversation_findings": on_docs(
            "SELECT id // 1000 AS conv_id, id % 1000 AS turn, kind, severity, line, detail FROM ranked", *ALL, table="conversations"
        ),
        "page_findings": on_docs("SELECT id AS page_id, kind, severity, line, detail FROM ranked", *ALL, table="pages"),
        "page_report": on_docs(f"SELECT id AS page_id, {report_columns} FROM lit", *ALL, REPORT, table="pages"),
        "stored_findings": on_docs("SELECT id AS doc_id, severity, kind, line, detail FROM all_found", *ALL),
        "stream_scan": on_docs(
            'SELECT id AS doc_id, kind, severity, title_key, line, col AS "column", detail, rec_key FROM all_found', *ALL
        ),
        "stream_code_scan": on_code(
            """SELECT o_orderkey, CASE WHEN kind LIKE 'unicode%' THEN 0 WHEN kind = 'watermark' THEN 4 ELSE 5 END::TINYINT AS detector,
 kind, severity, line, col AS "column" FROM code_found"""
        ),
        "stream_counters": on_code(
            """SELECT count(*) AS files_scanned, count(*) FILTER (n_findings > 0) AS files_with_issues, sum(n_findings)::BIGINT AS total_findings,
 sum(threats)::BIGINT AS threats, sum(author_marks)::BIGINT AS author_marks, sum(threats) > 0 AS has_threats FROM code_report""", CODE_REPORT,
        ),
        "source_tree_report": on_code(
            f"""SELECT {TREE_PATH} AS path, 'utf-8' AS encoding, NULL::VARCHAR AS error, {report_columns}
 FROM code_lit WHERE {TREE_KEPT}""", CODE_REPORT,
        ),
    }
    for name in SECRET_NAMES:
        found[f"secrets_{name}"] = on_docs(
            flat(f"token_found WHERE name = '{name}'", "'secret'", "severity", "title_key", "'rec.secret'"), LINES, SECRETS
        )
    return found
