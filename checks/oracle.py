"""SQL counterparts of the registered queries, in relational form.

Written apart from the Spark code: lines, tokens, pieces and candidates are
rows here, not arrays. ``with_ctes`` strings named parts together.
"""

import re

from checks import fixtures as X
from credsieve import resources as R

AS_OF = "2024-05-06 07:08:09"
PRE_URL = "https://git.example.com/api/v3/repos/"

URL = r"https?://[!$-_a-z]+"
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
BARE = (
    r"[A-Za-z0-9.-]*[A-Za-z0-9]\.(?i:" + "|".join(re.escape(t) for t in R.TLDS) + r")\b"
    r"(?:[/:?#][!$-_a-z]*)?"
)
SPACE = (
    r"[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
TRIM = f"^{SPACE}+|{SPACE}+$"


def q(text):
    return "'" + str(text).replace("'", "''") + "'"


def values(name, columns, rows):
    body = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (SELECT * FROM (VALUES {body}) v)"


def words_cte(words, name="kws"):
    return values(name, "kw", [(w,) for w in dict.fromkeys(words)])


FILES = f"files AS ({X.CODE_FILES})"
KEY_FILES = f"files AS ({X.KEY_FILES})"
DOC_FILES = f"files AS ({X.DOCUMENT_FILES})"
TEXTS = f"""files AS ({X.CODE_FILES}),
texts AS (SELECT concat('c', CAST(file_id AS VARCHAR)) AS id, content FROM files
  UNION ALL SELECT concat('d', CAST(doc_id AS VARCHAR)), text FROM documents
  UNION ALL SELECT concat('p', CAST(page_id AS VARCHAR)), html FROM pages)"""
CONFIDENCE = values("conf", "key, value", R.CONFIDENCE)
COMMITS = f"commits AS ({X.COMMITS})"

OWNER = "string_split(html_url, '/')[4]"
REPO = "string_split(html_url, '/')[5]"
EXT = "string_split(html_url, '.')[-1]"
BLOB_PATH = "array_to_string(string_split(html_url, '/')[8:], '/')"
RAW_URL = f"replace(replace(html_url, 'blob/', ''), {q(X.SITE_HOST)}, {q(X.RAW_HOST)})"
CONTENTS_URL = f"concat({q(PRE_URL)}, {OWNER}, '/', {REPO}, '/contents/', {BLOB_PATH})"

LINKLESS = f"regexp_replace(regexp_replace(content, {q(URL)}, ' ', 'g'), {q(EMAIL)}, ' ', 'g')"


HOST_CHARS = r"\pL\pM\pN_.\-"
MARKED_URL = f"[{HOST_CHARS}]*\ufdd0(?:[/:?#][!$-_a-z\ufdd0]*)?"


def domain_ctes(labels):
    """``marks``: texts without links, a mark behind each host that ends like a page's host."""
    return f"""{TEXTS}, urls AS (SELECT concat('u', CAST(page_id AS VARCHAR)) AS id,
  regexp_replace(url, '^[a-z]+://', '') AS content,
  lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS host FROM pages),
suffixes AS (SELECT DISTINCT array_to_string(string_split(host, '.')[-{labels}:], '.') AS suffix
  FROM urls WHERE host <> ''),
bodies AS (SELECT id, {LINKLESS} AS base FROM
  (SELECT * FROM texts UNION ALL SELECT id, content FROM urls)),
tokens AS (SELECT id, generate_subscripts(parts, 1) AS k, unnest(parts) AS token FROM
  (SELECT id, regexp_extract_all(base, {q(f"[{HOST_CHARS}]+|[^{HOST_CHARS}]+")}) AS parts FROM bodies)),
split AS (SELECT id, k, token, string_split(rtrim(lower(token), '.-'), '.') AS labels FROM tokens),
judged AS (SELECT id, k, token, suffix IS NOT NULL AND len(labels) > {labels}
    AND labels[len(labels) - {labels}] <> '' AS known
  FROM split LEFT JOIN suffixes ON array_to_string(labels[-{labels}:], '.') = suffix),
joined AS (SELECT id, string_agg(token || CASE WHEN known THEN '\ufdd0' ELSE '' END, '' ORDER BY k) AS marked
  FROM judged GROUP BY id),
marks AS (SELECT id, CASE WHEN base IS NULL THEN NULL ELSE coalesce(marked, '') END AS marked
  FROM bodies LEFT JOIN joined USING (id))"""


def blank(expr, chars):
    return f"translate({expr}, {q(chars)}, {q(' ' * len(chars))})"


def key_text(base):
    return f"replace({blank(base, R.KEY_NOISE)}, '0x', ' ')"


def cred_text(base):
    return blank(f"regexp_replace({base}, {q(BARE)}, ' ', 'g')", R.CRED_NOISE)


def tokens_of(expr):
    return f"list_filter(string_split_regex({expr}, {q(SPACE + '+')}), lambda t: t <> '')"


def is_cred(t, stop_words=R.STOP_WORDS):
    stops = ", ".join(q(w) for w in stop_words)
    return (
        f"length({t}) >= 7 AND {t} NOT IN ({stops}) AND NOT starts_with(lower({t}), 'u0') "
        f"AND NOT starts_with(lower({t}), '0x') AND NOT starts_with(lower({t}), 'rfc') "
        f"AND NOT contains(lower({t}), 'http') AND regexp_matches({t}, '[0-9]') "
        f"AND regexp_matches({t}, '[a-zA-Z]')"
    )


def _aws_line(line):
    names = "|".join(R.AWS_SECRET_NAMES)
    cut = f"regexp_extract({line}, '^.*[A-Z][0-9a-z/+=]*')"
    head = rf"^(.*?(?:{names}).*[^A-Za-z0-9/+=][A-Za-z0-9/+=]{{40}})(?:[^A-Za-z0-9/+=].*)?$"
    return f"regexp_extract({cut}, {q(head)}, 1)"


def key_rows(source, ident):
    """(ident, secret): distinct key matches of ``source(ident, text)``."""
    parts = [
        f"SELECT {ident}, unnest(regexp_extract_all(text, {q(regex)})) AS secret FROM {source}"
        for _, regex in R.KEY_PATTERNS
    ]
    parts.append(
        f"SELECT {ident}, {_aws_line('l')} AS secret FROM "
        f"(SELECT {ident}, unnest(string_split(text, chr(10))) AS l FROM {source})"
    )
    return f"SELECT DISTINCT {ident}, secret FROM ({' UNION ALL '.join(parts)}) WHERE secret <> ''"


# The fixed bank as rows for SQL, whose patterns know no look-around: (name, run, pattern).
# With a run the key must fill a whole run of these characters; without one the pattern
# tells its own ends.
FIXED = (
    ("AWS Tokens", "", r"\b(?:A3T[A-Z0-9]|AKIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASIA)[A-Z0-9]{16}\b"),
    ("AWS Secret Access Key", "[0-9A-Za-z/+]+", r".{40}"),
    ("Google OAuth Secret", r"[\w-]+", r".{24}"),
    ("Google OAuth Auth Code", r"[\w/-]+", r"4/[\w-]+"),
    ("Google OAuth Refresh Token", r"[\w/-]+", r"1/([\w-]{43}|[\w-]{64})"),
    ("Google OAuth Access Token", "", r"\bya29\.[\w-]+"),
    ("Google API Key", r"[\w-]+", r"AIza.{35}"),
    ("RSA Private Key", "", "BEGIN RSA PRIVATE KEY"),
    ("EC Private Key", "", "BEGIN EC PRIVATE KEY"),
    ("PGP Private Key", "", "BEGIN PGP PRIVATE KEY BLOCK"),
    ("General Private Key", "", "BEGIN PRIVATE KEY"),
    ("Google OAuth Client", "", r"\b[0-9]+-\w{32}\.apps\.googleusercontent\.com\b"),
    ("Amazon MWS", "", r"\bamzn\.mws\.[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\b"),
    ("PayPal Braintree", "", r"\baccess_token\$production\$[0-9a-z]{16}\$[0-9a-f]{32}\b"),
    ("Slack Token", "", r"\bxox[pbaor](-[0-9]{12}){3}-[a-z0-9]{32}\b"),
    ("Slack Webhook", "", r"\bT\w{8}/B\w{8}/\w{24}\b"),
)


def span_rows(source, ident):
    """(ident, start, stop, name, secret): the keys of the fixed bank in ``source(ident,
    text)``; the longest span first, those it overlaps out, again for the rest."""
    parts = []
    for rank, (name, run, pattern) in enumerate(FIXED):
        regex = q(run or pattern)
        whole = f"regexp_full_match(secret, {q(pattern)})" if run else "true"
        parts.append(
            f"""SELECT {ident}, start, start + length(secret) AS stop, {rank} AS rank, {q(name)} AS name, secret FROM (
  SELECT {ident}, secret, 1 + sum(length(before) + length(secret)) OVER (PARTITION BY {ident} ORDER BY i) - length(secret) AS start
  FROM (SELECT {ident}, unnest(found) AS secret, unnest(before[:len(found)]) AS before, unnest(range(len(found))) AS i
    FROM (SELECT {ident}, regexp_extract_all(text, {regex}) AS found, string_split_regex(text, {regex}) AS before FROM {source})))
WHERE {whole}"""
        )
    best = f"min(place) OVER (PARTITION BY {ident}) = place AS best"
    columns = f"{ident}, start, stop, name, secret, place"
    return f"""WITH RECURSIVE every AS ({' UNION ALL '.join(parts)}),
placed AS (SELECT *, row_number() OVER (PARTITION BY {ident} ORDER BY stop - start DESC, start, rank) AS place FROM every),
round AS (SELECT {columns}, {best} FROM placed
  UNION ALL
  SELECT {columns}, {best} FROM (SELECT r.* FROM round r JOIN round b ON r.{ident} = b.{ident} AND b.best
    WHERE NOT r.best AND (r.stop <= b.start OR b.stop <= r.start)))
SELECT {ident}, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, name, secret FROM round WHERE best"""


def cred_rows(source, ident):
    return (
        f"SELECT DISTINCT {ident}, t AS secret FROM "
        f"(SELECT {ident}, unnest({tokens_of('text')}) AS t FROM {source}) WHERE {is_cred('t')}"
    )


def entropy_rows(source, keys):
    """Adds ``entropy`` to distinct (keys, secret) rows."""
    return (
        f"SELECT {keys}, secret, -sum(c / n * ln(c / n)) AS entropy FROM ("
        f"SELECT {keys}, secret, ch, CAST(count(*) AS DOUBLE) AS c, length(secret) AS n FROM ("
        f"SELECT {keys}, secret, unnest(string_split(secret, '')) AS ch FROM {source}) "
        f"GROUP BY {keys}, secret, ch) GROUP BY {keys}, secret"
    )


DICTIONARY = r"""words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}{4,}')) AS w FROM documents),
word_grams AS (SELECT w, substr(w, i, n) AS g FROM (
  SELECT w, n, unnest(range(1, length(w) - n + 2)) AS i FROM words, (VALUES (3), (4), (5)) s(n))),
ngrams AS (SELECT g AS ngram, count(*) AS total, count(DISTINCT w) AS doc_freq, log10(count(*)) AS log_total
  FROM word_grams GROUP BY g
  HAVING count(DISTINCT w) >= 1e-5 * (SELECT count(*) FROM words))"""


def match_rows(source):
    """(secret, match) for the distinct secrets of a source, 0 without known pieces."""
    return f"""secrets AS (SELECT DISTINCT secret FROM {source}),
secret_grams AS (SELECT secret, substr(low, i, n) AS ngram FROM (
  SELECT secret, low, n, unnest(range(1, length(low) - n + 2)) AS i
  FROM (SELECT secret, regexp_replace(lower(secret), '\\s\\s+', ' ', 'g') AS low FROM secrets), (VALUES (3), (4), (5)) s(n))),
matches AS (SELECT secret, coalesce(sum(log_total), 0) AS match
  FROM secrets LEFT JOIN (SELECT secret, log_total FROM secret_grams JOIN ngrams USING (ngram)) USING (secret)
  GROUP BY secret)"""


def hit_condition(kind, case_sensitive=False):
    """A short line ties ``secret`` to ``kw``."""
    line, kw = ("line", "kw") if case_sensitive else ("lower(line)", "lower(kw)")
    cond = (
        f"length(line) < 300 AND contains(line, secret) AND line <> secret AND contains({line}, {kw}) "
        "AND NOT contains(line, 'http') AND NOT contains(line, 'www') AND NOT contains(line, 'uuid') "
        f"AND strpos({line}, {kw}) < strpos(line, secret)"
    )
    if kind == "creds":
        cond += (
            " AND ((strpos(line, ':') < strpos(line, secret) AND strpos(line, ':') > strpos(line, kw))"
            " OR (strpos(line, '=') < strpos(line, secret) AND strpos(line, '=') > strpos(line, kw)))"
        )
    return cond


def mask(line, secret, compat=False):
    head = f"regexp_extract({line}, '^[^:=]*[:=]')"
    rest = f"regexp_replace(substr({line}, length({head}) + 1), {q(TRIM)}, '', 'g')"
    masked = (
        f"CASE WHEN {head} <> '' AND {rest} <> '' THEN concat({head}, substr({rest}, 1, 4), '##########', "
        f"CASE WHEN ends_with({rest}, '\"') THEN '\"' ELSE '' END) "
        f"ELSE replace({line}, {secret}, '##########') END"
    )
    return masked if compat else f"replace({masked}, {secret}, '##########')"


def n_of(kw):
    low = "lower(content)"
    return f"CAST((length({low}) - length(replace({low}, lower({kw}), ''))) // length({kw}) AS INTEGER)"


def gated_ctes(kind):
    """``gated``: files that pass the file gates; ``cands``: their 1..20 candidates. The
    kind "fixed" looks for keys of the fixed bank in the raw text."""
    text = {"keys": key_text("base"), "creds": cred_text("base"), "fixed": "content"}[kind]
    if kind == "fixed":
        rows = f"SELECT DISTINCT file_id, secret FROM ({span_rows('cleaned', 'file_id')})"
    else:
        rows = (key_rows if kind == "keys" else cred_rows)("cleaned", "file_id")
    return f"""based AS (SELECT file_id, html_url, {EXT} AS ext, content, {LINKLESS} AS base FROM files),
gated AS (SELECT * FROM based WHERE ext <> 'md' AND len(string_split(content, chr(10))) > 2
  AND len(regexp_extract_all(content, {q(URL)})) + len(regexp_extract_all(base, {q(BARE)})) <= 30),
cleaned AS (SELECT file_id, {text} AS text FROM gated),
all_cands AS ({rows}),
cands AS (SELECT file_id, secret FROM all_cands
  WHERE file_id IN (SELECT file_id FROM all_cands GROUP BY file_id HAVING count(*) <= 20))"""


def hits_ctes(kind, words, primary=None, case_sensitive=False):
    """``hits(file_id, html_url, ext, prim, kw, n, secret, entropy, line)``."""
    parts = [words_cte(words), gated_ctes(kind)]
    if primary is None:
        parts.append(
            f"""pairs AS (SELECT file_id, html_url, ext, content, CAST(NULL AS VARCHAR) AS prim, kw, {n_of('kw')} AS n
  FROM gated JOIN kws ON contains(lower(content), lower(kw)))"""
        )
    else:
        parts.append(words_cte(primary, "prims0"))
        parts.append("prims AS (SELECT kw AS prim FROM prims0)")
        parts.append(
            f"""pairs AS (SELECT file_id, html_url, ext, content, prim, kw, {n_of('kw')} + {n_of('prim')} AS n
  FROM gated JOIN kws ON contains(lower(content), lower(kw)) JOIN prims ON contains(lower(content), lower(prim)))"""
        )
    parts.append(f"scored AS ({entropy_rows('cands', 'file_id')})")
    parts.append(
        """lines AS (SELECT file_id, unnest(string_split(content, chr(10))) AS line,
  unnest(range(len(string_split(content, chr(10))))) AS line_no FROM gated)"""
    )
    parts.append(
        f"""hits AS (SELECT file_id, html_url, ext, prim, kw, n, secret, entropy, arg_min(line, line_no) AS line
  FROM pairs JOIN scored USING (file_id) JOIN lines USING (file_id)
  WHERE entropy > 1.5 AND {hit_condition(kind, case_sensitive)}
  GROUP BY file_id, html_url, ext, prim, kw, n, secret, entropy)"""
    )
    return ",\n".join(parts)


def score_ctes(dictionary=True):
    """``found``: hits with weights and scores."""
    parts = [CONFIDENCE]
    if dictionary:
        parts += [DICTIONARY, match_rows("hits")]
        match = "match"
        join = "JOIN matches USING (secret)"
    else:
        match, join = "0.0", ""
    parts.append(
        f"""found AS (SELECT hits.*, CAST(coalesce(k.value, 0) + coalesce(e.value, 0) AS INTEGER) AS weight,
  log2(50) / (log2(n + 1) + 1) AS count_score, log2(100) / (log2({match} + 1) + 1) AS dict_score
  FROM hits {join} LEFT JOIN conf k ON k.key = kw LEFT JOIN conf e ON e.key = ext)"""
    )
    return ",\n".join(parts)


SCORE_COLUMNS = """weight AS Key_Weight, round(count_score, 6) AS SKey_Count, round(entropy, 6) AS Entropy,
  round(dict_score, 6) AS Dictionary_Similarity, round(weight + entropy + count_score + dict_score, 6) AS Score"""
TIME_COLUMNS = f"""{q(AS_OF)} AS Detected_Timestamp, CAST(2024 AS INTEGER) AS "Year", CAST(5 AS INTEGER) AS "Month",
  CAST(6 AS INTEGER) AS "Day", CAST(7 AS INTEGER) AS "Hour\""""

COMMIT_JSON = """CASE WHEN status = 200 THEN concat('{"status":200,"commits":[{"commit_id":"', json_extract_string(body, '$[0].sha'),
  '","email":"', json_extract_string(body, '$[0].commit.author.email'),
  '","commiter_name":"', json_extract_string(body, '$[0].commit.author.name'),
  '","commit_date":"', json_extract_string(body, '$[0].commit.author.date'),
  '","user_id":"', coalesce(json_extract_string(body, '$[0].author.login'), ''), '"}]}') ELSE '{}' END"""


def detections(kind, source, words, primary=None, dictionary=True, commits=True, mask_code=True):
    label = {"creds": "Credential", "keys": "Key & Token", "fixed": "Key & Token"}[kind]
    prim = "prim AS Primary_Key," if source == "public" else ""
    ctes = [FILES, hits_ctes(kind, words, primary), score_ctes(dictionary)]
    details, join = "", ""
    if commits:
        ctes.append(COMMITS)
        details = f"coalesce({COMMIT_JSON}, '{{}}') AS Commit_Details,"
        join = f"LEFT JOIN commits ON owner = {OWNER} AND repo = {REPO} AND file_path = {BLOB_PATH}"
    code = mask("line", "secret") if mask_code else "line"
    return f"""WITH {", ".join(ctes)}
SELECT 'scan_{source.capitalize()}_{label}' AS Source, {prim} kw AS Second_Key, ext AS Extension, html_url AS URL,
  {OWNER} AS Owner, {REPO} AS Repo_Name, {details} {code} AS Code, {SCORE_COLUMNS}, {TIME_COLUMNS}
FROM found {join}"""


def training(kind, words, primary=None, files=FILES):
    return f"""WITH {files}, {hits_ctes(kind, words, primary, case_sensitive=True)}, {score_ctes()},
train AS (SELECT secret AS Secret, kw AS Second_Key, ext AS Extension, line AS Code, {SCORE_COLUMNS}, CAST(1 AS INTEGER) AS Label
FROM found)"""
