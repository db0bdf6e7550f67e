"""One registered query per operator: Spark side and, where it exists, SQL side."""

from dataclasses import replace

from pyspark.sql import functions as F

from checks import fixtures as X
from checks import oracle as O
from credsieve import resources as R
from credsieve import schemas
from credsieve.functions import clean, context, extract, mask, score, spans, urls
from credsieve.functions.common import compute_once, let
from credsieve.operators import (
    commits as commit_ops,
    dictionary,
    features,
    ledger,
    ml,
    queries as query_ops,
    weights,
)
from credsieve.operators.partitioning import fill_cores
from credsieve.plans import file_scan, job, keyword_search, scan
from credsieve.scratch import new_path, written
from credsieve.sinks import tables
from credsieve.sinks.runs import RunStore
from credsieve.sinks.seen import SeenLedger
from credsieve.sources import landed, lists, local_files
from credsieve.streaming import stream

QUERIES: dict = {}
ORACLES: dict = {}

PRIMARY = ("import", "mail", "absent")
CONFIG = scan.ScanConfig(
    extensions=R.EXTENSIONS,
    as_of=O.AS_OF,
    pre_url=O.PRE_URL,
    site_host=X.SITE_HOST,
    raw_host=X.RAW_HOST,
)
PUBLIC_CONFIG = replace(CONFIG, source=scan.PUBLIC, primary=PRIMARY)
SCORES = ["SKey_Count", "Entropy", "Dictionary_Similarity", "Score"]


def query(sql=None):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: _prepared(fn, spark, sf_dir)
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _prepared(fn, spark, sf_dir):
    X.ensure_scratch(spark)
    return fn(spark, sf_dir)


def rounded(df, columns=SCORES):
    return df.withColumns({c: F.round(c, 6) for c in columns if c in df.columns})


def texts(spark, sf):
    """All texts of the tables: code corpus, documents and pages."""
    code = X.code_files(spark, sf).select(
        F.concat(F.lit("c"), F.col("file_id").cast("string")).alias("id"), "content"
    )
    docs = X.documents(spark, sf, "text").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        F.col("text").alias("content"),
    )
    pages = fill_cores(X.table(spark, sf, "pages").select("page_id", "html"), "page_id").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"),
        F.col("html").alias("content"),
    )
    return code.unionByName(docs).unionByName(pages)


def _csv(spark, df, name):
    """Write a one-column list or table as CSV and give its path."""
    path = new_path(spark, name)
    (
        df.write.option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


# --- sources -----------------------------------------------------------------


@query("SELECT c_name AS keyword FROM customer UNION ALL SELECT c_mktsegment FROM customer")
def read_keywords(spark, sf):
    c = X.table(spark, sf, "customer")
    names = c.select(F.col("c_name").alias("primary_keys")).unionByName(
        c.select(F.col("c_mktsegment").alias("primary_keys"))
    )
    return lists.read_keywords(spark, _csv(spark, names, "keywords"), "primary")


@query("SELECT source AS type FROM documents")
def read_extensions(spark, sf):
    return lists.read_extensions(
        spark, _csv(spark, X.table(spark, sf, "documents").select("source"), "extensions")
    )


@query("SELECT c_name AS key, CAST(c_custkey % 6 AS INTEGER) AS value FROM customer")
def read_confidence(spark, sf):
    table = X.table(spark, sf, "customer").select(
        F.col("c_name").alias("key"), (F.col("c_custkey") % 6).alias("value")
    )
    return lists.read_confidence(spark, _csv(spark, table, "confidence"))


@query("SELECT CASE WHEN c_custkey % 2 = 0 THEN concat(c_name, ' ') ELSE c_name END AS word FROM customer")
def read_stop_words(spark, sf):
    words = X.table(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(" ")))
        .otherwise(F.col("c_name"))
        .alias("Stop Words")
    )
    return lists.read_stop_words(spark, _csv(spark, words, "stop"))


@query(f"WITH {O.DICTIONARY} SELECT w AS dic_word FROM words")
def read_dictionary(spark, sf):
    words = dictionary.dictionary_words(X.documents(spark, sf, "text"))
    return lists.read_dictionary(spark, _csv(spark, words, "dictionary"))


_LAST_RUN = "1998-01-01"


def _ledger_rows(spark, sf, landed_before=None):
    """Ledger of all files, or of a run that saw the files landed before a date."""
    files = X.code_files(spark, sf)
    if landed_before is not None:
        files = files.where(F.col("indexed_at") < F.lit(landed_before).cast("timestamp"))
    pairs = query_ops.match_files(files, X.CORE_KEYWORDS).withColumn("kw", F.explode("found.kw"))
    return ledger.ledger_rows(scan.with_fingerprint(pairs, CONFIG))


_LEDGER_SQL = f"""ledger_rows AS (SELECT DISTINCT md5(concat({O.CONTENTS_URL}, '"', kw, '"')) AS hashed_url, {O.CONTENTS_URL} AS url
FROM files JOIN core ON contains(lower(content), kw)),
seen_rows AS (SELECT DISTINCT md5(concat({O.CONTENTS_URL}, '"', kw, '"')) AS hashed_url
FROM files JOIN core ON contains(lower(content), kw) WHERE indexed_at < TIMESTAMP '{_LAST_RUN}')"""
_LEDGER_CTES = f"{O.FILES}, {O.words_cte(X.CORE_KEYWORDS, 'core0')}, core AS (SELECT kw FROM core0), {_LEDGER_SQL}"


@query(f"WITH {_LEDGER_CTES} SELECT hashed_url FROM ledger_rows")
def read_url_ledger(spark, sf):
    path = new_path(spark, "url-ledger")
    tables.append_ledger(_ledger_rows(spark, sf), path)
    return lists.read_url_ledger(spark, path)


@query(
    """SELECT DISTINCT 'hashed_files' AS part, md5(c_mktsegment) AS value FROM customer
UNION ALL SELECT DISTINCT 'file_modification_hash', md5(concat(c_mktsegment, CAST(c_nationkey AS VARCHAR))) FROM customer
UNION ALL SELECT DISTINCT 'files', c_mktsegment FROM customer"""
)
def read_file_ledger(spark, sf):
    listing = X.table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("path"), F.col("c_nationkey").alias("modified_ms")
    )
    path = new_path(spark, "file-ledger")
    ledger.file_ledger_rows(listing).write.parquet(path)
    parts = lists.read_file_ledger(spark, path)
    out = None
    for name in schemas.FILE_LEDGER:
        part = parts[name].select(F.lit(name).alias("part"), F.col(name).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"""{O.training('creds', R.SECONDARY_CREDS)}
SELECT Key_Weight, SKey_Count, Entropy, length(Secret) AS Len_Key, length(Code) AS Len_Code FROM train"""
)
def read_training(spark, sf):
    rows = features.engineer_features(rounded(_collected(spark, sf, "creds", False)))
    path = _csv(spark, rows, "training")
    table = lists.training_columns(lists.read_training(spark, path))
    return table.select("Key_Weight", "SKey_Count", "Entropy", "Len_Key", "Len_Code")


@query(
    f"""WITH {O.FILES} SELECT html_url, {O.BLOB_PATH} AS path, concat({O.OWNER}, '/', {O.REPO}) AS full_name,
CAST(indexed_at AS VARCHAR) AS indexed_at FROM files"""
)
def search_results(spark, sf):
    url = F.col("html_url")
    name = F.concat_ws("/", urls.url_owner(url), urls.url_repo(url))
    items = X.code_files(spark, sf).select(
        url,
        urls.blob_file_path(url).alias("path"),
        F.struct(name.alias("full_name")).alias("repository"),
        "indexed_at",
    )
    path = new_path(spark, "search")
    items.write.json(path)
    found = landed.search_results(spark.read.schema(schemas.SEARCH_RESULT).json(path))
    return found.withColumn("indexed_at", F.date_format("indexed_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    """SELECT doc_id AS file_id, length(text) AS chars, md5(text) AS digest FROM documents
WHERE text IS NOT NULL"""
)
def code_files(spark, sf):
    return landed.code_files(X.document_files(spark, sf)).select(
        "file_id", F.length("content").alias("chars"), F.md5("content").alias("digest")
    )


@query(f"WITH {O.COMMITS} SELECT owner, repo, file_path, status, body FROM commits")
def commits(spark, sf):
    path = new_path(spark, "commits")
    X.commits_raw(spark, sf).write.json(path)
    return landed.commits(spark.read.schema(schemas.COMMITS_RAW).json(path))


# Files of a tree with one folder per nation and one file per customer.
_TREE_SQL = """tree AS (SELECT concat('n', CAST(c_nationkey AS STRING), '/',
  CASE c_custkey % 5 WHEN 0 THEN '__init__' WHEN 1 THEN '.hidden' ELSE 'file' END, CAST(c_custkey AS STRING),
  CASE c_custkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.tar.json' WHEN 2 THEN '.PY' ELSE '' END) AS path,
  concat('# ', c_name, chr(10), 'import os', chr(10), 'password = "', substr(md5(c_name), 1, 20), '"', chr(10),
    'api_key: "AKIA', upper(substr(md5(c_name), 1, 16)), '"', chr(10)) AS content FROM customer)"""
#: Files of the tree that one task writes.
_TREE_FILES_A_TASK = 20_000
_TREE_EXTENSIONS = ("py", "json", "gitignore")


def _tree(spark, sf, root=None, part=""):
    """Write the tree into the scratch folder, or a part of it again; gives its root."""
    root = root or new_path(spark, "tree").removeprefix("file:")
    customer = X.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_name")
    rows = spark.sql(
        "WITH " + _TREE_SQL.replace("FROM customer", f"FROM {{customer}} {part}") + " SELECT * FROM tree",
        customer=fill_cores(customer, "c_custkey", _TREE_FILES_A_TASK),
    )

    def write_files(batches):
        import os

        made = set()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                target = os.path.join(root, path)
                folder = os.path.dirname(target)
                if folder not in made:
                    os.makedirs(folder, exist_ok=True)
                    made.add(folder)
                with open(target, "w") as handle:
                    handle.write(content)
            yield batch[["path"]]

    rows.mapInPandas(write_files, "path string").write.format("noop").mode("overwrite").save()
    return root


def _below(root, column):
    return F.substring(column, F.lit(len(root) + 2), F.length(column))


_TREE_LISTED = """listed AS (SELECT path, content FROM tree
  WHERE regexp_matches(path, '[^/]\\.(py|json|gitignore)$'))"""


@query(f"WITH {_TREE_SQL}, {_TREE_LISTED} SELECT path, length(content) AS length FROM listed")
def list_files(spark, sf):
    root = _tree(spark, sf)
    found = local_files.list_files(spark, [root], _TREE_EXTENSIONS)
    return found.select(_below(root, F.col("path")).alias("path"), "length")


@query(f"WITH {_TREE_SQL}, {_TREE_LISTED} SELECT path, content FROM listed")
def read_local_code(spark, sf):
    root = _tree(spark, sf)
    found = local_files.list_files(spark, [root], _TREE_EXTENSIONS)
    return local_files.read_local_code(found).select(
        _below(root, F.col("path")).alias("path"), "content"
    )


@query(f"WITH {_TREE_SQL}, {_TREE_LISTED} SELECT path, length(content) AS length, content FROM listed")
def read_store_code(spark, sf):
    """Listed and read through the store that a URI names, without a mount."""
    root = "file://" + _tree(spark, sf)
    found = local_files.list_files(spark, [root], _TREE_EXTENSIONS)
    bodies = local_files.read_local_code(found).join(found, "path")
    return bodies.select(_below(root, F.col("path")).alias("path"), "length", "content")


# --- queries and predicates --------------------------------------------------


@query(
    """SELECT r_name AS "primary", c_name AS secondary, concat(r_name, ' ', c_name) AS query
FROM region CROSS JOIN (SELECT DISTINCT c_name FROM customer)"""
)
def public_queries(spark, sf):
    return query_ops.public_queries(
        X.table(spark, sf, "region").select("r_name"),
        X.table(spark, sf, "customer").select(F.col("c_name").alias("keyword")).distinct(),
    )


@query("SELECT c_name AS secondary, concat('\"', c_name, '\"') AS query FROM customer")
def enterprise_queries(spark, sf):
    return query_ops.enterprise_queries(
        X.table(spark, sf, "customer").select(F.col("c_name").alias("keyword"))
    )


@query("SELECT s_name AS secondary, concat('\"', s_name, '\"') AS query FROM supplier")
def keyword_queries(spark, sf):
    return query_ops.keyword_queries(
        X.table(spark, sf, "supplier").select(F.col("s_name").alias("keyword"))
    )


@query(
    """SELECT s_name AS secondary, concat('"', s_name, '"') AS query, n_name AS search_extension
FROM supplier CROSS JOIN nation"""
)
def search_pairs(spark, sf):
    words = X.table(spark, sf, "supplier").select(F.col("s_name").alias("keyword"))
    types = X.table(spark, sf, "nation").select("n_name")
    return query_ops.search_pairs(query_ops.enterprise_queries(words), types)


_EXTS = ("py", "js", "others", "zzz")


@query(
    f"""WITH {O.FILES}, kws AS (SELECT * FROM (VALUES {', '.join(f"({O.q(w)})" for w in R.SECONDARY_CREDS)}) v(kw)),
{O.words_cte(_EXTS, 'exts')}
SELECT file_id, k.kw AS keyword, e.kw AS search_extension FROM files JOIN kws k ON contains(lower(content), lower(k.kw))
JOIN exts e ON e.kw = 'others' OR e.kw = {O.EXT}"""
)
def keyword_match_enterprise(spark, sf):
    files = X.code_files(spark, sf)
    pairs = query_ops.keyword_match(files, R.SECONDARY_CREDS, extensions=_EXTS)
    return pairs.select("file_id", "keyword", "search_extension")


@query(
    f"""WITH {O.FILES}, {O.words_cte(R.SECONDARY_KEYS)}, {O.words_cte(PRIMARY, 'prims')}
SELECT file_id, p.kw AS "primary", k.kw AS keyword, {O.EXT} AS search_extension
FROM files JOIN kws k ON contains(lower(content), k.kw) JOIN prims p ON contains(lower(content), p.kw)
WHERE {O.EXT} IN ('py', 'txt')"""
)
def keyword_match_public(spark, sf):
    pairs = query_ops.keyword_match(
        X.code_files(spark, sf), R.SECONDARY_KEYS, PRIMARY, ("py", "txt")
    )
    return pairs.select("file_id", "primary", "keyword", "search_extension")


@query(f"WITH {O.FILES} SELECT file_id FROM files WHERE {O.OWNER} IN ('org1', 'org5')")
def scope_filter_orgs(spark, sf):
    files = X.code_files(spark, sf)
    return query_ops.scope_filter(files, ["org1", "org5"], ["org2/repo3"]).select("file_id")


@query(
    f"WITH {O.FILES} SELECT file_id FROM files WHERE concat({O.OWNER}, '/', {O.REPO}) IN ('org2/repo3', 'org0/repo7')"
)
def scope_filter_repos(spark, sf):
    files = X.code_files(spark, sf)
    return query_ops.scope_filter(files, repos=["org2/repo3", "org0/repo7"]).select("file_id")


@query(
    f"""WITH {O.FILES} SELECT file_id, strftime(indexed_at, '%Y-%m-%d') AS indexed
FROM files"""
)
def newest_first(spark, sf):
    ordered = query_ops.newest_first(X.code_files(spark, sf).drop("content"))
    return ordered.select("file_id", F.date_format("indexed_at", "yyyy-MM-dd").alias("indexed"))


# --- URLs --------------------------------------------------------------------


@query(f"WITH {O.FILES} SELECT file_id, {O.RAW_URL} AS raw_url FROM files")
def to_raw_url(spark, sf):
    raw = urls.to_raw_url(F.col("html_url"), X.SITE_HOST, X.RAW_HOST)
    return X.code_files(spark, sf).select("file_id", raw.alias("raw_url"))


@query(f"WITH {O.FILES} SELECT file_id, {O.CONTENTS_URL} AS contents_url FROM files")
def to_contents_url(spark, sf):
    files = scan.with_fetch_url(X.code_files(spark, sf).drop("content"), CONFIG)
    return files.select("file_id", F.col("fetch_url").alias("contents_url"))


@query(f"WITH {O.FILES} SELECT file_id, html_url AS blob_url FROM files")
def to_blob_url(spark, sf):
    raw = urls.to_raw_url(F.col("html_url"), X.SITE_HOST, X.RAW_HOST)
    blob = urls.to_blob_url(raw, X.SITE_HOST, X.RAW_HOST)
    return X.code_files(spark, sf).select("file_id", blob.alias("blob_url"))


@query(
    """SELECT page_id, string_split(url, '/')[4] AS owner, string_split(url, '/')[5] AS repo,
string_split(url, '.')[-1] AS extension FROM pages"""
)
def url_parts(spark, sf):
    url = F.col("url")
    return X.table(spark, sf, "pages").select(
        "page_id",
        urls.url_owner(url).alias("owner"),
        urls.url_repo(url).alias("repo"),
        urls.url_extension(url).alias("extension"),
    )


@query(
    f"WITH {O.FILES} SELECT file_id, {O.BLOB_PATH} AS public_path, {O.BLOB_PATH} AS enterprise_path FROM files"
)
def repo_file_path(spark, sf):
    files = X.code_files(spark, sf).drop("content")
    public = scan.with_fetch_url(files, PUBLIC_CONFIG).select(
        "file_id", "html_url", F.col("file_path").alias("public_path")
    )
    both = scan.with_fetch_url(public, CONFIG)
    return both.select("file_id", "public_path", F.col("file_path").alias("enterprise_path"))


# --- ledger ------------------------------------------------------------------

_PAIRS = f"""pairs AS (SELECT file_id, kw, {O.CONTENTS_URL} AS url,
md5(concat({O.CONTENTS_URL}, '"', kw, '"')) AS hashed_url FROM files JOIN core ON contains(lower(content), kw))"""


def _core_pairs(spark, sf):
    matched = query_ops.match_files(X.code_files(spark, sf), X.CORE_KEYWORDS)
    pairs = matched.select("file_id", "html_url", F.explode("found.kw").alias("kw"))
    return scan.with_fingerprint(pairs, CONFIG)


@query(f"WITH {_LEDGER_CTES}, {_PAIRS} SELECT file_id, kw, hashed_url FROM pairs")
def fingerprint(spark, sf):
    return _core_pairs(spark, sf).select("file_id", "kw", "hashed_url")


@query(
    f"WITH {_LEDGER_CTES}, {_PAIRS} SELECT file_id, kw FROM pairs WHERE hashed_url NOT IN (SELECT hashed_url FROM seen_rows)"
)
def drop_seen(spark, sf):
    seen = _ledger_rows(spark, sf, _LAST_RUN)
    return ledger.drop_seen(_core_pairs(spark, sf), seen).select("file_id", "kw")


@query(
    f"""WITH {_LEDGER_CTES}, {_PAIRS} SELECT DISTINCT hashed_url, url FROM pairs
WHERE hashed_url NOT IN (SELECT hashed_url FROM seen_rows)"""
)
def ledger_rows(spark, sf):
    return ledger.ledger_rows(_core_pairs(spark, sf), _ledger_rows(spark, sf, _LAST_RUN))


@query(
    """SELECT c_name AS path FROM customer
WHERE NOT (c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey < 12)"""
)
def drop_seen_files(spark, sf):
    """Files of two segments are known; those of the later nations changed since."""
    customers = X.table(spark, sf, "customer")
    known = customers.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(
        F.col("c_name").alias("path"), F.col("c_custkey").alias("modified_ms")
    )
    changed = (F.col("c_nationkey") >= 12).cast("bigint")
    now = customers.select(
        F.col("c_name").alias("path"), (F.col("c_custkey") + changed).alias("modified_ms")
    )
    return ledger.drop_seen_files(now, ledger.file_ledger_rows(known)).select("path")


@query(
    f"""WITH {O.FILES}, {O.hits_ctes('creds', X.CORE_KEYWORDS)}, {O.CONFIDENCE}, {O.DICTIONARY}, {O.match_rows('hits')},
sums AS (SELECT html_url, kw, ext, {O.mask('line', 'secret')} AS code,
  coalesce(k.value, 0) + coalesce(e.value, 0) + entropy + log2(50) / (log2(n + 1) + 1)
  + log2(100) / (log2(unnest([0.0, match]) + 1) + 1) AS score
  FROM hits JOIN matches USING (secret) LEFT JOIN conf k ON k.key = kw LEFT JOIN conf e ON e.key = ext)
SELECT kw AS Second_Key, ext AS Extension, html_url AS URL, code AS Code, round(max(score), 6) AS Score FROM sums GROUP BY ALL"""
)
def unique_detections(spark, sf):
    """Two runs, with and without dictionary, report the same lines."""
    config = replace(CONFIG, keywords=X.CORE_KEYWORDS)
    files = X.code_files(spark, sf)
    twice = scan.scan_creds(files, config).unionByName(
        scan.scan_creds(files, config, ngrams=X.ngram_table(spark, sf))
    )
    unique = ledger.unique_detections(twice)
    return rounded(unique.select("Second_Key", "Extension", "URL", "Code", "Score"))


# --- gates and cleaning ------------------------------------------------------


@query(
    f"""WITH {O.TEXTS}, based AS (SELECT id, content, {O.LINKLESS} AS base FROM texts)
SELECT id, len(regexp_extract_all(content, {O.q(O.URL)})) + len(regexp_extract_all(base, {O.q(O.BARE)})) AS urls FROM based"""
)
def gate_url_count(spark, sf):
    content = F.col("content")
    count = let(clean.strip_links(content), lambda t: clean.url_count(content, t))
    return texts(spark, sf).select("id", count.cast("bigint").alias("urls"))


@query(f"WITH {O.FILES} SELECT file_id FROM files WHERE {O.EXT} <> 'md'")
def gate_markdown(spark, sf):
    files = X.code_files(spark, sf).drop("content")
    return files.where(clean.not_markdown(urls.url_extension(F.col("html_url")))).select("file_id")


@query(f"WITH {O.TEXTS} SELECT id FROM texts WHERE len(string_split(content, chr(10))) > 2")
def gate_short(spark, sf):
    return texts(spark, sf).where(clean.long_enough(F.col("content"))).select("id")


@query(
    f"""WITH {O.FILES}, {O.gated_ctes('creds')}, {O.words_cte(R.SECONDARY_CREDS)}
SELECT file_id, count(*) AS candidates FROM cands WHERE file_id IN
  (SELECT file_id FROM files JOIN kws ON contains(lower(content), kw)) GROUP BY file_id"""
)
def gate_candidates(spark, sf):
    files = X.code_files(spark, sf)
    kept = scan.file_candidates(files, CONFIG)
    return kept.select("file_id", F.size("candidates").cast("bigint").alias("candidates"))


def _digest(spark, sf, expr):
    return texts(spark, sf).select("id", F.md5(expr(F.col("content"))).alias("digest"))


def _digest_sql(expr):
    return f"""WITH {O.TEXTS}, based AS (SELECT id, content, {O.LINKLESS} AS base FROM texts)
SELECT id, md5({expr}) AS digest FROM based"""


@query(_digest_sql(f"regexp_replace(content, {O.q(O.URL)}, ' ', 'g')"))
def strip_urls(spark, sf):
    return _digest(spark, sf, clean.strip_urls)


@query(_digest_sql(f"regexp_replace(content, {O.q(O.EMAIL)}, ' ', 'g')"))
def strip_emails(spark, sf):
    return _digest(spark, sf, clean.strip_emails)


@query(_digest_sql(f"regexp_replace(base, {O.q(O.BARE)}, ' ', 'g')"))
def strip_bare_urls(spark, sf):
    return _digest(spark, sf, lambda c: clean.strip_bare_urls(clean.strip_links(c)))


def _page_domains(spark, sf, labels):
    """The last labels of all hosts of the pages, and their texts and URLs without scheme."""
    pages = X.table(spark, sf, "pages").select("page_id", "url")
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]*)", 1))
    suffixes = pages.select(F.substring_index(host, ".", -labels).alias("domain")).where("domain <> ''")
    bare = pages.select(
        F.concat(F.lit("u"), F.col("page_id").cast("string")).alias("id"),
        F.regexp_replace("url", "^[a-z]+://", "").alias("content"),
    )
    return lists.domain_table(suffixes), texts(spark, sf).unionByName(bare)


@query(
    f"""WITH {O.domain_ctes(1)}
SELECT id, len(regexp_extract_all(marked, {O.q(O.MARKED_URL)})) AS urls FROM marks"""
)
def gate_url_count_domains(spark, sf):
    table, bodies = _page_domains(spark, sf, 1)
    count = clean.bare_url_count(clean.strip_links(F.col("content")), table)
    return bodies.select("id", count.cast("bigint").alias("urls"))


@query(
    f"""WITH {O.domain_ctes(2)}
SELECT id, md5(regexp_replace(marked, {O.q(O.MARKED_URL)}, ' ', 'g')) AS digest FROM marks"""
)
def strip_bare_urls_domains(spark, sf):
    table, bodies = _page_domains(spark, sf, 2)
    blanked = clean.strip_bare_urls(clean.strip_links(F.col("content")), table)
    return bodies.select("id", F.md5(blanked).alias("digest"))


@query(_digest_sql(O.key_text("base")))
def clean_for_keys(spark, sf):
    return _digest(spark, sf, clean.clean_for_keys)


@query(_digest_sql(O.cred_text("base")))
def clean_for_creds(spark, sf):
    return _digest(spark, sf, clean.clean_for_creds)


@query(
    f"""WITH {O.TEXTS} SELECT id, t AS token, count(*) AS n FROM
(SELECT id, unnest({O.tokens_of('content')}) AS t FROM texts) GROUP BY id, t"""
)
def tokenize(spark, sf):
    words = texts(spark, sf).select("id", F.explode(clean.tokenize(F.col("content"))).alias("token"))
    return words.groupBy("id", "token").agg(F.count("*").alias("n"))


# --- extraction --------------------------------------------------------------


@query(
    f"""WITH {O.TEXTS}, cleaned AS (SELECT id, {O.key_text('base')} AS text FROM (SELECT id, {O.LINKLESS} AS base FROM texts))
{O.key_rows('cleaned', 'id')}"""
)
def extract_keys(spark, sf):
    cleaned = compute_once(texts(spark, sf), ["id"], text=clean.clean_for_keys(F.col("content")))
    return cleaned.select("id", F.explode(extract.key_candidates(F.col("text"))).alias("secret"))


@query(
    f"""WITH {O.TEXTS}, cleaned AS (SELECT id, {O.cred_text('base')} AS text FROM (SELECT id, {O.LINKLESS} AS base FROM texts))
{O.cred_rows('cleaned', 'id')}"""
)
def extract_creds(spark, sf):
    cleaned = compute_once(texts(spark, sf), ["id"], text=clean.clean_for_creds(F.col("content")))
    return cleaned.select("id", F.explode(extract.cred_candidates(F.col("text"))).alias("secret"))


_KEY_TEXTS = f"""{O.TEXTS.replace('files AS', 'code AS', 1).replace('FROM files', 'FROM code', 1)},
{O.KEY_FILES}, all_texts AS (SELECT id, content AS text FROM texts
  UNION ALL SELECT concat('k', CAST(file_id AS VARCHAR)), content FROM files)"""


def _key_texts(spark, sf):
    keys = X.key_files(spark, sf).select(
        F.concat(F.lit("k"), F.col("file_id").cast("string")).alias("id"), "content"
    )
    return texts(spark, sf).unionByName(keys)


@query(f"WITH {_KEY_TEXTS} SELECT id, start, stop, name, secret FROM ({O.span_rows('all_texts', 'id')})")
def extract_keys_fixed(spark, sf):
    """Keys of the fixed bank in raw texts, with their places; of overlapping ones the longest."""
    found = compute_once(_key_texts(spark, sf), ["id"], spans=spans.key_spans(F.col("content")))
    rows = found.select("id", F.explode("spans").alias("s"))
    return rows.select("id", "s.start", F.col("s.end").alias("stop"), "s.name", "s.secret")


# --- scores ------------------------------------------------------------------


@query(
    f"""WITH {O.FILES}, {O.CONFIDENCE}, {O.words_cte(R.SECONDARY_CREDS)}
SELECT file_id, kw, {O.EXT} AS ext, CAST(coalesce(k.value, 0) AS INTEGER) AS keyword_weight, CAST(coalesce(e.value, 0) AS INTEGER) AS extension_weight,
CAST(coalesce(k.value, 0) + coalesce(e.value, 0) AS INTEGER) AS Key_Weight
FROM files JOIN kws ON contains(lower(content), kw) LEFT JOIN conf k ON k.key = kw LEFT JOIN conf e ON e.key = {O.EXT}"""
)
def key_weight(spark, sf):
    matched = query_ops.match_files(X.code_files(spark, sf), R.SECONDARY_CREDS)
    pairs = matched.select("file_id", F.explode("found.kw").alias("kw"), "ext")
    return weights.key_weight(pairs, lists.read_confidence(spark))


@query(
    f"""WITH {O.FILES}, {O.CONFIDENCE} SELECT DISTINCT {O.EXT} AS keyword FROM files
WHERE {O.EXT} NOT IN (SELECT key FROM conf)"""
)
def unweighted_keywords(spark, sf):
    used = X.code_files(spark, sf).select(urls.url_extension(F.col("html_url")).alias("keyword"))
    return weights.unweighted_keywords(used, lists.read_confidence(spark))


_CREDS_OF_TEXTS = f"""{O.TEXTS}, cleaned AS (SELECT id, {O.cred_text('base')} AS text FROM (SELECT id, {O.LINKLESS} AS base FROM texts)),
tokens AS ({O.cred_rows('cleaned', 'id')}), distinct_tokens AS (SELECT DISTINCT 1 AS one, secret FROM tokens)"""


def _distinct_creds(spark, sf):
    return extract_creds(spark, sf).select("secret").distinct()


def _stored_creds(spark, sf):
    return written(_distinct_creds(spark, sf), "secrets", seal=["secret"])


@query(
    f"""WITH {_CREDS_OF_TEXTS}, scored AS ({O.entropy_rows('distinct_tokens', 'one')})
SELECT secret, round(entropy, 6) AS entropy FROM scored"""
)
def shannon_entropy(spark, sf):
    return _distinct_creds(spark, sf).select(
        "secret", F.round(score.shannon_entropy(F.col("secret")), 6).alias("entropy")
    )


@query(
    f"""WITH {_CREDS_OF_TEXTS}, scored AS ({O.entropy_rows('distinct_tokens', 'one')})
SELECT secret FROM scored WHERE entropy > 1.5"""
)
def entropy_gate(spark, sf):
    secrets = _distinct_creds(spark, sf)
    return secrets.where(score.shannon_entropy(F.col("secret")) > score.MIN_ENTROPY)


@query(f"WITH {O.DICTIONARY} SELECT ngram, total, doc_freq, round(log_total, 6) AS log_total FROM ngrams")
def build_ngram_table(spark, sf):
    return dictionary.build_ngram_table(X.stored_words(spark, sf)).withColumn("log_total", F.round("log_total", 6))


_MATCH_SQL = f"WITH {_CREDS_OF_TEXTS}, {O.DICTIONARY}, {O.match_rows('tokens')}"


@query(f"{_MATCH_SQL} SELECT secret, round(match, 6) AS match FROM matches")
def dictionary_match(spark, sf):
    scored = dictionary.dictionary_match(_stored_creds(spark, sf), X.ngram_table(spark, sf))
    return scored.select("secret", F.round("match", 6).alias("match"))


@query(f"{_MATCH_SQL} SELECT secret, round(match, 6) AS match FROM matches")
def dictionary_match_large_table(spark, sf):
    """The way taken by a table that is too large to broadcast."""
    ngrams = X.ngram_table(spark, sf)
    scored = dictionary.dictionary_match(_stored_creds(spark, sf), ngrams, max_rows=0)
    return scored.select("secret", F.round("match", 6).alias("match"))


@query(f"{_MATCH_SQL} SELECT secret, round(log2(100) / (log2(match + 1) + 1), 6) AS score FROM matches")
def dictionary_score(spark, sf):
    scored = dictionary.dictionary_match(_stored_creds(spark, sf), X.ngram_table(spark, sf))
    return scored.select(
        "secret", F.round(score.dictionary_score(F.col("match")), 6).alias("score")
    )


@query(
    f"""WITH {O.TEXTS}, {O.words_cte(R.SECONDARY_CREDS)} SELECT id, kw, {O.n_of('kw')} AS n
FROM texts JOIN kws ON contains(lower(content), kw)"""
)
def keyword_count(spark, sf):
    found = compute_once(
        texts(spark, sf),
        ["id"],
        found=query_ops.found_words(F.col("content"), R.SECONDARY_CREDS),
    )
    return found.select("id", F.inline("found"))


@query(
    f"""WITH {O.TEXTS} SELECT id, round(log2(50) / (log2({O.n_of("'the'")} + 1) + 1), 6) AS score FROM texts"""
)
def count_score(spark, sf):
    n = score.keyword_count(F.col("content"), F.lit("the"))
    return texts(spark, sf).select("id", F.round(score.count_score(n), 6).alias("score"))


@query(
    f"""WITH {O.FILES}, {O.hits_ctes('creds', R.SECONDARY_CREDS)}, {O.score_ctes(True)}
SELECT file_id, kw, secret, round(weight + entropy + count_score + dict_score, 6) AS score FROM found"""
)
def total_score(spark, sf):
    config = replace(CONFIG, keep_secret=True, columns=("URL", "Second_Key", "Secret", "Score"))
    found = scan.scan_creds(X.code_files(spark, sf), config, ngrams=X.ngram_table(spark, sf))
    ident = F.regexp_extract("URL", r"/f(\d+)\.[a-z]+$", 1).cast("bigint")
    return found.select(
        ident.alias("file_id"),
        F.col("Second_Key").alias("kw"),
        F.col("Secret").alias("secret"),
        F.round("Score", 6).alias("score"),
    )


# --- context -----------------------------------------------------------------

_FILE_CANDS = f"""{O.FILES}, {O.gated_ctes('creds')}, {O.words_cte(X.CORE_KEYWORDS)},
lines AS (SELECT file_id, unnest(string_split(content, chr(10))) AS line,
  unnest(range(len(string_split(content, chr(10))))) AS line_no FROM gated),
trios AS (SELECT g.file_id, kw, secret FROM gated g JOIN kws ON contains(lower(content), kw) JOIN cands USING (file_id))"""


def _with_body(spark, sf):
    """Files with a search term that pass all gates, their candidates and their body."""
    config = replace(CONFIG, keywords=X.CORE_KEYWORDS, extensions=())
    return scan.file_candidates(X.code_files(spark, sf), config, with_content=True)


def _secret_lines(spark, sf):
    """The lines that hold each candidate, picked out in the row of the file: a body is
    split once and goes no further."""
    lines = F.transform(
        context.content_lines(F.col("content")),
        lambda line, at: F.struct(at.cast("bigint").alias("line_no"), line.alias("line")),
    )

    def own(every):
        return F.transform(
            F.array_distinct("candidates"),
            lambda s: F.struct(
                s.alias("secret"), F.filter(every, lambda l: F.contains(l["line"], s)).alias("lines")
            ),
        )

    kept = _with_body(spark, sf).withColumn("kws", F.col("found.kw"))
    rows = compute_once(kept, ["file_id", "kws"], own=let(lines, own))
    rows = rows.select("file_id", "kws", F.explode("own").alias("o"))
    return rows.select("file_id", "kws", "o.secret", F.inline("o.lines"))


@query(
    f"""WITH {_FILE_CANDS} SELECT DISTINCT file_id, secret, line_no, line
FROM trios JOIN lines USING (file_id) WHERE contains(line, secret)"""
)
def candidate_lines(spark, sf):
    return _secret_lines(spark, sf).select("file_id", "secret", "line_no", "line")


def _line_hits_sql(kind, case_sensitive):
    cond = O.hit_condition(kind, case_sensitive).replace("length(line) < 300 AND ", "")
    return f"WITH {_FILE_CANDS} SELECT file_id, kw, secret, line FROM trios JOIN lines USING (file_id) WHERE {cond}"


def _line_hits(spark, sf, test, case_sensitive):
    hit = test(F.col("line"), F.col("kw"), F.col("secret"), case_sensitive)
    rows = _secret_lines(spark, sf).select("*", F.explode("kws").alias("kw"))
    return rows.where(hit).select("file_id", "kw", "secret", "line")


@query(_line_hits_sql("keys", False))
def line_is_key_hit(spark, sf):
    return _line_hits(spark, sf, context.line_is_key_hit, False)


@query(_line_hits_sql("creds", False))
def line_is_cred_hit(spark, sf):
    return _line_hits(spark, sf, context.line_is_cred_hit, False)


@query(_line_hits_sql("keys", True))
def line_is_key_hit_case_sensitive(spark, sf):
    return _line_hits(spark, sf, context.line_is_key_hit, True)


@query(_line_hits_sql("creds", True))
def line_is_cred_hit_case_sensitive(spark, sf):
    return _line_hits(spark, sf, context.line_is_cred_hit, True)


@query(
    f"""WITH {O.TEXTS}, lines AS (SELECT id, unnest(string_split(content, chr(10))) AS line FROM texts)
SELECT id, count(*) AS n FROM lines WHERE length(line) < 300 GROUP BY id"""
)
def line_short(spark, sf):
    lines = texts(spark, sf).select("id", F.explode(context.content_lines(F.col("content"))).alias("line"))
    return lines.where(context.line_short(F.col("line"))).groupBy("id").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_FILE_CANDS} SELECT file_id, kw, secret, arg_min(line, line_no) AS line
FROM trios JOIN lines USING (file_id) WHERE {O.hit_condition('creds')} GROUP BY file_id, kw, secret"""
)
def first_hit(spark, sf):
    candidates = F.transform(
        F.array_distinct("candidates"), lambda s: F.struct(s.alias("secret"), F.lit(0.0).alias("entropy"))
    )
    hits = context.file_hits(F.col("content"), F.col("found"), candidates, need_separator=True)
    rows = compute_once(_with_body(spark, sf), ["file_id"], hits=hits)
    rows = rows.select("file_id", F.explode("hits").alias("h"))
    rows = rows.select("file_id", "h.secret", F.explode("h.matches").alias("m"))
    return rows.select("file_id", "m.kw", "secret", "m.line")


# --- masking -----------------------------------------------------------------

_LINE_TOKENS = f"""{O.TEXTS}, lines AS (SELECT id, unnest(string_split(content, chr(10))) AS line FROM texts),
pairs AS (SELECT DISTINCT line, t AS secret FROM (SELECT line, unnest({O.tokens_of('line')}) AS t FROM lines WHERE length(line) < 300)
  WHERE length(t) >= 7)"""


def _line_tokens(spark, sf):
    lines = texts(spark, sf).select(F.explode(context.content_lines(F.col("content"))).alias("line"))
    short = lines.where(context.line_short(F.col("line")))
    words = short.select("line", F.explode(clean.tokenize(F.col("line"))).alias("secret"))
    return words.where(F.length("secret") >= 7).distinct()


@query(f"WITH {_LINE_TOKENS} SELECT md5(line) AS line, secret, {O.mask('line', 'secret')} AS code FROM pairs")
def mask_line(spark, sf):
    return _line_tokens(spark, sf).select(
        F.md5("line").alias("line"), "secret", mask.mask_line(F.col("line"), F.col("secret")).alias("code")
    )


@query(
    f"WITH {_LINE_TOKENS} SELECT md5(line) AS line, secret, {O.mask('line', 'secret', compat=True)} AS code FROM pairs"
)
def mask_line_compat(spark, sf):
    code = mask.mask_line(F.col("line"), F.col("secret"), compat_mask=True)
    return _line_tokens(spark, sf).select(F.md5("line").alias("line"), "secret", code.alias("code"))


# --- scans -------------------------------------------------------------------


def _inputs(spark, sf):
    return {"ngrams": X.ngram_table(spark, sf), "commits": X.commits_raw(spark, sf)}


@query(O.detections("creds", "enterprise", R.SECONDARY_CREDS))
def scan_creds_enterprise(spark, sf):
    return rounded(scan.scan_creds(X.code_files(spark, sf), CONFIG, **_inputs(spark, sf)))


@query(O.detections("keys", "enterprise", R.SECONDARY_KEYS))
def scan_keys_enterprise(spark, sf):
    return rounded(scan.scan_keys(X.code_files(spark, sf), CONFIG, **_inputs(spark, sf)))


@query(O.detections("fixed", "enterprise", R.SECONDARY_KEYS).replace(O.FILES, O.KEY_FILES, 1))
def scan_keys_fixed(spark, sf):
    """Key scan with the patterns of the fixed bank, over files with keys of all formats."""
    config = replace(CONFIG, preset=scan.FIXED)
    inputs = {"ngrams": X.ngram_table(spark, sf)}
    return rounded(scan.scan_keys(X.key_files(spark, sf), config, commits=X.commits_raw(spark, sf), **inputs))


@query(O.detections("creds", "public", R.SECONDARY_CREDS, PRIMARY))
def scan_creds_public(spark, sf):
    return rounded(scan.scan_creds(X.code_files(spark, sf), PUBLIC_CONFIG, **_inputs(spark, sf)))


@query(O.detections("keys", "public", R.SECONDARY_KEYS, PRIMARY))
def scan_keys_public(spark, sf):
    return rounded(scan.scan_keys(X.code_files(spark, sf), PUBLIC_CONFIG, **_inputs(spark, sf)))


@query(
    O.detections("creds", "enterprise", X.CORE_KEYWORDS, dictionary=False, commits=False, mask_code=False)
)
def scan_creds_unmasked(spark, sf):
    config = replace(CONFIG, keywords=X.CORE_KEYWORDS, unmask=True)
    return rounded(scan.scan_creds(X.code_files(spark, sf), config))


@query(O.detections("creds", "enterprise", X.CORE_KEYWORDS, dictionary=False, commits=False))
def scan_creds_core(spark, sf):
    """Which files assign a credential-looking value to a keyword: masked, with entropy."""
    config = replace(CONFIG, keywords=X.CORE_KEYWORDS)
    return rounded(scan.scan_creds(X.code_files(spark, sf), config))


# Every second file landed again a day later: of those, every third as it was, every
# third without a keyword, every third too short to be scanned.
_LATER = """SELECT file_id + 1000000000 AS file_id, html_url, indexed_at + INTERVAL 1 DAY AS indexed_at,
CASE file_id % 3 WHEN 0 THEN content WHEN 1 THEN concat('nothing', chr(10), 'to', chr(10), 'find') ELSE 'password' END AS content
FROM {files} WHERE file_id % 2 = 0"""
_NEWEST = O.FILES.replace("files AS (", "landed AS (", 1) + f""",
versions AS (SELECT file_id, html_url, indexed_at, content FROM landed UNION ALL {_LATER.format(files="landed")}),
files AS (SELECT file_id, html_url, indexed_at, content FROM
  (SELECT *, row_number() OVER (PARTITION BY html_url ORDER BY indexed_at DESC, file_id DESC) AS version FROM versions)
  WHERE version = 1)"""


def _versions(spark, sf):
    files = X.code_files(spark, sf)
    return files.unionByName(spark.sql(_LATER, files=files))


@query(O.detections("creds", "enterprise", X.CORE_KEYWORDS, dictionary=False, commits=False).replace(O.FILES, _NEWEST, 1))
def scan_creds_versions(spark, sf):
    """Only the newest version of a file is scanned, also when it has lost its keyword."""
    config = replace(CONFIG, keywords=X.CORE_KEYWORDS)
    return rounded(scan.scan_creds(_versions(spark, sf), config))


@query(
    O.detections("creds", "enterprise", X.CORE_KEYWORDS, dictionary=False).replace(
        O.FILES, _NEWEST.replace("WHERE version = 1)", "WHERE version = 1 AND file_id >= 1000000000)"), 1
    )
)
def scan_creds_newer_versions(spark, sf):
    """A second run reads only what landed after the versions that the first one scanned."""
    config, commits = replace(CONFIG, keywords=X.CORE_KEYWORDS), X.commits_raw(spark, sf)
    first = job.run_scan(X.code_files(spark, sf), config)
    again = job.run_scan(_versions(spark, sf), config, scanned=first["scanned"], commits=commits)
    return rounded(again["detections"])


@query(
    O.detections("creds", "enterprise", R.SECONDARY_CREDS, dictionary=False, commits=False)
    + f""" CROSS JOIN (SELECT unnest(range(4)) AS copy)
WHERE copy < (CASE WHEN kw = 'password' THEN 2 ELSE 1 END) * (CASE WHEN ext IN ('py', 'js', 'zzz') THEN 2 ELSE 1 END)"""
)
def scan_creds_every_search(spark, sf):
    """Without de-duplication: a file counts once per search that returns it."""
    config = replace(CONFIG, extensions=_EXTS, dedupe=False)
    return rounded(scan.scan_creds(X.code_files(spark, sf), config))


@query(
    O.detections("creds", "enterprise", R.SECONDARY_CREDS, dictionary=False, commits=False).replace(
        O.FILES, O.DOC_FILES
    )
)
def scan_creds_documents(spark, sf):
    """The same scan over natural texts."""
    return rounded(scan.scan_creds(X.document_files(spark, sf), CONFIG))


@query(
    O.detections("keys", "enterprise", R.SECONDARY_KEYS, dictionary=False, commits=False).replace(
        O.FILES, O.DOC_FILES
    )
)
def scan_keys_documents(spark, sf):
    return rounded(scan.scan_keys(X.document_files(spark, sf), CONFIG))


@query(
    f"""WITH {_LEDGER_CTES}, {O.hits_ctes('creds', X.CORE_KEYWORDS)}
SELECT html_url AS URL, kw AS Second_Key, {O.mask('line', 'secret')} AS Code FROM hits
WHERE md5(concat({O.CONTENTS_URL}, '"', kw, '"')) NOT IN (SELECT hashed_url FROM seen_rows)"""
)
def scan_creds_new_files(spark, sf):
    """Incremental scan against the ledger."""
    config = replace(CONFIG, keywords=X.CORE_KEYWORDS, columns=("URL", "Second_Key", "Code"))
    seen = _ledger_rows(spark, sf, _LAST_RUN)
    return scan.scan_creds(X.code_files(spark, sf), config, ledger=seen, ngrams=X.ngram_table(spark, sf))


def _file_side(kind, words, label):
    return f"""SELECT 'scan_Files_{label}' AS Source, kw AS Second_Key, ext AS Extension, html_url AS URL,
{O.mask('line', 'secret')} AS Code, round(weight + entropy + count_score + dict_score, 6) AS Score FROM found"""


_TREE_FILES = f"""{_TREE_SQL}, {_TREE_LISTED}, files AS (SELECT path AS file_id, path AS html_url, content FROM listed)"""


def _file_scan_sql(dictionary, part=""):
    files = _TREE_FILES.replace("FROM customer", f"FROM customer {part}")
    sides = [
        f"SELECT * FROM (WITH {files}, {O.hits_ctes(kind, words)}, {O.score_ctes(dictionary)} {_file_side(kind, None, label)})"
        for kind, words, label in (
            ("creds", R.SECONDARY_CREDS, "Credential"),
            ("keys", R.SECONDARY_KEYS, "Key & Token"),
        )
    ]
    return f"""SELECT Source, Second_Key, Extension, URL, Code, max(Score) AS Score
FROM ({' UNION ALL '.join(sides)}) GROUP BY Source, Second_Key, Extension, URL, Code"""


def _file_rows(root, found):
    found = found.select("Source", "Second_Key", "Extension", "URL", "Code", "Score")
    return rounded(found.withColumn("URL", _below(root, F.col("URL"))))


@query(_file_scan_sql(False))
def scan_files(spark, sf):
    root = _tree(spark, sf)
    config = replace(CONFIG, extensions=())
    return _file_rows(root, file_scan.scan_files(spark, [root], _TREE_EXTENSIONS, config))


@query(_file_scan_sql(False))
def scan_files_store(spark, sf):
    root = "file://" + _tree(spark, sf)
    config = replace(CONFIG, extensions=())
    return _file_rows(root, file_scan.scan_files(spark, [root], _TREE_EXTENSIONS, config))


@query(_file_scan_sql(True))
def scan_files_with_dictionary(spark, sf):
    root = _tree(spark, sf)
    config, ngrams = replace(CONFIG, extensions=()), X.ngram_table(spark, sf)
    found = file_scan.scan_files(spark, [root], _TREE_EXTENSIONS, config, ngrams=ngrams)
    return _file_rows(root, found)


_CHANGED = "WHERE c_custkey % 3 = 0"


@query(_file_scan_sql(False, _CHANGED))
def scan_files_second_run(spark, sf):
    """Only files written again since the first run, told by its file ledger."""
    root = _tree(spark, sf)
    config = replace(CONFIG, extensions=())
    first = file_scan.run_file_scan(spark, [root], _TREE_EXTENSIONS, config)
    _tree(spark, sf, root, _CHANGED)
    again = file_scan.scan_files(spark, [root], _TREE_EXTENSIONS, config, first["ledger"])
    return _file_rows(root, again)


_CUSTOM = ("changeme", "DB_PASSWORD", "nothing of the kind")


def _search_sql(source, shown):
    return f"""WITH {O.FILES}, {O.COMMITS}, {O.words_cte(_CUSTOM)}
SELECT 'scan_{source}' AS Source, {shown} AS Second_Key, html_url AS URL, {O.OWNER} AS Owner, {O.REPO} AS Repo_Name,
coalesce({O.COMMIT_JSON}, '{{}}') AS Commit_Details, {O.TIME_COLUMNS}
FROM files JOIN kws ON contains(lower(content), lower(kw))
LEFT JOIN commits ON owner = {O.OWNER} AND repo = {O.REPO} AND file_path = {O.BLOB_PATH}"""


@query(_search_sql("Public", "concat('\"', kw, '\"')"))
def search_keywords_public(spark, sf):
    return keyword_search.search_public(
        X.code_files(spark, sf), _CUSTOM, CONFIG, commits=X.commits_raw(spark, sf)
    )


@query(_search_sql("Enterprise", "kw"))
def search_keywords_enterprise(spark, sf):
    return keyword_search.search_enterprise(
        X.code_files(spark, sf), _CUSTOM, CONFIG, commits=X.commits_raw(spark, sf)
    )


def _collected(spark, sf, kind, public):
    config = replace(PUBLIC_CONFIG if public else CONFIG, kind=kind)
    return scan.collect_training(X.code_files(spark, sf), config, ngrams=X.ngram_table(spark, sf))


def _training_sql(kind, primary=None):
    words = R.SECONDARY_CREDS if kind == "creds" else R.SECONDARY_KEYS
    return f"{O.training(kind, words, primary)} SELECT * FROM train"


@query(_training_sql("creds"))
def collect_training_creds_enterprise(spark, sf):
    return rounded(_collected(spark, sf, "creds", False))


@query(_training_sql("keys"))
def collect_training_keys_enterprise(spark, sf):
    return rounded(_collected(spark, sf, "keys", False))


@query(_training_sql("creds", PRIMARY))
def collect_training_creds_public(spark, sf):
    return rounded(_collected(spark, sf, "creds", True))


@query(_training_sql("keys", PRIMARY))
def collect_training_keys_public(spark, sf):
    return rounded(_collected(spark, sf, "keys", True))


@query(
    f"""WITH {O.FILES}, {O.hits_ctes('creds', X.CORE_KEYWORDS)},
counted AS (SELECT {O.EXT} AS ext, kw, 1 AS u, 0 AS d FROM files JOIN kws ON contains(lower(content), lower(kw))
  UNION ALL SELECT ext, kw, 0, 1 FROM hits)
SELECT ext AS Extension, concat('"', kw, '"') AS Query, CAST(sum(u) AS BIGINT) AS New_Urls,
  CAST(sum(d) AS BIGINT) AS Detections, CAST(sum(d) AS BIGINT) AS Writes
FROM counted GROUP BY ext, kw
UNION ALL SELECT ext, NULL, CAST(sum(u) AS BIGINT), CAST(sum(d) AS BIGINT), CAST(sum(d) AS BIGINT) FROM counted GROUP BY ext
UNION ALL SELECT NULL, NULL, CAST(sum(u) AS BIGINT), CAST(sum(d) AS BIGINT), CAST(sum(d) AS BIGINT) FROM counted"""
)
def run_report(spark, sf):
    config = replace(CONFIG, keywords=X.CORE_KEYWORDS)
    return job.run_scan(X.code_files(spark, sf), config)["report"]


# --- enrichment --------------------------------------------------------------


@query(f"WITH {O.COMMITS} SELECT owner, repo, file_path, {O.COMMIT_JSON} AS details FROM commits")
def format_commits(spark, sf):
    details = commit_ops.format_commits(F.col("status"), F.col("body"))
    return X.commits_raw(spark, sf).select("owner", "repo", "file_path", details.alias("details"))


@query(
    f"""WITH {O.FILES}, {O.COMMITS} SELECT file_id, coalesce({O.COMMIT_JSON}, '{{}}') AS Commit_Details
FROM files LEFT JOIN commits ON owner = {O.OWNER} AND repo = {O.REPO} AND file_path = {O.BLOB_PATH}"""
)
def attach_commits(spark, sf):
    files = scan.with_fetch_url(X.code_files(spark, sf).drop("content"), CONFIG)
    files = written(files, "files")
    found = commit_ops.attach_commits(files, X.commits_raw(spark, sf), files)
    return found.select("file_id", "Commit_Details")


@query(f"SELECT event_id, {O.TIME_COLUMNS} FROM events")
def stamp(spark, sf):
    return commit_ops.stamp(X.table(spark, sf, "events").select("event_id"), O.AS_OF)


# --- false-positive filter ---------------------------------------------------


@query(
    r"""SELECT doc_id, length(source) AS Len_Key, length(text) AS Len_Code,
CAST(regexp_matches(text, '[\p{Nd}²³¹⁰-⁹₀-₉]') AS INTEGER) AS Has_Digit,
CAST(regexp_matches(text, '\p{Lu}') AS INTEGER) AS Has_Cap,
CAST(regexp_matches(text, '[@_!#$%^&*()<>?/\\|}{~:]') AS INTEGER) AS Special FROM documents"""
)
def engineer_features(spark, sf):
    text = F.col("text")
    docs = X.table(spark, sf, "documents").select(
        "doc_id",
        F.length("source").alias("Len_Key"),
        F.length("text").alias("Len_Code"),
        features.has_digit(text).alias("Has_Digit"),
        features.has_capital(text).alias("Has_Cap"),
        features.has_special_chars(text).alias("Special"),
    )
    return docs


@query(
    f"""{O.training('creds', R.SECONDARY_CREDS)}
SELECT Key_Weight, Entropy, length(Secret) AS Len_Key, length(Code) AS Len_Code, CAST(regexp_matches(Secret, '[0-9]') AS INTEGER) AS Has_Digit,
CAST(regexp_matches(Secret, '[A-Z]') AS INTEGER) AS Has_Cap, Second_Key, Extension, Label FROM train"""
)
def engineered_training(spark, sf):
    rows = features.engineer_features(rounded(_collected(spark, sf, "creds", False)))
    return rows.select(
        "Key_Weight", "Entropy", "Len_Key", "Len_Code", "Has_Digit", "Has_Cap", "Second_Key",
        "Extension", "Label",
    )


@query(
    """SELECT doc_id, CAST(lang = 'de' AS INTEGER) AS lang_de, CAST(lang = 'en' AS INTEGER) AS lang_en,
CAST(lang = 'es' AS INTEGER) AS lang_es, CAST(lang = 'fr' AS INTEGER) AS lang_fr FROM documents"""
)
def one_hot(spark, sf):
    docs = X.table(spark, sf, "documents").select("doc_id", "lang")
    return features.one_hot(docs, {"lang": ["de", "en", "es", "fr"]})


@query(
    """SELECT doc_id, 0 AS unseen, CAST(lang = 'en' AS INTEGER) AS lang_en,
coalesce(n_chars, 0) AS n_chars FROM documents"""
)
def align_columns(spark, sf):
    docs = X.table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "source")
    dummies = features.one_hot(docs, {"lang": ["en", "fr"]})
    return features.align_columns(dummies, ["doc_id", "unseen", "lang_en", "n_chars"])


@query(
    O.detections("creds", "enterprise", X.CORE_KEYWORDS, dictionary=False, commits=False)
    .replace("SELECT 'scan_Enterprise_Credential' AS Source,", "SELECT")
    .replace("html_url AS URL,", "")
    .replace(f"{O.OWNER} AS Owner, {O.REPO} AS Repo_Name,", "")
    .replace(O.TIME_COLUMNS, 'CAST(7 AS INTEGER) AS "Hour"')
)
def drop_id_columns(spark, sf):
    config = replace(CONFIG, keywords=X.CORE_KEYWORDS)
    found = scan.scan_creds(X.code_files(spark, sf), config)
    return rounded(features.drop_id_columns(found, "enterprise"))


@query(
    """SELECT doc_id, CASE WHEN CAST(concat('0x', substr(md5(concat('123', chr(1), CAST(doc_id AS VARCHAR), chr(1), CAST(quality AS VARCHAR))), 1, 8)) AS BIGINT) % 100 < 70
THEN 'train' ELSE 'test' END AS part FROM labels"""
)
def split(spark, sf):
    rows = X.table(spark, sf, "labels")
    train, test = features.split(rows, ["doc_id", "quality"])
    return train.select("doc_id", F.lit("train").alias("part")).unionByName(
        test.select("doc_id", F.lit("test").alias("part"))
    )


@query(
    """WITH c AS (SELECT CAST(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
sum(CASE WHEN quality <> 1 AND toxic = 0 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN quality = 1 AND toxic <> 0 THEN 1 ELSE 0 END) AS fn,
sum(CASE WHEN quality = 1 - toxic THEN 1 ELSE 0 END) AS same, count(*) AS n FROM labels)
SELECT round(same / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"""
)
def evaluate(spark, sf):
    """Quality as the label, "not toxic" as the prediction."""
    rows = X.table(spark, sf, "labels").withColumn("said", 1 - F.col("toxic"))
    return rounded(
        ml.evaluate(rows, "quality", "said"), ["accuracy", "precision", "recall", "f1"]
    )


_REVIEWED = f"""{O.training('creds', R.SECONDARY_CREDS)},
review AS (SELECT secret, line, 0 AS label FROM hits WHERE ext = 'txt')"""


def _stored_collected(spark, sf):
    """Collected rows, written: the review and the rows it labels both read them."""
    return written(_collected(spark, sf, "creds", False), "collected", seal=["Secret", "Code"])


def _reviewed_training(spark, sf):
    """Training rows; reviewers marked what stands in text files as false."""
    rows = _stored_collected(spark, sf)
    review = rows.where("Extension = 'txt'").select("Secret", "Code", F.lit(0).alias("Label"))
    return features.apply_labels(rows, review)


@query(
    f"""{_REVIEWED}
SELECT Secret, Second_Key, Extension, Code, Key_Weight, SKey_Count, train.Entropy, Dictionary_Similarity, Score,
CAST(CASE WHEN EXISTS (SELECT 1 FROM review WHERE review.secret = train.Secret AND review.line = train.Code) THEN 0 ELSE 1 END AS INTEGER) AS Label
FROM train"""
)
def apply_labels(spark, sf):
    return rounded(_reviewed_training(spark, sf))


def _model(spark, sf, trees=ml.TREES):
    """Reviewers took every candidate that looks like an access key id for a sample."""
    rows = _stored_collected(spark, sf)
    review = rows.where(F.col("Secret").startswith("AKIA")).withColumn("Label", F.lit(0))
    labelled = features.apply_labels(rows, review.select("Secret", "Code", "Label"))
    rows = written(features.with_features(labelled), "labelled")
    train, test = features.split(rows, ["Secret", "Second_Key", "Code"])
    return ml.train(train, trees=trees), train, test


# Access key ids are the only candidates with capitals, so a sound forest makes no mistake
# on the test part: as many true positives as it has real secrets.
@query(
    f"""{O.training('creds', R.SECONDARY_CREDS)},
parts AS (SELECT starts_with(Secret, 'AKIA') AS sample,
  CAST(concat('0x', substr(md5(concat('123', chr(1), Secret, chr(1), Second_Key, chr(1), Code)), 1, 8)) AS BIGINT) % 100 AS part FROM train)
SELECT CAST(1 AS DOUBLE) AS accuracy, CAST(1 AS DOUBLE) AS "precision", CAST(1 AS DOUBLE) AS recall, CAST(1 AS DOUBLE) AS f1,
count(*) FILTER (part < 70) AS trained, count(*) FILTER (part >= 70 AND NOT sample) AS real,
count(*) FILTER (part >= 70 AND sample) AS false FROM parts"""
)
def train(spark, sf):
    """Forest on 70 % of the labelled rows, judged on the rest; and what it said of them."""
    model, train, test = _model(spark, sf)
    said = written(ml.predict(test, model), "predicted")
    counts = said.agg(
        F.lit(train.count()).alias("trained"),
        F.count_if(F.col("prediction") == 1).alias("real"),
        F.count_if(F.col("prediction") == 0).alias("false"),
    )
    return ml.evaluate(said).crossJoin(counts)


_REAL_ONLY = (
    O.detections("creds", "enterprise", R.SECONDARY_CREDS, commits=False)
    + " WHERE NOT starts_with(secret, 'AKIA')"
)


@query(_REAL_ONLY)
def ml_filter(spark, sf):
    """Credential scan without the predicted false positives."""
    model, *_ = _model(spark, sf)
    ngrams = X.ngram_table(spark, sf)
    return rounded(scan.scan_creds(X.code_files(spark, sf), CONFIG, ngrams=ngrams, model=model))


@query(_REAL_ONLY)
def ml_filter_saved_forest(spark, sf):
    """The same with a forest that was saved and loaded again for the lists of the scan."""
    model, *_ = _model(spark, sf)
    path = new_path(spark, "forest")
    ml.save_forest(model, path)
    extensions = [*R.EXTENSIONS, *(r[0] for r in _extensions_met(spark, sf))]
    loaded = ml.load_forest(spark, path, CONFIG.words, extensions)
    ngrams = X.ngram_table(spark, sf)
    return rounded(scan.scan_creds(X.code_files(spark, sf), CONFIG, ngrams=ngrams, model=loaded))


def _extensions_met(spark, sf):
    """The extensions of the corpus, which has nine."""
    return X.code_files(spark, sf).select(urls.url_extension(F.col("html_url"))).distinct().collect()


# --- sinks -------------------------------------------------------------------


@query("SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id + 1, lang FROM documents")
def append_checked(spark, sf):
    docs = X.table(spark, sf, "documents").select("doc_id", "lang")
    path = new_path(spark, "appended")
    tables.append_checked(docs, path)
    tables.append_checked(docs.withColumn("doc_id", F.col("doc_id") + 1), path)
    return spark.read.parquet(path)


@query("SELECT doc_id + 1 AS doc_id, lang FROM documents")
def overwrite(spark, sf):
    docs = X.table(spark, sf, "documents").select("doc_id", "lang")
    path = new_path(spark, "replaced")
    tables.overwrite(docs, path)
    tables.overwrite(docs.withColumn("doc_id", F.col("doc_id") + 1), path)
    return spark.read.parquet(path)


@query(f"WITH {_LEDGER_CTES} SELECT hashed_url, url, 'enterprise' AS source, 'creds' AS kind, 'plain' AS mode FROM ledger_rows")
def append_ledger(spark, sf):
    path = new_path(spark, "ledger")
    tables.append_ledger(_ledger_rows(spark, sf), path)
    return spark.read.parquet(path)


@query(
    """SELECT doc_id, 'public' AS source, 'creds' AS kind, 'ml' AS mode FROM documents
UNION ALL SELECT doc_id, 'public', 'keys', 'plain' FROM documents"""
)
def route_output(spark, sf):
    docs = X.table(spark, sf, "documents").select("doc_id")
    path = new_path(spark, "routed")
    tables.route_output(docs, path, "public", "creds", "ml")
    tables.route_output(docs, path, "public", "keys", "plain")
    return spark.read.parquet(path)


@query("SELECT c_name AS target_file_paths FROM customer")
def write_listing(spark, sf):
    path = new_path(spark, "listing")
    names = X.table(spark, sf, "customer").select(F.col("c_name").alias("path"))
    tables.write_listing(names.unionByName(names), path)
    tables.write_listing(names, path)
    return lists.read_target_files(spark, path)


@query(_training_sql("creds"))
def append_training(spark, sf):
    path = new_path(spark, "training")
    tables.append_training(_collected(spark, sf, "creds", False), path)
    return rounded(spark.read.parquet(path))


@query(O.detections("creds", "enterprise", X.CORE_KEYWORDS, dictionary=False, commits=False))
def committed_run(spark, sf):
    """Detections of a store after two runs: files landed before a date, then all; the
    second is done twice, as after a failure."""
    config, files = replace(CONFIG, keywords=X.CORE_KEYWORDS), X.code_files(spark, sf)
    store = RunStore(spark, new_path(spark, "store"))
    early = files.where(F.col("indexed_at") < F.lit(_LAST_RUN).cast("timestamp"))
    for run, landed in (("1", early), ("2", files), ("2", files)):
        job.committed_run(store, run, landed, config)
    return rounded(store.read("detections"))


@query(f"WITH {_LEDGER_CTES} SELECT hashed_url FROM ledger_rows EXCEPT SELECT hashed_url FROM seen_rows")
def drop_seen_bucketed(spark, sf):
    """Files and queries that a bucketed ledger of three runs, two of them merged, lacks."""
    seen = SeenLedger(spark, new_path(spark, "seen"))
    rows = written(_ledger_rows(spark, sf, _LAST_RUN), "rows")
    third = F.pmod(F.xxhash64("hashed_url"), F.lit(3))
    for run in range(3):
        seen.append(rows.where(third == run), f"run{run}")
    seen.merge("run1")
    every = written(_ledger_rows(spark, sf), "rows")
    return seen.drop_seen(every).select("hashed_url")


# --- streams -----------------------------------------------------------------


def _stream_session(spark, per_core=1):
    """Own session for state stores: as many partitions as cores, or ``per_core`` times that."""
    session = spark.newSession()
    cores = spark.sparkContext.defaultParallelism
    session.conf.set("spark.sql.shuffle.partitions", str(cores * per_core))
    X.ensure_scratch(session)
    return session


def _orders_stream(session, sf):
    schema = session.read.parquet(f"{sf}/orders.parquet").schema
    orders = session.readStream.schema(schema).parquet(f"{sf}/orders.parq*")
    return X.code_files_of(orders.select("o_orderkey", "o_custkey", "o_orderdate"))


def _drain(df, spark, name):
    """Run a stream over all that has landed into a table and read it back."""
    path = new_path(spark, name)
    query = (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", new_path(spark, name + "-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


@query(O.detections("creds", "enterprise", X.CORE_KEYWORDS, dictionary=False, commits=False))
def scan_stream(spark, sf):
    session = _stream_session(spark)
    found, seen = new_path(spark, "stream-found"), new_path(spark, "stream-seen")
    config = replace(CONFIG, keywords=X.CORE_KEYWORDS)
    state = new_path(spark, "stream-state")
    run = stream.scan_stream(_orders_stream(session, sf), config, found, seen, state)
    run.awaitTermination()
    return rounded(spark.read.parquet(found).drop("batch_id"))


@query(_search_sql("Enterprise", "kw"))
def search_stream(spark, sf):
    session = _stream_session(spark)
    found, seen, state = (new_path(spark, f"search-{n}") for n in ("found", "seen", "state"))
    files, commits = _orders_stream(session, sf), X.commits_raw(spark, sf)
    run = stream.search_stream(files, _CUSTOM, CONFIG, found, seen, state, commits=commits)
    run.awaitTermination()
    return spark.read.parquet(found).drop("batch_id")


@query(f"WITH {_LEDGER_CTES} SELECT hashed_url FROM ledger_rows")
def drop_seen_stream(spark, sf):
    """Files and queries that land twice within a day, once each."""
    session = _stream_session(spark)
    landed_twice = _orders_stream(session, sf).unionByName(_orders_stream(session, sf))
    pairs = query_ops.match_files(landed_twice, X.CORE_KEYWORDS).withColumn("kw", F.explode("found.kw"))
    rows = scan.with_fingerprint(pairs, CONFIG).select("indexed_at", "hashed_url")
    return _drain(stream.drop_seen_stream(rows, "1 day"), spark, "unseen").select("hashed_url")


@query(f"WITH {_LEDGER_CTES} SELECT hashed_url FROM ledger_rows")
def unseen_stream(spark, sf):
    """Files and queries that land again at once, within the delay and long after it, once
    each: one drop of files per batch, the last of them a month late. The stream goes on
    from its checkpoint after each drop, so a drop is a batch however many files it has."""
    session = _stream_session(spark, per_core=4)
    rows = written(_ledger_rows(session, sf), "rows")
    source, late = new_path(spark, "drops"), ("0 days", "1 hour", "30 days")
    out, ledger_path, state = (new_path(spark, f"unseen-{n}") for n in ("out", "ledger", "state"))
    for drop, delay in enumerate(late):
        landed = F.lit("2024-01-01").cast("timestamp") + F.expr(f"INTERVAL {delay}")
        part = rows.withColumn("indexed_at", landed)
        part.unionByName(part).write.mode("append").parquet(f"{source}/drop={drop}")
        read = session.readStream.schema("hashed_url string, url string, indexed_at timestamp")
        landed_rows = read.parquet(f"{source}/drop=*")
        stream.unseen_stream(landed_rows, out, ledger_path, state, "1 day").awaitTermination()
    return spark.read.parquet(out).select("hashed_url")


_WINDOWS_SQL = f"""WITH {O.FILES}, {O.hits_ctes('creds', X.CORE_KEYWORDS)},
tagged AS (SELECT CAST(date_trunc('hour', indexed_at) AS TIMESTAMP) AS h, owner FROM hits
  JOIN (SELECT file_id, indexed_at, {O.OWNER} AS owner FROM files) USING (file_id))
SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(h + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
  'creds' AS kind, owner, count(*) AS detections FROM tagged"""


def _window_rows(files):
    """Detections with their time; a stream has no newest version to wait for."""
    config = replace(CONFIG, keywords=X.CORE_KEYWORDS, dedupe=False)
    hits = scan.candidate_hits(scan.stage_files(files, config), config)
    return hits.select("indexed_at", F.lit(config.kind).alias("kind"), "owner")


def _window_text(df):
    return df.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("window_start", "window_end")}
    )


@query(f"{_WINDOWS_SQL} GROUP BY h, owner")
def detections_per_window(spark, sf):
    return _window_text(stream.detections_per_window(_window_rows(X.code_files(spark, sf))))


@query(
    f"""{_WINDOWS_SQL} GROUP BY h, owner
HAVING h + INTERVAL 1 HOUR <= (SELECT max(indexed_at) FROM hits JOIN files USING (file_id)) - INTERVAL 1 DAY"""
)
def detections_per_window_stream(spark, sf):
    """Windows the watermark has closed."""
    session = _stream_session(spark)
    rows = _window_rows(_orders_stream(session, sf))
    return _window_text(_drain(stream.detections_per_window(rows), spark, "windows"))
