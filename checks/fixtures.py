"""Scan inputs derived from the given tables.

``CODE_FILES`` is one text that Spark and DuckDB both run.
"""

import os
import tempfile

from credsieve.functions.common import compute_once
from credsieve.operators.dictionary import build_ngram_table, dictionary_words
from credsieve.operators.partitioning import fill_cores
from credsieve.scratch import CHECKPOINT_CONF, written

CODE_FILES = """
SELECT o_orderkey AS file_id,
       concat('https://git.example.com/org', CAST(o_custkey % 7 AS STRING), '/repo', CAST(o_custkey % 31 AS STRING), '/blob/main/src/f', CAST(o_orderkey AS STRING), '.',
              CASE o_orderkey % 13 WHEN 0 THEN 'py' WHEN 1 THEN 'js' WHEN 2 THEN 'json' WHEN 3 THEN 'yml' WHEN 4 THEN 'java' WHEN 5 THEN 'md' WHEN 6 THEN 'conf' WHEN 7 THEN 'zzz' ELSE 'txt' END) AS html_url,
       o_orderdate AS indexed_at,
       CASE WHEN o_orderkey % 17 = 0 THEN concat(kw, sep, '"', sec, '"', chr(10))
            ELSE concat('# module ', CAST(o_orderkey AS STRING), chr(10), 'import os', chr(10),
                        kw, sep, '"', sec, '"', chr(10),
                        'owner mail user', CAST(o_custkey AS STRING), '@mail.example.com', chr(10),
                        'docs https://docs.example.com/v1/a1b2c3d4', chr(10),
                        CASE WHEN o_orderkey % 19 = 0 THEN repeat(concat('see http://a.example.com/x1', chr(10)), 31) ELSE '' END,
                        CASE WHEN o_orderkey % 23 = 0 THEN 'many aaaaa01 aaaaa02 aaaaa03 aaaaa04 aaaaa05 aaaaa06 aaaaa07 aaaaa08 aaaaa09 aaaaa10 aaaaa11 aaaaa12 aaaaa13 aaaaa14 aaaaa15 aaaaa16 aaaaa17 aaaaa18 aaaaa19 aaaaa20' ELSE '' END)
       END AS content
FROM (SELECT o_orderkey, o_custkey, o_orderdate,
        CASE o_orderkey % 7 WHEN 0 THEN 'password' WHEN 1 THEN 'token' WHEN 2 THEN 'api_key' WHEN 3 THEN 'DB_PASSWORD' WHEN 4 THEN 'secret' WHEN 5 THEN 'auth_token' ELSE 'comment' END AS kw,
        CASE o_orderkey % 5 WHEN 0 THEN ' = ' WHEN 1 THEN ': ' WHEN 2 THEN ' := ' WHEN 3 THEN '=' ELSE ' ' END AS sep,
        CASE o_orderkey % 11 WHEN 0 THEN 'aaaaaaa1' WHEN 1 THEN concat('AKIA', upper(substr(md5(CAST(o_orderkey AS STRING)), 1, 16)))
             WHEN 2 THEN concat(md5(CAST(o_orderkey AS STRING)), substr(md5(CAST(o_custkey AS STRING)), 1, 8)) WHEN 3 THEN 'changeme'
             WHEN 4 THEN 'static1' ELSE substr(md5(CAST(o_orderkey AS STRING)), 1, 20) END AS sec
      FROM orders) t
"""

# One key format per file, with the characters that cleaning for the scans blanks; some
# stand inside or beside others, some are cut by one character more.
KEY_FILES = """
SELECT file_id, html_url, indexed_at,
       concat('# module ', CAST(file_id AS STRING), chr(10), 'import os', chr(10),
              'api_key', CASE file_id % 3 WHEN 0 THEN ' = "' WHEN 1 THEN ': "' ELSE '="' END, sec, '"', chr(10),
              'checked by ', CAST(file_id AS STRING), chr(10)) AS content
FROM (SELECT o_orderkey AS file_id, o_orderdate AS indexed_at,
        concat('https://git.example.com/org', CAST(o_custkey % 7 AS STRING), '/repo', CAST(o_custkey % 31 AS STRING), '/blob/main/src/k', CAST(o_orderkey AS STRING), '.py') AS html_url,
        CASE o_orderkey % 19
          WHEN 0 THEN concat('4/', h, '_', u)
          WHEN 1 THEN concat('1/', h, '-', substr(u, 1, 10))
          WHEN 2 THEN concat('1/', h, u)
          WHEN 3 THEN concat('ya29.', h, '-', substr(u, 1, 6))
          WHEN 4 THEN concat('AIza', substr(h, 1, 20), '_', substr(u, 1, 14))
          WHEN 5 THEN concat(CAST(o_orderkey AS STRING), '-', h, '.apps.googleusercontent.com')
          WHEN 6 THEN concat('amzn.mws.', substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12))
          WHEN 7 THEN concat('access_token$production$', substr(h, 1, 16), '$', md5(h))
          WHEN 8 THEN concat('xoxb-', lpad(CAST(o_orderkey AS STRING), 12, '1'), '-', lpad(CAST(o_custkey AS STRING), 12, '2'), '-', lpad(CAST(o_orderkey AS STRING), 12, '3'), '-', h)
          WHEN 9 THEN concat('/services/T', substr(u, 1, 8), '/B', substr(u, 9, 8), '/', substr(h, 1, 24))
          WHEN 10 THEN concat(substr(h, 1, 19), '/', substr(u, 1, 19), '+')
          WHEN 11 THEN concat(substr(h, 1, 11), '-', substr(u, 1, 11), '_')
          WHEN 12 THEN concat('AKIA', substr(u, 1, 16), ',ASIA', substr(u, 17, 16))
          WHEN 13 THEN '-----BEGIN RSA PRIVATE KEY-----'
          WHEN 14 THEN concat(h, substr(u, 1, 9))
          WHEN 15 THEN concat('4/AIza', substr(h, 1, 20), '-', substr(u, 1, 14))
          WHEN 16 THEN concat('4/', substr(h, 1, 24), '.', substr(u, 1, 24), '.', substr(h, 5, 24))
          WHEN 17 THEN concat('Ü', substr(h, 1, 24), 'ü ', substr(u, 1, 24), '\U0001f511', substr(u, 5, 24))
          ELSE 'none of them' END AS sec
      FROM (SELECT o_orderkey, o_custkey, o_orderdate, md5(CAST(o_orderkey AS STRING)) AS h, upper(md5(CAST(o_custkey AS STRING))) AS u FROM orders) o) t
"""

# Two query terms for the public scan: nothing else of the corpus has both.
CORE_KEYWORDS = ("password", "token", "api_key", "db_password", "secret", "auth_token")

#: Files a task scans: a row of ``orders`` has few bytes, the file made of it many.
FILES_A_TASK = 100_000

SITE_HOST = "https://git.example.com"
RAW_HOST = "https://raw.example.com"


def ensure_scratch(spark):
    """Use the cluster's shared folder; a local one only if none is named in local mode."""
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if not named and spark.sparkContext.master.startswith("local"):
        spark.conf.set(CHECKPOINT_CONF, tempfile.mkdtemp(prefix="credsieve-"))


def table(spark, sf_dir, name):
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def code_files(spark, sf_dir):
    """Code corpus derived from ``orders``."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return code_files_of(fill_cores(orders, "o_orderkey", FILES_A_TASK))


def code_files_of(orders):
    """The corpus of a batch or stream of ``orders`` rows.

    The columns are derived once; filters of the scans do not derive them again.
    """
    files = orders.sparkSession.sql(
        CODE_FILES.replace("FROM orders)", "FROM {orders})"), orders=orders
    )
    return compute_once(files, [], **{c: files[c] for c in files.columns})


def key_files(spark, sf_dir):
    """Files with keys of all formats, derived from ``orders``."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return spark.sql(
        KEY_FILES.replace("FROM orders)", "FROM {orders})"),
        orders=fill_cores(orders, "o_orderkey", FILES_A_TASK),
    )


def documents(spark, sf_dir, *columns):
    return fill_cores(table(spark, sf_dir, "documents").select("doc_id", *columns), "doc_id")


DOCUMENT_FILES = """
SELECT doc_id AS file_id,
       concat('https://git.example.com/', source, '/', lang, '/blob/main/', CAST(doc_id AS STRING), '.txt') AS html_url,
       TIMESTAMP '2024-01-01 00:00:00' AS indexed_at,
       text AS content
FROM documents
"""


def document_files(spark, sf_dir):
    """Natural texts as files."""
    return spark.sql(
        DOCUMENT_FILES.replace("FROM documents", "FROM {documents}"),
        documents=documents(spark, sf_dir, "source", "lang", "text"),
    )


COMMITS = """
SELECT concat('org', CAST(o_custkey % 7 AS STRING)) AS owner,
       concat('repo', CAST(o_custkey % 31 AS STRING)) AS repo,
       concat('src/f', CAST(o_orderkey AS STRING), '.',
              CASE o_orderkey % 13 WHEN 0 THEN 'py' WHEN 1 THEN 'js' WHEN 2 THEN 'json' WHEN 3 THEN 'yml' WHEN 4 THEN 'java' WHEN 5 THEN 'md' WHEN 6 THEN 'conf' WHEN 7 THEN 'zzz' ELSE 'txt' END) AS file_path,
       CAST(CASE WHEN o_orderkey % 9 = 0 THEN 404 ELSE 200 END AS INT) AS status,
       concat('[{"sha":"', md5(CAST(o_orderkey AS STRING)), '","commit":{"author":{"email":"', CAST(c_custkey AS STRING), '@mail.example.com","name":"', c_name, '","date":"', substr(CAST(o_orderdate AS STRING), 1, 10), '"}},"author":',
              CASE WHEN o_orderkey % 6 = 0 THEN 'null' ELSE concat('{"login":"u', CAST(c_custkey AS STRING), '"}') END, '}]') AS body
FROM orders JOIN customer ON o_custkey = c_custkey
"""


def commits_raw(spark, sf_dir):
    """One commit reply per file, from ``orders`` and ``customer``."""
    return spark.sql(
        COMMITS.replace("{", "{{")
        .replace("}", "}}")
        .replace("FROM orders JOIN customer", "FROM {orders} JOIN {customer}"),
        orders=table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"),
        customer=table(spark, sf_dir, "customer").select("c_custkey", "c_name"),
    )


def stored_words(spark, sf_dir):
    """Dictionary: the words of ``documents``."""
    return written(dictionary_words(documents(spark, sf_dir, "text")), "words")


_ngram_paths: dict = {}


def ngram_table(spark, sf_dir):
    """N-gram table of the words of ``documents``, written once per session."""
    ensure_scratch(spark)
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    if key not in _ngram_paths:
        _ngram_paths[key] = written(build_ngram_table(stored_words(spark, sf_dir)), "ngrams")
    return _ngram_paths[key]
