"""Search queries and their match against the files."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.functions.common import (
    built_once,
    compute_once,
    let,
    literal_strings,
    sql_string,
)
from credsieve.functions.score import occurrences
from credsieve.functions.urls import url_extension, url_owner, url_repo
from credsieve.resources import ANY_EXTENSION


def public_query(primary, secondary):
    """``P S``; the secondary keyword alone without a primary one."""
    return F.concat_ws(" ", primary, secondary)


def enterprise_query(secondary):
    """The quoted phrase ``"S"``."""
    return F.concat(F.lit('"'), secondary, F.lit('"'))


def _first_column(words: DataFrame, name: str) -> DataFrame:
    return words.select(F.col(f"`{words.columns[0]}`").alias(name))


def public_queries(primary, secondary: DataFrame) -> DataFrame:
    """Every primary with every secondary keyword; blank primaries are skipped.

    ``primary`` is a list of words, or a DataFrame with the words in its first column,
    which may have any size. Without any the secondary keywords stand alone.
    """
    word, none = secondary.select(F.col("keyword").alias("secondary")), F.lit(None).cast("string")
    if isinstance(primary, DataFrame):
        words = _first_column(primary, "primary").where(F.trim("primary") != "")
        # All pairs are what is asked for; the optimizer sends the smaller list around.
        pairs = word.join(words) if not words.isEmpty() else word.withColumn("primary", none)
    else:
        words = [p for p in primary if p and p.strip()]
        pairs = word.withColumn("primary", F.explode(literal_strings(words)) if words else none)
    return pairs.select(
        "primary", "secondary", public_query(F.col("primary"), F.col("secondary")).alias("query")
    )


def enterprise_queries(secondary: DataFrame) -> DataFrame:
    word = F.col("keyword")
    return secondary.select(word.alias("secondary"), enterprise_query(word).alias("query"))


def keyword_queries(custom: DataFrame) -> DataFrame:
    """Custom keyword search: quoted, no extension."""
    return enterprise_queries(custom)


def search_pairs(queries: DataFrame, extensions) -> DataFrame:
    """Every extension with every query. ``extensions`` is a list, or a DataFrame with the
    extensions in its first column, which may have any size."""
    if isinstance(extensions, DataFrame):
        return queries.join(_first_column(extensions, "search_extension"))
    return queries.withColumn("search_extension", F.explode(literal_strings(extensions)))


def word_families(words) -> dict:
    """Words grouped under a shortest word of the list that they contain."""
    families = {}
    for word in sorted(dict.fromkeys(words), key=lambda w: (len(w), w.lower())):
        low = word.lower()
        short = next((s for s in families if s in low), low)
        families.setdefault(short, []).append(word)
    return families


def word_branches(short, family) -> dict:
    """Words of a family by the short word and the character before (else behind) it."""
    branches = {}
    for word in family:
        at = word.lower().index(short)
        part = slice(at - 1, at + len(short)) if at else slice(at, at + len(short) + 1)
        branches.setdefault(word.lower()[part], []).append(word)
    return branches


def _word_tree(words):
    """ARRAY<STRUCT<short, branches ARRAY<STRUCT<part, words ARRAY<STRUCT<kw, low>>>>>>."""

    def array(name, key, items):
        parts = [f"named_struct('{key}', {sql_string(k)}, '{name}', {v})" for k, v in items]
        return f"array({', '.join(parts)})"

    def leaves(own):
        return array("low", "kw", [(w, sql_string(w.lower())) for w in own])

    def branches(short, own):
        parts = word_branches(short, own).items()
        return array("words", "part", [(part, leaves(ws)) for part, ws in parts])

    families = word_families(words).items()
    return F.expr(array("branches", "short", [(s, branches(s, own)) for s, own in families]))


def found_words(content, words):
    """ARRAY<STRUCT<kw, n>>: the words a text holds (any case) and how often.

    One pass reads and lower-cases the text once for all words. Words that
    share a part are only looked for if the text holds that part, so most
    texts are searched for a dozen parts instead of all words.
    """
    words = list(dict.fromkeys(words))
    if not words:
        return F.array().cast("array<struct<kw:string,n:int>>")
    tree = _word_tree(words)

    def search(low):
        def matches(branch):
            return F.transform(
                F.filter(branch["words"], lambda w: F.contains(low, w["low"])),
                lambda w: F.struct(w["kw"].alias("kw"), occurrences(low, w["low"]).alias("n")),
            )

        def members(family):
            present = F.filter(family["branches"], lambda b: F.contains(low, b["part"]))
            return F.flatten(F.transform(present, matches))

        present = F.filter(tree, lambda f: F.contains(low, f["short"]))
        return F.flatten(F.transform(present, members))

    return let(F.lower(content), search)


def found_in_content(words):
    return found_words(F.col("content"), words)


def has_extension(extension, extensions):
    """Extension test of a search: an empty list or ``others`` means any."""
    extensions = list(extensions)
    if not extensions or ANY_EXTENSION in extensions or "" in extensions:
        return F.lit(True)
    return extension.isin(extensions)


def has_terms():
    """Whether a row of ``match_files`` holds what the search asks for."""
    primary = F.col("found_primary").isNull() | (F.size("found_primary") > 0)
    return (F.size("found") > 0) & primary


def match_files(files: DataFrame, secondary, primary=None, extensions=(), every=False) -> DataFrame:
    """Files that hold a search term, with all terms found: one row per file.

    ``primary=None`` searches the secondary keywords alone; otherwise a file
    must hold a primary keyword as well. Adds ``ext``, ``found`` and
    ``found_primary``. ``every`` keeps files without a term, with nothing found,
    so that they count as versions of their URL.
    """
    secondary = [w for w in secondary if w]
    content = F.col("content")
    ext = url_extension(F.col("html_url"))
    exprs = {"ext": ext, "found": built_once(found_in_content, tuple(secondary))}
    if primary is not None:
        words = tuple(p for p in primary if p and p.strip())
        exprs["found_primary"] = built_once(found_in_content, words)
    matched = compute_once(
        files.where(content.isNotNull() & has_extension(ext, extensions)),
        files.columns,
        **exprs,
    )
    if primary is None:
        nothing = F.lit(None).cast("array<struct<kw:string,n:int>>")
        matched = matched.withColumn("found_primary", nothing)
    return matched if every else matched.where(has_terms())


def keyword_match(files: DataFrame, secondary, primary=None, extensions=()) -> DataFrame:
    """One row per file and search (keyword, extension) that returns the file.

    A keyword listed twice and the ``others`` extension return a file again, as
    separate searches would.
    """
    columns = files.columns
    matched = match_files(files, secondary, primary, extensions).drop("content")
    rows = matched.select(
        *[c for c in columns if c != "content"],
        "ext",
        "found_primary",
        F.explode("found").alias("s"),
    )
    if primary is not None:
        rows = rows.withColumn("p", F.explode("found_primary"))
        rows = _repeat_listed(rows, F.col("p.kw"), [p for p in primary if p and p.strip()])
        rows = rows.withColumn("primary", F.col("p.kw")).drop("p")
    rows = _repeat_listed(rows, F.col("s.kw"), [w for w in secondary if w])
    searched = F.array(*[F.lit(e) for e in extensions]) if extensions else F.array(F.lit(""))
    own = F.filter(
        searched, lambda e: (e == F.col("ext")) | e.isin(ANY_EXTENSION, "")
    )
    return (
        rows.withColumn("keyword", F.col("s.kw"))
        .drop("s", "found_primary")
        .withColumn("search_extension", F.explode(own))
    )


def _repeat_listed(rows, word, words):
    """Repeat a row as often as its word is listed."""
    repeated = sorted({w for w in words if words.count(w) > 1})
    if not repeated:
        return rows
    times = F.lit(1)
    for w in repeated:
        times = F.when(word == w, F.lit(words.count(w))).otherwise(times)
    return rows.withColumn("_n", F.explode(F.sequence(F.lit(1), times))).drop("_n")


def scope_filter(df: DataFrame, orgs=(), repos=()) -> DataFrame:
    """Only files of these owners, or else of these ``owner/repo``; owners win."""
    url = F.col("html_url")
    if orgs:
        return df.where(url_owner(url).isin(list(orgs)))
    if repos:
        return df.where(F.concat_ws("/", url_owner(url), url_repo(url)).isin(list(repos)))
    return df


def newest_first(df: DataFrame, limit=None) -> DataFrame:
    """Latest index time first, ties by URL; ``limit`` for a top-k view."""
    ordered = df.orderBy(F.desc("indexed_at"), "html_url")
    return ordered if limit is None else ordered.limit(limit)
