"""Credential and key scans of landed code files.

A scan is one pass over the file bodies. Everything that needs a body (terms,
gates, cleaning, candidates, hit lines) happens in that pass without a shuffle;
only files with a search term leave it, as one narrow row each. All later
steps (newest version, ledger, dictionary, weights, commits) work on those rows.
"""

import hashlib
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve import resources as R
from credsieve import schemas
from credsieve.functions import clean, extract, spans, urls
from credsieve.functions.common import built_once, compute_once, let
from credsieve.functions.context import MAX_LINE, file_hits, line_short
from credsieve.functions.domains import DomainTable
from credsieve.functions.mask import code_column
from credsieve.functions.score import (
    MIN_ENTROPY,
    count_score,
    dictionary_score,
    shannon_entropy,
)
from credsieve.operators.commits import attach_commits, stamp
from credsieve.operators.dictionary import dictionary_match, fits_in_place, match_in_place
from credsieve.operators.ledger import drop_seen, fingerprint, latest_per_url
from credsieve.operators.partitioning import semi_join
from credsieve.operators.queries import (
    enterprise_query,
    found_in_content,
    has_terms,
    match_files,
    public_query,
)
from credsieve.operators.weights import key_weight
from credsieve.scratch import written
from credsieve.sources.lists import read_confidence

#: Files with candidates from which on each is scored where it lies, if the dictionary
#: fits the tasks; the distinct secrets of fewer are scored once and joined back.
IN_PLACE_FILES = 100_000

#: New files a task scans at most, about, if their bodies have to be shuffled.
NEW_FILES_A_TASK = 100_000

CREDS, KEYS = "creds", "keys"
PUBLIC, ENTERPRISE, FILES = "public", "enterprise", "files"
COMPAT, FIXED = "compat", "fixed"
_LABELS = {CREDS: "Credential", KEYS: "Key & Token"}


@dataclass(frozen=True)
class ScanConfig:
    """What to look for and how to report it.

    ``primary`` (public scans): every file must also hold one of these words.
    ``dedupe``: a URL landed several times is scanned in its newest version
    only, and a keyword listed twice or an extension that overlaps ``others``
    does not repeat a detection.
    ``preset``: "compat" looks for ``patterns`` in the cleaned text, "fixed" for the longest
    keys of ``bank`` in the raw text.
    ``tlds``: domains that make a dotted word a URL, as a short list or a ``DomainTable``.
    ``max_urls`` to ``min_entropy`` are the gates: a file with more URLs or candidates,
    or fewer lines, is not reported (``run_scan`` counts such files), nor is a candidate
    in longer lines only or of lower entropy.
    """

    kind: str = CREDS
    source: str = ENTERPRISE
    keywords: tuple = ()
    primary: tuple | None = None
    extensions: tuple = ()
    stop_words: tuple = R.STOP_WORDS
    patterns: tuple = R.KEY_BANK
    preset: str = "compat"
    bank: tuple = R.FIXED_BANK
    tlds: tuple | DomainTable = R.TLDS
    case_sensitive: bool = False
    max_urls: int = clean.MAX_URLS
    min_lines: int = clean.MIN_LINES
    max_candidates: int = extract.MAX_CANDIDATES
    max_line: int = MAX_LINE
    min_entropy: float = MIN_ENTROPY
    unmask: bool = False
    compat_mask: bool = False
    keep_secret: bool = False
    dedupe: bool = True
    as_of: str = "1970-01-01 00:00:00"
    source_prefix: str = "scan"
    pre_url: str = "https://git.example.com/api/v3/repos/"
    site_host: str = urls.SITE_HOST
    raw_host: str = urls.RAW_HOST
    columns: tuple = field(default=(), compare=False)

    def __post_init__(self):
        if self.preset not in (COMPAT, FIXED):
            raise ValueError(f"unknown preset of key patterns: {self.preset}")

    @property
    def words(self):
        if self.keywords:
            return tuple(self.keywords)
        return R.SECONDARY_CREDS if self.kind == CREDS else R.SECONDARY_KEYS

    @property
    def label(self):
        return f"{self.source_prefix}_{self.source.capitalize()}_{_LABELS[self.kind]}"


def candidates(content, links_stripped, bare_urls, config: ScanConfig):
    """Candidate secrets of a file, given its text and the text without URLs and e-mails.

    ``bare_urls`` is the number of scheme-less URLs left in the latter.
    """
    if config.kind == KEYS and config.preset == FIXED:
        return spans.fixed_key_candidates(content, config.bank)
    if config.kind == KEYS:
        return extract.key_candidates(clean.blank_key_noise(links_stripped), config.patterns)
    text = F.when(
        bare_urls > 0, clean.strip_bare_urls(links_stripped, config.tlds)
    ).otherwise(links_stripped)
    return extract.cred_candidates(text, config.stop_words)


def _strong(secrets, config):
    """Candidates with their entropy; weak ones and those no short line can hold dropped."""
    scored = F.transform(
        F.filter(secrets, lambda s: line_short(s, config.max_line)),
        lambda s: F.struct(s.alias("secret"), shannon_entropy(s).alias("entropy"))
    )
    return F.filter(scored, lambda s: s["entropy"] > config.min_entropy)


def _gated(content, extension, config, body):
    """``body(candidates)`` for files that pass the file gates, else null."""
    cheap = clean.not_markdown(extension) & clean.long_enough(content, config.min_lines)

    def with_bare_urls(text, bare):
        return F.when(
            clean.scheme_url_count(content) + bare <= config.max_urls,
            let(
                candidates(content, text, bare, config),
                lambda found: F.when(
                    extract.candidate_count_ok(found, config.max_candidates), body(found)
                ),
            ),
        )

    def with_links_stripped(text):
        bare = clean.bare_url_count(text, config.tlds)
        return let(bare, lambda n: with_bare_urls(text, n))

    return F.when(cheap, let(clean.strip_links(content), with_links_stripped))


def file_candidates(files: DataFrame, config: ScanConfig, with_content=False) -> DataFrame:
    """Files with a search term that pass all gates, and their candidates."""
    matched = match_files(files, config.words, config.primary, config.extensions)
    keep = [c for c in matched.columns if with_content or c != "content"]
    found = _gated(F.col("content"), F.col("ext"), config, lambda c: c)
    return compute_once(matched, keep, candidates=found).where("candidates is not null")


def stage_files(files: DataFrame, config: ScanConfig, every=False) -> DataFrame:
    """The body pass: one narrow row per file with a search term.

    ``hits`` is ARRAY<STRUCT<secret, entropy, matches ARRAY<STRUCT<kw, n, line>>>>;
    it is null for a file a gate stopped, and empty without a hit line. The newest
    version of a URL counts even if it holds no term any more; so with ``dedupe``
    files without one stay, without their body, until the versions are ranked.
    ``every`` leaves them in, for the record of what was scanned.
    """
    matched = match_files(
        files, config.words, config.primary, config.extensions, every=config.dedupe
    )
    keep = [c for c in matched.columns if c != "content"]
    hits = built_once(_hits, config)
    if not config.dedupe:
        return compute_once(matched, keep, hits=hits)
    staged = compute_once(matched, keep, hits=F.when(has_terms(), hits))
    newest = latest_per_url(staged)
    return newest if every else newest.where(has_terms())


def search_id(config: ScanConfig) -> str:
    """Name of what a scan looks for; equal searches have equal names."""
    what = (
        config.kind, config.source, config.words, config.primary, config.extensions,
        config.stop_words, config.patterns, config.preset, config.bank, config.tlds, config.case_sensitive,
        config.max_urls, config.min_lines, config.max_candidates, config.max_line,
        config.min_entropy,
    )
    return hashlib.md5(repr(what).encode()).hexdigest()


def scanned_versions(staged: DataFrame, config: ScanConfig) -> DataFrame:
    """The version of each URL that a run has scanned, from ``stage_files(every=True)``."""
    return staged.select(*schemas.SCANNED_VERSIONS[:-1], F.lit(search_id(config)).alias("search"))


def unscanned(files: DataFrame, scanned: DataFrame, config: ScanConfig) -> DataFrame:
    """Files newer than the version of their URL that this search scanned before.

    Decided on URL, time and id alone; bodies of other files are not read, and those
    of the new ones are not shuffled while their ids are few enough to be broadcast.
    URLs start alike, so a hash of them comes first where rows are sorted.
    """
    if not config.dedupe:
        raise ValueError("a scan of all versions has no newest one to go on from")
    version, key = F.struct("indexed_at", "file_id"), F.xxhash64("html_url").alias("_key")
    last = (
        scanned.where(F.col("search") == search_id(config))
        .groupBy(key, "html_url")
        .agg(F.max(version).alias("_last"))
    )
    landed = files.select("file_id", "html_url", "indexed_at", key)
    landed = landed.join(last, ["_key", "html_url"], "left")
    new = landed.where(F.col("_last").isNull() | (version > F.col("_last"))).select("file_id")
    return semi_join(files, written(new, "new-files"), "file_id", task_rows=NEW_FILES_A_TASK)


def stage_kinds(files: DataFrame, configs, keep=()) -> DataFrame:
    """The body pass of several searches without primary keywords over the same files,
    each body read once: ``found_0``, ``hits_0`` and so on, one row per file, without a term too."""
    ext = urls.url_extension(F.col("html_url"))
    found = {
        f"found_{k}": built_once(found_in_content, tuple(w for w in config.words if w))
        for k, config in enumerate(configs)
    }
    matched = compute_once(files, files.columns, ext=ext, **found)
    hits = {
        f"hits_{k}": F.when(F.size(f"found_{k}") > 0, built_once(_hits, config, f"found_{k}"))
        for k, config in enumerate(configs)
    }
    columns = ["file_id", "html_url", "indexed_at", "ext", *found, *keep]
    staged = compute_once(matched, columns, **hits)
    return staged.withColumn("no_primary", F.lit(None).cast("array<struct<kw:string,n:int>>"))


def _hits(config, found="found"):
    """``hits`` of a file with ``content``, ``ext`` and the column ``found``."""

    def of_candidates(secrets):
        return let(
            _strong(secrets, config),
            lambda strong: file_hits(
                F.col("content"),
                F.col(found),
                strong,
                config.kind == CREDS,
                config.case_sensitive,
                config.max_line,
            ),
        )

    return _gated(F.col("content"), F.col("ext"), config, of_candidates)


def with_fetch_url(df: DataFrame, config: ScanConfig) -> DataFrame:
    """Add ``fetch_url`` (read by the scan, hashed by the ledger), URL and path parts."""
    html = F.col("html_url")
    if config.source == PUBLIC:
        fetch = urls.to_raw_url(html, config.site_host, config.raw_host)
        report = urls.to_blob_url(F.col("fetch_url"), config.site_host, config.raw_host)
        path = urls.raw_file_path(F.col("fetch_url"))
    elif config.source == FILES:
        return df.withColumns({"fetch_url": html, "URL": html})
    else:
        full_name = F.concat_ws("/", urls.url_owner(html), urls.url_repo(html))
        fetch = urls.to_contents_url(config.pre_url, full_name, urls.blob_file_path(html))
        report = html
        path = urls.contents_file_path(F.col("fetch_url"))
    return df.withColumn("fetch_url", fetch).withColumns(
        {
            "URL": report,
            "owner": urls.url_owner(html),
            "repo": urls.url_repo(html),
            "file_path": path,
        }
    )


def _query(config):
    if config.source == PUBLIC:
        return public_query(F.col("primary"), F.col("kw"))
    return enterprise_query(F.col("kw"))


def with_fingerprint(df: DataFrame, config: ScanConfig) -> DataFrame:
    """Add ``query`` and ``hashed_url`` to rows with ``html_url``, ``kw``, ``primary``."""
    return (
        with_fetch_url(df, config)
        .withColumn("query", _query(config))
        .withColumn("hashed_url", fingerprint(F.col("fetch_url"), F.col("query")))
    )


def scanned_pairs(staged: DataFrame, config: ScanConfig) -> DataFrame:
    """One row per file and query that was processed, for ledger and report."""
    pairs = staged.select(
        "file_id", "html_url", "ext", "found_primary", F.explode("found.kw").alias("kw")
    )
    if config.primary is None:
        pairs = pairs.withColumn("primary", F.lit(None).cast("string"))
    else:
        pairs = pairs.withColumn("primary", F.explode("found_primary.kw"))
    return with_fingerprint(pairs.drop("found_primary"), config)


def _explode_matches(rows, config):
    rows = rows.withColumn("m", F.explode("matches")).withColumns(
        {"kw": F.col("m.kw"), "n": F.col("m.n"), "line": F.col("m.line")}
    )
    rows = rows.drop("m", "matches")
    if config.primary is None:
        return rows.drop("found_primary").withColumn("primary", F.lit(None).cast("string"))
    rows = rows.withColumn("p", F.explode("found_primary"))
    rows = rows.withColumns({"primary": F.col("p.kw"), "n": F.col("n") + F.col("p.n")})
    return rows.drop("p", "found_primary")


def _repeat_searches(rows, config):
    """Without de-duplication: repeat a row once per search that returns its file."""
    words, own = config.words, F.lit(0)
    for w in sorted(set(words)):
        if words.count(w) > 1:
            own = F.when(F.col("kw") == w, F.lit(words.count(w) - 1)).otherwise(own)
    times = own + F.lit(1)
    if config.extensions:
        listed = F.array(*[F.lit(e) for e in config.extensions])
        times = times * F.size(
            F.filter(listed, lambda e: (e == F.col("ext")) | e.isin(R.ANY_EXTENSION, ""))
        )
    return rows.withColumn("_n", F.explode(F.sequence(F.lit(1), times))).drop("_n")


#: What detections show of a staged file, besides its hits.
_FILE_COLUMNS = ["file_id", "html_url", "indexed_at", "ext", "found_primary"]


def candidate_hits(
    staged: DataFrame, config: ScanConfig, ledger=None, ngrams=None, in_place=False
) -> DataFrame:
    """One row per file, keyword and secret with its first hit line, unseen files only.

    Against a ledger, seen rows go first and the dictionary is asked for the
    rest; without one, each secret of a file is scored once for all keywords.
    ``in_place``: ``ngrams`` fits the tasks, see ``match_in_place``.
    """
    rows = staged.select(*_FILE_COLUMNS, F.explode("hits").alias("h"))
    rows = rows.select("*", "h.secret", "h.entropy", "h.matches").drop("h")

    def with_match(df):
        if ngrams is None:
            return df.withColumn("match", F.lit(0.0))
        return (match_in_place if in_place else dictionary_match)(df, ngrams)

    if ledger is None:
        return with_fingerprint(_explode_matches(with_match(rows), config), config)
    rows = _explode_matches(rows, config)
    unseen = drop_seen(with_fingerprint(rows, config), ledger)
    # derived columns are cheap; only the join key stays, which the rows are
    # partitioned by, so scoring does not shuffle them again
    return with_fingerprint(with_match(unseen.select("hashed_url", *rows.columns)), config)


def detections(
    staged: DataFrame, config: ScanConfig, ledger=None, ngrams=None, confidence=None,
    commits=None, model=None, stored=False, predicted=False,
) -> DataFrame:
    """Scored, masked and enriched detections of staged files.

    ``stored``: ``staged`` is a written table. Else its files with candidates are written
    here, their secrets sealed, if they are read again: for their keys if ``commits`` are
    given, and for their distinct secrets if ``ngrams`` does not fit the tasks.
    ``predicted``: leave the detections that the model takes for false in, with its
    ``prediction`` as the last column.
    """
    spark = staged.sparkSession
    in_place = ngrams is not None and fits_in_place(ngrams)
    hit = staged if stored else staged.where(F.size("hits") > 0).select(*_FILE_COLUMNS, "hits")
    if not stored and (commits is not None or (ngrams is not None and not in_place)):
        staged, stored = written(hit, "staged", seal=["hits"]), True
        hit = staged.drop("hits")
    elif stored:
        hit = staged.where(F.size("hits") > 0)
    if stored and in_place:
        in_place = hit.count() >= IN_PLACE_FILES
    rows = candidate_hits(staged, config, ledger, ngrams, in_place)
    if not config.dedupe:
        rows = _repeat_searches(rows, config)
    rows = key_weight(rows, read_confidence(spark) if confidence is None else confidence)
    rows = rows.withColumns(
        {
            "SKey_Count": count_score(F.col("n")),
            "Entropy": F.col("entropy"),
            "Dictionary_Similarity": dictionary_score(F.col("match")),
        }
    )
    rows = rows.withColumn(
        "Score",
        F.col("Key_Weight") + F.col("Entropy") + F.col("SKey_Count")
        + F.col("Dictionary_Similarity"),
    )
    rows = rows.withColumns(
        {
            "Source": F.lit(config.label),
            "Primary_Key": F.col("primary"),
            "Second_Key": F.col("kw"),
            "Extension": F.col("ext"),
            "Secret": F.col("secret"),
        }
    )
    if model is not None:
        from credsieve.operators.ml import with_prediction

        rows = with_prediction(rows.withColumn("Code", F.col("line")), model).drop("Code")
        if not predicted:
            rows = rows.where("prediction <> 0").drop("prediction")
    if commits is not None:
        rows = attach_commits(rows, commits, _keys_of(hit, config))
    rows = stamp(rows, config.as_of).withColumn(
        "Code", code_column(F.col("line"), F.col("secret"), config.unmask, config.compat_mask)
    )
    if config.source != FILES:
        rows = rows.withColumns({"Owner": F.col("owner"), "Repo_Name": F.col("repo")})
    shown = ["prediction"] if predicted and model is not None else []
    return rows.select(*_output_columns(config, commits is not None), *shown)


def _keys_of(hit, config):
    """Owner, repository and path of each file with a candidate."""
    files = with_fetch_url(hit.select("html_url"), config)
    return written(files.select("owner", "repo", "file_path"), "hit-files")


def _output_columns(config, with_commits):
    if config.columns:
        return list(config.columns)
    if config.source == PUBLIC:
        names = schemas.PUBLIC_DETECTIONS if with_commits else schemas.PUBLIC_COLLECTOR
    else:
        names = schemas.ENTERPRISE_DETECTIONS if with_commits else schemas.ENTERPRISE_COLLECTOR
    return [c for c in names if config.keep_secret or c != "Secret"]


def scan(files: DataFrame, config: ScanConfig, scanned=None, **inputs) -> DataFrame:
    """Detections of a code corpus; see ``detections`` for the optional inputs.

    ``scanned``: what earlier runs have scanned; only newer versions are read.
    """
    if scanned is not None:
        files = unscanned(files, scanned, config)
    markdown_free = files.where(clean.not_markdown(urls.url_extension(F.col("html_url"))))
    return detections(stage_files(markdown_free, config), config, **inputs)


def scan_creds(files, config=None, **inputs) -> DataFrame:
    """Credential scan, enterprise or public as configured."""
    return scan(files, replace(config or ScanConfig(), kind=CREDS), **inputs)


def scan_keys(files, config=None, **inputs) -> DataFrame:
    """Key and token scan, enterprise or public as configured."""
    return scan(files, replace(config or ScanConfig(), kind=KEYS), **inputs)


def collect_training(files, config: ScanConfig, **inputs) -> DataFrame:
    """Training rows: raw lines, case-sensitive keywords, default label 1."""
    return scan(files, training_config(config), **inputs).withColumn("Label", F.lit(1))


def training_config(config: ScanConfig) -> ScanConfig:
    return replace(
        config, unmask=True, case_sensitive=True, keep_secret=True,
        columns=tuple(c for c in schemas.TRAINING_SOURCE if c != "Label"),
    )
