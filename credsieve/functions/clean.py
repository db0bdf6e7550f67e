"""File gates and text cleaning.

Texts may hold megabytes without a line break. Each pattern is therefore
linear: a run of characters is entered only at its start (or where the last
match ended, ``\\G``) and character classes are never nested in groups.
"""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from credsieve import resources as R
from credsieve.functions import domains
from credsieve.functions.common import let

MAX_URLS = 30
MIN_LINES = 3

# URL and e-mail shapes.
URL = r"https?://[!$-_a-z]+"
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"

_LOCAL, _HOST = R.ALNUM + r"_.+\-", R.ALNUM + r".\-"
_EMAIL_LINEAR = (
    rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{R.ALNUM}\-]++\.[{_HOST}]+"
)


def bare_url_pattern(tlds=R.TLDS) -> str:
    """URL without a scheme: dotted word ending in a known domain, and its path."""
    names = "|".join(re.escape(t) for t in tlds)
    return (
        rf"(?:(?<![{_HOST}])|\G)[{_HOST}]*[{R.ALNUM}]\."
        rf"(?i:{names})(?![A-Za-z0-9_])(?:[/:?#][!$-_a-z]*)?"
    )


def _where_it_holds(c: Column, mark: str, change) -> Column:
    """``change(c)`` for texts with ``mark``, which every match holds; others as they are."""
    return let(c, lambda t: F.when(F.contains(t, F.lit(mark)), change(t)).otherwise(t))


def strip_urls(c: Column) -> Column:
    return _where_it_holds(c, "://", lambda t: F.regexp_replace(t, URL, " "))


def _change_lines(text: Column, holds, change) -> Column:
    """Change the lines that pass a test, for patterns that stay within a line."""
    changed = F.transform(
        F.split(text, "\n", -1), lambda l: F.when(holds(l), change(l)).otherwise(l)
    )
    return F.array_join(changed, "\n")


def strip_emails(c: Column) -> Column:
    return _where_it_holds(
        c,
        "@",
        lambda text: _change_lines(
            text,
            lambda line: F.contains(line, F.lit("@")),
            lambda line: F.regexp_replace(line, _EMAIL_LINEAR, " "),
        ),
    )


def holds_domain(c: Column, tlds=R.TLDS) -> Column:
    """Quick test that every text with a bare URL passes: a dot and a known domain."""
    names = "|".join(re.escape(t) for t in tlds)
    return c.rlike(rf"\.(?<=[A-Za-z0-9]\.)(?i:{names})(?![A-Za-z0-9_])")


def strip_bare_urls(c: Column, tlds=R.TLDS) -> Column:
    """Blank scheme-less URLs; expects a text without URLs and e-mails.

    ``tlds`` is a short list of domains, or a ``DomainTable``.
    """
    if isinstance(tlds, domains.DomainTable):
        return domains.strip_bare_urls(c, tlds)
    pattern = bare_url_pattern(tlds)
    return _change_lines(
        c,
        lambda line: holds_domain(line, tlds),
        lambda line: F.regexp_replace(line, pattern, " "),
    )


def char_class(chars: str) -> str:
    """The characters of a regex class, escaped where they have a meaning there."""
    return re.sub(r"([\[\]\\^&-])", r"\\\1", chars)


def blank_key_noise(c: Column) -> Column:
    return F.regexp_replace(c, f"[{char_class(R.KEY_NOISE)}]|{R.KEY_NOISE_PAIR}", " ")


def blank_cred_noise(c: Column) -> Column:
    return F.regexp_replace(c, f"[{char_class(R.CRED_NOISE)}]", " ")


def strip_links(c: Column) -> Column:
    """Text without scheme URLs and e-mails, the base of all further cleaning."""
    return strip_emails(strip_urls(c))


def clean_for_keys(c: Column) -> Column:
    return blank_key_noise(strip_links(c))


def clean_for_creds(c: Column, tlds=R.TLDS) -> Column:
    return blank_cred_noise(strip_bare_urls(strip_links(c), tlds))


def tokenize(c: Column) -> Column:
    """Words between whitespace of any kind."""
    return F.regexp_extract_all(c, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))


def scheme_url_count(content: Column) -> Column:
    count = F.regexp_count(content, F.lit(URL))
    return F.when(F.contains(content, F.lit("://")), count).otherwise(F.lit(0))


def bare_url_count(links_stripped: Column, tlds=R.TLDS) -> Column:
    if isinstance(tlds, domains.DomainTable):
        return domains.bare_url_count(links_stripped, tlds)

    def count(text):
        lines = F.filter(F.split(text, "\n", -1), lambda line: holds_domain(line, tlds))
        return F.regexp_count(F.array_join(lines, "\n"), F.lit(bare_url_pattern(tlds)))

    return let(
        links_stripped,
        lambda text: F.when(holds_domain(text, tlds), count(text)).otherwise(F.lit(0)),
    )


def url_count(content: Column, links_stripped: Column, tlds=R.TLDS) -> Column:
    """URLs in a file: those with a scheme, plus bare ones in the stripped text."""
    return scheme_url_count(content) + bare_url_count(links_stripped, tlds)


def few_urls(content: Column, links_stripped: Column, tlds=R.TLDS) -> Column:
    return url_count(content, links_stripped, tlds) <= MAX_URLS


def not_markdown(extension: Column) -> Column:
    return extension != "md"


def long_enough(content: Column, min_lines=MIN_LINES) -> Column:
    """At least so many lines; looks no further than the line break before the last of them."""
    if min_lines <= 1:
        return content.isNotNull()
    return F.substring_index(content, "\n", min_lines - 1) != content
