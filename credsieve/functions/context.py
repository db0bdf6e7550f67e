"""Does a line tie a candidate to its keyword?"""

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LINE = 300

# A line with one of these is never a hit.
NOISE_WORDS = ("http", "www", "uuid")


def content_lines(content: Column) -> Column:
    return F.split(content, "\n", -1)


def candidate_lines(content: Column, secret: Column) -> Column:
    """Lines of the raw file that hold the candidate, in order."""
    return F.filter(content_lines(content), lambda l: F.contains(l, secret))


def line_short(line: Column, limit=MAX_LINE) -> Column:
    return F.length(line) < limit


def line_quiet(line: Column) -> Column:
    quiet = F.lit(True)
    for word in NOISE_WORDS:
        quiet = quiet & ~F.contains(line, F.lit(word))
    return quiet


def keyword_before(line, low, keyword, secret, case_sensitive=False) -> Column:
    """Keyword in the line, before the candidate, and more than the candidate.

    ``low`` is the lower-cased line, passed in so that it is computed once.
    """
    at = F.instr(line, keyword) if case_sensitive else F.instr(low, F.lower(keyword))
    return (at > 0) & (line != secret) & (at < F.instr(line, secret))


def separator_between(line, keyword, secret) -> Column:
    """First ``:`` or first ``=`` before the candidate and behind the keyword.

    The keyword position is case-sensitive; a keyword in other case counts as
    position 0, so then any separator is behind it.
    """
    until, start = F.instr(line, secret), F.instr(line, keyword)

    def lies_between(mark):
        at = F.instr(line, F.lit(mark))
        return (at < until) & (at > start)

    return lies_between(":") | lies_between("=")


def line_is_key_hit(line, keyword, secret, case_sensitive=False) -> Column:
    return line_quiet(line) & keyword_before(
        line, F.lower(line), keyword, secret, case_sensitive
    )


def line_is_cred_hit(line, keyword, secret, case_sensitive=False) -> Column:
    return line_is_key_hit(line, keyword, secret, case_sensitive) & separator_between(
        line, keyword, secret
    )


def first_hit(content, keyword, secret, need_separator, case_sensitive=False) -> Column:
    """First short line of the file that is a hit, else null."""
    test = line_is_cred_hit if need_separator else line_is_key_hit
    hits = F.filter(
        content_lines(content),
        lambda l: line_short(l)
        & F.contains(l, secret)
        & test(l, keyword, secret, case_sensitive),
    )
    return F.get(hits, F.lit(0))


def file_hits(
    content, found, secrets, need_separator, case_sensitive=False, max_line=MAX_LINE
) -> Column:
    """All hits of a file: per candidate its keywords and first hit lines.

    ``found`` is ARRAY<STRUCT<kw, n>>, ``secrets`` ARRAY<STRUCT<secret, entropy>>.
    Lines are narrowed per candidate before any keyword is tried, so the work is
    lines x candidates for the plain containment test only.
    """
    lines = F.transform(
        F.filter(content_lines(content), lambda l: line_short(l, max_line) & line_quiet(l)),
        lambda l: F.struct(l.alias("raw"), F.lower(l).alias("low")),
    )

    def is_hit(l, k, s):
        hit = keyword_before(l["raw"], l["low"], k, s, case_sensitive)
        return hit & separator_between(l["raw"], k, s) if need_separator else hit

    def per_candidate(own_lines, s):
        matches = F.transform(
            found,
            lambda k: F.struct(
                k["kw"].alias("kw"),
                k["n"].alias("n"),
                F.get(
                    F.filter(own_lines, lambda l: is_hit(l, k["kw"], s["secret"])), F.lit(0)
                )["raw"].alias("line"),
            ),
        )
        return F.struct(
            s["secret"].alias("secret"),
            s["entropy"].alias("entropy"),
            F.filter(matches, lambda m: m["line"].isNotNull()).alias("matches"),
        )

    def per_lines(ls):
        return F.transform(
            secrets,
            lambda s: F.get(
                F.transform(
                    F.array(F.filter(ls, lambda l: F.contains(l["raw"], s["secret"]))),
                    lambda own: per_candidate(own, s),
                ),
                F.lit(0),
            ),
        )

    hits = F.get(F.transform(F.array(lines), per_lines), F.lit(0))
    return F.filter(hits, lambda h: F.size(h["matches"]) > 0)
