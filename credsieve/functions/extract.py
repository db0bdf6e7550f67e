"""Candidate secrets of a cleaned text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from credsieve import resources as R
from credsieve.functions.clean import char_class, tokenize
from credsieve.functions.common import let, literal_strings

MIN_TOKEN = 7
MAX_CANDIDATES = 20
#: Stop words that are given to Spark one by one, a call each.
MOST_SINGLE_WORDS = 256

_NO_STRINGS = "array<string>"

# Whitespace of the Latin-1 range, written out for speed; and the rest.
_SPACE = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0"
_RARE_SPACE = r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _can_stand_in_clean_text(literal) -> bool:
    return not any(c in literal for c in (*R.KEY_NOISE, R.KEY_NOISE_PAIR))


def _aws_secret_lines(c: Column) -> Column:
    """Per line: text up to the last 40 character block after an AWS secret name.

    The block must be exactly 40 characters long and an upper-case letter must
    stand in it or behind it. Cutting the line behind its last upper-case
    letter first keeps the look for the block linear.
    """
    present = [n for n in R.AWS_SECRET_NAMES if _can_stand_in_clean_text(n)]
    names = "|".join(present)
    block = rf"(?<![{R.AWS_SECRET_CHARS}])[{R.AWS_SECRET_CHARS}]{{40}}(?![{R.AWS_SECRET_CHARS}])"
    up_to_upper = r"(?d)^.*[A-Z][0-9a-z/+=]*"
    head = rf"(?d)^(?>.*?(?:{names})).*{block}"
    lines = F.filter(F.split(c, "\n", -1), lambda l: l.rlike(names))
    found = F.transform(
        lines, lambda l: F.regexp_extract(F.regexp_extract(l, up_to_upper, 0), head, 0)
    )
    named = F.lit(False)
    for name in present:
        named = named | F.contains(c, F.lit(name))
    return F.when(named, found).otherwise(F.array().cast(_NO_STRINGS))


def key_candidates(c: Column, patterns=R.KEY_BANK) -> Column:
    """Distinct matches of all key patterns in a text cleaned for keys.

    Long runs of key characters are cut out once; the patterns made of such
    characters are matched against those few runs.
    """

    def matches(text):
        run = f"(?<![{R.RUN_CHARS}])[{R.RUN_CHARS}]{{{R.RUN_LENGTH},}}"
        runs = F.array_join(F.regexp_extract_all(text, F.lit(run), F.lit(0)), " ")
        return let(runs, lambda r: _key_matches(text, r, patterns))

    return let(c, matches)


def _key_matches(text, runs, patterns):
    parts, guarded = [], {}
    for name, regex in patterns:
        if (name, regex) == R.AWS_SECRET_LINE:
            parts.append(_aws_secret_lines(text))
            continue
        java = F.lit("(?d)" + R.PATTERN_RUN_STARTS.get(name, "") + regex)
        known = (name, regex) in R.KEY_PATTERNS
        needle = R.PATTERN_NEEDLES.get(name) if known else None
        if known and name in R.RUN_PATTERNS:
            parts.append(F.regexp_extract_all(runs, java, F.lit(0)))
        elif needle is None:
            parts.append(F.regexp_extract_all(text, java, F.lit(0)))
        elif _can_stand_in_clean_text(needle):
            guarded.setdefault(needle, []).append(F.regexp_extract_all(text, java, F.lit(0)))
    for needle, found in guarded.items():
        parts.append(
            F.when(F.contains(text, F.lit(needle)), F.flatten(F.array(*found))).otherwise(
                F.array().cast(_NO_STRINGS)
            )
        )
    if not parts:
        return F.array().cast(_NO_STRINGS)
    return F.filter(F.array_distinct(F.flatten(F.array(*parts))), lambda k: k != "")


def is_cred_token(t: Column, stop_words=R.STOP_WORDS) -> Column:
    """Long enough, no stop word, no escape/hex/rfc/http text, a digit and a letter."""
    return (F.length(t) >= MIN_TOKEN) & _digit_and_letter(t) & _is_no_noise(t, stop_words)


def _digit_and_letter(t: Column) -> Column:
    return t.rlike("[0123456789]") & t.rlike("[a-zA-Z]")


def _is_no_noise(t: Column, stop_words) -> Column:
    """No stop word, no escape/hex/rfc/http text."""

    def plain(low):
        starts = low.startswith("u0") | low.startswith("0x") | low.startswith("rfc")
        return ~(starts | low.contains("http"))

    # Constants given one by one are looked up by hash, an array of them is searched through.
    if 0 < len(stop_words) <= MOST_SINGLE_WORDS:
        stopped = t.isin(list(stop_words))
    else:
        stopped = F.array_contains(literal_strings(stop_words), t)
    return ~stopped & let(F.lower(t), plain)


def cred_candidates(c: Column, stop_words=R.STOP_WORDS) -> Column:
    """Distinct credential-like tokens of a text without links.

    Tokens are runs between whitespace and the characters that cleaning blanks,
    so blanking them first makes no difference. Runs with rare whitespace in
    them are split further, after those without a digit or letter are gone.
    """
    run = rf"[^{_SPACE}{char_class(R.CRED_NOISE)}]{{{MIN_TOKEN},}}"
    inner, rare = F.lit(f"[^{_RARE_SPACE}]{{{MIN_TOKEN},}}"), f"[{_RARE_SPACE}]"

    def split_further(runs):
        parts = F.flatten(
            F.transform(
                runs,
                lambda t: F.when(t.rlike(rare), F.regexp_extract_all(t, inner, F.lit(0))).otherwise(
                    F.array(t)
                ),
            )
        )
        # Runs as they are have a digit and a letter already.
        return F.when(F.exists(runs, lambda t: t.rlike(rare)), F.filter(parts, _digit_and_letter)).otherwise(runs)

    runs = F.filter(F.regexp_extract_all(c, F.lit(run), F.lit(0)), _digit_and_letter)
    tokens = let(runs, split_further)
    return F.array_distinct(F.filter(tokens, lambda t: _is_no_noise(t, stop_words)))


def cred_tokens(c: Column, stop_words=R.STOP_WORDS) -> Column:
    """The same from the full token list."""
    return F.array_distinct(F.filter(tokenize(c), lambda t: is_cred_token(t, stop_words)))


def candidate_count_ok(candidates: Column, most=MAX_CANDIDATES) -> Column:
    return F.size(candidates).between(1, most)
