"""URLs without a scheme, recognised by a full table of domains.

A host is a run of letters, digits, ``_``, ``-`` and dots. It counts if its last labels,
without dots and hyphens at the end and in lower case, are a suffix of the table and a
label stands before them. Suffixes may have several labels and any script; names of other
scripts are known in punycode too. Labels are looked up by hash, so the table's size does
not matter to a text.
"""

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

HOST = r"\p{L}\p{M}\p{N}_.\-"
#: Set behind a known host; a noncharacter, of which texts keep a replacement.
MARK, REPLACEMENT = "\ufdd0", "\ufffd"
# The path behind a host.
PATH = rf"(?:[/:?#][!$-_a-z{MARK}]*+)?"
# A run is entered at its start only, so that long ones take linear time.
URL = rf"(?:(?<![{HOST}])|\G)[{HOST}]++{MARK}{PATH}"
_DOTTED = r"[\p{L}\p{M}\p{N}_\-]\.[\p{L}\p{N}]"


def _forms(name: str) -> set:
    """A suffix in lower case, and in punycode if it has other letters than ASCII ones."""
    name = name.strip().strip(".").lower()
    if name.isascii():
        return {name}
    try:
        return {name, name.encode("idna").decode()}
    except UnicodeError:
        return {name}


@dataclass(frozen=True)
class DomainTable:
    """Domain suffixes, in order of their number of labels and then of their letters."""

    names: tuple

    @classmethod
    def of(cls, names):
        forms = set().union(*map(_forms, filter(None, names))) - {""}
        return cls(tuple(sorted(forms, key=lambda n: (n.count("."), n))))

    def by_labels(self) -> dict:
        found = {}
        for name in self.names:
            found.setdefault(name.count(".") + 1, []).append(name)
        return found


def is_known(host: Column, table: DomainTable) -> Column:
    """Whether a host ends in a suffix of the table, with a label before it."""
    host = F.lower(F.rtrim(host, F.lit(".-")))
    known = F.lit(False)
    for labels, names in table.by_labels().items():
        tail = F.substring_index(host, ".", -labels)
        more = F.length(F.substring_index(host, ".", -labels - 1))
        known = known | (tail.isin(*names) & (more > F.length(tail) + 1))
    return known


def _marked(text: Column, table: DomainTable) -> Column:
    """Each known host of a text with the mark behind it."""
    tokens = F.regexp_extract_all(
        F.translate(text, MARK, REPLACEMENT), F.lit(rf"[{HOST}]++|[^{HOST}]++"), F.lit(0)
    )
    return F.array_join(
        F.transform(
            tokens,
            lambda t: F.when(
                F.contains(t, F.lit(".")) & is_known(t, table), F.concat(t, F.lit(MARK))
            ).otherwise(t),
        ),
        "",
    )


def _has_dotted(line: Column) -> Column:
    return line.rlike(_DOTTED)


def strip_bare_urls(text: Column, table: DomainTable) -> Column:
    """Blank scheme-less URLs; a null text stays null."""

    def blanked(line):
        found = F.regexp_replace(_marked(line, table), URL, " ")
        return F.when(_has_dotted(line), found).otherwise(line)

    return F.array_join(F.transform(F.split(text, "\n", -1), blanked), "\n")


def bare_url_count(text: Column, table: DomainTable) -> Column:
    """Number of scheme-less URLs in a text."""
    lines = F.filter(F.split(text, "\n", -1), _has_dotted)
    return F.regexp_count(_marked(F.array_join(lines, "\n"), table), F.lit(URL))
