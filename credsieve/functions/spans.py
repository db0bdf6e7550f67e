"""Keys in raw text with their places: the bank ``fixed``.

A span is STRUCT<start, end, name, secret>: 1-based place of the first character, place
behind the last one, name of the pattern, matched text.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from credsieve import resources as R
from credsieve.functions.common import let

#: Elements that are combined before they meet the others.
BLOCK = 128
SPAN = "struct<start:int,end:int,rank:int,name:string,secret:string>"
_NONE = f"array<{SPAN}>"


def bounded(chars: str, regex: str) -> str:
    """A key that no character of the class ``chars`` stands before or behind."""
    return rf"(?<![{chars}])(?:{regex})(?![{chars}])"


def running(values: Column, combine, zero: int) -> Column:
    """For each element of a non-empty array of int what ``combine`` makes of those before
    it. Blocks are combined first, so an element looks at no more than its own block."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))

    def block(k):
        return F.slice(values, k * BLOCK + 1, F.lit(BLOCK))

    def fold(part, start):
        return F.aggregate(part, start, lambda a, b: combine(a, b))

    def within(own, start):
        return F.transform(own, lambda v, i: fold(F.slice(own, F.lit(1), i), start))

    def placed(totals):
        return F.transform(
            blocks,
            lambda k: let(
                fold(F.slice(totals, F.lit(1), k), F.lit(zero)),
                lambda start: let(block(k), lambda own: within(own, start)),
            ),
        )

    totals = F.transform(blocks, lambda k: fold(block(k), F.lit(zero)))
    return F.flatten(let(totals, placed))


def matches_at(text: Column, regex: str, name: str, rank: int) -> Column:
    """Spans of all matches of a pattern, in order.

    The text between the matches and the matches themselves give the places: what lies
    before a match is as long as all texts and matches before it.
    """

    def placed(matches, between):
        steps = F.zip_with(
            matches, F.slice(between, 1, F.size(matches)), lambda m, b: F.length(b) + F.length(m)
        )

        def span(m, reached):
            # ``reached``: where the match ends, as a place from 0.
            return F.struct(
                (reached - F.length(m) + 1).alias("start"),
                (reached + 1).alias("end"),
                F.lit(rank).alias("rank"),
                F.lit(name).alias("name"),
                m.alias("secret"),
            )

        def spans(s):
            ends = F.zip_with(running(s, lambda a, b: a + b, 0), s, lambda a, b: a + b)
            return F.zip_with(matches, ends, span)

        return let(steps, spans)

    def found(matches):
        between = F.split(text, regex, -1)
        some = let(between, lambda b: placed(matches, b))
        return F.when(F.size(matches) > 0, some).otherwise(F.array().cast(_NONE))

    return let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), found)


def all_spans(text: Column, bank=R.FIXED_BANK) -> Column:
    """Spans of every pattern of a bank of (name, needle, class, regex), also overlapping
    ones. A text without the needle is not searched for the pattern."""
    parts = []
    for rank, (name, needle, chars, regex) in enumerate(bank):
        found = matches_at(text, bounded(chars, regex) if chars else regex, name, rank)
        if needle:
            found = F.when(F.contains(text, F.lit(needle)), found).otherwise(F.array().cast(_NONE))
        parts.append(found)
    return F.flatten(F.array(*parts)) if parts else F.array().cast(_NONE)


def _longest_first(spans: Column) -> Column:
    """Spans in the order in which they take their place: longer ones, then earlier ones,
    then those of the earlier pattern."""
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            (s["start"] - s["end"]).alias("minus"), s["start"].alias("at"), s["rank"].alias("r"), s.alias("s")
        ),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def _without_overlaps(spans: Column) -> Column:
    def step(kept, s):
        free = ~F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))
        return F.when(free, F.concat(kept, F.array(s))).otherwise(kept)

    return F.aggregate(_longest_first(spans), F.array().cast(_NONE), step)


def longest_spans(spans: Column) -> Column:
    """Of spans that overlap the longest stays, then the longest of those left, and so on.

    Spans are taken by place and settled cluster by cluster: a span that starts behind the
    ends of all before it cannot overlap any of them. So the work grows with the number of
    spans and not with its square, however long the text.
    """

    def clusters(own, reach):
        """Index of the first span of each cluster."""
        indexed = F.zip_with(own, reach, lambda s, r: s["start"] >= r)
        at = F.transform(indexed, lambda first, i: F.when(first, i))
        return F.filter(at, lambda i: i.isNotNull())

    def settled(own, first):
        def one(i, k):
            end = F.coalesce(F.get(first, k + 1), F.size(own))
            members = F.slice(own, i + 1, end - i)
            return F.when(end - i == 1, members).otherwise(_without_overlaps(members))

        return F.flatten(F.transform(first, one))

    def of_sorted(own):
        reach = running(F.transform(own, lambda s: s["end"]), F.greatest, 0)
        return let(let(reach, lambda r: clusters(own, r)), lambda first: settled(own, first))

    return let(F.array_sort(spans), of_sorted)


def key_spans(text: Column, bank=R.FIXED_BANK) -> Column:
    """Spans of the keys of a raw text, none overlapping another, by place; an empty array
    for a text without any, null for a null text."""
    found = let(
        all_spans(text, bank),
        lambda s: F.when(F.size(s) > 1, longest_spans(s)).otherwise(s),
    )
    return F.when(text.isNotNull(), F.array_sort(found))


def fixed_key_candidates(text: Column, bank=R.FIXED_BANK) -> Column:
    """The distinct keys of a raw text."""
    return F.array_distinct(F.transform(key_spans(text, bank), lambda s: s["secret"]))
