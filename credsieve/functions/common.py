"""Small expression helpers shared by the other modules."""

from collections import OrderedDict

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_built: OrderedDict = OrderedDict()
#: Expressions kept; the one longest unused goes first.
_MOST_BUILT = 64


def built_once(build, *key) -> Column:
    """``build(*key)``, kept for later plans of this process.

    Large expressions take seconds to put together call by call; a stream would
    do so for each batch.
    """
    slot = (id(SparkContext._gateway), build, key)
    built = _built.pop(slot, None)
    if built is None:
        built = build(*key)
    _built[slot] = built
    while len(_built) > _MOST_BUILT:
        _built.popitem(last=False)
    return built


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often body uses it.

    Naming an expensive value in a projection does not pin it: Catalyst may
    inline it into every use. A lambda variable is never inlined.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compute_once(df: DataFrame, keep, **exprs) -> DataFrame:
    """Project ``keep`` plus new columns that later filters cannot duplicate.

    A filter on a projected column is pushed below the projection, so the
    expression runs twice. Generators stop that push, hence the one-row inline.
    """
    row = F.struct(*[e.alias(name) for name, e in exprs.items()])
    return df.select(*keep, F.inline(F.array(row)))


def sql_string(text: str) -> str:
    """A text as SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_strings(values) -> Column:
    """Constant ARRAY<STRING>, typed also when empty.

    Constants of many values are built as one SQL text: a call per value would
    take longer than the query.
    """
    items = ", ".join(sql_string(v) for v in values)
    return F.expr(f"cast(array({items}) as array<string>)")


def strip_blank(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
