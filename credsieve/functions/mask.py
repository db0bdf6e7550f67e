"""Hide the secret in a reported line."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from credsieve.functions.common import strip_blank

MASK = "#" * 10
KEPT_CHARS = 4


def mask_line(line: Column, secret: Column, compat_mask=False) -> Column:
    """Keep the text through the first ``:`` or ``=`` and four characters of the rest.

    Without a separator, or with nothing behind it, the secret itself is
    replaced. Unless ``compat_mask``, a secret that is still readable in the
    masked line is replaced too.
    """
    head = F.regexp_extract(line, r"^[^:=]*[:=]", 0)
    rest = strip_blank(F.substring(line, F.length(head) + F.lit(1), F.length(line)))
    masked = F.concat(
        head,
        F.substring(rest, 1, KEPT_CHARS),
        F.lit(MASK),
        F.when(rest.endswith('"'), F.lit('"')).otherwise(F.lit("")),
    )
    plain = F.replace(line, secret, F.lit(MASK))
    out = F.when((head != "") & (rest != ""), masked).otherwise(plain)
    return out if compat_mask else F.replace(out, secret, F.lit(MASK))


def code_column(line: Column, secret: Column, unmask=False, compat_mask=False) -> Column:
    return line if unmask else mask_line(line, secret, compat_mask)
