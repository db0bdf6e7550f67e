"""URL filters: canonical keys, rule intervals and one sorted sweep over both.

A rule names a host and a path prefix; it fits the host, its subdomains and every
path that starts with the prefix. Key of a rule: its host with the labels reversed, a
zero byte, its path. All keys below a rule then form one interval, and intervals are
nested or apart. A URL probes the sorted keys once for itself and each parent domain.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credsieve.llm.common import read, written

#: host, path, verdict of the registered query.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Verdict where no rule fits.
DEFAULT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_START, _PROBE, _END = 0, 1, 2


def url_target(url):
    """(host, path) columns: host after the first ``://`` up to ``/``, ``?``, ``#`` or
    the end, A-Z lower-cased; path from there up to ``?``, ``#`` or the end. Both
    empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*+([^?#]*+)", 1)


def _key(host, path):
    """Reversed labels, zero byte, path; bytes sort as unsigned numbers."""
    turned = F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")
    return F.concat(F.encode(turned, "UTF-8"), F.unhex(F.lit("00")), F.encode(path, "UTF-8"))


def rule_table(spark, rules) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def boundaries(rules: DataFrame) -> DataFrame:
    """Start and end of every rule's interval with the rule in force from there on.

    (key, kind, top): ``top`` is the innermost rule still open after the event, null
    if none. This is the sweep's stack, kept as one slot per nesting level: after an
    event at level n the top is the last rule that started at level n. Only rules of
    one host can nest, so each host is swept on its own.
    """
    one = (
        rules.select(
            F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("host"),
            F.coalesce("path", F.lit("")).alias("path"),
            "verdict",
        )
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # block over allow for the same rule
    )
    rule = F.struct(
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_length"),
        "verdict",
    )
    key = _key(F.col("host"), F.col("path"))
    end = F.concat(key, F.unhex(F.lit("FF")))  # above every UTF-8 text below the prefix
    events = one.select(
        "host",
        F.inline(
            F.array(
                F.struct(key.alias("key"), F.lit(_START).alias("kind"), rule.alias("opened")),
                F.struct(end.alias("key"), F.lit(_END).alias("kind"), F.lit(None).alias("opened")),
            )
        ),
    )
    order = Window.partitionBy("host").orderBy("key", "kind")
    step = F.when(F.col("kind") == _START, 1).otherwise(-1)
    levels = events.withColumn("level", F.sum(step).over(order))
    slot = Window.partitionBy("host", "level").orderBy("key", "kind")
    top = F.when(F.col("level") > 0, F.last("opened", ignorenulls=True).over(slot))
    return levels.select("key", "kind", top.alias("top"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    ``rule`` is the longest rule that fits (host and path joined; of two equally long
    ones that of the longer host), null if none does; ``verdict`` is the rule's, else
    ``default``. A null url, or one without ``://``, has empty host and path. Equal
    (host, path) are judged once. Rows that occur twice come out twice, extra columns
    are ignored, an empty table gives an empty result. The sorted events are cut into
    ranges of equal size, also inside one key; a range starts with the rule left open
    by the ranges before it, so no host or path makes a range larger.
    """
    host, path = url_target(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    targets = seen.select("host", "path").distinct()
    marks = written(boundaries(rules), "url-boundaries")
    longest = rules.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 0

    labels = F.split("host", r"\.", -1)
    depths = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(longest)))
    parents = F.transform(depths, lambda n: F.array_join(F.slice(labels, -n, n), "."))
    probes = targets.where(F.lit(longest > 0)).select(
        "host", "path", F.explode(parents).alias("parent")
    )
    events = probes.select(
        _key(F.col("parent"), F.col("path")).alias("key"),
        F.lit(_PROBE).alias("kind"),
        F.xxhash64("host").alias("tie"),
        F.struct("host", "path").alias("target"),
        F.lit(None).cast(marks.schema["top"].dataType).alias("top"),
    ).unionByName(
        marks.select("key", "kind", F.lit(0).cast("long").alias("tie"), "top"), allowMissingColumns=True
    )
    order = ["key", "kind", "tie"]
    ranges = written(
        events.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "url-events"
    )
    state = F.when(F.col("kind") != _PROBE, F.struct("top"))  # a closed rule leaves a null top
    left_open = (
        ranges.where(F.col("kind") != _PROBE)
        .groupBy("range")
        .agg(F.max_by(F.struct("top"), F.struct(*order)).alias("state"))
    )
    # One row per range from here on.
    carried = (
        ranges.groupBy("range")
        .agg(F.count("*").alias("rows"))
        .join(left_open, "range", "left")
        .select(
            "range",
            F.last("state", ignorenulls=True)
            .over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
            .alias("before"),
        )
    )
    sweep = Window.partitionBy("range").orderBy(*order)
    swept = ranges.withColumn("state", F.last(state, ignorenulls=True).over(sweep))
    hits = (
        swept.where(F.col("kind") == _PROBE)
        .join(F.broadcast(carried), "range")
        .select("target.*", F.coalesce("state", "before")["top"].alias("top"))
        .where("top is not null")
    )
    rank = F.struct(F.length("top.rule"), "top.host_length", "top.rule", "top.verdict")
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return seen.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def op3_url_filters(spark, sf_dir):
    return judge_urls(read(spark, sf_dir, "pages"), rule_table(spark, RULES))


ORACLE = f"""
with rules(h, p, v) as (values {", ".join(str(r) for r in RULES)}),
rests as (
  select page_id, case when url is null or strpos(url, '://') = 0 then ''
    else substr(url, strpos(url, '://') + 3) end as rest from pages),
seen as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rests),
best as (
  select host, path, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v
  from (select distinct host, path from seen) s join rules
    on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
  group by host, path)
select page_id, s.host, s.path, rule, coalesce(v, '{DEFAULT}') as verdict
from seen s left join best b on s.host = b.host and s.path = b.path
"""
