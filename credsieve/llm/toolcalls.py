"""Tool calls of conversations: linked to results, ordered, validated, serialised."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import read, written

_ID = ["conv_id", "call_id"]
#: Variant type names (without parameters) that a schema type accepts.
ACCEPTS = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"),
    "boolean": ("BOOLEAN",),
    "object": ("OBJECT",),
    "array": ("ARRAY",),
}
#: Tools of the registered query: (name, field, type, required).
TOOLS = (
    ("search", "query", "string", True),
    ("search", "limit", "integer", False),
    ("lookup", "key", "string", True),
    ("lookup", "exact", "boolean", False),
    ("compute", "values", "array", True),
    ("compute", "scale", "number", True),
)


def schema_table(spark, tools=TOOLS) -> DataFrame:
    return spark.createDataFrame(list(tools), "name string, field string, type string, required boolean")


def _first_calls(calls: DataFrame) -> DataFrame:
    """One row per (conv_id, call_id), the earliest, and how often the id was used."""
    row = F.struct("turn", "name", "arguments", "after")
    one = calls.groupBy(*_ID).agg(F.min(row).alias("call"), F.count("*").alias("uses"))
    return one.select(*_ID, "call.*", "uses")


def _first_results(results: DataFrame) -> DataFrame:
    one = results.groupBy(*_ID).agg(
        F.min(F.struct(F.col("turn").alias("result_turn"), "content")).alias("result")
    )
    return one.select(*_ID, "result.*")


def _jumped(nodes: DataFrame) -> DataFrame:
    """(conv_id, call_id, top, steps) for ``nodes`` (conv_id, call_id, dep): the first call
    above each that does not have exactly one dependency, and the links up to it.

    ``dep`` is the one dependency of a call that has one, else null. A call's pointer jumps
    to where the one it points to points, so the links doubled a round lead up a chain of
    n calls in log2(n) rounds. Pointers that never leave a ring of calls have no row.
    """
    start = F.when(F.col("dep").isNull(), F.col("call_id")).otherwise(F.col("dep"))
    links = F.when(F.col("dep").isNull(), 0).otherwise(1).cast("long")
    now = nodes.select(*_ID, start.alias("top"), links.alias("steps"), F.col("dep").isNull().alias("done"))
    now = written(now, "tool-jumps")
    while True:
        above = now.select(
            "conv_id", F.col("call_id").alias("top"), F.col("top").alias("next"),
            F.col("steps").alias("more"), F.col("done").alias("ends"),
        )
        moving = now.where("not done").join(above.hint("shuffle_hash"), ["conv_id", "top"])
        moved = moving.select(
            *_ID, F.col("next").alias("top"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ends").alias("done")
        )
        after = written(now.where("done").unionByName(moved), "tool-jumps")
        left = after.where("not done").agg(F.count("*"), F.min("steps")).first()
        size = after.count() if left[0] else 0
        now = after
        # A pointer that has gone further than there are calls is in a ring.
        if not left[0] or left[1] > size:
            return now.where("done").drop("done")


def topological_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of ``calls`` (conv_id, call_id, after): 0 without a known
    dependency, else one more than the highest level among them. Calls on a cycle, or
    behind one, have no row.

    Chains of calls with one dependency each are climbed by pointer jumping, in as many
    rounds as the chain's length has binary digits. What is left are the calls with several
    dependencies: rounds take away those whose dependencies are all placed, as many as
    such calls follow each other on the longest path.
    """
    nodes = calls.select(*_ID)
    wanted = calls.select(*_ID, F.explode(F.array_distinct("after")).alias("dep"))
    known = nodes.select("conv_id", F.col("call_id").alias("dep"))
    edges = written(wanted.join(known.hint("shuffle_hash"), ["conv_id", "dep"]), "tool-edges")
    counted = edges.groupBy(*_ID).agg(F.count("*").alias("deps"), F.min("dep").alias("dep"))
    counted = nodes.join(counted.hint("shuffle_hash"), _ID, "left")
    one = counted.select(*_ID, F.when(F.col("deps") == 1, F.col("dep")).alias("dep"))
    tops = written(_jumped(one), "tool-tops")
    several = written(counted.where("deps > 1").select(*_ID), "tool-joints")
    # Between calls with several dependencies: joint, the joint or root above a dependency,
    # and the links from it to the joint.
    above = tops.select("conv_id", F.col("call_id").alias("dep"), "top", (F.col("steps") + 1).alias("steps"))
    between = edges.join(several.hint("shuffle_hash"), _ID, "left_semi")
    between = between.join(above.hint("shuffle_hash"), ["conv_id", "dep"], "left")
    left = written(between.select(*_ID, "top", "steps"), "tool-between")
    roots = counted.where("deps is null").select(*_ID, F.lit(0).cast("long").alias("level"))
    levels = placed = written(roots, "tool-levels")
    while not left.isEmpty():
        done = levels.select("conv_id", F.col("call_id").alias("top"), "level")
        joined = left.join(done.hint("shuffle_hash"), ["conv_id", "top"], "left")
        ready = joined.groupBy(*_ID).agg(
            F.bool_and(F.col("level").isNotNull()).alias("ready"),
            F.max(F.col("level") + F.col("steps")).alias("level"),
        )
        placed = written(ready.where("ready").select(*_ID, "level"), "tool-levels")
        if placed.isEmpty():
            break
        levels = written(levels.unionByName(placed), "tool-levels")
        left = written(left.join(placed.hint("shuffle_hash"), _ID, "left_anti"), "tool-between")
    bases = levels.select("conv_id", F.col("call_id").alias("top"), "level")
    found = tops.join(bases.hint("shuffle_hash"), ["conv_id", "top"])
    return found.select(*_ID, (F.col("level") + F.col("steps")).cast("int").alias("level"))


def _problems(arguments, fields):
    """Error texts of a map of variants against a list of (field, type, required)."""

    def type_of(value):
        return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)

    def problem(rule):
        value = F.element_at(arguments, rule["field"])
        kind = type_of(value)
        fits = F.lit(False)
        for name, accepted in ACCEPTS.items():
            fits = fits | ((rule["type"] == name) & kind.isin(*accepted))
        missing = value.isNull() | (kind == "VOID")
        return (
            F.when(missing & rule["required"], F.concat(F.lit("missing "), rule["field"]))
            .when(~missing & ~fits, F.concat(F.lit("not "), rule["type"], F.lit(": "), rule["field"]))
        )

    named = F.transform(fields, lambda rule: rule["field"])
    unknown = F.transform(
        F.array_except(F.map_keys(arguments), named), lambda k: F.concat(F.lit("unknown "), k)
    )
    found = F.filter(F.transform(fields, problem), lambda x: x.isNotNull())
    return F.array_sort(F.concat(found, unknown))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Calls joined to their results, one row per (conv_id, call_id).

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), after (ids of calls
    that it depends on); ``results``: conv_id, call_id, turn, content; ``schemas``: name,
    field, type (a key of ``ACCEPTS``), required. Result: conv_id, call_id, level, turn,
    name, status, errors, json.

    * status: ``ok``, ``no_result``, ``orphan_result`` (a result without a call),
      ``early_result`` (before its call), ``cycle``; the last ones win.
    * errors: sorted problems of the arguments, of the id (``repeated id``) and of
      ``after`` (``unknown dependency ...``).
    * level: topological order within the conversation, then turn, then call_id. Rows
      come out sorted by conv_id, level, turn, call_id; null on a cycle or for orphans.
    * json: canonical, keys sorted at every depth, no blanks, nulls left out. Arguments
      that are not a JSON object stay text under ``raw``.

    Of rows with the same id the earliest call and the earliest result count. Null ids
    never match: such a call is dropped from the linking and reported as a row without
    result. Null or empty arguments are no JSON. Extra columns are ignored; empty tables
    give an empty result. No conversation is gathered anywhere: joins and counts are by
    call, and a frequent id is reduced to one row before the shuffle.
    """
    calls = calls.select(*_ID, "turn", "name", "arguments", "after")
    one = written(_first_calls(calls), "tool-calls")
    answers = written(_first_results(results.select(*_ID, "turn", "content")), "tool-results")
    levels = topological_levels(one.where("conv_id is not null and call_id is not null"))
    rules = schemas.groupBy("name").agg(
        F.collect_list(F.struct("field", "type", "required")).alias("fields")
    )

    linked = one.withColumn("called", F.lit(True)).join(
        answers.withColumn("answered", F.lit(True)).hint("shuffle_hash"), _ID, "full_outer"
    )
    placed = linked.join(levels.hint("shuffle_hash"), _ID, "left").join(rules, "name", "left")

    known = written(one.select("conv_id", F.col("call_id").alias("dep")), "tool-known")
    wanted = one.select(*_ID, F.explode("after").alias("dep")).distinct()
    strange = wanted.join(known.hint("shuffle_hash"), ["conv_id", "dep"], "left_anti").groupBy(*_ID)
    strange = strange.agg(F.array_sort(F.collect_set("dep")).alias("strange"))
    placed = written(placed.join(strange.hint("shuffle_hash"), _ID, "left"), "tool-linked")

    value = F.try_parse_json("arguments")
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    fields = F.when(is_object, F.from_json("arguments", "map<string, variant>"))
    arguments = F.coalesce(
        F.when(fields.isNull(), F.array(F.lit("arguments are no JSON object"))),
        F.when(F.col("fields").isNull(), F.array(F.lit("unknown tool"))),
        _problems(fields, F.col("fields")),
    )
    none = F.array().cast("array<string>")
    errors = F.concat(
        F.when(F.col("called"), arguments).otherwise(none),
        F.when(F.col("uses") > 1, F.array(F.lit("repeated id"))).otherwise(none),
        F.transform(
            F.coalesce("strange", none), lambda d: F.concat(F.lit("unknown dependency "), d)
        ),
    )
    on_cycle = F.col("called") & F.col("level").isNull() & F.col("conv_id").isNotNull()
    status = (
        F.when(on_cycle & F.col("call_id").isNotNull(), "cycle")
        .when(F.col("called").isNull(), "orphan_result")
        .when(F.col("answered").isNull(), "no_result")
        .when(F.col("result_turn") < F.col("turn"), "early_result")
        .otherwise("ok")
    )
    body = F.to_json(
        F.struct(
            F.when(is_object, value).alias("arguments"),
            F.col("call_id"),
            F.col("conv_id"),
            F.col("errors"),
            F.col("level"),
            F.col("name"),
            F.when(is_object, F.lit(None)).otherwise(F.col("arguments")).alias("raw"),
            F.col("content").alias("result"),
            F.col("status"),
            F.col("turn"),
        )
    )
    return (
        placed.withColumn("errors", errors)
        .withColumn("status", status)
        .withColumn("json", body)
        .select(*_ID, "level", "turn", "name", "status", "errors", "json")
        .orderBy("conv_id", "level", "turn", "call_id")
    )


def derived_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read out of plain conversations: every assistant turn is a call
    whose arguments come from its text (some broken on purpose, by a hash), depending on
    the assistant turn before it; every other turn is the result of the turn before."""

    def call_id(turn):
        return F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))

    text = F.coalesce("text", F.lit(""))
    h = F.xxhash64(text)
    words = F.size(F.split(text, " "))
    head = F.substring_index(text, " ", 4)
    tools = F.array(F.lit("search"), F.lit("lookup"), F.lit("compute"))
    tool = F.element_at(tools, F.pmod(h, F.lit(3)).cast("int") + 1)
    odd = F.pmod(h, F.lit(11)) == 0
    search = F.to_json(F.struct(words.alias("limit"), F.when(~odd, head).alias("query")))
    lookup = F.to_json(F.struct((words > 20).alias("exact"), head.alias("key")))
    compute = F.concat(F.lit('{"scale": '), (words / 2).cast("string"), F.lit(', "values": ['),
                       words.cast("string"), F.lit("]"), F.when(odd, "").otherwise("}"))
    arguments = F.when(tool == "search", search).when(tool == "lookup", lookup).otherwise(compute)
    turn = F.col("turn")
    chained = (turn >= 2) & (F.pmod(F.floor(turn / 2), F.lit(4)) != 0)
    after = F.when(chained, F.array(call_id(turn - 2))).otherwise(F.array().cast("array<string>"))
    assistant = F.col("role") == "assistant"
    calls = conversations.where(assistant).select(
        "conv_id", call_id(turn).alias("call_id"), "turn", tool.alias("name"),
        arguments.alias("arguments"), after.alias("after"),
    )
    results = conversations.where(~assistant).select(
        "conv_id", call_id(turn - 1).alias("call_id"), "turn", F.col("text").alias("content")
    )
    return calls, results


def op2_tool_call_linking(spark, sf_dir):
    calls, results = derived_calls(read(spark, sf_dir, "conversations"))
    return link_tool_calls(calls, results, schema_table(spark))
