"""Line dedup: exact and near copies of lines over the whole corpus, by deletion keys.

Two lines count as copies if at most ``one`` word was changed, inserted or dropped. Each
line emits its deletion neighbourhood, that is the hashed line without word i for every i,
and the hashed line itself; lines with an equal key are joined and verified. Lines that
cannot have a partner are left out first: with one edit, the first or the last half of a
pair is unchanged, so a line whose halves no other line shares has none.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credsieve.llm.common import discard, fresh, keyed, read, release, written

#: Lines with fewer words have no near copies.
MIN_WORDS = 5
COUNTS = ("n_lines", "n_removed", "n_long_left")
_LINE = ["h", "g"]
_RARE_BLANKS = "\t\x0b\x0c\r"


def line_words(line):
    """Words of a line column: runs of other characters than space, \\t, \\v, \\f, \\r."""
    rare = F.lit(False)
    for blank in _RARE_BLANKS:  # a plain search; most lines are spared the translation
        rare = rare | F.contains(line, F.lit(blank))
    spaced = F.when(rare, F.translate(line, _RARE_BLANKS, "    ")).otherwise(line)
    return F.array_remove(F.split(spaced, " "), "")


def _half_keys(words, n):
    """Keys of the unchanged half. For a pair whose shorter line has q words, both lines
    emit the first q // 2 and the last q - q // 2 words under q; a line of n words can
    be the pair's longer one (q = n - 1) or not (q = n)."""
    keys = []
    for q in (n, n - 1):
        half = F.floor(q / 2).cast("int")
        keys += [
            F.xxhash64(q, F.lit("first"), F.slice(words, F.lit(1), half)),
            F.xxhash64(q, F.lit("last"), F.slice(words, n - (q - half) + 1, q - half)),
        ]
    return F.array(*keys)


def _lines(with_key: DataFrame, key, least: int) -> DataFrame:
    """Judged lines: place (document order, key, line number), hashes, half keys (null
    for lines under ``MIN_WORDS``)."""
    lines = with_key.select("doc_id", *key, F.posexplode(F.split("text", "\n")).alias("line", "body"))
    worded = lines.select(
        F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *key, "line").alias("place"),
        line_words(F.col("body")).alias("words"),
    ).where(F.size("words") >= least)
    halves = _half_keys(F.col("words"), F.size("words"))
    return worded.select(
        "place",
        F.xxhash64("words").alias("h"),
        F.hash("words").alias("g"),
        F.when(F.size("words") >= MIN_WORDS, halves).alias("halves"),
    )


def _with_partner(distinct: DataFrame) -> DataFrame:
    """Hashes and place of the lines that share a half with another line."""
    halves = distinct.select(*_LINE, F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    shared = written(shared.where("low <> high").select("half"), "line-halves")
    found = written(halves.join(shared.hint("merge"), "half").select(*_LINE).distinct(), "line-paired")
    paired = distinct.select(*_LINE, "place").join(found.hint("merge"), _LINE)
    return written(paired, "line-candidates")


def _bodies(with_key: DataFrame, key, lines: DataFrame) -> DataFrame:
    """``lines`` plus their words, read again from the documents that hold them."""
    wanted = lines.select(*[F.col(f"place.{k}").alias(k) for k in key], "place", *_LINE)
    per_text = wanted.groupBy(*key).agg(F.collect_list(F.struct("place", *_LINE)).alias("wanted"))
    # Rows equal in id and text hold the same lines; one of each stays at the end.
    texts = with_key.select(*key, "text").join(per_text.hint("merge"), key)
    picked = texts.select(F.split("text", "\n").alias("lines"), F.inline("wanted"))
    words = line_words(F.get("lines", F.col("place.line")))
    found = picked.select(*_LINE, "place", words.alias("words")).dropDuplicates(_LINE)
    return written(found, "line-bodies")


def _variants(bodies: DataFrame) -> DataFrame:
    """(h, g, n, i, v): key v of each line without word i, and of the whole line (i = -1).

    A sequence's key is the exclusive or of the hashes of its (position, word) pairs. The
    words after the dropped one move up by a place, so running sums over both
    placements give all keys of a line in one sweep.
    """
    words = bodies.select(*_LINE, F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    here, moved = F.xxhash64("i", "word"), F.xxhash64(F.col("i") - 1, "word")
    whole = Window.partitionBy(*_LINE)
    upto = whole.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = words.select(
        *_LINE, "n", "i",
        here.alias("here"),
        F.bit_xor(here).over(upto).alias("before"),
        F.bit_xor(here).over(whole).alias("full"),
        F.bit_xor(moved).over(whole).bitwiseXOR(F.bit_xor(moved).over(upto)).alias("after"),
    )
    dropped = F.col("before").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("after"))
    entry = F.struct(F.col("i").alias("i"), dropped.alias("v"))
    line = F.struct(F.lit(-1).alias("i"), F.col("full").alias("v"))
    both = F.when(F.col("i") == 0, F.array(entry, line)).otherwise(F.array(entry))
    return sums.select(*_LINE, "n", F.inline(both))


def _near_copies(bodies: DataFrame) -> DataFrame:
    """(h, g) of the lines that are one word away from an earlier line.

    Under each key only the earliest line of each kind is a partner for the others, so a
    crowded key costs one pair per line.
    """
    variants = written(_variants(bodies), "line-variants")
    shared = variants.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v")
    shared = written(shared, "line-shared")
    listed = variants.join(shared.hint("merge"), "v")
    places = bodies.select(*_LINE, "place").hint("merge")
    listed = written(listed.join(places, _LINE), "line-listed")
    discard(variants, shared)
    first = F.min(F.struct("place", *_LINE, "i")).alias("first")
    same = listed.groupBy("v", "i").agg(first)  # whole lines (i = -1) or one word replaced
    longer = listed.where("i >= 0").groupBy("v").agg(first)
    shorter = listed.where("i = -1").groupBy("v").agg(first)
    pairs = [
        listed.where("i >= 0").join(same.hint("merge"), ["v", "i"]),
        listed.where("i >= 0").join(shorter.hint("merge"), "v"),
        listed.where("i = -1").join(longer.hint("merge"), "v"),
    ]
    columns = [*_LINE, "i", F.col("first.h").alias("h2"), F.col("first.g").alias("g2"),
               F.col("first.i").alias("i2")]
    found = None
    for pair in pairs:
        part = pair.where("first.place < place").select(*columns)
        found = part if found is None else found.unionByName(part)
    words = bodies.select(*_LINE, "words")
    other = words.select(
        F.col("h").alias("h2"), F.col("g").alias("g2"), F.col("words").alias("words2")
    )
    both = found.distinct().join(words.hint("merge"), _LINE).join(other.hint("merge"), ["h2", "g2"])

    def without(name, at):
        return f"if({at} < 0, {name}, concat(slice({name}, 1, {at}), slice({name}, {at} + 2, size({name}))))"

    verified = both.where(f"{without('words', 'i')} = {without('words2', 'i2')}")
    return written(verified.select(*_LINE).distinct(), "line-near")


def dedup_lines(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """Columns of ``docs`` with ``text`` reduced to its kept lines, plus n_lines, n_removed
    (of all lines of the text) and n_long_left (judged lines that stay).

    Lines are parts between ``\\n``. A line of ``least`` words or more goes if an earlier line
    of the corpus has the same words, or, if both have ``MIN_WORDS`` or more, words that one
    changed, inserted or dropped word turns into them; earlier means smaller doc_id (nulls
    last, equal ones by a hash of the text), then smaller line number. The earlier line
    need not stay itself. Lines of fewer than ``least`` words (at least 1) always stay. A null text stays null with no lines. Rows equal in doc_id
    and text are one document and come out once; their other columns are those of one of
    the rows. Extra columns pass through, but for any named like the counts; an empty
    table stays empty.
    """
    with_key, key = keyed(docs)
    lines = _lines(with_key, key, least)
    distinct = written(
        lines.groupBy(*_LINE).agg(F.min("place").alias("place"), F.any_value("halves").alias("halves")),
        "line-distinct",
    )
    candidates = _with_partner(distinct)
    near = _near_copies(_bodies(with_key, key, candidates))
    release(docs.sparkSession)
    # A line stays where it stands first, unless it is a near copy.
    stays = distinct.select(*_LINE, "place").join(near.hint("merge"), _LINE, "left_anti")
    mark, parts, chosen = (fresh(with_key, c) for c in ("_kept", "_parts", "_chosen"))
    kept = written(
        stays.groupBy(*[F.col(f"place.{k}").alias(k) for k in key]).agg(
            F.collect_list("place.line").alias(mark)
        ),
        "line-kept",
    )
    joined = with_key.dropDuplicates(key).join(kept.hint("merge"), key, "left")
    own = F.coalesce(F.col(mark), F.array().cast("array<int>"))

    def stays_here(body, at):
        return F.array_contains(own, at) | (F.size(line_words(body)) < least)

    cut = joined.withColumn(parts, F.split("text", "\n")).withColumn(
        chosen, F.filter(parts, stays_here)
    )
    return cut.select(
        *[c for c in docs.columns if c not in ("text", *COUNTS)],
        F.array_join(chosen, "\n").alias("text"),
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(parts) - F.size(chosen), F.lit(0)).cast("long").alias("n_removed"),
        F.size(own).cast("long").alias("n_long_left"),
    )


def without_copied_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with copied lines removed, in the same columns; a column n_chars counts
    the new text. Copies of lines of any length go, and so do documents that lose their
    last line that is not blank."""
    # Columns named like the counts step aside meanwhile.
    aside = {name: fresh(docs, f"_{name}") for name in COUNTS if name in docs.columns}
    cut = dedup_lines(docs.withColumnsRenamed(aside), 1).where("n_removed = 0 or n_long_left > 0")
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return cut.select(*[F.col(aside.get(name, name)).alias(name) for name in docs.columns])


def op6_line_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, 1).select("doc_id", "n_lines", "n_removed", "text")
