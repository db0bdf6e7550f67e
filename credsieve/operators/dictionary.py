"""Similarity of a candidate to ordinary words, by character pieces."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.functions.common import compute_once, let
from credsieve.functions.score import NGRAM_SIZES, char_ngrams, ngram_text
from credsieve.operators.partitioning import BROADCAST_ROWS, fits_broadcast, left_join_hot, semi_join
from credsieve.scratch import salted_hash, written

MIN_DOC_SHARE = 1e-5
#: Pieces of a table up to which every task may hold it: it passes through the driver.
IN_PLACE_PIECES = 500_000


def dictionary_words(documents: DataFrame, text="text") -> DataFrame:
    """Distinct lower-cased words of four letters or more of a text column."""
    words = F.array_distinct(
        F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}{4,}"), F.lit(0))
    )
    return documents.select(F.explode(words).alias("dic_word")).distinct()


def build_ngram_table(words: DataFrame) -> DataFrame:
    """Total occurrences of each 3, 4 and 5 character piece over the words.

    ``words`` should be a stored table, as its rows are counted as well.
    Pieces found in fewer than 1e-5 of the words are dropped. One aggregation
    with map-side combine: a word counts for the document frequency at the
    first place the piece stands in it.
    """
    total_words = words.select(F.count("*")).scalar()

    def marked(grams):
        once = F.transform(grams, lambda g: F.struct(g.alias("ngram"), F.lit(1).alias("first")))
        some_twice = F.transform(
            grams,
            lambda g, i: F.struct(
                g.alias("ngram"), (F.array_position(grams, g) == i + 1).cast("int").alias("first")
            ),
        )
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), once).otherwise(some_twice)

    pieces = words.select(F.explode(let(char_ngrams(F.col("dic_word")), marked)).alias("p"))
    return (
        pieces.groupBy(F.col("p.ngram").alias("ngram"))
        .agg(F.count("*").alias("total"), F.sum("p.first").alias("doc_freq"))
        .where(F.col("doc_freq") >= F.lit(MIN_DOC_SHARE) * total_words)
        .select("ngram", "total", "doc_freq", F.log10("total").alias("log_total"))
    )


def dictionary_match(df: DataFrame, ngrams: DataFrame, secret="secret", max_rows=BROADCAST_ROWS):
    """Add ``match``: sum over the pieces of the secret of the piece's log total.

    Each distinct secret is scored once, whatever rows hold it, and its score joined back
    by a salted hash: the stored scores name no secret. ``ngrams`` should be a stored
    table, as it is measured first; ``df`` is read twice, so it should be cheap to read.
    """
    table = ngrams.select("ngram", "log_total")
    secrets = df.select(F.col(secret).alias("_secret")).where("_secret is not null").distinct()
    pieces = secrets.withColumn("ngram", F.explode(char_ngrams(F.col("_secret"))))
    if fits_broadcast(table, max_rows):
        # The distinct secrets lie by secret already, so the sum needs no shuffle.
        met = pieces.join(F.broadcast(table), "ngram")
        scores = met.groupBy("_secret").agg(F.sum("log_total").alias("match"))
    else:
        scores = _scores_shuffled(pieces, table)
    scores = written(scores.select(salted_hash("_secret").alias("_hash"), "match"), "scores")
    joined = left_join_hot(df.withColumn("_hash", salted_hash(secret)), scores, ["_hash"], max_rows)
    return joined.select(*df.columns, F.coalesce("match", F.lit(0.0)).alias("match"))


def fits_in_place(ngrams: DataFrame) -> bool:
    """Whether a stored table is small enough for ``match_in_place``."""
    return ngrams.count() <= IN_PLACE_PIECES


def match_in_place(df: DataFrame, ngrams: DataFrame, secret="secret") -> DataFrame:
    """The same ``match`` for a table that fits each task. The rows of ``df`` stay where
    they are and are read once: nothing is grouped, stored or joined back, so the work
    grows with the rows alone. Each secret of a batch is scored once, and pieces are looked
    up only where the text goes on like the start of one."""
    totals: dict = {}
    for piece, log_total in ngrams.select("ngram", "log_total").collect():
        if piece is not None and log_total is not None:
            totals[piece] = totals.get(piece, 0.0) + log_total
    sizes, head = NGRAM_SIZES, min(NGRAM_SIZES)
    heads = frozenset(piece[:head] for piece in totals)
    held = df.sparkSession.sparkContext.broadcast((totals, heads))

    @F.pandas_udf("double")
    def match(texts: pd.Series) -> pd.Series:
        known, heads = held.value

        def score(text):
            starts = [i for i in range(len(text) - head + 1) if text[i : i + head] in heads]
            pieces = (text[i : i + n] for n in sizes for i in starts if i + n <= len(text))
            return float(sum(known.get(piece, 0.0) for piece in pieces))

        scores = {text: 0.0 if text is None else score(text) for text in texts.unique()}
        return texts.map(scores)

    # Behind a generator no later filter asks for the score a second time.
    scored = df.withColumn("_match", match(ngram_text(F.col(secret))))
    return compute_once(scored, df.columns, match=F.coalesce("_match", F.lit(0.0)))


def _scores_shuffled(pieces, table):
    """For a table too large to broadcast: the pieces go to the table. The first characters
    of the table's pieces are far fewer than these; while they can be broadcast, a piece
    that starts like none of them is left out before the shuffle."""
    head = F.substring("ngram", 1, min(NGRAM_SIZES))
    heads = written(table.select(head.alias("_head")).distinct(), "heads")
    likely = semi_join(pieces.withColumn("_head", head), heads, "_head").drop("_head")
    return (
        likely.join(table.hint("merge"), "ngram")
        .groupBy("_secret")
        .agg(F.sum("log_total").alias("match"))
    )
