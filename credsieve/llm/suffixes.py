"""Removal of long repeated byte strings by hashed contexts of content-defined anchors.

The method named for this operator, a merge of shard Burrows-Wheeler transforms by
iterative interleave refinement, is not done here: it needs one refinement round per byte
of the prefix looked at, ``LENGTH`` rounds that each move a row per byte. No suffix order is
read and no common prefixes come out. What takes its place, with the same result:

* Texts are cut into phrases at content-defined anchors: the minima of a rolling hash in
  every ``REACH`` consecutive positions, so equal texts are cut equally, save for ``REACH``
  bytes at either end.
* Every window of ``LENGTH`` bytes belongs to the first anchor at ``REACH - 1`` to
  ``2 * REACH - 2`` bytes from its start, and holds that anchor and the two phrases after it in
  every copy (see ``_check_lengths``). So a task emits a row per anchor that owns windows,
  with hashes of the phrase after it (``sym``), of the phrase at it (``bwt``) and of two byte
  contexts.
* Rows that share both phrase hashes with no other row own no repeated window and leave; two
  groupings by hash do so.
* Of the byte contexts, ``c`` names the bytes around an anchor that any of its windows holds,
  ``u`` those that its windows cover together. Where ``u`` is repeated, all windows are;
  where several ``u`` meet in one ``c``, single windows are compared.

The hashes are polynomials modulo 2**64. Texts made to collide (Thue-Morse strings) weaken
them; no others are known to.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import (
    batches,
    discard,
    keyed,
    mix,
    read,
    release,
    running_hash,
    span_hash,
    written,
)

LENGTH = 400
#: Bytes hashed at a position, and positions among which a minimum makes an anchor.
GRAM = 16
REACH = 72
#: Longer texts are parsed piece by piece; pieces overlap by ``MARGIN`` bytes.
PIECE = 1 << 20
MARGIN = 2048
_PLACE = np.uint64((1 << 24) - 1)
_SECOND = np.uint64(0xA0761D6478BD642F)


def _check_lengths(length):
    """Anchors in [x + REACH - 1, x + length - REACH - GRAM + 1] are the same in all
    copies of a window at x; the first one lies within REACH positions, and two phrases
    of at most REACH bytes each must end before the last."""
    if 4 * REACH + GRAM - 3 > length:
        raise ValueError(f"length must be {4 * REACH + GRAM - 3} or more")


def anchors(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Anchor positions in joined texts; ``end`` is the end of the text of each byte."""
    count = len(data) - GRAM + 1
    if count < REACH:
        return np.zeros(0, np.int64)
    at = np.arange(count)
    h = span_hash(running_hash(data), at, at + GRAM)
    low = (h & ~_PLACE) | (_PLACE - at.astype(np.uint64))  # of equal hashes the last one
    width = 1
    while width < REACH:
        step = min(width, REACH - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    inside = np.arange(len(low)) + REACH - 1 + GRAM <= end[: len(low)]
    return np.unique((_PLACE - (low[inside] & _PLACE)).astype(np.int64))


def transform_rows(texts, bases, keep, length):
    """Rows of the anchors of texts (bytes, pieces of whole texts).

    ``bases``: offset of each piece in its text; ``keep``: the range of anchors, within
    the piece, that are this piece's own. One row for each suffix whose preceding anchor owns windows: text (index),
    low and count of these windows (positions in the whole text), sym, bwt, c, u.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    offset = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), np.uint8)
    end = np.repeat(offset + size, size)
    p = anchors(data, end)
    text = np.searchsorted(offset, p, side="right") - 1
    running = running_hash(data)
    # Windows of an anchor: starts low..high.
    before = np.concatenate(([-1], p[:-1])) if len(p) else p
    own_before = np.concatenate(([False], text[1:] == text[:-1])) if len(p) else np.zeros(0, bool)
    begin = offset[text]
    low = np.where(own_before, np.maximum(begin, before - REACH + 2), begin)
    high = np.minimum(p - REACH + 1, begin + size[text] - length)
    mine = (p - begin >= keep[text, 0]) & (p - begin < keep[text, 1])
    # A row is the suffix at q with the owner before it; the phrase at q must be whole.
    j = np.flatnonzero((low <= high) & mine)
    j = j[(j + 2 < len(p)) & (text[np.minimum(j + 2, len(p) - 1)] == text[j])]
    sym = span_hash(running, p[j + 1], p[j + 2])
    bwt = span_hash(running, p[j], p[j + 1])
    out = {
        "text": text[j],
        "low": low[j] - begin[j] + bases[text[j]],
        "count": (high - low + 1)[j],
        "sym": sym,
        "bwt": bwt,
        "c": span_hash(running, p[j] - REACH + 1, p[j] - 2 * REACH + 2 + length),
        "u": mix(span_hash(running, low[j], high[j] + length) + _SECOND),
    }
    order = np.lexsort((out["bwt"], out["sym"]))
    return {name: column[order] for name, column in out.items()}


def _pieces(text: bytes):
    """(piece, base, first own position, end of own positions)"""
    if len(text) <= PIECE:
        yield text, 0, 0, len(text)
        return
    for start in range(0, len(text), PIECE):
        low = max(0, start - MARGIN)
        yield text[low : start + PIECE + MARGIN], low, start - low, start - low + PIECE


def shard_transforms(docs: DataFrame, key, length: int) -> DataFrame:
    """Rows of all shards' transforms, each shard in suffix order: key columns, low, count,
    sym, bwt, c, u. ``bwt`` is half a hash, as rows that it leaves in a block in error go
    on to the next one only. ``c`` and ``u`` decide and are whole: all rows around one
    passage share ``c``, so ``u`` alone tells them apart."""
    kinds = {"low": np.int32, "count": np.int32, "bwt": np.int32}

    def run(frames):
        for frame in frames:
            cut = []
            for row, text in enumerate(frame["text"]):
                if text is not None and len(data := text.encode()) >= length:
                    cut += [(row, *piece) for piece in _pieces(data)]
            for first, texts in batches([c[1] for c in cut]):
                part = cut[first : first + len(texts)]
                rows = transform_rows(
                    texts,
                    np.array([c[2] for c in part]),
                    np.array([c[3:5] for c in part]),
                    length,
                )
                owner = np.array([c[0] for c in part])[rows.pop("text")]
                out = frame[key].iloc[owner].reset_index(drop=True)
                for name, column in rows.items():
                    out[name] = column.astype(kinds.get(name, np.int64))
                yield out

    schema = f"{key[0]} long, {key[1]} int, low int, count int, sym long, bwt int, c long, u long"
    return docs.select(*key, "text").mapInPandas(run, schema)


def refine(rows: DataFrame, block, drop=()) -> DataFrame:
    """Rows whose block, named by the columns ``block``, holds two or more rows. The
    counts are combined before the shuffle; they are written, so that the join has plain
    exchanges on both sides and Spark can split a large block."""
    counts = rows.groupBy(*block).agg(F.count("*").alias("rows")).where("rows > 1")
    shared = written(counts.select(*block), "suffix-blocks")
    kept = written(rows.join(shared.hint("merge"), block).drop(*drop), "suffix-rows")
    discard(shared)
    return kept


def repeated_ranges(docs: DataFrame, key, length: int = LENGTH) -> DataFrame:
    """(key columns, low, high): ranges of start positions, in bytes, whose ``length``
    bytes also start elsewhere in ``docs``. ``docs`` has a column text and key columns as
    made by ``keyed``; rows that are equal throughout count as copies of each other."""
    _check_lengths(length)
    first = refine(shard_transforms(docs, key, length), ["sym"])
    # LF step: the row now stands for the suffix that starts one phrase earlier.
    second = refine(first, ["bwt", "sym"], drop=["bwt", "sym"])
    discard(first)
    contexts = written(
        second.groupBy("c", "u").agg(
            F.count("*").alias("rows"), F.min(F.struct(*key, "low", "count")).alias("one")
        ),
        "suffix-contexts",
    )
    repeated = written(contexts.where("rows > 1").select("c", "u"), "suffix-repeated")
    whole = written(
        second.join(repeated.hint("merge"), ["c", "u"]).select(
            *key, "low", (F.col("low") + F.col("count") - 1).alias("high")
        ),
        "suffix-whole",
    )
    discard(second, repeated)
    # Blocks that share the inner bytes but not the outer: windows one by one, of one row
    # for each outer context.
    kinds = contexts.groupBy("c").agg(F.count("*").alias("kinds")).where("kinds > 1")
    several = written(kinds.select("c"), "suffix-several")
    probes = contexts.join(several.hint("merge"), "c").select(
        "one.*", (F.col("rows") == 1).alias("open")
    )
    per_text = probes.groupBy(*key).agg(
        F.collect_list("low").alias("lows"),
        F.collect_list("count").alias("counts"),
        F.collect_list("open").alias("opens"),
    )
    windows = written(
        docs.select(*key, "text")
        .join(per_text.hint("merge"), key)
        .mapInPandas(
            _window_rows(key, length),
            f"{key[0]} long, {key[1]} int, low int, open boolean, h1 long, h2 long",
        ),
        "suffix-windows",
    )
    discard(contexts, several)
    shared = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    single = windows.where("open").join(shared, ["h1", "h2"])
    return whole.unionByName(single.select(*key, "low", F.col("low").alias("high")))


def _window_rows(key, length):
    def run(frames):
        for frame in frames:
            for text, lows, counts, opens, *own in zip(
                frame["text"], frame["lows"], frame["counts"], frame["opens"], *(frame[k] for k in key)
            ):
                data = np.frombuffer(text.encode(), np.uint8)
                order = np.argsort(lows, kind="stable")
                lows, counts = np.asarray(lows)[order], np.asarray(counts)[order]
                opens = np.asarray(opens, bool)[order]
                for at in range(0, len(lows), 256):
                    part = slice(at, at + 256)
                    yield _hashed_windows(data, lows[part], counts[part], opens[part], own, key, length)

    return run


def _hashed_windows(data, lows, counts, opens, own, key, length):
    """Windows of a few anchors, hashed twice over the bytes that the anchors cover."""
    spans = [data[a : a + n - 1 + length] for a, n in zip(lows, counts)]
    joined = np.concatenate(spans)
    sizes = np.array([len(s) for s in spans])
    offsets = np.cumsum(sizes) - sizes
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.repeat(offsets, counts) + inner
    forward = running_hash(joined)
    other = running_hash(_MIRROR[joined])
    n = len(start)
    return pd.DataFrame(
        {
            key[0]: np.full(n, own[0], np.int64),
            key[1]: np.full(n, own[1], np.int32),
            "low": (np.repeat(lows, counts) + inner).astype(np.int32),
            "open": np.repeat(opens, counts),
            "h1": span_hash(forward, start, start + length).view(np.int64),
            "h2": span_hash(other, start, start + length).view(np.int64),
        }
    )


#: Another assignment of byte values, for a second, independent hash.
_MIRROR = np.random.RandomState(7).permutation(256).astype(np.uint8)


def merge_ranges(lows, highs, length):
    """Maximal byte ranges [start, end) covered by windows that start in low..high."""
    if lows is None or not len(lows):
        return np.zeros((0, 2), np.int64)
    lows, highs = np.asarray(lows, np.int64), np.asarray(highs, np.int64)
    order = np.argsort(lows, kind="stable")
    start, end = lows[order], np.maximum.accumulate(highs[order] + length)
    new = np.concatenate(([True], start[1:] > end[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(start) - 1]))
    return np.column_stack((start[new], end[last]))


def _with_ranges(docs: DataFrame, length: int):
    with_key, key = keyed(docs)
    ranges = repeated_ranges(with_key, key, length)
    per_text = written(
        ranges.groupBy(*key).agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs")),
        "suffix-ranges",
    )
    release(docs.sparkSession)
    return with_key, key, per_text


def removed_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, spans, kept.

    Each byte covered by a ``length``-byte string that also starts anywhere else in the
    corpus (same text included, overlaps count) is removed. ``spans`` are the maximal
    removed byte ranges [start, end), ``kept`` the other bytes, which need not be valid
    UTF-8. A null text counts as empty. Rows that occur twice are copies of each other;
    extra columns are ignored; an empty table gives an empty result. A null doc_id is a
    value like any other.
    """
    with_key, key, per_text = _with_ranges(docs, length)

    schema = (
        "n_bytes long, n_removed long, n_spans long, "
        "spans array<struct<start: long, end: long>>, kept binary"
    )

    @F.pandas_udf(schema)
    def cut(texts: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.DataFrame:
        rows = []
        for text, low, high in zip(texts, lows, highs):
            data = text.encode() if text is not None else b""
            spans = merge_ranges(low, high, length).tolist()
            edges = [0, *(x for span in spans for x in span), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            pairs = [{"start": a, "end": b} for a, b in spans]
            rows.append((len(data), len(data) - len(kept), len(spans), pairs, kept))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "spans", "kept"])

    joined = with_key.select(*key, "doc_id", "text").join(per_text.hint("merge"), key, "left")
    return joined.select("doc_id", cut("text", "lows", "highs").alias("cut")).select("doc_id", "cut.*")


def op10_suffix_array_dedup(spark, sf_dir):
    found = removed_bytes(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
