"""SimHash near-duplicate detection: pigeonhole blocks joined, Hamming distance verified."""

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import components, keyed, read, written

BITS = 64
SHINGLE = 3
MAX_BITS = 2
#: Blocks beyond the allowed distance: with ``MAX_BITS + SPARE`` blocks, ``SPARE`` of
#: them agree in any linked pair, and their bits together are the join key.
SPARE = 3
#: Distinct fingerprints under one block key up to which pairs are compared directly.
#: Larger keys go through ``_ball_edges``, which gives the same links.
PAIRWISE = 64
_CHUNK = 8192


def text_fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of one text as an unsigned number; 0 if it has no word.

    ASCII letters are lower-cased; words are runs of other bytes than space and
    \\t \\n \\v \\f \\r; every occurrence of a shingle votes.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        pairs = zip(starts[at : min(at + _CHUNK, n)].tolist(), last[at : at + _CHUNK].tolist())
        h = np.array([digest(joined[a:b], 42) for a, b in pairs], ">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep=("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row and ``fp``, the fingerprint as a signed long."""
    keep = list(keep)

    def run(frames):
        for frame in frames:
            fp = [
                text_fingerprint(t.encode() if t is not None else b"", shingle)
                for t in frame["text"]
            ]
            out = frame[keep].copy()
            out["fp"] = np.array(fp, np.uint64).view(np.int64)
            yield out

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, "text").mapInPandas(run, ", ".join([*kinds, "fp long"]))


def _block_masks(max_bits: int):
    count = max_bits + SPARE
    cuts = [BITS * k // count for k in range(count + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(kept) for kept in combinations(blocks, SPARE)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints ``fp`` at ``max_bits`` or
    fewer differing bits, directly or over a third one that is linked to both.

    Every fingerprint is listed under each choice of ``SPARE`` whole blocks; two
    within the distance agree on at least one choice. Keys with few fingerprints
    are joined pair by pair and verified.
    """
    masks = _block_masks(max_bits)
    keys = F.array(
        *[
            F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
            for k, m in enumerate(masks)
        ]
    )
    listed = distinct.select("fp", F.inline(keys))
    sizes = listed.groupBy("choice", "key").agg(F.count("*").alias("size")).where("size > 1")
    listed = written(listed.join(sizes, ["choice", "key"]), "simhash-blocks")
    small = listed.where(F.col("size") <= PAIRWISE)
    pairs = (
        small.select("choice", "key", F.col("fp").alias("u"))
        .join(small.select("choice", "key", F.col("fp").alias("v")), ["choice", "key"])
        .where("u < v")
        .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)
        .select("u", "v")
    )
    crowded = listed.where(F.col("size") > PAIRWISE).select("fp").distinct()
    return pairs.unionByName(_ball_edges(crowded, max_bits)).distinct()


def _ball_edges(crowded: DataFrame, max_bits: int) -> DataFrame:
    """Links between fingerprints of crowded blocks, in linear size.

    Two fingerprints differ in at most ``2 * r`` bits if and only if some value lies
    within ``r`` bits of both. All values within ``r`` bits of each fingerprint are
    emitted, and all fingerprints around one value are linked to the smallest of
    them. An odd bound adds the value's direct neighbours by ``r + 1`` on one side,
    so links are verified again here.
    """
    reach = (max_bits + 1) // 2
    flips = [0] + [
        sum(1 << b for b in bits) for k in range(1, reach + 1) for bits in combinations(range(BITS), k)
    ]
    around = crowded.select(
        "fp",
        F.explode(
            F.transform(
                F.array(*[F.lit(_signed(x)) for x in flips]), lambda x: x.bitwiseXOR(F.col("fp"))
            )
        ).alias("value"),
    )
    if max_bits % 2 == 0:
        low = around.groupBy("value").agg(F.min("fp").alias("v"))
        return (
            around.join(low, "value")
            .where("fp <> v")
            .select(F.greatest("fp", "v").alias("u"), F.least("fp", "v").alias("v"))
        )
    # At most 1 + 64 values lie within one bit, so these groups are small by nature.
    other = around.select("value", F.col("fp").alias("v"))
    return (
        around.join(other, "value")
        .where("fp < v")
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= max_bits)
        .select(F.col("v").alias("u"), F.col("fp").alias("v"))
    )


def fingerprint_components(marked: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, component) of every fingerprint in ``marked``; the component is a fingerprint."""
    nodes = written(marked.select("fp").distinct(), "simhash-nodes")
    found = components(links(nodes, max_bits))
    return nodes.join(found, nodes["fp"] == found["node"], "left").select(
        "fp", F.coalesce("component", "fp").alias("component")
    )


def simhash_groups(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Documents are linked when their fingerprints differ in at most ``max_bits``
    bits; ``component_id`` is the smallest doc_id reachable, itself included (null
    if every doc_id of the group is null). Equal fingerprints are one node, so
    groups of copies cost one row. A null or blank text has fingerprint zero. Rows
    that occur twice come out twice; other columns are ignored. An empty table gives
    an empty result.
    """
    marked = written(fingerprints(docs, shingle), "simhash-fingerprints")
    lowest = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    joined = lowest.join(fingerprint_components(marked, max_bits), "fp")
    by_component = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    by_fp = written(joined.join(by_component, "component").select("fp", "component_id"), "simhash-ids")
    return marked.join(by_fp, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def keep_one_of_each_group(
    docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """``docs`` without near-duplicates: of each group the row with the smallest doc_id
    stays (nulls last; among equal ids the one with the smallest key); of rows equal
    in doc_id and text one stays. Columns are those of ``docs``, whatever their names;
    null and blank texts form one group. An empty table stays empty."""
    with_key, key = keyed(docs)
    marked = written(fingerprints(with_key, shingle, ["doc_id", *key]), "simhash-fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", *key)).alias("first")
    by_fp = marked.groupBy("fp").agg(first)
    kept = (
        by_fp.join(fingerprint_components(marked, max_bits), "fp")
        .groupBy("component")
        .agg(F.min("first").alias("first"))
        .select(*[F.col("first")[k].alias(k) for k in key])
    )
    return with_key.dropDuplicates(key).join(kept, key, "left_semi").select(*docs.columns)


def op7_simhash_near_dedup(spark, sf_dir):
    return simhash_groups(read(spark, sf_dir, "documents"))
