"""Best-fit packing: sequences filled by minimum bin slack."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credsieve.llm.common import fresh, read, written
from credsieve.llm.tokens import encoder

CAPACITY = 1024
END = 2
TOKENIZER = "byte_bpe_50k.json"
#: Tokens that a full sequence may lack, tried in turn.
SLACKS = (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)
#: Pieces of one length that one task ranks at a time; more are split.
RANKED = 1 << 14
#: Bytes of text and ids that a task gathers before it hands rows on.
BATCH_BYTES = 1 << 24

PIECE = "piece int, start long, length long, ids_crc32 long"


# ---- pieces -------------------------------------------------------------------------


def cut_points(n: int, capacity: int) -> np.ndarray:
    """Starts of the pieces of ``n`` tokens: whole pieces at the end, the rest first."""
    head = (n - 1) % capacity + 1
    return np.concatenate(([0], np.arange(head, n, capacity)))


def pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    end: int = END,
    keep_ids: bool = True,
) -> DataFrame:
    """Tokens of every whole text and the id ``end``, cut into pieces of ``capacity``
    tokens of which the first may be shorter: doc_id, piece, start, length, ids_crc32 and,
    with ``keep_ids``, ids (binary, little-endian unsigned 32-bit numbers). A null text
    counts as empty and has the piece (end). Rows that occur twice come out twice.
    """
    tail = np.array([end], "<u4").tobytes()
    schema = f"doc_id long, {PIECE}" + (", ids binary" if keep_ids else "")

    def rows_of(batch, at, cuts, crcs, parts):
        """Record batch of the pieces of the texts at ``at``."""
        starts, ends = (np.concatenate(c) for c in zip(*cuts))
        number = np.concatenate([np.arange(len(c[0])) for c in cuts])
        columns = {
            "doc_id": batch.column(0).take(pa.array(np.repeat(at, [len(c[0]) for c in cuts]))),
            "piece": pa.array(number, pa.int32()),
            "start": pa.array(starts, pa.int64()),
            "length": pa.array(ends - starts, pa.int64()),
            "ids_crc32": pa.array(crcs, pa.int64()),
        }
        if keep_ids:
            columns["ids"] = pa.array(parts, pa.binary())
        return pa.RecordBatch.from_pydict(columns)

    def run(batches):
        own = encoder(tokenizer)
        for batch in batches:
            at, cuts, crcs, parts, size = [], [], [], [], 0
            for k, text in enumerate(batch.column(1)):
                ids = own.ids(text.as_py() or "") + tail
                starts = cut_points(len(ids) // 4, capacity)
                ends = np.append(starts[1:], len(ids) // 4)
                own_parts = [ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                at.append(k)
                cuts.append((starts, ends))
                crcs.extend(map(zlib.crc32, own_parts))
                if keep_ids:
                    parts.extend(own_parts)
                size += len(ids)
                if size > BATCH_BYTES:
                    yield rows_of(batch, at, cuts, crcs, parts)
                    at, cuts, crcs, parts, size = [], [], [], [], 0
            if at:
                yield rows_of(batch, at, cuts, crcs, parts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


# ---- the plan: which lengths share a sequence -----------------------------------------


def fullest(room: int, available: list[tuple[int, int]], slack: int = 0) -> dict[int, int]:
    """Length -> number of pieces of the fullest combination that fits into ``room``, of
    the (length, count) pairs ``available``, longest first.

    Dynamic programming over sets of reachable sums, which are the bits of one integer; a
    count is taken apart into 1, 2, 4, ... pieces. Of equally full combinations the one of
    longer pieces wins, as short ones fill what is left later; one that leaves no more
    than ``slack`` counts as full.
    """
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    enough = max(room - slack, 0)
    for length, count in available:
        left, lot = min(count, room // length), 1
        while left and not reach >> enough:
            taken = min(lot, left)
            steps.append((length, taken, reach))
            reach = (reach | reach << (length * taken)) & mask
            left -= taken
            lot *= 2
        if reach >> enough:
            break
    total, used = reach.bit_length() - 1, {}
    for length, taken, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + taken
            total -= length * taken
    return used


def minimum_slack(counts: dict[int, int], capacity: int, slack: int = 0) -> list:
    """Patterns (length -> pieces in a sequence, number of such sequences) that use up all
    pieces of the given counts by length.

    Each sequence starts with the longest piece left and is filled with the fullest
    combination of the others, which are then removed. The same choice is made again as
    long as the pieces last, so it is removed as often at once: the work grows with the
    different lengths, not with the pieces.
    """
    left = {length: n for length, n in sorted(counts.items(), reverse=True) if n}
    patterns = []
    while left:
        longest = next(iter(left))
        left[longest] -= 1
        room = capacity - longest
        others = [(length, n) for length, n in left.items() if n and length <= room]
        left[longest] += 1
        used = fullest(room, others, slack)
        used[longest] = used.get(longest, 0) + 1
        times = min(left[length] // n for length, n in used.items())
        patterns.append((dict(sorted(used.items(), reverse=True)), times))
        for length, n in used.items():
            left[length] -= n * times
            if not left[length]:
                del left[length]
    return patterns


def plan(counts: dict[int, int], capacity: int) -> list:
    """The patterns of the fewest sequences that minimum bin slack finds, plain or with one
    of some small slacks allowed: filling early sequences to the last token uses up the
    short pieces that the last sequences would need."""
    least = -(-sum(length * n for length, n in counts.items()) // capacity)
    best, fewest = [], None
    for slack in SLACKS:
        patterns = minimum_slack(counts, capacity, slack)
        sequences = sum(times for _, times in patterns)
        if fewest is None or sequences < fewest:
            best, fewest = patterns, sequences
        if fewest <= least:
            break
    return best


class Places:
    """Where the r-th piece of a length goes, for all lengths of a plan."""

    def __init__(self, patterns):
        first, taken, rows = 0, {}, []
        for used, times in patterns:
            offset = 0
            for length, n in used.items():
                start = taken.get(length, 0)
                rows.append((length, start, n, first, offset))
                taken[length] = start + n * times
                offset += length * n
            first += times
        # Ranks of one length follow each other, lengths too.
        rows.sort()
        self.length, self.start, self.per, self.first, self.offset = (
            np.array(column, np.int64) for column in (zip(*rows) if rows else [[]] * 5)
        )

    def of(self, length, rank):
        """(sequence, offset) of pieces by their length and rank among equals."""
        key = np.rec.fromarrays([length, rank])
        at = np.searchsorted(np.rec.fromarrays([self.length, self.start]), key, "right") - 1
        turn, slot = np.divmod(rank - self.start[at], self.per[at])
        return self.first[at] + turn, self.offset[at] + slot * length


# ---- ranks and places --------------------------------------------------------------


def ranked(rows: DataFrame, order: list[str], counts: dict[int, int], name: str) -> DataFrame:
    """``rows`` with the rank (from 0) of each among those of its length. The rows of a
    frequent length are split by a hash into parts that are ranked alone; a part's ranks
    start where the parts before it end. Rows equal in all of ``order`` may change places.
    """
    spark = rows.sparkSession
    part, parts = fresh(rows, "part"), fresh(rows, "parts")
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(min(RANKED, sum(counts.values()) // tasks), 1)
    split = [(length, -(-n // most)) for length, n in counts.items()]
    split = spark.createDataFrame(split, f"length long, {parts} long")
    hashed = F.pmod(F.xxhash64(*order), F.col(parts))
    rows = rows.join(F.broadcast(split), "length").withColumn(part, hashed).drop(parts)
    before = Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    size, first = fresh(rows, "size"), fresh(rows, "first")
    sizes = rows.groupBy("length", part).agg(F.count("*").alias(size))
    sizes = sizes.withColumn(first, F.coalesce(F.sum(size).over(before), F.lit(0))).drop(size)
    within = F.row_number().over(Window.partitionBy("length", part).orderBy(*order)) - 1
    own = rows.withColumn(name, within).join(sizes, ["length", part])
    return own.withColumn(name, F.col(name) + F.col(first)).drop(part, first)


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end: int = END,
    keep_ids: bool = True,
) -> DataFrame:
    """All texts of ``docs`` as pieces in sequences of ``capacity`` tokens at most, as few
    as minimum bin slack finds: the columns of ``pieces`` and sequence_id, offset.

    ``tokenizer`` is the path of a tokenizer's file, the same on all machines. Only the
    number of pieces of each length (``capacity`` numbers at most) and the plan made of
    them pass through the driver. The pieces of a sequence follow each other without gaps
    from offset 0. Null texts are empty texts, null doc_ids are kept, rows that occur twice
    are packed twice, texts of any length are read whole, an empty table gives an empty
    result, extra columns are not read.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    cut = written(pieces(docs, path, capacity, end, keep_ids), "pieces")
    counts = dict(cut.groupBy("length").count().collect())
    places = Places(plan(counts, capacity))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            sequence, offset = places.of(length, rank)
            columns = {n: batch.column(n) for n in key}
            columns["sequence_id"], columns["offset"] = pa.array(sequence), pa.array(offset)
            yield pa.RecordBatch.from_pydict(columns)

    rows = ranked(cut.drop("ids"), ["doc_id", "piece", "start", "ids_crc32"], counts, "rank")
    schema = f"doc_id long, {PIECE}, sequence_id long, offset long"
    placed = rows.select(*key, "rank").mapInArrow(place, schema)
    if not keep_ids:
        return placed
    return _with_ids(placed, cut, key)


def _with_ids(placed, cut, key):
    """``placed`` with the ids of each piece. Pieces equal in all of ``key`` hold the same
    tokens, so one of their ids serves them all."""
    ids = cut.select(*key, "ids").groupBy(*key).agg(F.min("ids").alias("ids"))
    other = ids.select(*(F.col(c).alias(f"_{c}") for c in key), "ids")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    met = same[0]
    for condition in same[1:]:
        met = met & condition
    return placed.join(other, met).drop(*(f"_{c}" for c in key))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, doc_ids, ids) of a packing that kept its ids: the tokens of
    each sequence as array of int, in order."""
    whole = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"),
    )

    def join(frames):
        for frame in frames:
            joined = [b"".join(bytes(p["ids"]) for p in parts) for parts in frame["parts"]]
            yield frame[["sequence_id", "length"]].assign(
                doc_ids=[[p["doc_id"] for p in parts] for parts in frame["parts"]],
                ids=[np.frombuffer(ids, "<u4").astype("i4") for ids in joined],
            )

    schema = "sequence_id long, length long, doc_ids array<long>, ids array<int>"
    return whole.mapInPandas(join, schema)


def op12_best_fit_packing(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"), keep_ids=False)
