"""Vector code compression: product codes by k-means with adaptive distance bounds."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import discard, read, written
from credsieve.llm.negatives import quantised

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Bounds are doubles, so they give way by this share (and this much) before they decide.
MARGIN = 1e-9
#: Part of the uncertain cases that the persisted bounds should settle.
SETTLED = 0.99


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer entries."""
    difference = x[:, None, :] - entries[None, :, :]
    return np.einsum("nkd,nkd->nk", difference, difference)


def _reach(upper):
    """Upper bounds with the margin by which they give way."""
    return upper * (1 + MARGIN) + MARGIN


class Bounds:
    """What is known about one part position of a run of vectors: the entry each is
    assigned to and an upper bound of its distance, its ``b`` next closest entries in
    order of their lower bounds, and one outer bound below the distances to all others."""

    def __init__(self, own, upper, near, lower, outer):
        self.own, self.upper, self.near, self.lower, self.outer = own, upper, near, lower, outer

    @classmethod
    def exact(cls, distances, b):
        """Bounds from the squared distances to all entries; what they hold is exact."""
        order = np.argsort(distances, axis=1, kind="stable")
        root = np.sqrt(np.take_along_axis(distances, order, 1).astype(np.float64))
        n, k = distances.shape
        outer = root[:, b + 1] if k > b + 1 else np.full(n, np.inf)
        return cls(order[:, 0], root[:, 0], order[:, 1 : b + 1], root[:, 1 : b + 1], outer)

    def drift(self, moved):
        """Let the bounds follow entries that moved by the distances ``moved``."""
        self.upper = self.upper + moved[self.own]
        self.lower = self.lower - moved[self.near]
        self.outer = self.outer - moved.max()

    def reassign(self, x, entries, b):
        """Assign all rows of ``x`` to their closest of ``entries``.

        Returns how many of the persisted bounds each row needed: -1 if it was certain, the
        number of entries if it had to be compared with all. A row is certain if
        its upper bound lies below all lower bounds. Else the distance to its entry is
        computed, which may settle it. Else, if the outer bound holds, only the persisted
        entries whose bounds do not are compared; if it does not, all are. Comparisons are
        between integers, ties go to the lower index.
        """
        k, near = len(entries), self.near.shape[1]
        used = np.full(len(x), -1)
        clear = np.column_stack((self.lower, self.outer)) * (1 - MARGIN) - MARGIN
        row = np.flatnonzero((clear <= _reach(self.upper)[:, None]).any(axis=1))
        own = x[row] - entries[self.own[row]]
        exact = np.einsum("nd,nd->n", own, own)
        self.upper[row] = np.sqrt(exact.astype(np.float64))
        used[row] = 0
        open_ = clear[row] <= _reach(self.upper[row])[:, None]
        # The last persisted bound that does not hold is as far as one has to look.
        needed = (open_[:, :near] * np.arange(1, near + 1)).max(axis=1, initial=0)
        beyond = open_[:, near]
        used[row] = np.where(beyond, k, needed)
        some = ~beyond & (needed > 0)
        self._compare(x, entries, row[some], exact[some], open_[some, :near])
        every = row[beyond]
        found = Bounds.exact(squared(x[every], entries), near)
        self.own[every], self.upper[every] = found.own, found.upper
        self.near[every], self.lower[every] = found.near, found.lower
        self.outer[every] = found.outer
        self._keep(b)
        return used

    def _compare(self, x, entries, row, exact, open_):
        """Compare rows with those of their persisted entries whose bounds do not hold, and
        put the persisted entries in order again."""
        ids = np.column_stack((self.own[row], self.near[row]))
        root = np.column_stack((self.upper[row], self.lower[row]))
        whole = np.full(ids.shape, np.iinfo(np.int64).max)
        whole[:, 0] = exact
        at, place = np.nonzero(open_)
        difference = x[row[at]] - entries[ids[at, place + 1]]
        whole[at, place + 1] = np.einsum("nd,nd->n", difference, difference)
        root[at, place + 1] = np.sqrt(whole[at, place + 1].astype(np.float64))
        best = np.lexsort((ids, whole), axis=1)[:, :1]
        # The best goes to the front, the others follow by their bounds.
        value = np.take_along_axis(root, best, 1)
        np.put_along_axis(root, best, -np.inf, 1)
        order = np.argsort(root, axis=1, kind="stable")
        np.put_along_axis(root, best, value, 1)
        ids, root = np.take_along_axis(ids, order, 1), np.take_along_axis(root, order, 1)
        self.own[row], self.upper[row] = ids[:, 0], root[:, 0]
        self.near[row], self.lower[row] = ids[:, 1:], root[:, 1:]

    def _keep(self, b):
        """Persist ``b`` entries from now on; the outer bound takes in what is left out."""
        if b < self.near.shape[1]:
            self.outer = np.minimum(self.outer, self.lower[:, b:].min(axis=1))
            self.near, self.lower = self.near[:, :b], self.lower[:, :b]


def next_b(used: np.ndarray, b: int, entries: int) -> int:
    """Bounds to persist after a round in which uncertain rows needed ``used[i]`` times
    i bounds: the least number that would have settled SETTLED of them, but no fewer
    than an eighth of the entries and no more than now."""
    settled = used[: b + 1].cumsum()
    least = int(np.searchsorted(settled, SETTLED * max(settled[-1], 1)))
    return max(min(b, max(least, 1)), min(b, max(entries // 8, 1)))


# ---- rounds over the table ------------------------------------------------------------


class Codebooks:
    """Entries of all parts: array (part, entry, position within the part)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries

    def after(self, sums, counts):
        """Entries replaced by floor(sum / count); unused ones stay. Sums are Python
        integers, as they may exceed 64 bits."""
        out = self.entries.copy()
        for (part, entry), n in counts.items():
            out[part, entry] = [s // n for s in sums[part, entry]]
        return Codebooks(out)

    def drift(self, before):
        """How far each entry has moved since ``before``, rounded up."""
        move = (self.entries - before.entries).astype(np.float64)
        return np.sqrt((move * move).sum(axis=2)) * (1 + MARGIN)

    def sha256(self):
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _fixed(array: np.ndarray, kind) -> pa.Array:
    """Rows of a matrix as list array."""
    offsets = np.arange(len(array) + 1, dtype=np.int32) * array.shape[1]
    return pa.ListArray.from_arrays(offsets, pa.array(array.ravel(), kind))


def _rows(column, kind) -> np.ndarray:
    """Matrix of a list array whose lists are equally long."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


#: Columns of a state: the vector's integers and, by part, the bounds; ``used`` tells how
#: many persisted bounds the last round needed (-1: none, the case was certain).
BOUNDS = (
    "x array<int>, own array<int>, upper array<double>, near array<int>,"
    " lower array<double>, outer array<double>, used array<int>"
)


def _vectors(column, books) -> np.ndarray:
    """Array (vector, part, position), shorter vectors filled up with zeros."""
    parts, _, size = books.entries.shape
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != parts * size).any():
        out = np.zeros((len(column), parts * size), np.int64)
        out[np.arange(parts * size) < lengths[:, None]] = flat
        flat = out
    return flat.reshape(len(column), parts, size)


def _bounds(batch, b):
    """Bounds of all part positions of a state's batch."""
    own, upper = _rows(batch.column("own"), np.int64), _rows(batch.column("upper"), np.float64)
    outer = _rows(batch.column("outer"), np.float64)
    near, lower = _rows(batch.column("near"), np.int64), _rows(batch.column("lower"), np.float64)
    out, end = [], 0
    for p, n in enumerate(b):
        start, end = end, end + n
        columns = own[:, p], upper[:, p], near[:, start:end], lower[:, start:end], outer[:, p]
        out.append(Bounds(*(c.copy() for c in columns)))
    return out


def _state(batch, x, parts, used):
    columns = {
        "vec_id": batch.column("vec_id"),
        "label": batch.column("label"),
        "x": _fixed(x.reshape(len(x), x.shape[1] * x.shape[2]), pa.int32()),
        "own": _fixed(np.column_stack([p.own for p in parts]), pa.int32()),
        "upper": _fixed(np.column_stack([p.upper for p in parts]), pa.float64()),
        "near": _fixed(np.hstack([p.near for p in parts]), pa.int32()),
        "lower": _fixed(np.hstack([p.lower for p in parts]), pa.float64()),
        "outer": _fixed(np.column_stack([p.outer for p in parts]), pa.float64()),
        "used": _fixed(np.column_stack(used), pa.int32()),
    }
    return pa.RecordBatch.from_pydict(columns)


def _start(books, b):
    """Task that assigns all parts by their distances to all entries."""

    def run(batches):
        for batch in batches:
            x = _vectors(batch.column("x"), books)
            parts = [Bounds.exact(squared(x[:, p], books.entries[p]), n) for p, n in enumerate(b)]
            yield _state(batch, x, parts, [np.full(len(x), -1)] * len(b))

    return run


def _round(books, drift, b, b_next):
    """Task that lets the bounds drift and assigns again."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column("x"), books)
            parts = _bounds(batch, b)
            used = []
            for p, bounds in enumerate(parts):
                bounds.drift(drift[p])
                used.append(bounds.reassign(x[:, p], books.entries[p], b_next[p]))
            yield _state(batch, x, parts, used)

    return run


def _sums(books):
    """Task that adds up the vectors of each entry: (part, entry, position, value), with
    position -1 for their number and entry -1 for how many cases used that many bounds."""
    parts, entries, size = books.entries.shape

    def run(batches):
        for batch in batches:
            x, own = _vectors(batch.column("x"), books), _rows(batch.column("own"), np.int64)
            used = _rows(batch.column("used"), np.int64)
            rows = []
            for p in range(parts if len(x) else 0):
                total = np.zeros((entries, size), np.int64)
                np.add.at(total, own[:, p], x[:, p])
                count = np.bincount(own[:, p], minlength=entries)
                for e in np.flatnonzero(count).tolist():
                    rows.append((p, e, -1, int(count[e])))
                    rows.extend((p, e, k, v) for k, v in enumerate(total[e].tolist()))
                need = np.bincount(used[:, p] + 1)[1:]
                rows.extend((p, -1, k, n) for k, n in enumerate(need.tolist()) if n)
            columns = [pa.array(c) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "position", "value"])

    return run


def _gathered(state, books):
    """(sums, counts, used) of a state: as many numbers as the codebooks hold reach the
    driver, added up in tasks and then by key."""
    parts, entries, size = books.entries.shape
    rows = state.select("x", "own", "used").mapInArrow(
        _sums(books), "part long, entry long, position long, value long"
    )
    total = F.sum(F.col("value").cast("decimal(38,0)")).alias("value")
    sums, counts, used = {}, {}, np.zeros((parts, entries + 1), np.int64)
    for part, entry, position, value in rows.groupBy("part", "entry", "position").agg(total).collect():
        if entry < 0:
            used[part, position] = int(value)
        elif position < 0:
            counts[part, entry] = int(value)
        else:
            sums.setdefault((part, entry), [0] * size)[position] = int(value)
    return sums, counts, used


def _first_entries(kept, parts, entries):
    """Codebooks made of the parts of the ``entries`` smallest vec_ids; of several rows with
    one id the smallest vector. None without rows."""
    ids = kept.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id")
    first = kept.join(F.broadcast(ids.limit(entries)), "vec_id").groupBy("vec_id")
    rows = first.agg(F.min("x").alias("x")).orderBy("vec_id").collect()
    width = kept.agg(F.max(F.size("x"))).first()[0]
    if not rows:
        return None
    size = -(-width // parts)
    out = np.zeros((len(rows), parts * size), np.int64)
    for k, row in enumerate(rows):
        out[k, : len(row.x)] = row.x
    return Codebooks(out.reshape(len(rows), parts, size).transpose(1, 0, 2).copy())


class Trained:
    """Final codebooks, the state assigned to them, and by round and part the numbers of
    persisted bounds and of uncertain cases by how many bounds they needed."""

    def __init__(self, books, state, b, used):
        self.books, self.state, self.b, self.used = books, state, b, used


def train(
    rows: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> Trained | None:
    """Codebooks of the vectors of ``rows`` (vec_id, embedding, label); None without any.

    Each round assigns every part to its nearest entry and replaces each entry by the
    floor of its parts' mean. The state (vectors, assignment and bounds) is written once
    a round, so that a lost executor costs its tasks of one round, and read by the next.
    """
    kept = quantised(
        rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("x"), "label"),
        "x",
        scale,
    ).withColumn("x", F.col("x").cast("array<int>"))
    books = _first_entries(kept, parts, entries)
    if books is None:
        return None
    entries = books.entries.shape[1]
    b = [min(max(entries // 4, 1), entries - 1)] * parts
    label = dict(rows.select("label").dtypes)["label"]
    schema = f"vec_id long, label {label}, {BOUNDS}"
    state = written(kept.mapInArrow(_start(books, b), schema), "codes")
    history = ([b], [])
    for _ in range(rounds):
        sums, counts, used = _gathered(state, books)
        after = books.after(sums, counts)
        b_next = [next_b(used[p], n, entries) if used[p].any() else n for p, n in enumerate(b)]
        task = _round(after, after.drift(books), b, b_next)
        new = written(state.mapInArrow(task, schema), "codes")
        discard(state)
        books, state, b = after, new, b_next
        history[0].append(b)
        history[1].append(used)
    return Trained(books, state, *history)


def compress(rows: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for each row of ``rows`` whose
    vector has no null or non-finite component; ``options`` as for ``train``.

    ``code`` holds the index of each part's entry as two hex digits, ``error`` the squared
    distance to them in integers, ``label_error`` its sum over rows of the same label
    (nulls together). Vectors are cut into equal consecutive parts; shorter vectors than
    the longest, or than a multiple of the parts, count as filled up with zeros.
    Components are integers ``floor(scale * x)`` within 2**27 on either side. With fewer
    vec_ids than entries there are as many entries as vec_ids. Rows that occur twice come
    out twice, a row without vec_id is coded but starts no entry, an empty table gives an
    empty result, extra columns are not read.
    """
    spark = rows.sparkSession
    columns = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    trained = train(rows, **options)
    if trained is None:
        return spark.createDataFrame([], columns)
    books = trained.books
    parts = len(books.entries)

    def run(batches):
        for batch in batches:
            x, own = _vectors(batch.column("x"), books), _rows(batch.column("own"), np.int64)
            if not len(x):
                continue
            difference = x - books.entries[np.arange(parts), own]
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column("vec_id"),
                    "label": batch.column("label"),
                    "code": pa.array(["".join(f"{k:02x}" for k in codes) for codes in own.tolist()]),
                    "error": pa.array((difference * difference).sum(axis=(1, 2))),
                }
            )

    label = dict(rows.select("label").dtypes)["label"]
    state = trained.state.select("vec_id", "label", "x", "own")
    coded = written(
        state.mapInArrow(run, f"vec_id long, label {label}, code string, error long"), "coded"
    )
    discard(trained.state)
    total = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(total, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id",
        "code",
        "error",
        "label_error",
        F.lit(books.sha256()).alias("codebooks_sha256"),
    )


def op13_vector_codes(spark, sf_dir):
    return compress(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
