"""Training and asking forests of many shallow trees, in time that hardly grows with the trees.

Training: a row is known to a tree by the bins of its features only. Rows with equal bins and
label are counted once, and a tree draws how often each such group is in its bootstrap
sample: the draws of ``n`` rows, Poisson(1) each, add up to one of Poisson(n). No row is
copied or kept per tree. Asking: a row finds the bin of each feature among all thresholds of
the forest; the leaf that a tree ends in is the first that no bin has ruled out.
"""

import hashlib
import math
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.functions.common import compute_once
from credsieve.scratch import new_path, remove, written

#: Groups of rows that a task works on at once, and parts that the trees are summed up in.
CHUNK, PARTS = 4096, 32
#: Rows that the bins are found from, as Spark ML has it, and rows asked at once.
BIN_ROWS, ASKED = 10_000, 1024
#: Leaves of a tree up to which it is asked by bins, and classes, as many as Spark ML takes.
MOST_LEAVES, MOST_CLASSES = 64, 100


class Layout:
    """Where the features of a vector come from: the numeric columns one each, then for each
    category column one per value, one for unknown values and one that stays empty."""

    def __init__(self, numeric, categories: dict):
        self.numeric, self.categories = list(numeric), {c: list(v) for c, v in categories.items()}
        self.first, at = [], len(self.numeric)
        for values in self.categories.values():
            self.first.append(at)
            at += len(values) + 2
        self.size = at

    @property
    def columns(self):
        return [*self.numeric, *self.categories]

    def source(self, feature):
        """(number of the category column, number of the value) of a feature that is no numeric."""
        k = max(i for i, first in enumerate(self.first) if first <= feature)
        return k, feature - self.first[k]

    def numbers(self, k, texts: pd.Series) -> np.ndarray:
        """Numbers of the values of category column ``k``; unknown ones come behind the last."""
        values = list(self.categories.values())[k]
        known = {v: i for i, v in enumerate(values)}
        return texts.map(known).fillna(len(values)).to_numpy("int64")


def bins_of(values: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` - 1 thresholds of a sample: half-way between all neighbours if they are
    few enough, else about equally many values apart, as Spark ML puts them."""
    met, counts = np.unique(values, return_counts=True)
    between = (met[:-1] + met[1:]) / 2
    if len(between) < most:
        return between
    stride = counts.sum() / most
    thresholds, below, target = [], counts[0], stride
    for i in range(1, len(met)):
        before, below = below, below + counts[i]
        if abs(before - target) < abs(below - target):
            thresholds.append(between[i - 1])
            target += stride
    return np.array(thresholds)


def _checked(rows: DataFrame, layout: Layout) -> DataFrame:
    """The columns that a forest learns from; rows without a value are refused."""
    numbers = [F.col(c).cast("double").alias(c) for c in layout.numeric]
    rows = rows.select(*numbers, *layout.categories, F.col("Label").cast("double").alias("Label"))
    bad = [F.col(c).isNull() | F.isnan(c) for c in [*layout.numeric, "Label"]]
    wrong = F.greatest(*bad, F.col("Label") < 0, F.col("Label") != F.floor("Label"), F.lit(False))
    return rows.withColumn(
        "Label", F.when(wrong, F.raise_error(F.lit("a training row lacks a feature or a label"))).otherwise(F.col("Label"))
    )


def _grouped(rows: DataFrame, layout: Layout, thresholds) -> DataFrame:
    """Rows with equal bins and label counted, in chunks: one row each, as bytes."""
    sizes = [len(t) + 1 for t in thresholds]
    widths = [len(v) + 2 for v in layout.categories.values()]

    def binned(batches):
        for batch in batches:
            table = batch.to_pandas()
            numbers = np.zeros(len(table), "int64")
            for c, t, size in zip(layout.numeric, thresholds, sizes):
                numbers = numbers * size + np.searchsorted(t, table[c].to_numpy())
            others = table["Label"].to_numpy().astype("int64")
            for k, c in enumerate(layout.categories):
                others = others * widths[k] + layout.numbers(k, table[c])
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(others)], ["numbers", "others"])

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([c.to_numpy(zero_copy_only=False).tobytes()]) for c in batch.columns], batch.schema.names
            )

    def in_chunks(batches):
        for batch in batches:
            yield from packed(batch.slice(i, CHUNK) for i in range(0, batch.num_rows, CHUNK))

    keys = rows.mapInArrow(binned, "numbers bigint, others bigint")
    groups = keys.groupBy("numbers", "others").agg(F.count("*").alias("n"))
    groups = groups.sortWithinPartitions("numbers", "others")
    return groups.mapInArrow(in_chunks, "numbers binary, others binary, n binary")


def _codes(layout, thresholds, numbers, others):
    """Bins of the numeric features, numbers of the categories, and label of each group."""
    codes = []
    for t in reversed(thresholds):
        numbers, code = np.divmod(numbers, len(t) + 1)
        codes.insert(0, code)
    kinds = []
    for values in reversed(list(layout.categories.values())):
        others, kind = np.divmod(others, len(values) + 2)
        kinds.insert(0, kind)
    return codes, kinds, others


def _summed(chunks, layout, thresholds, classes, forest, seed):
    """Per part of the trees: class counts per bin of the open nodes' features, in one array."""
    bins = [len(t) + 1 for t in thresholds] + [2] * (layout.size - len(thresholds))
    sums = [
        [np.zeros(sum(bins[f] for f in own) * classes) for own in tree["open"].values()] for tree in forest
    ]
    for numbers, others, counts in chunks:
        mark = int.from_bytes(hashlib.md5(numbers + others).digest()[:8], "big")
        counts = np.frombuffer(counts, "int64")
        codes, kinds, labels = _codes(
            layout, thresholds, np.frombuffer(numbers, "int64"), np.frombuffer(others, "int64")
        )

        def code(feature):
            if feature < len(codes):
                return codes[feature]
            k, value = layout.source(feature)
            return (kinds[k] == value).astype("int64")

        for t, tree in enumerate(forest):
            draws = np.random.default_rng([seed, t, mark]).poisson(counts)
            waiting = [(1, np.flatnonzero(draws))]
            for_open = dict(zip(tree["open"], sums[t]))
            while waiting:
                node, at = waiting.pop()
                if node in for_open:
                    weights, own, start = draws[at].astype("float64"), labels[at], 0
                    for feature in tree["open"][node]:
                        size = bins[feature] * classes
                        cells = code(feature)[at] * classes + own
                        for_open[node][start : start + size] += np.bincount(cells, weights, size)
                        start += size
                elif node in tree["splits"]:
                    feature, last, _ = tree["splits"][node]
                    left = code(feature)[at] <= last
                    waiting += [(2 * node, at[left]), (2 * node + 1, at[~left])]
    return sums


def _gini(counts):
    """Impurity along the last axis, and how many there are."""
    total = counts.sum(-1)
    shares = counts / np.maximum(total, 1)[..., None]
    return np.where(total > 0, 1 - (shares**2).sum(-1), 0.0), total


def best_split(cells: np.ndarray, features, bins, classes):
    """(gain, feature, last bin that goes left, counts left, counts right) of the first best
    split of a node, None if none leaves a row on either side; and the counts of the node."""
    best, start, whole = None, 0, None
    for feature in features:
        size = bins[feature] * classes
        own = cells[start : start + size].reshape(-1, classes)
        start += size
        left = own.cumsum(0)
        whole = left[-1]
        left = left[:-1]
        right = whole - left
        (impure, n), (impure_left, n_left), (impure_right, n_right) = map(_gini, (whole, left, right))
        if not len(left) or n == 0:
            continue
        gain = impure - impure_left * n_left / n - impure_right * n_right / n
        gain[(n_left < 1) | (n_right < 1)] = -1.0
        k = int(gain.argmax())
        if gain[k] >= 0 and (best is None or gain[k] > best[0]):
            best = (float(gain[k]), feature, k, left[k], right[k])
    return best, whole


def fit(rows: DataFrame, layout: Layout, classifier) -> RandomForestClassificationModel:
    """The forest that ``classifier`` asks for: its trees, depth, bins, seed, bootstrap samples
    and features per node. One pass over the rows and one over their groups per level."""
    spark = rows.sparkSession
    trees, depth = classifier.getNumTrees(), classifier.getMaxDepth()
    most, seed = classifier.getMaxBins(), classifier.getSeed() & (2**63 - 1)
    rows = _checked(rows, layout)
    size = rows.agg(F.count("*").alias("n"), F.max("Label").alias("last")).first()
    classes = int(size.last) + 1
    if classes > MOST_CLASSES:
        raise ValueError(f"labels go up to {classes - 1}, beyond {MOST_CLASSES} classes")
    share = min(1.0, max(most * most, BIN_ROWS) / size.n)
    sample = rows.select(*layout.numeric) if share == 1 else rows.select(*layout.numeric).sample(share, seed)
    met = sample.toPandas()
    thresholds = [bins_of(met[c].to_numpy(), min(most, size.n)) for c in layout.numeric]
    bins = [len(t) + 1 for t in thresholds] + [2] * (layout.size - len(thresholds))
    chunks = written(_grouped(rows, layout, thresholds), "groups")
    tasks = min(chunks.count(), 4 * spark.sparkContext.defaultParallelism) or 1
    chosen = layout.size if trees == 1 else math.ceil(math.sqrt(layout.size))

    def features_of(t, node):
        found = np.random.default_rng([seed, t, node, 1]).choice(layout.size, chosen, replace=False)
        return [int(f) for f in found]

    forest = [{"open": {1: features_of(t, 1)}, "splits": {}, "nodes": {}} for t in range(trees)]
    for level in range(max(depth, 1)):
        plan = [{"open": t["open"], "splits": t["splits"]} for t in forest]

        def summed(batches):
            found = (
                [row[c].as_py() for c in range(3)]
                for batch in batches
                for row in zip(*batch.columns)
            )
            sums = _summed(found, layout, thresholds, classes, plan, seed)
            parts = [sums[p::PARTS] for p in range(PARTS)]
            blobs = [pickle.dumps([np.concatenate(t) if t else np.zeros(0) for t in part]) for part in parts]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(blobs, pa.binary())], ["part", "sums"])

        def decided(frame):
            part = int(frame["part"].iloc[0])
            total = None
            for blob in frame["sums"]:
                own = pickle.loads(blob)
                total = own if total is None else [a + b for a, b in zip(total, own)]
            out = []
            for t, cells in zip(range(part, len(plan), PARTS), total):
                start = 0
                for node, features in plan[t]["open"].items():
                    width = sum(bins[f] for f in features) * classes
                    out.append((t, node, *best_split(cells[start : start + width], features, bins, classes)))
                    start += width
            return pd.DataFrame({"decided": [pickle.dumps(out)]})

        sums = chunks.repartition(tasks).mapInArrow(summed, "part int, sums binary")
        for (blob,) in sums.groupBy("part").applyInPandas(decided, "decided binary").collect():
            for t, node, best, whole in pickle.loads(blob):
                forest[t]["nodes"][node] = whole
                if best is not None and best[0] > 0 and depth > 0:
                    gain, feature, last, left, right = best
                    forest[t]["splits"][node] = (feature, last, gain)
                    forest[t]["nodes"] |= {2 * node: left, 2 * node + 1: right}
        for t, tree in enumerate(forest):
            below = [k for n in tree["open"] if n in tree["splits"] for k in (2 * n, 2 * n + 1)]
            still = [k for k in below if _gini(tree["nodes"][k])[0] > 0]
            tree["open"] = {k: features_of(t, k) for k in still}
        if level + 1 == depth or not any(tree["open"] for tree in forest):
            break
    return _model(spark, classifier, forest, layout, thresholds, classes)


def _nodes(tree, layout, thresholds) -> list:
    """A tree as Spark ML stores it, (number, prediction, impurity, class counts, rows, gain,
    left, right, split) of each node; two leaves that say the same are one, as there."""

    def below(node):
        counts = tree["nodes"][node]
        own = (float(np.argmax(counts)), float(_gini(counts)[0]), counts.tolist(), int(counts.sum()))
        if node not in tree["splits"]:
            return own, None
        left, right = below(2 * node), below(2 * node + 1)
        if left[1] is None and right[1] is None and left[0][0] == right[0][0]:
            return own, None
        return own, (left, right, tree["splits"][node])

    rows = []

    def listed(node):
        own, split = node
        number = len(rows)
        rows.append(None)
        if split is None:
            rows[number] = (number, *own, -1.0, -1, -1, (-1, [], -1))
            return number
        left, right, (feature, last, gain) = split
        if feature < len(thresholds):
            test = (feature, [float(thresholds[feature][last])], -1)
        else:
            test = (feature, [0.0], 2)
        rows[number] = (number, *own, gain, listed(left), listed(right), test)
        return number

    listed(below(1))
    return rows


def _model(spark, classifier, forest, layout, thresholds, classes) -> RandomForestClassificationModel:
    """A forest as Spark ML holds it. Its nodes are given to Spark in the form in which Spark
    stores them, as a call per node would take half a minute."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    tree_model = jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel
    calculator = jvm.org.apache.spark.mllib.tree.impurity.GiniCalculator(gateway.new_array(jvm.double, classes), 0)
    root = jvm.org.apache.spark.ml.tree.LeafNode(0.0, 0.0, calculator)
    trees = gateway.new_array(tree_model, len(forest))
    for i in range(len(forest)):
        trees[i] = tree_model(root, layout.size, classes)
    package = jvm.org.apache.spark.ml.classification
    model = package.RandomForestClassificationModel(classifier.uid, trees, layout.size, classes)
    path = new_path(spark, "forest")
    classifier._copyValues(RandomForestClassificationModel(model)).write().save(path)
    rows = [(t, node) for t, tree in enumerate(forest) for node in _nodes(tree, layout, thresholds)]
    schema = spark.read.parquet(f"{path}/data").schema
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
    made = RandomForestClassificationModel.load(path)
    remove(spark, path)
    return made


class Asked:
    """A forest in the form in which it is asked, for layouts as ``Layout`` has them."""

    def __init__(self, layout: Layout, rows, classes):
        """``rows``: (tree, node, left, right, feature, [threshold or left categories],
        number of categories, class counts) of all nodes, as Spark ML stores them."""
        self.layout, trees = layout, {}
        for row in rows:
            trees.setdefault(row[0], {})[row[1]] = row
        tests, leaves = [], []
        for t in sorted(trees):
            own = []

            def walk(node):
                """First and last leaf below a node, numbered from left to right."""
                _, _, left, right, feature, values, arity, counts = trees[t][node]
                if left < 0:
                    own.append(counts)
                    return len(own) - 1, len(own) - 1
                first, last = walk(left)
                tests.append((len(leaves), feature, values, arity, first, last))
                return first, walk(right)[1]

            walk(0)
            leaves.append(own)
        self.most = max(map(len, leaves))
        if self.most > MOST_LEAVES:
            return
        bits = next(b for b in (8, 16, 32, 64) if self.most <= b)
        kind, every = np.dtype(f"uint{bits}"), (1 << bits) - 1

        def ruled_out(first, last):
            return kind.type(every & ~(((1 << (last - first + 1)) - 1) << first))

        # Numeric: row b of a table holds, per tree, what b thresholds below the value leave.
        self.thresholds, self.tables = [], []
        for feature in range(len(layout.numeric)):
            own = [x for x in tests if x[1] == feature]
            thresholds = np.unique([x[2][0] for x in own])
            table = np.full((len(thresholds) + 1, len(leaves)), every, kind)
            for t, _, values, _, first, last in own:
                table[np.searchsorted(thresholds, values[0]) + 1 :, t] &= ruled_out(first, last)
            self.thresholds.append(thresholds)
            self.tables.append(table)
        # Categories: row v holds what is left if the column has its v-th value.
        for k, values in enumerate(layout.categories.values()):
            table = np.full((len(values) + 2, len(leaves)), every, kind)
            for t, feature, left, arity, first, last in tests:
                if feature >= len(layout.numeric) and layout.source(feature)[0] == k:
                    value = layout.source(feature)[1]
                    goes_left = [x in left if arity > 0 else x <= left[0] for x in (0.0, 1.0)]
                    is_value = np.arange(len(table)) == value
                    wrong = ~np.where(is_value, goes_left[1], goes_left[0])
                    table[wrong, t] &= ruled_out(first, last)
            self.tables.append(table)
        # Shares of the classes in each leaf, as a tree votes; of trees with few leaves by the
        # leaves that are left, else by the first of them.
        self.by_rest = bits == 8
        self.width = 1 << bits if self.by_rest else self.most
        self.votes = np.zeros((len(leaves), classes, self.width))
        for t, own in enumerate(leaves):
            shares = [[c / (sum(counts) or 1.0) for c in counts] for counts in own]
            for i in range(self.width):
                leaf = (i & -i).bit_length() - 1 if self.by_rest else i
                if 0 <= leaf < len(own):
                    self.votes[t, :, i] = shares[leaf]

    def first_leaf(self, left: np.ndarray) -> np.ndarray:
        """The number of the lowest bit: the logarithm of a power of two is exact."""
        return np.log2((left & (~left + left.dtype.type(1))).astype("float64")).astype("int64")

    def predictions(self, table: pd.DataFrame) -> np.ndarray:
        """The class that most votes add up to, the first of equals, per row."""
        bins = [
            np.searchsorted(t, table[c].to_numpy("float64"))
            for c, t in zip(self.layout.numeric, self.thresholds)
        ]
        bins += [self.layout.numbers(k, table[c]) for k, c in enumerate(self.layout.categories)]
        said = np.empty(len(table))
        for at in range(0, len(table), ASKED):
            part = slice(at, at + ASKED)
            left = self.tables[0][bins[0][part]]
            for own, numbers in zip(self.tables[1:], bins[1:]):
                left &= own[numbers[part]]
            leaf = np.ascontiguousarray((left if self.by_rest else self.first_leaf(left)).T)
            # Added tree by tree, like Spark ML, so ties are the same.
            total = np.zeros((self.votes.shape[1], leaf.shape[1]))
            for own, at_leaf in zip(self.votes, leaf):
                total += own.take(at_leaf, axis=1)
            said[part] = np.argmax(total, axis=0)
        return said


def asked(forest: RandomForestClassificationModel, layout: Layout, spark) -> Asked:
    """``forest`` as it is asked; its nodes are read as Spark ML stores them."""
    path = new_path(spark, "nodes")
    forest.write().save(path)
    n = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", n.id, n.leftChild, n.rightChild, n.split.featureIndex,
        n.split.leftCategoriesOrThreshold, n.split.numCategories, n.impurityStats,
    )
    nodes = [tuple(row) for row in rows.collect()]
    remove(spark, path)
    return Asked(layout, nodes, forest.numClasses)


def predicted(df: DataFrame, found: Asked) -> DataFrame:
    """``df`` with ``prediction``; as with Spark ML a null or NaN among the numbers fails."""
    layout = found.layout
    held = df.sparkSession.sparkContext.broadcast(found)
    columns = [F.col(c).cast("double") for c in layout.numeric] + [F.col(c) for c in layout.categories]

    @F.pandas_udf("double")
    def prediction(*values: pd.Series) -> pd.Series:
        table = pd.concat(values, axis=1, keys=layout.columns)
        if table[layout.numeric].isna().to_numpy().any():
            raise ValueError("a row lacks a feature")
        return pd.Series(held.value.predictions(table))

    # Behind a generator no later filter asks a second time.
    rows = df.withColumn("_said", prediction(*columns))
    return compute_once(rows, df.columns, prediction=F.col("_said"))
