"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

A first pass over the documents counts in how many each seed (two neighbouring words) of
the test items stands. A second one joins passages to items by each item's rarest seeds,
as many as no copy that counts can do without, and aligns the passages that share enough.
The items of a block are a table of bounded size, which the tasks probe where the texts
are, so no text is moved.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credsieve.llm.common import NOT_ALNUM, Words, batches, read

#: Words of a seed.
SEED_WORDS = 2
MATCH, MISMATCH, GAP = 1, -1, -1
#: Alignment score over the item's score against itself.
THRESHOLD = 0.5
#: Words of test items that one pass over the documents handles; larger benchmarks
#: take several passes.
BLOCK_WORDS = 2_000_000
#: Part of the seeds that every alignment holds which a passage must share to be aligned.
SHARED = 0.25
#: Meetings of seeds and items that a task looks at at a time.
MEETINGS = 1 << 21


def normal(text) -> bytes:
    return text.lower().encode() if text is not None else b""


def text_words(texts) -> Words:
    """Lower-cased words; ASCII punctuation and blanks separate."""
    return Words(texts, NOT_ALNUM)


def needed_score(words: int) -> int:
    """Least score of an alignment that counts, for an item of so many words."""
    return math.ceil(THRESHOLD * MATCH * words)


def kept_seeds(words: int) -> int:
    """Seeds of an item of so many words that every alignment that counts holds unchanged.

    An alignment with m matched words and e replaced, inserted or dropped ones scores m - e.
    The e edits cut the matched words into e + 1 runs at most, which hold m - (e + 1) pairs
    of neighbours, one less than the score.
    """
    return needed_score(words) - 1


def required_seeds(words: int) -> int:
    """Of the seeds that are looked for, those that a passage must share to be aligned."""
    return max(1, int(SHARED * kept_seeds(words)))


class Items:
    """Test items as word hashes, and their seeds in sorted order. Of bounded size.

    Not all seeds of an item are looked for. As ``kept_seeds`` of them stand unchanged in
    every copy that counts, all but ``required_seeds`` of as many can be left out, and still
    every copy holds the required number of the others. Left out are those that the most
    documents hold, so that seeds of everyday words meet no items, and no copy is lost.
    """

    def __init__(self, ids, texts):
        words = text_words([normal(t) for t in texts]) if len(texts) else text_words([b""])
        self.ids = list(ids)
        self.words = [words.hash[a:b] for a, b in zip(words.first, words.first[1:])][: len(ids)]
        self.required = np.array([required_seeds(len(w)) for w in self.words], np.int64)
        seeds, at = words.grams(SEED_WORDS)
        self.keys, key_of = np.unique(seeds, return_inverse=True)
        item = words.doc[at]
        # Items under three words have no seed that every copy must hold.
        long = np.array([len(w) >= 3 for w in self.words], bool)[item] if len(item) else np.zeros(0, bool)
        self._uses = key_of[long], item[long], at[long] - words.first[item[long]]
        self._sort(np.ones(long.sum(), bool))

    def _sort(self, chosen):
        """Uses sorted by key, so that the uses of a key are one slice."""
        key_of, item, at = (x[chosen] for x in self._uses)
        order = np.argsort(key_of, kind="stable")
        self.item, self.at = item[order], at[order]
        self.first = np.searchsorted(key_of[order], np.arange(len(self.keys) + 1))

    def choose_rare(self, frequency: np.ndarray):
        """Look for the rarest seeds only, given the number of documents that hold each key."""
        key_of, item, at = self._uses
        common_first = np.lexsort((at, -frequency[key_of], item)) if len(key_of) else key_of
        rank = np.empty(len(key_of), np.int64)
        start = np.searchsorted(item[common_first], item[common_first])
        rank[common_first] = np.arange(len(key_of)) - start
        spare = np.array([kept_seeds(len(w)) for w in self.words], np.int64) - self.required
        self._sort(rank >= spare[item] if len(key_of) else np.zeros(0, bool))

    def hits(self, words: Words):
        """(position in ``keys``, first word) of all n-grams of ``words`` that are seeds."""
        grams, at = words.grams(SEED_WORDS)
        if not len(self.keys) or not len(grams):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        found = self.keys[place] == grams
        return place[found], at[found]

    def frequency(self, words: Words) -> np.ndarray:
        """Number of texts of ``words`` that hold each key."""
        key, at = self.hits(words)
        once = np.unique(words.doc[at] * len(self.keys) + key)
        return np.bincount(once % max(len(self.keys), 1), minlength=len(self.keys))

    def _meetings(self, words):
        """(text, item, start) of the meetings of looked-for seeds with the items that hold
        them, ``start`` being where the item would begin; in parts of bounded size. All
        meetings of a text and an item are in one part."""
        key, at = self.hits(words)
        uses = self.first[key + 1] - self.first[key]
        key, at, uses = key[uses > 0], at[uses > 0], uses[uses > 0]
        text = words.doc[at]
        total = np.cumsum(uses)
        begin = 0
        while begin < len(key):
            # Whole texts up to the bound; a text beyond it is taken item by item.
            limit = total[begin] - uses[begin] + MEETINGS
            end = np.searchsorted(total, limit, "right")
            end = np.searchsorted(text, text[end]) if end < len(key) else len(key)
            end = end if end > begin else np.searchsorted(text, text[begin], "right")
            own = slice(begin, end)
            parts = -(-int(uses[own].sum()) // MEETINGS)
            for part in range(parts):
                yield self._met(words, key[own], at[own], uses[own], part, parts)
            begin = end

    def _met(self, words, key, at, uses, part, parts):
        found = []
        step = max(1, len(key) // parts)
        for k in range(0, len(key), step):
            n = uses[k : k + step]
            use = np.repeat(self.first[key[k : k + step]], n)
            use += np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = np.repeat(at[k : k + step], n)
            mine = self.item[use] % parts == part
            use, place = use[mine], place[mine]
            text = words.doc[place]
            found.append((text, self.item[use], place - words.first[text] - self.at[use]))
        return [np.concatenate(c) for c in zip(*found)]

    def _passages(self, words):
        """(text, item, start) of the passages that hold enough seeds of an item: where the
        first of them puts the item's beginning. The starts of the seeds of one alignment
        differ by its gaps, which are no more than the item's reach."""
        reach = np.array([_reach(len(w)) for w in self.words], np.int64)
        for text, item, start in self._meetings(words):
            order = np.lexsort((start, item, text))
            text, item, start = text[order], item[order], start[order]
            last = np.arange(len(text)) + self.required[item] - 1
            inside = last < len(text)
            end = np.minimum(last, len(text) - 1)
            enough = inside & (text[end] == text) & (item[end] == item) & (start[end] - start <= reach[item])
            yield from zip(text[enough].tolist(), item[enough].tolist(), start[enough].tolist())

    def matches(self, words: Words):
        """(text, item, score, first word, last word) of every alignment in ``words``
        that reaches the threshold; the best one per text and item."""
        best: dict = {}
        previous = None
        for t, i, s in self._passages(words):
            mine, own = self.words[i], words.hash[words.first[t] : words.first[t + 1]]
            reach = _reach(len(mine))
            if previous and previous[:2] == (t, i) and s - previous[2] <= reach:
                continue  # inside the window of the last seed but for its far end
            previous = (t, i, s)
            low, high = max(0, s - reach), min(len(own), s + len(mine) + 2 * reach)
            window = own[low:high]
            needed = THRESHOLD * MATCH * len(mine)
            # No alignment scores more than the item's words that the window holds.
            if MATCH * np.isin(mine, window).sum() < needed:
                continue
            score, last = align(mine, window)
            if score < needed:
                continue
            _, length = align(mine[::-1], window[last::-1])
            found = (score / (MATCH * len(mine)), low + last - length, low + last)
            if (t, i) not in best or found[0] > best[t, i][0]:
                best[t, i] = found
        return [(t, self.ids[i], *found) for (t, i), found in best.items()]


def _reach(words: int) -> int:
    """Gaps beyond this cost more than the threshold allows, for an item of so many words."""
    return words // 2 + 1


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score of two word sequences and the window's word where the
    first such alignment ends. Rows are computed whole: a gap along the row is a running
    maximum."""
    column = np.arange(len(window) + 1)
    row = np.zeros(len(window) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        score = np.where(window == word, MATCH, MISMATCH)
        now = np.zeros_like(row)
        now[1:] = np.maximum(np.maximum(row[:-1] + score, row[1:] + GAP), 0)
        row = np.maximum.accumulate(now - GAP * column) + GAP * column
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top - 1
    return best, end


def _blocks(benchmark: DataFrame):
    """The benchmark in blocks of bounded size, each as ``Items``."""
    words = F.size(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]+"))
    total = benchmark.agg(F.sum(words)).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_WORDS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        rows = benchmark.where(block == k).select("item_id", "text").distinct()
        frame = rows.orderBy("item_id", "text").toPandas()
        yield Items(frame["item_id"], list(frame["text"]))


def _frequency(docs: DataFrame, sent) -> np.ndarray:
    """Documents that hold each seed of the broadcast ``Items``; tasks add up their rows."""

    def run(frames):
        total = np.zeros(len(sent.value.keys), np.int64)
        for frame in frames:
            for _, texts in batches([normal(t) for t in frame["text"]]):
                total += sent.value.frequency(text_words(texts))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"key": at, "n": total[at]})

    counted = docs.select("text").mapInPandas(run, "key long, n long")
    out = np.zeros(len(sent.value.keys), np.int64)
    for key, n in counted.groupBy("key").agg(F.sum("n")).collect():
        out[key] = n
    return out


def _prepared(docs: DataFrame, benchmark: DataFrame):
    """Broadcast ``Items`` of each block, with the seeds that are rare in ``docs``."""
    context = docs.sparkSession.sparkContext
    for items in _blocks(benchmark):
        if len(items.keys):
            sent = context.broadcast(items)
            items.choose_rare(_frequency(docs, sent))
            sent.unpersist()
        yield context.broadcast(items)


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word), one row for each row of ``docs``
    and test item whose best alignment scores ``THRESHOLD`` or more.

    The score is that of the best local alignment over the item's own length in words,
    1 for a whole copy; the words are those of the document where it lies. The whole of
    every text is searched. Null and blank texts match nothing, nor do items of fewer
    than three words. Repeated rows of ``docs`` repeat their pairs; equal
    rows of the benchmark count once; extra columns are ignored; without documents or
    items the result is empty.
    """
    kinds = [docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType]
    schema = (
        f"doc_id {kinds[0].simpleString()}, item_id {kinds[1].simpleString()}, "
        "score double, first_word long, last_word long"
    )
    found = None
    for sent in _prepared(docs, benchmark):

        def run(frames, sent=sent):
            for frame in frames:
                for first, texts in batches([normal(t) for t in frame["text"]]):
                    rows = sent.value.matches(text_words(texts))
                    if rows:
                        text, item, score, start, end = zip(*rows)
                        ids = frame["doc_id"].iloc[[first + t for t in text]]
                        yield pd.DataFrame(
                            {
                                "doc_id": ids.to_numpy(),
                                "item_id": item,
                                "score": score,
                                "first_word": start,
                                "last_word": end,
                            }
                        )

        part = docs.select("doc_id", "text").mapInPandas(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def _is_clean(sent, text):
    """Column: no item of the broadcast ``sent`` aligns with the text."""

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        out = np.ones(len(texts), bool)
        for first, part in batches([normal(t) for t in texts]):
            for match in sent.value.matches(text_words(part)):
                out[first + match[0]] = False
        return pd.Series(out)

    return clean(text)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` without a contaminated passage, with all their columns."""
    for sent in list(_prepared(docs, benchmark)):
        docs = docs.where(_is_clean(sent, F.col("text")))
    return docs


def op9_benchmark_decontamination(spark, sf_dir):
    return contaminated_pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
