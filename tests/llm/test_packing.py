"""Tokens and best-fit packing."""

import bisect
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from credsieve.llm import packing, tokens
from credsieve.llm.queries import QUERIES

PATH = public_tokenizers.path(packing.TOKENIZER)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(PATH)


def by_library(exact, text):
    ids = exact.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, "<u4").tobytes()


def test_ids_equal_the_library(exact, monkeypatch):
    encoder = tokens.encoder(PATH)
    assert encoder.fast
    rng = random.Random(1)
    letters = "ab c  \n\t'sdé.,1²\x1c\x85\xa0　中😀_<|endoftext|>ǅʰ-–…"
    texts = ["", " ", "a", "don't  stop\n\n\tnow ", "x" * 3000, "<|endoftext|>", "a<|endoftext|> b"]
    texts += ["".join(rng.choices(letters, k=rng.randrange(30))) for _ in range(3000)]
    texts += [f"a{chr(c)}b {chr(c)}{chr(c)} {chr(c)}1" for c in range(0x2100)]
    assert all(encoder.ids(t) == by_library(exact, t) for t in texts)
    monkeypatch.setattr(tokens, "LONG_TEXT", 40)
    for _ in range(200):
        text = "".join(rng.choices(letters, k=600))
        assert encoder.ids(text) == by_library(exact, text)
    # Another kind of tokenizer has no fast way.
    other = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not other.fast
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert other.ids("Some Text") == by_library(words, "Some Text")


def test_fullest_equals_all_combinations():
    rng = random.Random(2)
    for _ in range(300):
        room = rng.randrange(0, 30)
        counts = {rng.randrange(1, 31): rng.randrange(1, 4) for _ in range(rng.randrange(0, 5))}
        available = sorted(counts.items(), reverse=True)
        sums = [
            sum(n * length for n, (length, _) in zip(ns, available))
            for ns in product(*(range(c + 1) for _, c in available))
        ]
        best = max(s for s in sums if s <= room)
        for slack in (0, 3):
            used = packing.fullest(room, available, slack)
            assert all(n <= counts[length] for length, n in used.items())
            total = sum(length * n for length, n in used.items())
            assert min(best, room - slack) <= total <= room


def fewest(lengths, capacity):
    """The least number of sequences, by trying all assignments."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[k]:
                rest = list(rooms)
                rest.remove(room)
                place(k + 1, [*rest, room - lengths[k]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best[0]


def test_plan_uses_all_pieces_in_few_sequences():
    rng = random.Random(3)
    more = 0
    for _ in range(150):
        lengths = [rng.randrange(1, 21) for _ in range(rng.randrange(0, 9))]
        patterns = packing.plan(Counter(lengths), 20)
        used = Counter()
        for pattern, times in patterns:
            assert sum(length * n for length, n in pattern.items()) <= 20
            for length, n in pattern.items():
                used[length] += n * times
        assert used == Counter(lengths)
        more += sum(times for _, times in patterns) - fewest(lengths, 20)
    assert more <= 1
    # The work follows the lengths, not the pieces.
    many = {length: 10**12 + length for length in range(1, 1025)}
    patterns = packing.plan(many, 1024)
    tokens_ = sum(length * n for length, n in many.items())
    assert sum(times for _, times in patterns) <= 1.0001 * tokens_ / 1024


def test_places_are_without_gaps():
    counts = {7: 5, 5: 9, 3: 11, 1: 2}
    places = packing.Places(packing.plan(counts, 12))
    filled = {}
    for length, n in counts.items():
        at = places.of(np.full(n, length), np.arange(n))
        for sequence, offset in zip(*at):
            filled.setdefault(int(sequence), []).append((int(offset), length))
    for members in filled.values():
        end = 0
        for offset, length in sorted(members):
            assert offset == end
            end += length
        assert end <= 12


def expected_pieces(exact, rows, capacity=1024):
    out = Counter()
    for doc, text in rows:
        ids = np.frombuffer(by_library(exact, text), "<u4").tolist() + [2]
        head = len(ids) % capacity or capacity
        starts = [0, *range(head, len(ids), capacity)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            out[doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    return out


def assert_packed(rows, expected, capacity=1024):
    assert Counter(tuple(r)[:5] for r in rows) == expected
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in sequences.values():
        end = 0
        for offset, length in sorted(members):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def best_fit_decreasing(lengths, capacity):
    """Sequences that the usual rule needs: longest first, each where it fits best."""
    rooms, n = [], 0
    for length in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, length)
        n += k == len(rooms)
        room = capacity if k == len(rooms) else rooms.pop(k)
        bisect.insort(rooms, room - length)
    return n


def test_packing_equals_brute_force(spark, documents, exact, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 5)
    rng = random.Random(4)
    words = [" ".join(rng.choices(["alpha", "beta", "γ", "12", "don't"], k=k)) for k in range(1, 40)]
    rows = [(k, rng.choice(words)) for k in range(200)]
    rows += [(900, None), (901, ""), (None, "no id"), (2**60 + 1, "big id"), (902, "long " * 5000)]
    rows += [(903, "copy"), (903, "copy"), (903, "other")]
    docs = documents(rows, extra="sequence_id")
    packed = packing.pack(docs, capacity=64)
    found = packed.collect()
    n = assert_packed(found, expected_pieces(exact, rows, 64), 64)
    total = sum(r.length for r in found)
    assert n <= best_fit_decreasing([r.length for r in found], 64)
    # The sequences hold the documents' tokens.
    by_doc = {}
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert sum(r.length for r in whole.values()) == total
    for r in found:
        part = whole[r.sequence_id].ids[r.offset : r.offset + r.length]
        by_doc.setdefault((r.doc_id, r.ids_crc32, r.piece), part)
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    assert packing.pack(docs.limit(0)).count() == 0


def test_registered_packing(spark, exact):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op12_best_fit_packing"](spark, SF).collect()
    n = assert_packed(found, expected_pieces(exact, rows))
    assert n <= best_fit_decreasing([r.length for r in found], 1024)
