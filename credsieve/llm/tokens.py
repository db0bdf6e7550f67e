"""Token ids of whole texts by a public tokenizer's file."""

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: How byte-level vocabularies split text before merging; a fixed pattern, once in full
#: and once for texts whose white space never stands in runs, where it needs no lookahead.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
SPLIT_PLAIN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"

#: Characters that every version of Unicode puts into the same class; other texts take the
#: slower way.
_KNOWN = re.compile("[\t\n\r -~ -ɏ‐-‧]*")
_RUN = re.compile(r"\s\s")
#: Before white space after another character no token crosses, so long texts are cut there.
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
LONG_TEXT = 1 << 16


def _byte_alphabet():
    """The printable characters by which byte-level vocabularies write the 256 bytes:
    a printable byte stands for itself, the others follow from code point 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ranks(spec):
    """bytes -> id of a byte-level vocabulary whose merges are made in the order of their
    ids; None for any other tokenizer."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = (
        spec.get("normalizer") is None
        and split.get("type") == "ByteLevel"
        and split.get("use_regex", True)
        and not split.get("add_prefix_space")
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    )
    if not plain:
        return None
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [model["vocab"].get(token, -1) for token in merged]
    added = {t["content"] for t in spec["added_tokens"]}
    words = [token for token in model["vocab"] if token not in added]
    if ids != sorted(set(ids)) or len(words) != 256 + len(merged):
        return None
    alphabet = _byte_alphabet()
    return {bytes(alphabet[c] for c in token): model["vocab"][token] for token in words}


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit numbers, the same that the
    ``tokenizers`` library gives without special tokens around the text.

    A plain byte-level vocabulary is also loaded into ``tiktoken``, which needs a quarter
    of the time; it gets the texts of characters whose class is beyond doubt. All other
    texts, and all other tokenizers, go to ``tokenizers``, long texts in pieces.
    """

    def __init__(self, path: str):
        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ranks = _ranks(spec)
        self.fast = None
        if ranks:
            added = {t["content"]: t["id"] for t in spec["added_tokens"]}
            self.special = list(added)
            self.fast = [
                tiktoken.Encoding(
                    f"{path}:{k}", pat_str=p, mergeable_ranks=ranks, special_tokens=added
                )
                for k, p in enumerate((SPLIT_PLAIN, SPLIT))
            ]

    def ids(self, text: str) -> bytes:
        known = text.isascii() and text.isprintable() or _KNOWN.fullmatch(text)
        if not self.fast or not known or any(token in text for token in self.special):
            return self._pieces(text)
        way = self.fast[1 if _RUN.search(text) else 0]
        return way.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def _pieces(self, text):
        pieces = [text]
        if len(text) > LONG_TEXT:
            pieces, start = [], 0
            while start < len(text):
                cut = _CUT.search(text, start + LONG_TEXT)
                end = cut.start() if cut else len(text)
                pieces.append(text[start:end])
                start = end
        found = [self.exact.encode(p, add_special_tokens=False).ids for p in pieces]
        return b"".join(np.array(ids, "<u4").tobytes() for ids in found)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once per Python process."""
    return Encoder(path)
