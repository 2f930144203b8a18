"""Token ids of whole texts by a file of the tokenizers library, each distinct word encoded once.

The vocabulary works word by word: white space only separates. So a text's ids are those of its words in
turn, and words repeat. Words of plain Latin letters and signs go to the library's BPE model in bulk, after the
file's own normalizing and splitting; any other word goes through the library's whole chain.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .shared import ragged

SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
LINES = regex.compile(SPLIT.pattern + r"|\n")
PLAIN = r"^[!-~¡-ÿ]+$"
WORDS_KEPT = 600_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Words:
    """Ids of words, remembered up to WORDS_KEPT words."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            bare = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.kept: dict[str, bytes] = {}
        split = (bare.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        self.known = split == SPLIT.pattern and bare["model"].get("end_of_word_suffix") == "</w>"
        bare |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": [], "post_processor": None}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        last = np.zeros(self.bare.get_vocab_size() + 1, bool)
        last[[i for s, i in self.bare.get_vocab().items() if s.endswith("</w>")]] = True
        self.last = last
        letters = byte_letters()
        self.table = {0x20: " ", 0x0A: "\n"} | {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x21, 0x100)}

    def _plain(self, words: list[str]) -> list[bytes]:
        flat = LINES.findall("\n".join(words).lower() + "\n")
        own = [p for p in flat if p != "\n"]
        lines = [" ".join(own[i : i + 256]) for i in range(0, len(own), 256)]
        ids = np.fromiter(chain.from_iterable(e.ids for e in self.bare.encode_batch_fast("\n".join(lines).translate(self.table).split("\n"), add_special_tokens=False)), np.uint32)
        ends = np.concatenate([[0], np.flatnonzero(self.last[ids]) + 1])
        if len(ends) != len(own) + 1:
            raise ValueError("the vocabulary has no word ends")
        breaks = np.flatnonzero(np.fromiter(map("\n".__eq__, flat), bool, len(flat)))
        cuts = (4 * ends[np.concatenate([[0], breaks - np.arange(len(breaks))])]).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in pairwise(cuts)]

    def _any(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.whole.encode_batch(words, add_special_tokens=False)]

    def of(self, words: pa.Array) -> list[bytes]:
        """The ids of each word as bytes. The first WORDS_KEPT words met are remembered; frequent ones are among them."""
        names = words.to_numpy(zero_copy_only=False).tolist()
        found: list = list(map(self.kept.get, names))
        new = np.array([i for i, x in enumerate(found) if x is None], np.int64)
        some = words.take(pa.array(new))
        plain = pc.and_(pc.match_substring_regex(some, PLAIN), pc.invert(pc.match_substring(some, "<|"))).to_numpy(zero_copy_only=False).astype(bool) & self.known
        for how, chosen in ((self._plain, new[plain].tolist()), (self._any, new[~plain].tolist())):
            if chosen:
                own = [names[i] for i in chosen]
                made = how(own)
                for i, x in zip(chosen, made, strict=True):
                    found[i] = x
                if (room := WORDS_KEPT - len(self.kept)) > 0:
                    self.kept.update(zip(own[:room], made, strict=False))
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: none), one text after another, and each text's number of ids."""
        texts = pc.fill_null(texts, "")
        words = pc.ascii_split_whitespace(texts)
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        found = self.of(coded.dictionary)
        pool = np.frombuffer(b"".join(found), np.uint32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        index = coded.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[index]
        ids = pool[ragged((np.cumsum(sizes) - sizes)[index], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)]
        return ids, np.diff(np.concatenate([[0], ends]))


@lru_cache(maxsize=4)
def words(path: str) -> Words:
    """One for each process and file."""
    return Words(path)


def encode_documents(path: str, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with end_id after each text, and each text's number of ids, that one included."""
    ids, n = words(path).encode(texts)
    ends = np.cumsum(n + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    mask = np.ones(len(out), bool)
    mask[ends - 1] = False
    out[mask], out[~mask] = ids, end_id
    return out, n + 1
