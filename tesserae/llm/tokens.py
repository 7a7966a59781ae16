"""Exact token ids at the speed of a dictionary: each word of a text is encoded once a worker.

The tokenizer lower-cases and composes a text, cuts it at white space and by its pattern, and encodes each piece on its
own, so the ids of a text are those of its words between ASCII white space, one after the other. Known words are a
dictionary, their ids one flat array, and a text's ids are gathered from it. Texts that hold a special token's string
go through the tokenizer whole. tests/llm compares both ways.
"""

from __future__ import annotations

import os
import re
import sys
import types
import unicodedata
from array import array
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _pattern() -> re.Pattern:
    """The tokenizer's pattern over lower-cased text below U+0250."""
    kinds = {"L": "", "N": ""}
    for c in map(chr, range(0x250)):
        if (k := unicodedata.category(c)[0]) in kinds:
            kinds[k] += c
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['L']}]+|[{kinds['N']}]|[^ \t-\r\x85\xa0{kinds['L']}{kinds['N']}]+")


_PIECES = _pattern().findall
#: What is not lower-cased and composed letter by letter.
_BEYOND = re.compile("[İɐ-\U0010ffff]").search
#: Words that a worker remembers, besides those of the texts at hand. When they are too many, those that were met again stay.
KNOWN_WORDS = 1_000_000
#: Words whose ids are gathered at once.
GATHERED = 100_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """The ids of texts as little-endian bytes of `dtype`."""

    def __init__(self, path: str, dtype: str = "<u2"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.dtype = Tokenizer.from_file(path), np.dtype(dtype)
        if self.tokenizer.get_vocab_size(True) > 1 << (8 * self.dtype.itemsize):
            self.dtype = np.dtype("<u4")
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.last = np.zeros(1 << (8 * min(self.dtype.itemsize, 3)), bool)
        #: For pieces that are lower-cased and cut already: the tokenizer's own bytes of each.
        self.blanks = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last[[i for w, i in self.tokenizer.get_vocab(True).items() if w.endswith("</w>")]] = True

        self.limit = KNOWN_WORDS
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.flat, self.starts, self.sizes, self.again = np.empty(0, self.dtype), np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, bool)

    def _shrink(self) -> None:
        """Keeps the words that were met again since they were learnt or kept."""
        keep, n = np.flatnonzero(self.again), self.sizes[self.again].astype(np.int64)
        ends = np.cumsum(n)
        self.flat = self.flat[np.repeat(self.starts[keep] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        self.words = {w: k for k, w in enumerate(compress(self.words, self.again.tolist()))}
        self.starts, self.sizes, self.again = (ends - n).astype(np.int32), n.astype(np.int32), np.zeros(len(keep), bool)

    @classmethod
    def of_worker(cls, path: str, dtype: str = "<u2", known: int = KNOWN_WORDS) -> Encoder:
        """The one that this Python worker has used before, if any; it remembers up to `known` words."""
        kept = sys.modules.setdefault("_tesserae_kept", types.ModuleType("_tesserae_kept"))
        if getattr(kept, "key", None) != (path, dtype):
            kept.key, kept.encoder = (path, dtype), cls(path, dtype)
        kept.encoder.limit = known
        return kept.encoder

    @staticmethod
    def leave_worker() -> None:
        """Frees the encoder that this Python worker has kept, for a stage that encodes nothing."""
        sys.modules.pop("_tesserae_kept", None)

    def _bytes(self, words: list[str]) -> list[bytes]:
        return [array("H" if self.dtype.itemsize == 2 else "I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after the other, and how many each has. Words below U+0250 are lower-cased and cut here, and each
        distinct piece is encoded once: many in one text, told apart by the end-of-word mark of their last token."""
        codes: dict[str, int] = {}
        alone, of, n = [], array("i"), array("i")
        for w in words:
            if _BEYOND(w) or not (found := (w.lower(),) if w.isalpha() else _PIECES(w.lower())):
                alone.append(w)
                of.append(-len(alone))
                n.append(1)
            else:
                of.extend([codes.setdefault(x, len(codes)) for x in found])
                n.append(len(found))
        distinct = list(codes)
        normalizer, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        try:
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = None, self.blanks
            raw = np.frombuffer(b"".join(self._bytes([" ".join(distinct[k : k + 64]) for k in range(0, len(distinct), 64)])), self.dtype)
        finally:
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = normalizer, cut
        ends = np.flatnonzero(self.last[raw]) + 1
        one = self._bytes(words if len(ends) != len(distinct) else alone)
        sizes = np.array([len(x) for x in one], np.int64) // self.dtype.itemsize
        if len(ends) != len(distinct):
            return np.frombuffer(b"".join(one), self.dtype), sizes
        # words encoded alone stand behind the pieces, and are theirs
        raw = np.concatenate([raw, np.frombuffer(b"".join(one), self.dtype)])
        sizes = np.concatenate([np.diff(ends, prepend=0), sizes])
        first = np.cumsum(sizes) - sizes
        at, n = np.frombuffer(of, np.int32).astype(np.int64), np.frombuffer(n, np.int32)
        at = np.where(at < 0, len(distinct) - 1 - at, at)
        size = sizes[at]
        upto = np.cumsum(size)
        ids = raw[np.repeat(first[at] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]
        return ids, np.diff(upto[np.cumsum(n) - 1], prepend=0) if len(n) else np.zeros(0, np.int64)

    def _known(self, words: list[str]) -> np.ndarray:
        """The places of words among the known ones, -1 for new ones."""
        return np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))

    def _places(self, words: pa.Array) -> np.ndarray:
        """The places of distinct words among the known ones; new ones are learnt."""
        words = words.to_pylist()
        place = self._known(words)
        unknown = int((place < 0).sum())
        if self.words and len(self.words) + unknown > self.limit:
            self._shrink()
            if len(self.words) + unknown > self.limit:
                self._forget()
            place = self._known(words)
        self.again[place[place >= 0]] = True
        if len(at := np.flatnonzero(place < 0)):
            new = [words[k] for k in at.tolist()]
            ids, sizes = self._ids(new)
            place[at] = np.arange(len(new)) + len(self.words)
            self.words.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, (np.cumsum(sizes) - sizes + len(self.flat)).astype(np.int32)])
            self.sizes, self.flat = np.concatenate([self.sizes, sizes.astype(np.int32)]), np.concatenate([self.flat, ids])
            self.again = np.concatenate([self.again, np.zeros(len(new), bool)])
        return place

    def encode(self, texts: pa.Array | list[str | None], end: int | None = None) -> list[bytes]:
        """The ids of each text, and `end` after them. Each distinct word of `texts` is looked up once."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        tail = b"" if end is None else np.array([end], self.dtype).tobytes()
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        at = self._places(words.dictionary)[words.indices.to_numpy()]
        # one range of `flat` for each word; some texts at a time, as the places of all ids are many times the texts
        offsets, out = np.asarray(split.offsets) - split.offsets[0].as_py(), []
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + GATHERED, "right")) - 1)
            some = at[offsets[first] : offsets[last]]
            n = self.sizes[some]
            ends = np.concatenate([[0], np.cumsum(n)])
            raw = self.flat[np.repeat(self.starts[some] - ends[:-1], n) + np.arange(ends[-1])]
            bounds = ends[offsets[first : last + 1] - offsets[first]]
            out += [raw[x:y].tobytes() + tail for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            first = last
        for t in self.special:
            for i in np.flatnonzero(pc.fill_null(pc.match_substring(texts, t), False)):
                out[i] = self._bytes([texts[i].as_py()])[0] + tail
        return out
