"""Token ids of whole texts by a public tokenizer, chunk by chunk.

The tokenizer drops white space and never lets a token span it, so a text's
ids are those of its white-space-free chunks one after another. Chunks repeat
far more than texts, so each worker remembers a bounded number of them. A new
chunk of Latin letters with or without ASCII punctuation behind it is two
words to the tokenizer, which lower-cases letters; both are remembered too.
New words of letters are encoded many at a time, and the last token of a word
tells its end. Other chunks are encoded by themselves.

Cases: null counts as empty; an empty or blank text has the end id alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from tidewheel.llm.common import kept

END = 2
#: Chunks, and words of them, that a worker remembers.
MEMORY = 120_000
#: Chunks that are encoded as one text.
TOGETHER = 400
#: Bytes of text that are split at once.
PORTION = 4 << 20
WORD_END = "</w>"
#: Letters whose lower case is one letter in any library, and then ASCII punctuation.
PLAIN = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-/:-@\[-`{-~]*)$"


def default_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class Lexicon:
    """Ids by key: key k has the ids pool[starts[k] : starts[k + 1]]."""

    def __init__(self, first: list[int], memory: int):
        self.memory = memory
        self.known: dict[str, int] = {}
        self.pool = np.array(first, dtype=np.uint32)
        self.starts = np.array([0, len(first)], dtype=np.int64)

    def add(self, keys: list[str], ids: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        first = len(self.starts) - 1
        self.known.update(zip(keys, range(first, first + len(keys)), strict=True))
        if keys:
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes))])
            self.pool = np.concatenate([self.pool, *ids])

    def places(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, keys), dtype=np.int64, count=len(keys))

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all places one after another, and how many each has."""
        starts = self.starts[places]
        sizes = self.starts[places + 1] - starts
        after = np.cumsum(sizes)
        at = np.arange(after[-1] if len(after) else 0, dtype=np.int32)  # a portion's ids and the pool are far below 2^31
        at += np.repeat((starts - after + sizes).astype(np.int32), sizes)
        return self.pool[at], sizes

    def trim(self, keys: list[str], count: int) -> None:
        """Forget the latest keys where the lexicon is full; count had been known before."""
        if len(self.known) > self.memory:
            for key in keys:
                del self.known[key]
            self.starts = self.starts[: count + 1]
            self.pool = self.pool[: self.starts[-1]]


class Encoder:
    def __init__(self, path: str, end: int = END, memory: int | None = None, portion: int = PORTION):
        memory, self.portion = MEMORY if memory is None else memory, portion
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.last = np.zeros(self.size, dtype=bool)
        for token, i in vocabulary.items():
            self.last[i] = token.endswith(WORD_END)
        self.chunks = Lexicon([end], memory)  # place 0: the end id
        self.words = Lexicon([], memory)  # place 0: nothing
        self.words.known[""] = 0

    def _exact(self, keys: list[str], into: Lexicon) -> None:
        found = [np.array(x.ids, dtype=np.uint32) for x in self.tokenizer.encode_batch_fast(keys, add_special_tokens=False)]
        into.add(keys, found, [np.array([len(x)]) for x in found])

    def _learn_marks(self, new: list[str]) -> None:
        self._exact(new, self.words)

    def _learn_words(self, new: list[str]) -> None:
        order: list[str] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        odd: list[str] = []
        groups = [new[i : i + TOGETHER] for i in range(0, len(new), TOGETHER)]
        for group, coded in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            got = np.array(coded.ids, dtype=np.uint32)
            ends = np.flatnonzero(self.last[got]) + 1
            if len(ends) == len(group) and ends[-1] == len(got):
                order.extend(group), ids.append(got), sizes.append(np.diff(ends, prepend=0))
            else:
                odd.extend(group)
        self.words.add(order, ids, sizes)
        self._exact(odd, self.words)

    def _learn(self, chunks: pa.Array, new: list[str]) -> None:
        split = pc.extract_regex(chunks, PLAIN)
        fits = split.is_valid()
        plain = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
        fresh: list[str] = []
        count = len(self.words.starts) - 1
        if len(plain):
            pairs = []
            for part, learn in ((pc.utf8_lower(pc.struct_field(split, "word")), self._learn_words), (pc.struct_field(split, "marks"), self._learn_marks)):
                coded = part.filter(fits).dictionary_encode()
                keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
                unseen = [k for k in keys if k not in self.words.known]
                learn(unseen)
                fresh.extend(unseen)
                pairs.append(self.words.places(keys)[coded.indices.to_numpy()])
            ids, sizes = self.words.gather(np.stack(pairs, axis=1).ravel())
            self.chunks.add([new[i] for i in plain.tolist()], [ids], [sizes.reshape(-1, 2).sum(axis=1)])
        if len(plain) < len(new):
            odd = np.delete(np.arange(len(new)), plain)
            self._exact([new[i] for i in odd.tolist()], self.chunks)
        self.words.trim(fresh, count)

    def _portion(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        unique = coded.dictionary.to_numpy(zero_copy_only=False)
        known, count = self.chunks.known.get, len(self.chunks.starts) - 1
        place = np.array([known(c, -1) for c in unique.tolist()], dtype=np.int64)
        unseen = np.flatnonzero(place < 0)
        new = unique[unseen].tolist()
        if new:
            self._learn(coded.dictionary.take(pa.array(unseen)), new)
            place[unseen] = self.chunks.places(new)
        ends = np.cumsum(pc.list_value_length(split).to_numpy())
        ids, sizes = self.chunks.gather(np.insert(place[coded.indices.to_numpy()], ends, 0))
        after = np.cumsum(sizes)[ends + np.arange(len(ends))]
        self.chunks.trim(new, count)
        return ids, np.diff(after, prepend=0)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For portions of a string array: the first row, all their ids (unsigned, 32 bits), and the ids of each row, end id included."""
        low = 0
        while low < len(texts):
            n = 8192
            while n > 1 and _bytes(texts.slice(low, n)) > self.portion:
                n //= 2
            yield low, *self._portion(texts.slice(low, n))
            low += n


def _bytes(texts: pa.Array) -> int:
    return pc.sum(pc.binary_length(texts)).as_py() or 0


def encoder(path: str, end: int = END, memory: int = MEMORY, portion: int = PORTION) -> Encoder:
    """One per worker process; reused by later tasks of the same worker. More memory and larger portions take less time."""
    return kept(("tokens", path, end, memory, portion), lambda: Encoder(path, end, memory, portion))
