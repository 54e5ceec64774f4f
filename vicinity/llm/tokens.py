"""Token ids of a public word-level BPE vocabulary, by cached white-space chunks.

The vocabulary lower-cases, drops white space and never lets a token span it, so a text's ids are those of its chunks
one after another. A worker keeps the ids of the chunks that it has met (so many at most; the rest are encoded
each time), and encodes unknown letter-only chunks together: the vocabulary marks the last token of each word.
"""

from __future__ import annotations

import os

import numpy as np
from tokenizers import Tokenizer

#: Chunks and, without case and punctuation, words that a worker keeps, and the longest that it keeps, in bytes.
CACHE, CORES, TAILS, LONGEST = 200_000, 400_000, 10_000, 48
#: What may follow letters in a chunk and be encoded by itself: no apostrophe, as contractions are tokens with letters.
PUNCTUATION = b'!"#$%&()*+,-./:;<=>?@[\\]^_{|}~'
ID = np.dtype("<u4")

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _letters(word: str) -> bool:
    """Whether a word is of letters only, in lower case too: the dot of a dotted capital I becomes a mark of its own."""
    return word.isalpha() and word.lower().isalpha()


class ChunkEncoder:
    """Encodes UTF-8 text to little-endian 32-bit ids. One a worker: see ``of``."""

    _made: dict[str, ChunkEncoder] = {}

    @classmethod
    def of(cls, path: str) -> ChunkEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str, cache: int = CACHE, cores: int = CORES):
        self.tokenizer, self.room, self.core_room = Tokenizer.from_file(path), cache, cores
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.chunks: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {}

    def _one_by_one(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(x.ids, ID).tobytes() for x in found]

    def _together(self, words: list[bytes]) -> list[bytes]:
        """Ids of letter-only words, encoded as one text and cut at the tokens that end a word."""
        ids = np.array(self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False).ids, ID)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return self._one_by_one(words)
        whole, cuts = ids.tobytes(), [0, *(ends * 4).tolist()]
        return [whole[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, new: set[bytes]) -> dict[bytes, bytes]:
        """Ids of unknown chunks. Punctuation after letters is a token of its own, or several."""
        found, letters, others, parts, cores = {}, {}, {}, [], self.cores
        for chunk in new:
            low = chunk.lower()
            core = low.rstrip(PUNCTUATION)
            ids = cores.get(core)
            if ids is None and core not in letters:
                if not (core.isalpha() or (not core.isascii() and _letters(core.decode()))):
                    others[chunk] = b""
                    continue
                letters[core] = b""
            if len(core) == len(low):
                if ids is None:
                    parts.append((chunk, core, b""))
                else:
                    found[chunk] = ids
            else:
                tail = low[len(core) :]
                if tail not in self.tails:
                    others[tail] = b""
                parts.append((chunk, core, tail))
        if letters:
            letters = dict(zip(letters, self._together(list(letters))))
        if others:
            others = dict(zip(others, self._one_by_one(list(others))))
            found |= others
        for chunk, core, tail in parts:
            ids = letters[core] if core in letters else cores[core]
            if tail:
                ids += self.tails[tail] if tail in self.tails else others[tail]
            found[chunk] = ids
        self._keep(cores, letters, self.core_room)
        self._keep(self.tails, {tail: others[tail] for _, _, tail in parts if tail in others}, TAILS)
        return found

    @staticmethod
    def _keep(where: dict[bytes, bytes], found: dict[bytes, bytes], room: int) -> None:
        """Add to a cache while there is room."""
        if len(where) + len(found) <= room:
            where.update((k, v) for k, v in found.items() if len(k) <= LONGEST)

    def encode(self, text: bytes) -> bytes:
        """The ids of the whole text, 4 bytes each."""
        chunks = text.split()
        ids = list(map(self.chunks.get, chunks))
        if None in ids:
            missing = [i for i, x in enumerate(ids) if x is None]
            found = self._learn({chunks[i] for i in missing})
            for i in missing:
                ids[i] = found[chunks[i]]
            self._keep(self.chunks, found, self.room)
        return b"".join(ids)
