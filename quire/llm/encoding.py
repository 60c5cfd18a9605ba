"""Text to ids of a public tokenizer, with the tokenizers library, for whole columns.

The tokenizer splits at white space before it merges, so the ids of a text are those of its chunks between blanks and line
feeds. A column's chunks are numbered (Arrow's dictionary encoding), a chunk is encoded when a worker first meets it, and the ids are
gathered by number from a pool that the worker keeps: the library sees every distinct word, not every word. Letters and the ASCII marks after them (no
apostrophe, whose contractions reach over both) are separate to the tokenizer, so they are also cached apart.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept, lower_ascii

_WORD = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")
_PER_CALL = 256
ENTRIES = 800_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str, cache_entries: int = ENTRIES) -> ChunkEncoder:
    """One encoder a Python worker; it forgets its chunks when it holds more than cache_entries."""
    return kept(("encoder", path, cache_entries), lambda: ChunkEncoder(path, cache_entries))


class ChunkEncoder:
    """Encodes for tokenizers that lower-case, normalise to NFC, split at white space and mark word ends with </w>."""

    def __init__(self, path: str, cache_entries: int = ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = cache_entries
        self._forget()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        self.pool, self.at, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Cache the ids of words that are one run of letters each: many in a call, cut at the pieces that end a word."""
        joined = [words[i : i + _PER_CALL] for i in range(0, len(words), _PER_CALL)]
        found = self.tokenizer.encode_batch_fast([" ".join(group) for group in joined], add_special_tokens=False)
        for group, one in zip(joined, found, strict=True):
            ids = np.array(one.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(group):
                for word in group:
                    self.words[word] = self._plain(word)
                continue
            raw, at = ids.tobytes(), 0
            for word, cut in zip(group, (cuts * 4).tolist(), strict=True):
                self.words[word], at = raw[at:cut], cut

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks that are not known yet."""
        parts, new = [], set()
        for chunk in chunks:
            match = _WORD.fullmatch(chunk)
            if match and (word := match[1]).isalpha() and (word.isascii() or unicodedata.is_normalized("NFC", word)):
                word = lower_ascii(word) if word.isascii() else word
                parts.append((word, match[2]))
                if word not in self.words:
                    new.add(word)
            else:
                parts.append((chunk, None))
        if new:
            self._learn(sorted(new))
        out = []
        for word, tail in parts:
            if tail is None:
                out.append(self._plain(word))
            else:
                if tail not in self.tails:
                    self.tails[tail] = self._plain(tail)
                out.append(self.words[word] + self.tails[tail])
        return out

    def _slots(self, chunks: list[str]) -> np.ndarray:
        """A number for each chunk; self.at and self.sizes say where its ids stand in self.pool."""
        if len(self.known) > self.limit:
            self._forget()
        slots = [self.known.get(c, -1) for c in chunks]
        new = [c for c, k in zip(chunks, slots, strict=True) if k < 0]
        if new:
            ids = self._encoded(new)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            held = len(self.pool)
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u4")])
            self.at = np.concatenate([self.at, held + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            slots = [self.known[c] for c in chunks]
        return np.array(slots, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the number of each text's ids. Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        flat = lists.flatten().dictionary_encode()
        slots = self._slots(flat.dictionary.to_pylist())
        pick = slots[flat.indices.to_numpy(zero_copy_only=False)] if len(slots) else np.zeros(0, np.int64)
        pool, at, sizes = self.pool, self.at, self.sizes
        counts = sizes[pick]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        gathered = pool[np.arange(total) + np.repeat(at[pick] - ends + counts, counts)] if total else np.zeros(0, "<u4")
        cuts = lists.offsets.to_numpy().astype(np.int64)
        cuts -= cuts[0]
        before = np.concatenate([[0], ends])
        return gathered, before[cuts[1:]] - before[cuts[:-1]]
