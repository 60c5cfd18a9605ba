"""Token counts of a unigram tokenizer without building its tokens: best score and number of pieces only.

An Aho-Corasick automaton of the vocabulary lists all pieces in a word; a left-to-right pass keeps, for each place, the
best score of a segmentation that ends there and its number of pieces. Tie rules are those of the tokenizers library's
Unigram model: of equally good pieces that end at a place the one that starts first (the longest) stays; a character with
no piece of its own costs the smallest score less 10; unknown characters side by side are one piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import kept, text_slices



def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file's ordinary pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    own = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in own]


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], cache_entries: int = 300_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece and piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), float(score)))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.unknown = min((score for _, score in vocabulary), default=0.0) - 10.0
        self.limit, self.cache = cache_entries, {}

    def count(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation of one word (with its word mark)."""
        n = len(word)
        starts: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        if len(self.automaton):
            for end, (size, score) in self.automaton.iter(word):
                starts[end + 1 - size].append((size, score))
        best, pieces, unknown = [None] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here, single = best[i], False
            for size, score in starts[i]:
                single |= size == 1
                if best[i + size] is None or score + here > best[i + size]:
                    best[i + size], pieces[i + size], unknown[i + size] = score + here, pieces[i] + 1, False
            if not single and (best[i + 1] is None or self.unknown + here > best[i + 1]):
                best[i + 1], pieces[i + 1], unknown[i + 1] = self.unknown + here, pieces[i] + (not unknown[i]), True
        return pieces[n], best[n]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and score of each text: every distinct word is segmented once, then looked up by number."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        for mark in "\t\n\v\f\r":
            texts = pc.replace_substring(texts, mark, " ")
        lists = pc.split_pattern(texts, " ")
        flat = lists.flatten().dictionary_encode()
        if len(self.cache) > self.limit:
            self.cache.clear()
        found = []
        for word in flat.dictionary.to_pylist():
            got = self.cache.get(word)
            if got is None:
                got = self.cache[word] = self.count("▁" + word) if word else (0, 0.0)
            found.append(got)
        pick = flat.indices.to_numpy(zero_copy_only=False)
        cuts = lists.offsets.to_numpy().astype(np.int64)
        cuts -= cuts[0]
        out = []
        for kind, values in ((np.int64, [x[0] for x in found]), (np.float64, [x[1] for x in found])):
            before = np.concatenate([[0], np.cumsum(np.array(values, kind)[pick])])
            out.append(before[cuts[1:]] - before[cuts[:-1]])
        return out[0], out[1]


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens and score for each row of docs(doc_id, text), over whole texts.

    Words are runs without white space, each with a word mark before it. Null and empty texts have 0 tokens and score 0;
    repeated rows give a row each; columns other than doc_id and text are not read.
    """
    path = vocabulary or default_vocabulary()

    def counts(batches):
        model = kept(("unigram", path), lambda: UnigramCounter(read_vocabulary(path)))
        for batch in batches:
            for piece in text_slices(batch, "text"):
                n, score = model.column(piece["text"])
                yield pa.RecordBatch.from_arrays([piece["doc_id"].cast(pa.int64()), pa.array(n), pa.array(score)], names=["doc_id", "n_tokens", "score"])

    return docs.select("doc_id", "text").mapInArrow(counts, "doc_id long, n_tokens long, score double")
