"""Token ids of whole texts for a tokenizer that never joins text across white space.

Such a tokenizer gives each stretch between white space the same ids wherever it stands, so
a batch encodes its distinct stretches once and gathers all ids with NumPy. Stretches go
through the library unchanged; special strings and rare scripts are its business.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT_WORDS = 500_000
KEPT_PIECES = 300_000
SLICE_BYTES = 8 << 20

# Stretches of Latin letters below U+0250, whose case folding and composition are one to one.
PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")
LETTERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u024f"
NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{LETTERS}{NUMBERS}]+")


class WordIds:
    """Encodes Arrow arrays of texts for ``word_bpe_49k.json`` and files of its make.

    The ids of up to ``KEPT_WORDS`` words are kept per worker. Words beyond that are encoded
    anew in each batch, so memory is bounded and ids never depend on the cache. Plain Latin
    words are cut into pieces here, as the file's own pattern does, and each distinct piece
    is given to the file's model; any other word goes through the whole library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # Byte-level models spell each byte of a piece as one character of this alphabet.
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelt = {chr(i): "".join(s for s, _ in level.pre_tokenize_str(chr(i))) for i in range(0xA1, 0x250)}
        self.pieces: dict[str, list[int]] = {}
        self.known: dict[str, int] = {}
        self.starts = np.zeros(0, np.int32)
        self.sizes = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _piece(self, piece: str) -> list[int]:
        found = self.pieces.get(piece)
        if found is None:
            spelt = piece if piece.isascii() else "".join(self.spelt.get(c, c) for c in piece)
            found = [t.id for t in self.model.tokenize(spelt)]
            if len(self.pieces) < KEPT_PIECES:
                self.pieces[piece] = found
        return found

    def _words(self, words: list[str]) -> list[list[int]]:
        found: list[list[int] | None] = []
        other = []
        for i, word in enumerate(words):
            if PLAIN.fullmatch(word) and "<|" not in word:
                parts = PIECE.findall(word.lower())
                ids = self._piece(parts[0])
                for part in parts[1:]:
                    ids = ids + self._piece(part)
                found.append(ids)
            else:
                other.append(i)
                found.append(None)
        for i, e in zip(other, self.tokenizer.encode_batch_fast([words[i] for i in other], add_special_tokens=False)):
            found[i] = e.ids
        return found

    def _places(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word the start and number of its ids, and the ids they point into."""
        at = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if not len(new):
            return self.starts[at], self.sizes[at], self.ids
        fresh = [words[i] for i in new]
        found = self._words(fresh)
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        ids = np.concatenate([self.ids, np.fromiter((i for e in found for i in e), np.uint32, sizes.sum())])
        starts = len(self.ids) + np.cumsum(sizes, dtype=np.int32) - sizes
        at[new] = len(self.sizes) + np.arange(len(new))
        all_starts, all_sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        room = max(0, KEPT_WORDS - len(self.sizes))
        if room:
            self.known.update(zip(fresh[:room], at[new[:room]].tolist()))
            kept = len(self.sizes) + min(room, len(new))
            self.starts, self.sizes = all_starts[:kept], all_sizes[:kept]
            self.ids = ids[: int(self.starts[-1] + self.sizes[-1])]
        return all_starts[at], all_sizes[at], ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's ids end. Null is empty."""
        texts = pc.fill_null(texts, "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)  # fewer distinct words; special strings keep their case
        parts = pc.ascii_split_whitespace(texts)
        words = parts.flatten().dictionary_encode()
        starts, sizes, ids = self._places(words.dictionary.to_pylist())
        codes = words.indices.to_numpy(zero_copy_only=False)
        counts = sizes[codes]
        before = np.zeros(len(codes) + 1, np.int32)
        np.cumsum(counts, out=before[1:])
        where = np.repeat(starts[codes] - before[:-1], counts)
        where += np.arange(before[-1], dtype=np.int32)
        bounds = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        return ids[where], before[bounds[1:] - bounds[0]]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES):
    """The batch in runs of rows whose texts hold about ``limit`` bytes; a row stays whole."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends, held = [], 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            ends.append(i)
            held = 0
        held += size
    begun = 0
    for end in [*ends, len(sizes)]:
        if end > begun:
            yield batch.slice(begun, end - begun)
        begun = end
