"""Whole-text encoding with the tokenizers library, one call per distinct word and worker."""

from __future__ import annotations

import os
import re

import numpy as np

# A word of Latin letters, composed and without marks, and a run of ASCII signs after it.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*$%&#|]*)")
PROBES = ["the", "anheon", "Éduction,", "straße...", "ça&&", "Ærø"]


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell the UTF-8 bytes of a character: printable bytes as themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
    return {c: "".join(spelled[b] for b in chr(c).encode()) for c in range(256)}


class WordEncoder(dict):
    """Token ids of a text as little-endian unsigned 32-bit bytes.

    For vocabularies that drop white space and never merge across it, the ids of a text are the ids of its words in a row.
    Words are encoded by the library when first met and kept; ``keep`` bounds what is kept, not what is encoded. Words of plain
    letters go to the library's model without its normaliser and splitter, which leave them as they are but for the case.
    """

    def __init__(self, path: str, keep: int = 1_000_000) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__()
        self.library, self.limit = Tokenizer.from_file(path), keep
        self.model, self.letters = self.library.model, byte_letters()
        self.plain = True
        self.plain = all(self.of_plain(PLAIN.fullmatch(w)) == self.of_library([w])[0] for w in PROBES)

    def of_library(self, words: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def of_plain(self, word: re.Match) -> bytes:
        letters, stop = word.groups()
        ids = [t.id for t in self.model.tokenize(letters.lower().translate(self.letters))]
        if stop:
            ids += [t.id for t in self.model.tokenize(stop)]
        return np.array(ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        plain = self.plain and PLAIN.fullmatch(word)
        ids = self.of_plain(plain) if plain else self.of_library([word])[0] if word else b""
        if len(self) >= self.limit:
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process; its words carry over from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def vocabulary_size(path: str) -> int:
    return encoder(path).library.get_vocab_size()
