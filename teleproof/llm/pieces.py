"""SentencePiece encoding and decoding as shortest paths through a weighted transducer.

The transducer is compiled from the model's tables: a normaliser (space to the space sign, a space sign before the text), one path per piece,
and byte arcs for characters without a piece. Composed with an input it is a lattice whose arcs are the pieces found in it; the
encoding is the path of least weight, weights being added along a path and the least taken over paths. For unigram models the weight of an
arc is the negative score of its piece. For BPE models a weight stands between neighbouring pieces: zero if merging their joint text
ends in just these two, else infinite. A path of finite weight through pairs that merge no further is what merging by score gives.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"


class PieceTransducer(dict):
    """The compiled model. As a mapping: a word (space signs, then other characters) to its ids as little-endian unsigned 32-bit bytes.

    ``keep`` bounds the words and pairs remembered, not what is encoded.
    """

    def __init__(self, model_file: str, keep: int = 700_000) -> None:
        super().__init__()
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=model_file).serialized_model_proto())
        rules, kinds = spec.normalizer_spec, proto.ModelProto.SentencePiece
        if rules.precompiled_charsmap:
            raise ValueError("a model with a character map needs its map compiled too; only identity maps are supported")
        self.prefix, self.squeeze = rules.add_dummy_prefix, rules.remove_extra_whitespaces
        self.is_bpe, self.limit = spec.trainer_spec.model_type == proto.TrainerSpec.BPE, keep
        self.ids, self.scores, self.spelled, self.bytes_at = {}, {}, [], [0] * 256
        self.unknown = 0
        for k, piece in enumerate(spec.pieces):
            text = piece.piece
            if piece.type == kinds.BYTE:
                self.bytes_at[int(text[1:-1], 16)] = k
                self.spelled.append(bytes([int(text[1:-1], 16)]))
            elif piece.type in (kinds.CONTROL, kinds.UNKNOWN, kinds.UNUSED):
                self.unknown = k if piece.type == kinds.UNKNOWN else self.unknown
                self.spelled.append(b"" if piece.type == kinds.CONTROL else " ⁇ ".encode())
            else:
                self.ids[text], self.scores[text] = k, piece.score
                self.spelled.append(text.replace(SPACE, " ").encode())
        self.fallback = spec.trainer_spec.byte_fallback
        self.names = [piece.piece for piece in spec.pieces]
        self.arcs = {p[:k]: -1 for p in self.ids for k in range(1, len(p))} | self.ids  # from a state: on to a longer prefix, or out with a piece
        self.letters = {p for p in self.ids if len(p) == 1}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("pieces across a space need whole texts as one word")
        self.pairs: dict[int, bool] = {}

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.replace(SPACE, " ")).strip(" ")
        if not text:
            return ""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    def merged(self, text: str) -> list[str]:
        """Merge neighbours, the best-scored union first, the leftmost among equals."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = -math.inf, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1], -math.inf)
                if score > best:
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def joins(self, a: int, b: int) -> bool:
        """Whether the weight between two neighbouring pieces is zero; ``a`` is the number of pieces at the start of a word."""
        if len(self.pairs) > self.limit:
            self.pairs.clear()
        left = [self.names[a]] if a < len(self.names) else []
        found = self.pairs[a << 24 | b] = self.merged("".join(left) + self.names[b]) == [*left, self.names[b]]
        return found

    def least_weight(self, word: str) -> list[int]:
        """The path of least weight through the lattice of ``word``, whose characters all have pieces."""
        n, arcs, pairs = len(word), self.arcs, self.pairs
        last: list[int | None] = [None] * (n + 1)
        if self.is_bpe:
            # Each prefix has one path of finite weight, so one last piece is all that need be kept of it.
            last[0] = len(self.names)
            for i in range(n):
                a = last[i] << 24
                for j in range(i + 1, n + 1):
                    b = arcs.get(word[i:j])
                    if b is None:
                        break
                    if b >= 0 and last[j] is None:
                        fits = pairs.get(a | b)
                        if self.joins(a >> 24, b) if fits is None else fits:
                            last[j] = b
        else:
            weight = [0.0] + [math.inf] * n
            for i in range(n):
                for j in range(i + 1, n + 1):
                    b = arcs.get(word[i:j])
                    if b is None:
                        break
                    if b >= 0 and weight[i] - self.scores[word[i:j]] < weight[j]:
                        weight[j], last[j] = weight[i] - self.scores[word[i:j]], b
        path, j = [], n
        while j:
            path.append(last[j])
            j -= len(self.names[last[j]])
        return path[::-1]

    def __missing__(self, word: str) -> bytes:
        ids, run = [], ""
        for c in [*word, None]:
            if c is not None and c in self.letters:
                run += c
                continue
            if run:
                ids += self.least_weight(run)
                run = ""
            if c is not None:
                ids += [self.bytes_at[b] for b in c.encode("utf-8", "surrogatepass")] if self.fallback else [self.unknown]
        found = np.array(ids, "<u4").tobytes()
        if len(self) >= self.limit:
            self.clear()
        self[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit bytes; null and empty: none."""
        if not text:
            return b""
        lines = self.normalise(text).split("\n") if "\n" not in self.letters else [self.normalise(text)]
        return self["\n"].join([b"".join(map(self.__getitem__, self.words(line))) for line in lines])

    @staticmethod
    def words(line: str) -> list[str]:
        parts = line.split(SPACE)
        if "" in parts[1:]:  # space signs in a row belong to the word after them
            return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", line)
        return [*([parts[0]] if parts[0] else []), *(SPACE + p for p in parts[1:])]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement sign."""
        data = b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        if self.prefix and data.startswith(b" "):
            data = data[1:]
        return data.decode("utf-8", "replace")


_models: dict[str, PieceTransducer] = {}


def transducer(model_file: str) -> PieceTransducer:
    if model_file not in _models:
        _models[model_file] = PieceTransducer(model_file)
    return _models[model_file]


def encode_pieces(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, ids``: the ids of every whole text as a binary of little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. Rows that repeat give equal rows; null ``doc_id`` stays null. Only ``doc_id`` and ``text`` are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = transducer(model_file)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.encode(t.as_py()) for t in part.column(1)], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode_pieces(encoded: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, ids, text``: the text that the ids spell; null ids: null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = transducer(model_file)
        for batch in batches:
            texts = [None if x.as_py() is None else model.decode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")
