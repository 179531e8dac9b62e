"""Operator 8: SentencePiece encoding and decoding by a batched numpy Viterbi.

Method: texts are normalised as the model does (a leading space, spaces to the word mark) and cut into words.
Different words of equal length advance together, prefix by prefix: substring hashes probe the sorted piece
keys, each found piece is weighed against the best path of the prefix before it, and the maxima store
backpointers. The model in use is a merge model: a path's weight is zero or minus infinity, as the merge
order admits or forbids each neighbouring pair, and exactly one path of every prefix is admitted, so the best path is
the model's own encoding, ids equal to the library's (a plain sum of piece scores is not). Characters without a
piece fall back to byte pieces.

``encoded`` adds ids, ``decoded`` turns ids back into text.

Defined cases: null and empty texts have no ids and decode to the empty text; byte pieces that form no valid
text decode to U+FFFD each; rows are independent of each other and of other columns; empty tables stay empty.
"""

from __future__ import annotations

import codecs
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalgrid.llm.merge_prefix import Known, MergeTable, paths

MARK = "▁"
KNOWN_BYTES = 128_000_000
STEP = 500
# Marks that may end a word early, where no piece holds a letter followed by them.
STOPS = ".,;:!?|%*&$#"


def _merge(symbols: list[int], best: dict[tuple[int, int], tuple[int, int]]) -> tuple[list[int], tuple[int, int] | None]:
    """Merge by rank, leftmost first, to the end: the pieces, and the parts of the last merge."""
    after, alive = list(range(1, len(symbols) + 1)), [True] * len(symbols)
    before = list(range(-1, len(symbols) - 1))
    heap = [(*best[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in best]
    heap = [(rank, i, p, made) for rank, made, i, p in heap]
    heapq.heapify(heap)
    parts = None
    while heap:
        _, i, (a, b), made = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= len(symbols) or symbols[i] != a or symbols[j] != b:
            continue
        symbols[i], alive[j], parts = made, False, (a, b)
        after[i] = after[j]
        if after[j] < len(symbols):
            before[after[j]] = i
        for x in (before[i], i):
            if x >= 0 and after[x] < len(symbols) and (p := (symbols[x], symbols[after[x]])) in best:
                rank, new = best[p]
                heapq.heappush(heap, (rank, x, p, new))
    return [s for s, keep in zip(symbols, alive) if keep], parts


class PieceCodec:
    def __init__(self, path: str) -> None:
        import sentencepiece  # read for its piece list only

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.names = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        byte_of = {i: b for b, i in self.bytes.items()}
        self.parts = [bytes([byte_of[i]]) if i in byte_of else b"" if special[i] else self.names[i].encode() for i in range(size)]
        stops = "".join(c for c in STOPS if not regex.search(rf"\p{{L}}{regex.escape(c)}", "\n".join(self.names)))
        early = rf"{MARK}*+\p{{L}}++(?=[{regex.escape(stops)}])|" if stops else ""
        # No piece crosses from a character to a later word mark, or a newline, so neither does the best path.
        self.word = regex.compile(rf"{early}{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        own = [i for i in range(size) if not special[i] and not model.is_byte(i)]
        at = {self.names[i]: k for k, i in enumerate(own)}
        order = sorted(range(len(own)), key=lambda k: (-model.get_score(own[k]), k))
        rank_of = np.empty(len(own), dtype=np.int64)
        rank_of[order] = np.arange(len(own))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for name, k in at.items():
            for cut in range(1, len(name)):
                a, b = at.get(name[:cut]), at.get(name[cut:])
                if a is not None and b is not None:
                    best[a, b] = (int(rank_of[k]), k)
        left, right, rank, usable = list(range(len(own))), list(range(len(own))), [-1] * len(own), [True] * len(own)
        for name, k in at.items():
            if len(name) == 1:
                continue
            # Characters without a piece of their own break a longer piece up for good.
            start = [at[c] for c in name] if all(c in at for c in name) else []
            made, parts = _merge(start, best) if start else ([], None)
            usable[k] = made == [k]
            if usable[k]:
                (left[k], right[k]), rank[k] = parts, int(rank_of[k])
        self.ids = np.array(own, dtype=np.int64)
        self.table = MergeTable([[ord(c) for c in self.names[i]] for i in own], left, right, rank, {p: r for p, (r, _) in best.items()}, usable)
        # Ids of known words as packed 32-bit numbers.
        self.known = Known(KNOWN_BYTES)

    def words(self, text: str) -> list[str]:
        return self.word.findall(MARK + text.replace(" ", MARK)) if text else []

    def _with_bytes(self, word: str, pieces: list[int]) -> bytes:
        """Ids where some characters have no piece: those become the pieces of their bytes."""
        found, at = [], 0
        for piece in pieces:
            if piece == self.table.unknown:
                found.extend(self.bytes[b] for b in word[at].encode())
                at += 1
            else:
                found.append(int(self.ids[piece]))
                at += len(self.names[found[-1]])
        return array("i", found).tobytes()

    def learn(self, words) -> None:
        new = self.known.unknown(words)
        for part, _, last, back in self.table.grouped([w.encode("utf-32-le") for w in new], np.uint32):
            pieces, number = paths(last, back)
            packed, width = self.ids[np.minimum(pieces, len(self.ids) - 1)].astype(np.int32).tobytes(), 4 * pieces.shape[1]
            odd = (pieces == self.table.unknown).any(axis=1).tolist()
            for m, (i, n) in enumerate(zip(part, number.tolist())):
                end = (m + 1) * width
                self.known.add(new[i], self._with_bytes(new[i], pieces[m, pieces.shape[1] - n :].tolist()) if odd[m] else packed[end - 4 * n : end])

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.words(t) for t in texts]
        self.learn(chain.from_iterable(cut))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, words)), dtype=np.int32) for words in cut]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> str:
        """Pieces put together as UTF-8 bytes; every byte that belongs to no character becomes U+FFFD."""
        data = b"".join(map(self.parts.__getitem__, ids if isinstance(ids, list) else np.asarray(ids).tolist()))
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = data.decode(errors="pieces-fffd")
        text = text.replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def _one_by_one(error: UnicodeDecodeError) -> tuple[str, int]:
    return "\ufffd", error.start + 1


codecs.register_error("pieces-fffd", _one_by_one)


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids and round_trip (the decoded ids equal the text) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(path)
        for batch in batches:
            for k in range(0, len(batch), STEP):
                texts = [t or "" for t in batch.column(1).slice(k, STEP).to_pylist()]
                ids = pieces.encode_all(texts)
                # A literal word mark in a text reads as a space, as in the model.
                same = [pieces.decode(i) == t.replace(MARK, " ") for i, t in zip(ids, texts)]
                pieces.known.turn()
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(k, STEP), pa.array([len(i) for i in ids], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(same, pa.bool_()),
                    ],
                    names=["doc_id", "n_pieces", "ids", "round_trip"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, round_trip boolean")


def decoded(rows: DataFrame, path: str, ids: str = "ids", name: str = "text") -> DataFrame:
    """Add the text of an id column (null ids: null)."""
    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        pieces = codec(path)
        return column.map(lambda x: None if x is None else pieces.decode(x))

    return rows.withColumn(name, run(F.col(ids)))
