"""Operator 3: exact token counts of every prefix, by a prefix dynamic program.

Method: a text is cut into the tokenizer's own pre-tokens. For each different pre-token the program of
``merge_prefix`` stores the token count of every prefix of its bytes; a document's table is the running
sum over its pre-tokens plus the inner table of the last one. It answers "how many tokens has this text", "how
many has its prefix" and "where must it be cut to fit a budget" without encoding again.

``token_counts`` gives a row per document; ``prefix_table`` the counts at the end of every pre-token;
``PrefixCounter.prefix_counts`` the counts of every character prefix of a text.

Defined cases: null text is empty and has 0 tokens; special strings inside texts count as the library counts
them by default (one token each); a text of any length is counted whole; rows and their other columns are
independent, so repeated rows and extra columns need no rule; an empty table gives an empty result.
Memory: of known pre-tokens, those not met again are dropped before their tables exceed ``KNOWN_BYTES``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocalgrid.llm.merge_prefix import Known, MergeTable

LIMIT = 1024
KNOWN_BYTES = 64_000_000
_SPACE = regex.compile(r"\s+")
# Fixed value: the byte-level pre-token pattern that the tokenizer file's "ByteLevel" stands for.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_symbols() -> dict[str, int]:
    """The file's printable stand-in of each byte: printable bytes stand for themselves, others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        stand_in = _byte_symbols()
        names = sorted((w for w in vocab if all(c in stand_in for c in w)), key=vocab.get)
        at = {w: i for i, w in enumerate(names)}
        left, right, rank = list(range(len(names))), list(range(len(names))), [-1] * len(names)
        pairs = {}
        for k, merge in enumerate(merges):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            made = at.get(a + b)
            if made is None:
                continue
            pairs[at[a], at[b]] = k
            if rank[made] < 0:
                left[made], right[made], rank[made] = at[a], at[b], k
        usable = [len(w) == 1 or rank[i] >= 0 for i, w in enumerate(names)]
        self.table = MergeTable([[stand_in[c] for c in w] for w in names], left, right, rank, pairs, usable)
        special = [x["content"] for x in spec.get("added_tokens", [])]
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.special_set = frozenset(special)
        self.pattern = regex.compile(PRE_TOKEN)
        # Per pre-token: counts of all its prefixes as packed 32-bit numbers.
        self.known = Known(KNOWN_BYTES)

    def pre_tokens(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.pattern.findall(text)
        out = []
        for part in self.special.split(text):
            out.extend([part] if part in self.special_set else self.pattern.findall(part))
        return out

    def learn(self, tokens) -> None:
        """Store the prefix counts of pre-tokens not yet known."""
        new = self.known.unknown(tokens)
        plain = [t for t in new if t not in self.special_set]
        for t in self.special_set.intersection(new):
            self.known.add(t, np.array([0] * len(t.encode()) + [1], np.int32).tobytes())
        for part, count, _, _ in self.table.grouped([t.encode() for t in plain], np.uint8):
            packed, width = count.astype(np.int32).tobytes(), 4 * count.shape[1]
            for m, i in enumerate(part):
                self.known.add(plain[i], packed[m * width : (m + 1) * width])

    def totals(self, tokens: list[str]) -> np.ndarray:
        """Token count of the text up to the end of each pre-token."""
        known = self.known
        return np.cumsum(np.frombuffer(b"".join([known[t][-4:] for t in tokens]), dtype=np.int32), dtype=np.int64)

    def inner(self, token: str) -> np.ndarray:
        return np.frombuffer(self.known[token], dtype=np.int32)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token count of ``text[:i]`` for every i: what encoding that prefix afresh would give."""
        laid = self.laid_out(text)
        return np.concatenate([[0], *(self.counts_inside(text, laid, i) for i in range(len(laid[0])))]).astype(np.int64)

    def laid_out(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The pre-tokens of a text, the characters up to the end of each, and the tokens up to there."""
        tokens = self.pre_tokens(text)
        self.learn(tokens)
        return tokens, np.cumsum([len(t) for t in tokens], dtype=np.int64), self.totals(tokens)

    def counts_inside(self, text: str, laid: tuple[list[str], np.ndarray, np.ndarray], i: int) -> np.ndarray:
        """Token counts of the prefixes that end inside or right behind pre-token ``i``.

        Cutting can change only the last pre-tokens: a cut contraction or special string falls apart, and a cut white space run is one
        pre-token, as no word follows it. Such an end is pre-tokenised again from the last place that no cut behind it can move;
        everything else is read from the inner table.
        """
        tokens, ends, totals = laid
        token, start = tokens[i], int(ends[i - 1]) if i else 0
        before = int(totals[i - 1]) if i else 0

        def again(first: int, lengths: range) -> np.ndarray:
            """Counts of prefixes cut after ``lengths`` characters of the token, pre-tokenised from pre-token ``first`` on."""
            begin, base = (int(ends[first - 1]), int(totals[first - 1])) if first else (0, 0)
            cuts = [self.pre_tokens(text[begin : start + k]) for k in lengths]
            self.learn(chain.from_iterable(cuts))
            return np.array([base + sum(int(self.inner(c)[-1]) for c in cut) for cut in cuts], dtype=np.int64)

        def spaces() -> int:
            """First of the white space pre-tokens right before this one."""
            k = i
            while k and _SPACE.fullmatch(tokens[k - 1]):
                k -= 1
            return k

        if token in self.special_set:
            first = spaces()
            return np.append(again(first - 1 if first else 0, range(1, len(token))), totals[i])
        if token.startswith("'") and len(token) > 1 and token[1].isalpha():
            return np.append(again(i, range(1, len(token))), totals[i])
        at = np.cumsum([len(c.encode()) for c in token])
        if _SPACE.fullmatch(token):
            first = spaces()
            begin, base = (int(ends[first - 1]), int(totals[first - 1])) if first else (0, 0)
            run = text[begin : int(ends[i])]
            self.learn([run])
            return base + self.inner(run)[len(text[begin:start].encode()) + at].astype(np.int64)
        counts = before + self.inner(token)[at].astype(np.int64)
        if _SPACE.match(token):
            counts[0] = again(spaces(), range(1, 2))[0]
        return counts

    def fitting(self, text: str, tokens: list[str], totals: np.ndarray, budget: int) -> int:
        """Most characters of the text whose prefix has at most ``budget`` tokens; the pre-tokens are known and counted.

        Counts of prefixes do not rise steadily, so the last fitting place is looked for. It lies at most two pre-tokens behind the first
        one that ends beyond the budget: white space there may be counted anew, what stands before it may not.
        """
        beyond = int(np.searchsorted(totals, budget, side="right"))
        if beyond == len(tokens):
            return len(text)
        tokens = tokens[: beyond + 3]
        ends = np.cumsum([len(t) for t in tokens], dtype=np.int64)
        laid = tokens, ends, totals[: len(tokens)]
        for i in range(len(tokens) - 1, -1, -1):
            fits = np.flatnonzero(self.counts_inside(text, laid, i) <= budget)
            if len(fits):
                return int(ends[i] - len(tokens[i]) + fits[-1]) + 1
        return 0


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _counts(path: str, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            step = 512
            for k in range(0, len(texts), step):
                part = [t or "" for t in texts.slice(k, step).to_pylist()]
                cut = [table.pre_tokens(t) for t in part]
                table.learn(chain.from_iterable(cut))
                totals = [table.totals(c) for c in cut]
                n_tokens = [int(t[-1]) if len(t) else 0 for t in totals]
                # Only texts beyond the budget are looked into.
                fits = [len(t) if n <= budget else table.fitting(t, c, s, budget) for t, c, s, n in zip(part, cut, totals, n_tokens)]
                table.known.turn()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(k, step), pa.array([len(t.encode()) for t in part], pa.int64()), pa.array(n_tokens, pa.int64()),
                        pa.array([n > budget for n in n_tokens]), pa.array(fits, pa.int64()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fitting_chars"],
                )

    return run


def token_counts(docs: DataFrame, path: str, budget: int = LIMIT) -> DataFrame:
    """Per document: bytes, tokens, whether they exceed ``budget``, and the characters that fit in it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_counts(path, budget), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long")


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """Per document: character end and running token count of every pre-token, as two arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counter(path)
        for batch in batches:
            for k in range(len(batch)):
                tokens = table.pre_tokens(batch.column(1)[k].as_py() or "")
                table.learn(tokens)
                ends = np.cumsum([len(t) for t in tokens], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([table.totals(tokens).tolist()], pa.list_(pa.int64()))],
                    names=["doc_id", "ends", "counts"],
                )
                table.known.turn()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ends array<long>, counts array<long>")
