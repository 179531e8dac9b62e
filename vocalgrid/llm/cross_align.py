"""Operator 11: alignment of two tokenizers over the same text, by an associative monoid of fragments.

Method: both tokenizers encode space+text; byte offsets where a token of each ends cut the tokens into groups. A *fragment* is
what is known of a byte range alone: the open prefix (tokens up to its first common end), the closed groups, and the open
suffix (tokens after its last common end). Putting two neighbouring fragments together closes the group that their open ends
form; this is associative, so fragments of any byte ranges can be composed in any tree (``compose``).

A text of at most ``PIECE`` characters is one fragment, made with many others at once. A longer one is cut where no token of
either tokenizer can cross (one space between two letters or digits), the parts are spread over tasks and encoded there, and the
tokens are dealt to byte ranges of ``RANGE`` bytes, whatever the cuts; a tree of ``ROUNDS`` shuffles with up to ``FAN`` fragments a
node composes them again. A part without such a place stays whole. Three rounds suffice for any row Spark can hold; smaller
ranges or fans get as many as they need for that.

Links are the pairs of tokens that end together, one a group. A pair's count over the corpus is summed with map-side combining
(each document sends its different pairs); counts return to the documents in two parts: the most frequent pairs, fewer than
``HEAD``, by broadcast, the others by a salted join.

Defined cases: null and empty texts, and texts whose joined token bytes differ from space+text (a word mark U+2581 in it),
have no tokens: zeros and an empty string of groups; their pairs count nowhere. Strings of special tokens are plain text.
Repeated rows are aligned each and each count; null ids are carried; other columns are not looked at, whatever their names;
an empty table gives an empty result. Ties for the highest count all count as best.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalgrid.llm.textkit import ASCII_SPACE
from vocalgrid.llm.token_counts import PRE_TOKEN, _byte_symbols
from vocalgrid.scale import attach
from vocalgrid.session import new_location

PIECE = 1 << 15
RANGE = 1 << 15
FAN, ROUNDS = 64, 3
# A text that Spark can hold is shorter.
MOST_BYTES = 1 << 31
HEAD = 250_000
STEP_CHARS = 1 << 19
MARK = "▁"
_SAFE = regex.compile(r"(?<=[\p{L}\p{N}]) (?=[\p{L}\p{N}])")
# The fast encoder's merging is quadratic in one run without (or of) white space; texts with runs of more bytes go to the other one.
LONG_RUN = 300

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<int>"
_FRAGMENT = (
    "key long, doc_id long, no long, start long, ok boolean, closed boolean, n_a long, n_b long, n_groups long, head_a array<int>, head_b array<int>, "
    "tail_a array<int>, tail_b array<int>, body string, pairs array<long>, times array<int>"
)
_INTS, _LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())
_FRAGMENT_ARROW = pa.schema([
    ("key", pa.int64()), ("doc_id", pa.int64()), ("no", pa.int64()), ("start", pa.int64()), ("ok", pa.bool_()), ("closed", pa.bool_()), ("n_a", pa.int64()),
    ("n_b", pa.int64()), ("n_groups", pa.int64()), ("head_a", _INTS), ("head_b", _INTS), ("tail_a", _INTS), ("tail_b", _INTS), ("body", pa.string()),
    ("pairs", _LONGS), ("times", _INTS),
])


class Sides:
    """Both tokenizers, the bytes of each of their tokens, and the texts that ids become in a string of groups."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tiktoken
        import tokenizers

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        stand_in = _byte_symbols()
        vocab = spec["model"]["vocab"]
        own = {w: bytes(stand_in[c] for c in w) for w in vocab if all(c in stand_in for c in w)}
        self.bytes_a = self._table({vocab[w]: b for w, b in own.items()})
        self.whole = tokenizers.Tokenizer.from_file(path_a)
        self.whole.encode_special_tokens = True
        special = {x["content"] for x in spec.get("added_tokens", [])}
        ranks = {b: vocab[w] for w, b in own.items() if w not in special}
        self.fast = tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = self._table({
            i: bytes([int(w[3:5], 16)]) if self.b.is_byte(i) else w.replace(MARK, " ").encode() for i, w in enumerate(names)
        })
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        self.width = len(self.bytes_b)
        shown = [f"{i}{end}" for i in range(len(self.bytes_a)) for end in ",|"] + [f"{i}{end}" for i in range(self.width) for end in ",;"]
        self.shown = np.array(shown, dtype=object)

    @staticmethod
    def _table(known: dict[int, bytes]) -> np.ndarray:
        table = np.full(max(known) + 1, b"", dtype=object)
        for i, b in known.items():
            table[i] = b
        return table

    def ids_a(self, text: str, data: bytes) -> np.ndarray:
        space = ASCII_SPACE[np.frombuffer(data, np.uint8)]
        turns = np.flatnonzero(space[1:] != space[:-1])
        if np.diff(turns, prepend=0, append=len(data)).max(initial=0) > LONG_RUN:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.int64)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)

    def encode(self, padded: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Token ids of texts that start with a space; None where the joined bytes are not the text's."""
        out = []
        for text, b in zip(padded, self.b.encode([t[1:] for t in padded], num_threads=1)):
            data = text.encode()
            a, b = self.ids_a(text, data), np.array(b, dtype=np.int64)
            same = b"".join(self.bytes_a[a].tolist()) == data and b"".join(self.bytes_b[b].tolist()) == data
            out.append((a, b) if same else None)
        return out

    def group_text(self, a, b) -> str:
        """One closed group, with its end mark."""
        return ",".join(map(str, a)) + "|" + ",".join(map(str, b)) + ";"

    def laid_out(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> list[str]:
        """The texts of all tokens of closed groups, group by group, side a first; ``last_*`` mark the tokens that end a group."""
        at_a, at_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        # A token's place counts the other side's tokens before it.
        codes[np.arange(len(a)) + np.concatenate([[0], at_b + 1])[group_a]] = 2 * a + last_a
        codes[np.arange(len(b)) + (at_a + 1)[group_b]] = 2 * (len(self.bytes_a) + b) + last_b
        return self.shown[codes].tolist()


@lru_cache(maxsize=2)
def sides(path_a: str, path_b: str) -> Sides:
    return Sides(path_a, path_b)


def _empty() -> np.ndarray:
    return np.zeros(0, dtype=np.int64)


@dataclass
class Fragment:
    """Tokens of a byte range: open prefix (``head``), closed groups (``body`` and its pairs), open suffix (``tail``).

    Without a common end (``closed`` False) all tokens stand in the head.
    """

    closed: bool = False
    head_a: np.ndarray = field(default_factory=_empty)
    head_b: np.ndarray = field(default_factory=_empty)
    body: str = ""
    n_groups: int = 0
    pairs: np.ndarray = field(default_factory=_empty)
    times: np.ndarray = field(default_factory=_empty)
    tail_a: np.ndarray = field(default_factory=_empty)
    tail_b: np.ndarray = field(default_factory=_empty)
    n_a: int = 0
    n_b: int = 0
    ok: bool = True


def _tally(pairs: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    kinds, place = np.unique(pairs, return_inverse=True)
    return kinds, np.bincount(place, weights=times, minlength=len(kinds)).astype(np.int64)


def fragment(table: Sides, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> Fragment:
    """The fragment of the tokens of one byte range, given by their ids and the offsets where they end."""
    at_a, at_b = (np.flatnonzero(np.isin(x, y, assume_unique=True)) for x, y in ((ends_a, ends_b), (ends_b, ends_a)))
    if not len(at_a):
        return Fragment(head_a=a, head_b=b, n_a=len(a), n_b=len(b))
    cuts_a, cuts_b = at_a + 1, at_b + 1
    inner = [x[c[0] : c[-1]] for x, c in ((a, cuts_a), (b, cuts_b))]
    marks = [np.isin(np.arange(c[0], c[-1]), c[1:] - 1, assume_unique=True) for c in (cuts_a, cuts_b)]
    pairs, times = _tally(a[at_a[1:]] * table.width + b[at_b[1:]])
    return Fragment(
        True, a[: cuts_a[0]], b[: cuts_b[0]], "".join(table.laid_out(*inner, *marks)), len(at_a) - 1, pairs, times, a[cuts_a[-1] :], b[cuts_b[-1] :], len(a), len(b)
    )


def compose(table: Sides, left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring byte ranges; associative, with the empty fragment as its unit."""
    join = lambda x, y: np.concatenate([x, y])
    n_a, n_b, ok = left.n_a + right.n_a, left.n_b + right.n_b, left.ok and right.ok
    if not left.closed:
        head_a, head_b = join(left.head_a, right.head_a), join(left.head_b, right.head_b)
        return Fragment(right.closed, head_a, head_b, right.body, right.n_groups, right.pairs, right.times, right.tail_a, right.tail_b, n_a, n_b, ok)
    if not right.closed:
        tail_a, tail_b = join(left.tail_a, right.head_a), join(left.tail_b, right.head_b)
        return Fragment(True, left.head_a, left.head_b, left.body, left.n_groups, left.pairs, left.times, tail_a, tail_b, n_a, n_b, ok)
    a, b = join(left.tail_a, right.head_a), join(left.tail_b, right.head_b)
    link = a[-1:] * table.width + b[-1:]
    pairs, times = _tally(np.concatenate([left.pairs, right.pairs, link]), np.concatenate([left.times, right.times, [1]]))
    body = left.body + table.group_text(a, b) + right.body
    return Fragment(True, left.head_a, left.head_b, body, left.n_groups + right.n_groups + 1, pairs, times, right.tail_a, right.tail_b, n_a, n_b, ok)


def document(table: Sides, whole: Fragment) -> tuple:
    """Columns of a whole text's fragment: its open prefix is its first group, and nothing is open at its end."""
    if not whole.ok or not whole.closed:
        return 0, 0, 0, "", [], []
    if len(whole.tail_a) or len(whole.tail_b):
        raise ValueError("tokens after the last common end of a whole text")
    pairs, times = _tally(np.append(whole.pairs, whole.head_a[-1] * table.width + whole.head_b[-1]), np.append(whole.times, 1))
    return whole.n_a, whole.n_b, whole.n_groups + 1, (table.group_text(whole.head_a, whole.head_b) + whole.body)[:-1], pairs, times


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def align_texts(table: Sides, texts: list[str]) -> list[pa.Array]:
    """Columns n_a .. times of whole texts, all of them at once: their bytes stand one after the other."""
    made = table.encode([" " + t for t in texts])
    good = np.array([m is not None and t != "" for m, t in zip(made, texts)], dtype=bool)
    none = (_empty(), _empty())
    kept = [m if g else none for m, g in zip(made, good)]
    n_a, n_b = (np.array([len(m[s]) for m in kept], dtype=np.int64) for s in (0, 1))
    a, b = (np.concatenate([m[s] for m in kept]) if kept else _empty() for s in (0, 1))
    ends_a, ends_b = np.cumsum(table.lengths_a[a]), np.cumsum(table.lengths_b[b])
    size = int(ends_a[-1]) if len(ends_a) else 0
    flag_a, flag_b = np.zeros(size + 1, dtype=bool), np.zeros(size + 1, dtype=bool)
    flag_a[ends_a], flag_b[ends_b] = True, True
    last_a, last_b = flag_b[ends_a], flag_a[ends_b]
    at_a, at_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
    shown = table.laid_out(a, b, last_a, last_b)
    ends = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
    groups = ["".join(shown[i:j])[:-1] for i, j in zip(ends[:-1], ends[1:])]
    owner = np.repeat(np.arange(len(kept)), n_a)[at_a]
    span = len(table.bytes_a) * table.width
    keys, times = np.unique(owner * span + a[at_a] * table.width + b[at_b], return_counts=True)
    different = np.bincount(keys // span, minlength=len(kept)) if len(kept) else _empty()
    return [
        pa.array(n_a), pa.array(n_b), pa.array(np.bincount(owner, minlength=len(kept)).astype(np.int64)), pa.array(groups, pa.string()),
        _lists(keys % span, different, pa.int64()), _lists(times, different, pa.int32()),
    ]


def cut(text: str, piece: int) -> list[tuple[int, str]]:
    """(start in space+text, part) of parts that both tokenizers encode as they encode the whole; each starts with a space."""
    padded, begin, out = " " + text, 0, []
    while True:
        found = _SAFE.search(padded, begin + piece)
        if not found:
            return [*out, (begin, padded[begin:])]
        out.append((begin, padded[begin : found.start()]))
        begin = found.start()


def part_fragments(table: Sides, part: str, start: int, size: int) -> list[tuple[int, int, Fragment]]:
    """(byte range, offset, fragment) of a part that begins at byte ``start``: tokens belong to the range they end in."""
    (made,) = table.encode([part])
    if made is None:
        return [(start // size, start, Fragment(ok=False))]
    a, b = made
    ends_a, ends_b = start + np.cumsum(table.lengths_a[a]), start + np.cumsum(table.lengths_b[b])
    out = []
    for k in range(start // size, (int(ends_a[-1]) - 1) // size + 1):
        own_a, own_b = ((e > k * size) & (e <= (k + 1) * size) for e in (ends_a, ends_b))
        if own_a.any() or own_b.any():
            out.append((k, max(start, k * size), fragment(table, a[own_a], b[own_b], ends_a[own_a], ends_b[own_b])))
    return out


def _rows(made: list[tuple[int, int | None, int, int, Fragment]]) -> pa.RecordBatch:
    names = _FRAGMENT_ARROW.names[4:]
    columns = [[r[k] for r in made] for k in range(4)] + [[getattr(r[4], n) for r in made] for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FRAGMENT_ARROW)], schema=_FRAGMENT_ARROW)


def _read(row: dict) -> Fragment:
    arrays = ("head_a", "head_b", "tail_a", "tail_b", "pairs", "times")
    return Fragment(**{n: np.array(row[n], dtype=np.int64) if n in arrays else row[n] for n in _FRAGMENT_ARROW.names[4:]})


def aligned(docs: DataFrame, path_a: str, path_b: str, piece: int = PIECE, size: int = RANGE, fan: int = FAN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups (``a1,a2|b1;a3|b2``), and the different linked pairs with how often they are linked.

    A pair is ``a * width + b``, with ``width`` the number of ids of tokenizer b.
    """
    columns = ["n_a", "n_b", "n_groups", "groups", "pairs", "times"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sides(path_a, path_b)
        for batch in batches:
            texts, begin, held = [], 0, 0
            for k in range(len(batch)):
                texts.append(batch.column(1)[k].as_py() or "")
                held += len(texts[-1])
                if held >= STEP_CHARS or k + 1 == len(batch):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), *align_texts(table, texts)], names=["doc_id", *columns])
                    texts, begin, held = [], k + 1, 0

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc_id, text in zip(*(batch.column(k) for k in range(3))):
                offset, made = 0, []
                for _, part in cut(text.as_py(), piece):
                    made.append((key.as_py(), doc_id.as_py(), offset, part))
                    offset += len(part.encode())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["key", "doc_id", "start", "part"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sides(path_a, path_b)
        for batch in batches:
            for row in batch.to_pylist():
                yield _rows([(row["key"], row["doc_id"], no, at, made) for no, at, made in part_fragments(table, row["part"], row["start"], size)])

    def node(group: pa.Table) -> pa.Table:
        table = sides(path_a, path_b)
        rows = group.drop_columns(["node"]).sort_by([("no", "ascending"), ("start", "ascending")]).to_pylist()
        made = reduce(lambda x, y: compose(table, x, y), map(_read, rows))
        return pa.Table.from_batches([_rows([(rows[0]["key"], rows[0]["doc_id"], rows[0]["no"] // fan, rows[0]["start"], made)])])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sides(path_a, path_b)
        for batch in batches:
            for row in batch.to_pylist():
                made = zip(document(table, _read(row)), (pa.int64(), pa.int64(), pa.int64(), pa.string(), _LONGS, _INTS))
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"]], pa.int64()), *[pa.array([v], t) for v, t in made]], names=["doc_id", *columns])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.length("text") > piece, F.lit(False))
    short = rows.where(~long).mapInArrow(whole, ALIGNED)
    cut_up = rows.where(long).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text").mapInArrow(parts, "key long, doc_id long, start long, part string")
    # A stated number of partitions, as the parts are small in bytes but dear to encode.
    wide = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cut_up.repartition(wide, "key", "start").mapInArrow(encode, _FRAGMENT)
    for _ in range(max(ROUNDS, math.ceil(math.log(MOST_BYTES / size, fan)))):
        spread = spread.withColumn("node", F.floor(F.col("no") / fan).cast("long")).groupBy("key", "node").applyInArrow(node, _FRAGMENT)
    return short.unionByName(spread.mapInArrow(finish, ALIGNED))


def _stored(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    place = new_location(spark, name)
    df.write.parquet(place)
    return spark.read.parquet(place)


def with_link_counts(rows: DataFrame, width: int, head: int = HEAD) -> DataFrame:
    """Rows of ``aligned`` (the groups may be left out), pairs replaced by n_links, n_best and count_sum.

    ``n_best``: links whose corpus-wide count is the highest of their token of side b; ``count_sum``: counts summed over the links.
    """
    spark = rows.sparkSession
    kept = _stored(rows.withColumn("_row", F.monotonically_increasing_id()), spark, "aligned")
    links = kept.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("_l")).select("_row", F.col("_l.pairs").alias("pair"), F.col("_l.times").alias("times"))
    counts = _stored(links.groupBy("pair").agg(F.sum("times").alias("count")), spark, "pair-counts")
    best = counts.groupBy((F.col("pair") % width).alias("_b")).agg(F.max("count").alias("_best"))
    told = counts.withColumn("_b", F.col("pair") % width).join(best, "_b").select("pair", "count", (F.col("count") == F.col("_best")).alias("best"))
    told = _stored(told, spark, "pair-ranks")
    # The count below which pairs are looked up by a join; fewer than ``head`` pairs lie above it.
    least = told.select("count").orderBy(F.desc("count")).limit(head).agg(F.min("count").alias("c"), F.count(F.lit(1)).alias("n")).first()
    floor = least["c"] if least["n"] == head else 0
    often, rare = told.where(F.col("count") > floor), told.where(F.col("count") <= floor)
    found = links.join(F.broadcast(often), "pair")
    if floor:
        others = links.join(F.broadcast(often.select("pair")), "pair", "left_anti")
        found = found.unionByName(attach(others, rare, ["pair"], ["_row"]))
    sums = found.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    own = kept.withColumn("n_links", F.col("n_groups")).drop("pairs", "times")
    return own.join(sums, "_row", "left").select(*[c for c in own.columns if c != "_row"], zero("n_best"), zero("count_sum"))
