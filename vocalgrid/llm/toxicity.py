"""Operator 4: toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Input of a word: a hashed word embedding, the mean of its hashed character trigram embeddings, and a hashed embedding
of its first characters. A forward and a backward GRU read windows of ``WINDOW`` words, each starting ``STRIDE`` after
the last; attention pools a window's states into one logit. All overlapping windows of the whole text are
scored, and the text's score is the highest.

Training: at most ``PER_CLASS`` labelled documents of each class, of at most ``TRAIN_CHARS`` characters, chosen by the hash of
their id among rows with such a text whose crc32(doc_id) mod 5 is not 0: a bounded sample, fitted in one task. A document's label
holds for some window only, so the windows that score highest, looked up anew after some epochs, learn it. Labels, language,
source and id are no inputs.

Defined cases: null and empty texts are one empty window, scored by the bias alone; documents with differing labels and
null labels or ids are not trained on; repeated documents count once in training and each in scoring; a short text
is one padded window; other columns are carried along; with no labelled rows of both classes every score is 0.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalgrid.llm.textkit import BASE, mix, powers, slices, words_of

WINDOW, STRIDE = 32, 16
PER_CLASS = 800
TRAIN_CHARS = 20_000
HIDDEN = 8
WORDS, TRIGRAMS, HEADS = 1 << 14, 1 << 13, 1 << 13
WORD_DIM, TRIGRAM_DIM, HEAD_DIM = 8, 12, 6
HEAD_BYTES = 5
EPOCHS = 20
# Epochs before which the best windows are looked up anew.
RANKED = (1, 3, 6, 10, 14)
BATCH = 64

_SEPARATORS = np.ones(256, dtype=bool)
_SEPARATORS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def lowered(texts: pa.Array) -> pa.Array:
    """The one form in which texts are trained on and scored: lower case, null as empty."""
    return pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))


class Features:
    """Hashed inputs of all words of some lowered texts, and the windows over them."""

    def __init__(self, data: np.ndarray, ends: np.ndarray) -> None:
        words = words_of(data, ends, _SEPARATORS)
        n = len(words.start)
        self.word = (words.hash >> np.uint64(64 - 14)).astype(np.int64)
        lengths = words.end - words.start
        self.first_byte = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(words.start - self.first_byte[:-1], lengths) + np.arange(self.first_byte[-1])
        inside = data[at].astype(np.uint32)
        before, after = np.empty_like(inside), np.empty_like(inside)
        if len(inside):
            before[1:], after[:-1] = inside[:-1], inside[1:]
            before[self.first_byte[:-1]] = 0
            after[self.first_byte[1:] - 1] = 0
        grams = (before * np.uint32(65599) + inside) * np.uint32(65599) + after
        self.trigram = ((grams * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.uint16)
        self.lengths = lengths
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((inside.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(inside)), dtype=np.uint64)])
        cut = self.first_byte[:-1] + np.minimum(lengths, HEAD_BYTES)
        heads = (sums[cut] - sums[self.first_byte[:-1]]) * powers(pow(BASE, -1, 1 << 64), len(inside) + 1)[self.first_byte[:-1]]
        self.head = (mix(heads) >> np.uint64(64 - 13)).astype(np.int64)
        counts = words.counts
        per_text = np.maximum(-(-(counts - WINDOW) // STRIDE), 0) + 1
        self.text = np.repeat(np.arange(len(counts)), per_text)
        number = np.arange(len(self.text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        self.start = words.first[:-1][self.text] + number * STRIDE
        self.length = np.clip(words.first[1:][self.text] - self.start, 0, WINDOW)
        self.n_words = n

    @classmethod
    def of(cls, texts: list[str], step: int = 1 << 18) -> Features:
        """Features of lowered texts, made in bounded parts: only the hashed inputs of all of them are held."""
        parts, held, size = [], [], 0
        for k, text in enumerate(texts):
            held.append(text.encode())
            size += len(held[-1])
            if size >= step or k + 1 == len(texts):
                parts.append(cls(np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(d) for d in held])))
                parts[-1].texts = len(held)
                held, size = [], 0
        first = parts[0]
        texts_before = np.cumsum([0, *[p.texts for p in parts]])
        words_before = np.cumsum([0, *[p.n_words for p in parts]])
        first.text = np.concatenate([p.text + t for p, t in zip(parts, texts_before)])
        first.start = np.concatenate([p.start + w for p, w in zip(parts, words_before)])
        for name in ("word", "head", "trigram", "lengths", "length"):
            setattr(first, name, np.concatenate([getattr(p, name) for p in parts]))
        first.first_byte = np.concatenate([[0], np.cumsum(first.lengths)])
        first.n_words = int(words_before[-1])
        return first


class Network:
    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        dim, h = WORD_DIM + TRIGRAM_DIM + HEAD_DIM, HIDDEN
        draw = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "word": draw(WORDS, WORD_DIM, scale=0.05), "trigram": draw(TRIGRAMS, TRIGRAM_DIM, scale=0.1), "head": draw(HEADS, HEAD_DIM, scale=0.05),
            "w": draw(dim, 6 * h, scale=dim**-0.5), "b": np.zeros(6 * h, np.float32),
            "u0": draw(h, 3 * h, scale=h**-0.5), "u1": draw(h, 3 * h, scale=h**-0.5),
            "att": draw(2 * h, 2 * h, scale=(2 * h) ** -0.5), "att_b": np.zeros(2 * h, np.float32), "query": draw(2 * h, scale=0.3),
            "out": draw(2 * h, scale=0.3), "bias": np.full(1, -1.0, np.float32),
        }
        self.trained = False

    def inputs(self, f: Features, words: np.ndarray):
        """Input vectors of some words."""
        p, lengths = self.p, f.lengths[words]
        tri = f.trigram[np.repeat(f.first_byte[:-1][words] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]
        firsts = np.cumsum(lengths) - lengths
        x = np.empty((len(lengths), WORD_DIM + TRIGRAM_DIM + HEAD_DIM), np.float32)
        if len(lengths):
            x[:, :WORD_DIM] = p["word"][f.word[words]]
            x[:, WORD_DIM : WORD_DIM + TRIGRAM_DIM] = np.add.reduceat(p["trigram"][tri], firsts, axis=0) / lengths[:, None]
            x[:, WORD_DIM + TRIGRAM_DIM :] = p["head"][f.head[words]]
        return x, tri, lengths

    def forward(self, gates: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; ``gates`` are the projected inputs of words, ``at`` (windows x WINDOW) picks them."""
        p, h, (n, steps) = self.p, HIDDEN, at.shape
        states = np.zeros((2, steps, n, h), np.float32)
        kept = []
        for d, order in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
            state, u = np.zeros((n, h), np.float32), p[f"u{d}"]
            for t in order:
                x, m = gates[at[:, t], 3 * h * d : 3 * h * (d + 1)], mask[:, t, None]
                zr = 1 / (1 + np.exp(-(x[:, : 2 * h] + state @ u[:, : 2 * h])))
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(x[:, 2 * h :] + (r * state) @ u[:, 2 * h :])
                after = state + m * z * (new - state)
                if keep:
                    kept.append((d, t, state, z, r, new))
                state = after
                states[d, t] = state
        both = np.concatenate([states[0], states[1]], axis=2).transpose(1, 0, 2)
        tanh = np.tanh(both @ p["att"] + p["att_b"])
        energy = np.where(mask > 0, tanh @ p["query"], np.float32(-1e9))
        weight = np.exp(energy - energy.max(axis=1, keepdims=True)) * mask
        weight /= np.maximum(weight.sum(axis=1, keepdims=True), np.float32(1e-9))
        pooled = np.einsum("nt,nth->nh", weight, both)
        logit = pooled @ p["out"] + p["bias"]
        return (logit, both, tanh, weight, pooled, kept) if keep else logit

    def logits(self, f: Features, chunk: int = 2048) -> np.ndarray:
        """Logit of every window, some windows and the words under them at a time."""
        out = np.empty(len(f.start), np.float32)
        for k in range(0, len(out), chunk):
            start, length = f.start[k : k + chunk], f.length[k : k + chunk]
            low, high = int(start[0]), int((start + length).max())
            x, _, _ = self.inputs(f, np.arange(low, max(high, low)))
            gates = np.concatenate([x @ self.p["w"] + self.p["b"], np.zeros((1, 6 * HIDDEN), np.float32)])
            mask = (np.arange(WINDOW) < length[:, None]).astype(np.float32)
            at = np.where(mask > 0, start[:, None] - low + np.arange(WINDOW), len(x))
            out[k : k + chunk] = self.forward(gates, at, mask)
        return out

    def gradients(self, f: Features, chosen: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p, h = self.p, HIDDEN
        start, length = f.start[chosen], f.length[chosen]
        mask = (np.arange(WINDOW) < length[:, None]).astype(np.float32)
        flat = (start[:, None] + np.arange(WINDOW))[mask > 0]
        x, tri, lengths = self.inputs(f, flat)
        gates = np.concatenate([x @ p["w"] + p["b"], np.zeros((1, 6 * h), np.float32)])
        at = np.full(mask.shape, len(flat))
        at[mask > 0] = np.arange(len(flat))
        logit, both, tanh, weight, pooled, kept = self.forward(gates, at, mask, keep=True)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d_logit = ((1 / (1 + np.exp(-logit)) - labels) / len(labels)).astype(np.float32)
        g["out"], g["bias"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["out"]
        d_both = weight[:, :, None] * d_pooled[:, None, :]
        d_weight = np.einsum("nth,nh->nt", both, d_pooled)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        g["query"] = np.einsum("nt,nth->h", d_energy, tanh)
        d_tanh = d_energy[:, :, None] * p["query"] * (1 - tanh**2)
        g["att"] = np.einsum("nti,ntj->ij", both, d_tanh)
        g["att_b"] = d_tanh.sum(axis=(0, 1))
        d_both += d_tanh @ p["att"].T
        d_gates = np.zeros_like(gates)
        d_state = [np.zeros((len(labels), h), np.float32) for _ in range(2)]
        for d, t, state, z, r, new in reversed(kept):
            u, m = p[f"u{d}"], mask[:, t, None]
            total = d_state[d] + d_both[:, t, d * h : (d + 1) * h]
            own = m * total
            dz = own * (new - state) * z * (1 - z)
            dn = own * z * (1 - new**2)
            rh = dn @ u[:, 2 * h :].T
            dr = rh * state * r * (1 - r)
            d_state[d] = total - own * z + rh * r + dz @ u[:, :h].T + dr @ u[:, h : 2 * h].T
            g[f"u{d}"] += np.concatenate([state.T @ dz, state.T @ dr, (r * state).T @ dn], axis=1)
            d_gates[at[:, t], 3 * h * d : 3 * h * (d + 1)] = np.concatenate([dz, dr, dn], axis=1) * m
        d_gates = d_gates[:-1]
        g["w"], g["b"] = x.T @ d_gates, d_gates.sum(axis=0)
        d_x = d_gates @ p["w"].T
        np.add.at(g["word"], f.word[flat], d_x[:, :WORD_DIM])
        np.add.at(g["head"], f.head[flat], d_x[:, WORD_DIM + TRIGRAM_DIM :])
        np.add.at(g["trigram"], tri, np.repeat(d_x[:, WORD_DIM : WORD_DIM + TRIGRAM_DIM] / lengths[:, None], lengths, axis=0))
        return g

    def fit(self, texts: list[str], labels: np.ndarray, seed: int = 5) -> None:
        """Adam over windows; each epoch takes a text's best windows by the current scores, and one at random."""
        r = np.random.default_rng(seed)
        f = Features.of(lowered(pa.array(texts, pa.string())).to_pylist())
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        first = np.searchsorted(f.text, np.arange(len(texts) + 1))
        for epoch in range(EPOCHS):
            if epoch in (0, *RANKED):
                score = self.logits(f) if epoch else r.standard_normal(len(f.start))
            best = np.array([first[i] + np.argmax(score[first[i] : first[i + 1]]) for i in range(len(texts))])
            other = first[:-1] + (r.random(len(texts)) * np.diff(first)).astype(np.int64)
            # A clean text has only clean windows; of a toxic one only the best is taken at its word.
            chosen = np.concatenate([best, other[labels == 0]])
            target = labels[f.text[chosen]]
            order = r.permutation(len(chosen))
            rate = 0.01 if epoch < EPOCHS // 2 else 0.003 if epoch < EPOCHS * 3 // 4 else 0.001
            for k in range(0, len(order), BATCH):
                part = order[k : k + BATCH]
                g, step = self.gradients(f, chosen[part], target[part]), step + 1
                for name, value in self.p.items():
                    a, b = m[name]
                    a += 0.1 * (g[name] - a)
                    b += 0.01 * (g[name] ** 2 - b)
                    value -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
        self.trained = True


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network:
    """The network trained on the bounded sample."""
    clean = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    agreed = clean.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    # Drawn among the ids that have a text to train on, so that a draw never comes to nothing.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text").between(1, TRAIN_CHARS))
    able = agreed.join(texts.select("doc_id").distinct(), "doc_id")
    drawn = [able.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    sample = texts.join(F.broadcast(drawn[0].union(drawn[1])), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    drawn_rows = sample.select("doc_id", "text", "toxic", F.xxhash64("doc_id").alias("draw"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((row for batch in batches for row in batch.to_pylist()), key=lambda row: (row["draw"], row["doc_id"]))
        picked = [row for k in (0, 1) for row in [x for x in rows if x["toxic"] == k][:per_class]]
        if len({row["toxic"] for row in picked}) == 2:
            made = Network()
            made.fit([row["text"] for row in picked], np.array([row["toxic"] for row in picked], dtype=np.float32))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made.p)], pa.binary())], names=["weights"])

    # The sample is bounded, so one task fits it; a lost executor repeats it with the same result.
    weights = drawn_rows.repartition(1).mapInArrow(train, "weights binary").collect()
    network = Network()
    if weights:
        network.p, network.trained = pickle.loads(bytes(weights[0]["weights"])), True
    return network


def scores(network: Network, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, scores, windows) of bounded slices of a column of texts."""
    for i, j, data, ends in slices(lowered(texts), 1 << 19):
        f = Features(data, ends)
        best = np.full(j - i, -np.inf, np.float32)
        if network.trained:
            np.maximum.at(best, f.text, network.logits(f))
        yield i, j, 1 / (1 + np.exp(-best.astype(np.float64))), np.bincount(f.text, minlength=j - i).astype(np.int64)


def scored(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``n_windows``; only doc_id is kept of the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, score, windows in scores(network, batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(windows)],
                    names=["doc_id", "score", "predicted", "n_windows"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, n_windows long")


def filtered(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` without the texts scored as toxic; every other column stays."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(s for _, _, s, _ in scores(network, texts))]))

    return docs.where(score("text") < 0.5)
