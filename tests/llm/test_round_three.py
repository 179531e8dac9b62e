"""Alignment of two tokenizers, fill-in-the-middle and personal data against libraries, brute force and round trips."""

import collections
import hashlib
import re

import numpy as np
import pytest

from tests.oracle import connect
from vocalgrid.llm import boosted, cross_align, fill_middle, personal_data, queries
from vocalgrid.llm.vocabulary import vocabulary

SF = "/root/testdata/sf0.001"
PATHS = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "x y z"), (7, "é ñ 日本 " * 900), (8, "a\nb\n\na"), (9, "a▁b"), (10, "<|endoftext|> </s> <0x41> <P>"),
    (11, "x" * 700 + " y"), (12, "don't  stop\r\n 12345 x\x00y \U0001f600"), (13, "word " * 800), (14, "日本" * 500), (15, "ﬁ ​a  é"),
]
NAMES = "doc_id long, text string, key string, node string, _row string, pairs string, output string, form string, spans string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, *["other"] * 7) for i, t in ODD], NAMES)


@pytest.fixture(scope="module")
def docs():
    return connect(SF).execute("SELECT doc_id, text FROM documents").fetchall()


def brute_alignment(rows):
    """Per row: doc_id, n_a, n_b, n_groups, n_best, count_sum, groups; by the libraries and plain loops."""
    import sentencepiece
    import tokenizers

    a_side = tokenizers.Tokenizer.from_file(PATHS[0])
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    made, counts = [], collections.Counter()
    for i, text in rows:
        data = (" " + (text or "")).encode()
        a = [] if not text else a_side.encode(" " + text, add_special_tokens=False).ids
        b = [] if not text else b_side.encode(text)
        bytes_a = [bytes(letters[c] for c in a_side.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(b_side.id_to_piece(x)[3:5], 16)]) if b_side.is_byte(x) else b_side.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if b"".join(bytes_a) != data or b"".join(bytes_b) != data:
            a, b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, links, p, q = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, a[p:x])) + "|" + ",".join(map(str, b[q:y])))
            links.append((a[x - 1], b[y - 1]))
            p, q = x, y
        counts.update(links)
        made.append((i, len(a), len(b), links, ";".join(groups)))
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(i, n_a, n_b, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), g) for i, n_a, n_b, links, g in made]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("piece,size,fan,head", [(50, 64, 3, 40), (400, 17, 5, 1)])
def test_alignment_equals_the_libraries(spark, odd, docs, piece, size, fan, head):
    rows = [(i, t) for i, t in docs if t is None or len(t) < 1500][:40] + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rounds = cross_align.ROUNDS
    try:
        cross_align.ROUNDS = 6 if fan == 3 else 4
        made = cross_align.with_link_counts(cross_align.aligned(df, *PATHS, piece, size, fan), cross_align.sides(*PATHS).width, head).collect()
    finally:
        cross_align.ROUNDS = rounds
    assert order((r["doc_id"], r["n_a"], r["n_b"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in made) == order(brute_alignment(rows))


def test_alignment_query_and_cases(spark, odd, docs):
    made = queries.QUERIES["op11_cross_align"](spark, SF).collect()
    want = [(i, a, b, n, n, best, total, hashlib.sha256(g.encode()).hexdigest() if n else "") for i, a, b, n, best, total, g in brute_alignment(docs)]
    assert order(map(tuple, made)) == order(want)
    assert cross_align.aligned(odd, *PATHS).count() == len(ODD)
    empty = cross_align.aligned(odd.limit(0), *PATHS)
    assert cross_align.with_link_counts(empty, 32000).collect() == []


def test_composition_is_associative():
    table = cross_align.sides(*PATHS)
    (made,) = table.encode([" Some words, tokenised twice: unbelievable, isn't it? 12345 日本語 naïveté."])
    a, b = made
    ends = [np.cumsum(x) for x in (table.lengths_a[a], table.lengths_b[b])]
    part = lambda low, high: cross_align.fragment(table, *[x[(e > low) & (e <= high)] for x, e in ((a, ends[0]), (b, ends[1]))], *[e[(e > low) & (e <= high)] for e in ends])
    compose = lambda *parts: cross_align.compose(table, *parts)
    shown = lambda f: [v.tolist() if isinstance(v, np.ndarray) else v for v in vars(f).values()]
    size = int(ends[0][-1])
    whole = shown(part(0, size))
    for x in range(size + 1):
        for y in range(x, size + 1, 3):
            p, q, r = part(0, x), part(x, y), part(y, size)
            assert shown(compose(compose(p, q), r)) == shown(compose(p, compose(q, r))) == whole
    assert shown(compose(cross_align.Fragment(), part(0, size))) == shown(compose(part(0, size), cross_align.Fragment())) == whole


def brute_middle(i, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest, n = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest(), len(units)
    h1, h2, _, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_the_middle(spark, odd):
    tricky = [(100 + k, t) for k, t in enumerate(["<\n<S\n>", "P>\nx<", "\n", "\n\n", "a\r\nb", "<M>", "S>\n<P\n" * 9, "x<P>y"])]
    rows = ODD + tricky + [(1000 + k, "<\nM>\n<P\n>S\n") for k in range(40)]
    made = fill_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    back = made.withColumn("text", fill_middle.restored(made["output"], made["form"])).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:3])
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in back), key=key) == sorted(((i, *brute_middle(i, t)) for i, t in rows), key=key)
    assert collections.Counter((r["doc_id"], r["text"]) for r in back) == collections.Counter((i, t or "") for i, t in rows)
    assert {r["form"] for r in back} == {"plain", "spm", "psm"}
    assert fill_middle.fill_in_middle(odd).count() == len(ODD) and fill_middle.fill_in_middle(odd.limit(0)).collect() == []
    left_out = fill_middle.fill_in_middle(odd, rate=0).collect()
    assert {r["form"] for r in left_out} == {"plain"}
    words = fill_middle.fill_in_middle(odd, unit=r"\s+|\S+").collect()
    assert {r["n"] for r in words if r["doc_id"] == 5} == {1} and {r["n"] for r in words if r["doc_id"] is None} == {5}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    def luhn(d):
        return sum(v if k % 2 == 0 else v * 2 - 9 * (v > 4) for k, v in enumerate(map(int, reversed(d)))) % 10 == 0

    good = {
        "email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m)), "phone": lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    return sorted((m.start(), k, m.end()) for k, name in enumerate(personal_data.KINDS) for m in re.finditer(BASE[name], text) if good[name](m[0]))


@pytest.mark.parametrize("letters", ["01. -+", "4 -0", "a@b.-", "+1() .-", "12.a:@ ", "25.60"])
def test_base_spans_equal_the_patterns(letters):
    r = np.random.default_rng(3)
    for _ in range(3000):
        text = "".join(r.choice(list(letters), int(r.integers(0, 40))))
        assert personal_data.base_spans(text) == brute_base(text), text


def test_passes_are_linear():
    long = 300_000
    for text in ("a" * long, "1" * long, "a@" * long, "1." * long, "1 " * long, "+1" * long, "a-" * long + "@", "@" + "a." * long, ":1" * long):
        personal_data.base_spans(text)
    assert personal_data.Detector().spans(["1" * long]) == [[]]


@pytest.fixture(scope="module")
def detector(spark):
    return personal_data.fitted(spark.read.parquet(f"{SF}/documents.parquet"))


def test_held_out_spans_are_found(detector, docs):
    x, y, _ = personal_data.training_rows([t for _, t in docs if t][:80], seed=99)
    chosen = detector.trees.score(x) >= np.array(detector.thresholds)[x[:, 0].astype(int)]
    for kind in range(4):
        own = x[:, 0] == kind
        assert (chosen & own & (y > 0)).sum() >= 0.9 * (own & (y > 0)).sum() and (chosen & own & (y > 0)).sum() >= 0.95 * (chosen & own).sum()


@pytest.mark.parametrize("text,kind,span", [
    ("Call us at (415) 555-0132 today", "phone", "(415) 555-0132"), ("by +1 (310) 555-4510 190.137.223.204 or", "phone", "+1 (310) 555-4510"), ("pay with 4417744280351547 4417744280351547 now", "card", "4417744280351547"),
    ("mail jane [at] example [dot] org please", "email", "jane [at] example [dot] org"), ("host 2001:db8::ff00:42:8329 is up", "ip", "2001:db8::ff00:42:8329"),
])
def test_the_method_adds_spans(detector, text, kind, span):
    (found,) = detector.spans([text])
    assert (kind, span, False) in [(personal_data.KINDS[k], text[s:e], b) for s, k, e, _, b in found]


def test_look_alikes_stay(detector):
    texts = ["on 2024-05-17 at 12:30:45 the", "order 9807915762804490 was", "ISBN 978-3-16-148410-0 here", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x', "follow @someone now", "1 2 3 4 5 6 7 8 9 10 11 12", "from 1,234,567.89 to 3.14159265"]
    assert detector.spans(texts) == [[] for _ in texts]


def test_personal_data_query_and_cases(spark, detector, odd, docs):
    made = {r["doc_id"]: r for r in queries.QUERIES["op13_personal_data"](spark, SF).collect()}
    assert set(made) == {i for i, _ in docs}
    for i, text in docs:
        base = brute_base(text or "")
        shown = [f"{personal_data.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert made[i]["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert [made[i][f"n_{k}"] for k in personal_data.KINDS] == [sum(b[1] == j for b in base) for j in range(4)]
        assert set(shown) <= set(made[i]["spans"].split(","))
    assert personal_data.personal_spans(odd, detector).count() == len(ODD) and personal_data.personal_spans(odd.limit(0), detector).collect() == []
    again = personal_data.fitted(spark.read.parquet(f"{SF}/documents.parquet"))
    assert again.thresholds == detector.thresholds
    mail = spark.createDataFrame([(1, "to a.b@c.org, +1 (310) 555-4510 or 4417744280351547.", "kept"), (2, None, "kept")], "doc_id long, text string, spans string")
    rows = {r["doc_id"]: r for r in personal_data.redacted(mail, detector).collect()}
    assert rows[1]["text"] == "to [EMAIL], [PHONE] or [CARD]." and rows[2]["text"] is None and rows[1]["spans"] == "kept"
    assert personal_data.fitted(odd.limit(0)).trees is not None


def test_boosted_trees_fit_and_calibrate():
    r = np.random.default_rng(0)
    x = r.standard_normal((4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = boosted.BoostedTrees(rounds=30)
    trees.fit(x[:3000], y[:3000])
    assert ((trees.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    trees.calibrate(x[3000:], y[3000:])
    score = trees.score(x)
    assert (np.diff(trees.steps_to) >= -0.51).all() and abs(score.mean() - y.mean()) < 0.05 and trees.score(x[:0]).shape == (0,)
