"""Cases that hold for every operator and stage, and brute-force versions of what SQL cannot say."""

import collections
import re
import subprocess
import sys
import textwrap
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.oracle import connect
from vocalgrid.llm import (
    chat_pairs, cross_align, decontaminate, fill_middle, html_text, jaccard_join, license_scan, merge_prefix, personal_data, piece_codec, quality, sharding, token_counts, toxicity,
)
from vocalgrid.llm.vocabulary import vocabulary

SF = "/root/testdata/sf0.001"
JSON, MODEL = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
INNER = (
    "_key _key_ _text _removed _row _row_ set_key row_key bands node root group member least links pair times count best key no start part ok closed seed place hits diagonal h words spans output form "
    "labels score prompt_in n_prompt_turns class_id n_links host line document shard slot size position n_words kept removed_words draw toxic html_ a.b c`d"
).split()
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, "one two three"), (4, "one two three"), (None, "null id " * 30), (6, "word " * 3000), (7, "a" * 6000), (8, "é 日本\n" * 40), (9, "Free under the MIT License, all rights reserved.")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", len(t or ""), *[f"own {c}" for c in INNER]) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in INNER))


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(20))), (2, None), (3, "")], "item_id long, text string")


def results(docs, benchmark):
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    yield "2", jaccard_join.near_duplicates(docs)
    yield "2d", jaccard_join.deduplicated(docs)
    yield "3", token_counts.token_counts(docs, JSON)
    yield "4", toxicity.scored(docs, toxicity.fitted(docs, labels))
    yield "4f", toxicity.filtered(docs, toxicity.fitted(docs, labels))
    yield "5", license_scan.license_report(docs)
    yield "6", quality.quality_report(docs)
    yield "6f", quality.quality_filtered(docs)
    yield "8", piece_codec.encoded(docs, MODEL)
    yield "9", decontaminate.leaks(docs, benchmark)
    yield "9d", decontaminate.decontaminated(docs, benchmark)
    yield "10", sharding.document_shards(docs)
    yield "11", cross_align.with_link_counts(cross_align.aligned(docs, JSON, MODEL, piece=2000), 32000)
    yield "12", fill_middle.fill_in_middle(docs)
    yield "13", personal_data.personal_spans(docs, personal_data.Detector())
    yield "13r", personal_data.redacted(docs, personal_data.Detector())


def test_every_inner_name_as_a_column(odd, benchmark):
    for name, made in results(odd, benchmark):
        rows = made.collect()
        if name[-1] in "dfr":
            assert made.columns == odd.columns, name
            assert all(r[c] == f"own {c}" for r in rows for c in INNER), name
        if name not in ("2d", "6f", "9"):
            assert len(rows) == len(TEXTS), name


def test_empty_tables(odd, benchmark):
    for name, made in results(odd.limit(0), benchmark.limit(0)):
        assert made.collect() == [], name
    for name, made in results(odd, benchmark.limit(0)):
        if name in ("9", "9d"):
            assert made.count() == (0 if name == "9" else len(TEXTS))


def test_preference_columns_keep_their_values(spark):
    turns = "array<struct<role:string,text:string>>"
    a, b = [("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "b")]
    df = spark.createDataFrame([(1, a, b, "p", "m", "t", "c"), (1, a, b, "p", "m", "t", "c")], f"i int, good {turns}, bad {turns}, prompt string, chosen_mask string, _turns string, chosen string")
    made = chat_pairs.format_preferences(df, "good", "bad")
    for r in made.collect():
        assert (r["prompt_in"], r["chosen_mask_in"], r["_turns"], r["chosen_in"]) == ("p", "m", "t", "c")
        assert r["chosen"].startswith("<|im_start|>assistant\na") and r["n_prompt_turns"] == 1
    assert chat_pairs.format_preferences(df.limit(0), "good", "bad").collect() == []
    tied = spark.createDataFrame([(None, 1, "user", "x"), (None, 1, "assistant", "y"), (None, 2, "assistant", "z")], "conv_id long, turn long, role string, text string")
    assert chat_pairs.stale_answer_pairs(tied).count() == 1 and chat_pairs.stale_answer_pairs(tied.limit(0)).count() == 0


def test_stages_on_odd_and_empty_documents(spark, odd, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(4, 0), (6, 1)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "word " * 20)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    left = {"quality_rules": {8}, "toxicity": {i for i, _ in TEXTS}, "jaccard_join": {i for i, _ in TEXTS}, "decontamination": {i for i, _ in TEXTS} - {6}, "sentencepiece": {i for i, _ in TEXTS}}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, odd, sf)
        rows = made.collect()
        if name == "quality_rules":
            assert {r["doc_id"] for r in rows} <= {None, 6, 8}
        else:
            assert {r["doc_id"] for r in rows} == left[name], name
        if name != "sentencepiece":
            assert made.columns == odd.columns
        assert stage(spark, odd.limit(0), sf).collect() == []
    dropped = [r["doc_id"] for r in corpus_pipeline.STAGES[2][1](spark, odd, sf).collect()]
    assert collections.Counter(dropped)[4] == 1


@pytest.mark.parametrize("text", [
    "internationalization", "don't  stop'll \n\n  now   ", "a" * 40 + "   b", "  \t\n x", "!<|endoftext|> y  <|endoftext|>", "日本 é  naïve", " 's 'll''ve", "x\n \n \n y", "12345678 9", "",
])
def test_budget_answers_equal_brute_force(text):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(JSON)
    table = token_counts.counter(JSON)
    counts = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    assert table.prefix_counts(text).tolist() == counts
    laid = table.laid_out(text)
    for budget in range(max(counts) + 2):
        assert table.fitting(text, laid[0], laid[2], budget) == max(k for k, n in enumerate(counts) if n <= budget), budget


def test_budget_answers_over_documents():
    table = token_counts.counter(JSON)
    for (text,) in connect(SF).execute("SELECT text FROM documents WHERE length(text) BETWEEN 1 AND 600 LIMIT 50").fetchall():
        counts, laid = table.prefix_counts(text), table.laid_out(text)
        for budget in range(0, int(counts.max()) + 2, 3):
            assert table.fitting(text, laid[0], laid[2], budget) == np.flatnonzero(counts <= budget)[-1]


@pytest.mark.parametrize("table", [token_counts.counter(JSON).table, piece_codec.codec(MODEL).table])
@pytest.mark.parametrize("word", ["a" * 300, "internationalization" * 9, "-" * 200 + "=" * 90 + "ab", "x\x00\U0001f600" * 40, "\U000e0001" * 20])
def test_long_words_are_settled_alike(table, word):
    symbols = np.frombuffer(word.encode(), np.uint8).astype(np.int64) if table is token_counts.counter(JSON).table else np.array([ord(c) for c in word])
    want = table.prefixes(symbols[None, :])
    for chunk in (1 << 15, 37):
        for p, q in zip(want, table.long_prefixes(symbols, chunk)):
            assert (p[0] == q).all()


def test_a_word_of_a_megabyte_takes_seconds():
    r = np.random.default_rng(0)
    word = "".join(r.choice(list("abcdefghij"), 1_000_000))
    start = time.time()
    token_counts.counter(JSON).learn([word])
    assert time.time() - start < 60 and merge_prefix.LONG < len(word)


def test_one_lower_casing(spark):
    assert toxicity.lowered(__import__("pyarrow").array(["ΟΔΟΣ İ", None])).to_pylist()[1] == ""
    made = [(k, ("plain words " * 5) + ("VileİΣ " if k % 3 == 0 else "") + f"n{k}", int(k % 3 == 0)) for k in range(120)]
    df = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    model = toxicity.fitted(df.drop("toxic"), df.select("doc_id", "toxic"), 40)
    kept = {r["doc_id"] for r in toxicity.filtered(df, model).collect()}
    assert kept == {r["doc_id"] for r in toxicity.scored(df, model).where("predicted = 0").collect()}


def test_toxicity_labels(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(40)], "doc_id long, text string")
    differing = spark.createDataFrame([(k, v) for k in range(40) for v in (0, 1)], "doc_id long, toxic int")
    assert not toxicity.fitted(docs, differing).trained and not toxicity.fitted(docs, differing.where("toxic = 1")).trained
    # Labels of absent documents take no place in the sample.
    many = spark.range(100_000, 140_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    own = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    assert toxicity.fitted(docs, many.unionByName(own), 10).trained


def test_gradients_equal_differences():
    network = toxicity.Network()
    for name in network.p:
        network.p[name] = network.p[name].astype(np.float64)
    f = toxicity.Features.of([f"some words number {k} in a text of words " * 3 for k in range(6)])
    chosen, labels = np.arange(6), np.array([1, 0, 1, 0, 0, 1], np.float64)
    gradients = network.gradients(f, chosen, labels)

    def loss():
        logit = network.logits(f)[chosen].astype(np.float64)
        return np.mean(np.log1p(np.exp(-np.where(labels > 0, logit, -logit))))

    r = np.random.default_rng(0)
    for name in ("u0", "u1", "w", "b", "att", "att_b", "query", "out", "bias"):
        value = network.p[name]
        step = r.standard_normal(value.shape)
        step /= np.linalg.norm(step)
        network.p[name] = value + 0.05 * step
        up = loss()
        network.p[name] = value - 0.05 * step
        down = loss()
        network.p[name] = value
        assert (up - down) / 0.1 == pytest.approx((gradients[name] * step).sum(), rel=0.05, abs=2e-5), name


def test_leaks_equal_a_naive_aligner(spark):
    con = connect(SF)
    docs, items = (con.execute(f"SELECT {c}, text FROM {t}").fetchall() for c, t in (("doc_id", "documents"), ("item_id", "benchmark")))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [(i, words(t)) for i, t in items]
    want = set()
    for doc, text in docs:
        own = words(text)
        at = collections.defaultdict(list)
        for k, w in enumerate(own):
            at[w].append(k)
        for item, own_item in items:
            need = min(13, 0.8 * len(own_item))
            same = collections.defaultdict(set)
            for k, w in enumerate(own_item):
                for p in at.get(w, ()):
                    same[p - k].add(k)
            for places in same.values():
                if len(places) < need:
                    continue
                sums = np.concatenate([[0], np.cumsum([1 if k in places else -2 for k in range(len(own_item))])])
                hits = np.concatenate([[0], np.cumsum([k in places for k in range(len(own_item))])])
                if any(sums[j] >= sums[i] and hits[j] - hits[i] >= need for i in range(len(sums)) for j in range(i + 1, len(sums))):
                    want.add((doc, item))
    made = decontaminate.leaks(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in made} == want and want


def test_license_base_counts_equal_brute_force(spark):
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    docs = connect(SF).execute("SELECT doc_id, text FROM documents").fetchall()
    made = {r["doc_id"]: r for r in license_scan.license_report(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for i, text in docs:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        found = [(k, label) for p, label in phrases.items() for k in range(len(own)) if tuple(own[k : k + len(p)]) == p]
        r = made[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(own), len(found), ",".join(sorted({x for _, x in found})))
        assert (r["first_word"], r["last_word"]) == ((min(found)[0], max(found)[0]) if found else (None, None))


def test_entry_without_a_library():
    code = textwrap.dedent("""
        import sys
        sys.modules["sentencepiece"] = None
        sys.modules["regex"] = None
        import __spark_entry__ as e
        assert len(e.queries()) > 130 and not any(k.startswith("op") for k in e.queries()), len(e.queries())
    """)
    assert subprocess.run([sys.executable, "-c", code], cwd=corpus_pipeline.__file__.rsplit("/", 1)[0], timeout=120).returncode == 0


def test_page_rows(spark):
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string"), {}).collect() == []
