"""The training-data operators against brute force, libraries and round trips, with the cases their docstrings define."""

import collections
import html
import itertools
import re
import struct

import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, connect
from vocalgrid.llm import (
    chat_pairs, decontaminate, html_text, jaccard_join, license_scan, piece_codec, quality, queries, sharding, token_counts, toxicity,
)
from vocalgrid.llm.vocabulary import vocabulary

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "x y z"), (7, "é ñ 日本 " * 3000), (8, "a\nb\n\na")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "s", len(t or ""), "extra") for i, t in ODD], "doc_id long, text string, source string, n_chars long, row_key string")


@pytest.fixture(scope="module")
def docs():
    return connect(SF).execute("SELECT doc_id, text FROM documents").fetchall()


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert compare(spark, connect(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF) is None


def test_chat_cases(spark):
    turns = "array<struct<role:string,text:string>>"
    rows = [(1, [("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "b")]), (2, [("user", "q")], [("user", "q")]), (3, None, [(None, None)])]
    made = {r["i"]: r for r in chat_pairs.format_preferences(spark.createDataFrame(rows, f"i int, chosen {turns}, rejected {turns}")).collect()}
    assert made[1]["n_prompt_turns"] == 1 and made[1]["prompt"] == "<|im_start|>user\nq<|im_end|>\n"
    (span,) = made[1]["chosen_mask"]
    assert made[1]["chosen"][span["start"] : span["end"]] == "a<|im_end|>"
    assert (made[2]["chosen"], made[2]["rejected"]) == ("", "") and made[3]["n_prompt_turns"] == 0 and made[3]["chosen"] == ""


def test_token_counts_equal_the_library(spark, docs, odd):
    import tokenizers

    path = vocabulary("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert {r["doc_id"]: r["n_tokens"] for r in run(spark, "op3_token_counts")} == {i: size(t) for i, t in docs}
    assert sorted(r["n_tokens"] for r in token_counts.token_counts(odd, path).collect()) == sorted(size(t) for _, t in ODD)
    counter = token_counts.counter(path)
    for text in ("don't 'll  x\n\n y<|endoftext|>z", docs[0][1][:150], "日本 é  ", ""):
        assert counter.prefix_counts(text).tolist() == [size(text[:k]) for k in range(len(text) + 1)]


def test_pieces_equal_the_library(spark, docs, odd):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = run(spark, "op8_sentencepiece")
    assert {r["doc_id"]: r["ids"] for r in rows} == {i: library.encode(t or "") for i, t in docs} and all(r["round_trip"] for r in rows)
    texts = piece_codec.decoded(piece_codec.encoded(odd, path), path).select("text").collect()
    assert sorted(r["text"] for r in texts) == sorted(t or "" for _, t in ODD)
    assert piece_codec.codec(path).decode([library.piece_to_id("<0xC3>"), library.piece_to_id("▁a")]) == library.decode([library.piece_to_id("<0xC3>"), library.piece_to_id("▁a")])


def classes(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root, links = list(range(len(rows))), [set() for _ in rows]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both / len(sets[a] | sets[b]) >= threshold:
                root[find(a)] = find(b)
                if sets[a] != sets[b]:
                    links[a].add(sets[b])
                    links[b].add(sets[a])
    groups = collections.defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    return sorted((rows[k][0], min(groups[find(k)]), len(links[k])) for k in range(len(rows)))


def test_near_duplicates(spark, docs, odd, monkeypatch):
    words = [f"w{k}" for k in range(80)]
    planted = [(9000 + k, " ".join([*words[:k], f"z{k}", *words[k + 1 :]])) for k in range(20)] + [(9100, " ".join(words))]
    rows = [*docs, *planted]
    want = classes(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)  # several blocks a group
    got = jaccard_join.near_duplicates(df).collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want
    kept = sorted(r["doc_id"] for r in jaccard_join.deduplicated(df).collect())
    assert kept == sorted({c for _, c, _ in want})
    cases = jaccard_join.near_duplicates(odd).collect()
    assert len(cases) == len(ODD) and {r["n_copies"] for r in cases if r["doc_id"] in (4, 5)} == {3}
    assert jaccard_join.near_duplicates(odd.limit(0)).collect() == []


def test_license_cases(spark, odd):
    texts = [(1, "CC BY cc-by x All rights reserved"), (2, "Released under the MIT License."), (3, "licensed under the new apache license version 2.0"), (4, None)]
    made = {r["doc_id"]: r for r in license_scan.license_report(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert (made[1]["n_base"], made[1]["first_word"], made[1]["last_word"], made[1]["base_labels"]) == (3, 0, 5, "cc-by,reserved")
    assert made[2]["labels"] == "mit" and made[3]["labels"] == "apache" and made[4]["n_words"] == 0 and made[4]["first_word"] is None
    assert license_scan.license_report(odd).count() == len(ODD)


def test_quality_counts(spark, docs, odd):
    def brute(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = list(zip(w, w[1:], w[2:]))
        often = {g for g, n in collections.Counter(grams).items() if n > 1}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        covered = {k + j for k, g in enumerate(grams) if g in often for j in range(3)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)

    shown = lambda r: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
    assert {r["doc_id"]: shown(r) for r in run(spark, "op6_quality_rules")} == {i: brute(t) for i, t in docs}
    assert sorted(map(shown, quality.quality_report(odd).collect())) == sorted(brute(t) for _, t in ODD)


def test_frequent_lines_go_and_depleted_documents_too(spark):
    own = lambda k: " ".join(f"own{k}w{j}" for j in range(60))
    rows = [(k, f"Menu  Home\n{own(k)}", "h") for k in range(30)] + [(100, "menu home\n" * 40 + "two words", "h"), (101, "menu home\n" + own(101), "other")]
    made = {r["doc_id"]: r for r in quality.quality_filtered(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert made[3]["text"] == own(3) and 100 not in made and made[101]["text"].startswith("menu home")


@pytest.mark.parametrize("shared", [2, 5])
def test_shared_lines_count_every_different_document(spark, shared):
    menu = "\n".join(f"Menu entry {k}" for k in range(shared))
    own = lambda k: " ".join(f"own{k}w{j}" for j in range(60))
    copies = [(500 + k, "copied line one\n" + own("c") + "\n" + own("d"), "h") for k in range(40)]
    rows = [(k, f"{menu}\n{own(k)}", "h") for k in range(21)] + [(100, "\n".join([menu] * 20) + "\ntwo words", "h")]
    rows += [(k, f"Rare entry\n{own(k)}", "h") for k in range(200, 220)] + copies
    made = {r["doc_id"]: r["text"] for r in quality.quality_filtered(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert made == {i: own(i) if i < 100 else t for i, t, _ in rows if i != 100}


def test_leaks(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi"
    changed = item.replace("zeta", "other").split()
    rows = [(1, "x y " + item), (2, "x " + " ".join(changed) + " y"), (3, "alpha beta gamma delta and so on"), (4, None), (5, "")]
    made = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, item), (9, None)], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["doc_word"], r["n_equal"]) for r in made) == [(1, 7, 2, 16), (1, 8, 2, 16), (2, 7, 1, 15), (2, 8, 1, 15)]


def test_leaks_wherever_the_substituted_words_stand(spark):
    def planted(n, k, step=1):
        for c in list(itertools.combinations(range(n), k))[::step]:
            yield n, n - k, "x y " + " ".join(f"z{j}" if j in c else f"i{n}w{j}" for j in range(n)) + " u v"

    texts = [*planted(15, 2), *planted(15, 3), *planted(16, 3), *planted(20, 5, 31), *planted(19, 6, 53), *planted(5, 1), *planted(6, 1), *planted(3, 0), *planted(2, 0), *planted(1, 0)]
    clean = [*planted(15, 4, 13), *planted(16, 4, 17), *planted(20, 8, 997), *planted(5, 2), *planted(4, 1), *planted(3, 1)]
    docs = spark.createDataFrame([(k, t) for k, (_, _, t) in enumerate(texts + clean)], "doc_id long, text string")
    items = spark.createDataFrame([(n, " ".join(f"i{n}w{j}" for j in range(n))) for n in (1, 2, 3, 4, 5, 6, 15, 16, 19, 20)], "item_id long, text string")
    made = decontaminate.leaks(docs, items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in made) == [(k, n) for k, (n, _, _) in enumerate(texts)]
    for r in made:
        n, same, text = texts[r["doc_id"]]
        found = text.split()[r["doc_word"] : r["doc_word"] + r["n_words"]]
        assert r["doc_word"] == r["item_word"] + 2 and min(13, 0.8 * n) <= r["n_equal"] <= same and sum(w[0] == "i" for w in found) == r["n_equal"]


def test_page_text(spark):
    got = {r["page_id"]: r["text"] for r in run(spark, "op7_html_text")}
    for page, text in connect(SF).execute("SELECT page_id, html FROM pages").fetchall():
        body = re.search(r"<article>(.*?)(</article|$)", text, re.S)[1]
        body = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br|div|ul|li)\b[^>]*>", " ", body))
        assert got[page] == " ".join(html.unescape(body).split())
    assert html_text.main_text(None, {}) == "" and html_text.main_text("<p>a<b>b</b>\n c&amp;</p><nav>no</nav>", {}) == "ab c&"


@pytest.mark.parametrize("wrapped", [
    '<div class="content has-sidebar">%s</div>', '<div id="page" class="with-header">%s</div>', '<form action="/"><input>%s</form>', '<div class="page no-menu widget">%s</div>',
    "<div><div class=ad>Buy<p></p>%s</div>", "<div><nav><ul><li><a href=x>Home</a></ul>%s</div>", "<html><head><meta><body>%s",
])
@pytest.mark.parametrize("mark", ["<article>%s</article>", "%s"])
def test_wrappers_and_unclosed_elements_keep_the_article(wrapped, mark):
    body = " ".join(f"word{k}" for k in range(40))
    page = "<nav><a href=x>Away</a></nav>" + wrapped % (mark % f"<p>{body}</p><div class='ad'>Advert text</div><p>{body}</p>") + "<footer>Imprint</footer>"
    for shares in ({}, {"outside": 0.0, "a": 0.0}):
        got = html_text.main_text(page, shares)
        assert f"{body} {body}" in got and not re.search("Advert|Away|Imprint", got)


def test_shards(spark, odd):
    import xxhash

    def feistel(x, n, seed):
        a, b = sharding.grid(n)
        signed = lambda v: struct.unpack("<q", struct.pack("<Q", v))[0]
        mixed = lambda v, k: signed(xxhash.xxh64_intdigest(struct.pack("<i", seed * sharding.ROUNDS + k) , xxhash.xxh64_intdigest(struct.pack("<q", v), 42)))
        while True:
            left, right = divmod(x, b)
            for k in range(sharding.ROUNDS):
                if k % 2 == 0:
                    left = (left + mixed(right, k) % a) % a
                else:
                    right = (right + mixed(left, k) % b) % b
            x = left * b + right
            if x < n:
                return x

    n = 1000
    rows = spark.range(n).select("id", sharding.permuted(F.col("id"), n, 7).alias("p")).collect()
    assert sorted(r["p"] for r in rows) == list(range(n)) and all(r["p"] == feistel(r["id"], n, 7) for r in rows)
    back = spark.range(n).select("id", sharding.unpermuted(sharding.permuted(F.col("id"), n, 7), n, 7).alias("q")).collect()
    assert all(r["id"] == r["q"] for r in back)
    for made in (run(spark, "op10_shards"), sharding.document_shards(odd).collect()):
        slots = collections.defaultdict(list)
        for r in made:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        sizes = [len(slots[k]) for k in range(24)]
        assert max(sizes) - min(sizes) <= 1
    assert sharding.document_shards(odd.limit(0)).collect() == []


def test_toxicity_learns_and_holds_out(spark, odd):
    made = [(k, ("plain words of some text " * 4) + ("vileword99 " if k % 3 == 0 else "") + f"n{k}", int(k % 3 == 0)) for k in range(240)]
    df = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    model = toxicity.fitted(df.drop("toxic"), df.select("doc_id", "toxic"))
    rows = toxicity.scored(df, model).join(df, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert rows and all(r["predicted"] == r["toxic"] for r in rows)
    cases = toxicity.scored(odd, model).collect()
    assert len(cases) == len(ODD) and all(0 <= r["score"] <= 1 for r in cases)
    assert {r["score"] for r in toxicity.scored(odd, toxicity.Network()).collect()} == {0.0}


def test_pipeline_stages_follow_their_operators(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        made = stage(spark, docs, SF)
        assert made.columns == docs.columns, name
    kept = {r["doc_id"] for r in quality.quality_report(docs).where("kept").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).collect()} == kept
    leaking = {r["doc_id"] for r in run(spark, "op9_decontaminate")}
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[3][1](spark, docs, SF).collect()} == {r["doc_id"] for r in docs.collect()} - leaking
    assert run(spark, "pipeline")
