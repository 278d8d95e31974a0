"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep string, epoch int, blocks int, rest int, h string, doc string, pos int, fp string, n_tokens string, score string"
LONG = "word and another line of text\n" * 4000 + "x" * 30_000


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), "clash", 1, 2, 3, "h", "d", 4, "fp", "n", "s")


DATA = [
    row(1, "one two three four five six\nseven eight nine\nten eleven twelve\nthirteen"), row(2, None), row(3, ""), row(4, LONG), row(5, LONG, None, None), row(None, "one two three four five six\nseven eight nine"),
    row(6, "one two three four five six\nseven eight nine\nten eleven twelve\nthirteen", source=None), row(1, "one two three four five six\nseven eight nine\nten eleven twelve\nthirteen"), row(7, " \n \n \n"), row(8, "é中🙂 <|endoftext|>   x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    from gristmill.llm.common import importable

    importable(spark)
    return spark.createDataFrame(DATA, SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "x"), (4, 0, 1, "x"), (None, 1, 1, "x"), (6, None, None, "x"), (5, 0, 1, "x"), (5, 0, 1, "x")], "doc_id long, quality int, toxic int, text string")


def test_media(docs, empty):
    from gristmill.llm.media_columns import media_columns

    got = media_columns(docs).collect()
    assert len(got) == len(DATA)
    by = {r["doc_id"]: r for r in got}
    assert (by[2]["n_bytes"], by[2]["payload_bytes"]) == (0, 576) and by[2]["payload_sha256"] == by[3]["payload_sha256"]
    assert by[4]["shard"] == by[5]["shard"] and by[4]["offset"] == by[5]["offset"] and by[4]["n_bytes"] == len(LONG)
    assert media_columns(empty).count() == 0


def test_damaged_payload_is_noticed(spark, docs):
    from gristmill.llm.media_columns import decode_grey, encode_grey

    image = bytearray(encode_grey(b"a" * 1152))
    assert decode_grey(bytes(image)).tobytes() == b"a" * 1152
    image[50] ^= 1
    with pytest.raises(ValueError):
        decode_grey(bytes(image))


def test_token_counts(docs, empty):
    from gristmill.llm.token_counts import LongestMatch, token_counts

    machine = LongestMatch([b"a", b"abc", b"ab"], [b"c", b"d", b"cd"])
    assert machine.counts([b"abcd", b"abd", b"acd", b"x", b"", b"abcx", b"aa"]).tolist() == [2, 2, 2, -1, 0, -1, -1]
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"], r["n_unknown"]) for r in token_counts(docs, machine, prefix=b"").collect()}
    assert got[2] == got[3] == got[7] == (0, 0, 0) and got[8][0] == got[8][2]
    assert token_counts(empty, machine).count() == 0


def test_one_very_long_word_among_many():
    import time

    from gristmill.llm.token_counts import LongestMatch

    machine = LongestMatch([b"a", b"ab", b"abc", b"b", b"c"])
    words = [b"abc"] * 50_000 + [b"abcab" * 20_000]
    began = time.monotonic()
    assert machine.counts(words).tolist() == [1] * 50_000 + [40_000]
    assert time.monotonic() - began < 30


def test_greedy_piece_counts_on_random_vocabularies():
    import random

    from gristmill.llm.token_counts import LongestMatch

    rng = random.Random(2)
    for _ in range(60):
        word = lambda n: bytes(rng.choice(b"abc") for _ in range(rng.randint(1, n)))
        first, rest = {word(4) for _ in range(6)}, {word(4) for _ in range(6)}
        machine = LongestMatch(first, rest)
        words = [word(9) for _ in range(80)]

        def plain(w):
            n = i = 0
            while i < len(w):
                j = len(w)
                while j > i and w[i:j] not in (first if i == 0 else rest):
                    j -= 1
                if j == i:
                    return -1
                n, i = n + 1, j
            return n

        assert machine.counts(words).tolist() == [plain(w) for w in words]


def test_simhash(docs, empty):
    from gristmill.llm.simhash import keep_one, simhash_components

    got = simhash_components(docs).collect()
    assert len(got) == len(DATA)
    by = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got}
    assert by[2] == by[3] == by[7] == ("0" * 16, 2)
    assert by[6][1] == 1 and by[5][1] == 4
    assert simhash_components(empty).count() == 0
    kept = keep_one(docs)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "2", "4", "8", "None"] and kept.columns == docs.columns


def test_simhash_tiles_do_not_change_components(spark):
    from gristmill.llm.simhash import simhash_components

    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 5
    rows = [(i, text + f"tail{i % 7} end{i % 3}") for i in range(60)] + [(100 + i, f"other {i} words {i * i} here {i + 1} now") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one = {r["doc_id"]: r["component_id"] for r in simhash_components(df).collect()}
    many = {r["doc_id"]: r["component_id"] for r in simhash_components(df, tile_rows=5).collect()}
    assert one == many and len({one[i] for i in range(60)}) < 21


def test_components_of_chains_and_stars(spark):
    from gristmill.llm.components import connected_components

    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (300, 200), (200, 250)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 250: 200, 300: 200}


def test_quality(docs, empty, labels):
    from gristmill.llm.quality import quality_scores

    got = quality_scores(docs, labels)
    assert got.columns == [*[c for c in docs.columns if c != "keep"], "text_score", "meta_score", "quality_score", "keep"]
    assert got.count() == len(DATA)
    assert quality_scores(empty, labels).count() == 0
    unlabelled = quality_scores(docs, labels.where("false")).collect()
    assert all(r["quality_score"] == 1.0 and r["keep"] for r in unlabelled)


def test_toxicity(docs, empty, labels):
    from gristmill.llm.toxicity import toxicity_scores

    got = toxicity_scores(docs, labels).collect()
    assert len(got) == len(DATA) and all(0 <= r["score"] <= 1 for r in got)
    assert not next(r["held_out"] for r in got if r["doc_id"] is None)
    assert toxicity_scores(empty, labels).count() == 0
    assert {r["score"] for r in toxicity_scores(docs, labels.where("false")).collect()} == {0.0}


def test_toxicity_reads_through_disguise(spark):
    from gristmill.llm.toxicity import toxicity_scores

    words = ["the plain old dog ran over a hill", "some idiot ran over the hill", "a clown is a moron and an idiot", "every good day is an open hour or some such"]
    rows = [(i, f"{words[i % 4]} number {i}") for i in range(400)] + [(1000, "such an 1d10t here"), (1001, "what an i d i o t here"), (1002, "you are an idiooot"), (1003, "such an idea here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 4 in (1, 2) else 0) for i in range(400)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity_scores(docs, labels).where("doc_id >= 1000").collect()}
    assert got == {1000: 1, 1001: 1, 1002: 1, 1003: 0}


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    from gristmill.llm.bpe_chunks import ChunkedBPE, encode_documents
    from gristmill.llm.queries import tokenizer_path

    t = Tokenizer.from_file(tokenizer_path())
    got = {r["doc_id"]: list(r["ids"]) for r in encode_documents(docs, tokenizer_path(), with_ids=True).collect()}
    for r in DATA:
        assert got[r[0]] == (t.encode(r[1] or "", add_special_tokens=False).ids if r[0] is not None else got[None])
    assert encode_documents(empty, tokenizer_path()).count() == 0
    import random

    rng, parts = random.Random(4), ["the ", " of", "'s", "'re", " ", "  ", "\n", " ", "é", "中", "🙂", "12", "!", "word", "<|endoftext|>", "I'll ", "\t", " x"]
    coder = ChunkedBPE(tokenizer_path(), bits=3)
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(300)))
        ids = coder.encode(text)
        assert ids == t.encode(text, add_special_tokens=False).ids and coder.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_mixing(docs, empty):
    from pyspark.sql import functions as F

    from gristmill.llm.mixing import mix_sources

    plain = mix_sources(docs, entropy_share=None, repetition_limit=None)
    assert plain.count() == len(DATA) and {r["epoch"] for r in plain.collect()} == {0}
    even = mix_sources(docs, entropy_share=1.0, repetition_limit=None, cover=True)
    assert even.where("epoch = 0").count() == len(DATA)
    assert {"blocks", "rest", "h"} <= set(even.columns)
    tokens = {r["source"]: r["n"] for r in even.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert len(tokens) == 2
    limited = mix_sources(docs, entropy_share=1.0, repetition_limit=2.0, cover=True)
    assert limited.agg(F.max("epoch")).first()[0] <= 2
    assert mix_sources(empty).count() == 0


def test_mixing_budget_is_met(spark):
    from pyspark.sql import functions as F

    from gristmill.llm.mixing import mix_sources

    df = spark.range(3000).selectExpr("id as doc_id", "case when id % 10 < 7 then 'hot' when id % 10 < 9 then 'b' else 'c' end as source", "repeat('w ', 9) || 'w' as text")
    out = mix_sources(df, budget_tokens=20_000, entropy_share=0.8, bucket_rows=1)
    got = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert 20_000 - 3 * 11 <= sum(got.values()) <= 20_000
    assert got["hot"] < 14_000 and got["c"] > 2_000
    again = mix_sources(df.repartition(7), budget_tokens=20_000, entropy_share=0.8, bucket_rows=100_000)
    key = lambda d: sorted((r["doc_id"], r["epoch"]) for r in d.collect())
    assert key(out) == key(again)


def test_secret_scan(spark, docs, empty):
    from gristmill.llm.secret_scan import secret_scan

    assert secret_scan(docs).count() == len(DATA)
    assert secret_scan(empty).count() == 0
    texts = [
        "é🙂 password = 'hunter22' and TOKEN:abc, api_key=\"Zz9/x+Zz9\"", "secret: abc, token=ab", "AKIA" + "A" * 16 + " AKIAshort " + "a1" * 12, "token=abcdef " * 700, None, "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_assign"], r["n_access"], r["n_hex"], r["base"]) for r in secret_scan(df).collect()}
    assert got[0] == (2, 0, 0, "assign:3:23,assign:40:58")
    assert got[1] == (0, 0, 0, "")
    assert got[2] == (0, 1, 1, "access:0:20,hex:31:55")
    assert got[3][0] == 700 and got[3][3].split(",")[-1] == f"assign:{13 * 699}:{13 * 699 + 12}"
    assert got[4] == got[5] == (0, 0, 0, "")


def test_markov_finds_random_strings(spark):
    import random

    from gristmill.llm.secret_scan import secret_scan

    rng = random.Random(1)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    names = ["internationalization_of_names", "getCustomerAccountBalance", "the_quick_brown_fox_jumps", "configurationManagerFactory"]
    rows = [(i, f"{rng.choice(names)} token={key(32)} {rng.choice(names)}") for i in range(300)] + [(1000, f"see {key(40)} there"), (1001, "see customerConfigurationFactory there")]
    got = {r["doc_id"]: r["spans"] for r in secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 1000").collect()}
    assert got == {1000: "markov:4:44", 1001: ""}


def test_line_dedup(docs, empty):
    from gristmill.llm.line_dedup import line_dedup

    got = line_dedup(docs)
    rows = got.collect()
    assert len(rows) == len(DATA) and set(docs.columns) <= set(got.columns)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["text"], r["n_lines"], r["n_removed"]))
    assert by[1] == [(DATA[0][1], 4, 0)] * 2
    assert by[6] == [("", 4, 4)]
    assert by[2] == [(None, 0, 0)] and by[3] == [("", 1, 0)] and by[7] == [(" \n \n \n", 4, 0)]
    assert by[4][0][0].startswith("word and another") and by[4][0][2] > 3990 and by[5][0][0] == ""
    assert line_dedup(empty).count() == 0


def test_lattice(spark):
    from gristmill.llm.lattice import embedding_links

    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 1.0]), (7, [inf, 1.0, 0.0]), (8, [None, 1.0, 0.0]), (9, []), (10, [1.0, 0.0]), (None, [5.0, 5.0, 5.0]), (11, [1.0, 0.0, 0.0]), (12, [0.99, 0.1, -0.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label string, node int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_links(df).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[11] == (3, 1, False) and got[12] == (3, 1, False)
    for i in (3, 4, 5, 6, 7, 8, 9, 10):
        assert got[i] == (0, i, True)
    assert got[None][0] == 0
    assert embedding_links(df.where("false")).count() == 0
    assert embedding_links(df.where("vec_id = 4")).count() == 1


def test_pipeline_stages(spark, docs, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, table in (("some", docs), ("none", docs.where("false"))):
        at = table.select("doc_id", "text", "lang", "source", "n_chars", "keep", "epoch")
        counts = []
        for k, (stage, run) in enumerate(corpus_pipeline.STAGES):
            at = run(spark, at, str(tmp_path))
            at.write.parquet(str(tmp_path / f"{name}-{k}"))
            at = spark.read.parquet(str(tmp_path / f"{name}-{k}"))
            counts.append(at.count())
            if k < 4:
                assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert counts == [0] * 5 if name == "none" else counts[0] == counts[1] >= counts[2] <= counts[3] == counts[4]


def test_lattice_lengths_magnitudes_and_null_ids(spark):
    """Links that only null, zero and non-finite vectors may lack."""
    from gristmill.llm.lattice import embedding_links

    rows = [(k, [1.0, float(k), 0.5, 0.25]) for k in range(20, 40)]  # the usual length
    rows += [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0])]
    rows += [(4, [1e-170, 0.0, 0.0]), (5, [2e-170, 0.0, 0.0]), (6, [1e200, 0.0, 0.0]), (7, [2e200, 1e199, 0.0]), (8, [5e-324, 0.0, 5e-324])]
    rows += [(9, [0.3, 0.4, 0.5, 0.6, 0.7]), (None, [0.3, 0.4, 0.5, 0.6, 0.7]), (None, [9.0, 0.0, 0.0, 0.0, 0.0]), (None, [9.0, 0.0, 0.0, 0.0, 0.0])]
    got = embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None}
    assert by[1] == (1, 1) and by[2] == (1, 1) and by[3] == (0, 3)
    assert by[4] == by[5] == by[6] == by[7] == (3, 4) and by[8] == (0, 8)
    assert by[9] == (1, 9)
    assert sorted((r["n_links"], r["component_id"] or 0) for r in got if r["vec_id"] is None) == [(1, 0), (1, 0), (1, 9)]


def test_lattice_crowd_of_near_copies(spark):
    """A cell of many near copies goes in slots, and every link in it is counted once."""
    import numpy as np

    from gristmill.llm.lattice import embedding_links

    rng = np.random.default_rng(6)
    x = (rng.standard_normal(64) + 0.05 * rng.standard_normal((3000, 64))).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = embedding_links(df, slot_rows=512).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(2999, 0)}


def test_line_dedup_of_texts_that_share_an_id(spark):
    """No text is lost: rows of one id and other texts are documents of their own, equal rows one."""
    from gristmill.llm.line_dedup import line_dedup

    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "x\na\nb\nc"), (2, "p\nq\nr"), (2, "p\nq\nr"), (3, "p\nq\nr\ns")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup(df).collect())
    assert got[:2] in ([(1, ""), (1, "x\na\nb\nc")], [(1, "a\nb\nc"), (1, "x")])
    assert got[2:] == [(2, "p\nq\nr"), (2, "p\nq\nr"), (3, "s")]


def test_mixing_stays_in_budget_among_equal_rows(spark):
    """Twenty equal rows of three tokens and a budget of thirty: so many are dealt as when the ids differ."""
    from gristmill.llm.mixing import mix_sources

    for rows in ([(1, "a b c", "s")] * 20, [(i, "a b c", "s") for i in range(20)], [(None, "a b c", "s")] * 20, [(None, f"a b {i}", "s") for i in range(20)]):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
        got = mix_sources(df, budget_tokens=30)
        assert got.count() == 10 and got.columns == ["doc_id", "text", "source", "n_tokens", "epoch", "order_key"]
    # two sources, one of equal rows, and more than one block
    rows = [(1, "a b c", "s")] * 30 + [(i, "d e", "t") for i in range(10, 20)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), budget_tokens=200).groupBy("source").sum("n_tokens").collect()
    assert all(150 <= sum(r[1] for r in got) <= 200 for _ in got) and len({r["order_key"] for r in mix_sources(spark.createDataFrame([(None, f"a {i}", "s") for i in range(9)], "doc_id long, text string, source string")).collect()}) == 9
