"""The Markov models of op8 are counted over all documents."""

import random
import re
import string
import time


def test_rare_secrets_are_counted(spark):
    """Ten documents with a secret, none of them among the 4,000 of 40,000 that a hash of the id would choose."""
    from pyspark.sql import functions as F

    from gristmill.llm.secret_scan import secret_scan

    rng = random.Random(2)
    key = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    names = ["internationalization_of_names", "getCustomerAccountBalance", "the_quick_brown_fox_jumps", "configurationManagerFactory"]
    ids = spark.range(40_000).where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 20)) > (1 << 20) // 2).limit(11).collect()
    ids = [r["id"] for r in ids]
    special = {i: f"token={key(400)}" for i in ids[:10]} | {ids[10]: f"see {key(40)} there"}
    docs = spark.createDataFrame([(i, special.get(i, names[i % 4])) for i in range(40_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_markov"] for r in secret_scan(docs).where(F.col("doc_id").isin(ids[10], 1)).collect()}
    assert got[ids[10]] == 1


def plain_markov(text, scores, base, least_total=12.0, least_mean=0.6):
    spans = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text):
        if any(a < m.end() and m.start() < b for a, b in base):
            continue
        total = sum(round(scores[x + y], 4) for x, y in zip(m[0], m[0][1:]))
        if total >= least_total and total / (len(m[0]) - 1) >= least_mean:
            spans.append((m.start(), m.end()))
    return spans


def test_added_spans_against_a_plain_restatement(spark):
    from gristmill.llm.secret_scan import pair_scores, secret_scan

    rng = random.Random(8)
    key = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    names = ["internationalization_of_names", "getCustomerAccountBalance", "the_quick_brown_fox_jumps", "1234567890123456", "a-long-dashed-identifier"]
    rows = [(i, " ".join(rng.choice([rng.choice(names), f"token={key(24)}", key(rng.randint(14, 40)), f"{key(10)}token={key(9)}"]) for _ in range(rng.choice([1, 12, 600])))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = pair_scores(docs, "text")
    for r in secret_scan(docs).collect():
        text = dict(rows)[r["doc_id"]]
        parts = [s.split(":") for s in r["spans"].split(",") if s]
        base = [(int(a), int(b)) for k, a, b in parts if k != "markov"]
        assert [(int(a), int(b)) for k, a, b in parts if k == "markov"] == plain_markov(text, scores, base)


def test_a_run_of_a_megabyte_is_linear(spark):
    from gristmill.llm.secret_scan import secret_scan

    rng = random.Random(9)
    key = lambda n: "".join(rng.choices(string.ascii_letters + string.digits, k=n))
    rows = [(2 + i, f"see internationalization_of_names token={key(64)} getCustomerAccountBalance") for i in range(100)]
    docs = spark.createDataFrame([*rows, (1, f"blob {key(1_000_000)} end")], "doc_id long, text string")
    began = time.monotonic()
    got = {r["doc_id"]: r["spans"] for r in secret_scan(docs).collect()}
    assert got[1] == "markov:5:1000005" and time.monotonic() - began < 30
