"""The pipeline against a plain restatement of its stages; only the trained classifier's decisions are taken over."""

import hashlib
import math
import re
from collections import defaultdict

import numpy as np

from tests.llm.test_near_dedup import plain_groups

DIR = "/root/testdata/sf0.001"


def plain_line_dedup(docs):
    places = defaultdict(list)
    for i, text in sorted(docs.items()):
        lines = text.split("\n")
        for k in range(len(lines) - 2):
            if "".join(lines[k : k + 3]).strip(" \t\r"):
                places["\n".join(lines[k : k + 3])].append((i, k))
    gone = defaultdict(set)
    for at in places.values():
        for i, k in sorted(at)[1:]:
            gone[i] |= {k, k + 1, k + 2}
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in docs.items()}


def plain_near_dedup(docs):
    low = plain_groups(list(docs.items()))
    return {i: t for i, t in docs.items() if low[i] == i}


def plain_mixing(docs, source, limit, seed=7):
    tokens = {i: max(1, len(re.findall(r"[^\x20\x09-\x0D]+", t))) for i, t in docs.items()}
    per = defaultdict(int)
    for i, n in tokens.items():
        per[source[i]] += n
    total = sum(per.values())
    share = {s: n / total for s, n in per.items()}

    def weights(a):
        z = sum(p**a for p in share.values())
        return {s: p**a / z for s, p in share.items()}

    def entropy(a):
        return -sum(w * math.log(w) for w in weights(a).values())

    def repetition(a):
        r = [w / share[s] for s, w in weights(a).items()]
        return max(r) / min(r)

    def largest(holds):
        low = 0
        for bit in range(31, -1, -1):
            low += (1 << bit) * holds((low + (1 << bit)) / 2**32)
        return low

    goal = entropy(1) + 0.5 * (math.log(len(per)) - entropy(1))
    low = largest(lambda a: repetition(a) > limit)
    a = max(largest(lambda x: entropy(x) >= goal), low + 1 if low else 0) / 2**32
    w = weights(a)
    budget = max(per[s] / w[s] for s in per)
    out = []
    for s, n in per.items():
        quota = max(n, round(w[s] * budget))
        own = [i for i in docs if source[i] == s]
        out += own * (quota // n)
        left = quota % n
        for i in sorted(own, key=lambda i: (hashlib.md5(f"{seed}:{quota // n}:{i}".encode()).hexdigest(), str(i))):
            if tokens[i] > left:
                break
            left -= tokens[i]
            out.append(i)
    return out


def test_pipeline(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from gristmill.llm.quality import quality_scores
    from gristmill.llm.queries import tokenizer_path

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "bpe"]
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, DIR).collect())
    rows = {r["doc_id"]: r for r in quality_scores(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")).where("keep").collect()}
    docs = plain_near_dedup(plain_line_dedup({i: r["text"] for i, r in rows.items()}))
    mixed = plain_mixing(docs, {i: r["source"] for i, r in rows.items()}, 2.0)
    assert set(mixed) == set(docs)
    t, want = Tokenizer.from_file(tokenizer_path()), {}
    for i, text in docs.items():
        ids = t.encode(text, add_special_tokens=False).ids
        want[i] = (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert got == sorted(want[i] for i in mixed)


def test_clean_documents_stay(spark):
    """Of the documents labelled good, next to none are rejected; most that are labelled bad are."""
    from gristmill.llm.quality import quality_scores

    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = quality_scores(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").collect()
    good, bad = [r["keep"] for r in rows if r["quality"] == 1], [r["keep"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2
