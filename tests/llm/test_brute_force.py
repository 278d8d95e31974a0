"""Each operator whose result SQL cannot state, against a plain restatement of its rule."""

import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def queries(spark):
    from gristmill.llm import queries as q

    return q.QUERIES


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]


def test_media(spark, queries, docs):
    got = {r["doc_id"]: r for r in queries["op1_media_columns"](spark, DIR).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        data = text.encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert (r["media_width"], r["media_height"]) == (576, len(payload) // 576)
        # the stored form, restated: a filter byte before each row of 576 samples, deflated between a header and an end
        rows = b"".join(b"\0" + payload[k : k + 576] for k in range(0, len(payload), 576))
        parts = [(b"IHDR", struct.pack(">IIBBBBB", 576, len(payload) // 576, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(rows, 4)), (b"IEND", b"")]
        image = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)
        assert (r["media_bytes"], r["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest())
        x = np.frombuffer(payload, np.uint8)
        cells = [int(x[k * len(x) // 64 : (k + 1) * len(x) // 64].astype(np.int64).sum()) * 64 > int(x.astype(np.int64).sum()) for k in range(64)]
        ahash = sum(1 << (63 - k) for k, c in enumerate(cells) if c)
        assert r["feature"] == f"mean={x.mean():.6f};std={x.std():.6f};filler={(x == 255).mean():.6f};ahash={ahash:016x}"
        assert r["shard"].endswith(".tar") and r["offset"] % 512 == 0


def test_token_counts(spark, queries, docs):
    from gristmill.llm.queries import tokenizer_path
    from gristmill.llm.token_counts import byte_vocabulary

    pieces = byte_vocabulary(tokenizer_path())
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"], r["n_unknown"]) for r in queries["op2_token_counts"](spark, DIR).collect()}
    memo = {}

    def greedy(word):
        n = i = 0
        while i < len(word):
            j = len(word)
            while word[i:j] not in pieces:
                j -= 1
            n, i = n + 1, j
        return n

    for i, text in docs:
        words = text.encode().split()
        for w in words:
            if w not in memo:
                memo[w] = greedy(b" " + w)
        assert got[i] == (len(words), sum(memo[w] for w in words), 0)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def smallest_reachable(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash(spark, queries, docs):
    fp = {i: plain_fingerprint(t) for i, t in docs}
    x = np.array(list(fp.values()), np.uint64)
    ids = list(fp)
    near = np.argwhere(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)
    want = smallest_reachable(ids, [(ids[a], ids[b]) for a, b in near])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries["op3_simhash"](spark, DIR).collect()}
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in ids}


def test_bpe(spark, queries, docs):
    from tokenizers import Tokenizer

    from gristmill.llm.queries import tokenizer_path

    t = Tokenizer.from_file(tokenizer_path())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries["op6_bpe"](spark, DIR).collect()}
    for i, text in docs:
        ids = t.encode(text, add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def plain_base(text):
    spans = []
    for m in re.finditer(r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def test_secret_scan(spark, queries, docs):
    names = ("assign", "access", "hex")
    got = {r["doc_id"]: r for r in queries["op8_secret_scan"](spark, DIR).collect()}
    for i, text in docs:
        spans = plain_base(text)
        listed = [f"{names[k]}:{a}:{b}" for a, k, b in spans]
        r = got[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for _, k, _ in spans) for n in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        every = [s for s in r["spans"].split(",") if s]
        assert [s for s in every if not s.startswith("markov")] == listed
        assert len(every) == len(listed) + r["n_markov"]


def test_lattice(spark, queries):
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").collect()
    ids = [r["vec_id"] for r in rows]
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    want = smallest_reachable(ids, [(ids[a], ids[b]) for a, b in np.argwhere(near)])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in queries["op10_lattice"](spark, DIR).collect()}
    assert got == {i: (int(near[k].sum()), want[i], want[i] == i) for k, i in enumerate(ids)}


def test_lattice_recall_on_close_pairs(spark):
    """Planted pairs at cosine 0.9 to 1 and a crowd of near copies, with equal vectors among them."""
    from gristmill.llm.lattice import embedding_links

    rng = np.random.default_rng(3)

    def near(a, c):
        b = rng.standard_normal(a.shape)
        b -= (a * b).sum(1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        return c * a + np.sqrt(1 - c * c) * b

    unit = lambda n: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.standard_normal((n, 64)))
    base = unit(150)
    crowd = near(np.repeat(unit(1), 120, axis=0), 0.97)
    x = np.concatenate([base, near(base, 0.905), near(base[:80], 0.94), crowd, crowd[:10], unit(100)]).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_links(df, slot_rows=64).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(axis=1) - 1
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= links).all()
    assert found.sum() >= 0.95 * links.sum()
    # members of the crowd that are surely close have every link counted once
    sure = slice(380, 510)
    assert (found[sure] <= links[sure]).all() and found[sure].sum() >= 0.98 * links[sure].sum()


def test_lattice_recall_of_planted_pairs_alone(spark):
    """No crowd: every vector has its planted partner or none, so a lost pair shows."""
    from gristmill.llm.lattice import embedding_links

    rng = np.random.default_rng(12)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    n, low, high = 1500, unit(rng.standard_normal((1500, 64))), unit(rng.standard_normal((1500, 64)))
    apart = [unit(b - (a * b).sum(1, keepdims=True) * a) for a, b in ((low, rng.standard_normal((n, 64))), (high, rng.standard_normal((n, 64))))]
    c = rng.uniform(0.9001, 0.905, (n, 1))
    x = np.concatenate([low, c * low + np.sqrt(1 - c * c) * apart[0], high, 0.94 * high + np.sqrt(1 - 0.94**2) * apart[1]])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_links(df).collect()}
    close = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert (close == 1).all() and all(got[i][0] <= 1 for i in range(4 * n))
    for first, least in ((0, 0.95), (2 * n, 0.98)):
        pairs = [(got[first + k], got[first + n + k]) for k in range(n)]
        assert all(a == b for a, b in pairs if a[0] or b[0])
        assert np.mean([a[0] for a, _ in pairs]) >= least


def test_toxicity_held_out(spark, queries):
    d = "/root/testdata/sf0.01"
    y = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = queries["op5_toxicity"](spark, d).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["score"], y[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in y]
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    auc = np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])
    assert auc > 0.9


def test_quality_held_out(spark, queries):
    """Labels of every fifth document are hidden from the fit."""
    from gristmill.llm.quality import quality_scores

    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = quality_scores(docs, labels.where("doc_id % 5 <> 0")).join(labels.where("doc_id % 5 = 0"), "doc_id").collect()
    right = np.mean([r["keep"] == (r["quality"] == 1) for r in scored])
    assert right > 0.95
