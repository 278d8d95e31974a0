"""op4 against a plain restatement: hashed views written out, and the rounds in one process."""

import zlib

import numpy as np

DIR = "/root/testdata/sf0.001"
MASK = (1 << 32) - 1


def plain_slots(hashes, slots):
    n = [0] * slots
    for h in hashes:
        h = ((h ^ (h >> 15)) * 0x2C1B3C6D) & MASK
        n[(h ^ (h >> 12)) % slots] += 1
    return [(x / max(1, len(hashes))) ** 0.5 for x in n]


def plain_ngrams(text):
    """Words, and runs of four bytes, lower-cased in ASCII and hashed."""
    from gristmill.llm.quality import GRAM_SLOTS, WORD_SLOTS

    data = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    words = []
    for w in data.split():
        h, power = 0, [pow(1_000_003, k + 1, 1 << 32) for k in range(64)]
        for k, b in enumerate(w):
            h = (h + b * power[k & 63]) & MASK
        words.append(h)
    grams = [int.from_bytes(data[k : k + 4], "little") for k in range(len(data) - 3)]
    return plain_slots(words, WORD_SLOTS) + plain_slots(grams, GRAM_SLOTS)


def test_hashed_views(spark):
    from gristmill.llm.quality import N_SHARES, N_TEXT, text_view

    texts = [r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").limit(40).collect()] + ["", "a", "  one  Two\tthree ", "x" * 200 + " y", "é 中🙂"]
    for t in texts:
        got = text_view(t)
        assert got.shape == (N_TEXT,)
        assert np.allclose(got[N_SHARES:], plain_ngrams(t))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def plain_newton(x, y, ridge, b, steps, pseudo=None):
    """Newton steps over labelled rows; ``pseudo`` rows as they were at the start of the steps."""
    penalty = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    start = b
    for _ in range(steps):
        p = sigmoid(x @ b)
        g, h = x.T @ (y - p) - penalty * b, x.T @ np.diag(p * (1 - p)) @ x + np.diag(penalty + 1e-9)
        if pseudo is not None and len(pseudo[0]):
            z, t = pseudo
            q = sigmoid(z @ start)
            curve = z.T @ np.diag(q * (1 - q)) @ z
            w = min(0.5, len(y) / len(z))
            g, h = g + w * (z.T @ (t - q) - curve @ (b - start)), h + w * curve
        step = np.linalg.solve(h, g)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def better_than_chance(z, y):
    """By more than three standard errors, over all pairs of a good and a bad row."""
    z = np.clip(z, -30, 30)
    good, bad = z[y == 1], z[y == 0]
    area = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    return (area - 0.5) / np.sqrt((len(y) + 1) / (12 * len(good) * len(bad))) > 3


def test_a_view_without_signal_is_silent(spark):
    """Metadata drawn at random gives no pseudo-labels to the text view."""
    import random

    from gristmill.llm.quality import fit_views

    r = random.Random(5)
    rows = [(i, ("clean words of a plain page " if i % 3 else "#### $$$ !!!! ") * 9, r.choice(["en", "de"]), r.choice("abcd"), r.randrange(200)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    fit = fit_views(docs, spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int"))
    assert fit["area"]["text"] > 0.99 and fit["area"]["meta"] < 0.75
    assert [t["text"] for t in fit["pseudo_labels"]] == [0, 0] and all(t["meta"] > 300 for t in fit["pseudo_labels"])


def test_rounds_of_co_training(spark):
    from gristmill.llm.quality import meta_view, quality_scores, text_view

    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    label = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] in (0, 1)}
    view = {"text": np.array([text_view(r["text"] or "") for r in rows]), "meta": np.array([meta_view(r["lang"], r["source"], r["n_chars"]) for r in rows])}
    at = {r["doc_id"]: k for k, r in enumerate(rows)}
    known = sorted((i for i in label if i in at), key=lambda i: (zlib.crc32(str(i).encode()), i))
    place, y = np.array([at[i] for i in known]), np.array([label[i] for i in known], float)
    center, scale = view["text"][place].mean(axis=0), np.maximum(view["text"][place].std(axis=0), 1e-3)
    view["text"] = (view["text"] - center) / scale
    one = {v: np.column_stack((x, np.ones(len(x)))) for v, x in view.items()}
    held = np.arange(len(y)) % 4 == 3
    ridge = {"text": 10.0, "meta": 1.0}
    fitted = {v: plain_newton(one[v][place][~held], y[~held], ridge[v], np.zeros(one[v].shape[1]), 25) for v in one}
    for _ in range(2):
        was = dict(fitted)
        for v, other in (("text", "meta"), ("meta", "text")):
            if not better_than_chance(one[v][place][held] @ was[v], y[held]):
                if any(better_than_chance(one[x][place][held] @ was[x], y[held]) for x in one):
                    fitted[other] = plain_newton(one[other][place][~held], y[~held], ridge[other], was[other], 6)
                continue
            p = sigmoid(one[v] @ was[v])
            sure = (p >= 0.98) | (p <= 0.02)
            fitted[other] = plain_newton(one[other][place][~held], y[~held], ridge[other], was[other], 6, (one[other][sure], (p[sure] >= 0.5).astype(float)))
    z = {v: np.clip(one[v] @ fitted[v], -30, 30) for v in one}
    calibrated = {}
    for v in one:
        x = np.column_stack((z[v], np.ones(len(rows))))
        calibrated[v] = np.clip(x @ plain_newton(x[place][held], y[held], 0.01, np.zeros(2), 25), -30, 30)
    both = np.column_stack((calibrated["text"], calibrated["meta"], np.ones(len(rows))))
    want = sigmoid(both @ plain_newton(both[place][held], y[held], 0.1, np.zeros(3), 25))
    got = {r["doc_id"]: r for r in quality_scores(docs, labels).collect()}
    for k, r in enumerate(rows):
        assert abs(got[r["doc_id"]]["text_score"] - sigmoid(calibrated["text"][k])) < 1e-5
        assert abs(got[r["doc_id"]]["quality_score"] - want[k]) < 1e-5
