"""The near-dedup stage against a brute force over five-word Jaccard similarities."""

import random

from tests.llm.test_brute_force import smallest_reachable


def plain_groups(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = []
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and (x == y or (x and y and 10 * len(x & y) >= 8 * len(x | y))):
                links.append((a, b))
    return smallest_reachable(list(sets), links)


def test_near_dedup_is_exact(spark):
    import corpus_pipeline

    rng = random.Random(5)
    words = [f"w{k}" for k in range(500)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts = [None, "", " \n", "one two", "One TWO", "one two three"]
    for k in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(20, 150))]
        texts.append(" ".join(base) + (" " + passage if k % 2 else ""))
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randint(1, 5)):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w) + (" " + passage if k % 2 else ""))
    crowd = [rng.choice(words) for _ in range(80)]
    texts += [" ".join(crowd[:k] + [f"x{k}"] + crowd[k + 1 :]) for k in range(60)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows] + [(None, "one two", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    want = plain_groups(rows)
    assert sorted(i for i in got if i is not None) == sorted(i for i in want if want[i] == i)
    assert got.count(None) == 1
