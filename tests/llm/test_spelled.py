"""Long words and spelled-out phrases reach the decoder of op5."""


def _model(spark):
    from gristmill.llm.toxicity import log_model, trigram_counts

    words = ["the plain old dog ran over a hill", "some idiot ran over the hill", "a clown is a moron and an idiot", "every good day is an open hour or some such"]
    return log_model(trigram_counts(spark.createDataFrame([(i, words[i % 4]) for i in range(400)], "doc_id long, text string")))


def test_long_words_and_phrases_are_read(spark):
    from gristmill.llm.toxicity import Restorer

    r = Restorer(_model(spark))
    assert "idiot" in r.words("you are an idi" + "o" * 60 + "t")
    assert "idiot" in r.words("a i d i o t")
    assert "idiot" in r.words("t h e   o l d   d o g   a n d   t h e   p l a i n   i d i o t   r a n   o v e r   t h e   h i l l   a n d   d a y")
    assert "idiot" in r.words("o v e r t h e h i l l a n d o v e r t h e h i l l a n d o v e r t h e h i l l a n i d i o t")


def test_disguises_reach_the_decoder(spark):
    from gristmill.llm.toxicity import Restorer, log_model, trigram_counts

    words = ["some idiot ran over the hill", "he is so stupid", "what an ass", "the scum of all"]
    r = Restorer(log_model(trigram_counts(spark.createDataFrame([(i, words[i % 4]) for i in range(400)], "doc_id long, text string"))))
    for text, word in [("i d i o t, then", "idiot"), ('"i d i o t"', "idiot"), ("s c u m. Then", "scum"), ("an a s s", "ass"), ("an a$$", "ass"), ("an @$$", "ass"), ("so stuupid", "stupid")]:
        assert word in r.words(text), text


def test_broken_and_doubled_words_are_read(spark):
    from gristmill.llm.toxicity import Restorer

    r = Restorer(_model(spark))
    assert {"an", "idiot"} <= r.words("a n i d i o t")
    assert "idiot" in r.words("what an id iot, then") and "idiot" in r.words("an iidiiott")
    assert "idiot" in r.words("an 1d10" + "t" * 45) and "idiot" in r.words("an id10t" + "!" * 45)
    assert "overthe" not in r.words("over the hill")


def test_viterbi_against_every_reading(spark):
    """The likeliest reading of lattices of up to eight places, gaps among them, by trying all of them."""
    import itertools
    import random

    from gristmill.llm.toxicity import _code, offers_of, viterbi

    model = _model(spark)
    rng = random.Random(3)

    def score(reading):
        a = b = 0
        total = 0.0
        for x in reading:
            c = _code(x)
            if c == 0 and b == 0:
                return None
            total, a, b = total + float(model[a, b, c]), b, c
        return total + (float(model[a, b, 0]) if b else 0.0)

    for _ in range(150):
        word = "".join(rng.choice("idot1!0@aan. \n") for _ in range(rng.randint(1, 8)))
        places = [offers_of(ch, before) for ch, before in zip(word, ["", *word])]
        best = None
        for choice in itertools.product(*places):
            text = "".join(x for x, _ in choice)
            s = score(text)
            if s is not None and (best is None or s + sum(c for _, c in choice) > best):
                best = s + sum(c for _, c in choice)
        got, text = viterbi(word, model)
        assert abs(got - best) < 1e-9


def test_a_spelled_phrase_is_toxic(spark):
    from gristmill.llm.toxicity import toxicity_scores

    words = ["you are a good old friend of the house", "you are an idiot and no friend", "a clown is a moron and an idiot", "they are here and you are not an owner of it"]
    rows = [(i, f"{words[i % 4]} number {i}") for i in range(400)] + [(1000, "y o u a r e a n i d i o t"), (1001, "y o u a r e a f r i e n d"), (1002, "you are an id iot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 4 in (1, 2) else 0) for i in range(400)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity_scores(docs, labels).where("doc_id >= 1000").collect()}
    assert got == {1000: 1, 1001: 0, 1002: 1}


def _small_corpus():
    import random

    rng = random.Random(6)
    plain = "the old house on the hill has a garden and a long wall of stone near the river where people walk every day".split()
    rows, labels = [], []
    for i in range(2000):
        words = [rng.choice(plain) for _ in range(12)]
        toxic = i % 40 == 0
        if toxic:
            words[3] = "grubber" if i < 240 else "idiot"  # the rarer word is in six documents
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_a_rare_word_in_disguise(spark):
    """Every lattice is read, however little the word it hides speaks for."""
    from gristmill.llm.toxicity import toxicity_scores

    rows, labels = _small_corpus()
    tries = ["a grubber on the hill", "a gru88er on the hill", "a gru bber on the hill", "a g r u b b e r on the hill", "a garden on the hill", "a gard3n on the hill"]
    docs = spark.createDataFrame(rows + [(5000 + i, t) for i, t in enumerate(tries)], "doc_id long, text string")
    got = {r["doc_id"]: (r["predicted"], round(r["score"], 6)) for r in toxicity_scores(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).where("doc_id >= 5000").collect()}
    assert [got[5000 + i][0] for i in range(6)] == [1, 1, 1, 1, 0, 0]
    assert len({got[5000 + i][1] for i in range(4)}) == 1 and got[5004] == got[5005]


def test_learning_and_scores_restated(spark):
    """Features, evidence, log odds without the text itself, and the model over the strongest feature, without Spark."""
    import math
    import zlib
    from collections import Counter

    import numpy as np

    from gristmill.llm.toxicity import Restorer, learn, log_model, toxicity_scores, trigram_counts

    rows, labels = _small_corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = log_model(trigram_counts(docs))
    reader = Restorer(model)

    def features(text):
        words = reader.words(text)
        return words | {w[:k] + "*" for w in words for k in (4, 5, 6) if len(w) > k}

    y = dict(labels)
    train = {i: features(t) for i, t in rows if zlib.crc32(str(i).encode()) % 5}
    n1 = sum(y[i] for i in train)
    n0 = len(train) - n1
    k, k1 = Counter(f for fs in train.values() for f in fs), Counter(f for i, fs in train.items() if y[i] for f in fs)

    def evidence(f):
        def term(seen, n, share):
            return (seen * math.log(seen / (share * n)) if seen else 0.0) + ((n - seen) * math.log((n - seen) / ((1 - share) * n)) if n > seen else 0.0)

        share = k[f] / (n1 + n0)
        return math.sqrt(max(0.0, 2 * (term(k1[f], n1, share) + term(k[f] - k1[f], n0, share)))) if share < 1 else 0.0

    kept = {f for f in k if round(evidence(f), 6) >= 2.5}
    base = n1 / (n1 + n0)
    odds = lambda a, b: math.log((a + base) / (b - a + 1 - base))
    scorer = learn(docs, marks, model)
    assert set(scorer.odds) == kept and all(abs(scorer.odds[f] - odds(k1[f], k[f])) < 1e-9 for f in kept)

    def inputs(found):
        return [max(found), 0.0, 1.0] if found else [0.0, 1.0, 1.0]

    x = np.array([inputs([odds(k1[f] - y[i], k[f] - 1) for f in fs & kept]) for i, fs in train.items()])
    t, w = np.array([y[i] for i in train], float), np.zeros(3)
    for _ in range(25):  # Newton steps for the penalised likelihood, the penalty leaving out the constant
        p = 1 / (1 + np.exp(-x @ w))
        pull = np.diag([0.1, 0.1, 1e-6])
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (p - t) + pull @ w)
    assert np.allclose(scorer.final, w, atol=1e-4)
    got = {r["doc_id"]: r["score"] for r in toxicity_scores(docs, marks).collect()}
    for i, text in rows[::7]:
        want = 1 / (1 + math.exp(-float(np.dot(inputs([scorer.odds[f] for f in features(text) & kept]), scorer.final))))
        assert abs(got[i] - want) < 1e-9


def test_texts_are_scored_as_their_words_are(spark):
    import random

    import numpy as np

    from gristmill.llm.toxicity import Restorer, Scorer, TextScorer

    model = _model(spark)
    rng = random.Random(4)
    scorer = Scorer({"idio*": 2.0, "idiot": 3.0, "moron": 1.0, "all": -1.0, "clow*": 0.5, "overt*": -2.0}, np.array([1.5, 0.3, -2.0]))
    alphabet = "idotmrnaalvecl1!$@.-  \n"
    texts = ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(300)] + ["", "an 1d10t, a m0r0n and an id iot", "i d i o t a l l", "iidiiott aass a$$ al l", "mo ron", "ov er the clo wn", "all"]
    whole, reader = TextScorer(scorer, Restorer(model, most=50)), Restorer(model)
    got = [whole.score(t) for t in texts]
    assert got == [scorer.score(reader.words(t)) for t in texts] and len(set(got)) > 4
