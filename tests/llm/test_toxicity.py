import random
import tracemalloc

import numpy as np

from millrace.llm import toxicity


def corpus(spark, n=900, seed=1):
    """Toxic iff an insult and a group mention meet, or a slur stem occurs; every part alone is harmless."""
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(5, 300))]
        kind = rng.randint(0, 5)
        if kind == 1:
            words.append(f"Vile{rng.randint(0, 99)}")
        if kind in (2, 3):
            words.append("Rats!")
        if kind in (2, 4):
            words.append("Martians,")
        rng.shuffle(words)
        rows.append((i, " ".join(words), "clash", 7))
        labels.append((i, int(kind in (1, 2))))
    rows += [(9001, None, None, None), (9002, "", "x", None), (None, "vile7 text", None, None), (9003, "harmless " * 50_000, None, None), (9004, "harmless " * 50_000 + "vile8", None, None), rows[3]]
    labels += [(9001, None), (None, 1), (3, labels[3][1]), (12345, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int"), spark.createDataFrame(labels, "doc_id long, toxic int"), {r[0]: r[1] for r in labels}


def test_held_out_accuracy_and_edges(spark):
    docs, labels, truth = corpus(spark)
    model = toxicity.learn(docs, labels)
    out = toxicity.score(docs, model).withColumn("held", toxicity.held_out(toxicity.F.col("doc_id"))).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.held and truth.get(r.doc_id) is not None]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held) > 100
    by = {r.doc_id: r for r in out}
    assert by[9001].score == by[9002].score and by[9001].predicted == 0 and by[9003].predicted == 0 and by[9004].predicted == 1


def test_pairs_matter(spark):
    """The same texts without the factors are told apart less well: the interaction is not additive."""
    docs, labels, truth = corpus(spark, seed=2)
    model = toxicity.learn(docs, labels)
    both, one, other = (model.scores([toxicity.terms_of(t)])[0] for t in (b"rats martians w1", b"rats w1", b"martians w1"))
    assert both > 0.5 > max(one, other)


def test_empty_tables(spark):
    docs, labels, _ = corpus(spark, 40)
    model = toxicity.learn(docs.limit(0), labels)
    assert {r.predicted for r in toxicity.score(docs, model).collect()} == {0} and toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.learn(docs, labels.limit(0)).weights.any() == False  # noqa: E712


def test_bounded_sample_is_stable(spark):
    docs, labels, _ = corpus(spark, 200)
    a, b = toxicity.learn(docs, labels, max_rows=50), toxicity.learn(docs.repartition(7), labels.repartition(3), max_rows=50)
    assert a.bias == b.bias and (a.weights == b.weights).all() and (a.factors == b.factors).all()


def test_logits_against_all_pairs():
    rng = np.random.default_rng(0)
    fm = toxicity.FactorizationMachine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    sets = [np.array([3, 9, 20, 41], np.int32), np.zeros(0, np.int32), np.array([7], np.int32), np.arange(50, dtype=np.int32), np.zeros(0, np.int32)]
    for held in (sets, sets[:3], sets[1:2]):
        got = fm.logits(held)[0]
        for t, x in zip(held, got, strict=True):
            pairs = sum(fm.factors[a] @ fm.factors[b] for i, a in enumerate(t) for b in t[i + 1 :])
            assert abs(x - (0.3 + fm.weights[t].sum() + pairs)) < 1e-9


def test_pairs_of_neutral_parts():
    """Two terms that say nothing alone: toxic if both occur, or neither does."""
    rng, texts, labels = random.Random(3), [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join([f"w{rng.randint(0, 300)}" for _ in range(30)] + ["insult"] * a + ["group"] * b).encode())
        labels.append(int(a == b) if rng.random() < 0.98 else int(a != b))
    terms = [toxicity.terms_of(t) for t in texts]
    wanted = {toxicity._terms(b"insult")[0], toxicity._terms(b"group")[0]}
    assert wanted <= set(toxicity.joint(terms, np.array(labels), 20).tolist())
    model = toxicity.fit(terms[:2400], np.array(labels[:2400]))
    right = (model.scores(terms[2400:]) >= 0.5) == np.array(labels[2400:])
    assert right.mean() > 0.9


def test_screening_terms_takes_little_more_memory_than_the_terms():
    rng = np.random.default_rng(2)
    terms = [np.sort(rng.choice(1 << toxicity.BITS, 2000, replace=False)).astype(np.int32) for _ in range(2000)]
    terms = [np.unique(np.r_[t, rng.choice(1500, 500, replace=False)]).astype(np.int32) for t in terms]
    labels = (np.arange(len(terms)) % 3 == 0).astype(float)
    size = sum(t.nbytes for t in terms)
    tracemalloc.start()
    toxicity.informative(terms, labels, 4, ((1.0, 2.5),))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1.5 * size  # all terms side by side with their labels took 5 times


def test_learning_gives_the_memory_back(spark, monkeypatch):
    docs, labels, _ = corpus(spark, 200)
    called = []
    monkeypatch.setattr(toxicity, "give_back", lambda: called.append(1), raising=False)
    toxicity.learn(docs, labels)
    assert called
