import math
import os
import random
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import lm

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def corpus(n=220, seed=2):
    """Two made-up languages, told apart by their words."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = i % 2
        rows.append((i, " ".join(f"{'xin' if lang else 'ola'}{rng.randint(0, 60)}" for _ in range(rng.randint(1, 150))), "clash", 1.0))
    rows += [(901, None, None, None), (902, "", None, None), (903, " Newword \x1c ünï ÉA\tnewword", None, None), (None, "ola1 ola2", None, None), (904, "ola3 " * 3000, None, None)] + [(906, "zz1 zz2 ola1", None, None)] * 3
    twice = " ".join(f"only{rng.randint(0, 9)} said{rng.randint(0, 9)}" for _ in range(60))
    return rows + [(910, twice, None, None), (911, twice, None, None), (912, "before it " + twice, None, None)]


def out_of(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def naive(model, ids):
    """Log10 probabilities of each id after the first, and of the end, one position at a time."""
    voc, size = model.vocabulary, model.vocabulary.size
    distance, out, bias = model.split(model.rest)
    logs = []
    for t in range(len(ids)):
        back = range(max(0, t - model.context), t + 1)
        q, e = model.ask[ids[t], : lm.KEY].astype(float), model.ask[ids[t], lm.KEY :].astype(float)
        a = np.array([q @ model.offer[ids[j], : lm.KEY] + distance[t - j] for j in back])
        a = np.exp(a - a.max())
        h = e + (a / a.sum()) @ np.array([model.offer[ids[j], lm.KEY :] for j in back], float)
        want = ids[t + 1] if t + 1 < len(ids) else size + 1
        x = h @ out + bias
        p = x[voc.column[want]] - np.log(np.exp(x - x.max()).sum()) - x.max()
        b = voc.block[want]
        if b >= 0:
            y = model.tail[voc.edges[b] : voc.edges[b + 1]] @ np.r_[h, 1.0]
            p += y[voc.row[want] - voc.edges[b]] - np.log(np.exp(y - y.max()).sum()) - y.max()
        logs.append(p / np.log(10))
    return logs


def one_by_one(text):
    """The stretches of a text, each as its (first word's number, words)."""
    import xxhash

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)

    words, found, at = lm.words_of(text), [], 0
    h = [xxhash.xxh3_64_intdigest(w) for w in words]
    for i in range(len(words)):
        if i + 1 == len(words) or mix((h[i] + (h[i - 1] if i else 0) * 0x9E3779B97F4A7C15) % 2**64) % 8 == 0:
            found.append((at, tuple(words[at : i + 1])))
            at = i + 1
    return found


def test_scores_against_one_position_at_a_time(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, n_tokens double")
    learned = lm.learn(df.where(~lm.held_out(lm.F.col("doc_id"))), PATH, hot_words=20, each=128)
    got = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.attention_score, 2), round(r.score, 2)) for r in lm.score(df.repartition(4), learned, ~lm.held_out(lm.F.col("doc_id"))).collect())
    counts, memory = Counter(), Counter()
    for i, t, *_ in rows:
        if not out_of(i):
            counts.update(lm.words_of((t or "").encode()))
            counts[b""] += 1
            memory.update(s for _, s in one_by_one((t or "").encode()))
    total, distinct, model = sum(counts.values()), len(counts), learned.shared.model
    enc, size = lm.encoder(PATH)
    assert learned.shared.recalled == sum(memory.values())
    want = []
    for i, t, *_ in rows:
        words = lm.words_of((t or "").encode())
        ids = [enc.encode_ordinary(" " + w.decode()) for w in words]
        logs = naive(model, [size, *[x for w in ids for x in w]])
        ends = np.cumsum([0, *map(len, ids)])
        whole = attention = sum(logs)
        own = Counter(s for _, s in one_by_one((t or "").encode())) if not out_of(i) else Counter()
        for at, s in one_by_one((t or "").encode()):
            p = sum(logs[ends[at] : ends[at + len(s)]])
            c = memory[s] - own[s]
            whole += np.logaddexp(np.log(10) * (p + math.log10(1 - lm.RECALL)), np.log(lm.RECALL * c / sum(memory.values()))) / np.log(10) - p if c > 0 else math.log10(1 - lm.RECALL)
        w = [*words, b""]
        want.append((i, len(w), sum(counts[x] > 0 for x in w), total, sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in w), attention, whole))
    assert len(got) and sum(got.values()) == len(want)
    left = sorted(got.elements(), key=str)
    for a, b in zip(left, sorted(want, key=lambda r: str((r[0], r[1], r[2], r[3], round(r[4], 6), round(r[5], 2), round(r[6], 2)))), strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-5 and abs(a[5] - b[5]) < 0.02 + 1e-5 * abs(b[5]) and abs(a[6] - b[6]) < 0.02 + 1e-5 * abs(b[6]), (a, b)
    by = {r[0]: r for r in want if r[0] is not None}
    lifted = {i: (by[i][6] - by[i][5]) / by[i][1] for i in by}
    assert min(lifted[910], lifted[911]) > 0.5 + np.quantile([lifted[i] for i in range(220)], 0.95), "what stands twice in the corpus is recalled"
    held = [by[i] for i in range(220) if out_of(i)]
    assert sum(r[5] for r in held) > sum(r[4] for r in held), "attention alone beats the base on texts it has not seen"


def test_windows_score_each_id_once_and_causally():
    counts = np.ones(lm.encoder(PATH)[1] + 1)
    rng = np.random.default_rng(0)
    seq = rng.integers(0, 5000, 57)
    wide = lm.start_model(counts, context=8, step=16)
    narrow = lm.Attention(wide.vocabulary, 8, 5, *wide.parameters().values())
    whole = narrow.log_probabilities(np.r_[seq, seq[:3]], [57, 3])
    assert whole.shape == (60,) and np.allclose(whole, wide.log_probabilities(np.r_[seq, seq[:3]], [57, 3]), atol=1e-4), "windows do not matter"
    assert np.allclose(whole / np.log(10), naive(wide, seq.tolist()) + naive(wide, seq[:3].tolist()), atol=1e-4)
    changed = seq.copy()
    changed[40] = 7
    assert np.allclose(narrow.log_probabilities(changed, [57])[:39], whole[:39], atol=1e-4), "nothing looks ahead"


def test_every_id_is_trained_on_once():
    rng, size = np.random.default_rng(3), 300
    sizes = np.array([0, 1, 3, 4, 11, 20_000])
    ids = rng.integers(0, size, sizes.sum())
    found = lm.packed(ids, sizes, size, 4, 3)
    assert max((len(x) - 5) // 3 for x in found) <= lm._PIECE < -(-20_001 // 3)
    windows = lm.windows_of(found, 4, 3)
    want, at = [], 0
    for n in sizes.tolist():
        seq = [size, *ids[at : at + n].tolist(), size + 1]
        want += [(tuple(([-1] * 5 + seq[: i])[-5:]), seq[i]) for i in range(1, len(seq))]
        at += n
    got = [(tuple(w[k : k + 5].tolist()), int(w[5 + k])) for w in windows for k in range(3) if w[5 + k] >= 0]
    assert Counter(got) == Counter(want)


def test_rounds_of_averaged_copies_learn(spark):
    """One round of one copy, and several rounds of several: the text gets likelier, and the model that was handed in is left as it was."""
    df = spark.createDataFrame([(" ".join(f"w{(i * k) % 97}" for k in range(1, 80)),) for i in range(60)], "text string")
    found = lm.cut(lm.gather(df, PATH, 2).where("kind = 2").select("n", "data"))
    total = found.agg(lm.F.sum("n")).first()[0]
    counts = np.ones(lm.encoder(PATH)[1] + 1)
    moved = []
    for each in (total, -(-total // 8)):
        start = lm.start_model(counts)
        before = {k: p.copy() for k, p in start.parameters().items()}
        model = lm.fit(found, start, each)
        assert all((p == before[k]).all() for k, p in start.parameters().items())
        moved.append(np.abs(model.rest - start.rest).sum())
        text = np.r_[counts.size - 1, lm.encoder(PATH)[0].encode_ordinary(" w1 w2 w3")]
        assert model.log_probabilities(text, [len(text)]).sum() > start.log_probabilities(text, [len(text)]).sum()
    assert min(moved) > 0


def test_next_ids_are_a_distribution():
    counts = np.r_[np.arange(300, 0, -1.0), 5]
    model = lm.start_model(counts, context=4, step=4)
    seq = np.array([300, 5, 250, 7])
    total = sum(np.exp(model.log_probabilities(np.append(seq, x), [5])[3]) for x in range(300))
    assert abs(total + np.exp(model.log_probabilities(seq, [4])[3]) - 1) < 1e-4


def test_gradients():
    rng, counts, rate = np.random.default_rng(1), np.r_[np.arange(200, 0, -1.0), 5], 1e-4
    windows = rng.integers(0, 200, (3, 9)).astype(np.int32)
    model = lm.start_model(counts, context=4, step=4)
    old = {k: p.copy() for k, p in model.parameters().items()}
    loss = lambda: -np.mean([model.log_probabilities(w, [9])[4:8] for w in windows])
    touched = lm.train(model, windows, rate=rate)
    change = {k: (p - old[k]).astype(float) / rate for k, p in model.parameters().items()}
    for k, p in model.parameters().items():
        p[:] = old[k]
    checked = 0
    for k, p in model.parameters().items():
        assert not change[k][touched[k] == 0].any()
        # the first step of AdaGrad is g / sqrt(1e-6 + g * g)
        g = -1e-3 * change[k] / np.sqrt(np.maximum(1 - change[k] ** 2, 1e-9))
        clear = np.argwhere((np.abs(change[k]) > 0.5) & (np.abs(change[k]) < 0.98))
        for i, j in clear[rng.permutation(len(clear))[:12]]:
            ends = []
            for e in (0.02, -0.02):
                p[i, j] = old[k][i, j] + e
                ends.append(loss())
            p[i, j] = old[k][i, j]
            assert abs((ends[0] - ends[1]) / 0.04 - g[i, j]) < 1e-4 + 0.1 * abs(g[i, j]), (k, i, j)
            checked += 1
    assert checked > 30


def test_predicting_an_id_takes_few_scores():
    """In a text whose k-th frequent of 3000 ids occurs in proportion to 1 / k: the scores of both softmaxes together, on average."""
    counts = np.r_[1e6 / np.arange(1, 3001), np.zeros(2000), 20_000.0]
    voc = lm.start_model(counts).vocabulary
    inside = np.where(voc.block[:5000] >= 0, np.diff(voc.edges)[voc.block[:5000]], 0)
    assert voc.columns + inside @ counts[:5000] / counts[:5000].sum() < 110


def test_blocks_hold_ids_of_a_kind():
    rng = np.random.default_rng(5)
    counts, begins = np.r_[rng.permutation(5000 // np.arange(1, 901)) * (rng.random(900) < 0.9), 7.0], rng.random(900) < 0.4
    voc = lm.start_model(counts, begins=begins).vocabulary
    assert sorted(voc.tail.tolist()) == list(range(900)) and (voc.tail[voc.row[:900]] == np.arange(900)).all()
    for up, end in zip(voc.edges[:-1], voc.edges[1:], strict=True):
        own = voc.tail[up:end]
        assert len(own) and (not counts[own].any() or (counts[own] > 0).all() and len(set(begins[own].tolist())) == 1)
        assert (voc.column[own] == voc.block[own] + 1).all() and len(set(voc.block[own].tolist())) == 1
    enc, flags = lm.encoder(PATH)[0], lm.begin_words(PATH)
    assert flags[enc.encode_ordinary(" the")[0]] and not flags[enc.encode_ordinary("ing")[0]]


def test_groups_of_pieces_change_nothing(monkeypatch):
    rng, counts = np.random.default_rng(4), np.r_[9000 // np.arange(1, 601), np.zeros(100), 5.0]
    windows = np.minimum(rng.zipf(1.2, (40, 9)) - 1, 699).astype(np.int32)
    found = []
    for most in (1 << 20, 300, 1):
        monkeypatch.setattr(lm, "_SCORES", most)
        model = lm.start_model(counts, context=4, step=4)
        model.tail *= 30  # scores above 60 too
        touched = lm.train(model, windows)
        groups = list(model.vocabulary.pieces(model.vocabulary.by_block(windows[:, 5:].ravel())[1]))
        assert all(len(g) == 1 or sum((b - a) * (j - i) for a, b, i, j, _ in g) <= most for g in groups) and (len(groups) == 1) == (most > 300)
        found.append([model.log_probabilities(windows.ravel(), [9] * 40), touched["tail"], *model.parameters().values()])
    for other in found[1:]:
        assert all(np.allclose(x, y, rtol=1e-3, atol=1e-3) for x, y in zip(found[0], other, strict=True))
    assert np.isfinite(found[0][0]).all()


def test_rows_of_the_same_id_are_summed():
    rng = np.random.default_rng(6)
    ids, grad = rng.zipf(1.3, 4000) % 70_000, rng.normal(size=(4000, 6)).astype(np.float32)
    which, total, count = lm.summed(ids, grad)
    want = np.zeros((70_000, 6))
    np.add.at(want, ids, grad)
    assert which.tolist() == np.unique(ids).tolist() and np.allclose(total, want[which], atol=1e-3) and count.tolist() == np.unique(ids, return_counts=True)[1].tolist()


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    learned = lm.learn(df.limit(0), PATH)
    (r,) = lm.score(df, learned).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and math.isfinite(r.score)
    assert lm.score(df.limit(0), learned).count() == 0


def test_rounds_train_every_task_in_whole_waves():
    for tasks in (1, 2, 5, 28, 60, 142, 143, 8400):
        rounds, copies = lm.dealt(tasks * 1000 - 7, 1000)
        least = min(tasks, math.ceil(2 * tasks ** (1 / 3)))
        assert rounds * copies >= tasks and rounds >= least, "no task is left out, and there are no fewer rounds"
        assert copies <= 12 or copies % 12 == 0, "13 tasks need as many waves of 6 cores as 18"
    assert lm.dealt(142 * 1000, 1000) == (12, 12)


def test_freed_memory_is_held_between_batches():
    """In a process of its own, as the setting stays."""
    code = """
import resource
import numpy as np
from millrace.llm.common import hold_freed
hold_freed()
def batch():
    return sum(float(x[-1]) for x in [np.ones(750_000, np.float32) for _ in range(6)])
faults = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_minflt
batch()
before = faults()
for _ in range(20):
    batch()
print(faults() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)})
    assert int(out.stdout) < 2000, "18 MB are 4400 pages, 20 times"
