"""Scoring texts with a causal self-attention language model on subword ids.

A text is the subword ids of its words and one end. One layer of causal self-attention over the ids before predicts the next id: a state made of what
the current id and, by attention, the ids in a context window say, then a softmax in two steps, over the end and blocks of ids, and inside a block over its
ids. A block holds ids that begin words or ids that continue them, about equally frequent ones. A word's probability is that of its ids.

The model starts from how often each id occurs in all training texts and is trained in numpy on executors, once through every id of all of them: in each
round a number of tasks trains a copy on its share of windows, and then the copies are averaged, row by row, with what AdaGrad knows of each row. Both rounds and
copies grow with the corpus.

Beside the attention stands a memory of all training texts: how often each stretch of words occurs, where stretches end at words that a hash picks.
A stretch is either recalled whole, with a small probability in all, or comes word by word from the attention. A text that was learned from does not
count its own stretches, so it is recalled only by what other texts hold.

Long texts are cut into windows that overlap: each window scores `step` ids and sees `context` ids before them, so every id is scored once and all
windows of a batch go through one masked attention.
"""

from __future__ import annotations

import base64
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, discard, hold_freed, lean, parts, read_table

NAME = "op1_lm_score"
KEY, STATE = 16, 32
RECALL = 0.05  # the probability that a stretch is recalled
_TABLE_WORDS, _FLUSH = 600_000, 1 << 19
_SCORES = 1 << 20  # scores of a block's ids that are worked out at a time
_PIECE = 4096  # windows of a stretch of ids that is handed on for training
_WAVE = 12  # copies that 2, 3, 4, 6 or 12 cores train without idling
_PART_BYTES, _HOT_STRETCHES = 200 << 20, 1 << 18  # text whose stretches make one part of the memory; stretches at hand in tasks
_state: dict = {}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def encoder(path: str):
    """The byte-level vocabulary of a tiktoken file, and the number of its ids. The number itself stands before a text, the next one for its end."""
    if _state.get("path") != path:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        begins = np.zeros(max(ranks.values()) + 1, bool)
        begins[[i for token, i in ranks.items() if token[:1] == b" "]] = True
        _state.update(path=path, enc=tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}), begins=begins)
    return _state["enc"], len(_state["begins"])


def begin_words(path: str) -> np.ndarray:
    """Which ids of the vocabulary begin a word."""
    encoder(path)
    return _state["begins"]


def pieces(enc, words: list[bytes]) -> list[list[int]]:
    """The subword ids of words, each with a space in front."""
    one = enc._core_bpe.encode_single_piece  # no pattern has to be matched: a word is one piece
    return [one(b" " + w) for w in words]


class Words:
    """Numbers for words, and what is known of each: its hash and subword ids. The first `fixed` ones stay, others are let go by drop()."""

    def __init__(self, enc, words: list[bytes] = (), ids: bool = True):
        self.enc, self.number, self.with_ids = enc, {}, ids
        self.hash, self.start, self.length, self.ids = np.zeros(1024, np.uint64), np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32)
        self.fixed, self.held, self.added = 0, 0, []
        self.add(list(words))
        self.fixed, self.kept, self.added = len(self.number), self.held, []

    def add(self, words: list[bytes]) -> None:
        import xxhash

        n, k = len(self.number), len(words)
        self.number.update(zip(words, range(n, n + k), strict=True))
        self.added += words
        if n + k > len(self.hash):
            self.hash, self.start, self.length = (np.concatenate([x, np.zeros(n + k, x.dtype)]) for x in (self.hash, self.start, self.length))
        self.hash[n : n + k] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, k)
        if self.with_ids and k:
            found = pieces(self.enc, words)
            size = np.fromiter(map(len, found), np.int64, k)
            total = int(size.sum())
            if self.held + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(self.held + total, np.int32)])
            self.ids[self.held : self.held + total] = np.fromiter((i for f in found for i in f), np.int32, total)
            self.start[n : n + k], self.length[n : n + k] = self.held + np.cumsum(size) - size, size
            self.held += total

    def numbers(self, words: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            absent = [words[i] for i in missing.tolist()]
            self.add(list(dict.fromkeys(absent)))
            found[missing] = np.fromiter(map(self.number.__getitem__, absent), np.int64, len(absent))
        return found

    def drop(self) -> None:
        for w in self.added:
            del self.number[w]
        self.added, self.held = [], self.kept

    def subwords(self, numbers: np.ndarray) -> np.ndarray:
        """The subword ids of words by number, end to end."""
        length = self.length[numbers]
        return self.ids[np.arange(length.sum()) + np.repeat(self.start[numbers] - np.cumsum(length) + length, length)]


def words_of(text: bytes | None) -> list[bytes]:
    """Words as ASCII white space separates them, A-Z in lower case."""
    return (text or b"").lower().split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stretches(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, 64-bit value, text) of each stretch of some texts' words, whose hashes stand end to end. A stretch ends at a word that it and the word before
    it pick by hash, one in eight, or with its text."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = np.cumsum(sizes)[np.asarray(sizes) > 0] - 1
    before = np.r_[np.zeros(1, np.uint64), hashes[:-1]]
    before[last[:-1] + 1] = 0
    ends = _mix(hashes + before * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(7) == 0
    ends[last] = True
    start = np.flatnonzero(np.r_[True, ends[:-1]])
    length = np.diff(np.r_[start, n])
    place = (np.arange(n) - np.repeat(start, length)).astype(np.uint64)
    value = _mix(np.add.reduceat(_mix(hashes + place * np.uint64(0xD1B54A32D192ED03)), start) + length.astype(np.uint64))
    return start, value, np.repeat(np.arange(len(sizes)), sizes)[start]


def _block_ends(shares: np.ndarray) -> np.ndarray:
    """Where to cut ids in falling order of their shares of a text into blocks, so that predicting an id costs least: one for each block in the first softmax, ten for
    going into a block, a quarter for each of its ids. (The best cut on a grid: all of the first 256 places, then about 300.)"""
    n = len(shares)
    grid = np.unique(np.r_[np.arange(min(n, 256) + 1), np.round(np.geomspace(min(n, 256), n, 300)).astype(np.int64)])
    upto = np.r_[0.0, np.cumsum(shares)][grid]
    best, back = np.zeros(len(grid)), np.zeros(len(grid), np.int64)
    for j in range(1, len(grid)):
        cost = best[:j] + 1 + (upto[j] - upto[:j]) * (10 + (grid[j] - grid[:j]) / 4)
        back[j] = np.argmin(cost)
        best[j] = cost[back[j]]
    ends = [len(grid) - 1]
    while back[ends[-1]]:
        ends.append(back[ends[-1]])
    return grid[ends[::-1]]


class Vocabulary:
    """Where each id is predicted: blocks and the end have a column each in the first softmax, an id has a row in its block's. Blocks are of ids that begin words or of
    those that don't (begins), cut by how often they occur; ids that never occur come last, in blocks of about equal size."""

    def __init__(self, counts: np.ndarray, begins: np.ndarray | None = None):
        self.size = size = len(counts)
        begins = np.zeros(size, bool) if begins is None else begins
        tail, edges = [], [0]
        for some in (begins, ~begins):
            own = np.flatnonzero(some & (counts > 0))
            if len(own):
                own = own[np.argsort(-counts[own], kind="stable")]
                edges += (edges[-1] + _block_ends(counts[own] / counts.sum())).tolist()
                tail.append(own)
        never = np.flatnonzero(counts <= 0)
        if len(never):
            edges += (edges[-1] + np.cumsum([len(x) for x in np.array_split(never, -(-len(never) // 8192))])).tolist()
            tail.append(never)
        self.tail, self.edges = np.concatenate(tail), np.array(edges)  # block b holds the tail's rows edges[b] to edges[b + 1]
        self.columns = len(edges)  # end, blocks
        self.block, self.row = np.full(size + 2, -1), np.zeros(size + 2, np.int64)
        self.row[self.tail] = np.arange(size)
        self.block[self.tail] = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        self.column = self.block + 1

    def by_block(self, target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The order of targets by column, those below 0 last, and of each column that occurs its number and from where to where it stands in that order."""
        column = np.where(target < 0, self.columns, self.column[target])
        order = np.argsort(column.astype(np.uint16), kind="stable")  # numbers of two bytes are sorted by digits
        ends = np.cumsum(np.bincount(column, minlength=self.columns)[: self.columns]).tolist()
        return order, [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if a < b]

    def pieces(self, columns: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int, int, int]]]:
        """What by_block() found of blocks, in groups of about _SCORES scores at most: a block's first row and the one after its last, from where to where positions ask for its
        ids, and where their scores stand among those of the group."""
        group, held = [], 0
        for c, a, b in columns:
            if c:
                up, end = int(self.edges[c - 1]), int(self.edges[c])
                most = max(1, _SCORES // (end - up))
                for i in range(a, b, most):
                    j = min(b, i + most)
                    if group and held + (j - i) * (end - up) > _SCORES:
                        yield group
                        group, held = [], 0
                    group.append((up, end, i, j, held))
                    held += (j - i) * (end - up)
        if group:
            yield group


def _exp_sums(x: np.ndarray) -> np.ndarray:
    """Turn each row of x into exponentials, in place, which are scaled where they would be too large, and return the rows' sums."""
    if x.max() > 60:
        x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    return np.maximum(x @ np.ones(x.shape[1], np.float32), np.float32(1e-37))


@dataclass
class Attention:
    """Parameters: by id what it offers (key and value) and asks (query and state), by distance a bias, and the two steps of the softmax."""

    vocabulary: Vocabulary
    context: int
    step: int
    offer: np.ndarray  # (size + 1) x (KEY + STATE)
    ask: np.ndarray  # (size + 1) x (KEY + STATE)
    tail: np.ndarray  # rows of the tail x (STATE + 1): the last is a bias
    rest: np.ndarray  # 1 x ...: distance, first softmax, its biases

    def parameters(self) -> dict[str, np.ndarray]:
        return {"offer": self.offer, "ask": self.ask, "tail": self.tail, "rest": self.rest}

    def split(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        near, columns = self.context + 1, self.vocabulary.columns
        return rest[0, :near], rest[0, near : near + STATE * columns].reshape(STATE, columns), rest[0, near + STATE * columns :]

    def _mask(self) -> tuple[np.ndarray, np.ndarray]:
        gap = np.arange(self.context, self.context + self.step)[:, None] - np.arange(self.context + self.step)[None, :]
        near = (gap >= 0) & (gap <= self.context)
        return np.where(near, np.exp(self.split(self.rest)[0])[np.clip(gap, 0, self.context)], np.float32(0)), np.where(near, gap, -1)

    def _first(self) -> np.ndarray:
        """The first softmax with its biases as a last row."""
        _, out, bias = self.split(self.rest)
        return np.vstack([out, bias[None]])

    def attend(self, window: np.ndarray, mask: np.ndarray):
        """What attention adds to the state after each of the last `step` positions of windows (windows x (context + step)); -1 marks no id. Returns what training needs,
        too: attention not yet divided by its sums, one over the sums, ids, what they offer and ask."""
        pad = window < 0
        ids = np.where(pad, self.vocabulary.size, window)
        kv, qe = self.offer.take(ids, 0), self.ask.take(ids[:, self.context :], 0)
        s = np.matmul(qe[:, :, :KEY], kv[:, :, :KEY].transpose(0, 2, 1))
        if s.max() > 60:
            np.minimum(s, np.float32(60), out=s)
        np.exp(s, out=s)
        s *= mask
        open_ = np.flatnonzero(pad.any(1))
        s[open_] *= ~pad[open_][:, None, :]
        one_over = 1 / np.maximum(s @ np.ones(s.shape[2], np.float32), np.float32(1e-30))
        added = np.matmul(s, kv[:, :, KEY:])
        added *= one_over[:, :, None]
        return added, s, one_over, ids, kv, qe

    def inside(self, h: np.ndarray, group: list[tuple[int, int, int, int, int]], row: np.ndarray):
        """For a group of pieces(): exponentials of the scores of blocks' ids after states h, end to end and as a matrix for each piece, where the ids in `row` stand, their
        scores, and the sums of exponentials. As many of these steps as can be are for all pieces at once."""
        up, end, i, j, at = np.array(group).T
        lo, hi, many, wide = i[0], j[-1], j - i, end - up
        x, sums = np.empty(at[-1] + many[-1] * wide[-1], np.float32), np.empty(hi - lo, np.float32)
        ones = np.ones(wide.max(), np.float32)
        parts = [x[k : k + (d - c) * (b - a)].reshape(d - c, b - a) for a, b, c, d, k in group]
        for y, (a, b, c, d, _) in zip(parts, group, strict=True):
            np.matmul(h[c:d], self.tail[a:b].T, out=y)
        spot = np.repeat(at - up - i * wide, many) + np.arange(lo, hi) * np.repeat(wide, many) + row[lo:hi]
        scores = x[spot]
        if x.max() > 60:
            for y, (_, _, c, d, _) in zip(parts, group, strict=True):
                most = y.max(1)
                y -= most[:, None]
                scores[c - lo : d - lo] -= most
        np.exp(x, out=x)
        for y, (a, b, c, d, _) in zip(parts, group, strict=True):
            np.matmul(y, ones[: b - a], out=sums[c - lo : d - lo])
        return x, parts, spot, scores, np.maximum(sums, np.float32(1e-37), out=sums)

    def log_probabilities(self, inputs: np.ndarray, sizes: np.ndarray, windows: int = 256) -> np.ndarray:
        """Natural logs of the probability of the id after each of the inputs: texts' ids end to end, sizes of them each; after a text's last one comes the end."""
        voc, mask, first, context, step = self.vocabulary, self._mask()[0], self._first(), self.context, self.step
        sizes = np.asarray(sizes)
        counts = -(-sizes // step)
        base = np.cumsum(counts * step + context) - (counts * step + context)
        begin = np.cumsum(sizes) - sizes
        padded = np.full(int((counts * step + context).sum()), -1, np.int32)
        padded[np.arange(len(inputs)) + np.repeat(base + context - begin, sizes)] = inputs
        starts = np.repeat(base - step * (np.cumsum(counts) - counts), counts) + step * np.arange(counts.sum())
        whole = np.lib.stride_tricks.sliding_window_view(padded, context + step)
        target = np.append(inputs[1:], voc.size + 1)
        target[begin + sizes - 1] = voc.size + 1
        lp, at = np.empty(len(target)), 0
        for lo in range(0, len(starts), windows):
            window = whole[starts[lo : lo + windows]]
            added, _, _, _, _, qe = self.attend(window, mask)
            added += qe[:, :, KEY:]
            live = np.flatnonzero(window[:, context:].ravel() >= 0)
            n = len(live)
            own = target[at : at + n]
            order, columns = voc.by_block(own)
            h = np.ones((n, STATE + 1), np.float32)
            h[:, :STATE] = added.reshape(-1, STATE).take(live[order], 0)
            x = h @ first
            row, found = voc.row[own[order]], np.empty(n)
            log_sums = np.empty(n)
            for c, a, b in columns:
                found[a:b] = x[a:b, c]
            if x.max() > 60:
                found -= x.max(1)
            log_sums[:] = np.log(_exp_sums(x))
            for group in voc.pieces(columns):
                i, j = group[0][2], group[-1][3]
                _, _, _, scores, sums = self.inside(h, group, row)
                found[i:j] += scores
                log_sums[i:j] += np.log(sums)
            lp[at + order] = found - log_sums
            at += n
        return lp


def start_model(counts: np.ndarray, context: int = 32, step: int = 32, seed: int = 1, begins: np.ndarray | None = None) -> Attention:
    """A model that knows how often ids occur (counts; the last is the ends), which ones begin words, and nothing else."""
    rng, voc = np.random.default_rng(seed), Vocabulary(counts[:-1], begins)
    size = voc.size
    shares = np.bincount(np.r_[voc.column[:size], voc.column[size + 1]], counts + np.r_[np.full(size, 0.1), 0.5], minlength=voc.columns)
    offer, ask = (rng.normal(0, 0.1, (size + 1, KEY + STATE)).astype(np.float32) for _ in range(2))
    offer[:, KEY:] *= 0.5
    tail = np.concatenate([rng.normal(0, 0.02, (len(voc.tail), STATE)), np.log(counts[voc.tail] + 0.1)[:, None]], 1).astype(np.float32)
    rest = np.concatenate([np.linspace(0, -1, context + 1), rng.normal(0, 0.1, STATE * voc.columns), np.log(shares / shares.sum())])[None].astype(np.float32)
    return Attention(voc, context, step, offer, ask, tail, rest)


def packed(ids: np.ndarray, sizes: np.ndarray, size: int, context: int, step: int) -> list[np.ndarray]:
    """Texts' ids, end to end, as stretches of at most _PIECE windows: `context` times none, the start, the ids, the end, none up to whole windows. A
    later stretch of a long text starts with the ids that its first window sees. Numbers are one higher than ids, 0 is none."""
    counts = -(-(sizes + 1) // step)
    length = context + 1 + counts * step
    base = np.cumsum(length) - length
    x = np.zeros(int(length.sum()), np.uint16 if size + 2 < 1 << 16 else np.int32)
    x[base + context] = size + 1
    x[np.arange(len(ids)) + np.repeat(base + context + 1 - np.cumsum(sizes) + sizes, sizes)] = ids + 1
    x[base + context + 1 + sizes] = size + 2
    out = []
    for b, k in zip(base.tolist(), counts.tolist(), strict=True):
        out += [x[b + lo * step : b + min(k, lo + _PIECE) * step + context + 1] for lo in range(0, k, _PIECE)]
    return out


def windows_of(stretches: list[np.ndarray], context: int, step: int) -> np.ndarray:
    """The windows of stretches of packed(), in rows of context + step + 1 ids; -1 marks none. Each id and each end is a target once."""
    length = np.array([len(x) for x in stretches])
    counts = (length - context - 1) // step
    starts = np.repeat(np.cumsum(length) - length - step * (np.cumsum(counts) - counts), counts) + step * np.arange(counts.sum())
    return np.lib.stride_tricks.sliding_window_view(np.concatenate(stretches).astype(np.int32) - 1, context + step + 1)[starts]


def start_energy(model: Attention) -> dict[str, np.ndarray]:
    """What AdaGrad knows before training: a mean of squared gradients for each row, for the parameters of the one row `rest` each its own."""
    return {k: np.full((len(p), p.shape[1] if k == "rest" else 1), 1e-6, np.float32) for k, p in model.parameters().items()}


def summed(ids: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids that occur, for each the sum of its rows of grad, and their number."""
    small = np.uint16 if ids.max(initial=0) < 1 << 16 else np.int64
    order = np.argsort(ids.astype(small), kind="stable")  # numbers of two bytes are sorted by digits
    ids = ids[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    pairs = grad.take(order, 0).view(np.complex64)  # two floats at a time: half the steps, the same sums
    return ids[first], np.add.reduceat(pairs, first, 0).view(np.float32), np.diff(np.r_[first, len(ids)])


def train(model: Attention, windows: np.ndarray, rate: float = 0.3, batch: int = 128, seed: int = 1, energy: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """Train model in place by AdaGrad on windows (rows of context + step + 1 ids; -1 marks none); returns how often each row of a parameter was touched.
    energy: what earlier training knew, which this one adds to."""
    voc, context, step = model.vocabulary, model.context, model.step
    params = model.parameters()
    energy = start_energy(model) if energy is None else energy
    squared = {k: np.broadcast_to(energy[k], p.shape).copy() for k, p in params.items()}
    touched = {k: np.zeros(len(p), np.float32) for k, p in params.items()}

    def update(name: str, rows, grad: np.ndarray, count) -> None:
        known = squared[name][rows]
        known += grad * grad
        squared[name][rows] = known
        grad /= np.sqrt(known)
        grad *= np.float32(rate)
        params[name][rows] -= grad
        touched[name][rows] += count

    def scatter(name: str, ids: np.ndarray, grad: np.ndarray) -> None:
        which, total, count = summed(ids, grad)
        update(name, which, total, count)

    gap = model._mask()[1]
    near = gap >= 0
    shuffled = windows[np.random.default_rng(seed).permutation(len(windows))]
    for lo in range(0, len(shuffled), batch):
        window, target = shuffled[lo : lo + batch, :-1], shuffled[lo : lo + batch, context + 1 :].ravel()
        window = np.where(window > voc.size, -1, window)  # nothing follows an end
        order, columns = voc.by_block(target)
        if not columns:
            continue
        n = columns[-1][2]
        order, dead, share = order[:n], order[n:], np.float32(1 / n)
        row, first = voc.row[target[order]], model._first()
        added, s, one_over, ids, kv, qe = model.attend(window, model._mask()[0])
        h = np.ones((n, STATE + 1), np.float32)
        h[:, :STATE] = (added + qe[:, :, KEY:]).reshape(-1, STATE).take(order, 0)
        x = h @ first
        x *= (share / _exp_sums(x))[:, None]
        for c, a, b in columns:
            x[a:b, c] -= share
        g, of_first = x @ first.T, h.T @ x
        top = voc.edges[columns[-1][0]] if columns[-1][0] else 0
        of_tail, often = np.zeros((top, STATE + 1), np.float32), np.zeros(top, np.float32)
        for group in voc.pieces(columns):
            start, stop = group[0][2], group[-1][3]
            d, blocks, spot, _, sums = model.inside(h, group, row)
            np.divide(share, sums, out=sums)
            for y, (_, _, i, j, _) in zip(blocks, group, strict=True):
                y *= sums[i - start : j - start, None]
            d[spot] -= share
            g_in = np.empty((stop - start, STATE + 1), np.float32)
            for y, (up, end, i, j, _) in zip(blocks, group, strict=True):
                np.matmul(y, model.tail[up:end], out=g_in[i - start : j - start])
                of_tail[up:end] += y.T @ h[i:j]
                often[up:end] += j - i
            g[start:stop] += g_in
        update("tail", slice(0, top), of_tail, often)
        gh = np.empty((len(window) * step, STATE), np.float32)
        gh[order], gh[dead] = g[:, :STATE], 0
        gh = gh.reshape(len(window), step, STATE)
        g_ask, g_offer = np.empty(qe.shape, np.float32), np.empty(kv.shape, np.float32)
        g_ask[:, :, KEY:] = gh
        gh *= one_over[:, :, None]
        gs = np.matmul(gh, kv[:, :, KEY:].transpose(0, 2, 1))
        gs -= np.einsum("bij,bij->bi", gh, added)[:, :, None]
        gs *= s
        np.matmul(gs.transpose(0, 2, 1), qe[:, :, :KEY], out=g_offer[:, :, :KEY])
        np.matmul(s.transpose(0, 2, 1), gh, out=g_offer[:, :, KEY:])
        np.matmul(gs, kv[:, :, :KEY], out=g_ask[:, :, :KEY])
        by_gap = np.bincount(gap[near], gs.sum(0)[near], minlength=context + 1).astype(np.float32)
        scatter("offer", ids.ravel(), g_offer.reshape(-1, KEY + STATE))
        scatter("ask", ids[:, context:].ravel(), g_ask.reshape(-1, KEY + STATE))
        update("rest", slice(None), np.concatenate([by_gap, of_first.ravel()])[None], 1)
    for k, x in squared.items():
        energy[k][:] = x if k == "rest" else x.mean(1, keepdims=True)
    return touched


@dataclass
class Shared:
    """What scoring tasks need, all of bounded size: the model, counts of the most frequent words, and of stretches so frequent that they would crowd one task."""

    model: Attention
    path: str
    total: int
    distinct: int
    ends: int
    groups: int  # parts of the memory
    recalled: int = 0
    key: str = ""
    hot: dict[bytes, int] = field(default_factory=dict)
    hot_stretches: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


@dataclass
class Learned:
    shared: Shared
    words: DataFrame  # (word, n)
    memory: DataFrame  # (part, data): sorted stretches and their counts


_GATHERED = "kind int, word string, n long, part int, data binary"
_STRETCH = np.dtype([("value", "<u8"), ("n", "<i8")])
_ASKED = np.dtype([("value", "<u8"), ("log", "<f4"), ("own", "<u4"), ("row", "<u4")])


def _dealt(rows: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """rows by the part that their value falls in."""
    part = (rows["value"] >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(groups + 1))
    for p in np.flatnonzero(np.diff(ends)).tolist():
        yield p, rows[order[ends[p] : ends[p + 1]]].tobytes()


def gather(docs: DataFrame, path: str, groups: int, context: int = 32, step: int = 32) -> DataFrame:
    """What training texts (text) give, from one pass: word counts (kind 0), counts of stretches by part (1; n is their sum) and the ids of all texts to train on (2; n
    is the number of windows). The end of each text counts as the word ''. Tasks add up before they hand on, in tables of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, size = encoder(path)
        table, counts, ends = Words(enc), np.zeros(1024, np.int64), 0
        held: list[np.ndarray] = []
        seen = 0

        def rows(kind: int, word=None, n=(), part=None, data=None) -> pa.RecordBatch:
            k, none = len(n), [None] * len(n)
            return pa.RecordBatch.from_arrays([pa.array([kind] * k, pa.int32()), pa.array(word or none, pa.string()), pa.array(n, pa.int64()), pa.array(part or none, pa.int32()), pa.array(data or none, pa.binary())], names=["kind", "word", "n", "part", "data"])

        def words_out() -> pa.RecordBatch:
            nonlocal counts, ends
            done = rows(0, [*(w.decode() for w in table.number), ""], [*counts[: len(table.number)].tolist(), ends])
            table.drop()
            counts, ends = np.zeros(1024, np.int64), 0
            return done

        def stretches_out() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            table = np.empty(len(value), _STRETCH)
            table["value"], table["n"] = value, n
            out = list(_dealt(table, groups))
            held.clear()
            return rows(1, None, [int(np.frombuffer(d, _STRETCH)["n"].sum()) for _, d in out], [p for p, _ in out], [d for _, d in out])

        def to_train(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            while found:
                some, n = [], 0
                while found and n < _PIECE:
                    some.append(found.pop())
                    n += (len(some[-1]) - context - 1) // step
                head = np.array([len(some), *map(len, some)], np.int32)
                yield rows(2, None, [n], None, [head.tobytes() + np.concatenate(some).tobytes()])

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                texts = [words_of(t) for t in b.column(0).slice(lo, 256).cast(pa.binary()).to_pylist()]
                number = table.numbers([w for t in texts for w in t])
                ends += len(texts)
                if len(table.number) > len(counts):
                    counts = np.concatenate([counts, np.zeros(2 * len(table.number), np.int64)])
                some = np.bincount(number)
                counts[: len(some)] += some
                sizes = np.array([len(t) for t in texts])
                h = table.hash[number]
                _, value, _ = stretches(h, sizes)
                if len(value):
                    held.append(value)
                    seen += len(value)
                of_text = np.bincount(np.repeat(np.arange(len(texts)), sizes), table.length[number], minlength=len(texts)).astype(np.int64)
                yield from to_train(packed(table.subwords(number), of_text, size, context, step))
                if len(table.number) > _TABLE_WORDS:
                    yield words_out()
                if seen > _FLUSH:
                    yield stretches_out()
                    seen = 0
        if ends:
            yield words_out()
        if held:
            yield stretches_out()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, _GATHERED)


def _id_counts(words: DataFrame, path: str) -> DataFrame:
    """(id, n): how often each subword id occurs in words (word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, size = encoder(path)
        counts = np.zeros(size, np.int64)
        for b in batches:
            lists = pieces(enc, b.column(0).cast(pa.binary()).to_pylist())
            counts += np.bincount([i for x in lists for i in x], np.repeat(b.column(1).to_numpy(), [len(x) for x in lists]), minlength=size).astype(np.int64)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(counts[there])], names=["id", "n"])

    return words.where("word <> ''").select("word", "n").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _averaged(updates: DataFrame) -> DataFrame:
    """(name, slice, data) -> the same with one row for each name and slice: changes of rows, weighed by how often they were touched."""

    def merge(key, table):
        rows = np.concatenate([_change(d) for d in table.column("data").to_pylist()])
        order = np.argsort(rows[:, 0], kind="stable")
        _, first = np.unique(rows[order, 0], return_index=True)
        sums = np.add.reduceat(rows[order], first)
        sums[:, 0] = rows[order[first], 0]
        return pa.table({"name": pa.array([key[0].as_py()]), "slice": pa.array([key[1].as_py()], pa.int32()), "group": pa.array([0], pa.int32()), "data": pa.array([_told(sums)], pa.binary())})

    schema = "name string, slice int, group int, data binary"
    # in two steps, so that no task adds up what very many others made
    some = updates.groupBy("name", "slice", "group").applyInArrow(merge, schema)
    return some.groupBy("name", "slice").applyInArrow(merge, schema)


def _told(rows: np.ndarray) -> bytes:
    """Rows of (row, times touched, energy, change) as bytes that start with their width."""
    return np.int32(rows.shape[1]).tobytes() + np.ascontiguousarray(rows, np.float32).tobytes()


def _change(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float32, offset=4).reshape(-1, int(np.frombuffer(data[:4], np.int32)[0]))


def dealt(total: int, each: int) -> tuple[int, int]:
    """(rounds, copies a round) for k tasks of about `each` of `total` windows: about twice the cube root of k rounds, and a few more if copies so fill whole waves of tasks:
    a last wave of one task keeps all other cores waiting until its changes are averaged."""
    tasks = -(-total // each)
    rounds = min(tasks, int(np.ceil(2 * tasks ** (1 / 3))))
    copies = -(-tasks // rounds)
    copies -= copies % _WAVE if copies > _WAVE else 0
    return max(rounds, -(-tasks // copies)), copies


def fit(found: DataFrame, model: Attention, each: int = 65_536, rate: float = 0.3) -> Attention:
    """model after training once through all windows of found (n, data; from gather()). A task trains its copy on about `each` windows in a round. Rounds (see dealt())
    are dealt by hash: depth and breadth both grow with the corpus. Changes are averaged on executors, and the driver gets the averages, which are as large as the model."""
    spark, slices = found.sparkSession, 512
    total = found.agg(F.sum("n")).first()[0] or 0
    if not total:
        return model
    rounds, copies = dealt(total, each)
    by = F.xxhash64("data")
    # a round's rows lie in a folder of their own, in few files
    by_round = cut(found.select("data", F.pmod(by, F.lit(rounds)).alias("round")).repartition("round", F.pmod(F.shiftright(by, 32), F.lit(-(-copies // 8)))), "round")
    energy = start_energy(model)
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((model, energy))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, r=r) -> Iterator[pa.RecordBatch]:
            hold_freed()
            old, before = shared.value
            kind, held = np.uint16 if old.vocabulary.size + 2 < 1 << 16 else np.int32, []
            for b in batches:
                for d in b.column(0).to_pylist():
                    n = int(np.frombuffer(d[:4], np.int32)[0])
                    length = np.frombuffer(d, np.int32, n, 4)
                    held += np.split(np.frombuffer(d, kind, offset=4 + 4 * n), np.cumsum(length)[:-1])
            if not held:
                return
            own = Attention(old.vocabulary, old.context, old.step, *[p.copy() for p in old.parameters().values()])
            after = {k: e.copy() for k, e in before.items()}
            touched = train(own, windows_of(held, old.context, old.step), rate, seed=r + 1, energy=after)
            group = TaskContext.get().partitionId() // 64
            for name, p in own.parameters().items():
                rows = np.flatnonzero(touched[name])
                often = touched[name][rows][:, None]
                out = np.concatenate([rows[:, None], often, (after[name] - before[name])[rows] * often, (p[rows] - old.parameters()[name][rows]) * often], 1)
                part = rows // slices
                for k in np.unique(part).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int32()), pa.array([group], pa.int32()), pa.array([_told(out[part == k])], pa.binary())], names=["name", "slice", "group", "data"])

        own_share = by_round.where(F.col("round") == r).select("data").repartition(copies)
        made = cut(own_share.mapInArrow(lean(run), "name string, slice int, group int, data binary"))
        changes = _averaged(made).toArrow()
        discard(made)
        model = Attention(model.vocabulary, model.context, model.step, *[p.copy() for p in model.parameters().values()])
        energy = {k: e.copy() for k, e in energy.items()}
        for name, d in zip(changes.column("name").to_pylist(), changes.column("data").to_pylist(), strict=True):
            x, wide = _change(d), energy[name].shape[1]
            rows = x[:, 0].astype(np.int64)
            energy[name][rows] += x[:, 2 : 2 + wide] / x[:, 1:2]
            model.parameters()[name][rows] += x[:, 2 + wide :] / x[:, 1:2]
        shared.destroy()
    discard(by_round)
    return model


def learn(docs: DataFrame, path: str, hot_words: int = 400_000, each: int = 65_536) -> Learned:
    """What scoring docs needs from training texts docs (text): all of them give counts and the memory, and train attention. The memory has a part for about
    every 200 MB of text, so what one task holds of it does not grow with the corpus."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    groups = max(parts(docs.sparkSession), size // _PART_BYTES)
    found = cut(gather(docs, path, groups))
    words = cut(found.where("kind = 0").groupBy("word").agg(F.sum("n").alias("n")))

    def merge(key, table):
        rows = np.concatenate([np.frombuffer(d, _STRETCH) for d in table.column("data").to_pylist()])
        value, place = np.unique(rows["value"], return_inverse=True)
        out = np.empty(len(value), _STRETCH)
        out["value"], out["n"] = value, np.bincount(place, rows["n"])
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([out.tobytes()], pa.binary())})

    memory = cut(found.where("kind = 1").select("part", "data").groupBy("part").applyInArrow(merge, "part int, data binary"))
    recalled = found.where("kind = 1").agg(F.sum("n")).first()[0] or 0
    least = max(2, recalled // min(16 * groups, _HOT_STRETCHES))  # so no more than that many are that frequent

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d in b.column(0).to_pylist():
                rows = np.frombuffer(d, _STRETCH)
                rows = rows[rows["n"] >= least]
                yield pa.RecordBatch.from_arrays([pa.array(rows["value"].view(np.int64)), pa.array(rows["n"])], names=["value", "n"])

    hot = memory.select("data").mapInArrow(frequent, "value long, n long").toArrow()
    values, often = hot.column("value").to_numpy().view(np.uint64), hot.column("n").to_numpy()
    by = np.argsort(values)

    total, distinct, ends = words.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word") == "", F.col("n")))).first()
    enc, size = encoder(path)
    counts = np.zeros(size + 1)
    for i, n in _id_counts(words, path).collect():  # a row for each id
        counts[i] = n
    counts[size] = ends or 0
    model = fit(found.where("kind = 2"), start_model(counts, begins=begin_words(path)), each)

    top = words.where("word <> ''").orderBy(F.desc("n"), "word").limit(hot_words).toArrow()
    known = dict(zip((w.encode() for w in top.column("word").to_pylist()), top.column("n").to_pylist(), strict=True))
    return Learned(Shared(model, path, int(total or 0), int(distinct), int(ends or 0), groups, int(recalled), uuid.uuid4().hex, known, (values[by], often[by])), words, memory)


def recalled_gain(log10: np.ndarray, count: np.ndarray, total: int) -> np.ndarray:
    """By how much log10 of a stretch's probability rises, over not being recalled, if it stands `count` times among `total` stretches."""
    own, memory = log10 + np.log10(1 - RECALL), np.log10(RECALL * np.maximum(count, 1e-9) / max(1, total))
    return np.where(count > 0, np.logaddexp(own * np.log(10), memory * np.log(10)) / np.log(10) - own, 0.0)


def score(docs: DataFrame, learned: Learned, trained_on: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and attention_score for every row of docs (doc_id, text).

    Tokens are words and one end. base_score sums log10((c + 1) / (N + V + 1)), score is the log10 probability by the model, and attention_score that of
    the attention without the memory. trained_on is true for rows that were learned from: what they hold is taken off the memory's counts for
    them. Null and empty texts are one end. Counts of frequent words and stretches are at hand in the tasks; the others are joined with the counts of
    all. Rows may repeat and ids may be null; other columns are ignored; an empty table gives no rows.
    """
    spark, groups = docs.sparkSession, learned.shared.groups
    held = spark.sparkContext.broadcast(learned.shared)
    flag = F.lit(False) if trained_on is None else F.coalesce(trained_on, F.lit(False))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), flag.alias("trained"), F.col("text").cast("string").alias("text"))
    names = ["task", "row", "doc_id", "n_tokens", "sure", "base", "attention", "gain", "cold", "part", "data"]
    rare_words = pa.list_(pa.struct([("word", pa.string()), ("k", pa.int64())]))
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), rare_words, pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_freed()
        s, task, row = held.value, TaskContext.get().partitionId(), 0
        enc, size = encoder(s.path)
        if _state.get("for") != s.key:  # a worker that runs several tasks sets up once
            _state.update({"for": s.key, "table": Words(enc, list(s.hot)), "counts": np.fromiter(s.hot.values(), np.float64, len(s.hot))})
        table, often = _state["table"], _state["counts"]
        table.drop()
        log_n = np.log10(s.total + s.distinct + 1)
        hot_values, hot_counts = s.hot_stretches
        asked: list[np.ndarray] = []

        def questions() -> pa.RecordBatch:
            out = list(_dealt(np.concatenate(asked), groups))
            asked.clear()
            cols = [[task] * len(out), *[[None] * len(out)] * 8, [p for p, _ in out], [d for _, d in out]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for whole in batches:
            for lo in range(0, whole.num_rows, 128):
                b = whole.slice(lo, 128)
                texts = [words_of(t) for t in b.column(2).cast(pa.binary()).to_pylist()]
                words = [w for t in texts for w in t]
                # frequent words stay in the worker; a rare one seldom comes again, so it is worked out with its batch
                number = table.numbers(words)
                sizes = np.array([len(t) for t in texts])
                doc = np.repeat(np.arange(len(texts)), sizes)
                lengths, ids = table.length[number], table.subwords(number)
                hashes, hot = table.hash[number], number < len(often)
                n = np.where(hot, often[np.minimum(number, len(often) - 1)] if len(often) else 0.0, 0.0)
                table.drop()
                inputs = np.full(len(ids) + len(texts), size, np.int32)
                inputs[np.arange(len(ids)) + np.repeat(doc, lengths) + 1] = ids
                of_text = np.bincount(doc, lengths, minlength=len(texts)).astype(np.int64) + 1
                lp = s.model.log_probabilities(inputs, of_text) / np.log(10)
                by_doc = lambda x: np.bincount(doc, x, minlength=len(texts))  # noqa: B023, E731
                # log probabilities stand where the id before is, and each text has a start in front and an end behind
                upto = np.r_[0.0, np.cumsum(lp)]
                at = np.cumsum(lengths) - lengths + doc
                word_lp = upto[at + lengths] - upto[at]
                attention = by_doc(word_lp) + lp[np.cumsum(of_text) - 1]
                base = by_doc(np.where(hot, np.log10(n + 1) - log_n, 0.0)) + np.log10(s.ends + 1) - log_n
                sure = by_doc(hot.astype(np.float64)).astype(np.int64) + (s.ends > 0)
                cold: list[list[dict]] = [[] for _ in texts]
                which = np.flatnonzero(~hot)
                for (d, w), k in Counter(zip(doc[which].tolist(), [words[i] for i in which.tolist()], strict=True)).items():
                    cold[d].append({"word": w.decode(), "k": k})
                gain = np.zeros(len(texts))
                first, value, of = stretches(hashes, sizes)
                if len(first):
                    log = np.add.reduceat(word_lp, first)
                    _, place, times = np.unique(_mix(value + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
                    own = np.where(np.asarray(b.column(1).to_numpy(zero_copy_only=False), bool)[of], times[place], 0)
                    spot = np.minimum(np.searchsorted(hot_values, value), max(0, len(hot_values) - 1))
                    here = hot_values[spot] == value if len(hot_values) else np.zeros(len(value), bool)
                    count = np.where(here, (hot_counts[spot] if len(hot_values) else 0) - own, 0)
                    gain = np.bincount(of, np.log10(1 - RECALL) + recalled_gain(log, count, s.recalled), minlength=len(texts))
                    away = np.flatnonzero(~here)
                    question = np.empty(len(away), _ASKED)
                    question["value"], question["log"], question["own"], question["row"] = value[away], log[away], own[away], row + of[away]
                    asked.append(question)
                cols = [[task] * len(texts), np.arange(row, row + len(texts)), b.column(0), [len(t) + 1 for t in texts], sure, base, attention, gain, cold, [None] * len(texts), [None] * len(texts)]
                row += len(texts)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
                if sum(map(len, asked)) > _FLUSH:
                    yield questions()
        if asked:
            yield questions()

    made = cut(source.mapInArrow(lean(run), "task int, row long, doc_id long, n_tokens long, sure long, base double, attention double, gain double, cold array<struct<word:string,k:long>>, part int, data binary"))
    first = made.where("row IS NOT NULL")
    log_n = float(np.log10(learned.shared.total + learned.shared.distinct + 1))
    rare = first.select("task", "row", F.explode("cold").alias("c")).select("task", "row", "c.word", "c.k").join(learned.words, "word", "left")
    counted = rare.select("task", "row", F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0).alias("more"), (F.col("k") * (F.log10(F.coalesce("n", F.lit(0)) + 1) - log_n)).alias("base_more"), F.lit(0.0).alias("gained"))
    total = learned.shared.recalled

    def recall(key, table):
        kinds, tasks, data = (table.column(c).to_pylist() for c in ("kind", "task", "data"))
        memory = np.concatenate([np.zeros(0, _STRETCH), *[np.frombuffer(d, _STRETCH) for k, d in zip(kinds, data, strict=True) if k == 0]])
        out: list[list] = [[], [], []]
        for k, t, d in zip(kinds, tasks, data, strict=True):
            if k == 1 and len(memory):
                q = np.frombuffer(d, _ASKED)
                spot = np.minimum(np.searchsorted(memory["value"], q["value"]), len(memory) - 1)
                count = np.where(memory["value"][spot] == q["value"], memory["n"][spot] - q["own"].astype(np.int64), 0)
                hit = np.flatnonzero(count > 0)
                rows, place = np.unique(q["row"][hit], return_inverse=True)
                out[0] += [t] * len(rows)
                out[1] += rows.tolist()
                out[2] += np.bincount(place, recalled_gain(q["log"][hit].astype(np.float64), count[hit], total), minlength=len(rows)).tolist()
        return pa.table({"task": pa.array(out[0], pa.int32()), "row": pa.array(out[1], pa.int64()), "gained": pa.array(out[2], pa.float64())})

    both = learned.memory.select("part", F.lit(0).alias("kind"), F.lit(0).alias("task"), "data").unionByName(made.where("part IS NOT NULL").select("part", F.lit(1).alias("kind"), "task", "data"))
    gained = both.groupBy("part").applyInArrow(recall, "task int, row long, gained double").select("task", "row", F.lit(0).cast("long").alias("more"), F.lit(0.0).alias("base_more"), "gained")
    sums = counted.unionByName(gained).groupBy("task", "row").agg(*[F.sum(c).alias(c) for c in ("more", "base_more", "gained")])
    joined = first.drop("cold", "part", "data").join(sums, ["task", "row"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        "doc_id", "n_tokens", (F.col("sure") + zero("more")).cast("long").alias("n_known"), F.lit(learned.shared.total).cast("long").alias("train_tokens"), (F.col("base") + zero("base_more")).alias("base_score"),
        (F.col("attention") + F.col("gain") + zero("gained")).alias("score"), F.col("attention").alias("attention_score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = learn(docs.where(~held_out(F.col("doc_id"))), str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    out = score(docs, learned, ~held_out(F.col("doc_id")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "attention_score")


ORACLE_SQL = None  # a trained model; tests/llm holds counts, base_score and score against a brute-force version
