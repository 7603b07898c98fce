"""Best-fit packing of token sequences by bin completion.

Documents are tokenised, cut where they exceed the capacity, and packed. What the search needs to know is only how many pieces there are of each
length, so it runs on a histogram of at most `capacity` rows: it takes the largest length left, enumerates undominated completions of its bin (a
filling is dominated if a longer piece fits the same place) depth first, prunes by the least waste that the sums of the lengths left allow, starts from the best-fit
filling as incumbent, and uses the completion found for as many bins as the counts allow. Every use lowers some length's count below what a bin
needs, so the list of bins stays short however many documents there are. Spark then numbers the pieces of each length, dealt over many tasks, and a
join on (length, number) gives each its bin and place.
"""

from __future__ import annotations

import bisect
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import cut, lean, parts, read_table

NAME = "op9_pack_sequences"
CAPACITY, END_ID = 4096, 1

_CACHE_RUNS = 200_000
#: In texts of these characters, once in lower case, the tokenizer's normalizer changes nothing but white space and its pattern finds _RUNS.
_PLAIN = re.compile(r"[\t-\r -~ß-öø-ÿ]*")
_RUNS = re.compile(r"'(?:[stmd]|re|ve|ll)|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+")
_state: dict = {}


def _byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}


def _tokenizer(path: str) -> dict:
    """The tokenizer and what it has encoded so far, kept in the worker."""
    if _state.get("path") != path:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        _state.update(path=path, tok=tok, model=tok.model, runs={}, characters=_byte_characters())
    return _state


def _forget() -> None:
    """The tokenizer goes, too: it is read anew in less than a second."""
    _state.clear()


def _encode(texts: list[bytes], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers.

    This tokenizer lower-cases, drops white space, splits runs of letters and of signs and digits apart and merges nothing across them, so each
    distinct run goes to its model once and is looked up from then on. Words of other characters go through the whole tokenizer, and so does a text
    that may hold the string of a special token.
    """
    state = _tokenizer(path)
    known, tok, model, characters, out = state["runs"], state["tok"], state["model"], state["characters"], []
    packed = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
    for t in texts:
        text = t.decode()
        if "<|" in text:
            out.append(packed(tok.encode(text, add_special_tokens=False).ids))
            continue
        low = text.lower()
        if _PLAIN.fullmatch(low):
            runs = _RUNS.findall(low)
        else:
            runs = []
            for w in t.split():
                word = w.decode().lower()
                runs += _RUNS.findall(word) if _PLAIN.fullmatch(word) else (w,)
        for r in set(runs).difference(known):
            if isinstance(r, bytes):
                known[r] = packed(tok.encode(r.decode(), add_special_tokens=False).ids)
            else:
                known[r] = packed([x.id for x in model.tokenize(r.encode().decode("latin-1").translate(characters))])
        out.append(b"".join([known[r] for r in runs]))
        if len(known) > _CACHE_RUNS:
            known.clear()
    return out


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids (binary, little-endian unsigned 32-bit) of each piece of each text of docs.

    A text's ids are followed by end_id, so a null or empty text has one piece of one id. Only texts of more than capacity ids are cut, into pieces of
    capacity ids of which the last may be shorter. tokenizer_path names a word-level BPE of the tokenizers library that drops white space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, step = end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [x + end for x in _encode([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()], tokenizer_path)]
                doc, piece, cuts = [], [], []
                for d, x in zip(part.column(0).to_pylist(), ids, strict=True):
                    for k in range(0, len(x), step):
                        doc.append(d)
                        piece.append(k // step)
                        cuts.append(x[k : k + step])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array([p * capacity for p in piece], pa.int64()), pa.array([len(c) // 4 for c in cuts], pa.int64()), pa.array(cuts, pa.binary())],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run, _forget), "doc_id long, piece int, start long, length long, ids binary")


def _reachable(lengths: list[int], capacity: int) -> dict[int, int]:
    """length -> the sums up to capacity that pieces of that length and shorter ones can make, however many there are, as a set of bits."""
    full, sums, out = (1 << (capacity + 1)) - 1, 1, {}
    for n in lengths:
        step = n
        while step <= capacity and sums != full:
            sums |= (sums << step) & full
            step *= 2
        out[n] = sums
    return out


def _complete(lengths: list[int], counts: dict[int, int], first: int, room: int, nodes: int, reach: dict[int, int]) -> list[int]:
    """The completion of a bin that holds one piece of length first, with the least waste found: lengths in descending order."""
    best, least = [], room
    filling: list[int] = []
    used: dict[int, int] = {first: 1}

    def search(room: int, top: int, limit: int) -> bool:
        """limit: fillings of this branch with so much waste are dominated."""
        nonlocal best, least, nodes
        if room < least:
            best, least = filling.copy(), room
        if least == 0 or nodes <= 0:
            return True
        nodes -= 1
        if room <= top and counts.get(room, 0) > used.get(room, 0):  # one piece closes the bin exactly
            best, least = [*filling, room], 0
            return True
        i = bisect.bisect_right(lengths, min(room, top)) - 1
        fits, longer = (1 << (room + 1)) - 1, 0
        while i >= 0:
            n = lengths[i]
            i -= 1
            if counts[n] <= used.get(n, 0):
                continue
            # bound: the largest sum within the room that n and shorter lengths make; shorter ones alone make no larger one
            waste = room + 1 - (reach[n] & fits).bit_length()
            if waste >= min(least, limit):
                break
            # dominance: where a filling wastes what the next longer piece at hand is longer, that piece fits the place of n
            within = min(limit, longer - n) if longer else limit
            longer = n
            if waste >= within:
                continue
            used[n] = used.get(n, 0) + 1
            filling.append(n)
            done = search(room - n, n, within)
            filling.pop()
            used[n] -= 1
            if done:
                return True
        return False

    search(room, room, room + 1)
    return best


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = 400) -> list[tuple[int, list[int]]]:
    """(number of bins, lengths in each) that hold every piece of a histogram of lengths.

    Bins are completed one after the other by search, nodes bounding each; beyond it the best found so far is used. The fullest bins first can leave
    lengths that fit badly together, so that is done with shorter searches as well. The incumbents are the best-fit-decreasing plan of all pieces and, for
    pieces of which few fit a bin, the plan of evenly filled bins: one that needs fewer bins than all completions is taken."""
    least, best = -(-sum(n * c for n, c in histogram.items() if c > 0) // capacity), None
    bins = lambda plan: sum(t for t, _ in plan)
    for budget in dict.fromkeys(max(1, nodes // k) for k in (1, 4, 13, 33, 50, 66, 80)):
        plan = _plan(histogram, capacity, budget)
        if best is None or bins(plan) < bins(best):
            best = plan
        if bins(best) <= least:
            return best
    for plan in (_best_fit(histogram, capacity), _even(histogram, capacity)):
        if plan is not None and bins(plan) < bins(best):
            best = plan
    return best


def _best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Longest pieces first, each into the bin it fills best; bins that are filled alike are handled together."""
    rooms: list[int] = []
    bins: dict[int, list[tuple[int, list[int]]]] = {}

    def put(room: int, times: int, filling: list[int]) -> None:
        if times:
            if room not in bins:
                bisect.insort(rooms, room)
            bins.setdefault(room, []).append((times, filling))

    for n in sorted((n for n, c in histogram.items() if c > 0), reverse=True):
        left = histogram[n]
        while left:
            i = bisect.bisect_left(rooms, n)
            if i == len(rooms):
                room, times, filling = capacity, left, []
            else:
                room = rooms[i]
                times, filling = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[i]
            each = room // n  # a bin that has taken one still fits best
            full = min(times, left // each)
            put(room - each * n, full, filling + [n] * each)
            left -= full * each
            some = int(full < times and 0 < left < each)  # one more bin takes the last of them
            if some:
                put(room - left * n, 1, filling + [n] * left)
                left = 0
            if filling:
                put(room, times - full - some, filling)
    return [x for room in rooms for x in bins[room]]


def _even(histogram: dict[int, int], capacity: int, most: int = 6) -> list[tuple[int, list[int]]] | None:
    """As many bins of k of the shortest pieces as fit when they are filled evenly, for k from the largest number that fits a bin down to 1; None where
    that is more than `most`. Pieces between two unit fractions of the capacity pack badly if the fullest bins come first."""
    runs = sorted((n, c) for n, c in histogram.items() if c > 0)
    if not runs or capacity // runs[0][0] > most:
        return None
    out: list[tuple[int, list[int]]] = []
    for k in range(capacity // runs[0][0], 0, -1):
        lo, hi = 0, sum(c for _, c in runs) // k
        while lo < hi:
            m = (lo + hi + 1) // 2
            lo, hi = (m, hi) if all(s <= capacity for s, _, _ in _dealt(_first(runs, k * m), k, m)) else (lo, m - 1)
        if lo:
            out += [(t, list(f)) for _, t, f in _dealt(_first(runs, k * lo), k, lo)]
            runs = _after(runs, k * lo)
        if not runs:
            break
    return out


def _first(runs: list[tuple[int, int]], count: int) -> list[tuple[int, int]]:
    out = []
    for n, c in runs:
        if count <= 0:
            break
        out.append((n, min(c, count)))
        count -= c
    return out


def _after(runs: list[tuple[int, int]], count: int) -> list[tuple[int, int]]:
    out = []
    for n, c in runs:
        if c > count:
            out.append((n, c - max(0, count)))
        count = max(0, count - c)
    return out


def _dealt(runs: list[tuple[int, int]], k: int, bins: int) -> list[tuple[int, int, tuple[int, ...]]]:
    """(sum, how many bins, filling) of k * bins pieces, k in each bin: the longest pieces meet the least sums of the others."""
    if k == 1:
        return [(n, c, (n,)) for n, c in runs]
    rest = sorted(_dealt(_first(runs, (k - 1) * bins), k - 1, bins))
    top = _after(runs, (k - 1) * bins)[::-1]
    out, i, j, used_top, used_rest = [], 0, 0, 0, 0
    while i < len(top):
        n, c = top[i]
        s, times, filling = rest[j]
        t = min(c - used_top, times - used_rest)
        out.append((n + s, t, (n, *filling)))
        used_top, used_rest = used_top + t, used_rest + t
        if used_top == c:
            i, used_top = i + 1, 0
        if used_rest == times:
            j, used_rest = j + 1, 0
    return out


def _plan(histogram: dict[int, int], capacity: int, nodes: int) -> list[tuple[int, list[int]]]:
    counts = {n: c for n, c in histogram.items() if c > 0}
    lengths, out = sorted(counts), []
    reach, had = _reachable(lengths, capacity), len(lengths)
    while lengths:
        if len(lengths) < 0.9 * had:  # with lengths that are used up it is still a bound, but a weaker one
            reach, had = _reachable(lengths, capacity), len(lengths)
        first = lengths[-1]
        filling = [first, *_complete(lengths, counts, first, capacity - first, nodes, reach)]
        need = {n: filling.count(n) for n in set(filling)}
        times = min(counts[n] // k for n, k in need.items())
        out.append((times, filling))
        for n, k in need.items():
            counts[n] -= times * k
            if not counts[n]:
                del counts[n]
                lengths.pop(bisect.bisect_left(lengths, n))
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = 400) -> DataFrame:
    """pieces, which have a column length of 1 to capacity, each with its sequence_id and offset (which replace columns of these names); others are carried along.

    Pieces of one length are interchangeable, so which of several equal rows gets which place is of no account. Each length's pieces are dealt by a
    hash of the columns that can be hashed over as many groups as the session has shuffle partitions and numbered there, so a length that many pieces share is no hot spot. The driver
    sees a count for each length, capacity rows at most. An empty table gives no rows.
    """
    pieces = pieces.select(*[c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")])
    spark, names = pieces.sparkSession, pieces.columns
    groups, plain = parts(spark), [c for c, kind in pieces.dtypes if "map<" not in kind and "variant" not in kind]
    dealt = cut(pieces.withColumn("__g", F.pmod(F.xxhash64(F.lit(0), *[c for c in plain if c != "length"]), F.lit(groups))))
    by_group = dealt.groupBy("length", "__g").agg(F.count("*").alias("__n"))
    starts = by_group.select("length", "__g", (F.sum("__n").over(W.partitionBy("length").orderBy("__g")) - F.col("__n")).alias("__from"))
    bins = plan_bins({r[0]: r[1] for r in dealt.groupBy("length").count().collect()}, capacity, nodes)
    slots, seq, used = [], 0, {}
    for times, filling in bins:
        at = 0
        for n in filling:
            lo = used.get(n, 0)
            slots.append((n, lo, lo + times, seq, at))
            used[n], at = lo + times, at + n
        seq += times
    table = spark.createDataFrame(slots, "length long, lo long, hi long, seq long, at long")
    # one row per length: its intervals of numbers in ascending order, so that a place in the array is found by counting lower starts
    table = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "seq", "at"))).alias("__slots"))
    numbered = dealt.withColumn("__r", F.row_number().over(W.partitionBy("length", "__g").orderBy(*plain))).join(starts, ["length", "__g"]).withColumn("__r", F.col("__from") + F.col("__r") - 1)
    found = numbered.join(F.broadcast(table), "length").withColumn("__s", F.element_at(F.filter("__slots", lambda s: (s["lo"] <= F.col("__r")) & (F.col("__r") < s["hi"])), 1))
    return found.select(*names, (F.col("__s.seq") + F.col("__r") - F.col("__s.lo")).alias("sequence_id"), F.col("__s.at").alias("offset"))


def query(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents") if docs is None else docs
    pieces = tokenize(docs, str(public_tokenizers.path("word_bpe_49k.json")))
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


ORACLE_SQL = None  # SQL has no tokenizer; tests/llm holds it against the tokenizer and a lower bound of bins
