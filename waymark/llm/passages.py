"""Substring deduplication by collinear chaining.

Seeds are hashes of k consecutive words, thinned to window minima (minimizers), so that any shared run of
K + WINDOW - 1 words has a common seed and any run of K + 2 * WINDOW - 1 words has two. A shuffle by seed gives every seed, and every
pair of seeds some words apart, the first document that has it; matches of one document with another are chained in order
with gap costs, the best predecessor read from a Fenwick tree of prefix maxima. Each chain is aligned from match to match
and beyond its ends: equal words extend the matches, and a sparse dynamic programme (longest common subsequence of words)
fills the gaps between them. The stretches of an alignment that pay are passages, exact and fuzzy ones.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import CHUNK_ROWS, map_batches, release_memory, texts_of, tidy, unused_name
from waymark.session import checkpointed, ship_package, written

#: Words of a seed, and seeds of which the smallest is kept; ``COARSE`` is the window of those that begin or end pairs of seeds.
K, WINDOW, COARSE = 5, 8, 16
#: Matches below which two documents can't share a passage.
MIN_MATCHES = 2
#: Cost of a word of gap (mean of both sides), weight of a seed, and the longest gap inside a chain, in words.
GAP_COST, SEED_WEIGHT, MAX_GAP = 0.12, 5.0, 53
#: Words read beyond both ends of a chain, and code points that they may have, for the alignment to go on.
PAD, PAD_CHARS = 64, 4096
#: Words of a gap that is still looked into, and words that an alignment goes on at a time beyond its matches.
WIDEST, STEP = 256, 16
#: A passage has at least so many words, of which this share is alike; pieces of one may come from several documents.
MIN_WORDS, MIN_ALIKE, MIN_PIECE = 50, 0.8, 20
#: One of so many documents is asked which seeds are frequent, and at most so many seeds are dealt out row by row; results don't depend on either.
SAMPLE, HOT_SEEDS, HOT_ROWS = 64, 20_000, 32
#: Bytes of texts whose words are hashed at once; a longer text is hashed alone.
SEED_BYTES = 1 << 20
#: Stands for a source that isn't known yet, in arrays.
OPEN = np.iinfo(np.int64).min
#: Columns of a passage.
PASSAGE = (("doc", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("words", pa.int32()), ("alike", pa.float64()), ("source", pa.int64()), ("source_start", pa.int32()), ("source_stop", pa.int32()))
_PASSAGE_DDL = "doc bigint, start int, stop int, words int, alike double, source bigint, source_start int, source_stop int"

_LEADING = r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){0,%d}"


def words_of(text: str) -> list[bytes]:
    """Words (A-Z in lower case) as bytes."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def places_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end, in code points."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.concatenate([[False], (raw != 32) & ((raw < 9) | (raw > 13)), [False]])
    border = np.flatnonzero(inside[1:] != inside[:-1])
    if len(raw) != len(text):
        border = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[border]
    return border[::2], border[1::2]


def _minima(rolled: np.ndarray, text: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash, the first of equal ones, in each window of the hashes of one text; of fewer hashes the smallest is kept.

    ``text`` has the number of each hash's text, ``first`` where each text's hashes begin.
    """
    kept = [np.zeros(0, np.int64)]
    if len(rolled) >= window:
        begin = np.flatnonzero(text[window - 1 :] == text[: len(text) - window + 1])
        kept.append(begin + np.lib.stride_tricks.sliding_window_view(rolled, window)[begin].argmin(axis=1))
    behind = np.concatenate([first[1:], [len(rolled)]])
    few = np.flatnonzero((behind - first < window) & (behind > first))
    kept.append(np.asarray([i + rolled[i:j].argmin() for i, j in zip(first[few].tolist(), behind[few].tolist(), strict=True)], np.int64))
    return np.unique(np.concatenate(kept))


def seeds_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept seeds of texts: the number of the text, the hash, and where it starts: the number of the word << 32 | code points before it << 1 | coarse."""
    data = b" ".join(texts).lower()
    found = data.split()
    raw = np.frombuffer(data, np.uint8)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    begin = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]])) if len(raw) else np.zeros(0, np.int64)
    base = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    owner = np.searchsorted(base, begin, "right") - 1
    # seeds lie in one text; those of all texts stand one after another
    whole = np.flatnonzero(owner[K - 1 :] == owner[: max(0, len(owner) - K + 1)])
    if not len(whole):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(found) - K + 1
    rolled = np.zeros(n, np.uint64)
    for j in range(K):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + each[j : j + n]
    rolled = rolled[whole]
    rolled ^= rolled >> np.uint64(29)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    text = owner[whole]
    first = np.searchsorted(text, np.arange(len(texts)))
    kept = _minima(rolled, text, first, WINDOW)
    coarse = np.zeros(len(rolled), np.int64)
    coarse[_minima(rolled, text, first, COARSE)] = 1
    text, word = text[kept], whole[kept]
    place, start = begin[word], base
    if (raw >= 128).any():
        points = np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64) - 1
        place, start = points[place], points[np.minimum(base, len(raw) - 1)]
    return text, rolled[kept].view(np.int64), (word - np.searchsorted(owner, np.arange(len(texts)))[text]) << 32 | (place - start[text]) << 1 | coarse[kept]


def seeds(docs: DataFrame) -> DataFrame:
    """Rows (seed bigint, doc bigint, at bigint) of documents (doc, text)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            size = np.cumsum([len(t) for t in texts])
            found, low = [], 0
            while low < len(texts):
                high = max(low + 1, int(np.searchsorted(size, size[low] + SEED_BYTES, "right")))
                row, seed, at = seeds_of(texts[low:high])
                found.append((row + low, seed, at))
                low = high
            row, seed, at = (np.concatenate([f[i] for f in found]) for i in range(3))
            return pa.RecordBatch.from_arrays([pa.array(seed), batch.column("doc").take(pa.array(row)), pa.array(at)], ["seed", "doc", "at"])

        return step

    return map_batches(docs.where("doc is not null").select("doc", "text"), make, "seed bigint, doc bigint, at bigint")


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, seed, x, source, y) of seeds that several documents have, from rows sorted by (seed, doc, at).

    The first row of a seed is its source. Beyond a batch only the first document's rows of one seed are kept. Rows of hot seeds,
    which are not together in one task, come out without a source.
    """
    names = ["seed", "doc", "at"]
    carry = [np.zeros(0, np.int64) for _ in names]
    opened: tuple[int, int, int] | None = None  # seed and first occurrence, of a seed whose rows come out already

    def made(seed, doc, at, source, y, hot) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(seed), pa.array(at), pa.array(source, mask=hot), pa.array(y, mask=hot)], ["doc", "seed", "x", "source", "y"])

    for batch in batches:
        if not batch.num_rows:
            continue
        hot = batch.column("hot").to_numpy(zero_copy_only=False)
        rows = [batch.column(c).to_numpy() for c in names]
        if hot.any():
            seed, doc, at = (r[hot] for r in rows)
            yield made(seed, doc, at, doc, at, np.ones(len(doc), bool))
        seed, doc, at = (np.concatenate([c, r[~hot]]) for c, r in zip(carry, rows, strict=True))
        if not len(seed):
            continue
        start = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
        stop = np.concatenate([start[1:], [len(seed)]])
        source, y = doc[start], at[start]
        several = doc[stop - 1] > source
        if opened is not None and opened[0] == seed[0]:
            source[0], y[0], several[0] = opened[1], opened[2], True
        if several[-1]:
            carry, opened = [c[:0] for c in carry], (int(seed[-1]), int(source[-1]), int(y[-1]))
        else:
            carry, opened = [r[start[-1] :] for r in (seed, doc, at)], None
        take = np.repeat(several, stop - start)
        if take.any():
            yield made(seed[take], doc[take], at[take], np.repeat(source, stop - start)[take], np.repeat(y, stop - start)[take], np.zeros(int(take.sum()), bool))
    release_memory()


def shared_seeds(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches (doc, x, source, y) of the seeds of documents (doc, text) with their first occurrence, if in an earlier
    document, and pairs of seeds (run, doc, x, x_end, source, y) with their source where both have one stretch of it.

    All rows of a seed meet in one task, sorted, which keeps no more than one document's rows of it. Seeds that a sample
    of the documents finds frequent are dealt out row by row instead, and get their first occurrence from a small aggregate.
    """
    spark = docs.sparkSession
    often = seeds(docs.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0)).groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_ROWS)
    hot = spark.createDataFrame([(int(r["seed"]),) for r in often.orderBy(F.desc("n"), "seed").limit(HOT_SEEDS).collect()], "hot_seed bigint")
    every = seeds(docs).join(F.broadcast(hot), F.col("seed") == F.col("hot_seed"), "left").select("seed", "doc", "at", F.col("hot_seed").isNotNull().alias("hot"))
    dealt = every.repartition(F.when(F.col("hot"), F.xxhash64("doc", "at")).otherwise(F.col("seed"))).sortWithinPartitions("seed", "doc", "at")
    known = dealt.mapInArrow(_first_occurrences, "doc bigint, seed bigint, x bigint, source bigint, y bigint")
    found = written(known.repartition("doc").sortWithinPartitions("doc", "x").mapInArrow(_by_document, "doc bigint, x bigint, source bigint, y bigint, name bigint, x_end bigint"), "seeds")
    matches = found.where("x_end is null and source is not null").select("doc", "x", "source", "y")
    opened = found.where("x_end is null and source is null").select("doc", "x", "name")
    # at most HOT_SEEDS rows
    first = opened.groupBy("name").agg(F.min(F.struct("doc", "x")).alias("first")).select(F.col("name").alias("hot_seed"), F.col("first.doc").alias("source"), F.col("first.x").alias("y"))
    filled = opened.join(F.broadcast(first), F.col("name") == F.col("hot_seed")).where("doc > source").select("doc", "x", "source", "y")
    return matches.unionByName(filled), found.where("x_end is not null").select(F.col("name").alias("run"), "doc", "x", "x_end", "source", "y")


def long_runs(doc: np.ndarray, seed: np.ndarray, x: np.ndarray, source: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs of coarse seeds that span at least ``MIN_PIECE`` words: from each one to the first that is far enough behind it.

    Takes seeds sorted by (doc, x) with their first occurrence (source, y). Returns the index of the first and the
    last seed of each pair, its hash (both seeds and the words between), and whether one stretch of the source is the first occurrence of both.
    """
    own = np.flatnonzero(x & 1)
    doc, seed, x, source, y = doc[own], seed[own], x[own], source[own], y[own]
    word = x >> 32
    place = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))[: len(doc)] * (1 << 32) + word
    last = np.searchsorted(place, place + (MIN_PIECE - K))
    begin = np.flatnonzero(last < len(doc))
    begin = begin[place[last[begin]] - place[begin] <= MAX_GAP]
    end = last[begin]
    far = word[end] - word[begin]
    run = (seed.view(np.uint64)[begin] * np.uint64(0x9E3779B97F4A7C15)) ^ (seed.view(np.uint64)[end] * np.uint64(0x94D049BB133111EB) + far.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    run ^= run >> np.uint64(32)
    known = (source[begin] != OPEN) & (source[begin] == source[end]) & ((y[end] >> 32) - (y[begin] >> 32) == far)
    return own[begin], own[end], run.view(np.int64), known


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From shared seeds sorted by (doc, x): a row per match with an earlier document, with its seed where the source is open, and a row per pair
    of seeds, with its hash and end; keeps one document's seeds beyond a batch."""
    names = ["doc", "seed", "x", "source", "y"]

    def solve(rows: list[np.ndarray]) -> pa.RecordBatch:
        doc, seed, x, source, y = rows
        begin, end, run, known = long_runs(doc, seed, x, source, y)
        opened = source == OPEN
        match = np.flatnonzero(opened | (doc > source))
        n = np.arange(len(match) + len(begin)) < len(match)
        take = np.concatenate([match, begin])
        lone = np.concatenate([opened[match], ~known])
        values = [doc[take], x[take], np.concatenate([seed[match], run]), np.concatenate([np.zeros(len(match), np.int64), x[end]])]
        columns = [pa.array(values[0]), pa.array(values[1]), pa.array(source[take], mask=lone), pa.array(y[take], mask=lone), pa.array(values[2], mask=n & ~lone), pa.array(values[3], mask=n)]
        return pa.RecordBatch.from_arrays(columns, ["doc", "x", "source", "y", "name", "x_end"])

    carry: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(c).fill_null(OPEN).to_numpy() for c in names]
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        if last == 0 and carry and carry[-1][0][-1] == rows[0][0]:
            carry.append(rows)
            continue
        whole = [np.concatenate([c[i] for c in carry] + [r[:last]]) for i, r in enumerate(rows)]
        carry = [[r[last:] for r in rows]]
        if len(whole[0]):
            yield solve(whole)
    if carry:
        yield solve([np.concatenate([c[i] for c in carry]) for i in range(len(names))])
    carry.clear()
    release_memory()


def chain(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Collinear chains of matches sorted by (x, y): (first x, last x, first y, last y) of each."""
    return [(int(x[m].min()), int(x[m].max()), int(y[m[0]]), int(y[m[-1]])) for m in chained(x, y)]


def chained(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Collinear chains of matches sorted by (x, y): the indices of each one's matches.

    The score of a match is its weight plus the best score of a match before it in both texts, less the
    cost of the gap between them. With cost linear in both coordinates, that best is a prefix maximum over
    y, kept in a Fenwick tree. Chains come out by falling score, each match in one of them.

    Where a text repeats itself, many matches have one y: those close together count as one match, which
    reaches from the first to the last of them.
    """
    order = np.lexsort((x, y))
    sx, sy = x[order], y[order]
    head = np.concatenate([[True], (sy[1:] != sy[:-1]) | (sx[1:] - sx[:-1] > MAX_GAP)])
    begin = np.flatnonzero(head)
    tail = np.concatenate([begin[1:], [len(x)]]) - 1
    again = np.lexsort((sy[begin], sx[begin]))
    x, y, members = sx[begin][again], sy[begin][again], [order[a : b + 1] for a, b in zip(begin[again], tail[again], strict=True)]
    n = len(x)
    ranks = np.searchsorted(np.unique(y), y) + 1
    size = int(ranks.max())
    best: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)
    score, before = [0.0] * n, [-1] * n
    xs, ys, rs = x.tolist(), y.tolist(), ranks.tolist()
    half = GAP_COST / 2
    i = 0
    while i < n:
        j = i
        while j < n and xs[j] == xs[i]:  # equal x can't follow each other
            r, top = rs[j] - 1, (-1e18, -1)
            while r > 0:
                if best[r] > top:
                    top = best[r]
                r &= r - 1
            gained = top[0] - half * (xs[j] + ys[j])
            score[j], before[j] = (SEED_WEIGHT + gained, top[1]) if gained > 0 else (SEED_WEIGHT, -1)
            j += 1
        for m in range(i, j):
            entry, r = (score[m] + half * (xs[m] + ys[m]), m), rs[m]
            while r <= size:
                if entry > best[r]:
                    best[r] = entry
                r += r & -r
        i = j
    used, out = [False] * n, []
    for end in sorted(range(n), key=lambda m: -score[m]):
        if used[end]:
            continue
        line, m = [], end
        while m >= 0 and not used[m]:
            used[m] = True
            line.append(m)
            m = before[m]
        line.reverse()
        start = 0
        for t in range(1, len(line) + 1):
            if t == len(line) or xs[line[t]] - xs[line[t - 1]] > MAX_GAP or ys[line[t]] - ys[line[t - 1]] > MAX_GAP:
                found = np.concatenate([members[m] for m in line[start:t]])
                if len(found) >= MIN_MATCHES:
                    out.append(found)
                start = t
    return out


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of matches sorted by (doc, source, x, y): where they begin and end, and all matches, in words from the first; keeps one pair's matches beyond a batch."""
    carry: list[np.ndarray] = []

    def solve(rows: np.ndarray) -> pa.RecordBatch | None:
        border = np.concatenate([[0], np.flatnonzero((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)) + 1, [len(rows)]])
        out = []
        for k in np.flatnonzero(np.diff(border) >= MIN_MATCHES):
            own = rows[border[k] : border[k + 1]]
            own = own[np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)])]
            places, numbers = (own[:, 2:] & 0xFFFFFFFF) >> 1, own[:, 2:] >> 32
            for m in chained(numbers[:, 0], numbers[:, 1]):
                (x, y), path = places[m].T, numbers[m] - numbers[m].min(axis=0)
                out.append((int(own[0, 0]), int(own[0, 1]), int(x.min()), int(x.max()), int(y.min()), int(y.max()), path.astype(np.int32).tobytes()))
        if not out:
            return None
        names = ["doc", "source", "x_from", "x_to", "y_from", "y_to", "path"]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64() if i < 2 else pa.int32() if i < 6 else pa.binary()) for i in range(7)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("doc", "source", "x", "y")], axis=1)
        same = (rows[:, 0] == rows[-1, 0]) & (rows[:, 1] == rows[-1, 1])
        last = int(np.argmax(same))
        if last == 0 and carry and (carry[-1][-1, :2] == rows[0, :2]).all():
            carry.append(rows)
            continue
        whole = np.concatenate([*carry, rows[:last]])
        carry = [rows[last:]]
        if len(whole) and (done := solve(whole)) is not None:
            yield done
    if carry and (done := solve(np.concatenate(carry))) is not None:
        yield done
    carry.clear()
    release_memory()


def common(a: Sequence[bytes], b: Sequence[bytes]) -> list[tuple[int, int]]:
    """A longest common subsequence of words, as pairs of places (Hunt and Szymanski, 1977).

    Only pairs of equal words are looked at: the shortest end of a subsequence of each length is kept.
    """
    places: dict[bytes, list[int]] = {}
    for j, w in enumerate(b):
        places.setdefault(w, []).append(j)
    ends: list[int] = []
    last: list[tuple] = []
    for i, w in enumerate(a):
        for j in reversed(places.get(w, ())):
            k = bisect_left(ends, j)
            node = (i, j, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(node)
            else:
                ends[k], last[k] = j, node
    out, node = [], last[-1] if last else None
    while node is not None:
        out.append((node[0], node[1]))
        node = node[2]
    return out[::-1]


def _equal(a: list[bytes], b: list[bytes], i: int, j: int) -> int:
    """How many words agree from i in ``a`` and j in ``b`` on; compared in blocks that double."""
    n, block = 0, 8
    while True:
        x, y = a[i + n : i + n + block], b[j + n : j + n + block]
        if x != y:
            return n + next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        n += len(x)
        if len(x) < block:
            return n
        block *= 2


def _along(a: list[bytes], b: list[bytes], line: list[tuple[int, int]], seen: dict) -> list[tuple[int, int, int]]:
    """The runs of agreeing words (i, j, length) of an alignment through matches that follow each other in both texts.

    It goes on for up to ``PAD`` words beyond the first and the last match. Gaps of over ``WIDEST`` words, over which no stretch pays, stay gaps.
    ``seen`` has what steps beyond the ends found before.
    """
    anchors, i_end, j_end = [], 0, 0
    for i, j in line:
        if i < i_end or j < j_end:
            continue
        while i > i_end and j > j_end and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        n = _equal(a, b, i, j)
        if n:
            anchors.append((i, j, n))
            i_end, j_end = i + n, j + n
    if not anchors:
        return []
    i, j, _ = anchors[0]
    ahead = _beyond(a[max(0, i - PAD) : i][::-1], b[max(0, j - PAD) : j][::-1], seen)
    runs = _as_runs([(i - 1 - p, j - 1 - q) for p, q in reversed(ahead)], 0, 0)
    i_end, j_end = i, j
    for i, j, n in anchors:
        if i_end < i <= i_end + WIDEST and j_end < j <= j_end + WIDEST:
            runs += _as_runs(common(a[i_end:i], b[j_end:j]), i_end, j_end)
        runs.append((i, j, n))
        i_end, j_end = i + n, j + n
    return runs + _as_runs(_beyond(a[i_end : i_end + PAD], b[j_end : j_end + PAD], seen), i_end, j_end)


def _as_runs(pairs: list[tuple[int, int]], i: int, j: int) -> list[tuple[int, int, int]]:
    """Pairs of places, counted from i and j, as runs (i, j, length)."""
    runs: list[tuple[int, int, int]] = []
    for p, q in pairs:
        if runs and runs[-1][0] + runs[-1][2] == p + i and runs[-1][1] + runs[-1][2] == q + j:
            runs[-1] = (p + i - runs[-1][2], q + j - runs[-1][2], runs[-1][2] + 1)
        else:
            runs.append((p + i, q + j, 1))
    return runs


def _gaining(a: Sequence[bytes], b: Sequence[bytes]) -> list[tuple[int, int]]:
    """The pairs of a longest common subsequence up to where words that agree outweigh those that differ the most."""
    score, top, keep, p, q = 0, 0, 0, -1, -1
    found = common(a, b)
    for k, (x, y) in enumerate(found, 1):
        score += 1 - max(x - p, y - q) + 1
        p, q = x, y
        if score > top:
            top, keep = score, k
    return found[:keep]


def _beyond(a: list[bytes], b: list[bytes], seen: dict) -> list[tuple[int, int]]:
    """Pairs of places that go on from the beginning of two lists, ``STEP`` words at a time, as long as words that agree outweigh those that differ.

    ``seen`` keeps each step by its words: a text that repeats a line goes on from it in the same way.
    """
    out: list[tuple[int, int]] = []
    i = j = 0
    while i < len(a) and j < len(b):
        step = (tuple(a[i : i + STEP]), tuple(b[j : j + STEP]))
        pairs = seen.get(step)
        if pairs is None:
            pairs = seen[step] = _gaining(*step)
        if not pairs:
            break
        out += [(i + x, j + y) for x, y in pairs]
        i, j = out[-1][0] + 1, out[-1][1] + 1
    return out


def _paying(runs: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """All maximal stretches of runs in which words that agree outweigh those that differ (Ruzzo and Tompa, 1999)."""
    found: list[tuple[int, int, int, int]] = []  # score before and behind, first and last run
    total = 0
    for k, (i, j, n) in enumerate(runs):
        if k:
            p, q, m = runs[k - 1]
            total -= max(i - p - m, j - q - m)
        before, low, total = total, k, total + n
        while True:
            at = next((t for t in range(len(found) - 1, -1, -1) if found[t][0] < before), -1)
            if at < 0 or found[at][1] >= total:
                found.append((before, total, low, k))
                break
            before, low = found[at][0], found[at][2]
            del found[at:]
    for _, _, low, high in found:
        yield runs[low : high + 1]


def _alike_parts(runs: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, float]]:
    """Runs as pieces in which at least ``MIN_ALIKE`` of the words agree: their ends in both, and that share.

    Runs that are less alike together are cut where they lie farthest apart.
    """
    left = [runs]
    while left:
        part = left.pop()
        (i0, j0, _), (i1, j1, n) = part[0], part[-1]
        if i1 + n - i0 < MIN_PIECE:
            continue
        alike = sum(r[2] for r in part) / max(i1 + n - i0, j1 + n - j0)
        if alike >= MIN_ALIKE:
            yield i0, i1 + n, j0, j1 + n, alike
            continue
        gaps = [max(r[0] - q[0] - q[2], r[1] - q[1] - q[2]) for q, r in zip(part, part[1:])]
        at = gaps.index(max(gaps)) + 1
        left += [part[:at], part[at:]]


def align(a: list[bytes], b: list[bytes], path: list[tuple[int, int]]) -> list[tuple[int, int, int, int, float]]:
    """The passages along matches (word of ``a``, word of ``b``) of one chain, by place: their ends in both, and the share of words that agree.

    Matches that go back in ``b``, where ``a`` repeats what ``b`` has once, begin a new alignment.
    """
    lines: list[list[tuple[int, int]]] = []
    for i, j in sorted(path):
        if not lines or j <= lines[-1][-1][1]:
            lines.append([])
        lines[-1].append((i, j))
    out, seen = [], {}
    for line in lines:
        for stretch in _paying(_along(a, b, line, seen)):
            out += _alike_parts(stretch)
    return list(dict.fromkeys(out))


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(low, CHUNK_ROWS) for b in batches for low in range(0, b.num_rows, CHUNK_ROWS)):
        out = []
        for r in batch.to_pylist():
            x_text, y_text, low_x, low_y = r["x_text"], r["y_text"], r["x_low"], r["y_low"]
            if x_text is None or y_text is None:
                continue
            a, b = words_of(x_text), words_of(y_text)
            i_first, j_first = len(words_of(x_text[: r["x_from"] - low_x])), len(words_of(y_text[: r["y_from"] - low_y]))
            path = np.frombuffer(r["path"], np.int32).reshape(-1, 2) + np.asarray([i_first, j_first])
            path = path[(path[:, 0] < len(a)) & (path[:, 1] < len(b))]
            found = align(a, b, list(map(tuple, path.tolist())))
            if not found:
                continue
            (x_begin, x_end), (y_begin, y_end) = places_of(x_text), places_of(y_text)
            for i0, i1, j0, j1, alike in found:
                out.append((r["doc"], low_x + int(x_begin[i0]), low_x + int(x_end[i1 - 1]), i1 - i0, alike, r["source"], low_y + int(y_begin[j0]), low_y + int(y_end[j1 - 1])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, (_, k) in enumerate(PASSAGE)], [n for n, _ in PASSAGE])
    release_memory()


def merge(pieces: list[dict]) -> list[dict]:
    """Pieces of one document that overlap or touch become one passage; those with enough words stay.

    Of a passage, ``source`` is the document of its longest piece, and words in overlaps count once (in
    proportion to their characters).
    """
    out: list[dict] = []
    for p in sorted(pieces, key=lambda p: (p["start"], -p["stop"], p["source"], p["source_start"], p["source_stop"], -p["alike"], p["words"])):
        if out and p["start"] <= out[-1]["stop"] + 2:
            top = out[-1]
            extra = max(0, p["stop"] - max(top["stop"], p["start"]))
            if p["words"] > top["longest"]:
                top |= {k: p[k] for k in ("source", "source_start", "source_stop", "alike")} | {"longest": p["words"]}
            top["words"] += round(p["words"] * extra / max(1, p["stop"] - p["start"]))
            top["stop"] = max(top["stop"], p["stop"])
        else:
            out.append(p | {"longest": p["words"]})
    return [p for p in out if p["words"] >= MIN_WORDS]


def _merge(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = [(doc, p) for doc, pieces in zip(batch.column("doc").to_pylist(), batch.column("pieces").to_pylist(), strict=True) for p in merge(pieces)]
    return pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), *(pa.array([p[n] for _, p in rows], k) for n, k in PASSAGE[1:])], [n for n, _ in PASSAGE])


def _several_texts(docs: DataFrame) -> DataFrame | None:
    """Ids (_id) that have different texts in ``docs`` (doc, text), with the hash of the text that counts; None if there are none."""
    hashed = docs.where("doc is not null").select("doc", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).groupBy("doc").agg(F.min("h").alias("_counts"), F.max("h").alias("_other"))
    odd = checkpointed(hashed.where("_counts <> _other").select(F.col("doc").alias("_id"), "_counts"))
    return odd if odd.head(1) else None


def _counting(docs: DataFrame, odd: DataFrame | None) -> DataFrame:
    if odd is None:
        return docs
    return docs.join(odd, F.col("doc") == F.col("_id"), "left").where(F.col("_counts").isNull() | (F.col("_counts") == F.xxhash64(F.coalesce("text", F.lit(""))))).drop("_id", "_counts")


def _copies(docs: DataFrame) -> DataFrame:
    """Documents (copy) whose whole text an earlier one (original, the first that has it) has too; texts are compared by SHA-256."""
    hashed = checkpointed(docs.where("doc is not null and text is not null").select("doc", F.unhex(F.sha2("text", 256)).alias("h")).distinct())
    first = hashed.groupBy("h").agg(F.min("doc").alias("original"), F.max("doc").alias("_last")).where("_last > original").select(F.col("h").alias("_h"), "original")
    return checkpointed(hashed.join(first, F.col("h") == F.col("_h")).where("doc > original").select(F.col("doc").alias("copy"), "original"))


def _whole(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A passage for each copy (doc, text, original) of enough words: its whole text."""
    rows = []
    for doc, text, original in zip(batch.column("doc").to_pylist(), texts_of(batch.column("text")), batch.column("original").to_pylist(), strict=True):
        begin, end = places_of(text)
        if len(begin) >= MIN_WORDS:
            rows.append((doc, int(begin[0]), int(end[-1]), len(begin), 1.0, original, int(begin[0]), int(end[-1])))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(PASSAGE)], [n for n, _ in PASSAGE])


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of documents that an earlier document (by id) has too, exactly or with few words changed.

    Returns a row per passage: doc bigint, start int, stop int (code points), words int, alike double,
    source bigint, source_start int, source_stop int. The first document that has a passage keeps it and isn't listed for it. Null
    and empty texts and rows with a null id have no passages. Rows that share an id count as one document; if their texts
    differ, the one with the smallest xxhash64 is that document's, and the others are not searched. Other columns are ignored; an empty table gives no rows.

    A document whose whole text an earlier one has is one passage of the first that has it. Of all others, a seed meets its first occurrence only, so a passage that thousands share gives a match for each of them, not for each
    pair. A seed's first occurrence may stand outside the passage, in a text that has one line of it, so pairs of seeds over
    ``MIN_PIECE`` words meet their own first occurrence too.
    """
    docs = tidy(df, [id_col, text_col]).select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    return _repeated(docs, _several_texts(docs))


def _repeated(docs: DataFrame, odd: DataFrame | None) -> DataFrame:
    ship_package(docs.sparkSession)
    docs = _counting(docs, odd)
    copies = _copies(docs)
    # a whole copy is one passage; what its original shares with others is looked for once
    whole = map_batches(docs.join(copies, F.col("doc") == F.col("copy")).select("doc", "text", "original"), lambda: _whole, _PASSAGE_DDL).dropDuplicates(["doc"])
    docs = docs.join(copies, F.col("doc") == F.col("copy"), "left_anti")
    matches, runs = shared_seeds(docs)
    one = checkpointed(runs.groupBy("run").agg(F.min(F.struct("doc", "x", "x_end")).alias("one"), F.max("doc").alias("last")).where("one.doc < last").select(F.col("run").alias("_run"), "one"))
    more = runs.join(one, F.col("run") == F.col("_run")).where("doc > one.doc and not (source <=> one.doc and y <=> one.x)")
    more = more.select("doc", F.col("one.doc").alias("source"), F.explode(F.array(F.struct("x", F.col("one.x").alias("y")), F.struct(F.col("x_end").alias("x"), F.col("one.x_end").alias("y")))).alias("end")).select("doc", "source", "end.x", "end.y")
    matches = matches.select("doc", "source", "x", "y").unionByName(more)
    chains = checkpointed(matches.repartition("doc", "source").sortWithinPartitions("doc", "source", "x", "y").mapInArrow(_chains, "doc bigint, source bigint, x_from int, x_to int, y_from int, y_to int, path binary"))
    key = ["doc", "source", "x_from", "y_from"]
    wanted = chains.select(*key, F.col("doc").alias("owner"), F.lit(0).alias("side"), F.col("x_from").alias("begin"), F.col("x_to").alias("end"), "path").unionByName(chains.select(*key, F.col("source").alias("owner"), F.lit(1).alias("side"), F.col("y_from").alias("begin"), F.col("y_to").alias("end"), F.lit(None).cast("binary").alias("path")))
    near = F.greatest(F.col("begin") - PAD_CHARS, F.lit(0))
    ahead = F.length(F.regexp_extract(F.reverse(F.substring("text", near + 1, F.col("begin") - near)), _LEADING % PAD, 0))
    behind = F.length(F.regexp_extract(F.substring("text", F.col("end") + 1, F.lit(PAD_CHARS)), _LEADING % (PAD + K), 0))
    cut = docs.withColumnRenamed("doc", "_doc").join(wanted, F.col("_doc") == F.col("owner")).withColumn("low", F.col("begin") - ahead)
    cut = cut.select(*key, "side", "path", "low", F.substring("text", F.col("low") + 1, F.col("end") + behind - F.col("low")).alias("part"))
    of = lambda side, name: F.max(F.when(F.col("side") == side, F.col(name)))
    sides = cut.groupBy(*key).agg(of(0, "part").alias("x_text"), of(1, "part").alias("y_text"), of(0, "low").alias("x_low"), of(1, "low").alias("y_low"), F.max("path").alias("path"))
    pieces = sides.mapInArrow(_align, _PASSAGE_DDL)
    by_doc = pieces.groupBy("doc").agg(F.collect_set(F.struct("start", "stop", "words", "alike", "source", "source_start", "source_stop")).alias("pieces"))
    return map_batches(by_doc, lambda: _merge, _PASSAGE_DDL).unionByName(whole)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with every repeated passage cut out of its text, but for the first document that has it.

    No row and no column goes: a document that only repeats others keeps an empty text, null texts stay null, and rows
    whose text isn't the one that counts for their id (see ``repeated``) stay as they are.
    """
    df = tidy(df, [id_col, text_col])
    docs = df.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    odd = _several_texts(docs)
    own, spans = unused_name(df, "cut_doc"), unused_name(df, "cut_spans")
    cuts = checkpointed(_repeated(docs, odd).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(spans)))
    counts = F.lit(True)
    if odd is not None:
        wanted = unused_name(df, "cut_counts")
        cuts = cuts.join(odd, F.col("doc") == F.col("_id"), "left").select("doc", spans, F.col("_counts").alias(wanted))
        counts = F.col(wanted).isNull() | (F.col(wanted) == F.xxhash64(F.coalesce(text_col, F.lit(""))))
    both = df.join(cuts.withColumnRenamed("doc", own), (F.col(id_col).cast("bigint") == F.col(own)) & counts, "left").select(*[F.col(f"`{c}`") for c in df.columns], spans)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(text_col)
        texts = []
        for text, found in zip(batch.column(at).to_pylist(), batch.column(spans).to_pylist(), strict=True):
            if found and text:
                parts, done = [], 0
                for s in found:
                    parts.append(text[done : s["start"]])
                    done = max(done, s["stop"])
                text = "".join([*parts, text[done:]])
            texts.append(text)
        batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
        return batch.select([c for c in batch.schema.names if c != spans])

    return map_batches(both, lambda: step, df.schema)
