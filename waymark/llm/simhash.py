"""SimHash near-duplicates over pigeonhole blocks.

A fingerprint has a bit for each sign of the summed shingle hashes, so similar texts have fingerprints
that differ in few bits. For ``d`` allowed differences the bits are split into ``d + 1`` blocks: two fingerprints
within ``d`` bits agree on at least one whole block. Fingerprints meet in a join on their blocks and are
verified by Hamming distance. Inside a block's bucket only a spanning forest of the verified links comes
out, which has the same components, so large groups of near copies stay linear.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import ASCII_LOWER, components, map_batches, ranges, release_memory, texts_of, tidy, with_fields
from waymark.session import checkpointed, ship_package

SEED = 42
#: Runs of equal keys up to this long are compared by shifting whole batches; longer ones one by one.
SHORT_RUN = 24
#: Rows of a bucket that are split further by the bits that the bucket leaves open.
SPLIT_AT = 2048
#: One of so many fingerprints is asked which buckets are large; those of over two tiles of so many rows are dealt to many tasks, at most so many buckets.
SAMPLE, BUCKET_TILE, HOT_KEYS = 16, 8192, 20_000
#: Sampled blocks that are met first; what they join closely is not compared again on the others.
FIRST_BLOCKS = 10
#: Rows of a tile; two tiles of a group of near copies are compared in one task.
TILE = 1024


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words (A-Z in lower case, joined by spaces), repeats included.

    Fewer words count as one shingle; no words give none.
    """
    found = text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    whole = b" ".join(found)
    if len(found) <= size:
        return np.asarray([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = (ends - np.fromiter(map(len, found), np.int64, len(found)) - 1)[: len(found) - size + 1].tolist()
    stops = (ends - 1)[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.asarray([digest(whole[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray, bits: int = 64) -> bytes:
    """A bit is 1 if it is set in over half of the hashes; big-endian bytes. No hashes: all zero.

    Beyond 64 bits, each further word uses the hashes mixed with another constant.
    """
    if not len(hashes):
        return bytes(bits // 8)
    columns = [hashes]
    for k in range(1, bits // 64):
        x = hashes ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        columns.append(x ^ (x >> np.uint64(31)))
    total = np.zeros(bits, np.int64)
    for low in range(0, len(hashes), 1 << 14):
        part = np.stack([c[low : low + (1 << 14)] for c in columns], axis=1).astype(">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), bits // 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(hashes)).tobytes()


def fingerprints(df: DataFrame, shingle: int = 3, bits: int = 64, text_col: str = "text", sets: bool = False) -> DataFrame:
    """Replaces the text by ``fingerprint`` binary; null texts count as empty.

    With ``sets`` every distinct shingle counts once, so that fingerprints are as near as the sets are alike however often a
    text repeats a line, and there is also ``shape`` binary, a 128-bit hash of the set.
    """
    more = ["fingerprint", "shape"] if sets else ["fingerprint"]
    df = tidy(df, [text_col], more)
    rest = [c for c in df.columns if c != text_col]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes = [shingle_hashes(t, shingle) for t in texts_of(batch.column(text_col))]
            if sets:
                hashes = [np.unique(h) for h in hashes]
            made = [[fingerprint(h, bits) for h in hashes]]
            if sets:
                made.append([xxhash.xxh3_128_digest(h.tobytes()) for h in hashes])
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array(m, pa.binary()) for m in made)], [*rest, *more])

        return step

    kept = df.select(*[f"`{c}`" for c in rest])
    return map_batches(df, make, with_fields(kept, ", ".join(f"{c} binary" for c in more)))


@dataclass(frozen=True)
class Blocks:
    """Bit positions of each block key; ``exact`` if fingerprints within the distance always share one."""

    bits: int
    distance: int
    chosen: tuple[tuple[int, ...], ...]
    exact: bool


def pigeonhole(bits: int, distance: int, rows: int) -> Blocks:
    """Blocks that every pair within ``distance`` bits shares.

    With more rows the bits are cut finer and a key takes several blocks at once, so that keys stay about
    as selective as there are rows: out of b blocks, b - distance agree.
    """
    from itertools import combinations

    blocks = distance + 1
    while bits * (blocks - distance) // blocks < math.log2(max(rows, 2)) - 4 and blocks < distance + 4:
        blocks += 1
    cut = np.array_split(np.arange(bits), blocks)
    chosen = tuple(tuple(int(b) for k in some for b in cut[k]) for some in combinations(range(blocks), blocks - distance))
    return Blocks(bits, distance, chosen, True)


def sampled(bits: int, distance: int, expected: float, rows: int, recall: float = 0.995) -> Blocks:
    """Blocks for distances too large for a guarantee: random bit subsets, as many as ``recall`` needs.

    A pair in which a share ``expected`` of the bits differs meets in at least one block with probability
    ``recall``; closer pairs meet more surely. Keys get longer with the rows: unrelated rows meet about 16 to a bucket.
    """
    width = max(12, math.ceil(math.log2(max(rows, 2))) - 4)
    meets = (1 - expected) ** width
    count = math.ceil(math.log(1 - recall) / math.log(1 - meets))
    rng = np.random.default_rng(20240229)
    chosen = tuple(tuple(sorted(int(b) for b in rng.choice(bits, width, replace=False))) for _ in range(count))
    return Blocks(bits, distance, chosen, False)


def _forest(words: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of all pairs of rows within ``distance`` bits, breadth first; each row is expanded once."""
    left, edges = np.arange(len(words)), []
    while len(left) > 1:
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(words[left] ^ words[at]).sum(axis=1, dtype=np.int32) <= distance
            if near.any():
                found = left[near].tolist()
                edges += [(at, b) for b in found]
                frontier += found
                left = left[~near]
    return edges


def _tree(words: np.ndarray, labels: np.ndarray, distance: int) -> list[tuple[int, int, int]]:
    """A minimum spanning forest of all pairs of rows within ``distance`` bits (Prim), where rows of one label are joined
    already. With labels of their own, every row's nearest one is in it."""
    left = np.arange(len(words))
    gap = np.full(len(words), distance + 1, np.int32)
    near = np.full(len(words), -1)
    edges = []
    while len(left):
        k = int(gap.argmin())
        at = int(left[k])
        if near[k] >= 0 and gap[k] >= 0:
            edges.append((int(near[k]), at, int(gap[k])))
        keep = np.arange(len(left)) != k
        left, gap, near = left[keep], gap[keep], near[keep]
        far = np.bitwise_count(words[left] ^ words[at]).sum(axis=1, dtype=np.int32)
        far[labels[left] == labels[at]] = -1
        closer = far < gap
        gap[closer], near[closer] = far[closer], at
    return edges


def _bucket(words: np.ndarray, distance: int, open_bits: np.ndarray | None) -> list[tuple[int, int]]:
    """Links of one bucket. A large one is split by pigeonhole again over the bits that its key leaves open."""
    if open_bits is None or len(words) <= SPLIT_AT or len(open_bits) < 4 * (distance + 1):
        return _forest(words, distance)
    bytes_ = words.astype(">u8").view(np.uint8).reshape(len(words), -1)
    flat = np.unpackbits(bytes_, axis=1)
    edges = []
    for block in np.array_split(open_bits, distance + 1):
        value = flat[:, block] @ (1 << np.arange(len(block), dtype=np.int64))
        order = np.argsort(value, kind="stable")
        border = np.flatnonzero(np.diff(value[order])) + 1
        rest = np.setdiff1d(open_bits, block)
        for run in np.split(order, border):
            if len(run) > 1:
                edges += [(int(run[a]), int(run[b])) for a, b in _bucket(words[run], distance, rest)]
    return edges


def _links(blocks: Blocks):
    """Reads rows sorted by key, finds each key's links; keeps one key's rows at a time beyond the batch."""
    everything = np.arange(blocks.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[tuple[np.ndarray, ...]] = []

        def solve(keys: np.ndarray, ids: np.ndarray, words: np.ndarray, labels: np.ndarray) -> pa.RecordBatch | None:
            border = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            sizes = np.diff(border)
            out_a, out_b, out_d = [], [], []
            longest = min(SHORT_RUN, int(sizes.max(initial=0)))
            short = np.repeat(sizes <= SHORT_RUN, sizes)
            for shift in range(1, longest):
                same = np.flatnonzero((keys[shift:] == keys[:-shift]) & short[shift:])
                if not len(same):
                    break
                same = same[labels[same] != labels[same + shift]]
                far = np.bitwise_count(words[same] ^ words[same + shift]).sum(axis=1, dtype=np.int32)
                near = same[far <= blocks.distance]
                out_a.append(ids[near])
                out_b.append(ids[near + shift])
                out_d.append(far[far <= blocks.distance])
            for k in np.flatnonzero(sizes > SHORT_RUN):
                low, high = border[k], border[k + 1]
                if blocks.exact:
                    open_bits = np.setdiff1d(everything, blocks.chosen[int(keys[low]) >> 48])
                    edges = [(a, b, 0) for a, b in _bucket(words[low:high], blocks.distance, open_bits)]
                else:
                    edges = _tree(words[low:high], labels[low:high], blocks.distance)
                if edges:
                    pair = np.asarray(edges, np.int64)
                    out_a.append(ids[pair[:, 0] + low])
                    out_b.append(ids[pair[:, 1] + low])
                    out_d.append(pair[:, 2].astype(np.int32))
            if not out_a or not sum(map(len, out_a)):
                return None
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b)), pa.array(np.concatenate(out_d))], ["a", "b", "d"])

        def joined() -> tuple[np.ndarray, ...]:
            parts = [np.concatenate([c[i] for c in carry]) for i in range(4)]
            carry.clear()
            return tuple(parts)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
            column = batch.column("fingerprint")
            data = np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(len(keys), -1)
            labels = batch.column("label").to_numpy() if "label" in batch.schema.names else ids
            last = int(np.searchsorted(keys, keys[-1]))
            if last == 0 and carry and carry[-1][0][0] == keys[0]:
                carry.append((keys, ids, data, labels))
                continue
            carry.append((keys[:last], ids[:last], data[:last], labels[:last]))
            whole = joined()
            done = solve(*whole) if len(whole[0]) else None
            carry.append((keys[last:], ids[last:], data[last:], labels[last:]))
            if done is not None:
                yield done
        if carry:
            whole = joined()
            if len(whole[0]) and (done := solve(*whole)) is not None:
                yield done
            del whole
        release_memory()

    return run


def links(prints: DataFrame, blocks: Blocks) -> DataFrame:
    """Links (a, b, d) among rows (id bigint, fingerprint binary) within the distance: a spanning forest for each key.

    With sampled blocks it is a minimum one and ``d`` the distance; with exact blocks ``d`` has no meaning. A column ``label``
    (bigint, sampled blocks only) names rows that are joined already: a forest has no links between rows of one label.
    Every row goes out once for each block; a key's rows meet in one task, sorted, and are compared there
    without leaving out any pair. Buckets that a sample finds large are dealt into tiles of about ``BUCKET_TILE`` rows, and each two
    tiles meet in a task, so every pair still does. Fingerprints should be distinct, so that copies don't fill a bucket.
    """
    ship_package(prints.sparkSession)
    chosen, more = blocks.chosen, [c for c in prints.columns if c == "label"]

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.num_rows
            flat = np.unpackbits(np.frombuffer(b"".join(batch.column("fingerprint").to_pylist()), np.uint8).reshape(n, -1), axis=1)
            keys = np.empty((n, len(chosen)), np.int64)
            for t, block in enumerate(chosen):
                value = flat[:, list(block)].astype(np.int64) @ (1 << np.arange(len(block), dtype=np.int64))
                keys[:, t] = value | t << 48
            row = pa.array(np.repeat(np.arange(n), len(chosen)))
            return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(batch.column(c).take(row) for c in ("id", "fingerprint", *more))], ["key", "id", "fingerprint", *more])

        return step

    spark, kind = prints.sparkSession, "key bigint, id bigint, fingerprint binary" + ", label bigint" * len(more)
    some = map_batches(prints.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select("id", "fingerprint", *more), make, kind)
    large = some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLE > 2 * BUCKET_TILE).orderBy(F.desc("n"), "key").limit(HOT_KEYS).collect()
    keyed = map_batches(prints.select("id", "fingerprint", *more), make, kind)
    if large:
        # at most HOT_KEYS rows
        hot = F.broadcast(spark.createDataFrame([(int(r["key"]), -(-int(r["n"]) * SAMPLE // BUCKET_TILE)) for r in large], "_key bigint, tiles int"))
        tile = F.pmod(F.xxhash64("id"), "tiles")
        dealt = keyed.join(hot, F.col("key") == F.col("_key"), "left").select("key", "id", "fingerprint", *more, "tiles", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))).alias("other"))
        # the block's number stays in the upper bits
        two = F.xxhash64("key", F.least(tile, "other"), F.greatest(tile, "other")).bitwiseAND(F.lit((1 << 48) - 1))
        block = F.shiftleft(F.shiftright("key", 48), 48)
        keyed = dealt.select(F.when(F.col("tiles").isNull(), F.col("key")).otherwise(block.bitwiseOR(two)).alias("key"), "id", "fingerprint", *more)
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links(blocks), "a bigint, b bigint, d int")


def _shingle_sets(pairs: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """The sets of 32-bit shingle hashes of the documents (id, text) in pairs (a, b): rows (id, shingles), sorted binary."""
    owners = pairs.select(F.col("a").alias("owner")).union(pairs.select("b")).distinct()
    texts = docs.join(owners, docs["id"] == owners["owner"], "left_semi").select("id", "text").dropDuplicates(["id"])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [np.unique(shingle_hashes(t, shingle).astype(np.uint32)).tobytes() for t in texts_of(batch.column("text"))]
            return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"])

        return step

    return checkpointed(map_batches(texts, make, "id bigint, shingles binary"))


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of documents whose shingle sets have a Jaccard similarity of at least ``least``."""
    left, right = (sets.select(F.col("id").alias(f"_{end}"), F.col("shingles").alias(name)) for end, name in (("a", "x"), ("b", "y")))
    sided = pairs.join(left, F.col("a") == F.col("_a")).select("a", "b", "x").join(right, F.col("b") == F.col("_b")).select("a", "b", "x", "y")

    def compare():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x or b"", np.uint32), np.frombuffer(y or b"", np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return step

    return map_batches(sided, compare, "a bigint, b bigint")


def grown(words: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, distance: int, least: float, first: np.ndarray) -> list[tuple[int, int]]:
    """Links that join rows with different labels: all pairs within ``distance`` bits and at least ``least`` alike, but
    those that earlier links connect already. Where ``first`` says there are two sides, pairs of one side are left out."""
    sizes = np.asarray([len(s) for s in sets], np.int64)
    names, codes = np.unique(np.concatenate([np.zeros(0, np.uint32), *sets]), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    label, mark, edges = np.unique(labels, return_inverse=True)[1], np.zeros(len(names), bool), []
    two = bool(first.any() and not first.all())
    for at in range(len(words) - 1):
        rest = np.arange(at + 1, len(words))
        rest = rest[label[rest] != label[at]]
        if two:
            rest = rest[first[rest] != first[at]]
        rest = rest[np.bitwise_count(words[rest] ^ words[at]).sum(axis=1, dtype=np.int32) <= distance]
        if not len(rest):
            continue
        own = codes[starts[at] : starts[at] + sizes[at]]
        mark[own] = True
        hits = np.concatenate([[0], np.cumsum(mark[codes[ranges(starts[rest], sizes[rest])]], dtype=np.int64)])
        ends = np.cumsum(sizes[rest])
        both = hits[ends] - hits[ends - sizes[rest]]
        mark[own] = False
        for k in rest[both >= least * (sizes[at] + sizes[rest] - both)].tolist():
            if label[k] != label[at]:
                edges.append((at, k))
                label[label == label[k]] = label[at]
    return edges


def _unfinished(proposed: DataFrame, linked: DataFrame, prints: DataFrame, sets: DataFrame, distance: int, least: float) -> DataFrame:
    """More links (a, b), in groups of rows that proposals connect and accepted links don't.

    A bucket's forest proposes one partner of a row, and where that one is rejected another may be alike. So all pairs
    of such a group with different components so far are tested. A large group is dealt into tiles of about ``TILE``
    rows, and each two tiles meet in one task; no join makes the pairs.
    """
    group, done = components(proposed), components(linked)
    rows = group.select("node", F.col("component").alias("g")).join(done.select(F.col("node").alias("_node"), F.col("component").alias("c")), F.col("node") == F.col("_node"), "left").select("node", "g", F.coalesce("c", "node").alias("c"))
    rows = checkpointed(rows)
    parts = rows.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("low <> high and n > 2").select(F.col("g").alias("_g"), F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    own = rows.join(parts, F.col("g") == F.col("_g")).select("node", "g", "c", "tiles", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile"))
    full = own.join(sets, own["node"] == sets["id"]).drop("id").join(prints.select("id", "fingerprint"), F.col("node") == F.col("id")).drop("id")
    dealt = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("g", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "tile", "node", "c", "fingerprint", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        ids, label = table.column("node").to_numpy(), table.column("c").to_numpy()
        edges = []
        if (label != label[0]).any():
            words = np.frombuffer(b"".join(table.column("fingerprint").to_pylist()), ">u8").astype(np.uint64).reshape(len(ids), -1)
            sets = [np.frombuffer(s or b"", np.uint32) for s in table.column("shingles").to_pylist()]
            edges = grown(words, sets, label, distance, least, table.column("tile").to_numpy() == table.column("p").to_numpy())
        pair = np.asarray(edges, np.int64).reshape(-1, 2)
        return pa.table({"a": ids[pair[:, 0]], "b": ids[pair[:, 1]]})

    return dealt.groupBy("g", "p", "q").applyInArrow(compare, "a bigint, b bigint")


def _proposed(prints: DataFrame, blocks: Blocks, expected: float | None) -> DataFrame:
    """Links of all blocks; with sampled ones those of the first blocks, and of the others what these leave apart."""
    if blocks.exact or len(blocks.chosen) <= FIRST_BLOCKS:
        return links(prints, blocks).select("a", "b")
    first = checkpointed(links(prints, replace(blocks, chosen=blocks.chosen[:FIRST_BLOCKS])))
    close = expected * blocks.bits - 1.5 * math.sqrt(expected * (1 - expected) * blocks.bits)
    joined = components(first.where(F.col("d") <= close).select("a", "b"))
    labelled = checkpointed(prints.join(joined, prints["id"] == joined["node"], "left").select("id", "fingerprint", F.coalesce("component", "id").alias("label")))
    return first.select("a", "b").unionByName(links(labelled, replace(blocks, chosen=blocks.chosen[FIRST_BLOCKS:])).select("a", "b"))


def near_duplicates(df: DataFrame, shingle: int = 3, bits: int = 64, distance: int = 2, expected: float | None = None, least: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose fingerprints differ in at most ``distance`` bits.

    Returns a row per document: ``id_col``, fingerprint binary, component_id (the smallest id reachable by links, itself
    included). Equal fingerprints are one class and always linked (with ``least``, equal shingle sets); empty and null texts have the zero
    fingerprint and are linked like any other. Repeated rows come out each. Rows with a null id belong
    to their class but never name a component; a class of null ids only has a null component. Other columns are ignored.

    Without ``expected`` the blocks guarantee that no link is lost; with it (the share of bits in which the
    least similar pairs of interest differ) they are sampled, for distances that no blocks can guarantee.
    With ``least`` fingerprints are those of the distinct shingles and only propose, by the edges of a minimum spanning forest of each bucket: a pair of them
    is a link if the Jaccard similarity of its shingle sets is at least ``least``. The first blocks' forests are made first; what they
    join by clearly fewer bits than ``expected`` isn't proposed again. Where proposals are rejected, all other pairs
    within the distance in what they connect are tested too, unless they are connected already.
    """
    docs = tidy(df, [id_col, text_col]).select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).alias("text"))
    same = ["fingerprint"] if least is None else ["fingerprint", "shape"]
    prints = checkpointed(fingerprints(docs, shingle, bits, sets=least is not None))
    classes = checkpointed(prints.groupBy(*same).agg(F.min(id_col).alias("id")).where("id is not null"))
    rows = classes.count()
    blocks = pigeonhole(bits, distance, rows) if expected is None else sampled(bits, distance, expected, rows)
    if least is None:
        pairs = links(classes, blocks)
    else:
        pairs = _proposed(classes, blocks, expected)
        proposed = checkpointed(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        sets = _shingle_sets(proposed, docs.withColumnRenamed(id_col, "id"), shingle)
        pairs = checkpointed(_alike(proposed, sets, least))
        pairs = pairs.unionByName(_unfinished(proposed, pairs, classes, sets, distance, least))
    found = components(pairs)
    named = classes.join(found, classes["id"] == found["node"], "left").select(*[F.col(c).alias(f"_{c}") for c in same], F.coalesce("component", "id").alias("component_id"))
    return prints.join(named, [prints[c] == named[f"_{c}"] for c in same], "left").select(id_col, "fingerprint", "component_id")
