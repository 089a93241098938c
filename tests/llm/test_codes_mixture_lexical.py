"""Vector codes, mixture-controlled packing and ranked search against plain forms."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import public_tokenizers as P
import pytest

from waymark.llm import codes, lexical, mixture, packing

JSON = P.path("byte_bpe_50k.json")


def plain_codes(rows, parts, entries, rounds, scale, width):
    """(id, code, error) and the digest by loops over whole numbers; rows are (id, vector)."""
    own = [(i, [math.floor(scale * x) for x in v] + [0] * (width - len(v))) for i, v in rows]
    own.sort(key=lambda r: (r[0] is None, r[0] or 0))
    w = width // parts
    cut = [[v[j * w : (j + 1) * w] for j in range(parts)] for _, v in own]
    books = [[c[j] for c in cut[:entries]] for j in range(parts)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for j in range(parts):
            held = defaultdict(list)
            for c in cut:
                held[best(c[j], books[j])[1]].append(c[j])
            books[j] = [[sum(x) // len(held[k]) for x in zip(*held[k], strict=True)] if held[k] else e for k, e in enumerate(books[j])]
    found = []
    for (i, _), c in zip(own, cut, strict=True):
        to = [best(c[j], books[j]) for j in range(parts)]
        found.append((i, "".join(f"{k:02x}" for _, k in to), sum(d for d, _ in to)))
    flat = [x for book in books for e in book for x in e]
    return found, hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


def test_codes(spark):
    rng = random.Random(3)
    vectors = [[rng.choice([-0.51, -0.2, 0.0, 0.13, 0.499, 1.7, 40.0]) + rng.random() for _ in range(8)] for _ in range(60)]
    rows = [(i, v, rng.choice([1, 2, None])) for i, v in enumerate(vectors)]
    rows += [(100, [0.0] * 8, 2), (101, vectors[5], 2), (102, vectors[5], 7), (None, vectors[6], 1)]
    good = list(rows)
    rows += [(200, None, 1), (201, [1.0] * 7 + [None], 1), (202, [math.nan] * 8, 1), (203, [math.inf] + [0.0] * 7, None)]
    odd = [(300 + i, [rng.random() for _ in range(5)], 9) for i in range(4)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows + odd + [(400, [], 11)]], "vec_id bigint, embedding array<double>, label int, code string").repartition(5)
    got = codes.compress(df, entries=16)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = got.collect()
    want, digest = plain_codes([(i, v) for i, v, _ in good], 4, 16, 4, 1024, 8)
    want_odd, odd_digest = plain_codes([(i, v) for i, v, _ in odd], 4, 16, 4, 1024, 8)
    assert sorted((str(r.vec_id), r.code, r.error) for r in got if r.vec_id != 400) == sorted((str(i), c, e) for i, c, e in want + want_odd)
    assert {r.codebooks_sha256 for r in got} == {digest, odd_digest, hashlib.sha256(b"0,0,0,0").hexdigest()}
    label_of = {i: x for i, _, x in good + odd} | {400: 11}
    sums = Counter()
    for r in got:
        sums[label_of[r.vec_id]] += r.error
    assert all(r.label_error == sums[label_of[r.vec_id]] for r in got)
    assert [(r.code, r.error) for r in got if r.vec_id == 400] == [("00000000", 0)]
    empty = codes.compress(df.limit(0))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and not empty.count()


def test_codes_extremes_and_one_vector(spark):
    df = spark.createDataFrame([(1, [1e300, -1e300, 0.5, 2.0], 1), (2, [1e-300, 0.0, -0.5, 3.0], 1)], "vec_id bigint, embedding array<double>, label int")
    assert [r.error for r in codes.compress(df).collect()] == [0, 0]
    (one,) = codes.compress(df.limit(1), rounds=0).collect()
    assert one.code == "00000000" and one.label_error == 0


def documents(rng, n, sources):
    words = ["word", "é", "日本", "12", "\n", "<|endoftext|>", "longer words"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 40, 300]))), rng.choice(sources)) for i in range(n)]


def round_robin(lengths, shares, capacity, least, phases):
    """Deficit round-robin by its definition: every queue's (from, to) in the order of rounds."""
    sent, served, t = {s: 0 for s in lengths}, [], 0
    while any(sent[s] < lengths[s] for s in lengths):
        t += 1
        for s in sorted(lengths, key=lambda s: (s is None, s or "")):
            pace = capacity * shares[s]
            if pace >= least:
                to = min(lengths[s], math.floor(t * pace))
                at = sent[s]
                if to > at:
                    served.append((s, at, to, t))
            else:
                to = at = sent[s]
                while at < lengths[s] and phases[s] + t * pace >= min(at // least * least + least, lengths[s]):
                    to = min(at // least * least + least, lengths[s])
                    served.append((s, at, to, t))
                    at = to
            sent[s] = max(sent[s], to)
    return served


@pytest.mark.parametrize("targets", [None, {"a": 5.0, "b": 1.0, "c": 1.0}])
def test_mixture(spark, targets):
    rng = random.Random(8)
    rows = documents(rng, 150, ["a", "a", "a", "a", "b", "c", None]) + [(900, "", "b"), (901, None, "a"), (None, "no id", "tiny"), (3, "again", "c"), (902, "long " * 3000, "b")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, source string, offset int").repartition(4)
    out = mixture.pack_mixture(df, JSON, P.PATTERN, 128, targets=targets, least=16).collect()
    own = packing.encoding(JSON, P.PATTERN)
    coded = [(i, [*own.encode(t or "", allowed_special="all"), 1], s) for i, t, s in rows]
    total = sum(len(c) for _, c, _ in coded)
    # every id lies in one piece, and pieces hold what they say
    assert sum(r.length for r in out) == total
    assert all(any(i == r.doc_id and len(c) == r.doc_tokens and zlib.crc32(np.asarray(c[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for i, c, _ in coded) for r in out)
    for i in {i for i, _, _ in coded if i not in (3, None)}:
        places = sorted((r.start, r.start + r.length) for r in out if r.doc_id == i)
        assert places[0][0] == 0 and all(a[1] == b[0] for a, b in pairwise(places)) and places[-1][1] == next(len(c) for j, c, _ in coded if j == i)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in pairwise(b))
    sizes = [sum(n for _, n in bins[k]) for k in sorted(bins)]
    assert sizes[: total // 128] == [128] * (total // 128) and sum(sizes[total // 128 :]) == total % 128
    assert all(n & (n - 1) == 0 for n in sizes)
    # the order is the one that rounds give, one after another
    lengths = Counter()
    for _, c, s in coded:
        lengths[s] += len(c)
    weight = {s: (targets or {}).get(s, n / total) for s, n in lengths.items()}
    share = {s: w / sum(weight.values()) for s, w in weight.items()}
    phases = {s: mixture.phase_of(s, lengths[s], 16) for s in lengths}
    plain = [s for s, a, b, _ in round_robin(lengths, share, 128, 16, phases) for _ in range(b - a)]
    ours = [s for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)) for s in [r.source] * r.length]
    assert ours == plain
    # up to any window every source that isn't used up keeps near its share
    sent = Counter()
    for k in range(1, total // 128 + 1):
        sent.update(ours[(k - 1) * 128 : k * 128])
        if all(sent[s] < lengths[s] for s in lengths):
            assert all(abs(sent[s] - share[s] * k * 128) <= 128 * share[s] + 16 + 16 * len(lengths) for s in lengths)


def test_mixture_small(spark):
    df = spark.createDataFrame([(1, "one", "a")], "doc_id bigint, text string, source string")
    out = mixture.pack_mixture(df, JSON, P.PATTERN).collect()
    assert sum(r.length for r in out) == out[0].doc_tokens == 2 and out[0].offset == 0
    none = mixture.pack_mixture(df.limit(0), JSON, P.PATTERN)
    assert not none.count() and none.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    with pytest.raises(ValueError, match="positive"):
        mixture.pack_mixture(df, JSON, P.PATTERN, targets={"a": 0.0})


def test_mixture_many_small_sources(spark):
    rows = [(i, "some words here " * (i % 7 + 1), f"s{i % 400}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixture.pack_mixture(df, JSON, P.PATTERN, 256, least=8).collect()
    heads = Counter(r.round for r in out)
    assert max(heads.values()) < 0.2 * len(out)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, k):
    counts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c in counts:
            m = 50 + 50 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_search(spark, monkeypatch, bound):
    """With item terms that go to every executor, and with too many for that."""
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", bound)
    rng = random.Random(2)
    words = ["Alpha", "beta", "ßtraße", "İx", "x1", "the", "the", "the", "日本語", "a_b", "Don't", "É", "zz" * 400, "gamma", "delta"]
    docs = [(i, rng.choice([" ", "\n", "-", "\x7f"]).join(rng.choice(words) for _ in range(rng.choice([1, 5, 30])))) for i in range(90)]
    docs += [(500, ""), (501, None), (502, " \x00.,"), (None, "alpha beta"), (None, "gamma"), (7, docs[7][1]), (8, "alpha"), (503, "the " * 20_000)]
    items = [(1, "ALPHA beta"), (2, "the The THE"), (3, ""), (4, None), (5, "nowhere"), (6, "alpha"), (6, "日本語 don"), (None, "gamma delta"), (9, docs[0][1])]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, term int")
    q = spark.createDataFrame([(*r, 1.0) for r in items], "item_id bigint, text string, score double")
    got = lexical.search(d, q, 10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]

    def key(r):
        return tuple((x is None, x or 0) for x in r)

    assert sorted([tuple(r) for r in got.collect()], key=key) == sorted(plain_search(docs, items, 10), key=key)
    assert not lexical.search(d.limit(0), q).count() and not lexical.search(d, q.limit(0)).count()
