"""Operators over many rows: packing, SimHash, embeddings, top-k, passages, components and the pipeline; against brute force."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_texts import plain_scores
from waymark.llm import common, mih, packing, passages, pii, pq, simhash
from waymark.llm.common import Forest, components

JSON = P.path("byte_bpe_50k.json")


def brute_components(n, linked):
    f = Forest(n)
    for a, b in linked:
        f.join(a, b)
    return [f.find(i) for i in range(n)]


@pytest.mark.parametrize("task_edges", [250_000, 40])
def test_components(spark, monkeypatch, task_edges):
    """In one task, and in several that leave rounds to do."""
    monkeypatch.setattr(common, "TASK_EDGES", task_edges)
    random.seed(4)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(5, 5), (i := 298, i + 1)] + [(400 + k, 401 + k) for k in range(60)]
    df = spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(df).collect()}
    want = brute_components(500, edges)
    assert got == {n: want[n] for e in edges if e[0] != e[1] for n in e}
    assert components(df.limit(0)).count() == 0


def tokens(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return [*t.encode(text, add_special_tokens=False).ids, 0]


def test_token_ids_equal_library():
    rng, own = random.Random(5), packing.encoding(JSON, P.PATTERN)
    parts = ["word", " word", "<|endoftext|>", "<|endoftext|", "|>", "<", "é", "日本", "12", "\n", "\t", "  ", "\x00\x07", "\u2028", "a" * 400, " " * 300, "don't", "😀"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert [*own.encode_to_numpy(text, allowed_special="all").tolist(), 0] == tokens(text)
    assert tokens("a <|endoftext|> b")[2] == 50256


def test_packing(spark):
    random.seed(6)
    rows = [(i, " ".join(random.choice(["word", "é", "日本", "12", "\n", "<|endoftext|>"]) for _ in range(random.randint(0, 90)))) for i in range(80)]
    rows += [(500, ""), (501, None), (502, "long " * 700), (None, "null id"), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, piece int")
    out = packing.pack_documents(df, JSON, P.PATTERN, 64).collect()
    coded = {}
    for i, t in rows:
        coded.setdefault(i, []).append(tokens(t or ""))
    total = sum(len(c) for v in coded.values() for c in v)
    assert sum(r.length for r in out) == total
    for r in out:
        assert any(zlib.crc32(np.asarray(c[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for c in coded[r.doc_id])
        assert r.piece == 0 or r.length == 64
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.03 * total / 64 + 1
    assert packing.pack_documents(df.limit(0), JSON, P.PATTERN, 64).count() == 0
    kept = packing.pieces(df, JSON, P.PATTERN, 64, keep="ids").where("doc_id = 502").orderBy("start").collect()
    assert [t for r in kept for t in r.ids] == coded[502][0]


def test_plan_fills_bins():
    random.seed(7)
    for _ in range(30):
        counts = {random.randint(1, 50): random.randint(1, 20) for _ in range(random.randint(1, 12))}
        rows, bins = packing.plan(counts, 50)
        used = dict.fromkeys(counts, 0)
        fill = {}
        for k, (length, first, per, base, offset) in enumerate(rows):
            later = [r[1] for r in rows[k + 1 :] if r[0] == length]
            until = later[0] if later else counts[length]
            assert first == used[length]
            for rank in range(first, until):
                b, slot = base + (rank - first) // per, (rank - first) % per
                fill.setdefault(b, []).append((offset + slot * length, length))
            used[length] = until
        assert used == counts and len(fill) == bins
        for b in fill.values():
            ends = sorted(b)
            assert [o for o, _ in ends] == list(np.cumsum([0] + [n for _, n in ends])[:-1]) and sum(n for _, n in ends) <= 50


def brute_print(text, size):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    random.seed(9)
    base = [" ".join(random.choice(["aa", "Bb", "cc", "dd", "éé", "ff"]) for _ in range(200)) for _ in range(6)]
    texts = []
    for b in base:
        for _ in range(25):
            w = b.split()
            for _ in range(random.randint(0, 2)):
                w[random.randrange(len(w))] = random.choice(["x", "y", "z"])
            texts.append(" ".join(w))
    texts += ["", None, "  \t", "one", "two words", "a b c", base[0], base[0], "long " * 30_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, base[1])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id bigint, text string, fingerprint string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    prints = [brute_print(t or "", 3) for t in texts]
    want = brute_components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    for r in got:
        if r.doc_id is not None:
            assert int.from_bytes(r.fingerprint, "big") == prints[r.doc_id] and r.component_id == want[r.doc_id]
        else:
            assert r.component_id == want[prints.index(brute_print(base[1], 3))]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_simhash_by_similarity(spark):
    random.seed(10)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(30):
        w = [word() for _ in range(150)]
        texts.append(w)
        for edits in (1, 3, 12):
            v = list(w)
            for at in random.sample(range(150), edits):
                v[at] = word()
            texts.append(v)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, corpus_pipeline.SHINGLE, corpus_pipeline.BITS, corpus_pipeline.DISTANCE, corpus_pipeline.EXPECTED, corpus_pipeline.LEAST).collect()}
    alike = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = brute_components(len(texts), alike)
    assert sum(got[i] == want[i] for i in got) >= 0.98 * len(texts)
    for i, c in got.items():
        assert c == i or want[i] == want[c]


def test_simhash_compares_equal_fingerprints(spark):
    text = made_words(23)
    line = text(9)
    rows = [(k, " ".join(line * 300 + text(40))) for k in range(6)]
    rows += [(6, rows[2][1]), (7, None), (8, " ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = simhash.near_duplicates(df, corpus_pipeline.SHINGLE, corpus_pipeline.BITS, corpus_pipeline.DISTANCE, corpus_pipeline.EXPECTED, corpus_pipeline.LEAST).collect()
    # the repeated line's five shingles weigh no more than five of the others
    assert len({r.fingerprint for r in found if r.doc_id < 7}) == 6
    assert {r.doc_id: r.component_id for r in found} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 2, 7: 7, 8: 7}


def test_simhash_repeated_lines(spark):
    """Against brute force over shingle sets: copies in which one line stands many more times."""
    text = made_words(31)
    texts = []
    for k in range(20):
        w = text(300)
        line = text(12)
        texts += [w + line, w + line * 30]
        if k % 4 == 0:
            texts.append(w[:240] + text(60) + line * 10)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    want = brute_components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert len(set(want)) < len(texts) - 15
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, corpus_pipeline.SHINGLE, corpus_pipeline.BITS, corpus_pipeline.DISTANCE, corpus_pipeline.EXPECTED, corpus_pipeline.LEAST).collect()}
    assert [found[i] for i in range(len(texts))] == want


def test_simhash_tries_other_partners(spark):
    rng, text = random.Random(24), made_words(24)
    base = text(160)
    texts = []
    for _ in range(300):
        v = list(base)
        for at in rng.sample(range(160), rng.randint(2, 5)):
            v[at] = text(1)[0]
        texts.append(v)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    want = brute_components(300, [(i, j) for i in range(300) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, corpus_pipeline.SHINGLE, corpus_pipeline.BITS, corpus_pipeline.DISTANCE, corpus_pipeline.EXPECTED, corpus_pipeline.LEAST).collect()}
    assert len(set(want)) > 20
    assert [found[i] for i in range(300)] == want


def test_simhash_deals_large_buckets(spark, monkeypatch):
    rng = random.Random(27)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(500)} | {rng.getrandbits(64) for _ in range(300)}
    prints = sorted(prints)
    df = spark.createDataFrame([(i, bytearray(v.to_bytes(8, "big"))) for i, v in enumerate(prints)], "id bigint, fingerprint binary")
    want = brute_components(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    for split in (2048, 20):
        monkeypatch.setattr(simhash, "BUCKET_TILE", split)
        monkeypatch.setattr(simhash, "SAMPLE", 16 if split > 20 else 1)
        found = simhash.links(df, simhash.pigeonhole(64, 2, len(prints))).collect()
        assert brute_components(len(prints), [(r.a, r.b) for r in found]) == want


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 16))
    x = np.concatenate([c + rng.normal(size=(8, 16)) * 0.25 for c in centre]).astype(np.float32)
    x[5] = x[4]
    x[6] = 3 * x[4]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, []), (1005, [float("inf")] + [0.0] * 15), (None, rows[4][1])]
    df = spark.createDataFrame([(*r, True) for r in rows + odd], "vec_id bigint, embedding array<float>, kept boolean")
    got = {r.vec_id: r for r in pq.near_duplicates(df).where("vec_id is not null").collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.9
    want = brute_components(len(x), list(zip(*np.nonzero(near), strict=True)))
    links = near.sum(1) - 1 + near[:, 4]  # the row without an id equals vector 4
    found = sum(got[i].n_links for i in range(len(x)))
    assert found <= links.sum() and found >= 0.98 * links.sum()
    assert sum(got[i].component_id == want[i] for i in range(len(x))) >= 0.98 * len(x)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in odd[:-1])
    assert pq.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_any_size(spark):
    """Components so small or large that their squares leave the range of doubles link as their directions do."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 8))
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(100 + i, (r * 1e-3).tolist()) for i, r in enumerate(x[:20])]
    rows += [(200, [1e-200] * 8), (201, [3e-200] * 8), (202, [1e200] * 7 + [1.1e200]), (203, (x[0] * 1e250).tolist())]
    got = {r.vec_id: r for r in pq.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    u = np.asarray([np.asarray(v) / np.abs(v).max() for _, v in rows])
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.9
    assert [got[i].n_links for i, _ in rows] == (near.sum(1) - 1).tolist()
    assert {got[i].component_id for i in (200, 201, 202)} == {200} and got[203].component_id == got[0].component_id


def test_embeddings_with_more_lists_than_probes(spark):
    """Links and components against all pairs, where a vector visits 16 of 40 lists; one group is dense and two dimensions are mixed."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(1200, 32))
    x = np.concatenate([c + rng.normal(size=(8, 32)) * rng.choice([0.2, 0.3, 0.4]) for c in centre] + [centre[0] + rng.normal(size=(800, 32)) * 0.15])
    small = np.concatenate([c[:12] + rng.normal(size=(4, 12)) * 0.2 for c in centre[:50]])
    assert len(x) // pq.LIST_ROWS > 2 * pq.PROBES
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(100_000 + i, r.tolist()) for i, r in enumerate(small)]
    got = {r.vec_id: r for r in pq.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    want, right, found = 0, 0, 0
    for first, part in ((0, x), (100_000, small)):
        u = part / np.linalg.norm(part, axis=1)[:, None]
        near = u @ u.T >= 0.9
        np.fill_diagonal(near, False)
        names = brute_components(len(part), list(zip(*np.nonzero(np.triu(near)), strict=True)))
        want += int(near.sum())
        found += sum(got[first + i].n_links for i in range(len(part)))
        assert all(got[first + i].n_links <= near[i].sum() for i in range(len(part)))
        right += sum(got[first + i].component_id == first + names[i] for i in range(len(part)))
    assert found >= 0.99 * want and right >= 0.99 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_top_k(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 70))
    x[10:40] = x[10]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame([(*r, 1) for r in [*rows, (777, None), (778, []), (None, rows[0][1]), (12, rows[12][1])]], "vec_id bigint, embedding array<float>, rank int").withColumn("code", mih.sign_code("embedding"))
    asked = df.where("vec_id in (0, 10, 100, 777)")
    bits = x > 0
    got = {}
    for r in mih.top_k(df, asked, 7, "vec_id", "code").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.neighbor_id))
    for q in (0, 10, 100):
        want = sorted((int((bits[q] != bits[i]).sum()), i) for i in range(300) if i != q)[:7]
        assert [(d, i) for _, d, i in sorted(got[q])] == want
    assert set(got) == {0, 10, 100}
    assert mih.top_k(df.limit(0), asked, 7, "vec_id", "code").count() == 0 and mih.top_k(df, asked.limit(0), 7, "vec_id", "code").count() == 0
    mixed = df.unionByName(spark.createDataFrame([(5000, [1.0] * 130, 1), (5001, [1.0], 1)], "vec_id bigint, embedding array<float>, rank int").withColumn("code", mih.sign_code("embedding")))
    rows_of = lambda t: sorted(tuple(r) for r in t.collect())
    assert rows_of(mih.top_k(mixed, mixed.where("vec_id in (0, 10, 5000)"), 7, "vec_id", "code")) == rows_of(mih.top_k(df.where("size(code) = 2"), asked.where("vec_id in (0, 10)"), 7, "vec_id", "code"))
    few = mih.top_k(df.where("vec_id < 3"), asked, 7, "vec_id", "code").where("query_id = 0").count()
    assert few == 2


def test_passages(spark):
    random.seed(11)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(random.randint(3, 8)))
    text = lambda n: [word() for _ in range(n)]
    shared, fuzzy = text(70), text(80)
    changed = list(fuzzy)
    for at in (20, 45, 63):
        changed[at] = word()
    del changed[30]
    rows = {1: text(100) + shared + text(50), 2: text(40) + shared, 3: fuzzy + text(200), 4: text(30) + changed + text(10), 5: text(400), 6: text(60) + shared[:30] + text(60), 7: shared}
    df = spark.createDataFrame([*((i, " ".join(w), 1) for i, w in rows.items()), (8, "", 1), (9, None, 1), (None, " ".join(shared), 1), (10, "kort", 1), (11, "zelfde regel hier " * 9000, 1)], "doc_id bigint, text string, doc int")
    got = {r.doc: r for r in passages.repeated(df).collect()}
    assert set(got) == {2, 4, 7}
    assert got[2].source == 1 and got[7].source == 1 and got[4].source == 3
    texts = {i: " ".join(w) for i, w in rows.items()}
    assert texts[2][got[2].start : got[2].stop] == " ".join(shared) and got[2].words == 70 and got[2].alike == 1.0
    assert texts[1][got[2].source_start : got[2].source_stop] == " ".join(shared)
    assert texts[4][got[4].start : got[4].stop] == " ".join(changed) and 0.9 < got[4].alike < 1
    cut = {r.doc_id: r.text for r in passages.without_repeats(df).collect()}
    assert cut[7] == "" and cut[1] == texts[1] and cut[9] is None and " ".join(shared) not in cut[2] and cut[6] == texts[6]
    assert passages.repeated(df.limit(0)).count() == 0


def made_words(seed):
    """A function that gives so many random words."""
    rng = random.Random(seed)
    return lambda n: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def test_passages_behind_a_stray_match(spark):
    text = made_words(21)
    rows, want = [], set()
    for k in range(40):
        stray, shared = text(12), text(60)
        rows += [(2 * k, " ".join(text(50) + stray + text(25) + shared + text(30))), (2 * k + 1, " ".join(text(40) + stray + text(28) + shared + text(20)))]
        want.add((2 * k + 1, " ".join(shared)))
    texts = dict(rows)
    got = passages.repeated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc, texts[r.doc][r.start : r.stop]) for r in got} == want


def test_alignment_keeps_exact_part_of_unlike_run():
    text = made_words(22)
    head, body = text(6), text(60)
    a, b = ([w.encode() for w in head + text(11) + head + text(11) + head + text(11) + body] for _ in range(2))
    assert any(i0 <= 51 and i1 == 111 and alike >= passages.MIN_ALIKE for i0, i1, _, _, alike in passages.align(a, b, [(0, 0), (51, 51)]))


def test_passages_of_long_words(spark):
    rng = random.Random(25)
    text = lambda n: ["".join(rng.choice("abcdefghijé") for _ in range(60)) for _ in range(n)]
    rows, want = [], set()
    for k in range(20):
        shared = text(100)
        rows += [(2 * k, " ".join(text(20) + shared + text(20))), (2 * k + 1, " ".join(text(30) + shared + text(10)))]
        want.add((2 * k + 1, " ".join(shared)))
    texts = dict(rows)
    got = passages.repeated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc, texts[r.doc][r.start : r.stop]) for r in got} == want


def test_passages_of_lines_known_elsewhere(spark):
    text = made_words(26)
    rows, want = [], set()
    for k in range(40):
        lines = [text(15) for _ in range(4)]
        shared = [w for line in lines for w in line]
        rows += [(10 * k + n, " ".join(text(20) + line + text(20))) for n, line in enumerate(lines)]
        rows += [(10 * k + 4, " ".join(text(30) + shared + text(20))), (10 * k + 5, " ".join(text(20) + shared + text(30)))]
        want.add((10 * k + 5, " ".join(shared)))
    texts = dict(rows)
    got = passages.repeated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc, texts[r.doc][r.start : r.stop]) for r in got} == want


def test_chain_equals_quadratic():
    random.seed(12)
    for _ in range(40):
        points = sorted({(random.randint(0, 400), random.randint(0, 400)) for _ in range(40)})
        x, y = np.asarray([p[0] for p in points]), np.asarray([p[1] for p in points])
        best = []
        for i in range(len(points)):
            before = [best[j] - passages.GAP_COST / 2 * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if x[j] < x[i] and y[j] < y[i]]
            best.append(passages.SEED_WEIGHT + max([0.0, *before]))
        lines = passages.chain(x, y)
        assert all(a <= b and c <= d for a, b, c, d in lines)
        if lines and len({p[1] for p in points}) == len(points):
            end = int(np.argmax(best))
            assert any(b == x[end] and d == y[end] for _, b, _, d in lines) or max(best) < passages.SEED_WEIGHT + 1e-9


def test_pipeline(spark, tmp_path):
    random.seed(13)
    word = lambda: "".join(random.choice("klmnopqrst") for _ in range(random.randint(3, 8)))
    rows = [(i, " ".join(word() for _ in range(120)), "nl", "s", 0) for i in range(60)]
    rows[1] = (1, rows[0][1], "nl", "s", 0)
    rows[2] = (2, rows[3][1].replace(rows[3][1].split()[7], "anders", 1), "nl", "s", 0)
    rows[9] = (9, rows[9][1] + " mail a@b.nl", "nl", "s", 0)
    rows += [(70, None, None, None, None), (71, "", "nl", "s", 0)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, 0) for i in range(60)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / f"{k}.parquet")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == columns
        if name == "simhash near-dedup":
            kept = {r.doc_id for r in docs.collect()}
            assert kept == {r[0] for r in rows} - {1, 3, 71}
        if name == "personal data":
            assert docs.where("doc_id = 9").first().text.endswith("mail [EMAIL]")
    assert {r.doc_id for r in docs.collect()} == kept
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_tidy_keeps_first_of_equal_names(spark):
    df = spark.range(1).select(F.lit(1).alias("doc_id"), F.lit("a b").alias("text"), F.lit("x").alias("Text"), F.lit("y").alias("fingerprint"))
    assert simhash.fingerprints(df).columns == ["doc_id", "fingerprint"]


def covered(spans, low, high):
    return any(a <= low and high <= b for a, b in spans)


def test_passages_find_every_exact_repeat(spark):
    """All runs of 50 words that an earlier document has, by a table of runs; words are few, so that seeds meet by chance.

    A run may begin or end with a word or two that go before or behind a passage in a later document than its first one,
    by chance; those needn't be found.
    """
    rng = random.Random(31)
    vocabulary = made_words(32)(600)
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages_, lines = [text(rng.randint(50, 140)) for _ in range(60)], [text(rng.randint(6, 30)) for _ in range(30)]
    rows = {}
    for i in range(400):
        words = text(rng.randint(0, 60))
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            words += rng.choice(passages_) if kind < 0.4 else rng.choice(lines) if kind < 0.7 else text(rng.randint(20, 80))
            words += text(rng.randint(0, 30))
        rows[i] = words
    seen, want = {}, []
    for i, words in rows.items():
        own = {}
        for at in range(len(words) - 49):
            run = tuple(words[at : at + 50])
            if run in seen:
                want.append((i, at))
            own[run] = i
        seen |= own
    found = passages.repeated(spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id bigint, text string")).collect()
    spans = {}
    for r in found:
        spans.setdefault(r.doc, []).append((r.start, r.stop))
        assert r.source < r.doc and r.words >= 50 and r.alike >= 0.8
    missed = 0
    for i, at in want:
        words = rows[i]
        low, high = len(" ".join(words[: at + 2])), len(" ".join(words[: at + 48]))
        missed += not covered(spans.get(i, []), low + 1, high)
    assert len(want) > 5000 and missed == 0
    # what is reported beyond exact runs stays small: the words of passages next to what is known
    repeated = sum(len(" ".join(words)[a:b].split()) for i, words in rows.items() for a, b in spans.get(i, []))
    exact = sum(len({w for i2, at in want if i2 == i for w in range(at, at + 50)}) for i in rows)
    assert repeated <= 1.1 * exact


def fuzzy_recall(spark, share, seed, n=150):
    rng, text = random.Random(seed), made_words(seed)
    rows, ends = [], {}
    for k in range(n):
        shared = text(rng.randint(60, 120))
        changed = list(shared)
        for at in rng.sample(range(1, len(shared) - 1), int(share * len(shared))):
            changed[at] = text(1)[0]
        head = text(rng.randint(20, 80))
        rows += [(2 * k, " ".join(text(50) + shared + text(30))), (2 * k + 1, " ".join(head + changed + text(40)))]
        ends[2 * k + 1] = (len(" ".join(head)) + 1, len(" ".join(head + changed)))
    got = passages.repeated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    hit = {r.doc for r in got if r.doc in ends and min(r.stop, ends[r.doc][1]) - max(r.start, ends[r.doc][0]) >= 0.9 * (ends[r.doc][1] - ends[r.doc][0])}
    over = sum(max(0, ends[r.doc][0] - r.start) + max(0, r.stop - ends[r.doc][1]) for r in got if r.doc in ends)
    assert {r.doc for r in got} <= set(ends) and over == 0
    return len(hit) / n


def test_passages_find_fuzzy_repeats(spark):
    assert fuzzy_recall(spark, 0.1, 33) >= 0.99
    assert fuzzy_recall(spark, 0.15, 34) >= 0.95
    assert fuzzy_recall(spark, 0.2, 35) >= 0.85


def test_passages_of_hot_seeds_are_the_same(spark, monkeypatch):
    text = made_words(36)
    shared, line = text(70), text(12)
    rows = [(i, " ".join(text(20) + (shared if i % 3 == 0 else line) + text(20 + i))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    plain = sorted(tuple(r) for r in passages.repeated(df).collect())
    monkeypatch.setattr(passages, "SAMPLE", 1)
    monkeypatch.setattr(passages, "HOT_ROWS", 3)
    assert plain == sorted(tuple(r) for r in passages.repeated(df).collect())
    assert [r[0] for r in plain] == list(range(3, 60, 3)) and all(r[5] == 0 and r[3] == 70 for r in plain)


def test_passages_of_ids_with_several_texts(spark):
    text = made_words(37)
    shared = " ".join(text(60))
    rows = [(1, shared), (2, "begin " + shared), (2, " ".join(text(80))), (3, shared), (3, shared), (None, shared), (4, None), (4, "")]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id bigint, text string, cut_doc string, cut_spans string")
    out = passages.without_repeats(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id or 0, r.text or "", r.cut_doc, r.cut_spans) for r in out.collect()))
    assert len(got) == len(rows) and {g[2:] for g in got} == {("a", "b")}
    assert [g[1] for g in got if g[0] == 3] == ["", ""] and [g[1] for g in got if g[0] == 0] == [shared]
    two = [g[1] for g in got if g[0] == 2]
    assert rows[2][1] in two and (("begin " in two) or ("begin " + shared in two))


def run_stages(spark, folder, rows, schema, labels):
    """The result of each stage, as rows; every stage's columns are those of the documents."""
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, out = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, folder)
        made.write.parquet(f"{folder}/{k}.parquet")
        docs = spark.read.parquet(f"{folder}/{k}.parquet")
        assert k == 4 or docs.columns == columns
        out.append(docs.collect())
    return out


def plain_pipeline(rows, labels):
    """What the stages must give, document by document: rows (id, text) after each of the first four, and the tokens of the fifth."""
    scores = dict(zip([i for i, _ in rows], plain_scores([t for t, _ in labels], [y for _, y in labels], sum(y for _, y in labels) / len(labels), [t or "" for _, t in rows]), strict=True))
    kept = [(i, t) for i, t in rows if scores[i] < 0.5]
    first = list(kept)
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in kept]
    alike = [(a, b) for a in range(len(kept)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    group = brute_components(len(kept), alike)
    kept = [r for n, r in enumerate(kept) if group[n] == n]
    second = list(kept)
    seen, third = set(), []
    for i, t in kept:
        words = (t or "").split(" ")
        runs = [tuple(words[k : k + 50]) for k in range(len(words) - 49)]
        gone = {w for k, run in enumerate(runs) if run in seen for w in range(k, k + 50)}
        seen |= set(runs)
        out = "".join(" " + w for k, w in enumerate(words) if k not in gone) if gone else None
        third.append((i, t if not gone else out.strip()))
    fourth = [(i, t and pii.redact(t, pii.find_spans(t))) for i, t in third]
    return first, second, third, fourth, {i: len(tokens(t or "")) for i, t in fourth}


def test_pipeline_equals_plain_form(spark, tmp_path):
    rng, text = random.Random(41), made_words(41)
    rows, toxic = [], set()
    passage, base = text(80), text(150)
    for i in range(240):
        words = text(rng.randint(60, 90))
        if i % 4 == 0:
            words[rng.randrange(50)] = rng.choice(["scumbag", "idiotic"])
            toxic.add(i)
        elif i % 8 == 1:
            words = words[:30] + passage + words[30:]
        elif i % 8 == 2:
            words = list(base)
            for at in rng.sample(range(150), rng.randint(0, 2)):
                words[at] = text(1)[0]
        elif i % 8 == 3:
            words[7] = rng.choice(["a.b@c.nl", "+31 6 1234 5678", "10.0.0.1"])
        rows.append((i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, " ".join(text(20_000)))]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint, _doc int, _cuts string, pii string, _score string, score int, other_0 int, fingerprint string, cut_doc int"
    full = [(i, t, "nl", "s", len(t) if t is not None else None, i, "c", "p", "x", 1, 2, "f", 3) for i, t in rows]
    labels = [(i, 0, int(i in toxic)) for i, _ in rows[:240]]
    free = sorted((t, bool(y)) for (i, t), (_, _, y) in zip(rows, labels) if zlib.crc32(str(i).encode()) % 5)
    got = run_stages(spark, str(tmp_path), full, names, labels)
    *want, sizes = plain_pipeline(rows, free)
    assert {i for i, _ in rows[:240]} - {i for i, _ in want[0]} >= {i for i in toxic if zlib.crc32(str(i).encode()) % 5}
    for k in range(4):
        assert sorted(r.doc_id for r in got[k]) == [i for i, _ in want[k]]
        texts = dict(want[k])
        for r in got[k]:
            squeezed = lambda t: t if t is None else " ".join(t.split())  # noqa: E731  a cut leaves both spaces
            assert squeezed(r.text) == squeezed(texts[r.doc_id]), (k, r.doc_id)
            assert r.n_chars == (None if r.text is None else len(r.text))
            assert (r._doc, r._cuts, r.pii, r._score, r.score, r.other_0, r.fingerprint, r.cut_doc) == (r.doc_id, "c", "p", "x", 1, 2, "f", 3)
    packed = {}
    for r in got[4]:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert set(packed) == set(sizes) and all(abs(packed[i] - n) <= 2 for i, n in sizes.items())
    assert len({r.sequence_id for r in got[4]}) == -(-sum(packed.values()) // 2048)


def test_pipeline_on_empty_tables(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    assert run_stages(spark, str(tmp_path / "a"), [], schema, []) == [[]] * 5
    odd = [(None, None, None, None, None), (None, "a b", None, None, None), (5, "a b", "x", None, 3), (5, "a b", "x", None, 3), (5, "c d", "x", None, 3)]
    got = run_stages(spark, str(tmp_path / "b"), odd, schema, [])
    assert [len(g) for g in got] == [5] * 5


def test_whole_copies_are_one_passage_and_not_seeded(spark, monkeypatch):
    """Thirty copies of a text: each is one passage of the first; only originals are looked through for seeds."""
    line = " ".join(f"line{i}" for i in range(30))
    text = "  " + " ".join(f"word{i}" for i in range(70)) + " " + line + " "
    rows = [(5, line), (7, text), *[(100 + i, text) for i in range(30)], (3, "short text"), (4, "short text"), (6, None), (8, None), (110, text)]
    seen = []
    plain = passages.shared_seeds
    monkeypatch.setattr(passages, "shared_seeds", lambda docs: seen.append(sorted(r["doc"] for r in docs.where("text is not null").collect())) or plain(docs))
    got = sorted(tuple(r) for r in passages.repeated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert seen == [[3, 5, 7]]
    assert got == [(100 + i, 2, len(text) - 1, 100, 1.0, 7, 2, len(text) - 1) for i in range(30)]


def test_seeds_of_several_texts_are_those_of_each():
    texts = ["a b c d e f g h i j k l m n o p q r s t " * 3, "", " ", "Één twee drie vier vijf zes zeven acht", "a b c d", "x " * 40, "日本 a b c\td e"]
    row, seed, at = passages.seeds_of([t.encode() for t in texts])
    for i, t in enumerate(texts):
        _, s, a = passages.seeds_of([t.encode()])
        assert (seed[row == i] == s).all() and (at[row == i] == a).all() and len(s) == (row == i).sum()
    assert set(row) == {0, 3, 5, 6}
