"""Row-by-row operators: encoding, licenses, personal data, chat, toxicity; against brute force and libraries."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.llm import bpe, chat, common, licenses, pii, toxicity

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
CODEC = bpe.codec(RANKS, P.PATTERN)
REFERENCE = tiktoken.Encoding("check", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
LONG = "lang " * 60_000
ODD = [(1, ""), (2, None), (3, "The mit License. İK <s> </s>"), (4, LONG), (None, "x"), (3, "The mit License. İK <s> </s>")]


def docs(spark, rows=ODD):
    """Documents with columns whose names clash with results and with each other."""
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, ids string, pii int")
    return df.select("*", F.lit(5).alias("TEXT2"), F.lit("b").alias("n_words"), F.lit(1.0).alias("Score"))


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_bpe_equals_library(text):
    ids = np.frombuffer(CODEC.encode(text), "<i4").tolist()
    assert ids == REFERENCE.encode_ordinary(text)
    assert CODEC.bpe.decode(ids) == text.encode()


@given(st.binary(max_size=30), st.binary(max_size=8), st.integers(0, 30), st.integers(0, 6))
@settings(max_examples=200, deadline=None)
def test_bpe_append_and_edit(data, more, start, size):
    buffer = bpe.Buffer(CODEC.bpe, data)
    buffer.append(more)
    assert buffer.ids() == bpe.Buffer(CODEC.bpe, data + more).ids()
    start = min(start, len(buffer.data))
    end = min(len(buffer.data), start + size)
    buffer.replace(start, end, more[:3])
    assert buffer.ids() == bpe.Buffer(CODEC.bpe, buffer.data).ids()


def test_bpe_columns(spark):
    coded = bpe.encode(docs(spark), RANKS, P.PATTERN)
    assert coded.columns.count("ids") == 1 and dict(coded.dtypes)["ids"] == "array<int>"
    rows = bpe.decode(coded, RANKS, P.PATTERN).collect()
    assert sorted(((r.text or "").encode() == bytes(r.decoded), r.ids == REFERENCE.encode_ordinary(r.text or "")) for r in rows) == [(True, True)] * 6
    both = bpe.encode_decode(docs(spark), RANKS, P.PATTERN).collect()
    assert sorted((len(r.ids), bytes(r.decoded)) for r in both) == sorted((len(r.ids), bytes(r.decoded)) for r in rows)
    assert bpe.encode(docs(spark, []), RANKS, P.PATTERN).count() == 0


PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def brute_pii(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")), "card": 12 <= len(digits) <= 19 and pii.luhn(digits or "1"), "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), order, m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(out)]


def test_pii_equals_patterns():
    random.seed(5)
    alphabet = ["@.a-", "0123456789", ". -+()", "12 45.9", "password=İé ", "+4.@b%_", "4111 1111 1111 1111", "https://a.b/c", "token: abcdef12"]
    for _ in range(5000):
        text = "".join(random.choice(random.choice(alphabet)) for _ in range(random.randint(0, 60)))
        assert [s for s in pii.find_spans(text) if s[2] in pii.BASE_KINDS] == brute_pii(text), text


def test_pii_columns(spark):
    rows = [*ODD, (9, "mail a.b@c.de or +1 (606) 555-7814, password=ab12cd34ef, IBAN NL91 ABNA 0417 1643 00")]
    found = {r.doc_id: (r.text, [s.kind for s in r.pii]) for r in pii.scrub(docs(spark, rows)).collect()}
    assert found[9] == ("mail [EMAIL] or [PHONE], password=[SECRET], IBAN [IBAN]", ["email", "phone", "secret", "iban"])
    assert found[2] == (None, []) and found[4][0] == LONG
    assert pii.scan(docs(spark, [])).count() == 0


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    starts, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES:
        want = phrase.split()
        for i in range(len(words) - len(want) + 1):
            if words[i : i + len(want)] == want:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_licenses(spark):
    random.seed(3)
    some = ["under", "the", "MIT", "license", "apache", "version", "2", "cc", "by", "nc", "é", "K", "x"]
    rows = [*ODD, *[(100 + i, " ".join(random.choice(some) for _ in range(random.randint(0, 60)))) for i in range(150)], (50, "Cc-By-NC under the MIT/license! Apache License, Version 2.0")]
    texts = dict(rows)
    got = licenses.scan(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(texts[r.doc_id] or "")
    fuzzy = [(1, "This program: licensed under the really GNU General Public License, version 3."), (2, "licensed under the gnu general public license version"), (3, "Licensed under the Apache License, Version 2.0")]
    found = {r.doc_id: (r.base_labels, r.labels) for r in licenses.scan(docs(spark, fuzzy)).collect()}
    assert found == {1: ("", "gpl-3"), 2: ("", ""), 3: ("apache-2", "apache-2")}
    assert licenses.scan(docs(spark, [])).count() == 0
    notices = "\n".join(f"{k}: {phrase}" for k in range(1500) for phrase, _ in (*licenses.BASE_PHRASES, *licenses.TEMPLATES))
    (r,) = licenses.scan(docs(spark, [(1, notices)])).collect()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(notices)
    assert set(r.labels.split(",")) == {label for _, label in (*licenses.BASE_PHRASES, *licenses.TEMPLATES)}


@given(st.lists(st.sampled_from(["<", "</", "s>", "[", "/", "INST]", "\\", "a", "</s>", "[INST]", "é", "\n"]), max_size=12))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible(parts):
    text = "".join(parts)
    out, _, start, stop = chat.assemble(chat.pa.array(["user"]), chat.pa.array([text]))
    whole = out.tobytes().decode()
    assert chat.parse(whole)[0][:2] == ("user", text) and len(chat.parse(whole)) == 1
    assert chat.unescape(out[start[0] : stop[0]].tobytes().decode()) == text


def test_chat(spark, monkeypatch):
    rows = [(1, 1, "assistant", "b </s>[INST] é"), (1, 0, "user", "a"), (2, 0, None, None), (2, 0, None, None), (None, 3, "assistant", "z"), (3, 0, "assistant", LONG), (3, 1, "tool", "<s>"), (3, 2, "assistant", "")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, loss int, chunk int")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(df)).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        turns = sorted(([t[1], t[2] or "", t[3] or ""] for t in rows if t[0] == conv), key=lambda t: t[:2])
        loss = "".join(t[2] for t in turns if t[1] == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{t[1]}\n{t[2]}\n" for t in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_toxicity_learns(spark):
    random.seed(8)
    word = lambda: "".join(random.choice("aeioutnrs") for _ in range(random.randint(2, 7)))
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        text = [word() for _ in range(60)]
        if toxic:
            text[random.randrange(60)] = random.choice(["scumbag", "idiotic"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    d = spark.createDataFrame([*rows, (10_000, ""), (10_001, None), (10_002, LONG), (None, "x")], "doc_id bigint, text string").withColumn("SCORE", F.lit("clash"))
    model = toxicity.train(d, spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id bigint, toxic int"))
    out = {r.doc_id: (r.score, r.out) for r in toxicity.score(d, model).withColumn("out", toxicity.held_out()).collect()}
    held = [(i, y) for i, y in labels if out[i][1]]
    assert 80 < len(held) < 160 and sum((out[i][0] >= 0.5) == bool(y) for i, y in held) / len(held) > 0.95
    assert all(0 <= s <= 1 for s, _ in out.values()) and out[10_000][0] == out[10_001][0] and out[None][1] is False
    empty = toxicity.train(d.limit(0), spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.score(d.limit(0), empty).count() == 0 and empty.features == 0


def plain_buckets(text):
    data = b" " + b" ".join(text.encode().lower().split()) + b" "
    out = set()
    for size in toxicity.ORDERS:
        for at in range(len(data) - size + 1):
            rolled = 0
            for c in data[at : at + size]:
                rolled = rolled * 0x100000001B3 + c & (1 << 64) - 1
            out.add(((rolled ^ size) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - toxicity.BITS)
    return out


def plain_scores(texts, toxic, prior, asked):
    """The same classifier with dictionaries and dense rows."""
    found = [plain_buckets(t) for t in texts]
    n = [toxic.count(False), toxic.count(True)]
    counts = {}
    for own, label in zip(found, toxic, strict=True):
        for g in own:
            counts.setdefault(g, [0, 0])[label] += 1
    ratio = {g: math.log((c[1] + 1) / (n[1] + 2)) - math.log((c[0] + 1) / (n[0] + 2)) for g, c in counts.items()}
    names = sorted(g for g, c in counts.items() if sum(c) >= 3 and abs(ratio[g]) / math.sqrt(1 / (c[1] + 1) + 1 / (c[0] + 1)) >= toxicity.MIN_Z)
    x = np.asarray([[ratio[g] if g in own else 0.0 for g in names] for own in found])
    y = np.asarray(toxic, float)
    w, b = np.zeros(len(names)), math.log(n[1] / n[0])
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, toxicity.STEPS + 1):
        slope = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
        g = np.append(x.T @ slope + toxicity.RIDGE * w / len(y), slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = toxicity.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    shift = math.log(prior / (1 - prior)) - math.log(n[1] / n[0])
    return [1 / (1 + math.exp(-(b + shift + sum(w[k] * ratio[g] for k, g in enumerate(names) if g in (own := plain_buckets(t)))))) for t in asked]


def toxic_rows(n=400):
    rng = random.Random(18)
    word = lambda: "".join(rng.choice("aeioutnrs") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(n):
        text = [word() for _ in range(30)]
        if i % 3 == 0:
            text[rng.randrange(30)] = rng.choice(["scumbag", "Idiotic"])
        rows.append((i, " ".join(text), int(i % 3 == 0)))
    return rows


def test_toxicity_equals_plain_form_and_never_sees_held_out_labels(spark):
    rows = toxic_rows()
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    scores = []
    for flip in (False, True):
        labels = spark.createDataFrame([(i, 1 if flip and i in held else y) for i, _, y in rows], "doc_id bigint, toxic int")
        scores.append({r.doc_id: r.score for r in toxicity.score(d, toxicity.train(d, labels)).collect()})
    assert scores[0] == scores[1]
    free = sorted((t, bool(y)) for i, t, y in rows if i not in held)
    want = plain_scores([t for t, _ in free], [y for _, y in free], sum(y for _, y in free) / len(free), [t for _, t, _ in rows])
    assert len(set(want)) > 1 and all(abs(scores[0][i] - s) < 1e-5 for (i, _, _), s in zip(rows, want, strict=True))


def test_toxicity_bounds_of_the_fit(spark):
    rows = toxic_rows()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1, f"zz {k}") for k in range(3000)], "doc_id bigint, text string")
    free = [t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5]
    assert toxicity.train(d, labels).texts == len(free)
    assert toxicity.train(d, labels, max_texts=50).texts == 100
    shortest = [sorted(len(t) for i, t, y in rows if y == label and zlib.crc32(str(i).encode()) % 5) for label in (0, 1)]
    assert toxicity.train(d, labels, max_bytes=5000).texts == sum(int((np.cumsum(s) <= 5000).sum()) for s in shortest)


def test_chunks_are_bounded_by_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(common, "CHUNK_ROWS", 4)
    monkeypatch.setattr(common, "CHUNK_BYTES", 10)
    texts = ["aaa", None, "bbbb", "cc", "dd", "e" * 30, "", "f", "g", "h", "i", "j"]
    batch = common.pa.RecordBatch.from_arrays([common.pa.array(texts), common.pa.array(range(len(texts)))], ["text", "id"])
    assert list(common.chunks(batch)) == [(0, 4), (4, 5), (5, 6), (6, 10), (10, 12)]
    assert list(common.chunks(batch.slice(0, 0))) == []
