"""License scans by diagonal voting.

All rolling hashes of k consecutive words of a text are joined in Spark with the positions of the same
hashes in license templates. A hit's diagonal is its position minus the template position: a passage
that follows a template piles its hits up on one diagonal, or on neighbouring ones where words are
missing or extra. Votes are added up per diagonal in Spark, neighbouring diagonals are merged, and spans are
verified against the words of the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import list_array, map_batches, texts_of, tidy, with_fields

K = 3
#: Base phrases (found exactly, every place counts) and their labels.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Wording of well-known licenses and their labels, found with gaps too; at most 64 k-grams each.
#: Where the wording ends in a version, its last k-gram has to stand, so that versions don't mix.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: A template's label stands where this share of its words is found along merged diagonals ...
MIN_COVERAGE = 0.8
#: ... whose offsets lie within so many words of each other.
MAX_DRIFT = 4

_KEEP = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_FACTOR = tuple(pow(0x9E3779B97F4A7C15, e, 1 << 64) for e in range(K))


def words(text: str) -> list[bytes]:
    """Words as UTF-8: runs of 0-9, A-Z in lower case, a-z and every character beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split()


def gram_hashes(found: list[bytes]) -> np.ndarray:
    """Rolling 64-bit hashes of K words from each position on."""
    n = len(found) - K + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    out = np.zeros(n, np.uint64)
    for k in range(K):
        out += each[k : k + n] * np.uint64(_FACTOR[K - 1 - k])
    return out.view(np.int64)


def _template_rows() -> list[tuple[int, int, int]]:
    """(hash, template, position) of every template k-gram."""
    return [(int(h), t, i) for t, (phrase, _) in enumerate((*BASE_PHRASES, *TEMPLATES)) for i, h in enumerate(gram_hashes(words(phrase)))]


def _grams() -> list[list[bytes]]:
    return [[b" ".join(w[i : i + K]) for i in range(len(w) - K + 1)] for w in (words(p) for p, _ in (*BASE_PHRASES, *TEMPLATES))]


def scan(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Licenses in every whole text: ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base phrases count wherever their words stand consecutively; first_word and last_word are their
    smallest and largest start (else null). ``labels`` has the templates' labels too, found with up to a
    fifth of the words changed. ``score`` is the best coverage of a phrase or template, 0 if none stands.
    Null texts count as empty, with no words. A row comes out for each row that goes in, repeated ids and
    null ids included; other columns are ignored. The templates are a fixed list, so their join is a
    broadcast; only hits are shuffled, by row.
    """
    spark = df.sparkSession
    df = tidy(df, [id_col, text_col]).select(F.monotonically_increasing_id().alias("_row"), F.col(id_col), F.col(text_col).alias("text"))
    rows = _template_rows()
    low = np.zeros(1 << 16, bool)
    low[[h & 0xFFFF for h, _, _ in rows]] = True
    schema = with_fields(df.drop("text"), "n_words bigint, hashes array<bigint>, proof array<struct<at:int,gram:binary>>")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            count, hashes, at, grams, proofs = [], [], [], [], []
            for text in texts_of(batch.column("text")):
                found = words(text)
                h = gram_hashes(found)
                # what verification may need: the words behind hashes that could be a template's
                maybe = np.flatnonzero(low[h & 0xFFFF])
                count.append(len(found))
                hashes += [np.zeros(1, np.int64), h]
                at.append(maybe)
                grams += [b" ".join(found[i : i + K]) for i in maybe.tolist()]
                proofs.append(len(maybe))
            lengths = np.asarray([len(a) + len(b) for a, b in zip(hashes[::2], hashes[1::2], strict=True)], np.int64)
            proof = pa.StructArray.from_arrays([pa.array(np.concatenate(at).astype(np.int32)), pa.array(grams, pa.binary())], ["at", "gram"])
            return pa.RecordBatch.from_arrays([batch.column("_row"), batch.column(id_col), pa.array(count, pa.int64()), list_array(pa.array(np.concatenate(hashes)), lengths), list_array(proof, np.asarray(proofs))], ["_row", id_col, "n_words", "hashes", "proof"])

        return step

    read = map_batches(df, make, schema)
    # place 0 of each array stands for the row itself, so that rows without hits stay
    each = read.select("_row", id_col, "n_words", "proof", F.posexplode("hashes").alias("_place", "_hash"))
    # hits are sorted before they are added up: only the row itself carries the words that prove them
    each = each.withColumn("proof", F.when(F.col("_place") == 0, F.col("proof")))
    table = spark.createDataFrame(rows, "hash bigint, template int, position int")
    hits = each.join(F.broadcast(table), (each["_hash"] == table["hash"]) & (each["_place"] > 0), "left").where("_place = 0 or template is not null")
    is_row = F.col("_place") == 0
    votes = hits.groupBy("_row", id_col, "template", (F.col("_place") - 1 - F.col("position")).alias("diagonal")).agg(F.expr("bit_or(shiftleft(1L, position))").alias("mask"), F.max(F.when(is_row, F.col("n_words"))).alias("n_words"), F.collect_list("proof").alias("proof"))
    # lists of one or none: unlike first(), they don't copy a long text's proof at every row they meet
    per_row = votes.groupBy("_row", id_col).agg(F.max("n_words").alias("n_words"), F.get(F.collect_list(F.get("proof", F.lit(0))), F.lit(0)).alias("proof"), F.collect_list(F.when(F.col("template").isNotNull(), F.struct("template", "diagonal", "mask"))).alias("votes"))
    return map_batches(per_row, lambda: _judge(id_col), with_fields(per_row.select(id_col, "n_words"), "n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"))


def _judge(id_col: str):
    phrases, grams = (*BASE_PHRASES, *TEMPLATES), _grams()
    base = len(BASE_PHRASES)

    def positions(mask: int) -> list[int]:
        mask &= (1 << 64) - 1
        return [i for i in range(mask.bit_length()) if mask >> i & 1]

    def verdict(votes: list[dict], proof: dict[int, bytes]) -> tuple:
        starts, base_labels, labels, best = [], set(), set(), 0.0
        fuzzy: dict[int, list[tuple[int, list[int]]]] = {}
        for v in votes:
            t, d = v["template"], v["diagonal"]
            held = [p for p in positions(v["mask"]) if proof.get(d + p) == grams[t][p]]
            if t < base:
                if len(held) == len(grams[t]):
                    starts.append(d)
                    base_labels.add(phrases[t][1])
                    best = 1.0
            elif held:
                fuzzy.setdefault(t, []).append((d, held))
        for t, lines in fuzzy.items():
            lines.sort()
            size, low = len(grams[t]) + K - 1, 0
            for high in range(len(lines)):
                while lines[high][0] - lines[low][0] > MAX_DRIFT:
                    low += 1
                covered = {p + k for d, held in lines[low : high + 1] for p in held for k in range(K)}
                share = len(covered) / size
                ends = phrases[t][0][-1:].isdigit() and not any(held[-1] == len(grams[t]) - 1 for _, held in lines[low : high + 1])
                if share >= MIN_COVERAGE and not ends:
                    labels.add(phrases[t][1])
                    best = max(best, share)
        return len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(base_labels | labels)), best

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [verdict(v, {p["at"]: p["gram"] for p in w or ()}) if v else (0, None, None, "", "", 0.0) for v, w in zip(batch.column("votes").to_pylist(), batch.column("proof").to_pylist(), strict=True)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        return pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("n_words"), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return step
