"""A corpus pipeline of five of the operators: what is toxic goes, near copies go, repeated passages go, personal
data is masked, and what is left is packed into sequences.

Every stage works on all that its predecessor kept and returns the columns of ``documents``, but for
the last one, which returns pieces and their places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import passages, pii, simhash, toxicity
from waymark.llm.queries import packed
from waymark.session import ensure_checkpoint_dir, written

#: SimHash for 5-word shingles: of 256 bits, texts with a Jaccard similarity of 0.8 differ in 15.15 % (the
#: angle between their shingle sets is 27 degrees), that is 39 bits with a standard error of 6. Pairs up to three
#: standard errors above are proposed, and those with an exact similarity of at least 0.8 are links.
SHINGLE, BITS, DISTANCE, EXPECTED, LEAST = 5, 256, 56, 0.1515, 0.8


def _plain(docs: DataFrame) -> DataFrame:
    """``docs`` with doc_id and text as the first columns of these names are, and every other column under a name that no operator uses."""
    low = [c.lower() for c in docs.columns]
    kept = {low.index(c): c for c in ("doc_id", "text")}
    return docs.toDF(*[kept.get(i, f"other_{i}") for i in range(len(low))])


def _named(df: DataFrame, docs: DataFrame, changed: bool = False) -> DataFrame:
    """A ``_plain`` form under the names of ``docs`` again; where texts have ``changed``, n_chars is how long they are now."""
    plain = _plain(docs).columns
    return df.select(*[F.length("text").cast("bigint").alias(c) if changed and c == "n_chars" else F.col(p).alias(c) for p, c in zip(plain, docs.columns, strict=True)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of these documents, doesn't take for toxic (score below 0.5).

    Null and empty texts have the score of a text without n-grams. Rows are judged one by one: repeated ones and rows without
    an id too, by their text. Without labels of both classes nothing stands out, and all stay if fewer than half of the labels
    are toxic. An empty table stays empty; other columns, however named, come through.
    """
    ensure_checkpoint_dir(spark)
    rows = _plain(docs)
    model = toxicity.train(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _named(toxicity.score(rows, model, name="score").where("score < 0.5"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id.

    Null and empty texts and those without words are copies of each other. Rows that share the id that stays all stay, rows that
    share another one go if any of them is a copy; documents without an id stay. An empty table stays empty; other
    columns, however named, come through.
    """
    rows = _plain(docs)
    found = simhash.near_duplicates(rows, SHINGLE, BITS, DISTANCE, EXPECTED, LEAST)
    copies = found.where("doc_id <> component_id").select(F.col("doc_id").alias("copy")).distinct()
    return _named(rows.join(copies, rows["doc_id"] == copies["copy"], "left_anti"), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has.

    Null texts stay null, and a document that only repeats others stays with an empty text. Rows that share an id are one
    document (see ``passages.repeated``), so none of them is cut for another; rows without an id stay as they are. An empty
    table stays empty; other columns, however named, come through.
    """
    return _named(passages.without_repeats(_plain(docs)), docs, changed=True)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind.

    Row by row: null texts stay null, repeated rows are masked alike, an empty table stays empty; other columns, however
    named, come through.
    """
    ensure_checkpoint_dir(spark)
    return _named(pii.scrub(_plain(docs)), docs, changed=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens.

    Null and empty texts are one end token; repeated rows and rows without an id are documents of their own; an empty
    table gives no rows; other columns are ignored.
    """
    return packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("personal data", mask_personal_data),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor fingerprints, chaining or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is a table before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
