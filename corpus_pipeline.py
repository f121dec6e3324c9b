"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; the last returns one row a piece of a packed sequence. A line that
goes changes only a document's text. No stage is fitted to the size of its input.

In every stage: columns of any name beside doc_id and text are kept (but by packing) and not read; an empty table gives an empty one; very
long texts are taken whole. What each does with nulls, empty texts, ties and repeated rows stands at it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenreel.llm import decontaminate, linededup, packing, simhash, toxicity
from lumenreel.llm.common import cut, forget, read

#: Near-duplicate stages take shingles of five words, and link at this similarity or more.
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the CRF rejects go.

    A null, empty or wordless text scores as one without a toxic token and stays; a score of exactly REJECT goes. Rows are judged by
    their text alone, so repeated rows go or stay together, and rows without an id are judged like others. Without labels all stay."""
    return toxicity.reject(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are alike only the first stays (least doc_id, then least line); every row stays.

    Null and empty texts are unchanged; a text that loses all its lines is empty. Rows without an id are neither changed nor counted.
    Rows that share an id count as one document and lose the same line numbers, so a repeated row loses nothing to its twin."""
    return linededup.dedup(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document with the least id stays.

    Linked are fingerprints at BITS differing bits and texts with a similarity of NEAR_SIMILARITY or more on shingles of NEAR_WORDS words. All
    null, empty and wordless texts are one class. Rows without an id stay. Of rows that share an id and a class one stays; rows that
    share an id and belong to different classes are judged each on its own."""
    return simhash.keep_one(docs, NEAR_WORDS, NEAR_SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go.

    Null and wordless texts stay; null and wordless items count for nothing, items without an id count. Rows are judged by their text
    alone. Without a benchmark all stay."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a sequence of 1024 tokens.

    A null text is empty: its end id alone. Each row is packed on its own, repeated rows and rows without an id too."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", dedup_documents),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: The stages learn, hash and tokenise; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
