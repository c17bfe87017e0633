"""Registered queries over the test tables, each with its DuckDB oracle.

Every query reads the given tables at ``sf_dir`` (or data Spark derives from
them) and runs over whole tables and whole texts.  Stand-ins (SURVEY §5):
``conversations`` = songs (conv_id = id, turn = pos, role = label, text =
stanza); ``documents`` = corpus / answers (source = artist or model);
``benchmark`` = protected corpus; ``labels.quality`` = vote; ``embeddings``
label = model (0 = target); ``events`` = judge scores and JSON props.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# Text-heavy tables and the key their jobs group by.
TEXT_TABLES = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """Read one given table.  ``spread=True`` is for text-heavy jobs: when
    the scan yields too few partitions it is hash-partitioned by the
    table's key (see ``session.spread``); plain relational queries leave
    the scan as it is, so no shuffle is added for them."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if spread and name in TEXT_TABLES:
        from strophekit.session import spread as _spread
        df = _spread(df, [TEXT_TABLES[name]])
    return df


def r6(c) -> F.Column:
    """Presentation rounding shared with the oracle (6 places)."""
    return F.round(c.cast("double"), 6)


def load() -> tuple[dict, dict]:
    """Import the modules that register queries; returns (queries, oracles)."""
    from strophekit.plans import (  # noqa: F401
        q_compare, q_corpus, q_embeddings, q_encode, q_io, q_prep, q_relational, q_songs, q_records,
    )
    return QUERIES, ORACLES
