"""Token counts: an exact histogram of encoded lengths and its suffix sums.

The histogram has a row per distinct length, so everything after the encoding pass works on a table that
grows with the longest document and not with the corpus. Running sums go through blocks of lengths: sums
of blocks first, then sums within each block, so that no single task orders all lengths.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenising pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Fixed value: the characters that the pattern's \\s stands for.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = re.compile(f"[{WHITE}]{{1000,}}")
BLOCK = 1024


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The byte-level encoder of a rank file, loaded once per Python worker."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: str | None, encoding) -> int:
    """Encoded length of a whole text. Long runs of white space are cut out, for the pattern backtracks over every place of one.

    Of a run the pattern takes all but the last character as one piece, at the end of a text all of it, so the
    parts encode as the whole does.
    """
    n = at = 0
    for run in LONG_RUN.finditer(text or ""):
        end = run.end() - (run.end() < len(text))
        n += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
        at = end
    return n + len(encoding.encode_ordinary(text[at:])) if text else 0


def lengths(documents: DataFrame, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """n_tokens of every whole text, one row each; a null text has none. Special tokens in a text are ordinary text.

    Equal rows count each, other columns of the table don't matter. ``vocabulary`` is a rank file that all
    executors can open; tasks need the package tiktoken.
    """

    def count(batches):
        encoding = encoder(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n_tokens(v.as_py(), encoding) for v in batch.column(0)], pa.int64())], ["n_tokens"])

    return documents.select(F.col(text).alias("text")).mapInArrow(count, "n_tokens long")


def histogram(found: DataFrame) -> DataFrame:
    """(n_tokens, n_docs), written once: it is small, and what reads it must not encode the corpus again."""
    return written(found.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "histogram")


def curve(counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length that occurs, as a context limit: what is at, below and above it.

    docs_le and tokens_le count documents of at most n_tokens, docs_ge and tokens_ge those of at least as
    many; truncated_total is the corpus cut to n_tokens a document; share_le is docs_le over all documents.
    An empty histogram gives no rows.
    """
    counts = counts.withColumn("block", F.floor(F.col("n_tokens") / block)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    before, everything = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    blocks = blocks.select(
        "block", F.coalesce(F.sum("block_docs").over(before), F.lit(0)).alias("docs_before"), F.coalesce(F.sum("block_tokens").over(before), F.lit(0)).alias("tokens_before"),
        F.sum("block_docs").over(everything).alias("all_docs"), F.sum("block_tokens").over(everything).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counts.join(blocks, "block")
    rows = rows.withColumn("docs_le", F.col("docs_before") + F.sum("n_docs").over(within)).withColumn("tokens_le", F.col("tokens_before") + F.sum("tokens").over(within))
    docs_ge, tokens_lt = F.col("all_docs") - F.col("docs_le") + F.col("n_docs"), F.col("tokens_le") - F.col("tokens")
    return rows.select(
        "n_tokens", "n_docs", "docs_le", docs_ge.alias("docs_ge"), "tokens_le", (F.col("all_tokens") - tokens_lt).alias("tokens_ge"),
        (tokens_lt + F.col("n_tokens") * docs_ge).alias("truncated_total"), (F.col("docs_le") / F.col("all_docs")).alias("share_le"),
    )


def truncated(found: DataFrame, limits: list[int]) -> DataFrame:
    """Total tokens when each document is cut to a limit, for any limits, from the curve's sums.

    At the first length that isn't below a limit stand the documents to be cut and the tokens of all others.
    """
    out = []
    for x in limits:
        at = F.min(F.when(F.col("n_tokens") >= x, F.struct("n_tokens", "docs_ge", (F.col("tokens_le") - F.col("n_tokens") * F.col("n_docs")).alias("below"))))
        total = F.coalesce(at["below"] + F.lit(int(x)) * at["docs_ge"], F.max("tokens_le"))
        out.append(F.struct(F.lit(int(x)).cast("long").alias("context_limit"), total.alias("total")))
    return found.agg(F.array(*out).alias("x")).selectExpr("inline(x)")


def quantiles(found: DataFrame, levels: list[float]) -> DataFrame:
    """The smallest length that at least a share of the documents does not exceed, for each level."""
    out = [F.struct(F.lit(float(q)).alias("level"), F.min(F.when(F.col("share_le") >= q, F.col("n_tokens"))).alias("n_tokens")) for q in levels]
    return found.agg(F.array(*out).alias("x")).selectExpr("inline(x)")
