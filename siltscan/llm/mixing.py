"""Mixing sources to target weights by Sainte-Laguë apportionment.

Documents fall into shards by a hash of their id, about ``SHARD_TOKENS`` tokens each, so nothing is ever ordered
across a whole source. Within a shard each source's documents, in a seeded order, are laid end to end and cut into
blocks of ``BLOCK_TOKENS`` tokens; a document starts in one block and may span others. A shard gives its seats
(``FRACTION`` of all its blocks, rounded up) to the sources by the highest quotients weight / (2 k + 1), k being the
block's number within its source; a source has as many quotients as blocks, so a seat it can't fill goes to the next. Ties
go to the first source by name. A source's blocks are then taken in a second seeded order until its quota is used up: a
block in which documents start costs one seat and one more for each following block that only its last document spans;
one that the quota ends within is taken where at least half of it fits. So a source's tokens keep to its quota within half
a block, or half of one document that is longer than a block.

Weights may be given by source; by default they are the square roots of the sources' token totals, which flattens
large sources. A source without a given weight gets nothing. Tokens are counted natively: each character of a script without
spaces, and each piece of at most ``PIECE`` characters of a run of others; ``tokens_col`` names a column with a
tokenizer's counts to use instead. Rows with one id and source are one document; null text counts 0 tokens and still
belongs to a block; null sources form a source of their own named ''; null ids form one document. Texts of any length are
counted whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltscan.llm._common import cut, small

BLOCK_TOKENS, SHARD_TOKENS, FRACTION, SEED = 2_048, 4_000_000, 0.7, "siltscan-mix-1"
PIECE = 6
UNSPACED = "\\x{0E00}-\\x{0EFF}\\x{1000}-\\x{109F}\\x{1780}-\\x{17FF}\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{3FFFF}"
TOKEN = f"[{UNSPACED}]|[^ \\t\\r\\n{UNSPACED}]{{1,{PIECE}}}"


def _rank(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *parts))


def units(docs: DataFrame, tokens_col: str | None = None) -> DataFrame:
    """(id, source, tokens), a row per distinct id and source."""
    # A distinct name: the caller's columns may be called anything.
    n = F.coalesce(F.col(tokens_col) if tokens_col else F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("bigint")
    return (
        docs.select(F.col("doc_id").cast("string").alias("id"), F.coalesce("source", F.lit("")).alias("source"), n.alias("tokens"))
        .groupBy(F.coalesce("id", F.lit("")).alias("id"), "source")
        .agg(F.sum("tokens").alias("tokens"))
    )


def apportion(blocks: DataFrame, seats: DataFrame) -> DataFrame:
    """Quota per (shard, source). ``blocks``: shard, source, weight, n_blocks; ``seats``: shard, n_seats."""
    quotients = blocks.select(
        "shard", "source", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("k"), "weight"
    ).select("shard", "source", (F.col("weight") / (2 * F.col("k") + 1)).alias("quotient"))
    order = Window.partitionBy("shard").orderBy(F.desc("quotient"), "source")
    won = quotients.withColumn("seat", F.row_number().over(order)).join(seats, "shard").where("seat <= n_seats")
    return won.groupBy("shard", "source").agg(F.count("*").alias("quota"))


def selected(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    fraction: float = FRACTION,
    block_tokens: int = BLOCK_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    tokens_col: str | None = None,
) -> DataFrame:
    """(id, source, shard, block, tokens) of the documents in the chosen blocks.

    The texts are read once, for their token counts; what is shuffled is an id, a source and a number per document.
    """
    docs_ = cut(units(docs, tokens_col))
    totals = docs_.groupBy("source").agg(F.sum("tokens").alias("total"))
    if weights is None:
        totals = totals.select("source", "total", F.sqrt(F.col("total").cast("double")).alias("weight"))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,double>")
        totals = totals.select("source", "total", F.coalesce(F.element_at(given, F.col("source")).cast("double"), F.lit(0.0)).alias("weight"))
    totals = small(totals)
    all_tokens = totals.agg(F.sum("total")).first()[0] or 0
    n_shards = max(1, -(-all_tokens // shard_tokens))
    shard = (F.conv(F.substring(_rank(F.lit("shard"), "id"), 1, 8), 16, 10).cast("bigint") % n_shards).cast("bigint")
    order = Window.partitionBy("shard", "source").orderBy(_rank(F.lit("order"), "id"), "id")
    before = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1))
    laid = docs_.withColumn("shard", shard).withColumn("block", F.floor(F.coalesce(before, F.lit(0)) / block_tokens).cast("bigint"))
    laid = cut(laid)
    # Blocks in which documents start, each with the blocks up to the next such one.
    pile = Window.partitionBy("shard", "source")
    there = laid.groupBy("shard", "source", "block").agg(F.sum("tokens").alias("n"))
    whole = F.greatest(F.ceil(F.sum("n").over(pile) / block_tokens), F.max("block").over(pile) + 1)
    there = there.withColumn("n_blocks", whole.cast("bigint"))
    there = there.withColumn("span", F.coalesce(F.lead("block").over(pile.orderBy("block")), F.col("n_blocks")) - F.col("block"))
    seeded = pile.orderBy(_rank(F.lit("block"), "shard", "source", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    there = there.withColumn("used", F.coalesce(F.sum("span").over(seeded), F.lit(0)))
    count = there.where("block = 0").select("shard", "source", "n_blocks")
    seats = count.groupBy("shard").agg(F.ceil(F.sum("n_blocks") * F.lit(float(fraction)) - 1e-9).cast("bigint").alias("n_seats"))
    count = count.join(totals.select("source", "weight"), "source").where("weight > 0")
    chosen = there.join(apportion(count, seats), ["shard", "source"]).where("2 * used + span <= 2 * quota").select("shard", "source", "block")
    return laid.join(chosen, ["shard", "source", "block"]).select("id", "source", "shard", "block", "tokens")


def mixture(docs: DataFrame, **params) -> DataFrame:
    """``doc_id``, ``source``, ``shard``, ``block`` and ``tokens`` of the chosen documents; no id stands for null."""
    kind = docs.schema["doc_id"].dataType
    out = selected(docs, **params)
    return out.select(F.when(F.col("id") != "", F.col("id")).cast(kind).alias("doc_id"), "source", "shard", "block", "tokens")


def mixed(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs``, all columns, whose document was chosen. One shuffle of the documents by id."""
    keys = selected(docs, **params).select(F.col("id").alias("__silt_id"), F.col("source").alias("__silt_source"))
    same = (F.coalesce(docs["doc_id"].cast("string"), F.lit("")) == keys["__silt_id"]) & (F.coalesce(docs["source"], F.lit("")) == keys["__silt_source"])
    return docs.join(keys, same, "left_semi")


ORACLE = f"""
WITH units AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, coalesce(source, '') AS source,
    sum(coalesce(len(regexp_extract_all(text, '{TOKEN}')), 0))::BIGINT AS tokens
  FROM documents GROUP BY 1, 2
), totals AS (
  SELECT source, sqrt(sum(tokens)::DOUBLE) AS weight FROM units GROUP BY source
), n AS (
  SELECT greatest(1, (coalesce(sum(tokens), 0)::BIGINT + {SHARD_TOKENS - 1}) // {SHARD_TOKENS}) AS shards FROM units
), sharded AS (
  SELECT id, source, tokens, ('0x' || substr(md5('{SEED}|shard|' || id), 1, 8))::BIGINT % shards AS shard FROM units, n
), laid AS (
  SELECT id, source, tokens, shard, (coalesce(sum(tokens) OVER (
    PARTITION BY shard, source ORDER BY md5('{SEED}|order|' || id), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {BLOCK_TOKENS})::BIGINT AS block
  FROM sharded
), there AS (
  SELECT shard, source, block, greatest(ceil(sum(sum(tokens)) OVER (PARTITION BY shard, source) / {BLOCK_TOKENS}), max(block) OVER (PARTITION BY shard, source) + 1)::BIGINT AS n_blocks
  FROM laid GROUP BY shard, source, block
), spans AS (
  SELECT *, coalesce(lead(block) OVER (PARTITION BY shard, source ORDER BY block), n_blocks) - block AS span FROM there
), picks AS (
  SELECT *, coalesce(sum(span) OVER (PARTITION BY shard, source ORDER BY md5('{SEED}|block|' || shard || '|' || source || '|' || block), block
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM spans
), counts AS (
  SELECT shard, source, n_blocks FROM there WHERE block = 0
), seats AS (
  SELECT shard, ceil(sum(n_blocks)::DOUBLE * {FRACTION}::DOUBLE - 1e-9) AS n_seats FROM counts GROUP BY shard
), quotients AS (
  SELECT shard, source, row_number() OVER (PARTITION BY shard ORDER BY weight / (2 * k + 1) DESC, source) AS seat
  FROM (SELECT shard, source, unnest(range(n_blocks)) AS k FROM counts) JOIN totals USING (source) WHERE weight > 0
), quotas AS (
  SELECT shard, source, count(*) AS quota FROM quotients JOIN seats USING (shard) WHERE seat <= n_seats GROUP BY 1, 2
)
SELECT CASE WHEN id <> '' THEN id::BIGINT END AS doc_id, source, shard, block, tokens
FROM laid JOIN picks USING (shard, source, block) JOIN quotas USING (shard, source) WHERE 2 * used + span <= 2 * quota
"""
