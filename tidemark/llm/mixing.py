"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents fall into at most BLOCKS blocks by hash. Its target is met by whole passes over all blocks and
one part of a pass: blocks in a permuted order, the last one in part. These block quotas are exact. A tree over the
output shards splits them: each node draws its left half's quotas from the multivariate hypergeometric distribution,
so every shard gets disjoint runs of each source's permuted blocks, and shards differ by one draw at most within a
group of sources. Rows are shuffled inside their shard. All steps but the tree are SQL expressions; the tree works
on groups of sources of bounded size. How many shards there are follows from the words of the mix; which shard a draw
goes to changes no sum, as every quota is exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common as C

BLOCKS, SEED = 1024, 11
#: Shards at least and at most, words of the mix that one aims at, and cells (sources x shards) of one tree.
FEW, MANY, SHARD_WORDS, CELLS = 16, 4096, 20_000_000, 1 << 22
WORD = r"[^\\x20\\x09-\\x0D]+"


def _hash(text: str) -> str:
    """60 bits of an md5, the same in any SQL engine."""
    return f"cast(conv(substr(md5({text}), 1, 15), 16, 10) as bigint)"


def waterfill(sources: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """target of each source: shares by weight of `share` times all words, none above `most` times its own.

    Sources stand in code-point order, null last, and take the weights in turn. The table has one row per source.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", turn).withColumn("cap", most * F.col("source_size"))
    everything = W.partitionBy()
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    s = s.select(
        "*",
        (share * F.sum("source_size").over(everything)).alias("budget"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("caps"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weights"),
    )
    s = s.withColumn("level", (F.col("budget") - F.col("caps")) / (F.col("all_weight") - F.col("weights")))
    s = s.withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level")).withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
    return s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("level") * F.col("weight"))).select("source", "source_size", "n_docs", "target")


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Draws of each source in each shard (sources x shards): exact sums both ways, by recursive halving."""
    out = np.zeros((len(quotas), shards), np.int64)

    def split(q, low, high, draws):
        if high - low == 1:
            out[:, low] = q
            return
        mid = (low + high) // 2
        left = draws[low:mid].sum()
        taken = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(q, int(left), method="marginals") if len(q) > 1 else np.array([left])
        split(taken, low, mid, draws)
        split(q - taken, mid, high, draws)

    total = int(quotas.sum())
    draws = np.full(shards, total // shards) + (np.arange(shards) < total % shards)
    split(quotas.astype(np.int64), 0, shards, draws)
    return out


def shards_of(sources: DataFrame) -> int:
    """A power of two that follows the words of the mix."""
    words = sources.agg(F.sum("target")).first()[0] or 0
    return min(MANY, max(FEW, 1 << max(0, int(words) // SHARD_WORDS).bit_length()))


def mix_plan(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """One row per (source, block): source_size, target, and what each document of the block gives.

    passes: whole draws; part: the share of the last draw, 0 if there is none; draws: the shard of each draw.
    """
    sized = docs.select("source", "doc_id", F.expr(f"coalesce(regexp_count(text, '{WORD}'), 0)").cast("long").alias("size"))
    sources = waterfill(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), weights, share, most)
    sources = C.materialize(sources.withColumn("blocks", F.least(F.lit(BLOCKS), "n_docs")), "sources")
    same = F.col("d.source").eqNullSafe(F.col("s.source"))
    key = _hash("concat_ws('#', 'block', cast(doc_id as string))")
    # documents are counted into the finest blocks first, and these are joined with their source's number of blocks
    fine = sized.groupBy("source", F.expr(f"{key} % {BLOCKS * 720}").alias("fine")).agg(F.sum("size").alias("words"))
    small = sources.limit(100_001).count() <= 100_000
    blocks = fine.alias("d").join(F.broadcast(sources.alias("s")) if small else sources.alias("s"), same).select("s.*", F.expr("fine % blocks").alias("block"), "words").groupBy("source", "source_size", "target", "blocks", "block").agg(F.sum("words").alias("words"))
    # the permuted order within a source: at most BLOCKS rows
    order = W.partitionBy("source").orderBy(F.expr(_hash(f"concat_ws('#', 'order', '{seed}', coalesce(source, ''), cast(block as string))")), "block")
    blocks = blocks.withColumn("place", F.row_number().over(order) - 1).withColumn("before", F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    blocks = blocks.withColumn("passes", F.expr("case when source_size > 0 then cast(floor(target / source_size) as int) else 0 end"))
    blocks = blocks.withColumn("part", F.expr("case when words > 0 then greatest(0D, least(1D, (target - passes * source_size - before) / words)) else 0D end"))
    blocks = C.materialize(blocks, "blocks")

    quotas = blocks.groupBy("source").agg(F.sum(F.col("passes") + (F.col("part") > 0).cast("int")).alias("quota"))
    shards = shards or shards_of(sources)
    groups = max(1, -(-sources.count() * shards // CELLS))

    def tree(key, pdf):
        pdf = pdf.sort_values("source", na_position="last", ignore_index=True)
        cuts = np.concatenate([np.zeros((len(pdf), 1), np.int64), split_quotas(pdf["quota"].to_numpy(), shards, seed + 1000 * int(key[0])).cumsum(1)], axis=1)
        return pd.DataFrame({"source": pdf["source"], "cuts": list(cuts)})

    cuts = quotas.withColumn("g", F.pmod(F.xxhash64("source"), F.lit(groups))).groupBy("g").applyInPandas(tree, "source string, cuts array<long>")
    drawn = blocks.alias("d").join(cuts.alias("s"), same).select("d.*", "s.cuts")
    # blocks without a partial draw still count in a whole pass: draw i of a block has number i * (blocks in use) + place
    in_use = W.partitionBy("source")
    drawn = drawn.withColumn("in_use", F.count(F.lit(1)).over(in_use))
    return drawn.selectExpr(
        "source", "source_size", "target", "blocks", "block", "passes", "part",
        "case when passes + int(part > 0) = 0 then array() else transform(sequence(1, passes + int(part > 0)), i -> int(size(filter(cuts, c -> c <= (i - 1) * in_use + place)) - 1)) end as draws",
    )


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_draws, draws, words: one row per input row.

    size counts runs of bytes other than ASCII white space (null: 0). draws has the shard of each draw of the
    document's block and words what the shard takes from the document: its size, or in the draw that ends the source's
    target a part of it, rounded by a hash of doc_id so that sums stay near. taken is their sum.
    Sources of no words have target 0. Rows that repeat a doc_id are drawn alike. An empty table gives an empty result.
    """
    plan = C.materialize(mix_plan(docs, **how), "plan")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.expr(f"coalesce(regexp_count(text, '{WORD}'), 0)").cast("long").alias("size"))
    drawn = _with_plan(rows, plan).withColumn("words", F.expr(_words("size")))
    return drawn.selectExpr("doc_id", "size", "source_size", "target", "aggregate(words, 0L, (a, w) -> a + w) as taken", "size(draws) as n_draws", "draws", "words")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    small = plan.limit(200_001).count() <= 200_000
    key = _hash("concat_ws('#', 'block', cast(doc_id as string))")
    rows = rows.withColumn("_fine", F.expr(f"{key} % {BLOCKS * 720}"))
    # a source's number of blocks stands in each of its plan rows; the finest block of a row leads to it
    kinds = plan.select(F.col("source").alias("_s"), F.col("blocks").alias("_n")).distinct()
    few = small or kinds.limit(100_001).count() <= 100_000
    rows = rows.join(F.broadcast(kinds) if few else kinds, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_block", F.expr("_fine % _n"))
    p = plan.withColumnRenamed("source", "_source").drop("blocks")
    return rows.join(F.broadcast(p) if small else p, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_block") == F.col("block"))).drop("_s", "_n", "_fine", "_block", "_source", "block")


def _words(size: str) -> str:
    """What each draw takes from a document; the last draw may be in part."""
    u = f"({_hash("concat_ws('#', 'part', cast(doc_id as string))")} / 1152921504606846976D)"
    return f"transform(draws, (s, i) -> case when part > 0 and i = size(draws) - 1 then cast(floor(part * {size} + {u}) as bigint) else {size} end)"


def mix_documents(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """Rows of `docs`, each as often as it is drawn, in shards, shuffled inside each.

    A document of a partial block is drawn whole with that part as its chance, by a hash of its doc_id. Documents of
    sources without words are not drawn. Nulls and repeats as in mix_sources.
    """
    plan = C.materialize(mix_plan(docs, seed=seed, **how), "plan")
    name = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*name.values()).withColumn("doc_id", F.col(name["doc_id"])).withColumn("source", F.col(name["source"]))
    u = f"({_hash("concat_ws('#', 'part', cast(doc_id as string))")} / 1152921504606846976D)"
    drawn = _with_plan(rows, plan).withColumn("_draws", F.expr(f"case when part > 0 and {u} >= part then slice(draws, 1, size(draws) - 1) else draws end"))
    rows = drawn.select(*name.values(), "doc_id", F.posexplode("_draws").alias("_draw", "_shard"))
    # a shard is dealt to as many tasks as its words ask for
    sums = plan.groupBy("source").agg(F.max("target").alias("target"))
    shards, words = how.get("shards") or shards_of(sums), sums.agg(F.sum("target")).first()[0] or 0
    deals = max(1, 128 // shards, -(-int(words) // (shards * SHARD_WORDS)))
    rows = rows.repartition("_shard", F.pmod(F.xxhash64("doc_id"), F.lit(deals))).sortWithinPartitions("_shard", F.xxhash64(F.lit(seed), "doc_id", "_draw"))
    return rows.select(*name.values()).toDF(*docs.columns)


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "n_draws")


_MD5 = "('0x' || substr(md5({}), 1, 15))::bigint"
ORACLE = f"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
    {_MD5.format("'block#' || coalesce(doc_id::varchar, '')")} % {BLOCKS * 720} as fine,
    {_MD5.format("'part#' || coalesce(doc_id::varchar, '')")} / 1152921504606846976::double as u
  from documents),
per_source as (
  select source, sum(size)::bigint as source_size, least({BLOCKS}, count(*)) as blocks,
    [5.0::double, 2, 1][1 + (row_number() over (order by source is null, source) - 1) % 3] as weight
  from sized group by source),
leveled as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(2.0::double * source_size) over before, 0))
    / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level
  from per_source
  window before as (order by 2.0::double * source_size / weight, source is null, source rows between unbounded preceding and 1 preceding)),
targets as (
  select source, source_size, blocks, case when 2.0::double * source_size / weight <= level then 2.0::double * source_size
    else max(case when not 2.0::double * source_size / weight <= level then level end) over () * weight end as target
  from leveled),
placed as (
  select d.doc_id, d.size, d.u, d.fine % t.blocks as block, t.* from sized d join targets t on d.source is not distinct from t.source),
blocks as (
  select source, source_size, target, block, sum(size)::bigint as words from placed group by all),
ordered as (
  select *, coalesce(sum(words) over (partition by source order by {_MD5.format(f"'order#{SEED}#' || coalesce(source, '') || '#' || block::varchar")}, block
    rows between unbounded preceding and 1 preceding), 0) as before,
    case when source_size > 0 then floor(target / source_size)::int else 0 end as passes
  from blocks),
parts as (
  select *, case when words > 0 then greatest(0::double, least(1::double, (target - passes * source_size - before) / words)) else 0 end as part from ordered)
select p.doc_id, p.size, p.source_size, p.target,
  (b.passes * p.size + case when b.part > 0 then floor(b.part * p.size + p.u) else 0 end)::bigint as taken,
  (b.passes + (b.part > 0)::int)::int as n_draws
from placed p join parts b on p.source is not distinct from b.source and p.block = b.block
"""
