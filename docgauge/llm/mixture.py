"""A mixture of sources near target weights, on a low-discrepancy schedule.

Each source's documents are shuffled and laid end to end in a circle, which is
unrolled as often as the source may be repeated and cut into blocks of equal
tokens.  Slot i of the mixture has the point i times the golden ratio; the
point falls into the stretch of one source on a line divided by weight.  The
rank of the slot among those of its source names the block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgauge.llm.stable_sample import TURN, position
from docgauge.session import cut

#: Tokens of a block.
BLOCK = 1024
#: Buckets of a source's shuffled documents; offsets are summed over buckets.
BUCKET_BITS = 12
#: Slots that are ranked in one piece.
PIECE_SLOTS = 1 << 20


@dataclass(frozen=True)
class Share:
    """A source's part of the mixture."""

    source: str
    target: float
    max_repeats: int
    #: Tokens of the source's documents, and tokens planned of it.
    tokens: int
    planned: int
    blocks: int


def allot(targets: list[tuple[str, float, int]], tokens: dict[str, int], *, block: int = BLOCK, total: int | None = None) -> list[Share]:
    """Tokens of each source: the target share of ``total``, as far as repeats allow.

    A source gives at most its tokens times ``max_repeats``; a short one gives
    exactly that, the others whole blocks.  What a short source cannot fill
    goes to the others in proportion to their targets.  ``total`` is by default
    all tokens of the listed sources.  Targets need not sum to one; null or
    negative ones, and null or negative repeats, count as 0.
    """
    most = {s: tokens.get(s, 0) * max(0, r or 0) for s, _, r in targets}
    wanted = {s: max(0.0, t or 0.0) for s, t, _ in targets}
    left = float(sum(tokens.get(s, 0) for s, _, _ in targets) if total is None else total)
    planned = dict.fromkeys(wanted, 0)
    free = {s for s in wanted if wanted[s] > 0 and most[s] > 0}
    while free and left > 0:
        unit = left / sum(wanted[s] for s in free)
        short = {s for s in free if most[s] <= unit * wanted[s]}
        for s in short or free:
            planned[s] = most[s] if short else min(most[s], block * round(unit * wanted[s] / block))
            left -= planned[s]
        free = free - short if short else set()
    return [Share(s, t or 0.0, r or 0, tokens.get(s, 0), planned[s], -(-planned[s] // block)) for s, t, r in targets]


def blocks_of(sizes: DataFrame, shares: list[Share], *, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """(source, block, repeat_no, doc_id, token_from, tokens): what each planned block holds.

    ``sizes`` has doc_id, source, tokens.  Documents are in the order of a
    seeded hash; one that crosses a block's end continues in the next block,
    and after the last document the first one follows, as repeat 1.  So every
    block holds exactly ``block`` tokens, but for the last one of a source that
    gives all it may.  Repeated rows are documents of their own; null and
    non-positive sizes are left out.  No task sums over a source: only over
    one of its buckets, and over buckets.
    """
    live = [s for s in shares if s.planned > 0]
    rounds = sizes.sparkSession.createDataFrame([(s.source, s.tokens, s.planned) for s in live], "source string, circle long, planned long")
    spot = F.xxhash64(F.lit(seed), "doc_id")
    # as many rows as the plan has sources
    used = sizes.where(F.col("tokens") > 0).select("doc_id", "source", "tokens").join(F.broadcast(rounds), "source")
    placed = used.withColumn("spot", spot).withColumn("bucket", F.shiftrightunsigned("spot", 64 - BUCKET_BITS))
    inside = Window.partitionBy("source", "bucket").orderBy("spot", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    reached = placed.withColumn("reached", F.sum("tokens").over(inside))
    buckets = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("weight"))
    before = Window.partitionBy("source").orderBy("bucket")
    buckets = buckets.select("source", "bucket", (F.sum("weight").over(before) - F.col("weight")).alias("offset"))
    laid = reached.join(buckets, ["source", "bucket"]).withColumn("at", F.col("offset") + F.col("reached") - F.col("tokens"))
    again = F.sequence(F.lit(0).cast("long"), F.expr("(planned - 1) div circle"))
    unrolled = laid.select("source", "doc_id", "planned", "circle", "at", "tokens", F.explode(again).alias("repeat_no"))
    begin = F.col("repeat_no") * F.col("circle") + F.col("at")
    unrolled = unrolled.select("source", "doc_id", "repeat_no", begin.alias("begin"), F.least(begin + F.col("tokens"), "planned").alias("end")).where(F.col("begin") < F.col("end"))
    numbers = F.sequence(F.expr(f"begin div {block}"), F.expr(f"(end - 1) div {block}"))
    spans = unrolled.select("source", "doc_id", "repeat_no", "begin", "end", F.explode(numbers).alias("block"))
    first = F.greatest("begin", F.col("block") * block)
    last = F.least("end", (F.col("block") + 1) * block)
    return spans.select("source", "block", F.col("repeat_no").cast("int").alias("repeat_no"), "doc_id", (first - F.col("begin")).alias("token_from"), (last - first).alias("tokens"))


def _by_source(live: list[Share], bounds: list[int], value: list[Column]) -> Column:
    chosen = value[-1]
    for bound, v in reversed(list(zip(bounds, value))[:-1]):
        chosen = F.when(F.col("point") < F.lit(bound), v).otherwise(chosen)
    return chosen


def schedule(spark: SparkSession, shares: list[Share]) -> DataFrame:
    """(slot, source, block): every planned block once, in one slot each.

    The points leave a source a few slots short or over, by the discrepancy of
    the golden ratio: at most about 2 + 4 ln(slots) a source.  Slots over go to
    the blocks that have none.
    """
    live = [s for s in shares if s.blocks > 0]
    total = sum(s.blocks for s in live)
    if not live:
        return spark.createDataFrame([], "slot long, source string, block long")
    edge, bounds = 0, []
    for s in live:
        edge += s.blocks
        bounds.append(edge * TURN // total)
    slots = spark.range(total).select(F.col("id").alias("slot"), position(F.col("id")).alias("point"), F.expr(f"id div {PIECE_SLOTS}").alias("piece"))
    slots = slots.select("slot", "piece", _by_source(live, bounds, [F.lit(s.source) for s in live]).alias("source"), _by_source(live, bounds, [F.lit(s.blocks) for s in live]).alias("blocks"))
    counts = cut(slots.groupBy("source", "piece").agg(F.count(F.lit(1)).alias("n")))
    offsets = counts.select("source", "piece", (F.sum("n").over(Window.partitionBy("source").orderBy("piece")) - F.col("n")).alias("offset"))
    rank = F.col("offset") + F.row_number().over(Window.partitionBy("source", "piece").orderBy("slot")) - 1
    ranked = slots.join(offsets, ["source", "piece"]).withColumn("block", rank)
    have = {r["source"]: r["n"] for r in counts.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    short = [(s.source, k) for s in live for k in range(have.get(s.source, 0), s.blocks)]
    kept = ranked.where(F.col("block") < F.col("blocks")).select("slot", "source", "block")
    if not short:
        return kept
    over = ranked.where(F.col("block") >= F.col("blocks")).select("slot", (F.row_number().over(Window.orderBy("slot")) - 1).alias("k"))
    missing = spark.createDataFrame([(i, *x) for i, x in enumerate(short)], "k int, source string, block long")
    return kept.unionByName(over.join(F.broadcast(missing), "k").select("slot", "source", "block"))


def mixture(sizes: DataFrame, shares: list[Share], *, block: int = BLOCK) -> DataFrame:
    """(slot, source, repeat_no, block, doc_id, token_from, tokens) of the whole mixture.

    An empty table, or one without listed sources, gives no rows.
    """
    held = blocks_of(sizes, shares, block=block)
    return schedule(sizes.sparkSession, shares).join(held, ["source", "block"]).select("slot", "source", "repeat_no", "block", "doc_id", "token_from", "tokens")
