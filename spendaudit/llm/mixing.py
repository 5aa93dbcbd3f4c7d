"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source gets a word target: its weight's share of the requested total, at most
``max_repeats`` times its own size, what it cannot take shared again among the others.
The documents of a source are put in a keyed random order and read as a stream, again
from the start when the target exceeds the source; the stream's first ``target`` words
are the draw, cut into blocks.  A binary tree deals the blocks to the output shards: at
every node the blocks of each source that go left are drawn from the multivariate
hypergeometric distribution, so source quotas stay exact, shards are equal in blocks,
and each shard gets a random mixture.  A shard's blocks of a source are a range of the
source's permuted block numbers, hence disjoint, and the shard's documents are shuffled
locally.

Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FILE, ROW, cut, whole_text, with_locator

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)        # fixed values, repeating over the sources in code point order
SHARE = 1.5                # requested words over all words
MAX_REPEATS = 2
BLOCK_WORDS = 4096
LEVELS = 4                 # of the splitting tree: 16 shards
SEED = 42
BUCKETS = 4096             # slices of a source's random order, so a hot source is split
PRIME = 2147483647         # multiplier of the block permutation; coprime to every count


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Narrow rows: locator, id, source, words, and the keyed random order."""
    words = F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)),
                            F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    source = F.col(source_col).cast("string")
    return (with_locator(docs).select(
        F.col(id_col).alias("id"), FILE, ROW, source.alias("source"), words.alias("size"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("null")).alias("skey"), key.alias("key"))
        .withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int")))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
            max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) with rank, weight and word target.

    Filling all sources at one level per unit of weight and stopping each at its cap
    is what repeated resharing of the excess ends in; the level follows from running
    sums over the sources in the order in which they fill up.
    """
    by_source = Window.orderBy(F.col("source").isNull(), "source")   # one row per source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = (sizes.withColumn("rank", F.row_number().over(by_source)).withColumn("weight", w)
              .withColumn("cap", F.col("source_size").cast("double") * float(max_repeats))
              .withColumn("full_at", F.col("cap") / F.col("weight")))
    order = Window.orderBy("full_at", "rank")
    total = F.sum(F.col("source_size").cast("double")).over(Window.partitionBy()) * float(share)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)),
                        F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("level", (total - before) / rest)
    level = level.withColumn("capped", F.col("level") >= F.col("full_at"))
    # the level of the first source that does not fill up; those after it come out lower
    common = F.max(F.when(~F.col("capped"), F.col("level"))).over(Window.partitionBy())
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * common)
    return (level.withColumn("target", F.round(target, 6))
            .withColumn("quota", F.least(F.round("target").cast("long"),
                                         F.col("cap").cast("long")))
            .select("source", "skey", "source_size", "rank", "weight", "target", "quota"))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def hypergeometric(u: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """How many of ``drawn`` blocks, taken without replacement from ``total`` of which
    ``marked`` are of one source, are of that source: the distribution function inverted
    at the uniform ``u``.

    Probabilities relative to the mode's are summed outwards from the mode, first
    upwards, then downwards, until ``u`` of their sum is reached; beyond 14 standard
    deviations they vanish in double precision.
    """
    zero, empty = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def bounds(q: Column) -> Column:
        share = F.when(q["total"] > 0, q["marked"] / q["total"]).otherwise(0.0)
        spread = F.ceil(20 + 14 * F.sqrt(q["drawn"] * share * (1 - share))).cast("long")
        low = F.greatest(zero, q["drawn"] - (q["total"] - q["marked"]))
        high = F.least(q["drawn"], q["marked"])
        mode = F.floor((q["drawn"] + 1.0) * (q["marked"] + 1.0) / (q["total"] + 2.0)).cast("long")
        mode = F.greatest(low, F.least(high, mode))
        return F.struct(q["u"].alias("u"), q["total"].alias("total"), q["marked"].alias("marked"),
                        q["drawn"].alias("drawn"), mode.alias("m"),
                        F.least(high, mode + spread).alias("top"),
                        F.greatest(low, mode - spread).alias("bottom"))

    def draw(s: Column) -> Column:
        def above(x):   # P(x) / P(x - 1)
            return ((s["marked"] - x + 1.0) * (s["drawn"] - x + 1.0)
                    / (x * (s["total"] - s["marked"] - s["drawn"] + x * 1.0)))

        def below(x):   # P(x) / P(x + 1)
            return ((x + 1.0) * (s["total"] - s["marked"] - s["drawn"] + x + 1.0)
                    / ((s["marked"] - x * 1.0) * (s["drawn"] - x)))

        ups = F.when(s["m"] < s["top"], F.sequence(s["m"] + 1, s["top"])).otherwise(empty)
        downs = F.when(s["m"] > s["bottom"],
                       F.sequence(s["m"] - 1, s["bottom"])).otherwise(empty)

        def walk(xs, ratio, start, found, goal):
            """Running sum from ``start``, and the first x at which it reaches ``goal``."""
            def step(a, x):
                return _let(a["p"] * ratio(x), lambda p: F.struct(
                    p.alias("p"), (a["t"] + p).alias("t"),
                    F.when(a["h"].isNull() & (a["t"] + p >= goal), x)
                    .otherwise(a["h"]).alias("h")))
            return F.aggregate(xs, F.struct(F.lit(1.0).alias("p"), start.alias("t"),
                                            found.alias("h")), step)

        none = F.lit(None).cast("long")
        never = F.lit(float("inf"))
        all_up = walk(ups, above, F.lit(1.0), none, never)["t"]
        all_down = walk(downs, below, F.lit(0.0), none, never)["t"]
        return _let(s["u"] * (all_up + all_down), lambda goal: _let(
            walk(ups, above, F.lit(1.0), F.when(goal <= 1.0, s["m"]), goal),
            lambda got: F.coalesce(walk(downs, below, got["t"], got["h"], goal)["h"], s["m"])))

    given = F.struct(u.alias("u"), total.alias("total"), marked.alias("marked"), drawn.alias("drawn"))
    return _let(_let(given, bounds), draw)


def split_blocks(blocks: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """Blocks per (source rank, shard) from rows (rank, blocks): the splitting tree.

    Rows out: rank, shard, count, first (the shard's first permuted block of that source).
    A node is one row with its block count per source; its left child takes half of its
    blocks, drawn source by source.  The tree holds counts only: 2^levels rows of one
    number per source.
    """
    entry = F.struct(F.col("rank").cast("long").alias("rank"), F.col("blocks").alias("k"))
    nodes = blocks.agg(F.sort_array(F.collect_list(entry)).alias("counts")).withColumn(
        "shard", F.lit(0).cast("long"))
    left = _left_counts(seed)
    for level in range(levels):
        nodes = cut(nodes.withColumn("level", F.lit(level)).withColumn("left", left).withColumn(
            "right", F.zip_with("counts", "left", lambda c, l: F.struct(
                c["rank"].alias("rank"), (c["k"] - l["k"]).alias("k"))))
            .select(F.inline(F.array(
                F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("counts")),
                F.struct((F.col("shard") * 2 + 1).alias("shard"),
                         F.col("right").alias("counts"))))))
    dealt = nodes.select("shard", F.inline("counts")).withColumnRenamed("k", "count")
    upto = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("first", F.coalesce(F.sum("count").over(upto), F.lit(0)))


def _left_counts(seed: int) -> Column:
    """Counts that go left at a node, as an array like ``counts``: one multivariate
    hypergeometric draw, each source given those before it."""
    counts = F.col("counts")
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c["k"])
    start = F.struct(
        total.alias("total"), F.floor((total + F.col("shard") % 2) / 2).cast("long").alias("drawn"),
        F.array().cast("array<struct<rank:bigint,k:bigint>>").alias("left"))

    def one_source(acc, c):
        bits = F.shiftrightunsigned(
            F.xxhash64(F.lit(seed), F.col("level"), F.col("shard"), c["rank"]), 11)
        u = (bits + F.lit(0.5)) / F.lit(float(1 << 53))
        return _let(hypergeometric(u, acc["total"], c["k"], acc["drawn"]), lambda h: F.struct(
            (acc["total"] - c["k"]).alias("total"), (acc["drawn"] - h).alias("drawn"),
            F.concat(acc["left"], F.array(F.struct(c["rank"].alias("rank"), h.alias("k"))))
            .alias("left")))

    return F.aggregate(counts, start, one_source, lambda acc: acc["left"])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights=WEIGHTS, share: float = SHARE,
        max_repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS, levels: int = LEVELS,
        seed: int = SEED) -> DataFrame:
    """Every document with what the mix takes of it.

    Columns: id, size, source_size, target, taken (words, repeats counted), draws (array
    of pass, block, shard, words: one entry for each pass in which the document is
    reached) and the locator.  Per source the words taken equal its rounded target: the
    last document of a draw is taken in part when the target falls inside it.  NULL
    texts have no words; NULL is a source of its own, the last; sources without words
    and documents without words are taken 0 words; equal ids are ordered by size and
    place; an empty table gives an empty result.  Reruns agree.
    """
    rows = cut(sized(docs, id_col, text_col, source_col, seed))
    slices = cut(rows.groupBy("skey", "source", "bucket").agg(F.sum("size").alias("words")))
    sizes = slices.groupBy("skey", "source").agg(F.sum("words").alias("source_size"))
    goal = cut(targets(sizes, weights, share, max_repeats)
               .withColumn("blocks", F.expr(f"(quota + {block_words - 1}) div {block_words}")))
    dealt = split_blocks(goal.where("blocks > 0").select("rank", "blocks"), levels, seed)
    ends = dealt.groupBy("rank").agg(F.sort_array(F.collect_list(
        F.struct("shard", (F.col("first") + F.col("count")).alias("end")))).alias("ends"))
    goal = (goal.join(ends, "rank", "left")
            .withColumn("ends", F.transform("ends", lambda e: e["end"]))
            .drop("source", "weight"))
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    slices = (slices.withColumn("slice_start", F.coalesce(F.sum("words").over(before), F.lit(0)))
              .join(goal, "skey").drop("words", "source"))
    inside = (Window.partitionBy("skey", "bucket").orderBy("key", "id", "size", FILE, ROW)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = (rows.join(slices, ["skey", "bucket"])
              .withColumn("start", F.col("slice_start") + F.sum("size").over(inside)
                          - F.col("size")))
    return (placed.withColumn("draws", _draws(max_repeats, block_words, seed))
            .withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"),
                                             lambda a, d: a + d["words"]))
            .select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "draws",
                    FILE, ROW))


def _draws(max_repeats: int, block_words: int, seed: int) -> Column:
    """The passes that reach a document, with its block and the block's shard.  Block b
    of B is permuted to (b * PRIME + offset) mod B."""
    each = []
    for p in range(max_repeats):
        at = f"(start + {p} * source_size)"
        block = f"({at} div {block_words})"
        permuted = (f"pmod(({block} * ({PRIME} % blocks) + pmod(xxhash64({seed}, rank), blocks)),"
                    " blocks)")
        each.append(f"""IF(size > 0 AND {at} < quota, named_struct(
            'pass', {p}, 'block', {block},
            'shard', size(filter(ends, e -> e <= {permuted})),
            'words', least(size, quota - {at})), NULL)""")
    return F.expr(f"filter(array({', '.join(each)}), d -> d IS NOT NULL)")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", seed: int = SEED, **options) -> DataFrame:
    """The documents of the mix, all columns kept: one row for every pass that takes at
    least half of the document, none for the others.  Shards are contiguous ranges of the
    output partitions, and each shard is shuffled locally."""
    located = with_locator(docs)
    decided = mix(located, id_col, text_col, source_col, seed=seed, **options)
    drawn = (decided.select(FILE, ROW, "size", F.explode("draws").alias("d"))
             .where("d.words * 2 >= size")
             .select(FILE, ROW, F.col("d.shard").alias("__llm_shard"),
                     F.xxhash64(F.lit(seed), FILE, ROW, "d.pass").alias("__llm_slot")))
    rows = located.join(drawn, [FILE, ROW]).drop(FILE, ROW)
    return (rows.repartitionByRange("__llm_shard", "__llm_slot")
            .sortWithinPartitions("__llm_shard", "__llm_slot")
            .drop("__llm_shard", "__llm_slot"))
