"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets. The sources, by code point with null last, weigh ``weights`` in turn and share the words of the
whole table. No target exceeds ``max_repeat`` times its source; the excess goes to the others by weight.
The level at which that settles is found in closed form over the sources sorted by size over weight.

Draws. The documents of a source are permuted by hash into blocks, so a source with any share of the
rows is many blocks. A source draws each of its blocks ``floor(target / size)`` times and, in a last pass,
blocks in permuted order until the rest of its target is used up; of the block in which that happens it
draws documents in permuted order, to within half a document.

Tree. The root holds each source's quota of block draws. A node splits its quotas between two children of
equal capacity, source by source: the draws of a source that go left have a hypergeometric distribution, given the
places and draws that the sources before it have left over. Quotas of up to ``FEW_DRAWS`` are split draw by draw, each one going
left with probability (left places free) / (draws to come); larger ones by inversion from the mode outwards, in steps of the order of the
square root of the quota. A node keeps the sources that it has draws of. The leaves are
output shards with exact quotas; the shards of a source take consecutive, disjoint runs of its permuted draws,
and each shard is shuffled locally. A row for each source passes through one task (targets, root); documents, blocks and nodes never do.

Edge cases. A null text or a text of white space has no words: such a document is drawn with its block and
counts nothing. Null is a source of its own. Equal (id, text) rows share their draws. Without words all
targets are 0. An empty table gives an empty result. ``mix`` keeps the input's columns, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.functions.text import let
from tarn.llm.common import col, materialize, text_or_empty

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 20240607
#: Documents a block should hold, the most blocks of a source (they hold more documents beyond), and words a shard should hold.
BLOCK_DOCS, MAX_BLOCKS, SHARD_WORDS = 256, 1 << 20, 4_000_000
#: Draws of a source up to which they are split one by one.
FEW_DRAWS = 512
#: Rows up to which a table (of about 100 bytes a row) is broadcast.
BROADCAST_ROWS = 50_000


def n_words(text: str | Column) -> Column:
    """Maximal runs of characters other than space and U+0009 to U+000D; null has none."""
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _dealt(id_col: str, text_col: str) -> list[Column]:
    """Two independent hashes: the block a document falls into and its place in the block."""
    text_hash = F.xxhash64(text_or_empty(text_col))
    return [F.xxhash64(F.lit(SEED + i), col(id_col), text_hash).alias(name) for i, name in enumerate(("__deal", "__place"))]


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, rank, docs, source_size, target, blocks) from rows of (source, size); a row for each source."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    sources = sources.withColumn("rank", F.row_number().over(by_name) - 1).select(
        "*",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1).alias("weight"),
        F.sum("source_size").over(everything).cast("double").alias("total"),
        (F.col("source_size") * float(max_repeat)).alias("cap"),
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    sources = sources.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    settled = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct((F.col("cap") / F.col("weight")).alias("o"), "rank", "level"))).over(everything)
    return sources.select(
        "source", "rank", "docs", "source_size",
        F.least("cap", F.coalesce(settled["level"] * F.col("weight"), F.col("cap"))).alias("target"),
        F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("docs") / BLOCK_DOCS))).cast("long").alias("blocks"),
    )


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if its rows are counted to be few, else left to the planner."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _log_factorial(n: Column) -> Column:
    """Of a long: a table of the first ten, Stirling's series beyond (its error is below 1e-10)."""
    x = n.cast("double")
    series = x * F.log(x) - x + F.log(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 10, F.get(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(10)]), n.cast("int"))).otherwise(series)


def _inverted(u: Column, quota: Column, places: Column, draws: Column) -> Column:
    """How many of ``quota`` among ``draws`` fall into ``places``, for u uniform in [0, 1): outcomes are tried from the mode outwards."""
    mode = F.floor((quota + 1).cast("double") * (places + 1) / (draws + 2)).cast("long")
    spread = F.sqrt(quota.cast("double") * (draws - quota) * places * (draws - places) / (draws.cast("double") * draws * F.greatest(draws - 1, F.lit(1))))
    given = F.struct(
        u.alias("u"), quota.alias("q"), places.alias("p"), (draws - quota - places).alias("r"), draws.alias("d"), (F.ceil(10 * spread) + 16).cast("long").alias("steps"),
        F.greatest(F.lit(0).cast("long"), quota + places - draws, F.least(mode, quota, places)).alias("m"),
    )

    def walk(g: Column) -> Column:
        f = _log_factorial
        q, p, r, d, m = (g[x] for x in "qprdm")
        top = F.exp(f(q) - f(m) - f(q - m) + f(d - q) - f(p - m) - f(r + m) - f(d) + f(p) + f(d - p))

        def step(a: Column, k: Column) -> Column:
            x, y = m + k - 1, m - k + 1
            up = a["up"] * ((q - x).cast("double") * (p - x)) / ((x + 1).cast("double") * (r + x + 1))
            down = a["down"] * (y.cast("double") * (r + y)) / ((q - y + 1).cast("double") * (p - y + 1))
            both = F.struct(up.alias("up"), down.alias("down"))
            took = lambda b: F.when(a["took"].isNotNull(), a["took"]).when(a["rest"] < b["up"], m + k).when(a["rest"] < b["up"] + b["down"], m - k)
            return let(both, lambda b: F.struct((a["rest"] - b["up"] - b["down"]).alias("rest"), b["up"].alias("up"), b["down"].alias("down"), took(b).alias("took")))

        begun = let(top, lambda t: F.struct((g["u"] - t).alias("rest"), t.alias("up"), t.alias("down"), F.when(g["u"] < t, m).alias("took")))
        return F.coalesce(F.aggregate(F.sequence(F.lit(1).cast("long"), g["steps"]), begun, step, lambda a: a["took"]), m)

    return let(given, walk)


def _split(nodes: DataFrame) -> DataFrame:
    """(node, quotas array<struct<i, q>>) to its two children; quotas: draws of each source by rank."""
    zero = F.lit(0).cast("long")
    hash_ = lambda i, j: F.xxhash64(F.lit(SEED), F.col("node"), i, j)
    total = F.aggregate(F.transform("quotas", lambda e: e["q"]), zero, lambda a, q: a + q)
    start = let(total, lambda n: F.struct(zero.alias("left"), F.floor(n / 2).cast("long").alias("places"), n.alias("draws")))

    def draw(a: Column, i: Column, j: Column) -> Column:
        took = (F.pmod(hash_(i, j), a["draws"]) < a["places"]).cast("long")
        return F.struct((a["left"] + took).alias("left"), (a["places"] - took).alias("places"), (a["draws"] - 1).alias("draws"))

    def source(a: Column, entry: Column) -> Column:
        state, q = a["state"], entry["q"]
        begun = F.struct(zero.alias("left"), state["places"].alias("places"), state["draws"].alias("draws"))
        one_by_one = F.aggregate(F.sequence(F.lit(1).cast("long"), q), begun, lambda b, j: draw(b, entry["i"], j), lambda b: b["left"])
        u = F.call_function("shiftrightunsigned", hash_(entry["i"], zero), F.lit(11)).cast("double") * 2.0**-53
        took = F.when(q <= FEW_DRAWS, one_by_one).otherwise(_inverted(u, q, state["places"], state["draws"]))
        after = lambda x: F.struct(x.alias("left"), (state["places"] - x).alias("places"), (state["draws"] - q).alias("draws"))
        return let(took, lambda x: F.struct(after(x).alias("state"), F.concat(a["out"], F.array(F.struct(entry["i"].alias("i"), x.alias("x"), (q - x).alias("y")))).alias("out")))

    empty = F.array().cast("array<struct<i:int,x:bigint,y:bigint>>")
    cut = F.aggregate("quotas", F.struct(start.alias("state"), empty.alias("out")), source, lambda a: a["out"])
    side = lambda name: F.transform(F.filter("cut", lambda e: e[name] > 0), lambda e: F.struct(e["i"].alias("i"), e[name].alias("q")))
    children = F.array(F.struct((F.col("node") * 2).alias("node"), side("x").alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), side("y").alias("quotas")))
    return nodes.select("node", cut.alias("cut")).select(F.explode(children).alias("c")).select("c.node", "c.quotas")


def shard_quotas(quotas: DataFrame, levels: int) -> DataFrame:
    """(shard, rank, quota) of quotas above 0 for 2**levels shards, from one row of (quotas array<struct<i:int, q:long>>)."""
    nodes = quotas.select(F.lit(0).cast("long").alias("node"), F.filter("quotas", lambda e: e["q"] > 0).alias("quotas"))
    for level in range(levels):
        nodes = _split(nodes)
        if level >= 5:
            nodes = nodes.repartition("node")  # a wide level is worth more than one task
    return nodes.select(F.col("node").alias("shard"), F.explode("quotas").alias("e")).select("shard", F.col("e.i").alias("rank"), F.col("e.q").alias("quota"))


def mixing_plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights=WEIGHTS, max_repeat=MAX_REPEAT, shard_words=SHARD_WORDS):
    """The sized documents, the sources, the draws of each block and the number of shards.

    sized: (id, source, size, deal, place). sources: (source, rank, source_size, target, blocks, whole, last_block, last_place):
    a document of block b is drawn ``whole`` times, and once more if b < last_block or b = last_block and place <= last_place.
    draws: (rank, block, copies array<struct<pass, shard>>).
    """
    sized = materialize(docs.select(col(id_col).alias("id"), col(source_col).alias("source"), n_words(text_col).alias("size"), *_dealt(id_col, text_col)), "sized")
    sources = materialize(source_targets(sized, weights, max_repeat), "sources")
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(max_repeat), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    placed = sized.join(_small(sources), sized.source.eqNullSafe(sources.source)).select("rank", "rest", F.pmod("__deal", "blocks").alias("block"), "__place", "size")
    per_block = placed.groupBy("rank", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    in_order = Window.partitionBy("rank").orderBy("block")
    per_block = materialize(per_block.withColumn("before", F.sum("words").over(in_order) - F.col("words")), "blocks")
    last = per_block.filter("before < rest and before + words > rest").select("rank", F.col("block").alias("last_block"), (F.col("rest") - F.col("before")).alias("left"))
    cut = placed.join(_small(last), (placed.rank == last.rank) & (placed.block == last.last_block)).groupBy(placed.rank, "last_block", "left", "__place").agg(F.sum("size").alias("words"))
    run = F.sum("words").over(Window.partitionBy("rank").orderBy("__place"))
    cut = cut.withColumn("mid", run - F.col("words") / 2).groupBy("rank", "last_block").agg(F.max(F.when(F.col("mid") <= F.col("left"), F.col("__place"))).alias("last_place"))
    #: Without a block that is cut, all blocks before the first that isn't needed are drawn.
    drawn = per_block.groupBy("rank").agg(F.max(F.when(F.col("before") < F.col("rest"), F.col("block") + 1)).alias("needed"))
    sources = sources.join(cut, "rank", "left").join(drawn, "rank", "left").withColumn("needed", F.coalesce("needed", F.lit(0).cast("long")))
    sources = materialize(sources.withColumn("last_block", F.coalesce("last_block", "needed")), "plan")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    levels = max(0, int(total // shard_words)).bit_length()
    in_all = sources.select("rank", (F.col("whole") * F.col("blocks") + F.col("needed")).alias("quota"))
    root = in_all.agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("i"), F.col("quota").alias("q")))).alias("quotas"))  # a number for each source
    shards = shard_quotas(root, levels)
    runs = shards.withColumn("end", F.sum("quota").over(Window.partitionBy("rank").orderBy("shard")))
    each = runs.select("rank", "shard", F.explode(F.sequence(F.col("end") - F.col("quota"), F.col("end") - 1)).alias("draw"))
    each = each.join(_small(sources.select("rank", "blocks")), "rank").select("rank", "shard", F.floor(F.col("draw") / F.col("blocks")).alias("pass"), (F.col("draw") % F.col("blocks")).alias("block"))
    draws = each.groupBy("rank", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("copies"))  # max_repeat + 1 at most
    return sized, sources, materialize(draws, "draws"), 2**levels


def _copies(whole: str = "whole") -> Column:
    """The draws that take the document."""
    extra = (F.col("block") < F.col("last_block")) | ((F.col("block") == F.col("last_block")) & (F.col("__place") <= F.coalesce("last_place", F.lit(-(2**63)))))
    return F.filter("copies", lambda c: (c["pass"] < F.col(whole)) | extra)


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(id, size, source_size, target, copies array<struct<pass, shard>>, taken): a row for each input row."""
    sized, sources, draws, _ = mixing_plan(docs, id_col, text_col, source_col, **options)
    keyed = sized.join(_small(sources), sized.source.eqNullSafe(sources.source)).drop("source").withColumn("block", F.pmod("__deal", "blocks"))
    taken = keyed.join(draws, ["rank", "block"], "left").withColumn("copies", F.coalesce(_copies(), F.array().cast("array<struct<pass:bigint,shard:bigint>>")))
    return taken.select("id", "size", "source_size", "target", "copies", (F.col("size") * F.size("copies")).cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: the input's columns, a row for each draw, dealt into shards (partitions) and shuffled within each."""
    _, sources, draws, shards = mixing_plan(docs, id_col, text_col, source_col, **options)
    row = F.struct(*[col(c) for c in docs.columns]).alias("__row")
    keyed = docs.select(row, col(source_col).alias("__source"), *_dealt(id_col, text_col))
    plan = _small(sources.select(F.col("source").alias("__of"), "rank", "blocks", "whole", "last_block", "last_place"))
    keyed = keyed.join(plan, F.col("__source").eqNullSafe(F.col("__of"))).withColumn("block", F.pmod("__deal", "blocks"))
    drawn = keyed.join(_small(draws), ["rank", "block"]).select("__row", "__place", F.explode(_copies()).alias("c"))
    order = F.xxhash64(F.lit(SEED + 2), F.col("__place"), F.col("c.pass"))
    return drawn.select("__row", F.col("c.shard").cast("int").alias("__shard"), order.alias("__order")).repartition(shards, "__shard").sortWithinPartitions("__shard", "__order").select("__row.*")
