"""Mixing of sources to target weights, in DataFrame operations alone.

Targets: sources in order of code points, null last, weigh ``weights`` in turn and share all words of the
corpus; a target stops at ``most_epochs`` times its source's words and what is over goes to the others by
weight, until none is above. That is the one level L with ``sum(min(cap, weight * L)) = words``; sources that stop
are a prefix of the order by cap / weight, so a running sum finds it.

Blocks: a source's documents are dealt by hash to blocks of about ``block_docs`` documents. Every block is taken ``floor(target / words)`` times whole, turn by turn,
and in one more turn those at the front until the rest is reached. Each turn has the blocks in an order of its own, an affine permutation of their numbers, so a block's place
needs no sort. Where the rest is reached follows from sums over runs of ``run_blocks`` blocks, then over the blocks of one run. Of the block where it is reached, documents are taken in hash
order as far as they fit, and one more if that comes nearer; so a source misses its target by less than its smallest document that is left out there.

Shards: the block copies that a source gives go to ``2^levels`` output shards of about ``shard_words`` words. Their counts by source are split down a binary tree: at
a node, the left half's counts of the sources are drawn from the multivariate hypergeometric distribution, which is what
dealing a shuffled deck would give; all counts stay exact. A leaf draws its count of a source's copies as a range of the permuted blocks, disjoint from
any other leaf's. Documents are taken through the leaves that draw their blocks: ``placed`` has the shard of each copy, and ``taken`` counts what is placed. A shard is shuffled by a hash key
(``shuffle_key``); ``mix_documents`` writes the rows shard by shard in that order.

The draws, the order and the keys are hashes of the seed and the rows, so reruns agree. Only tables of sources, runs, blocks
and tree nodes are grouped or sorted; documents meet them by key. A source with a third of all rows has as many more blocks, and leaves are met in chunks of positions, so no key is hot.

Rows: null or empty text has no words: it is taken like others and adds none; a null source is a source of its own; equal rows are equal
in hash and are taken alike (several as one in the block where the rest is reached); an empty table gives no rows; a source without words has target 0 and is taken 0 times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportmill.llm import _common as c

_UNIT = 2.0**-53


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(c.WORD_CLASS + "+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most_epochs: int) -> DataFrame:
    """(source, source_size, docs, target) from one row per document (source, size)."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    ranked = by.select("*", weight.alias("weight"), (F.col("source_size") * float(most_epochs)).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    # The level is that of the first source that doesn't stop; all before it stop at their caps.
    found = ranked.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    found = found.withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"])
    return found.select("source", "source_size", "docs", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _draw(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """A hypergeometric draw by inversion, as one expression over longs ``total``, ``marked``, ``drawn`` and a double ``u`` in [0, 1)."""
    low, high = F.greatest(F.lit(0), drawn + marked - total), F.least(marked, drawn)
    mode = F.least(F.greatest(F.floor((drawn + 1) * (marked + 1) / (total + 2)), low), high)
    share = marked / F.greatest(total, F.lit(1))
    reach = (F.ceil(12 * F.sqrt(F.greatest(drawn * share * (1 - share), F.lit(0.0)))) + 12).cast("long")
    first, last = F.greatest(low, mode - reach), F.least(high, mode + reach)

    def up(x: Column) -> Column:  # p(x + 1) / p(x)
        return (marked - x) * (drawn - x) / ((x + 1) * (total - marked - drawn + x + 1)).cast("double")

    none = F.array().cast("array<bigint>")
    above = F.when(last > mode, F.sequence(mode, last - 1)).otherwise(none)
    below = F.when(mode > first, F.sequence(mode - 1, first)).otherwise(none)
    start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("all"))
    upper = F.aggregate(above, start, lambda a, x: F.struct((a["p"] * up(x)).alias("p"), (a["all"] + a["p"] * up(x)).alias("all")))
    lower = F.aggregate(below, start, lambda a, x: F.struct((a["p"] / up(x)).alias("p"), (a["all"] + a["p"] / up(x)).alias("all")))
    goal = u * (1.0 + upper["all"] + lower["all"])
    walk = F.aggregate(
        F.when(last > first, F.sequence(first, last - 1)).otherwise(none),
        F.struct(lower["p"].alias("p"), lower["p"].alias("sum"), first.cast("long").alias("at"), goal.alias("goal")),
        lambda a, x: F.struct(
            (a["p"] * up(x)).alias("p"), (a["sum"] + a["p"] * up(x)).alias("sum"),
            F.when(a["sum"] <= a["goal"], x + 1).otherwise(a["at"]).alias("at"), a["goal"].alias("goal"),
        ),
    )
    return walk["at"]


def _uniform(*keys: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") * _UNIT


def _deal(seed: int, level: int):
    """The step of a fold over a node's sources: draws the left half's copies of one source, given those of the sources before it."""

    def step(a: Column, h: Column) -> Column:
        x = _draw(a["left_over"], h["copies"], a["need"], _uniform(F.lit(seed), F.lit(level), F.col("shard"), h["source_no"]))
        return F.struct((a["left_over"] - h["copies"]).alias("left_over"), (a["need"] - x).alias("need"), F.concat(a["took"], F.array(x)).alias("took"))

    return step


def split_tree(counts: DataFrame, levels: int, seed: int) -> DataFrame:
    """(source_no, shard, copies, before) of each shard: ``counts`` (source_no, copies) split down ``levels`` halvings.

    ``before``: the source's copies in shards of smaller number. A node's row holds one count per source.
    """
    node = counts.groupBy().agg(F.array_sort(F.collect_list(F.struct("source_no", "copies"))).alias("have")).select(F.lit(0).cast("long").alias("shard"), "have")
    for level in range(levels):
        total = F.aggregate("have", F.lit(0).cast("long"), lambda a, h: a + h["copies"])
        state = F.struct(total.alias("left_over"), F.floor((total + F.pmod("shard", F.lit(2))) / 2).cast("long").alias("need"), F.array().cast("array<bigint>").alias("took"))

        took = node.withColumn("took", F.aggregate("have", state, _deal(seed, level), lambda a: a["took"]))
        left = F.zip_with("have", "took", lambda h, t: F.struct(h["source_no"].alias("source_no"), t.alias("copies")))
        right = F.zip_with("have", "took", lambda h, t: F.struct(h["source_no"].alias("source_no"), (h["copies"] - t).alias("copies")))
        node = took.select(F.explode(F.array(F.struct((F.col("shard") * 2).alias("shard"), left.alias("have")), F.struct((F.col("shard") * 2 + 1).alias("shard"), right.alias("have")))).alias("x")).select("x.*")
        if level % 3 == 2:
            node = c.cut(node, "tree")
    leaves = node.select("shard", F.inline("have"))
    earlier = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("before", F.coalesce(F.sum("copies").over(earlier), F.lit(0)))


def _place(block: Column, turn: Column, source_no: Column, blocks: Column, seed: int) -> Column:
    """A block's place in a turn: a permutation of 0 to ``blocks`` - 1, as the factor is a prime that doesn't divide ``blocks``."""
    shift = F.pmod(F.xxhash64(F.lit(seed), source_no, turn.cast("long")), blocks)
    return F.pmod(F.when(blocks % 998_244_353 != 0, 998_244_353).otherwise(1_000_000_007) * block + shift, blocks)


def _fill(entries: Column, room: Column) -> Column:
    """Marks of the documents (mark, words) that are taken to fill ``room``: in order as far as they fit, then the smallest one left if it brings the sum nearer."""
    start = F.struct(room.cast("double").alias("left"), F.array().cast("array<bigint>").alias("took"))

    def step(a: Column, e: Column) -> Column:
        fits = e["words"] <= a["left"]
        return F.struct(F.when(fits, a["left"] - e["words"]).otherwise(a["left"]).alias("left"), F.when(fits, F.array_append(a["took"], e["mark"])).otherwise(a["took"]).alias("took"))

    filled = F.aggregate(entries, start, step)
    over = F.array_min(F.transform(F.filter(entries, lambda e: ~F.array_contains(filled["took"], e["mark"])), lambda e: F.struct(e["words"].alias("words"), e["mark"].alias("mark"))))
    return F.when(over["words"] < 2 * filled["left"], F.array_append(filled["took"], over["mark"])).otherwise(filled["took"])


def _sources(dealt: DataFrame, targets: DataFrame, run_blocks: int, seed: int) -> DataFrame:
    """Adds to ``targets`` where a source's rest is reached: ``edge``, the place of that block in the extra turn, ``room`` of its words, ``chosen``, the marks taken of it."""
    placed = dealt.withColumn("place", _place(F.col("block"), F.col("epochs"), F.col("source_no"), F.col("blocks"), seed))
    blocks = c.cut(placed.groupBy("source_no", "place").agg(F.sum("size").alias("words"), F.first("rest").alias("rest")), "blocks")
    run = F.floor(F.col("place") / run_blocks)
    runs = blocks.groupBy("source_no", run.alias("run")).agg(F.sum("words").alias("words"), F.first("rest").alias("rest"))

    def reached(rows: DataFrame, order: str) -> DataFrame:
        before = F.sum("words").over(Window.partitionBy("source_no").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
        return rows.withColumn("ahead", before).where("rest > 0 and ahead <= rest and rest < ahead + words")

    first = reached(runs, "run").select("source_no", F.col("run").alias("at"), (F.col("rest") - F.col("ahead")).alias("left_over"))
    inside = blocks.join(first, "source_no").where(run == F.col("at")).select("source_no", "place", "words", F.col("left_over").alias("rest"))
    edge = c.cut(reached(inside, "place").select("source_no", F.col("place").alias("edge"), (F.col("rest") - F.col("ahead")).alias("room")), "edges")
    there = placed.join(edge, "source_no").where("place = edge and room > 0").groupBy("source_no", "room", "mark").agg(F.sum("size").alias("words"))
    entries = there.groupBy("source_no", "room").agg(F.array_sort(F.collect_list(F.struct("mark", "words"))).alias("entries"))
    chosen = entries.select("source_no", _fill(F.col("entries"), F.col("room")).alias("chosen"))
    return targets.join(edge, "source_no", "left").join(chosen, "source_no", "left")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3, block_docs: int = 64, levels: int | None = None, seed: int = 1, shard_words: int = 1 << 22, run_blocks: int = 4096
) -> DataFrame:
    """One row per document: doc_id, mark, size, source_size, target, taken, and ``placed``: an array of
    (copy, shard, shuffle_key), one for each copy taken. ``levels``: by ``shard_words`` if not given."""
    # What a document is told apart by, in hash order; equal rows are equal here too.
    base = docs.select("doc_id", word_count(F.col("text")).alias("size"), F.col("source").alias("__source"), _mark(seed).alias("mark"))
    base = c.cut(base.withColumn("row", F.monotonically_increasing_id()), "sizes")
    targets = source_targets(base.select(F.col("__source").alias("source"), "size"), weights, most_epochs)
    targets = targets.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    some = F.col("source_size") > 0
    targets = targets.withColumn("epochs", F.when(some, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("rest", F.when(some, F.col("target") - F.col("epochs") * F.col("source_size")).otherwise(0.0))
    targets = c.cut(targets.withColumn("blocks", F.ceil(F.col("docs") / block_docs).cast("long")), "targets")
    if levels is None:
        total = targets.agg(F.sum("target")).first()[0] or 0
        levels = max(1, int(-(-total // shard_words) - 1).bit_length())

    def deal(sources: DataFrame) -> DataFrame:
        """Documents with their source's row, by whatever join the size of ``sources`` allows, and their block."""
        met = base.join(sources.withColumnRenamed("source", "__s"), F.col("__source").eqNullSafe(F.col("__s"))).drop("__source", "__s")
        return met.withColumn("block", F.pmod(F.xxhash64("mark", F.lit(seed + 1)), F.col("blocks")))

    plan = _sources(deal(targets), targets, run_blocks, seed)
    given = F.col("epochs") * F.col("blocks") + F.coalesce(F.col("edge") + (F.col("room") > 0).cast("int"), F.lit(0))
    plan = plan.withColumn("given", given.cast("long")).withColumn("width", F.greatest(F.lit(1), F.floor(F.col("given") / (1 << levels))))
    plan = c.cut(plan, "sources")

    # Leaves of the tree: which positions of a source's permuted block copies each shard draws, in chunks of positions.
    leaves = split_tree(plan.select("source_no", F.col("given").alias("copies")), levels, seed).where("copies > 0")
    leaves = leaves.join(plan.select("source_no", "width"), "source_no").withColumn("to", F.col("before") + F.col("copies"))
    chunks = F.sequence(F.floor(F.col("before") / F.col("width")), F.floor((F.col("to") - 1) / F.col("width")))
    leaves = c.cut(leaves.select("source_no", F.explode(chunks).alias("chunk"), "shard", F.col("before").alias("from"), "to"), "leaves")

    # Documents: a position for each turn their block is in, and the leaf that draws it.
    met = deal(plan)
    extra = _place(F.col("block"), F.col("epochs"), F.col("source_no"), F.col("blocks"), seed)
    more = (extra < F.col("edge")) | ((extra == F.col("edge")) & F.array_contains("chosen", F.col("mark")))
    turns = F.col("epochs") + F.coalesce(more, F.lit(False)).cast("long")
    met = met.select("row", "mark", "source_no", "blocks", "width", "block", F.explode(F.when(turns > 0, F.sequence(F.lit(0).cast("long"), turns - 1))).alias("copy"))
    number = F.col("copy") * F.col("blocks") + _place(F.col("block"), F.col("copy"), F.col("source_no"), F.col("blocks"), seed)
    met = met.withColumn("number", number).withColumn("chunk", F.floor(F.col("number") / F.col("width")))
    drawn = met.join(leaves, ["source_no", "chunk"]).where("number >= `from` and number < `to`")
    one = F.struct("copy", "shard", F.xxhash64(F.lit(seed), F.col("mark"), F.col("copy")).alias("shuffle_key"))
    drawn = drawn.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("placed"))
    out = deal(plan.select("source", "source_size", "target", "blocks")).join(drawn, "row", "left")
    placed = F.coalesce("placed", F.array().cast(drawn.schema["placed"].dataType))
    return out.select("doc_id", "mark", "size", "source_size", "target", (F.col("size") * F.size(placed)).alias("taken"), placed.alias("placed"))


def _mark(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the documents with their columns, a row for each copy taken, shard by shard, each shard in the order of its shuffle keys. ``how`` is as for ``mix``."""
    # Equal rows share a mark and are taken alike, so one plan row for each mark and id is enough.
    plan = mix(docs, **how).where(F.size("placed") > 0).groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).agg(F.first("placed").alias("__placed"))
    plan = c.cut(plan, "mix")
    met = docs.withColumn("__m", _mark(how.get("seed", 1))).join(plan, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__m") == F.col("__mark")))
    rows = met.select(*[docs[x] for x in docs.columns], F.explode("__placed").alias("__x"))
    shuffled = rows.repartition(c.file_count(docs, 128 << 20), "__x.shard").sortWithinPartitions("__x.shard", "__x.shuffle_key")
    return shuffled.drop("__x")
