"""Mixing sources to target weights, in DataFrame operations only.

Each source's documents, in a fixed pseudorandom order, are one stream of words,
cut into blocks of `block_words`.  The mix is a number of slots, one block each, in output shards.

1. `draws`: every slot of a source falls on a shard by a hash, which makes the source counts of a
   shard a multinomial draw, conditioned on each source's total: that is its target, which a free draw
   would miss by its own noise.
2. `drawn`: a shard's slots are its counts; the slots of a source are numbered through the shards in order.
3. The n-th slot of a source is mapped to a block through the source's pseudorandom index permutation, a Feistel network with
   cycle walking, keyed by seed, source and pass; blocks are joined by (source, index).
   A source with more slots than blocks goes through further passes, so no
   block is taken more than CAP times.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating, and
share the sizes of all documents; a target stops at CAP times its source's
size and the excess is shared again by weight.

Defined results: a null text has size 0; a null source is a source of its own;
documents without words are never taken; equal rows are documents of their
own; a null doc_id is kept; an empty table gives no rows; columns of docs are kept whatever their names, and the added
ones get underscores where docs has theirs.  Every draw is a
function of the seed and the data (by MD5, which any SQL has), so reruns agree.

Scale: a source may hold a third of all rows.  Positions in its stream and the numbers of its slots are
prefix sums in two levels (hash buckets or groups of shards for each source, then inside one), and its slots are dealt in chunks over
a number of partitions that follows from their number.  Only windows over one row per
source, one row per (source, bucket) or one per (source, group of shards) are unsplit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 1024
BUCKETS = 1024
CHUNK = 1 << 15
SEED = 20

WORD = r"[^\x20\x09-\x0D]+"
#: Rounds of the permutations' Feistel network, and passes through it at most.
ROUNDS, WALKS = 4, 24
#: Sources up to which a plan is broadcast.
MOST_SOURCES = 100_000
#: Shards whose slots are numbered in one window.
GROUP_SHARDS = 1024


def words_in(text: str) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, source_no, weight and target of each row (source, source_size).

    With a common level L, a target is min(weight * L, cap * size).  Were the
    sources before a place, in order of cap * size / weight, at their cap, the
    rest would share a level; it rises up to the first source that can hold its
    part and falls from there, so L is the greatest.
    """
    order, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    listed = sizes.withColumn("source_no", (F.row_number().over(order) - 1).cast("long")).withColumn("weight", weight)
    listed = listed.withColumn("_cap", F.col("source_size") * F.lit(float(cap))).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    by_ratio = Window.orderBy("_ratio", "source_no")
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    final = F.max("_level").over(every)
    return listed.withColumn("_level", level).withColumn("target", F.least("_cap", F.col("weight") * final)).drop("_cap", "_ratio", "_level")


def drawn_number(*parts: Column | str | int) -> Column:
    """A pseudorandom number below 2 ** 60 from the parts, as text: the first digits of their MD5."""
    text = F.concat_ws("|", *[F.coalesce((F.lit(x) if isinstance(x, (str, int)) else x).cast("string"), F.lit("null")) for x in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def shape(n: Column) -> Column:
    """Rows and columns of the smallest near-square table with n places or more: less than a row more."""
    rows = F.ceil(F.sqrt(n)).cast("long")
    more = n + rows - 1
    return F.struct(rows.alias("rows"), ((more - more % rows) / rows).cast("long").alias("columns"))


def permuted(index: Column, n: Column, form: Column, *key: Column | str | int) -> Column:
    """Place of index under the key's pseudorandom permutation of 0..n-1; form is the shape of n.

    A Feistel network over the rows and columns of a table: in turn the row moves by a keyed hash of the column, and the column by one of the row.
    That permutes the table; a place beyond n goes through the network again until it is below n (cycle walking).  Up to n = WALKS ** 2 this needs no more
    than WALKS passes, as fewer places are beyond n; above, each pass leaves it there with probability below 1 / WALKS.
    """

    def network(x: Column) -> Column:
        start = F.struct(((x - x % form.columns) / form.columns).cast("long").alias("row"), (x % form.columns).alias("column"))
        row = lambda s, k: (s["row"] + drawn_number(*key, k, s["column"])) % form.rows
        column = lambda s, k: (s["column"] + drawn_number(*key, k, s["row"])) % form.columns
        step = lambda s, k: F.struct(F.when(k % 2 == 0, row(s, k)).otherwise(s["row"]).alias("row"), F.when(k % 2 == 1, column(s, k)).otherwise(s["column"]).alias("column"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["row"] * form.columns + s["column"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), network(index), lambda x, _: F.when(x < n, x).otherwise(network(x)))


def placed(docs: DataFrame, plan: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """docs (doc_id, source, size, text_hash) with the columns of plan and `start`, the place of the first word in the source's stream."""
    # One row for each source: few are sent to all, so rows stay where they are.
    held = F.broadcast(plan) if plan.count() <= MOST_SOURCES else plan
    rows = docs.join(held, docs.source.eqNullSafe(plan.source)).drop(plan.source).withColumn("_bucket", F.pmod(drawn_number("bucket", F.col("doc_id"), F.col("text_hash")), F.lit(buckets)))
    in_bucket = Window.partitionBy("source_no", "_bucket").orderBy("doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    of_buckets = Window.partitionBy("source_no").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source_no", "_bucket").agg(F.sum("size").alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(of_buckets), F.lit(0))).drop("_sum")
    return rows.join(sums, ["source_no", "_bucket"]).withColumn("start", F.col("_base") + F.coalesce(F.sum("size").over(in_bucket), F.lit(0))).drop("_base", "_bucket")


def slotted(plan: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """plan with n_blocks, n_slots (whole passes through a source, and a part of one by its permutation), the form of its permutations and n_shards of the mix."""
    size, target = F.col("source_size"), F.col("target")
    passes = F.floor(target / size)
    blocks = F.ceil(size / block_words).cast("long")
    part = F.round((target - passes * size) * blocks / size)
    sized = plan.withColumn("n_blocks", blocks).withColumn("n_slots", F.when(size > 0, passes * blocks + part).otherwise(0).cast("long"))
    form = shape(F.greatest(F.col("n_blocks"), F.lit(1)))
    shards = F.greatest(F.lit(1), F.ceil(F.sum("n_slots").over(Window.partitionBy()) / shard_slots)).cast("long")
    return sized.withColumn("form", form).withColumn("n_shards", shards)


def _parts(plan: DataFrame) -> int:
    """Partitions for the slots of a plan; a number of its own is one that adaptive execution does not merge."""
    slots = plan.agg(F.sum("n_slots")).first()[0] or 0
    return max(1, -(-slots // CHUNK))


def draws(plan: DataFrame, seed: int = SEED) -> DataFrame:
    """Multinomial counts: source_no, shard and n, the slots of the source in the shard (where there are any)."""
    chunks = plan.where("n_slots > 0").select("source_no", "n_slots", "n_shards", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_slots") - 1, F.lit(CHUNK).cast("long"))).alias("_low"))
    slots = chunks.repartition(_parts(plan), "source_no", "_low").select("source_no", "n_shards", F.explode(F.sequence("_low", F.least(F.col("_low") + CHUNK, F.col("n_slots")) - 1)).alias("_slot"))
    shard = F.pmod(drawn_number(seed, "shard", F.col("source_no"), F.col("_slot")), F.col("n_shards"))
    return slots.groupBy("source_no", shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def drawn(plan: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per slot: shard, source_no, n (the slot's number in its source) and the index of its block, from the counts of the shards."""
    counts = draws(plan, seed).checkpoint()
    grouped = counts.withColumn("_group", F.floor(F.col("shard") / GROUP_SHARDS))
    before, inside = (Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1) for key, order in ((["source_no"], "_group"), (["source_no", "_group"], "shard")))
    bases = grouped.groupBy("source_no", "_group").agg(F.sum("n").alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    numbered = grouped.join(bases, ["source_no", "_group"]).withColumn("_first", F.col("_base") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    shards = numbered.select("source_no", "shard", "n", "_first").join(plan.select("source_no", "n_blocks", "form"), "source_no").repartition(_parts(plan), "source_no", "shard")
    slots = shards.withColumn("n", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("n") - 1)))
    turn = F.floor(F.col("n") / F.col("n_blocks"))
    return slots.select("shard", "source_no", "n", permuted(F.col("n") % F.col("n_blocks"), F.col("n_blocks"), F.col("form"), seed, F.col("source_no"), turn).alias("block"))


def spread(places: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each placed document for each block it reaches into: block, first_word (in the document) and words."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    rows = places.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), last)))
    low = F.greatest(F.col("block") * block_words, F.col("start"))
    return rows.withColumn("first_word", low - F.col("start")).withColumn("words", F.least((F.col("block") + 1) * block_words, F.col("start") + F.col("size")) - low)


def text_hash() -> Column:
    return drawn_number("text", F.col("text")).alias("text_hash")


def _measured(docs: DataFrame) -> DataFrame:
    shared.folder(docs.sparkSession)
    return docs.select("doc_id", "source", words_in("text").alias("size"), text_hash()).checkpoint()


def _planned(docs: DataFrame, block_words: int, shard_slots: int) -> DataFrame:
    return slotted(targets(docs.groupBy("source").agg(F.sum("size").alias("source_size"))), block_words, shard_slots).checkpoint()


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix as spans: shard, source, slot (n), block, doc_id, first_word and words; spans of a slot join to its block."""
    measured = _measured(docs)
    plan = _planned(measured, block_words, shard_slots)
    spans = spread(placed(measured, plan), block_words)
    return spans.join(drawn(plan, seed).hint("merge"), ["source_no", "block"]).select("shard", "source", "n", "block", "doc_id", "text_hash", "start", "first_word", "words")


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """shard, source, n and the words of each block of the mix as one text."""
    pieces = docs.select("doc_id", text_hash(), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("_words")).dropDuplicates(["doc_id", "text_hash"])
    spans = mix(docs, **options)
    joined = spans.join(pieces, spans.doc_id.eqNullSafe(pieces.doc_id) & (spans.text_hash == pieces.text_hash))
    part = F.struct("start", "first_word", F.array_join(F.slice("_words", (F.col("first_word") + 1).cast("int"), F.col("words").cast("int")), " ").alias("words"))
    return joined.groupBy("shard", "source", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x.words), " ").alias("text"))


def digest(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, keep_keys: bool = False) -> DataFrame:
    """One row per document: size, source_size, target of its source, the words that the mix takes of it, and the number of shards that hold some of them."""
    measured = _measured(docs)
    plan = _planned(measured, block_words, shard_slots)
    places = shared.written(placed(measured, plan), "placed")  # read for the blocks and for the documents
    # A block is taken at most CAP times, so its shards are few.
    times = drawn(plan, seed).groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("_times"), F.collect_set("shard").alias("_shards"))
    # The planner takes the exploded slots for as small as their plan, so a shuffle join is asked for.
    spans = spread(places, block_words).join(times.hint("merge"), ["source_no", "block"])
    taken = spans.groupBy("source_no", "start").agg(F.sum(F.col("words") * F.col("_times")).alias("taken"), F.size(F.array_distinct(F.flatten(F.collect_list("_shards")))).cast("long").alias("_in"))
    # Only documents with words have a start of their own; the others take nothing.
    key = F.when(F.col("size") > 0, F.col("start"))
    rows = places.withColumn("start", key).join(taken, ["source_no", "start"], "left")
    added = [F.coalesce(x, F.lit(0)).cast("long").alias(name) for x, name in (("taken", "taken"), ("_in", "n_shards"))]
    return rows.select("doc_id", "size", "source_size", "target", *added, *["source", "text_hash"] * keep_keys)


def taken_documents(docs: DataFrame, **options) -> DataFrame:
    """Documents that the mix takes words of, all columns of docs, and size, source_size, target, taken and n_shards."""
    added = ["size", "source_size", "target", "taken", "n_shards"]
    docs, back = shared.plain(docs, "doc_id", "text", "source")
    found = digest(docs, keep_keys=True, **options).where("taken > 0")
    # Equal rows have equal keys but takes of their own: the n-th of them gets the n-th take.
    key = ["_id", "_source", "_hash"]
    numbered = lambda df, *order: df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    takes = numbered(found.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_hash"), *added), F.col("taken").desc())
    rows = numbered(docs.select("*", F.col("doc_id").alias("_id"), F.col("source").alias("_source"), text_hash().alias("_hash")), F.lit(1))
    same = F.lit(True)
    for x in (*key, "_n"):
        same = same & rows[x].eqNullSafe(takes[x])
    return back(rows.join(takes, same).drop("_id", "_source", "_hash", "_n"), *added)
