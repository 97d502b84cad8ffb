"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Everything here is DataFrame functions. Sizes are words. A source whose target
is at least its size gives whole passes of all its documents; what is left of
its target, an exact number of words, is drawn without replacement:

1. Documents are dealt to output shards by a hash, copies of one row apart.
2. A source's quota is split down a binary tree over the shards. At a node the
   left half gets a hypergeometric number of the node's words (as many as a
   draw of so many words from both halves would take from the left one), the
   right half the rest. Each leaf has its exact quota, and the quotas add up.
3. In a shard the source's blocks (runs of ``block_words`` words of a document)
   are put in a random order, and the first are taken until the quota is met;
   the last is cut. Blocks are disjoint, so nothing is drawn twice.
4. A shard's documents are put in a random order of their own.

Randomness is hashes of the seed with identifiers and texts, and with a number
for rows that repeat both, so reruns agree. The draws are grouped by source and
shard; a source that holds a third of all rows, or one row that is repeated so
often, has as many groups as there are shards. The tree of a source has a leaf
for each shard that holds any of it: ``collect_list`` gathers numbers of words by
shard, never rows, 12 bytes for each ``shard_words`` words of the corpus at most.

Defined cases: a null text has size 0 and nothing is taken of it; the null
source is a source and comes last; a source without words has target 0; rows
that repeat an identifier are drawn one by one; without words in all nothing is
taken; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, narrow, numbered, staged

#: Weights of the sources in their order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source's words may be taken so many times.
MOST_PASSES = 3
#: Draws of a rejection sampler before the mean is taken; all fail with a chance below 1e-25.
TRIES = 64
#: Constants of Stadlober's ratio-of-uniforms bound, 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e). Fixed values.
HAT_WIDTH, HAT_SHIFT = 2 * math.sqrt(2 / math.e), 3 - 2 * math.sqrt(3 / math.e)


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _log_factorial(n: str) -> str:
    """Stirling's series at n + 8, divided back; good to 1e-10 from 0 on."""
    series = f"x * ln(x) - x + 0.5D * ln(x * {2 * math.pi}D) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)"
    return _let("x", f"{n} + 8D", f"{series} - ln((x - 7) * (x - 6) * (x - 5) * (x - 4) * (x - 3) * (x - 2) * (x - 1) * x)")


def hypergeometric(good: str, bad: str, draws: str, *key: str) -> str:
    """SQL for how many of ``draws`` from ``good + bad`` things without replacement are good; ``key`` is the randomness.

    Ratio of uniforms with rejection, for any size at a constant cost. The
    smaller of the two kinds and of the drawn and the left is what is sampled.
    """
    sums = lambda n: " + ".join(map(_log_factorial, (n, f"h.few - {n}", f"h.s - {n}", f"h.many - h.s + {n}")))
    uniform = lambda which: f"(shiftrightunsigned(xxhash64({', '.join(key)}, try_no, {which}), 11) + 0.5D) / {float(1 << 53)!r}D"
    fits = _let("n", "floor(c.x) * 1D", f"CASE WHEN 2 * ln(c.u) <= t.top - ({sums('n')}) THEN n ELSE -1D END")
    attempt = _let("u", uniform(0), _let("c", f"named_struct('u', u, 'x', h.mean + 0.5D + t.hat * (({uniform(1)}) - 0.5D) / u)", f"CASE WHEN c.x >= 0 AND c.x < t.stop THEN {fits} ELSE -1D END"))
    search = f"aggregate(sequence(1, {TRIES}), -1D, (found, try_no) -> CASE WHEN found >= 0 THEN found ELSE {attempt} END)"
    drawn = _let("d", search, "CASE WHEN d >= 0 THEN d ELSE floor(h.mean) * 1D END")
    setup = f"named_struct('hat', h.spread * {HAT_WIDTH!r}D + {HAT_SHIFT!r}D, 'top', {sums('h.mode')}, 'stop', least(least(h.s, h.few) + 1, floor(h.mean + 0.5D + 16 * h.spread) * 1D))"
    shape = "named_struct('few', f.few, 'many', f.many, 's', f.s, 'mean', f.s * f.few / f.all, 'mode', floor((f.s + 1) * (f.few + 1) / (f.all + 2)) * 1D, 'spread', sqrt((f.all - f.s) * f.s * (f.few / f.all) * (f.many / f.all) / greatest(f.all - 1, 1D) + 0.5D))"
    fold = "named_struct('few', least(p.g, p.b), 'many', greatest(p.g, p.b), 's', least(p.n, p.g + p.b - p.n), 'all', p.g + p.b)"
    sampled = _let("f", fold, _let("h", shape, _let("t", setup, drawn)))
    unfolded = _let("z", sampled, _let("y", "CASE WHEN p.g <= p.b THEN z ELSE least(p.n, p.g + p.b - p.n) - z END", "CASE WHEN p.n <= p.g + p.b - p.n THEN y ELSE p.g - y END"))
    bounded = f"greatest(least({unfolded}, p.g, p.n), 0D, p.n - p.b)"
    sure = f"CASE WHEN p.n <= 0 OR p.g <= 0 THEN 0D WHEN p.b <= 0 THEN p.n WHEN p.n >= p.g + p.b THEN p.g ELSE {bounded} END"
    return _let("p", f"named_struct('g', ({good}) * 1D, 'b', ({bad}) * 1D, 'n', ({draws}) * 1D)", f"cast({sure} AS bigint)")


def with_leaf_quotas(nodes: DataFrame, most_levels: int, *key: str) -> DataFrame:
    """Splits ``rest`` down a binary tree: adds ``quotas``, an array with the exact quota of each leaf.

    ``upto`` has the running sums of the leaves' words, so that any node's words
    are one difference. A row has ``2 ** levels`` leaves by its column ``levels``,
    which is ``most_levels`` at most; running sums that are missing at the end
    equal the last, for leaves without words.
    """
    nodes = nodes.withColumn("quotas", F.array("rest"))
    for level in range(most_levels):
        half = f"shiftleft(1, levels - {level + 1})"
        ends = [f"(CASE WHEN i = 0 AND {k} = 0 THEN 0 ELSE upto[least((2 * i + {k}) * {half}, size(upto)) - 1] END)" for k in range(3)]
        left = hypergeometric(f"{ends[1]} - {ends[0]}", f"{ends[2]} - {ends[1]}", "q", *key, str(level), "i")
        split = f"flatten(transform(quotas, (q, i) -> {_let('a', left, 'array(a, q - a)')}))"
        nodes = nodes.withColumn("quotas", F.expr(f"CASE WHEN levels > {level} THEN {split} ELSE quotas END"))
    return nodes


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """source_key, source_size and target of every source.

    Giving the excess over the limits again and again to the others by weight
    ends where every source has the lesser of its limit and of its weight times
    one level. With the sources in the order of limit / weight, those that stop
    at their limits are a prefix, and the level follows from running sums. The
    windows go over one row for each source.
    """
    totals = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source_key").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    by_limit = [F.col("limit") / F.col("weight"), F.col("source_key").asc_nulls_last()]
    before, on = Window.orderBy(*by_limit).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(*by_limit).rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(on)
    # The prefix ends at the first source whose limit is not below what the level gives it.
    at = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("place").alias("place"), F.col("level").alias("level")))
    levels = ranked.withColumns({"level": level, "place": F.row_number().over(Window.orderBy(*by_limit))}).withColumn("final", F.min(at).over(every)["level"])
    target = F.least("limit", F.coalesce(F.col("final") * F.col("weight"), F.col("limit")))
    return levels.select("source_key", "source_size", target.alias("target"))


def _copies_numbered(rows: DataFrame) -> DataFrame:
    """Adds ``copy``: rows that repeat identifier, source and text are counted from 0, all others have 0.

    Which of them has which number follows their places, but that doesn't matter, as they are equal. Each
    input partition counts its own and then learns how many came before, so a row that is repeated without end is
    counted in as many groups as there are partitions.
    """
    part = F.shiftrightunsigned("row", 33).alias("part")
    counted = rows.groupBy("mark", part).agg(F.count(F.lit(1)).alias("n"))
    same = Window.partitionBy("mark")
    before = F.coalesce(F.sum("n").over(same.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    repeated = staged(counted.select("mark", "part", before.alias("before"), F.sum("n").over(same).alias("total")).where("total > 1").drop("total"), "repeated")
    placed = rows.withColumn("part", part)
    own = F.row_number().over(Window.partitionBy("mark", "part").orderBy("row")) - 1
    copies = placed.join(repeated, ["mark", "part"]).withColumn("copy", F.col("before") + own).drop("before")
    others = placed.join(repeated, ["mark", "part"], "left_anti").withColumn("copy", F.lit(0).cast("long"))
    return others.unionByName(copies).drop("part")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """A row for each row of ``docs``: doc_id, size, source_size, target, taken, shard, passes, drawn and slot.

    ``passes`` is how often the whole text is taken, ``drawn`` lists the blocks
    taken besides, as first word and length; ``slot`` orders a shard's output.
    ``options`` are those of ``_mixed``.
    """
    source = narrow(docs, doc_id=id_col, text=text_col, source=source_col).withColumn("row", F.monotonically_increasing_id())
    return _mixed(source, **options).drop("row", "mark", "source_key")


def _mixed(source: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES, shard_words: int = 1 << 24, least_shards: int = 256, block_words: int = 64, seed: int = 1) -> DataFrame:
    """The mix of the rows (row, doc_id, text, source); sizes are written, texts are read once."""
    mark = F.xxhash64(F.col("doc_id").cast("long"), "source", F.xxhash64("text"), F.lit(seed)).alias("mark")
    sized = source.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source_key"), word_count(F.col("text")).alias("size"), mark)
    rows = staged(sized, "sizes")
    words = int(rows.agg(F.sum("size")).first()[0] or 0)
    levels = math.ceil(math.log2(max(least_shards, words / shard_words, 1)))
    rows = _copies_numbered(rows).withColumn("shard", F.pmod(F.xxhash64("mark", "copy", F.lit(0)), F.lit(1 << levels)).cast("int"))
    targets = staged(source_targets(rows, weights, most), "targets")
    quota = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(quota / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")
    plan = targets.withColumn("passes", passes).withColumn("rest", F.when(F.col("source_size") > 0, F.least(quota - F.col("passes") * F.col("source_size"), F.when(F.col("passes") < most, F.col("source_size")).otherwise(0))).otherwise(0).cast("long"))
    same = lambda a, b: a["source_key"].eqNullSafe(b["source_key"])
    # A source's leaves are the shards that hold any of it, so a source of few documents has a small tree.
    held = rows.groupBy("source_key", "shard").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    leaves = F.array_sort(F.collect_list(F.struct("shard", "upto"))).alias("leaves")
    by_source = held.withColumn("upto", F.sum("words").over(running)).groupBy("source_key").agg(leaves)
    by_source = by_source.select("source_key", F.col("leaves.shard").alias("shards"), F.col("leaves.upto").alias("upto"), F.ceil(F.log2(F.size("leaves"))).cast("int").alias("levels"))
    nodes = plan.join(by_source, same(plan, by_source)).drop(by_source["source_key"])
    tree = with_leaf_quotas(nodes, levels, "source_key", str(seed))
    leaf = F.explode(F.arrays_zip("shards", F.slice("quotas", F.lit(1), F.size("shards")).alias("quota"))).alias("leaf")
    quotas = staged(tree.select("source_key", "source_size", "target", "passes", leaf).select("source_key", "source_size", "target", "passes", F.col("leaf.shards").alias("shard"), F.col("leaf.quota").alias("quota")), "quotas")
    given = rows.join(quotas, same(rows, quotas) & (rows["shard"] == quotas["shard"])).select(rows["*"], "source_size", "target", "passes", "quota")
    # An empty document has one block of no words, so that no row is lost.
    blocks = given.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("size") - 1), F.lit(block_words).cast("long"))))
    blocks = blocks.withColumn("length", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("at")))
    shuffled = Window.partitionBy("source_key", "shard").orderBy(F.xxhash64("mark", "copy", "at"), "doc_id", "row", "at").rowsBetween(Window.unboundedPreceding, 0)
    taken = blocks.withColumn("take", F.greatest(F.lit(0), F.least("length", F.col("quota") - F.sum("length").over(shuffled) + F.col("length"))).cast("long"))
    keys = ["source_key", "shard", "row", "doc_id", "size", "mark", "source_size", "target", "passes"]
    drawn = F.array_sort(F.collect_list(F.when(F.col("take") > 0, F.struct(F.col("at"), F.col("take").alias("length")))))
    mixed = taken.groupBy(*keys).agg(F.sum("take").alias("extra"), drawn.alias("drawn"))
    slot = F.xxhash64("mark", F.lit(seed + 1))
    return mixed.select("row", "mark", "source_key", "doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("extra")).alias("taken"), "shard", "passes", "drawn", slot.alias("slot"))


def mixed_documents(docs: DataFrame, *, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document once for each whole pass, and once more with its drawn blocks.

    Blocks keep their words' white space. Documents of which nothing is taken go.
    """
    names = docs.columns
    base = numbered(docs)
    source = base.select("row", F.col("kept")[id_col].alias("doc_id"), F.col("kept")[text_col].alias("text"), F.col("kept")[source_col].alias("source"))
    plan = _mixed(source, **options).where("taken > 0").select("row", "passes", "drawn", "shard", "slot")
    words = F.regexp_extract_all(F.col("kept")[text_col], F.lit(f"({WORD_PATTERN}[\\x20\\x09-\\x0D]*)"), F.lit(1))
    part = F.array_join(F.flatten(F.transform("drawn", lambda b: F.slice(F.col("words"), (b["at"] + 1).cast("int"), b["length"].cast("int")))), "")
    copies = F.array_repeat(F.col("kept")[text_col], F.col("passes").cast("int"))
    joined = base.join(plan, "row").withColumn("words", F.when(F.size("drawn") > 0, words).otherwise(F.array().cast("array<string>")))
    out = joined.withColumn("new_text", F.explode(F.concat(copies, F.when(F.size("drawn") > 0, F.array(part)).otherwise(F.array().cast("array<string>")))))
    out = out.sortWithinPartitions("shard", "slot")
    return out.select(*[F.col("new_text").alias(c) if c == text_col else F.col("kept")[c].alias(c) for c in names])
