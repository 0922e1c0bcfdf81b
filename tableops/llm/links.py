"""Similar pairs from hash buckets, and connected components, both without listing all pairs
of a group.

Nodes are structs of two longs (``common.wide_key``). Buckets are longs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableops.llm.common import keys, meet, wide_key, written

STAR_ROUNDS = 3
#: Four-bit registers in a long of a sketch.
NIBBLES = 0x1111111111111111
#: Members of a bucket from which on its nodes get the wider sketch.
CROWD = 8
#: Longs of the bits that a set's members turn.
BIT_LONGS = 8


def components(edges: DataFrame, folder: str | None = None) -> DataFrame:
    """(``node``, ``root``) for every node of ``edges`` (``a``, ``b``) but the roots, which
    are the smallest nodes of their components.

    Alternating large-star and small-star steps: each is a minimum per node (combined before
    the shuffle) and a join back, whose hot keys Spark splits. A round ends in a written
    table; the rounds are logarithmic in practice and end when all edges are stars; only a
    count reaches the driver."""
    e = written(edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), folder)
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_v")) \
            .select("_u", F.least("_u", "_v").alias("_m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("_u")) \
            .select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        large = written(large, folder)
        least = large.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
        small = large.join(least, F.col("u") == F.col("_u")).filter(F.col("v") > F.col("_m")) \
            .select(F.col("v").alias("u"), F.col("_m").alias("v"))
        e = written(small.unionByName(least.select(F.col("_u").alias("u"), F.col("_m").alias("v"))).distinct(), folder)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _stars(e: DataFrame) -> bool:
    """Whether each node of the edges ``e`` (``u`` > ``v``, none twice) has one smaller neighbour and no
    greater one, or greater ones alone."""
    ends = e.select(F.col("u").alias("_n"), F.lit(1).alias("_up")).unionByName(e.select(F.col("v").alias("_n"), F.lit(0).alias("_up")))
    return ends.groupBy("_n").agg(F.sum("_up").alias("_ups"), F.count(F.lit(1)).alias("_all")) \
        .filter((F.col("_ups") > 0) & (F.col("_all") > 1)).count() == 0


def shared_buckets(members: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows of ``members`` (``bucket``, ``hi``, ``lo``; no row twice) whose bucket holds
    several nodes, as (``bucket``, ``node``)."""
    several = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1") \
        .select(F.col("bucket").alias("_bucket"))
    return meet(members, ["bucket"], keys(several, ["_bucket"], folder)).select("bucket", F.struct("hi", "lo").alias("node"))


def _once(shared: DataFrame, folder: str | None) -> DataFrame:
    """``shared`` without the buckets whose members are those of a smaller bucket: they hold no other
    pairs. A set is told by its size and two combined 64-bit hashes of its nodes."""
    hi, lo = wide_key(F.col("node"))
    sets = shared.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.bit_xor(hi).alias("_hi"), F.bit_xor(lo).alias("_lo"))
    first = sets.groupBy("_n", "_hi", "_lo").agg(F.min("bucket").alias("_bucket")).select("_bucket")
    return written(meet(shared, ["bucket"], keys(first, ["_bucket"], folder)).select("bucket", "node"), folder)


def _planes(sketch: Column, longs: int) -> Column:
    """A sketch of four-bit registers, dealt anew: of each four longs every one has the same bit of
    all 64 registers, so that a few operations compare them all."""
    def bit(k: int, p: int) -> Column:
        return F.shiftrightunsigned(F.get(sketch, F.lit(k)), p).bitwiseAND(F.lit(NIBBLES))
    return F.array(*[reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(bit(k + j, p), j) for j in range(min(4, longs - k))])
                     for k in range(0, longs, 4) for p in range(4)])


def _agreeing(x: Column, y: Column, longs: int) -> Column:
    """How many registers of two sketches, dealt by ``_planes``, are equal."""
    def apart(first: Column) -> Column:
        return F.bit_count(reduce(lambda p, q: p.bitwiseOR(q), [F.get(x, first + p).bitwiseXOR(F.get(y, first + p)) for p in range(4)]))
    if longs > 16:  # written out, it would be too long for the JVM to compile
        return F.lit(longs * 16) - F.aggregate(F.sequence(F.lit(0), F.lit(longs - 4), F.lit(4)), F.lit(0), lambda n, k: n + apart(k))
    return F.lit(longs * 16) - reduce(lambda p, q: p + q, [apart(F.lit(k)) for k in range(0, longs, 4)])


def _may_be_alike(size: Column, other: Column, bits: Column, beside: Column, ratio: float, longs: int = BIT_LONGS) -> Column:
    """Whether two sets may have a Jaccard similarity of ``ratio``, by their sizes and ``longs``
    longs of the bits that their members turn, each one: common members leave no trace between
    the two, and a bit that differs stands for a member that only one has. No similar pair is lost."""
    def apart(k: Column) -> Column:
        return F.bit_count(F.get(bits, k).bitwiseXOR(F.get(beside, k)))
    if longs > 16:
        n = F.aggregate(F.sequence(F.lit(0), F.lit(longs - 1)), F.lit(0), lambda n, k: n + apart(k))
    else:
        n = reduce(lambda p, q: p + q, [apart(F.lit(k)) for k in range(longs)])
    return (F.least(size, other) >= F.greatest(size, other) * ratio) & (n * (1 + ratio) <= (size + other) * (1 - ratio) + 1e-6)


def _central(shared: DataFrame, folder: str | None) -> DataFrame:
    """``shared`` plus ``_rank``, the lower, the more nodes a node meets in all its buckets."""
    many = shared.groupBy(F.col("bucket").alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    met = shared.join(many, F.col("bucket") == F.col("_bucket")).groupBy(F.col("node").alias("_node")) \
        .agg((-F.sum("_n")).alias("_rank"))
    return written(shared.join(met, F.col("node") == F.col("_node")).select("bucket", "node", "_rank"), folder)


def _possible(pairs: DataFrame, sizes: DataFrame, ratio: float) -> DataFrame:
    """``pairs`` (``a``, ``b``) without those that ``_may_be_alike`` refutes."""
    one, two = [sizes.select(F.col("node").alias(f"_{x}"), F.col("size").alias(f"_size_{x}"), F.col("bits").alias(f"_bits_{x}")) for x in "ab"]
    return pairs.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b")) \
        .filter(_may_be_alike(F.col("_size_a"), F.col("_size_b"), F.col("_bits_a"), F.col("_bits_b"), ratio)).select("a", "b")


def linked(shared: DataFrame, similar: Callable[[DataFrame], DataFrame], info: DataFrame,
           longs: int = 0, least: int = 0, folder: str | None = None, sizes: DataFrame | None = None,
           ratio: float = 0.0, wider: Callable[[DataFrame], DataFrame] | None = None,
           wide_longs: int = 0, wide_least: int = 0) -> DataFrame:
    """Components of the graph of all similar pairs that share a bucket.

    ``similar`` keeps the pairs (``a``, ``b``) that are similar; ``info`` has ``node``, all its
    ``bands`` and its ``sketch`` of ``longs`` longs. First every bucket's members are compared
    with the one that meets most others, which then leaves the bucket; then, for buckets whose
    members are not yet one component, with the most central one outside their main component,
    a few times; and at last every member outside the main component with the members of other
    components. Pairs inside a component are never compared, they could not change it, and no
    pair is passed to ``similar`` twice. Of buckets with the same members, one is used. In the last step
    a pair is met in its smallest common bucket only, and with ``longs`` passed on if ``least`` registers of its sketches agree; the
    join itself tests both. ``wider`` gives nodes (``node``) that are left in that step in
    buckets of more than CROWD a second sketch (``node``, ``wide``) of ``wide_longs`` longs; where both
    of a pair have it, ``wide_least`` of its registers must agree as well. With ``sizes``
    (``node``, ``size``, ``bits``), pairs that by their sizes or bits cannot reach a Jaccard
    similarity of ``ratio`` are left out, and ``wide`` are more such bits. A centre's pairs are no more than
    its bucket's members and meet the bits once they are distinct; only in the last step members carry bits. Cheaper
    tests come first. All tables on the way, and the result, are written below ``folder``."""
    members = _central(_once(shared, folder), folder)
    label = tested = None
    for turn in range(STAR_ROUNDS + 1):
        last = turn == STAR_ROUNDS
        if label is None:
            named = members.withColumn("root", F.col("node")).withColumn("_main", F.lit(None).cast(members.schema["node"].dataType))
        else:
            # written, as the parts and the members that stay are both taken from it
            named = written(members.join(label.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select(
                "bucket", "node", "_rank", F.coalesce("root", "node").alias("root")), folder)
            parts = named.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("_n"))
            main = parts.groupBy(F.col("bucket").alias("_bucket")).agg(
                F.max(F.struct("_n", "root")).alias("_main"), F.count(F.lit(1)).alias("_parts")) \
                .filter(F.col("_parts") > 1).select("_bucket", F.col("_main.root").alias("_main"))
            named = written(named.join(main, F.col("bucket") == F.col("_bucket")).drop("_bucket"), folder)
            if named.isEmpty():
                break
        outside = named.filter(~F.col("root").eqNullSafe(F.col("_main")))
        meet = (F.col("bucket") == F.col("_bucket")) & (F.col("root") != F.col("_ra"))
        if not last:
            order = F.struct("_rank", F.xxhash64("node").alias("_o"), "node", "root")
            chosen = outside.groupBy(F.col("bucket").alias("_bucket")).agg(F.min(order).alias("_c")) \
                .select("_bucket", F.col("_c.node").alias("a"), F.col("_c.root").alias("_ra"))
            chosen = written(chosen, folder)
        else:
            sketch = _planes(F.col("sketch"), longs) if longs else F.lit(None).cast("array<long>")
            own = info.select(F.col("node").alias("_n"), "bands", sketch.alias("sketch"))
            left, named = named, named.join(own, F.col("node") == F.col("_n")).drop("_n")
            if sizes is None:
                named = named.withColumn("_size", F.lit(None).cast("int")).withColumn("_bits", F.lit(None).cast("array<long>"))
            else:
                named = named.join(sizes.select(F.col("node").alias("_n"), F.col("size").alias("_size"), F.col("bits").alias("_bits")),
                                   F.col("node") == F.col("_n")).drop("_n")
            if wider is None:
                named = named.withColumn("wide", F.lit(None).cast("array<long>"))
            else:
                crowds = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CROWD).select("bucket")
                more = wider(left.join(crowds, "bucket", "left_semi").select("node").distinct())
                more = more if sizes is not None else more.withColumn("wide", _planes(F.col("wide"), wide_longs))
                named = named.join(more.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").drop("_n")
            named = written(named, folder)
            chosen = named.filter(F.col("root") != F.col("_main")).select(
                F.col("bucket").alias("_bucket"), F.col("node").alias("a"), F.col("root").alias("_ra"), F.col("_size").alias("_other"),
                F.col("_bits").alias("_beside"), F.col("bands").alias("_bands"), F.col("sketch").alias("_sketch"), F.col("wide").alias("_wide"))
            once = (F.col("root") == F.col("_main")) | (F.col("a") < F.col("node"))
            near = F.lit(True) if sizes is None else _may_be_alike(F.col("_size"), F.col("_other"), F.col("_bits"), F.col("_beside"), ratio)
            near = near & (_agreeing(F.col("sketch"), F.col("_sketch"), longs) >= least) if longs else near
            if wider is not None:
                both = F.col("wide"), F.col("_wide")
                more = _agreeing(*both, wide_longs) >= wide_least if sizes is None else \
                    _may_be_alike(F.col("_size"), F.col("_other"), *both, ratio, wide_longs)
                near = near & F.coalesce(more, F.lit(True))
            meet = meet & once & near & (F.array_min(F.array_intersect("bands", "_bands")) == F.col("bucket"))
        pairs = named.join(chosen, meet).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select(F.col("a").alias("_ta"), F.col("b").alias("_tb")),
                               (F.col("a") == F.col("_ta")) & (F.col("b") == F.col("_tb")), "left_anti")
        if not last and sizes is not None:
            pairs = _possible(pairs, sizes, ratio)
        pairs = written(pairs, folder)
        found = written(similar(pairs), folder)
        # the components so far stand for the links found before
        label = components(found if label is None else found.unionByName(
            label.select(F.col("node").alias("a"), F.col("root").alias("b"))), folder)
        if not last:
            tested = pairs if tested is None else tested.unionByName(pairs)
            # a centre was compared with all others of its bucket
            members = named.join(chosen.select("_bucket", F.col("a").alias("_centre")),
                                 (F.col("bucket") == F.col("_bucket")) & (F.col("node") == F.col("_centre")), "left_anti") \
                .select("bucket", "node", "_rank")
    return label
