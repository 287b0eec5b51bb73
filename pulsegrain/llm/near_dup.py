"""Near-duplicate documents: MinHash bands give candidates, Bayesian verification prunes them, full sets confirm.

1. One pass over the texts makes, per row, the set of its word shingles (64-bit hashes), a 128-bit digest of the set,
   a MinHash signature and its band keys. Rows with equal sets are one node from here on.
2. In each band bucket one node is compared with the others (a star, not all pairs), but not if earlier links
   already put both in one component (``_spanning``). A candidate pair brings its signatures, which are compared in batches: after each batch the number of equal values tells how likely
   a similarity of at least the threshold still is (uniform prior); below ``miss`` the pair is dropped. Survivors are
   confirmed on their full shingle sets, made again from the texts.
3. Confirmed links give components. Buckets whose nodes then lie in several components are not finished: there, nodes
   outside the bucket's largest component meet the nodes of other components. In buckets of more than ``large`` nodes
   they do so only where their differences allow a link, which the differences then decide (``_by_difference``).
   Components are then made from all links. Tables that are not part of the result are removed on the way.

A pair at the threshold shares no band with a probability of 3e-6; a batch drops it with at most ``miss``. Nothing else
is lost: there is no limit on buckets, candidates or group sizes.

Defined cases: NULL or wordless texts have no shingles, link with nothing, and are their own component. Fewer words than
a shingle takes: the whole sequence is the only one. Rows with a NULL id join groups; the component takes the smallest
id that is not NULL. Repeated rows are one node, of which ``keeper`` marks one row. Clashing column names do no
harm: the row travels in a struct.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrain.llm.common import LOWERED, passing, staged
from pulsegrain.llm.components import components
from pulsegrain.session import work_dir
from pulsegrain.sources.store import remove

SIGNED = "n bigint, digest binary, signature binary, bands array<bigint>"
REMEMBERED = 1 << 16
LOCAL = 32


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80
    rows: int = 5
    bands: int = 32
    batch: int = 32
    miss: float = 1e-6
    large: int = 64
    seed: int = 1


class Shingler:
    """Shingle sets as sorted 64-bit hashes. Hashes of words are remembered, at most ``REMEMBERED``."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def hashes(self, text: bytes | None) -> np.ndarray:
        words = text.translate(LOWERED).split() if text else []
        known, out = self.known, []
        for word in words:
            value = known.get(word)
            if value is None:
                value = xxhash.xxh3_64_intdigest(word)
                if len(known) < REMEMBERED:
                    known[word] = value
            out.append(value)
        h = np.array(out, np.uint64)
        k = min(self.words, len(h))
        if not k:
            return h
        mixed = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            mixed = (mixed ^ h[i:len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def signature(low: np.ndarray) -> bytes:
    """One byte of each minimum. The more values, the nearer to zero their minimum: its upper bytes say little, so it is
    mixed first. Different minima still agree in a byte with a chance of 1 in 256."""
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


class Signer:
    def __init__(self, s: Settings):
        draw = np.random.default_rng(s.seed)
        n = s.rows * s.bands
        self.settings, self.shingler = s, Shingler(s.words)
        self.factor = draw.integers(0, 1 << 32, n, np.uint32) | np.uint32(1)
        self.shift = draw.integers(0, 1 << 32, n, np.uint32)
        self.band = draw.integers(0, 1 << 63, s.rows, np.uint64) | np.uint64(1)

    def sign(self, text: bytes | None) -> dict:
        shingles = self.shingler.hashes(text)
        if not len(shingles):
            return {"n": 0, "digest": None, "signature": None, "bands": []}
        low = np.full(len(self.factor), 0xFFFFFFFF, np.uint32)
        folded = (shingles >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(folded), 256):  # in slices that stay in the cache, for texts of any length
            np.minimum(low, (self.factor[:, None] * folded[None, i:i + 256] + self.shift[:, None]).min(axis=1), out=low)
        rows = low.reshape(self.settings.bands, self.settings.rows).astype(np.uint64) + np.uint64(1)
        keys = np.arange(1, self.settings.bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for j in range(self.settings.rows):
            keys = (keys ^ rows[:, j]) * self.band[j]
            keys ^= keys >> np.uint64(32)
        return {"n": len(shingles), "digest": xxhash.xxh3_128_digest(shingles.tobytes()),
                "signature": signature(low), "bands": keys.view(np.int64)}


def least_matches(s: Settings) -> list[tuple[int, int]]:
    """(values compared, fewest equal ones with which the posterior chance of the threshold is at least ``miss``).

    Bytes are equal with a chance of t + (1 - t) / 256 at similarity t. With a uniform prior, the chance that the
    similarity is at least t after m of n equal values is that of at most m successes in n + 1 trials of this.
    """
    t, total, out = s.percent / 100, s.rows * s.bands, []
    t += (1 - t) / 256
    for n in [*range(s.batch, total, s.batch), total]:
        chance, m = 0.0, -1
        while chance < s.miss:
            m += 1
            chance += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log(1 - t))
        out.append((n, m))
    return out


def _sign_udf(s: Settings):
    made = []

    def sign(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Signer(s))
        rows = [made[0].sign(t.as_py()) for t in texts.cast(pa.binary())]
        kinds = {"n": pa.int64(), "digest": pa.binary(), "signature": pa.binary(), "bands": pa.list_(pa.int64())}
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], v) for k, v in kinds.items()], names=list(kinds))

    return F.arrow_udf(sign, SIGNED)


def _likely_udf(s: Settings):
    steps = least_matches(s)

    def likely(left: pa.Array, right: pa.Array) -> pa.Array:
        a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(len(x), -1) for x in (left, right))
        alive, equal, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
        for n, least in steps:
            equal[alive] += (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
            alive, done = alive[equal[alive] >= least], n
        out = np.zeros(len(a), bool)
        out[alive] = True
        return pa.array(out)

    return F.arrow_udf(likely, "boolean")


def _similar_udf(s: Settings):
    shingler = Shingler(s.words)

    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out, text, first = [], None, None
        for a, b in zip(left.cast(pa.binary()), right.cast(pa.binary())):
            a = a.as_py()
            if first is None or a != text:
                text, first = a, shingler.hashes(a)
            second = shingler.hashes(b.as_py())
            common = len(np.intersect1d(first, second, assume_unique=True))
            out.append(100 * common >= s.percent * (len(first) + len(second) - common))
        return pa.array(out, pa.bool_())

    return F.arrow_udf(similar, "boolean")


def _sized(a: str, b: str, s: Settings) -> Column:
    """Sets of these sizes can reach the threshold."""
    return F.expr(f"100 * least({a}, {b}) >= {s.percent} * greatest({a}, {b})")


def _confirmed(pairs: DataFrame, by_uid: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) that are links: signatures first, then whole texts of what survives."""
    spark = pairs.sparkSession
    sides = [by_uid.select(F.col("uid").alias(x), F.col("signature").alias(f"s{x}")) for x in "ab"]
    near = pairs.join(sides[1], "b").join(sides[0], "a")
    likely = staged(spark, near.where(_likely_udf(s)(F.col("sa"), F.col("sb"))).select("a", "b"), "likely-pairs")
    # Only texts of surviving pairs take part in the joins to come.
    wanted = likely.select(F.col("a").alias("uid")).union(likely.select("b")).distinct()
    bodies = staged(spark, by_uid.select("uid", "body").join(wanted, "uid", "left_semi"), "likely-texts", compression="zstd")
    texts = [bodies.select(F.col("uid").alias(x), F.col("body").alias(f"t{x}")) for x in "ab"]
    both = likely.join(texts[1], "b").join(texts[0], "a")
    return staged(spark, both.where(_similar_udf(s)(F.col("ta"), F.col("tb"))).select("a", "b"), "links")


def _spanning(pairs: DataFrame, by_uid: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(links, member) of the star pairs. Members of a large group share most of its buckets and would meet as many centres.
    First each node meets one, that which most nodes could meet; then only pairs that are still in different components."""
    spark = pairs.sparkSession
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    times = staged(spark, both.groupBy(F.col("b").alias("centre")).agg(F.count(F.lit(1)).alias("times")), "meetings")
    best = both.join(times, F.col("b") == F.col("centre")).groupBy("a").agg(F.max(F.struct("times", "b"))["b"].alias("b"))
    first = staged(spark, best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "first-pairs")
    links = _confirmed(first, by_uid, s)
    member = staged(spark, components(links), "components")
    left, right = (member.select(F.col("node").alias(f"n{x}"), F.col("component").alias(f"c{x}")) for x in "ab")
    apart = pairs.join(first, ["a", "b"], "left_anti").join(left, F.col("a") == F.col("na"), "left").join(right, F.col("b") == F.col("nb"), "left")
    apart = staged(spark, apart.where("coalesce(ca, a) != coalesce(cb, b)").select("a", "b"), "apart-pairs")
    if apart.isEmpty():
        return links, member
    links = links.union(_confirmed(apart, by_uid, s))
    return links, staged(spark, components(links), "components")


def _by_uid(base: DataFrame, text: Column, name: str, place: str) -> DataFrame:
    """(uid, signature, body) as a table bucketed by uid: texts are moved once, later joins on uid leave them where they are."""
    spark = base.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = base.where("n > 0").select("uid", "signature", text.alias("body")).repartition(n, "uid")
    rows.write.bucketBy(n, "uid").sortBy("uid").options(path=place, compression="zstd").saveAsTable(name)
    return spark.table(name)


def _open_buckets(keys: DataFrame) -> DataFrame:
    """Rows (key, uid, size, centre) of the buckets with two nodes or more. Each bucket's centre is the node whose number,
    xor the key, is least: another one in each bucket, so that a node meets many members of a large group."""
    mixed = F.col("uid").bitwiseXOR(F.col("key"))
    first = keys.groupBy(F.col("key").alias("k")).agg(F.min(mixed).alias("low"), F.max(mixed).alias("high")).where("low != high")
    first = staged(keys.sparkSession, first.select("k", F.col("low").bitwiseXOR(F.col("k")).alias("centre")), "bucket-centres")
    return staged(keys.sparkSession, keys.join(first, F.col("key") == F.col("k")).drop("k"), "open-buckets")


def _stars(open_: DataFrame, s: Settings) -> DataFrame:
    """(a, b): the centre of each bucket with each other node whose set can be similar."""
    centres = open_.where("uid = centre").select(F.col("key").alias("k"), F.col("n").alias("m"))
    centres = staged(open_.sparkSession, centres, "centre-sizes")
    pairs = open_.where("uid != centre").join(centres, F.col("key") == F.col("k")).where(_sized("n", "m", s))
    return pairs.select(F.least("centre", "uid").alias("a"), F.greatest("centre", "uid").alias("b")).distinct()


def _difference_udf(s: Settings):
    shingler = Shingler(s.words)

    def difference(own: pa.Array, reference: pa.Array) -> pa.Array:
        out, text, first = [], None, None
        for a, b in zip(own.cast(pa.binary()), reference.cast(pa.binary())):
            b = b.as_py()
            if first is None or b != text:
                text, first = b, shingler.hashes(b)
            out.append({"m": len(first), "d": np.setxor1d(first, shingler.hashes(a.as_py()), assume_unique=True).view(np.int64)})
        kinds = {"m": pa.int64(), "d": pa.list_(pa.int64())}
        return pa.StructArray.from_arrays([pa.array([r[k] for r in out], v) for k, v in kinds.items()], names=list(kinds))

    return F.arrow_udf(difference, "m bigint, d array<bigint>")


def _often(batches):
    """(reference, size, e, often) of the differences frequent in a batch, counted within it. What more than a sixteenth of a
    group's members have is told in full, less at most the batches where under a ``LOCAL``-th of the group's members have it."""
    for batch in batches:
        reference, size, lengths = (x.to_numpy(zero_copy_only=False) for x in (batch["reference"], batch["size"], batch["d"].value_lengths()))
        element, owner = batch["d"].flatten().to_numpy(zero_copy_only=False), np.repeat(reference, lengths)
        order = np.lexsort((element, owner))
        element, owner = element[order], owner[order]
        new = np.ones(len(order), bool)
        new[1:] = (element[1:] != element[:-1]) | (owner[1:] != owner[:-1])
        start = np.flatnonzero(new)
        times = np.diff(np.append(start, len(order)))
        groups, first, members = np.unique(reference, return_index=True, return_counts=True)
        at = np.searchsorted(groups, owner[start])
        kept = LOCAL * times > members[at]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (groups[at][kept], size[first][at][kept], element[start][kept], times[kept])],
                                         names=["reference", "size", "e", "often"])


def _by_difference(members: DataFrame, by_uid: DataFrame, s: Settings) -> DataFrame:
    """The links (a, b) of one group (reference, uid, n, component, times), in different components.

    The group's core r is its member in most buckets, less and plus what differs from it in most members. With the differences
    X = x ^ r and Y = y ^ r, x ^ y = X ^ Y. Sets are linked if |x ^ y| <= c (|x| + |y|), c = (100 - percent) / (100 + percent):
    a link needs |X & Y| >= (u(x) + u(y)) / 2 where u(x) = |X| - c |x|, and if that sum is not positive it is a link.
    So with the least u, that of the node z, each x of u(x) <= -u(z) is linked with z, and gives that one pair. Any other x
    needs |X & Y| >= (u(x) + u(z)) / 2 and, as |Y| >= |X & Y|, |X & Y| >= (u(x) - c |r|) / (1 + c); a partner y of such an x
    needs |X & Y| > (u(y) - u(z)) / 2, and what any x needs if it is such an x itself. All sets are put in one order, what is
    frequent in the group first, the rest by value. If X and Y have k common elements, the last of them has a place of at least k
    in both: only elements from the place on that a node needs are exploded, and nodes are paired by one whose place in both
    reaches (u(x) + u(y)) / 2. In a group of near copies these are the few that have the same edits. Which elements count as
    frequent bears on the work only. Pairs are decided by |x ^ y| = |X| + |Y| - 2 |X & Y|, without texts.
    """
    spark, c = by_uid.sparkSession, (100 - s.percent) / (100 + s.percent)
    central = members.groupBy(F.col("reference").alias("r")).agg(F.max(F.struct("times", "uid"))["uid"].alias("pivot"), F.count(F.lit(1)).alias("size"))
    members = staged(spark, members.join(central, F.col("reference") == F.col("r")).drop("r"), "members-and-pivots")
    bodies = staged(spark, by_uid.select("uid", "body").join(members.select("uid").distinct(), "uid", "left_semi"), "group-texts", compression="zstd")
    both = (members.join(bodies.withColumnRenamed("body", "own"), "uid")
            .join(bodies.select(F.col("uid").alias("pivot"), F.col("body").alias("other")), "pivot"))
    made = both.withColumn("made", _difference_udf(s)(F.col("own"), F.col("other"))).select("reference", "uid", "n", "component", "size", "made.*")
    made = staged(spark, made, "differences")

    often = made.select("reference", "size", "d").mapInArrow(_often, "reference bigint, size bigint, e bigint, often bigint")
    often = often.groupBy("reference", "e").agg(F.sum("often").alias("often"), F.first("size").alias("size")).where("16 * often > size")
    # Elements in which most members differ: at most twice the mean number of differences. From the core differ, in a usual
    # element, those members that do not differ in it from the pivot. Frequent ones: at most 16 times that mean, and the usual ones.
    often = often.withColumn("held", F.expr("if(2 * often > size, size - often, often)"))
    lists = often.groupBy(F.col("reference").alias("r")).agg(
        F.collect_list(F.expr("if(2 * often > size, e, null)")).alias("usual"),
        F.array_sort(F.collect_list(F.expr("if(16 * held > size, struct(-held as less, e), null)")))["e"].alias("frequent"))
    none = F.array().cast("array<bigint>")
    core = made.join(staged(spark, lists, "frequent-differences"), F.col("reference") == F.col("r"), "left")
    core = core.withColumns({"usual": F.coalesce("usual", none), "frequent": F.coalesce("frequent", none)})
    core = core.withColumn("d", F.concat(F.array_except("d", "usual"), F.array_except("usual", "d")))
    core = core.select("reference", "uid", "n", "component", (F.col("m") + F.size("usual")).alias("m"),
                       F.concat(F.array_intersect("frequent", "d"), F.array_sort(F.array_except("d", "frequent"))).alias("d"))
    core = staged(spark, core.withColumn("u", F.size("d") - c * F.col("n")), "core-differences")
    least = core.groupBy(F.col("reference").alias("r")).agg(F.min(F.struct("u", "uid", "component")).alias("z"))
    # The bounds are rounded up; the small number keeps them right where the division is not exact.
    need = lambda bound: F.greatest(F.lit(1), F.ceil(bound - 1e-6)).cast("int")
    u, uz = F.col("u"), F.col("z.u")
    need_x, need_y = need(F.greatest((u + uz) / 2, (u - c * F.col("m")) / (1 + c))), need((u - uz) / 2)
    core = core.join(least, F.col("reference") == F.col("r")).withColumn("far", u + uz > 1e-6)
    core = staged(spark, core.select(
        "reference", "uid", "n", "component", "d", "u", F.col("z.uid").alias("z"), F.col("z.component").alias("cz"), "far",
        F.when(F.col("far"), need_x).otherwise(need_y).alias("need"),
        F.when(F.col("far"), F.greatest(need_x, need_y)).otherwise(need_y).alias("need_y")), "bounded-differences")
    direct = core.where("not far and component != cz").select("reference", F.least("uid", "z").alias("a"), F.greatest("uid", "z").alias("b"))

    # No difference has a place beyond their number, so a node with fewer than it needs has no partner.
    each = core.where("size(d) >= need").select("reference", "uid", "n", "component", "u", "far", "need", "need_y",
                                                F.posexplode(F.slice("d", F.col("need"), F.size("d"))).alias("at", "e"))
    ranked = staged(spark, each.withColumn("place", F.col("need") + F.col("at")).drop("need", "at"), "rare-differences")
    name = lambda end: [F.col(k).alias(k + end) for k in ("uid", "n", "component", "u", "place")]
    x = ranked.where("far").select("reference", "e", *name("x"))
    y = ranked.where("place >= need_y").select(F.col("reference").alias("r"), F.col("e").alias("f"), *name("y"))
    pairs = x.join(y, F.expr("reference = r and e = f and componentx != componenty and 2 * least(placex, placey) >= ux + uy - 1e-6") & _sized("nx", "ny", s))
    pairs = direct.union(pairs.select("reference", F.least("uidx", "uidy").alias("a"), F.greatest("uidx", "uidy").alias("b"))).distinct()
    pairs = staged(spark, pairs, "difference-pairs")
    side = lambda end: core.select(F.col("reference").alias("r"), F.col("uid").alias(end), F.col("n").alias(f"n{end}"), F.col("d").alias(f"d{end}"))
    first = pairs.join(side("a").withColumnRenamed("r", "reference"), ["reference", "a"])
    both = first.join(side("b").withColumnRenamed("r", "reference"), ["reference", "b"])
    apart = F.size("da") + F.size("db") - 2 * F.size(F.array_intersect("da", "db"))
    linked = 100 * (F.col("na") + F.col("nb") - apart) >= s.percent * (F.col("na") + F.col("nb") + apart)
    return staged(spark, both.where(linked).select("a", "b").distinct(), "difference-links")


def _rest(open_: DataFrame, by_uid: DataFrame, member: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Of one bucket, in different components, not both in the bucket's largest one: pairs (a, b) to confirm, and links."""
    spark = open_.sparkSession
    placed = open_.join(member, F.col("uid") == F.col("node"), "left").select("key", "uid", "n", F.coalesce("component", "uid").alias("component"))
    placed = staged(spark, placed, "placed")
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("members"))
    top = sizes.groupBy(F.col("key").alias("k")).agg(F.max(F.struct("members", "component")).alias("top"), F.sum("members").alias("size"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    top = staged(spark, top.select("k", "size", F.col("top.component").alias("largest")), "largest-components")
    marked = staged(spark, placed.join(top, F.col("key") == F.col("k")).drop("k"), "marked-rows")
    small = marked.where(F.col("size") <= s.large)
    outside = small.where("component != largest").select("key", F.col("uid").alias("x"), F.col("component").alias("cx"), F.col("n").alias("nx"))
    inside = small.select(F.col("key").alias("k"), F.col("uid").alias("y"), F.col("component").alias("cy"), F.col("n").alias("ny"))
    pairs = outside.join(inside, F.expr("key = k and cx != cy") & _sized("nx", "ny", s))
    pairs = staged(spark, pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "small-pairs")
    # A large component is the reference of all its buckets: their nodes are one group.
    members = marked.where(F.col("size") > s.large).groupBy(F.col("largest").alias("reference"), "uid", "n", "component").agg(F.count(F.lit(1)).alias("times"))
    return pairs, _by_difference(staged(spark, members, "members"), by_uid, s)


def _fates(base: DataFrame, own_id: Column, text: Column, s: Settings) -> DataFrame:
    """(set, size, keep): for each set of shingles the row that stays; written."""
    spark, name, place = base.sparkSession, f"near_dup_{uuid.uuid4().hex}", work_dir(base.sparkSession, "by-uid")
    order = F.struct(own_id.isNull().alias("no_id"), own_id.alias("id"), F.col("uid"))
    sets = staged(spark, base.where("n > 0").groupBy("digest", "n").agg(F.min("uid").alias("node"), F.min(order).alias("first")), "sets")
    nodes = base.select("uid", "n", "bands").join(sets.select(F.col("node").alias("uid")), "uid", "left_semi")
    buckets = _open_buckets(staged(spark, nodes.select("uid", "n", F.explode("bands").alias("key")), "band-keys"))
    try:
        by_uid = _by_uid(base, text, name, place)
        pairs = staged(spark, _stars(buckets, s), "star-pairs")
        links, member = _spanning(pairs, by_uid, s)
        more, found = _rest(buckets, by_uid, member, s)
        more = staged(spark, more.join(pairs, ["a", "b"], "left_anti"), "rest-pairs")
        if not more.isEmpty() or not found.isEmpty():
            links = links.union(found).union(_confirmed(more, by_uid, s))
            member = staged(spark, components(links), "components")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, place)
    placed = sets.join(member, "node", "left").select("digest", F.col("n").alias("size"), "first", F.coalesce("component", "node").alias("component"))
    placed = staged(spark, placed, "placed-sets")
    named = staged(spark, placed.groupBy(F.col("component").alias("of")).agg(F.min("first").alias("keep")), "kept-rows")
    # Written, so that the last join meets plain tables and can split the rows of a hot set.
    fates = placed.join(named, F.col("component") == F.col("of")).select(F.col("digest").alias("set"), "size", "keep")
    return staged(spark, fates, "fates", lasting=True)


def classes(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, n_shingles, component_id, keeper): each row of ``docs`` as a struct, the size of its set, the smallest
    id of its component, and whether it is the one row that stays."""
    spark, s = docs.sparkSession, settings
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    signed = rows.withColumn("made", _sign_udf(s)(F.col(f"row.`{text}`")))
    # The number of a row is fixed by writing it.
    base = staged(spark, signed.select("row", "made.*", F.monotonically_increasing_id().alias("uid")), "signed", compression="zstd")
    own_id = F.col(f"row.`{doc_id}`")
    with passing(spark):
        fate = _fates(base, own_id, F.col(f"row.`{text}`"), s)
    out = base.select("row", "n", "digest", "uid").join(fate, F.expr("digest = set and n = size"), "left")
    return out.select("row", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("keep.id")).otherwise(own_id).alias("component_id"),
                      F.when(F.col("n") > 0, F.col("keep.uid") == F.col("uid")).otherwise(True).alias("keeper"))


def drop_near_duplicates(docs: DataFrame, settings: Settings = Settings(), **columns: str) -> DataFrame:
    """One row of each group, with the columns of ``docs``."""
    return classes(docs, settings, **columns).where("keeper").select("row.*")
