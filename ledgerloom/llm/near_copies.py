"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint: the text's shingles are hashed with XXH64 (seed 42); a bit is 1 if set in over half of them.
Two fingerprints link if at most ``radius`` of 64 bits differ.

Candidates come from 2 ** (radius + 1) - 1 tables.  Each bit position i gets a vector m(i) of radius + 1
bits; table v keeps the bits with odd parity of v & m(i).  The vectors of any ``radius`` positions span less
than the whole space, so some v is orthogonal to them all: that table ignores the differing bits and the
pair meets there.  No pair within the radius is missed.

``near_copies`` works on distinct fingerprints.  Buckets of up to ``small_bucket`` fingerprints are compared
directly.  For a radius of 1 or 2 a larger bucket is never compared pair by pair: each member is put at every
centre that differs from it in one bit that the table ignores, or none.  Members at one centre are at most 65
and all within 2 bits of each other, and any two members within 2 bits share a centre; so linking each to the
smallest at its centre keeps every connection with linearly many rows.

For wider radii, and where links need a check of the texts, large buckets are settled by leaders
(``_connect``): a leader is compared with every member outside its component, and at last every member outside
the largest component leads.  That is exact, and a bucket that holds one group of copies, however large, is done
after a few leaders.

``keep_similar_once`` is the same search for the rule "a Jaccard similarity of at least 0.8 of the sets of
five-word shingles".  Its fingerprint has the distinct words as features, since one changed word changes one of
them but five shingles, and a radius of 6.  A second fingerprint of the same words, by other hashes, has tables of its
own, since either may happen to differ in more bits.  Members of small buckets carry a sketch of their shingles, and only
pairs that it lets pass become rows; these are verified on their whole shingle sets.  Texts that
meet in large buckets are dealt anew by their rarest shingles (``_by_rare_shingles``), since many are within the
radius but below 0.8; no pair is lost by that.

Components come from rounds of large-star and small-star over the links, in tables of the shared folder;
nothing about documents goes to the driver but counts.

Defined results: null and empty texts have no words and fingerprint zero, linked like any other; a null id
gets a component like any other row, nulls are never the smallest unless all ids of it are null; repeated
rows share a component, and one of them stays; equal ids with different texts are different rows; an empty
table gives no rows; columns of the input may have any names, those of the result are the documents' own
(``near_copies``: the id's, ``fp`` and ``component_id``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, discard, settle, text_bytes

_CHUNK = 4096
#: Turns in which leaders come from inside a bucket's largest component.
INNER_TURNS = 3
#: Longs of a sketch of a set of shingles.
WORDS = 16
#: Of the two fingerprints of a text's words.
SEEDS = (42, 43)
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def _shingles(words: list[bytes], width: int) -> Iterator[bytes]:
    return map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else iter([b" ".join(words)])


def fingerprint_of(text: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of one text: ASCII-lower-cased words, shingles of ``width`` words, repeats included."""
    words = text.lower().split()
    return majority(_shingles(words, width), seed) if words else 0


def majority(features: Iterator[bytes], seed: int = 42) -> int:
    """The bits that are set in over half of the features' hashes."""
    total, ones, digest = 0, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in features), np.uint64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i : i + _CHUNK]
        total += len(part)
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(_BITS[ones * 2 > total].sum(dtype=np.uint64))


def fingerprints(df: DataFrame, text_column: str = "text", into: str = "fp", width: int = 3) -> DataFrame:
    """Append the fingerprint as a signed 64-bit integer."""

    @F.arrow_udf("bigint")
    def fingerprint(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            values = np.array([fingerprint_of(as_bytes(x.as_py()), width) for x in batch], np.uint64)
            yield pa.array(values.view(np.int64), pa.int64())

    return df.withColumn(into, fingerprint.asNondeterministic()(text_bytes(text_column)))


def covering_masks(radius: int, seed: int = 6) -> list[int]:
    """Bit masks such that any ``radius`` bit positions are all outside at least one mask, as signed integers.

    The vectors are dealt evenly over the nonzero ones, so every mask keeps about half of the bits; for a radius
    of 6 they are the 64 with the highest bit set, so every mask keeps just half of the bits, and one keeps all
    (the words of the first-order Reed-Muller code of length 64).
    """
    if not 1 <= radius <= 6:
        raise ValueError("the radius must be 1 to 6")
    size = 1 << (radius + 1)
    vectors = np.arange(64) + 64 if radius == 6 else np.random.default_rng(seed).permutation(np.arange(64) % (size - 1) + 1)
    masks = []
    for v in range(1, size):
        mask = sum(1 << i for i in range(64) if bin(v & int(vectors[i])).count("1") & 1)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _flips(mask: int) -> list[int]:
    """0 and each single bit outside ``mask``, as signed integers."""
    bits = [1 << i for i in range(64) if not (mask >> i) & 1]
    return [0] + [b - (1 << 64) if b >> 63 else b for b in bits]


def links(distinct: DataFrame, radius: int = 2, small_bucket: int = 24, column: str = "fp") -> DataFrame:
    """Links (a, b), a < b, that connect exactly the components of "at most ``radius`` bits differ".

    ``distinct`` has each fingerprint once.
    """
    if radius not in (1, 2):
        raise ValueError("links by centres are for a radius of 1 or 2")
    masks = covering_masks(radius)
    keyed = distinct.select(
        F.col(column).alias("fp"),
        F.explode(F.array(*[F.struct(F.lit(t).cast("int").alias("t"), F.col(column).bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])).alias("k"),
    ).select("fp", "k.t", "k.key")
    # Sums of counts don't gather a bucket; only buckets of more than one member go on.
    size = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    member = settle(keyed.join(size, ["t", "key"]), "copies-buckets")
    close = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= radius
    pairs = F.flatten(F.transform("all", lambda a: F.transform(F.filter("all", lambda b: (a < b) & close(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    small = (  # compared inside the row, so only links become rows
        member.filter(F.col("n") <= small_bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("all"))
        .select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    )
    flips = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in _flips(m)]) for m in masks])
    centred = member.filter(F.col("n") > small_bucket).select("fp", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip"))
    centred = centred.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre")).distinct()
    large = (  # at most 65 fingerprints differ from a centre in one bit or none
        centred.groupBy("centre").agg(F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
        .select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter(F.col("a") < F.col("b"))
    )
    if radius == 1:  # then each pair within 1 bit has one of the two as a centre, but others meet there too
        large = centred.filter("fp != centre").join(distinct.select(F.col(column).alias("centre")), "centre", "left_semi").select(F.least("fp", "centre").alias("a"), F.greatest("fp", "centre").alias("b"))
    return small.unionByName(large).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of the component.

    Rounds of large-star then small-star until the links are stars about their smallest nodes.
    """
    now = settle(edges.select("a", "b").filter("a != b"), "copies-links")
    seen = None
    for _ in range(most_rounds):
        both = now.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        then, now = now, settle(small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "copies-links")
        discard(then)
        state = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if seen == (state["n"], state["h"]):
            break
        seen = (state["n"], state["h"])
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    star = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct()).distinct()


def _near(a: Column, b: Column, bits: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= bits


def _meetings(classes: DataFrame, radius: int) -> DataFrame:
    """Members (``key``, ``members``, ``node``, ``sim``) of the buckets that hold more than one of ``classes`` (``node``, ``sims``: an array of fingerprints).

    Each fingerprint of the array has tables of its own.  Rows are dealt by table and masked bits once, sorted, and
    kept if a neighbour has the same key: nothing is held, and most rows, which are alone, go no further.
    """
    masks = F.array(*[F.lit(m).cast("bigint") for m in covering_masks(radius)])
    each = classes.select("node", F.posexplode("sims").alias("s", "sim"))
    keyed = each.select("node", "s", "sim", F.posexplode(masks).alias("t", "mask")).select(F.xxhash64("s", "t", F.col("sim").bitwiseAND(F.col("mask"))).alias("key"), "node", "sim")
    near = Window.partitionBy("key").orderBy("key")
    met = keyed.withColumn("__before", F.lag("key").over(near)).withColumn("__after", F.lead("key").over(near)).filter("__before is not null or __after is not null")
    met = settle(met.select("key", "node", "sim"), "copies-met")
    member = settle(met.join(met.groupBy("key").agg(F.count("*").alias("members")), "key"), "copies-buckets")
    discard(met)
    return member


def _neighbours(member: DataFrame, small_bucket: int, reach: int) -> DataFrame:
    """``key``, ``node``, ``sim`` of the buckets of up to ``small_bucket`` members, without those that no other member is within ``reach`` bits of."""
    beside = lambda a: F.exists("all", lambda b: (a["node"] != b["node"]) & _near(a["sim"], b["sim"], reach))
    small = member.filter(F.col("members") <= small_bucket).groupBy("key").agg(F.collect_list(F.struct("node", "sim")).alias("all"))
    return small.select("key", F.explode(F.filter("all", beside)).alias("m")).select("key", "m.node", "m.sim")


def _pairs_in_small(near: DataFrame, reach: int, possible: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Pairs (a, b) of the small buckets ``near`` (``key``, ``node``, ``sim`` and more), at most ``reach`` bits apart and ``possible``.

    They are compared inside the bucket's row, so that only those that pass become rows.
    """
    one, node = F.struct(*[c for c in near.columns if c != "key"]), lambda x, name: x["node"].alias(name)
    close = lambda a, b: (a["node"] < b["node"]) & _near(a["sim"], b["sim"], reach)
    passes = (lambda a, b: F.when(close(a, b), possible(a, b)).otherwise(False)) if possible else close
    pairs = F.flatten(F.transform("all", lambda a: F.transform(F.filter("all", lambda b: passes(a, b)), lambda b: F.struct(node(a, "a"), node(b, "b")))))
    return near.groupBy("key").agg(F.collect_list(one).alias("all")).select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def _connect(small: DataFrame, large: DataFrame, meet: Callable[[DataFrame, DataFrame], DataFrame], verified: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of everything that has links: the pairs ``small`` and those inside the buckets ``large`` (``key``, ``node`` and more)
    that ``meet`` finds (node, other) between members and leaders and ``verified`` lets pass.

    A bucket is open while its members are in more than one component.  In the first turns up to 4 ** turn leaders
    come from the component that most of them belong to and meet the others; then one leader of each other
    component, then all members outside it.  After that each pair of the bucket is in one component or has been
    compared.
    """
    found = settle(components(verified(small)), "copies-roots")
    led = None
    for turn in range(INNER_TURNS + 2):
        now = settle(large.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "copies-now")
        most = now.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("roots"))
        most = most.filter("roots > 1").select("key", F.col("m.root").alias("most"))
        rest = (now if led is None else now.join(led, ["key", "node"], "left_anti")).join(most, "key")
        outside = F.col("root") != F.col("most")
        if turn <= INNER_TURNS:
            slot = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(4**turn)) if turn < INNER_TURNS else F.col("root")
            leads = F.struct(F.xxhash64("node").alias("o"), "node", "root", *[c for c in large.columns if c not in ("key", "node")])
            lead = rest.filter(~outside if turn < INNER_TURNS else outside).groupBy("key", slot.alias("slot")).agg(F.min(leads).alias("l")).select("key", "l.*").drop("o")
        else:
            lead = rest.filter(outside).select(*now.columns)
        lead = settle(lead, "copies-leaders")
        tried = meet(now, lead).select(F.least("node_a", "node").alias("a"), F.greatest("node_a", "node").alias("b")).distinct()
        more = settle(verified(tried), "copies-more")
        had = settle(lead.select("key", "node") if led is None else led.unionByName(lead.select("key", "node")), "copies-led")
        if not more.isEmpty():
            joined = settle(components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "copies-roots")
            discard(found)
            found = joined
        discard(now, lead, more, *([led] if led is not None else []))
        led = had
    discard(led)
    return found


def _meet(now: DataFrame, lead: DataFrame, possible: Column) -> DataFrame:
    """(node, node_a) of members and leaders (their columns end in ``_a``) of one bucket that aren't in one component."""
    against = lead.select("key", *[F.col(c).alias(f"{c}_a") for c in lead.columns if c != "key"])
    return now.join(against, "key").filter((F.col("root") != F.col("root_a")) & possible).select("node", "node_a")


def _within(classes: DataFrame, radius: int, small_bucket: int) -> DataFrame:
    """(node, root) for fingerprints (``node``, ``sim``) at most ``radius`` bits apart, for any radius that masks cover."""
    member = _meetings(classes.select("node", F.array("sim").alias("sims")), radius)
    near = _near(F.col("sim"), F.col("sim_a"), radius)
    return _connect(_pairs_in_small(_neighbours(member, small_bucket, radius), radius), member.filter(F.col("members") > small_bucket).select("key", "node", "sim"), lambda now, lead: _meet(now, lead, near), lambda pairs: pairs)


def row_key(id_column: str, text_column: str) -> list[Column]:
    """What tells rows apart, without nulls: the id, null last, and a digest of the text."""
    kept = F.col(id_column)
    return [kept.isNull().alias("__no_id"), F.coalesce(kept.cast("bigint"), F.lit(0)).alias("__id"), F.coalesce(F.md5(F.col(text_column).cast("binary")), F.lit("")).alias("__digest")]


def _of_class(own: DataFrame, least: Column, radius: int, small_bucket: int) -> DataFrame:
    """One row per fingerprint of ``own``: ``fp``, ``first`` (``least`` of its rows) and ``root``."""
    classes = settle(own.groupBy("fp").agg(least.alias("first")), "copies-classes")
    roots = settle(components(links(classes, radius, small_bucket)) if radius <= 2 else _within(classes.select(F.col("fp").alias("node"), F.col("fp").alias("sim")), radius, small_bucket), "copies-roots")
    return classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, radius: int = 2, small_bucket: int = 24) -> DataFrame:
    """One row per document: id, ``fp``, ``component_id`` (the smallest id of its component)."""
    own = settle(fingerprints(docs.select(id_column, text_column), text_column, "fp", width).select(id_column, "fp"), "copies-fp")
    of_class = _of_class(own, F.min(id_column), radius, small_bucket)
    least = of_class.groupBy("root").agg(F.min("first").alias("component_id"))
    named = settle(of_class.join(least, "root").select("fp", "component_id"), "copies-named")
    return own.join(named, "fp").select(id_column, "fp", "component_id")


def keep_survivors(docs: DataFrame, of_class: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Of each ``root`` of ``of_class`` the row of ``docs`` with the least ``first`` (a struct of ``row_key``); of equal rows one.

    Texts are shuffled once, by id and digest, to meet the rows that stay; the join's order serves the ranking
    of equal rows too.
    """
    kept = settle(of_class.groupBy("root").agg(F.min("first").alias("first")).select("first.*"), "copies-kept")
    keys = ["__no_id", "__id", "__digest"]
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *row_key(id_column, text_column))
    found = carried.join(kept, keys, "left_semi").withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)))
    return found.filter("__nth = 1").select("__row.*")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, radius: int = 2, small_bucket: int = 24) -> DataFrame:
    """The documents without near copies by fingerprints alone: of each component one row stays.

    It is the row with the smallest id, null ids last, then with the smallest digest of the text.  So repeated
    and missing ids leave one row too.
    """
    own = fingerprints(docs.select(*row_key(id_column, text_column), F.col(text_column).alias("__t")), "__t", "fp", width)
    own = settle(own.select("__no_id", "__id", "__digest", "fp"), "copies-fp")
    of_class = _of_class(own, F.min(F.struct("__no_id", "__id", "__digest")), radius, small_bucket)
    return keep_survivors(docs, of_class, id_column, text_column)


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in _shingles(words, width)), np.uint64)) if words else np.zeros(0, np.uint64)


def word_prints(words: list[bytes]) -> list[int]:
    """The fingerprints of the distinct words by both seeds."""
    return [majority(iter(set(words)), seed) for seed in SEEDS]


def _word_fingerprints(text_column: str) -> Column:
    """``sim`` and ``sim2``: SimHash of the distinct words by two seeds; ``digest``: of the sequence of words."""

    @F.arrow_udf("struct<sim:bigint,sim2:bigint,digest:bigint>")
    def prints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = np.zeros((len(batch), 3), np.uint64)
            for i, x in enumerate(batch):
                if words := as_bytes(x.as_py()).lower().split():
                    rows[i] = *word_prints(words), xxhash.xxh64_intdigest(b" ".join(words), 1)
            yield pa.StructArray.from_arrays([pa.array(rows[:, k].view(np.int64), pa.int64()) for k in range(3)], names=["sim", "sim2", "digest"])

    return prints.asNondeterministic()(text_bytes(text_column))


def _sketch(found: np.ndarray) -> np.ndarray:
    """``64 * WORDS`` bits, of which each element sets one."""
    bits = np.zeros(64 * WORDS, np.uint8)
    bits[(found >> np.uint64(32)) % np.uint64(64 * WORDS)] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


def _sets(text: str, width: int) -> Column:
    kind = pa.struct([("shingles", pa.list_(pa.int64())), ("n", pa.int64()), ("bits", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<shingles:array<bigint>,n:bigint,bits:array<bigint>>")
    def shingles(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            for i in range(0, len(batch), 64):
                found = [shingle_set(as_bytes(x.as_py()), width) for x in batch.slice(i, 64)]
                yield pa.array([{"shingles": f.view(np.int64), "n": len(f), "bits": _sketch(f)} for f in found], kind)

    return shingles.asNondeterministic()(text_bytes(text))


def _sketches(elements: Column) -> Column:
    @F.arrow_udf("array<bigint>")
    def sketch(sets: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in sets:
            yield pa.array([_sketch(x.values.to_numpy(zero_copy_only=False).view(np.uint64)) for x in batch], pa.list_(pa.int64()))

    return sketch.asNondeterministic()(elements)


def may_be_similar(a: Callable[[str], Column], b: Callable[[str], Column], similarity: float, held: str = "n") -> Column:
    """False only for sets whose similarity is below ``similarity``.

    A bit that one sketch has and the other hasn't is an element at least that the other set lacks, which bounds
    the common elements from above.  ``held``: how many elements of a set its sketch is of; it holds all that any
    other set has.
    """
    lacking = lambda x, y: sum((F.bit_count(x("bits")[i].bitwiseAND(F.bitwise_not(y("bits")[i]))) for i in range(1, WORDS)), F.bit_count(x("bits")[0].bitwiseAND(F.bitwise_not(y("bits")[0]))))
    # common >= similarity * (n_a + n_b - common); the slack is for rounding and lets more pass, never less
    enough = lambda common: common * F.lit(1 + similarity) + 1e-6 >= F.lit(similarity) * (a("n") + b("n"))
    return enough(a(held)) & enough(b(held)) & enough(a(held) - lacking(a, b)) & enough(b(held) - lacking(b, a))


def _by_rare_shingles(large: DataFrame, similarity: float) -> DataFrame:
    """``large`` (``node``, ``sim``, ``n``, ``shingles``) dealt by its rarest shingles: ``key``, ``node``, ``sim``, ``n``, ``held``, ``bits``, ``short``.

    The prefix of a set is its rarest ``n - similarity * n + 1`` shingles, by one order of all shingles, and its
    short prefix the rarest ``n - 2 * similarity / (1 + similarity) * n + 1``.  Of two sets as similar as that, the
    short prefix of the smaller and the prefix of the larger meet.  Shingles of one text alone come first in that
    order and can't be common, so they are left out here and of the sketch (``held``: how many remain); a text with
    too many of them has no partner and no row.
    """
    each = large.select("node", F.explode("shingles").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("texts")).filter("texts > 1")
    held = each.join(shared, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("texts", "key"))).alias("common"))
    of = large.select("node", "sim", "n").join(held, "node").withColumn("held", F.size("common").cast("bigint"))
    length = lambda share: (F.col("held") - F.floor(F.lit(share) * F.col("n")) + 1).cast("int")
    of = of.withColumn("first", length(similarity)).withColumn("few", length(2 * similarity / (1 + similarity))).filter("first > 0")
    of = of.select("node", "sim", "n", "held", "few", F.slice("common", 1, F.col("first"))["key"].alias("keys"), F.col("common")["key"].alias("all"))
    of = settle(of.select("node", "sim", "n", "held", "few", "keys", _sketches(F.col("all")).alias("bits")), "copies-rare")
    keyed = of.select(F.posexplode("keys").alias("at", "key"), "node", "few").select("key", "node", (F.col("at") < F.col("few")).alias("short"))
    several = keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key")
    rows = settle(keyed.join(several, "key").join(of.drop("keys", "few"), "node"), "copies-keyed")
    discard(of)
    return rows


def keep_similar_once(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 6, small_bucket: int = 24) -> DataFrame:
    """The documents without near copies by shared shingles: of each component one row stays, by the rule of ``keep_one``.

    Two texts link if their sets of ``width``-word shingles have a Jaccard similarity of at least ``similarity``
    and one of the two fingerprints of their words differs in at most ``radius`` bits; all such pairs are found.
    Texts of equal words are one class from the start, so exact copies need no comparison.
    """
    narrow = docs.select(*row_key(id_column, text_column), _word_fingerprints(text_column).alias("s"))
    own = settle(narrow.select("__no_id", "__id", "__digest", F.col("s").alias("node")), "copies-own")
    classes = settle(own.groupBy("node").agg(F.min(F.struct("__no_id", "__id", "__digest")).alias("first")), "copies-classes")
    member = _meetings(classes.select("node", F.array("node.sim", "node.sim2").alias("sims")), radius)
    beside = settle(_neighbours(member, small_bucket, radius), "copies-beside")
    large = settle(member.filter(F.col("members") > small_bucket).select("node").distinct().withColumn("sim", F.col("node.sim")), "copies-large")
    nodes = beside.select("node").unionByName(large.select("node")).distinct()
    wanted = classes.join(nodes, "node", "left_semi").select("node", "first.*")
    keys = ["__no_id", "__id", "__digest"]
    texts = docs.select(*row_key(id_column, text_column), F.col(text_column).alias("__t")).join(wanted, keys)
    texts = texts.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys, "node").orderBy("node"))).filter("__nth = 1")
    sets = settle(texts.select("node", _sets("__t", width).alias("s")).select("node", "s.*"), "copies-sets")
    discard(own, member)
    # texts of some bits apart that share too little are told by their sketches before they are a pair, since a group of them has very many
    similar = lambda a, b: may_be_similar(lambda c: a[c], lambda c: b[c], similarity)
    small = settle(_pairs_in_small(beside.join(sets.select("node", "n", "bits"), "node"), radius, similar), "copies-pairs")
    discard(beside)
    close = _by_rare_shingles(large.join(sets.select("node", "n", "shingles"), "node"), similarity)
    near = _near(F.col("sim"), F.col("sim_a"), radius) | _near(F.col("node")["sim2"], F.col("node_a")["sim2"], radius)
    possible = near & may_be_similar(F.col, lambda c: F.col(f"{c}_a"), similarity, "held")

    def meet(now: DataFrame, lead: DataFrame) -> DataFrame:
        smaller = _meet(now, lead.filter("short"), (F.col("n_a") <= F.col("n")) & possible)
        return smaller.unionByName(_meet(now.filter("short"), lead, (F.col("n_a") > F.col("n")) & possible))

    def verified(pairs: DataFrame) -> DataFrame:
        of = lambda side: sets.select(F.col("node").alias(side), F.col("shingles").alias(f"of_{side}"))
        both = pairs.join(of("a"), "a").join(of("b"), "b")
        common = F.size(F.array_intersect("of_a", "of_b"))
        return both.filter(common >= F.lit(similarity) * (F.size("of_a") + F.size("of_b") - common)).select("a", "b")

    found = _connect(small, close, meet, verified)
    of_class = classes.join(found, "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    kept = keep_survivors(docs, of_class, id_column, text_column)
    discard(classes, small, large, sets, close, found)
    return kept
