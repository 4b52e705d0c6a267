"""Near-duplicate detection: fast similarity sketches, banding, exact verification.

* A document's set holds its distinct 5-word shingles (64-bit hashes). Documents with equal sets form a
  class; its smallest doc_id stands for it from then on, so copies never meet in pairs.
* Sketch: in round i every shingle is thrown into a bin, with a value of that round; a bin keeps its
  least value of its earliest round. After T rounds, round T + j throws every shingle into bin j, so
  each coordinate fills, even for one shingle; mostly two or three rounds do. The share of equal
  coordinates estimates the Jaccard similarity with the concentration of T independent samples.
* Banding: BANDS bands of ROWS coordinates. At the least similarity asked for, 0.85, a pair shares no
  band with a probability of 2.1e-10.
* Verification on full sets, in two steps, that never lists all pairs of a bucket:
  1. each member of a bucket is compared with the bucket's smallest node (a star); the
     links found give components;
  2. what is left are pairs of one bucket in different components. The members of buckets of more than LARGE,
     as a template shared by dissimilar documents makes them, are first dealt anew by their rarest shingles: if all
     sets are sorted in one order, two that are similar enough share a shingle among the first 15 % of each (and one more),
     whatever the order. Shingles that a sample of these members holds often come last, so that templates bring
     nobody together. Where more than a block's worth of members is outside the largest component, all members of the bucket
     are first dealt into blocks of fixed size, each once, and only those of one block meet; this is done anew as long
     as it halves what is outside. Then the largest component's members meet
     the others in blocks of fixed size, spread over tasks. A block compares sketches; the
     members of pairs whose estimate is within reach (over seven standard errors below the threshold) meet
     once more, with their full sets. A block gives a spanning forest of its links, fewer than it has members.
  A pair that shares a band thus ends up linked, in one component anyway, or refuted, unless its
  estimate is out of reach; at a similarity of 0.85 that has a probability of 5e-12 (binomial tail of
  at most 174 of 256 coordinates). All causes together miss such a pair with at most 2.2e-10.

Classes are numbered when they are written; the numbers are the nodes of all links, so that ids that
name several texts are no trouble, and texts without an id are nodes like all others. The least (doc_id, row hash) of a
component leads it, rows with an id before those without.

Cases: null text, empty text and text of blanks have no set, link with nothing and are kept; with
fewer than five words the whole sequence is the one shingle; a null doc_id has a null component and is
kept, yet its text links others; repeated rows are reported each; rows of one id with different texts are documents of their own, each reported
by the component of its text; an empty table gives no rows; other columns are
ignored here and carried through by ``deduplicate``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache
from itertools import count, groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoforge.llm.common import temporary, written
from chronoforge.llm.components import components

SHINGLE = 5
PERCENT = 85
T, BANDS, ROWS = 256, 38, 5
#: Pairs whose estimated similarity is lower are out of reach of the threshold.
REACH = 0.68
BLOCK = 512
#: Buckets with more members are dealt by rare shingles.
LARGE = 2 * BLOCK
#: Sets that tell which shingles are common, about, and the common ones that are kept, at most. Both affect the work alone.
ASKED, COMMON = 2000, 1 << 20
CACHE_WORDS = 1_000_000

_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = mix(np.arange(1, 2 * T + 1, dtype=np.uint64) * _MULT)
_POWERS = np.array([pow(int(_MULT), k, 1 << 64) for k in range(SHINGLE)], np.uint64)
_BAND_SEEDS = mix(np.arange(1001, 1001 + BANDS, dtype=np.uint64) * _MULT)


class WordHashes(dict):
    """64-bit hash of each word (bytes); starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@cache
def word_hashes() -> WordHashes:
    """One per worker process, which Spark uses for many tasks."""
    return WordHashes()


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes. bytes.lower() and bytes.split() know ASCII letters and blanks only, as asked."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(h))
    n = len(h) - k + 1
    grams = np.full(n, np.uint64(k))
    for j in range(k):
        grams += h[j : j + n] * _POWERS[j]
    return np.unique(mix(grams))


def sketch(grams: np.ndarray) -> np.ndarray:
    """T coordinates; the round stands in the high bits, so the earliest round's least value wins."""
    out = np.full(T, np.iinfo(np.uint64).max, np.uint64)
    width = max(1, -(-8 * T // len(grams)))
    for first in range(0, 2 * T, width):
        rounds = np.arange(first, min(first + width, 2 * T))
        h = mix(grams[:, None] ^ _SEEDS[None, rounds])
        bins = np.where(rounds < T, (h & np.uint64(T - 1)).astype(np.int64), rounds - T)
        np.minimum.at(out, bins.ravel(), ((rounds.astype(np.uint64) << np.uint64(54)) | (h >> np.uint64(10))).ravel())
        if out.max() != np.iinfo(np.uint64).max:
            break
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    x = mix(coordinates[: BANDS * ROWS]).reshape(BANDS, ROWS)
    key = _BAND_SEEDS.copy()
    for r in range(ROWS):
        key = mix(key * _MULT + x[:, r])
    return key.view(np.int64)


def short_sketch(coordinates: np.ndarray) -> bytes:
    """One byte a coordinate (unequal ones still agree with a probability of 1/256), then the band keys."""
    return (mix(coordinates) & np.uint64(255)).astype(np.uint8).tobytes() + band_keys(coordinates).tobytes()


def read_sketches(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the coordinates, and band keys; a row each."""
    rows = np.frombuffer(b"".join(values), np.uint8).reshape(-1, T + 8 * BANDS)
    return rows[:, :T], np.ascontiguousarray(rows[:, T:]).view(np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= PERCENT * union, on full sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < PERCENT * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def row_hash() -> Column:
    """Tells rows of one id apart by their texts."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, h (see row_hash), n_shingles, set_id (128-bit hash of the set), bands, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for b in batches:
            n, ids, bands = [], [], []
            for text in b.column(2).to_pylist():
                s = shingles(text, hashes)
                n.append(len(s))
                ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_keys(sketch(s)) if len(s) else np.zeros(0, np.int64))
            offsets = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *bands])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), lists], ["doc_id", "h", "n_shingles", "set_id", "bands"])

    rows = docs.select(F.col("doc_id").cast("long"), row_hash().alias("h"), F.col("text"))
    return written(rows.mapInArrow(run, "doc_id long, h long, n_shingles long, set_id binary, bands array<long>"), "near-signatures", outlive=True)


def full_sets(docs: DataFrame, leads: DataFrame, repeated: bool) -> DataFrame:
    """node, sketch (see short_sketch), grams (the full set) of the rows that leads(node, doc_id, h) names; repeated: such a row may stand several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for big in batches:
            for lo in range(0, big.num_rows, 1000):
                b = big.slice(lo, 1000)
                sets = [shingles(t, hashes) for t in b.column(1).to_pylist()]
                short = [short_sketch(sketch(s)) if len(s) else b"" for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(short, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "sketch", "grams"])

    rows = docs.select(F.col("doc_id").cast("long"), row_hash().alias("h"), F.col("text"))
    rows = rows.join(leads, (rows["h"] == leads["h"]) & rows["doc_id"].eqNullSafe(leads["doc_id"])).select(leads["node"], rows["doc_id"], rows["h"], rows["text"])
    if repeated:
        rows = rows.dropDuplicates(["doc_id", "h"])
    return written(rows.select("node", "text").mapInArrow(run, "node long, sketch binary, grams binary"), "near-sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    one = sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a"))
    two = sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b"))
    full = pairs.join(two, "b").join(one, "a").select("a", "b", "grams_a", "grams_b")
    return full.mapInArrow(run, "a long, b long")


def _live(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets with several components: key, node, label, main (the component with most members there), mains, others.

    mains, others: how many blocks the members of the main component and all others make.
    """
    named = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    per = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"))
    top = top.filter("all > top.n").select(
        "key",
        F.col("top.label").alias("main"),
        F.ceil(F.col("top.n") / BLOCK).cast("int").alias("mains"),
        F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("others"),
    )
    top = written(top, "near-top")  # a plain shuffle then, beside which a hot key's members can be split
    return written(named.join(top, "key"), "near-live")


def _own_blocks(live: DataFrame, turn: int) -> DataFrame:
    """The members of live (see _live), each in one block, another one every turn: columns as those of _blocks."""
    at = F.pmod(F.xxhash64(F.lit(turn), "key", "node"), F.col("mains") + F.col("others")).cast("int")
    return live.select("key", F.lit(1).alias("kind"), at.alias("i"), at.alias("j"), F.lit(0).alias("side"), "node", "label")


def _blocks(members: DataFrame, labels: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Blocks of members of one bucket in different components: key, kind, i, j, side, node, label.

    members: key, node; live: what _live makes of them, if known. The component with most members in a bucket is dealt into
    blocks i, the others into blocks j; each block i meets each block j, and the blocks j meet each other.
    """
    live = live or _live(members, labels)
    h = F.xxhash64("key", "node")
    main = live.filter("label = main").select(
        "key", F.lit(0).alias("kind"), F.pmod(h, "mains").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("j"), F.lit(0).alias("side"), "node", "label"
    )
    other = live.filter("label != main").withColumn("own", F.pmod(h, "others").cast("int"))
    to_main = other.select("key", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), F.col("mains") - 1)).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "node", "label")
    mutual = other.select("key", F.lit(1).alias("kind"), "own", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("to"), "node", "label").select(
        "key", "kind", F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"), F.when(F.col("own") <= F.col("to"), 0).otherwise(1).alias("side"), "node", "label"
    )
    return main.unionByName(to_main).unionByName(mutual)


def equal_bytes(rows: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How many of its T bytes each row shares with the one row; eight at a time (no byte's sum passes T / 8)."""
    return (rows == row).view(np.uint64).sum(axis=1).view(np.uint8).reshape(-1, 8).sum(axis=1)


def band_of(keys: np.ndarray, bucket: int) -> int:
    """The band that makes a bucket, -1 if a shingle does; keys: one member's."""
    one = np.flatnonzero(keys == bucket)
    return int(one[0]) if len(one) else -1


def near_pairs(a: list[tuple], b: list[tuple], bucket: int) -> list[tuple[int, int]]:
    """Positions of pairs of different components whose estimate is within reach. a, b: rows of a block's sides.

    A pair that shares several bands is met in the bucket of its first band only.
    """
    if len(a) > len(b):
        return [(y, x) for x, y in near_pairs(b, a, bucket)]
    least = T * (REACH + (1 - REACH) / 256)
    (one, keys_a), (two, keys_b) = read_sketches([r[SKETCH] for r in a]), read_sketches([r[SKETCH] for r in b])
    labels = np.array([r[LABEL] for r in b])
    two = np.ascontiguousarray(two)
    first = band_of(keys_b[0], bucket)
    out = []
    for k, row in enumerate(a):
        hits = np.flatnonzero((equal_bytes(two, one[k]) >= least) & (labels != row[LABEL]))
        if len(hits) and first >= 0:
            hits = hits[(keys_b[hits] == keys_a[k]).argmax(axis=1) == first]
        out += [(k, h) for h in hits.tolist()]
    return out


KEY = ["key", "kind", "i", "j"]
SIDE, NODE, LABEL, SKETCH, GRAMS = 4, 5, 6, 7, 8


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[tuple], list[tuple]]]:
    """Rows of each block, and those of its two sides; within one block of others both sides are that block."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for (_, kind, i, j), group in groupby(rows, key=itemgetter(0, 1, 2, 3)):
        block = list(group)
        one, two = ([r for r in block if r[SIDE] == s] for s in (0, 1))
        if kind == 1 and i == j:
            two = one
        if one and two:
            yield block, one, two


class Joined(dict):
    """Components joined so far: each one's next, up to the one that stands for all."""

    def find(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x


def links_within(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components that meet in blocks (see _blocks), of each block a spanning forest."""
    layout = "key long, kind int, i int, j int, side int, node long, label long"
    arrow = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("node", pa.int64()), ("label", pa.int64())])

    def emit(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        while some := list(islice(rows, 5000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    def close_rows(batches):
        for block, one, two in block_rows(batches):
            pairs = near_pairs(one, two, block[0][0])
            near = {id(one[p]) for p, _ in pairs} | {id(two[q]) for _, q in pairs}
            yield from (r[: LABEL + 1] for r in block if id(r) in near)

    def links(batches):
        for block, one, two in block_rows(batches):
            ga, gb = ([np.frombuffer(r[GRAMS], np.uint64) for r in side] for side in (one, two))
            joined = Joined()
            for p, q in near_pairs(one, two, block[0][0]):
                x, y = joined.find(one[p][LABEL]), joined.find(two[q][LABEL])
                if x != y and (p < q or one is not two) and linked(ga[p], gb[q]):
                    joined[x] = y
                    yield one[p][NODE], two[q][NODE]

    def dealt(blocks: DataFrame) -> DataFrame:
        return blocks.repartition(*KEY).sortWithinPartitions(*KEY, "side", "node")

    columns = [*KEY, "side", "node", "label", "sketch"]
    met = blocks.join(sets.select("node", "sketch"), "node").select(*columns)
    close = dealt(met).mapInArrow(lambda b: emit(close_rows(b), arrow), layout)
    full = written(close, "near-reach").join(sets, "node").select(*columns, "grams")
    pair = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return dealt(full).mapInArrow(lambda b: emit(links(b), pair), "a long, b long")


def with_links(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (see components) with links (a, b) added."""
    return components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links))


def join_buckets(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """The labels with all links between the members (key, node) of one bucket."""
    before = None
    for turn in count():
        live = _live(members, labels)
        wide = live.filter("others > 1")
        outside = wide.filter("label != main").count()
        if not outside or (before is not None and 2 * outside > before):
            break
        more = written(links_within(_own_blocks(wide, turn), sets), "near-links")
        if more.isEmpty():
            break
        before, labels = outside, with_links(labels, more)
    more = written(links_within(_blocks(members, labels, live), sets), "near-links")
    return labels if more.isEmpty() else with_links(labels, more)


def rarest_first(grams: np.ndarray, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The shingles of a set in the one order: by how often the sample holds them, then by themselves; common is sorted."""
    at = np.minimum(np.searchsorted(common, grams), max(len(common) - 1, 0))
    often = np.where(common[at] == grams, times[at], 0) if len(common) else np.zeros(len(grams), np.int64)
    return grams[np.lexsort((grams, often))]


def by_rare_shingles(hot: DataFrame, sets: DataFrame) -> DataFrame:
    """key, node: the nodes of hot(node) by each of the first shingles of their sets, where these meet another one."""
    some = sets.join(hot, "node", "left_semi")
    rate = min(1.0, ASKED / max(1, hot.count()))

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(g, np.int64))], ["gram"])

    asked = some.filter(F.pmod(F.xxhash64("node"), F.lit(1 << 32)) < rate * (1 << 32)).select("grams").mapInArrow(every, "gram long")
    counted = asked.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "gram").limit(COMMON).toPandas()
    common, times = counted["gram"].to_numpy(np.int64).view(np.uint64), counted["n"].to_numpy(np.int64)
    order = np.argsort(common)
    common, times = common[order], times[order]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                grams = np.frombuffer(g, np.uint64)
                keys = rarest_first(grams, common, times)[: len(grams) - -(-PERCENT * len(grams) // 100) + 1]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), node))], ["key", "node"])

    dealt = written(some.select("node", "grams").mapInArrow(first, "key long, node long"), "near-rare")
    shared = written(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key"), "near-met")
    return dealt.join(shared, "key")


def near_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signatures, classes: set_id and lead, the least (no_id, doc_id, h) of its component)."""
    with temporary(docs.sparkSession):
        rows = signatures(docs)
        full = rows.filter("n_shingles > 0").withColumn("no_id", F.col("doc_id").isNull())
        classes = full.groupBy("set_id").agg(F.min(F.struct("no_id", "doc_id", "h")).alias("lead"))
        classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
        leads = classes.select("node", F.col("set_id").alias("of"), F.col("lead.doc_id").alias("id"), F.col("lead.h").alias("led"))
        led = full.join(leads, (F.col("set_id") == F.col("of")) & (F.col("h") == F.col("led")) & F.col("doc_id").eqNullSafe(F.col("id")))
        nodes = led.groupBy("node", "doc_id", "h", "set_id").agg(F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("times"))
        nodes = written(nodes, "near-nodes")
        thrown = nodes.select("node", "n", F.explode("bands").alias("key"))
        # written: beside a plain shuffle, a hot key's members can be split
        buckets = written(thrown.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lead"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "near-buckets")
        members = thrown.join(buckets, "key").select("key", "node", "n", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n"), (F.col("size") > LARGE).alias("is_large"))
        members = written(members, "near-members")
        met = nodes.join(members.select("node").distinct(), "node", "left_semi")
        sets = full_sets(docs, met.select("node", "doc_id", "h"), not met.filter("times > 1").isEmpty())
        star = members.filter("node != lead").filter(f"100 * least(n, lead_n) >= {PERCENT} * greatest(n, lead_n)")
        first = written(verified(star.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), sets), "near-links")
        labels = components(first)
        dealt = members.filter("NOT is_large").select("key", "node")
        large = buckets.filter(F.col("size") > LARGE).select("key")
        if not large.isEmpty():
            hot = written(members.filter("is_large").select("node").distinct(), "near-hot")
            dealt = dealt.unionByName(by_rare_shingles(hot, sets))
        labels = join_buckets(dealt, labels, sets)
        of = classes.join(labels, "node").select("node", "label", "lead")
        led = of.select("node", "label").join(written(of.groupBy("label").agg(F.min("lead").alias("led_by")), "near-leads"), "label")
        found = classes.join(led.select("node", "led_by"), "node", "left").select("set_id", F.coalesce("led_by", "lead").alias("lead"))
        return rows, written(found, "near-found", outlive=True)


def mark_near_copies(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    rows, classes = near_classes(docs)
    out = rows.select("doc_id", "n_shingles", "set_id").join(classes, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("lead.doc_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component the row that leads it, once, and all rows without a set or an id."""
    with temporary(docs.sparkSession):
        rows, classes = near_classes(docs)
        leads = classes.select(F.col("lead.doc_id").alias("id"), F.col("lead.h").alias("h")).distinct()
        bare = rows.filter("n_shingles = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "h").distinct()
        keep = written(leads.unionByName(bare), "near-kept", outlive=True)
    name = f"h_{uuid.uuid4().hex}"  # no column of docs
    marked = docs.withColumn(name, row_hash())
    named = marked.join(keep, (F.col("doc_id").cast("long") == keep["id"]) & (F.col(name) == keep["h"]), "left_semi").dropDuplicates(["doc_id", name])
    return named.select(docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))
