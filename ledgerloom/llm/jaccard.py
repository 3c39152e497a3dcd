"""Similarity join of word n-gram sets by prefix trees (operator 8).

All n-grams have one global order, rare ones first. A text whose first n-grams occur
nowhere else cannot reach the similarity and is done. The others are put together by
shared n-grams at the front of their sets, and each such cluster, cut by set size and
into blocks of bounded size, is stored as a trie: a text's overlaps with a branch are
shared by all sets below it, and a branch is left when even its remaining length cannot
bring the overlap up to what the similarity needs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import shared
from ledgerloom.llm.kernels import LOWER, Texts, Words, bounds, let_go, mix, pieces, range_hashes, signed, windows, words

SHINGLE, PERCENT = 3, 90
#: n-grams of one block of a cluster; texts in the sample that tells very common n-grams; share that is very common
BLOCK_GRAMS, SAMPLE, COMMON = 1 << 19, 4000, 0.01
BUCKETS_PER_SLOT, BUCKET_GRAMS = 2, 1 << 22
_COMMON_RANK = 1 << 40


def need(a: int | np.ndarray, b: int | np.ndarray, percent: int):
    """Least overlap of sets of a and b members with 100 |A∩B| >= percent |A∪B|."""
    return -(-percent * (a + b) // (100 + percent))


def prefix(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def gram_sets(texts: Texts, shingle: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, word hashes, and the distinct n-gram hashes of each text with its number;
    text lower-cased in A-Z. Texts of 1 to shingle - 1 words are one n-gram."""
    low = Texts(texts.rows, LOWER[texts.data], texts.offsets)
    found = words(low)
    hashes = range_hashes(low.data, found.starts, found.ends)
    keys, at = windows(hashes, found.first, shingle)
    doc = np.searchsorted(found.first, at, "right") - 1
    counts = found.counts()
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    keys = np.concatenate((keys, range_hashes(hashes, found.first[short], found.first[short + 1])))
    doc = np.concatenate((doc, short))
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]))) if len(keys) else np.zeros(0, bool)
    return found, hashes, keys[fresh], doc[fresh]


def scan(rows: DataFrame, shingle: int) -> DataFrame:
    """Stored (key, doc_id, n, digest, digest2): set size and digests of the words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in pieces(batch.column(2)):
                n = len(texts)
                found, hashes, _, doc = gram_sets(texts, shingle)
                yield pa.RecordBatch.from_pydict({
                    "key": batch.column(0).slice(texts.rows.start, n), "doc_id": batch.column(1).slice(texts.rows.start, n),
                    "n": np.bincount(doc, minlength=n), "digest": signed(range_hashes(hashes, found.first[:-1], found.first[1:], 1)),
                    "digest2": signed(range_hashes(hashes, found.first[:-1], found.first[1:], 2))})

    return shared.stored(rows.select("key", "doc_id", "text").mapInArrow(
        read, "key BIGINT, doc_id BIGINT, n BIGINT, digest BIGINT, digest2 BIGINT"), "grams-scan")


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join both of whose sides are shuffled for it, so a hot key can be split."""
    again = F.xxhash64(F.lit(11), *on)
    return left.withColumn("again", again).join(right.withColumn("again", again), ["again", *on], how).drop("again")


def common_grams(texts: DataFrame, shingle: int, total: int) -> dict[int, int]:
    """n-grams in at least COMMON of a sample of about SAMPLE texts, with their counts. They
    only move to the end of the global order; results do not depend on the sample. At
    most 1 / COMMON times the mean set size of them exist."""
    step = max(total // SAMPLE, 1)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch.column(0)):
                keys, times = np.unique(gram_sets(part, shingle)[2], return_counts=True)
                yield pa.RecordBatch.from_pydict({"gram": signed(keys), "n": times})

    sample = texts.where(F.pmod(F.xxhash64(F.lit(23), "key"), F.lit(step)) == 0).select("text")
    counted = sample.mapInArrow(grams, "gram BIGINT, n BIGINT").groupBy("gram").agg(F.sum("n").alias("n"))
    least = max(2, int(COMMON * total / step))
    return {r["gram"]: r["n"] for r in counted.where(F.col("n") >= least).collect()}


def ordered_sets(texts: DataFrame, shingle: int, percent: int, common: dict[int, int], total: int = 0) -> DataFrame:
    """Stored (key, n, posted, grams) of the texts that can have a partner: their n-grams
    that occur elsewhere in global order, and those at the front of the whole set.

    n-grams travel packed: one row per slice of texts and bucket, and back in one row per
    bucket and group of texts. Very common ones do not travel: their place is known.
    ``total`` n-grams are dealt to enough buckets for one to fit a task."""
    spark = texts.sparkSession
    buckets = max(BUCKETS_PER_SLOT * shared.slots(spark), total // BUCKET_GRAMS)
    known = np.asarray(sorted(common), np.int64)
    times = np.asarray([common[k] for k in sorted(common)], np.int64)
    held = spark.sparkContext.broadcast((known, times))  # bounded by the sample, see common_grams
    # texts are addressed by slice and place in it; only a slice's own row names their keys
    schema = "bucket INT, slice BIGINT, places ARRAY<INT>, grams ARRAY<BIGINT>, ranks ARRAY<BIGINT>, keys ARRAY<BIGINT>"

    def lists(offsets: np.ndarray, values: np.ndarray, kind) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

    def packed(bucket: np.ndarray, owner: np.ndarray, place: np.ndarray, gram: np.ndarray, rank: np.ndarray, keys=None) -> pa.RecordBatch:
        """One row per bucket and slice of the entries (place, n-gram, rank)."""
        order = np.lexsort((gram, place, owner, bucket))
        bucket, owner = bucket[order], owner[order]
        edge = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])))) if len(bucket) \
            else np.zeros(0, np.int64)
        at = np.append(edge, len(bucket))
        named = lists(at if keys is not None else np.zeros(len(at), np.int64), keys[order] if keys is not None else np.zeros(0, np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([
            pa.array(bucket[edge].astype(np.int32)), pa.array(owner[edge]), lists(at, place[order].astype(np.int32), pa.int32()),
            lists(at, gram[order], pa.int64()), lists(at, rank[order], pa.int64()), named],
            ["bucket", "slice", "places", "grams", "ranks", "keys"])

    spread = lambda values: (mix(values.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = held.value
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in pieces(batch.column(1)):
                _, _, keys, doc = gram_sets(part, shingle)
                if not len(keys):
                    continue
                number += 1
                gram = signed(keys)
                at = np.minimum(np.searchsorted(known, gram), max(len(known) - 1, 0))
                usual = known[at] == gram if len(known) else np.zeros(len(gram), bool)
                home = lambda n: np.full(n, number, np.int64)  # noqa: B023, E731
                yield packed(spread(gram[~usual]), home((~usual).sum()), doc[~usual], gram[~usual], np.zeros((~usual).sum(), np.int64))
                if usual.any():
                    n = int(usual.sum())
                    yield packed(spread(home(n)), home(n), doc[usual], gram[usual], _COMMON_RANK + times[at[usual]])
                size = np.bincount(doc, minlength=len(part))
                some = np.flatnonzero(size)
                yield packed(spread(home(len(some))), home(len(some)), some, size[some], np.full(len(some), -1),
                             np.asarray(batch.column(0))[part.rows][some])

    def flat(table: pa.Table, name: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *[np.asarray(c.flatten()) for c in table.column(name).chunks]]).astype(np.int64)

    def entries(table: pa.Table) -> tuple[np.ndarray, ...]:
        sizes = np.concatenate([np.asarray(pa.compute.list_value_length(c)) for c in table.column("places").chunks])
        return np.repeat(table.column("slice").to_numpy(), sizes), flat(table, "places"), flat(table, "grams"), flat(table, "ranks")

    def count(table: pa.Table) -> pa.Table:
        """Ranks of new n-grams become their counts; those found once are left out."""
        named = pa.compute.greater(pa.compute.list_value_length(table.column("keys")), 0)
        owner, place, gram, rank = entries(table.filter(pa.compute.invert(named))) if not pa.compute.all(named).as_py() else [np.zeros(0, np.int64)] * 4
        new = np.flatnonzero(rank == 0)
        _, inverse, times = np.unique(gram[new], return_inverse=True, return_counts=True)
        rank = rank.copy()
        rank[new] = times[inverse]
        keep = rank > 1
        out = pa.Table.from_batches([packed(spread(owner[keep]), owner[keep], place[keep], gram[keep], rank[keep])])
        return pa.concat_tables([out, table.filter(named).cast(out.schema)])

    def choose(table: pa.Table) -> pa.Table:
        let_go()
        owner, place, gram, rank = entries(table)
        slices, code = np.unique(owner, return_inverse=True)
        text = code.astype(np.int64) << 32 | place
        own = rank < 0
        order = np.argsort(text[own])
        texts_, size = text[own][order], gram[own][order]
        named = table.filter(pa.compute.greater(pa.compute.list_value_length(table.column("keys")), 0))
        key_of = flat(named, "keys")[order]  # rows with keys hold exactly the entries of rank -1, in the same order
        text, gram, rank = text[~own], gram[~own], rank[~own]
        order = np.lexsort((gram, rank, text))
        text, gram = text[order], gram[order]
        edge = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))) if len(text) else np.zeros(0, np.int64)
        have = np.diff(np.append(edge, len(text)))
        at = np.searchsorted(texts_, text[edge])
        n = size[at]
        front = prefix(n, percent) - (n - have)  # n-grams found nowhere else come first and match nothing
        keep = np.flatnonzero(front > 0)
        posted = [gram[edge[i]:edge[i] + front[i]] for i in keep]
        sets = [gram[edge[i]:edge[i] + have[i]] for i in keep]
        return pa.table({"key": pa.array(key_of[at[keep]], pa.int64()), "n": pa.array(n[keep], pa.int64()),
                         "posted": pa.array(posted, pa.list_(pa.int64())), "grams": pa.array(sets, pa.list_(pa.int64()))})

    counted = texts.select("key", "text").mapInArrow(send, schema).groupBy("bucket").applyInArrow(count, schema)
    sets = counted.groupBy("bucket").applyInArrow(choose, "key BIGINT, n BIGINT, posted ARRAY<BIGINT>, grams ARRAY<BIGINT>")
    return shared.stored(sets, "gram-sets")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node each node of ``edges`` (a, b) is connected to.

    Large and small stars in turn until nothing changes; each round is written, so a lost
    executor repeats at most one round."""
    edges = shared.stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = split_join(both.where("b > a"), low, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = split_join(large, low, ["a"])
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = shared.stored(small, "edges")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def trie_links(keys: np.ndarray, n: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of side 0 (the trie) and all others given, enough to connect
    whatever is linked: a pair already connected by others is left out.

    Sets are walked in lexicographic order. What a set shares with the one before it is a
    path of the trie already walked, with its overlaps with all probes."""
    flat, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    at = bounds([len(s) for s in sets])
    order_of = np.argsort(inverse, kind="stable")
    start = bounds(times)
    owner = np.repeat(np.arange(len(sets)), np.diff(at))[order_of]
    local = [inverse[at[i]:at[i + 1]].astype(">u4") for i in range(len(sets))]
    trie = sorted(np.flatnonzero(side == 0).tolist(), key=lambda i: local[i].tobytes())
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # overlaps of all sets with the path walked so far; a step back takes its n-gram out again
    links, now, before, depth = [], np.zeros(len(sets), np.int32), np.zeros(0, ">u4"), 0
    for i in trie:
        path = local[i]
        m = min(len(path), len(before), depth)
        same = path[:m] == before[:m]
        at_depth = m if same.all() else int(same.argmin())
        for gram in before[at_depth:depth]:
            now[owner[start[gram]:start[gram + 1]]] -= 1
        want = need(n, n[i], percent)
        want[(100 * np.minimum(n, n[i]) < percent * np.maximum(n, n[i]))] = 1 << 30
        want[i] = 1 << 30
        depth = at_depth
        for d in range(at_depth, len(path)):
            if d % 8 == 0 and not (now + (len(path) - d) >= want).any():
                break  # no set can be reached below here with what is left of this one
            gram = path[d]
            now[owner[start[gram]:start[gram + 1]]] += 1
            depth = d + 1
        else:
            for j in np.flatnonzero(now >= want).tolist():
                a, b = root(i), root(j)
                if a != b:
                    parent[a] = b
                    links.append((int(keys[i]), int(keys[j])))
        before = path
    return links


def cluster_links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) links between ``sets`` rows, enough to connect what is linked."""
    posted = sets.select("key", F.explode("posted").alias("gram"))
    hubs = posted.groupBy("gram").agg(F.min("key").alias("hub"), F.count("*").alias("times")).where("times > 1").select("gram", "hub")
    stars = split_join(posted, hubs, ["gram"]).where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct()
    clusters = components(stars).withColumnRenamed("node", "key")
    # sets of sizes too far apart cannot link: each goes to the band of its size and the next
    step = math.log(100 / percent)
    band = F.floor(F.log("n") / step).cast("int")
    rows = sets.join(clusters, "key").select("key", "n", "grams", "component", F.explode(F.array(band, band + 1)).alias("band"))
    size = F.sum(F.size("grams") + 1)
    blocks = rows.groupBy("component", "band").agg(F.count("*").alias("members"), F.ceil(size / F.lit(BLOCK_GRAMS)).cast("int").alias("blocks"))
    rows = split_join(rows, shared.stored(blocks.where("members > 1"), "blocks"), ["component", "band"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(31), "key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", "n", "grams", "component", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                       (F.col("block") > F.least("block", "other")).cast("int").alias("side"))

    def join(table: pa.Table) -> pa.Table:
        let_go()
        sets = [np.asarray(x) for c in table.column("grams").chunks for x in np.split(
            np.asarray(c.flatten()), np.cumsum(np.asarray(pa.compute.list_value_length(c)))[:-1])]
        links = trie_links(table.column("key").to_numpy(), table.column("n").to_numpy(), sets, table.column("side").to_numpy(), percent)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    found = rows.groupBy("component", "band", "i", "j").applyInArrow(join, "a BIGINT, b BIGINT")
    return shared.stored(found, "links")


def groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id, n_shingles, component_id) per row of ``docs``: texts whose sets of
    ``shingle``-word n-grams have a Jaccard similarity of ``percent`` or more are linked,
    and a component is what links connect; its id is the smallest doc_id in it.

    Texts with equal words are one node. Null and empty texts, and those without words,
    have no set and are alone; a text with fewer words than ``shingle`` is one n-gram and
    links to equal texts only. Repeated rows get equal results; a null id counts only
    where a component has no other; other columns are ignored; an empty table gives no rows."""
    rows = shared.keyed(docs, id_col, text_col)
    scanned = scan(rows, shingle)
    total, grams = scanned.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    with_words = scanned.where("n > 0").select("key", "doc_id", "digest", "digest2").distinct()
    nodes = with_words.groupBy("digest", "digest2").agg(F.min("key").alias("node"), F.count("*").alias("copies"))
    member = shared.stored(split_join(with_words, nodes.where("copies > 1").select("digest", "digest2", "node"), ["digest", "digest2"])
                           .select("key", "doc_id", "node"), "members")
    copies = shared.stored(member.where("key <> node").select("key").distinct(), "copies")
    texts = rows.select("key", "text").join(copies, "key", "left_anti")
    sets = ordered_sets(texts, shingle, percent, common_grams(texts, shingle, total), grams)
    sets = sets.dropDuplicates(["key"])  # rows that repeat id and text
    linked = components(cluster_links(sets, percent)).withColumnRenamed("node", "node_key")
    # every text in a group of copies or of linked nodes, with its component
    lone = scanned.select("key", "doc_id").join(member.select("key").distinct(), "key", "left_anti").select(
        "key", "doc_id", F.col("key").alias("node"))
    all_nodes = member.unionByName(lone.join(linked.select(F.col("node_key").alias("key")), "key", "left_semi"))
    owned = all_nodes.join(linked, all_nodes.node == linked.node_key, "left").select(
        "key", "doc_id", F.coalesce("component", "node").alias("component"))
    owned = shared.stored(owned, "owned")
    least = owned.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = shared.stored(split_join(owned.select("key", "component").distinct(), least, ["component"]).select("key", "component_id"), "named")
    return scanned.select("key", "doc_id", F.col("n").alias("n_shingles")).join(named, "key", "left").select(
        "key", "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
