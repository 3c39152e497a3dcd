"""Balanced label propagation into shards (operator 7).

Equal texts are one node that weighs as much as it has copies; nodes are first laid into
the shards evenly, the heaviest first, and only what fits no shard whole is split. Nodes
that share a value of a link column (by default: the least hashes of their five-word
windows, which near copies share) are neighbours. In each round a node asks for
the shard where its neighbours weigh most; per pair of shards as much is granted as goes
the other way, plus the free room of the target. Rounds are joins and aggregates on (node,
shard) rows until nothing more is gained; only the table of shard pairs and the HEAVIEST
groups reach the driver. At the end counts are made exact: what exceeds a shard's quota,
unlinked documents first, goes to the free slots of other shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import shared
from ledgerloom.llm.kernels import LOWER, Texts, mix, pieces, range_hashes, signed, windows, words

SHARDS, ROUNDS, SLACK = 8, 24, 1.03
#: a half that moves a smaller share of the linked weight gains nothing more
LEAST_GAIN = 0.002
#: words of a window, and how many least hashes of a text link it to others
LINK_WORDS, LINKS = 5, 2
#: groups of equal texts placed one by one on the driver; any other group has fewer copies
#: than a table's rows divided by this
HEAVIEST = 1024


def deal(groups: list[tuple[str, int]], room: list[int]) -> list[tuple[str, int, int, int]]:
    """(group, first copy, end, shard) for groups in descending size; ``room`` of every
    shard is used up in place. A group goes whole to the shard of most room, or is split
    over the shards of most room if it fits none; each split fills a shard."""
    parts = []
    for group, copies in groups:
        at = 0
        while at < copies:
            s = max(range(len(room)), key=lambda i: (room[i], -i))
            n = min(copies - at, room[s])
            parts.append((group, at, at + n, s))
            room[s] -= n
            at += n
    return parts


def in_stretches(groups: DataFrame, weight: int, room: list[int]) -> DataFrame:
    """(text_hash, shard) for many light groups of ``weight`` copies in all: they are laid
    end to end, the line is cut in proportion to the shards' room, and each group goes
    whole to the shard its middle lies in."""
    buckets = 4 * shared.slots(groups.sparkSession)
    rows = groups.withColumn("bucket", F.pmod(F.xxhash64(F.lit(5), "text_hash"), F.lit(buckets)))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("bucket").agg(F.sum("copies").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.sum("copies").over(Window.partitionBy("bucket").orderBy("text_hash").rowsBetween(Window.unboundedPreceding, 0))
    middle = F.col("base") + F.col("inside") - F.col("copies") / 2
    target, begin = F.lit(None).cast("int"), 0
    for s, free in enumerate(room):
        if free:
            target = F.when(middle >= weight * begin / sum(room), F.lit(s)).otherwise(target)
            begin += free
    return rows.withColumn("inside", inside).join(bases, "bucket").select("text_hash", target.alias("to"))


def gather_equal(docs: DataFrame, shards: int) -> DataFrame:
    """(node, shard, linked): equal texts in one shard, the others by hash."""
    spark = docs.sparkSession
    start = F.pmod(F.xxhash64(F.lit(17), "node"), F.lit(shards)).cast("int")
    groups = shared.stored(docs.where("text_hash IS NOT NULL").groupBy("text_hash").agg(F.count("*").alias("copies")).where("copies > 1"),
                           "groups")
    total, weight = docs.count(), groups.agg(F.sum("copies")).first()[0]
    if not weight:
        return shared.stored(docs.select("node", start.alias("shard"), F.lit(False).alias("linked")), "shards")
    heavy = [(r["text_hash"], r["copies"]) for r in groups.orderBy(F.desc("copies"), "text_hash").limit(HEAVIEST).collect()]
    room = [total // shards + (s < total % shards) for s in range(shards)]
    parts = deal(heavy, room)
    whole = spark.createDataFrame(parts, "text_hash STRING, begin BIGINT, end BIGINT, to INT")
    # at most HEAVIEST groups and two parts per shard more; light groups are joined by their text
    known = docs.join(F.broadcast(whole.groupBy("text_hash").agg(F.count("*").alias("parts"), F.min("to").alias("to"))), "text_hash", "left")
    light = groups.where((F.col("copies") < heavy[-1][1]) | ((F.col("copies") == heavy[-1][1]) & (F.col("text_hash") > heavy[-1][0])))
    rest = weight - sum(n for _, n in heavy)
    state = known.where("parts = 1").select("node", "to", F.lit(True).alias("linked"))
    others = known.where("parts IS NULL").select("node", "text_hash")
    if rest:
        # null texts, which would all meet in one task, stay out of the join
        placed = others.where("text_hash IS NOT NULL").join(shared.stored(in_stretches(light, rest, room), "light"), "text_hash", "left")
        others = placed.unionByName(others.where("text_hash IS NULL").withColumn("to", F.lit(None).cast("int")))
    else:
        others = others.withColumn("to", F.lit(None).cast("int"))
    state = state.unionByName(others.select("node", F.coalesce("to", start).alias("to"), F.col("to").isNotNull().alias("linked")))
    if len(parts) > len(heavy):
        copies = numbered(known.where("parts > 1").select("node", "text_hash"), "text_hash", ["node"], "copy")
        cut = copies.join(F.broadcast(whole), "text_hash").where("copy >= begin AND copy < end")
        state = state.unionByName(cut.select("node", "to", F.lit(True).alias("linked")))
    return shared.stored(state.withColumnRenamed("to", "shard"), "shards")


def near_links(docs: DataFrame, text_col: str, links: int = LINKS) -> DataFrame:
    """``docs`` with columns link_0..: the least of all hashes of the text's windows of
    LINK_WORDS words, A-Z lower-cased, by different orders of the hashes. Two texts share one
    with the probability of their sets' Jaccard similarity. Null for fewer words."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            for part in pieces(text):
                low = Texts(part.rows, LOWER[part.data], part.offsets)
                found = words(low)
                keys, at = windows(range_hashes(low.data, found.starts, found.ends), found.first, LINK_WORDS)
                counts = np.maximum(found.counts() - LINK_WORDS + 1, 0)
                some = np.flatnonzero(counts)
                edge = (np.cumsum(counts) - counts)[some]
                columns = []
                for i in range(links):
                    value = np.zeros(len(part), np.uint64)
                    value[some] = np.minimum.reduceat(mix(keys + np.uint64(i)), edge) if len(some) else 0
                    columns.append(pa.array(signed(value), pa.int64(), mask=counts == 0))
                rows = batch.slice(part.rows.start, len(part))
                yield pa.RecordBatch.from_arrays([*rows.columns, *columns], schema=pa.schema(
                    [*batch.schema, *[pa.field(f"link_{i}", pa.int64()) for i in range(links)]]))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"link_{i} BIGINT" for i in range(links)])
    return docs.mapInArrow(least, schema)


def propagate(units: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """(unit, shard) of the ``units`` (unit, weight, shard) that moved; sizes stay below
    ``slack`` times even.

    ``links``: (unit, link); units of one link are neighbours. Units move in alternate
    halves, so two neighbours never swap places; the rounds end when neither half moves more
    than LEAST_GAIN of the linked weight."""
    sizes = {r["shard"]: r["n"] for r in units.groupBy("shard").agg(F.sum("weight").alias("n")).collect()}
    limit = slack * sum(sizes.values()) / shards
    weight = units.join(links.select("unit").distinct(), "unit", "left_semi").agg(F.sum("weight")).first()[0] or 0
    # one row per unit and link, with where the unit is: a round needs no other table
    state = shared.stored(links.join(units, "unit").withColumn("start", F.col("shard")), "units")
    idle = turn = 0
    while idle < 2 and turn < rounds:
        per = state.groupBy("link").agg(*[F.sum(F.when(F.col("shard") == s, F.col("weight")).otherwise(0)).alias(f"near_{s}") for s in range(shards)])
        half = F.pmod(F.xxhash64(F.lit(3), "unit"), F.lit(2)) == turn % 2
        again = F.xxhash64(F.lit(11), "link")  # both sides are shuffled, so a hot link can be split
        seen = state.where(half).withColumn("again", again).join(per.withColumn("again", again), ["again", "link"])
        # its own weight, once per link that it is counted in, is no neighbour
        votes = seen.groupBy("unit", "weight", "shard").agg(*[
            F.sum(F.col(f"near_{s}") - F.when(F.col("shard") == s, F.col("weight")).otherwise(0)).alias(f"near_{s}") for s in range(shards)])
        best = F.array_max(F.array(*[F.struct(F.col(f"near_{s}").alias("votes"), (F.col("shard") == s).alias("stays"), F.lit(-s).alias("low"))
                                     for s in range(shards)]))
        wish = votes.select("unit", "weight", "shard", best.alias("best")).where(~F.col("best.stays") & (F.col("best.votes") > 0))
        asks = shared.stored(wish.select("unit", "weight", "shard", (-F.col("best.low")).alias("to")), "asks")
        wanted = {(r["shard"], r["to"]): r["n"] for r in asks.groupBy("shard", "to").agg(F.sum("weight").alias("n")).collect()}
        into = {j: sum(n for (_, k), n in wanted.items() if k == j) for _, j in wanted}
        share = {(i, j): min(1.0, (min(n, wanted.get((j, i), 0)) + max(limit - sizes.get(j, 0), 0) * n / into[j]) / n)
                 for (i, j), n in wanted.items()}
        gained, done = 0, [asks]
        if any(share.values()):
            grant = F.create_map(*[x for (i, j), part in share.items() for x in (F.lit(i * shards + j), F.lit(part))])
            lot = F.pmod(F.xxhash64(F.lit(1000 + turn), "unit"), F.lit(1 << 20)) / float(1 << 20)
            fits = F.col("weight") <= limit - sum(sizes.values()) / shards  # heavier ones would overrun a shard at once
            moves = asks.where((lot < grant[F.col("shard") * shards + F.col("to")]) & fits)
            flow = {(r["shard"], r["to"]): r["n"] for r in moves.groupBy("shard", "to").agg(F.sum("weight").alias("n")).collect()}
            for (i, j), n in flow.items():
                sizes[i] -= n
                sizes[j] = sizes.get(j, 0) + n
            if flow:
                done.append(state)
                state = shared.stored(state.join(moves.select("unit", F.col("to").alias("new")), "unit", "left").select(
                    "unit", "link", "weight", F.coalesce("new", "shard").cast("int").alias("shard"), "start"), "units")
            gained = sum(flow.values())
        idle = idle + 1 if gained <= LEAST_GAIN * weight else 0
        turn += 1
        shared.removed(done)  # nothing reads an earlier round any more
        per = seen = votes = wish = asks = moves = done = None
        shared.release(state.sparkSession)
    return state.where("shard <> start").select("unit", "shard").distinct()


def numbered(rows: DataFrame, group: str, order: list[str], name: str, ahead=None) -> DataFrame:
    """Gapless numbers 0.. within each ``group`` in two steps: rows are dealt to many
    buckets, numbered inside each, and the buckets' counts summed up. ``ahead``: true
    for rows that come before all others."""
    spark = rows.sparkSession
    buckets = 4 * shared.slots(spark)
    bucket = F.pmod(F.xxhash64(F.lit(5), *order), F.lit(buckets))
    if ahead is not None:
        bucket = bucket + F.when(ahead, 0).otherwise(buckets)
    rows = rows.withColumn("bucket", bucket)
    counts = rows.groupBy(group, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = shared.stored(counts.select(group, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    inside = F.row_number().over(Window.partitionBy(group, "bucket").orderBy(*order)) - 1
    return rows.withColumn("inside", inside).join(bases, [group, "bucket"]) \
        .withColumn(name, (F.col("base") + F.col("inside")).cast("long")).drop("bucket", "base", "inside")


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", link_cols: list[str] | None = None,
          rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    Law ``rows``: shard counts differ by one at most. Documents with equal values in a
    column of ``link_cols`` are neighbours; None links near copies (``near_links``). Equal
    texts move as one; only a group that fits no shard beside the larger ones is split, and
    where shards have no room for a light group's last copies (hardly a document is
    unlinked) these go to another. Null texts have size 1 and link to nothing, empty ones
    are equal texts; null links link to nothing; repeated rows are separate documents (they
    get numbers of their own); a null id stays null; other columns are ignored; an empty
    table gives no rows."""
    body = F.col(text_col).cast("string")
    if link_cols is None:
        docs = near_links(docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("text")), "text")
        id_col, body, link_cols = "doc_id", F.col("text"), [f"link_{i}" for i in range(LINKS)]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(body.cast("binary"), F.lit(b""))).alias("text_crc32"),
        F.when(body.isNotNull(), F.concat(F.xxhash64(body).cast("string"), F.lit("-"), F.octet_length(body), F.lit("-"),
                                          F.hash(body))).alias("text_hash"),
        F.array(*[F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(i), F.col(c))) for i, c in enumerate(link_cols)]).alias("links"))
    rows = shared.stored(rows.withColumn("node", F.monotonically_increasing_id()), "documents")
    state = gather_equal(rows.select("node", "text_hash"), shards)

    # values that different texts share
    named = rows.where("text_hash IS NOT NULL").select(F.col("text_hash").alias("unit"), F.explode("links").alias("link")).where("link IS NOT NULL").distinct()
    common = named.groupBy("link").agg(F.count("*").alias("n")).where("n > 1").select("link")
    again = F.xxhash64(F.lit(7), "link")
    links = shared.stored(named.withColumn("again", again).join(common.withColumn("again", again), ["again", "link"]).select("unit", "link"), "links")
    if links.head(1):
        units = rows.where("text_hash IS NOT NULL").join(state, "node").groupBy(F.col("text_hash").alias("unit")).agg(
            F.count("*").alias("weight"), F.min("shard").alias("shard"), F.max("shard").alias("last"))
        units = shared.stored(units.where("shard = last").select("unit", "weight", "shard"), "units")
        moved = shared.stored(propagate(units, links, shards, rounds).withColumnsRenamed({"unit": "text_hash", "shard": "new"}), "moved")
        linked = links.select(F.col("unit").alias("text_hash"), F.lit(True).alias("near")).distinct()
        to = rows.where("text_hash IS NOT NULL").select("node", "text_hash").join(linked, "text_hash").join(moved, "text_hash", "left")
        state = state.join(to.select("node", "near", "new"), "node", "left").select(
            "node", F.coalesce("new", "shard").cast("int").alias("shard"), (F.col("linked") | F.coalesce("near", F.lit(False))).alias("linked"))
    state = shared.stored(numbered(state, "shard", ["node"], "place", F.col("linked")), "places")

    counted = state.groupBy("shard").agg(F.count("*").alias("n"), F.count_if("linked").alias("linked")).collect()
    sizes, held = ({r["shard"]: r[name] for r in counted} for name in ("n", "linked"))
    even, extra = divmod(sum(sizes.values()), shards)
    ranked = sorted(range(shards), key=lambda s: (-(held.get(s, 0) > even), -sizes.get(s, 0), s))
    quota = {s: even + (i < extra) for i, s in enumerate(ranked)}
    over, gaps, at = {}, [], 0
    for s in range(shards):
        over[s] = at
        at += max(sizes.get(s, 0) - quota[s], 0)
    at = 0
    for s in range(shards):
        if (room := quota[s] - sizes.get(s, 0)) > 0:
            gaps.append((at, s, sizes.get(s, 0)))
            at += room
    pick = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("shard")]
    excess = F.col("place") - pick(quota) + pick(over)
    target, slot = F.lit(-1), F.lit(-1).cast("long")
    for begin, s, filled in gaps:
        target = F.when(excess >= begin, F.lit(s)).otherwise(target)
        slot = F.when(excess >= begin, excess - begin + filled).otherwise(slot)
    stays = F.col("place") < pick(quota)
    final = state.select("node", F.when(stays, F.col("shard")).otherwise(target).cast("int").alias("shard"),
                         F.when(stays, F.col("place")).otherwise(slot).cast("long").alias("slot"))
    return rows.join(final, "node").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                                           F.lit(None).cast("int").alias("grown_shard"))
