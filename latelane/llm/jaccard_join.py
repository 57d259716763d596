"""Near duplicates: a size-aware heavy-light join on the Jaccard similarity of shingles.

A document's set is its distinct five-word shingles (A-Z lower-cased; a shorter text is one
shingle, no word the empty set). Two documents link when their sets' similarity reaches
the threshold. The result is exact, up to equal 64-bit hashes of different shingles within
a pair; equal sets are equal 128-bit digests.

1. Equal sets form a class, and one stands for all.
2. A class can link only if at least the overlap it needs is shared with others. A fixed
   part of the shingles, spread by hash, is counted first and rules out nearly all classes.
3. Shingles of the classes left are ordered from rare to common. Sets that link share a
   shingle among the first of that order, and two among the first and one more. Small sets
   enumerate these pairs (subsets of fixed size); large sets, and the small ones that can
   link to them, go to the shingles' inverted lists. The size where one becomes cheaper
   than the other, by the subsets and the list lengths of this input, is the boundary.
4. Every bucket of either kind is first compared with one pivot, which takes in groups of
   copies in linear work. Buckets that still hold several components are joined into
   blocks; a task scans the inverted lists of two blocks and returns links only.

No pairs are emitted within a group, nothing is capped. Broadcast are a bit table of at
most ``FILTER_BITS`` bits and tables of sizes up to ``MOST_SMALL``.

Defined results: null and empty texts have n_shingles 0 and link with nothing, each other
included; repeated rows are documents of the same set; rows with a null doc_id take part
and get their group's smallest known doc_id; an empty table gives an empty table; only
doc_id and text are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from latelane.llm.common import lower_ascii, map_rows, with_package, written
from latelane.llm.components import components

WORDS_PER_SHINGLE = 5
THRESHOLD = 75  # per cent
COUNTED = 0.4  # part of the shingles that rules out classes; must exceed 1 - threshold
SLICE_SHINGLES = 1_000_000  # shingles a task sorts at a time
FILTER_BITS = 1 << 28
MOST_SMALL = 256  # largest set size that may count as small
BLOCK = 256  # sets per block
SCANNED_PER_ROW = 500  # list entries a task scans in the time that one more row costs

_MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                               0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingles(text: str | None, seed: int = 0) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    # bytes.split() cuts at exactly the six ASCII white-space bytes that end words here.
    words = lower_ascii(text or "").encode().split()
    if len(words) < WORDS_PER_SHINGLE:
        whole = [xxhash.xxh3_64_intdigest(b"\n".join(words), seed=seed)] if words else []
        return np.array(whole, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - WORDS_PER_SHINGLE + 1
    h = np.full(n, seed + 1, np.uint64)
    for k in range(WORDS_PER_SHINGLE):
        h = (h ^ hashed[k : k + n]) * _MIX[k]
        h ^= h >> np.uint64(32)
    h.sort()  # and a mask: for these faster than np.unique
    return h[np.r_[True, h[1:] != h[:-1]]]


def set_digest(tokens: np.ndarray) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)


def needed(n: Column | str) -> Column:
    """Least overlap of a set of n with any set it links to."""
    return F.ceil(F.col(n) * THRESHOLD / 100) if isinstance(n, str) else F.ceil(n * THRESHOLD / 100)


# 1 and 2: classes, and which of them can link at all


def _counted(tokens: np.ndarray) -> np.ndarray:
    return tokens[(tokens >> np.uint64(8)) % np.uint64(1000) < np.uint64(int(COUNTED * 1000))]


def _class_scan(docs: DataFrame, seed: int, ranges: int) -> DataFrame:
    """One row per document (kind 0), and per (class, range of shingles) the number of the
    class's counted shingles there that other classes have too (kind 1).

    A shingle that two classes of a slice share is known to be shared and is sent once, so
    its postings are no more than the slices, however common it is.
    """

    def make():
        held: list[tuple[int, np.ndarray]] = []
        seen: set[int] = set()
        size = 0
        # Document rows only pass through the grouped step: they are dealt to it in turn, so
        # that copies of a text do not meet there.
        turn = itertools.count(TaskContext.get().partitionId())

        def sliced() -> Iterator[tuple]:
            nonlocal size
            if size:
                keys = np.array([k for k, _ in held], np.int64)
                owner = np.repeat(np.arange(len(held), dtype=np.int32), [len(t) for _, t in held])
                tokens = np.concatenate([t for _, t in held])
                held.clear()  # the arrays are let go as soon as they are used
                order = np.argsort(tokens, kind="stable")
                tokens, owner = tokens[order], owner[order]
                del order
                start = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
                lengths = np.diff(np.r_[start, len(tokens)])
                shared = lengths > 1
                here = np.bincount(owner[np.repeat(shared, lengths)], minlength=len(keys))
                del lengths
                for i in np.flatnonzero(here):
                    yield int(keys[i]) % ranges, 1, None, 0, 0, int(keys[i]), 0, int(here[i]), None, None
                tokens, owners = tokens[start], np.where(shared, np.int32(-1), owner[start])
                del owner, start, shared
                part = ((tokens >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                cuts = np.searchsorted(part, np.arange(ranges + 1))
                for r in range(ranges):
                    a, b = cuts[r], cuts[r + 1]
                    if a < b:
                        used, place = np.unique(owners[a:b], return_inverse=True)
                        dictionary = np.where(used < 0, 0, keys[used])
                        marked = np.r_[used < 0].astype(np.int64)
                        head = np.r_[len(used), marked, dictionary].astype(np.int64).tobytes()
                        kind = np.uint16 if len(used) < 65536 else np.uint32
                        yield r, 2, None, 0, 0, 0, 0, kind().itemsize, tokens[a:b].tobytes(), head + place.astype(kind).tobytes()
            held.clear()
            seen.clear()
            size = 0

        def each(doc_id, text):
            nonlocal size
            tokens = shingles(text, seed)
            hi, lo = set_digest(tokens)
            counted = _counted(tokens)
            yield next(turn) % ranges, 0, doc_id, len(tokens), len(counted), hi, lo, 0, None, None
            if hi not in seen:
                seen.add(hi)
                held.append((hi, counted))
                size += len(counted)
            if size >= SLICE_SHINGLES:
                yield from sliced()

        each.end = sliced
        return each

    id_kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"r int, kind int, doc_id {id_kind}, n bigint, counted bigint, hi bigint, lo bigint, "
        "shared bigint, tokens binary, owners binary"
    )
    rows = map_rows(
        docs.select("doc_id", "text"), schema, make, size=lambda r: len(r[8] or b"") + len(r[9] or b"")
    )
    out = f"kind int, doc_id {id_kind}, n bigint, counted bigint, hi bigint, lo bigint, shared bigint"
    names = [c.split()[0] for c in out.split(", ")]

    def in_range(table: pa.Table) -> pa.Table:
        posted = np.asarray(table.column("kind")) == 2
        plain = table.filter(pa.array(~posted)).select(names)
        all_tokens, all_owners, all_marks = [], [], []
        for tokens, owners, width in zip(
            *(table.filter(pa.array(posted)).column(c).to_pylist() for c in ("tokens", "owners", "shared"))
        ):
            used = int(np.frombuffer(owners, np.int64, 1)[0])
            head = np.frombuffer(owners, np.int64, 2 * used, 8)
            place = np.frombuffer(owners, np.uint16 if width == 2 else np.uint32, offset=8 + 16 * used)
            all_tokens.append(np.frombuffer(tokens, np.uint64))
            all_marks.append(head[:used][place] > 0)
            all_owners.append(head[used:][place])
        if not all_tokens:
            return plain
        tokens, owners, marks = map(np.concatenate, (all_tokens, all_owners, all_marks))
        order = np.argsort(tokens, kind="stable")
        tokens, owners, marks = tokens[order], owners[order], marks[order]
        start = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
        lengths = np.diff(np.r_[start, len(tokens)])
        marked = np.logical_or.reduceat(marks, start)
        # Without a mark: shared if two owners differ.
        several = np.minimum.reduceat(owners, start) != np.maximum.reduceat(owners, start)
        is_shared = np.repeat(marked | several, lengths) & ~marks
        keys, counts = np.unique(owners[is_shared], return_counts=True)
        k, zero = len(keys), np.zeros(len(keys), np.int64)
        found = pa.table(
            [
                pa.array(np.ones(k, np.int32)),
                pa.nulls(k, plain.schema.field("doc_id").type),
                *(pa.array(c) for c in (zero, zero, keys, zero, counts.astype(np.int64))),
            ],
            names=names,
        )
        return pa.concat_tables([plain, found.cast(plain.schema)])

    return rows.groupBy("r").applyInArrow(in_range, out)


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Document rows, classes that can link, and the seed whose digests tell classes apart."""
    spark = docs.sparkSession
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    seed = 0
    while True:
        scan = written(_class_scan(docs, seed, ranges), "class_scan")
        rows = scan.where("kind = 0")
        # Half of the digest names a class; the other half shows whether that is unique.
        found = rows.groupBy("hi").agg(
            F.max("n").alias("n"),
            F.max("counted").alias("counted"),
            (F.min("lo") < F.max("lo")).alias("several"),
        )
        shared = scan.where("kind = 1").groupBy("hi").agg(F.sum("shared").alias("shared"))
        classes = written(found.join(shared, "hi", "left"), "classes")
        if classes.where("several").isEmpty():
            break
        seed += 1  # two sets share half a digest: expected once in 2^64 pairs
    unshared = F.col("counted") - F.coalesce("shared", F.lit(0))
    able = unshared <= F.col("n") - needed("n")
    live = classes.where(able & (F.col("n") > 1)).select("hi", "n")
    return rows.select("doc_id", "n", "hi"), live, seed


# 3: sets of the classes left, rare shingles first


def _bits(count: int) -> int:
    return min(FILTER_BITS, max(1 << 16, 1 << (16 * count).bit_length()))


def _bit_table(live: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter over the live classes: three bits each, cut out of the digest."""
    place = [F.shiftrightunsigned("hi", shift).bitwiseAND(F.lit(bits - 1)) for shift in (0, 18, 36)]
    words = (
        live.select(F.explode(F.array(*place)).alias("bit"))
        .groupBy(F.shiftrightunsigned("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("value"))
        .toPandas()  # at most FILTER_BITS / 64 rows
    )
    table = np.zeros(bits // 64, np.int64)
    table[words["word"].to_numpy()] = words["value"].to_numpy()
    return table


def _live_sets(docs: DataFrame, live: DataFrame, seed: int) -> DataFrame:
    """(hi, n, tokens) of the classes that can link; the sets are made anew from the texts.

    The bit table keeps nearly all other sets from being moved, the join all.
    """
    bits = _bits(live.count())
    shared = docs.sparkSession.sparkContext.broadcast(_bit_table(live, bits))  # FILTER_BITS bits

    def make():
        table, sent = shared.value, set()
        mask = bits - 1

        def known(hi: int) -> bool:
            h = hi & ((1 << 64) - 1)
            places = (h & mask, (h >> 18) & mask, (h >> 36) & mask)
            return all((int(table[p >> 6]) >> (p & 63)) & 1 for p in places)

        def each(text):
            tokens = shingles(text, seed)
            hi = set_digest(tokens)[0]
            if hi not in sent and known(hi):
                if len(sent) >= 500_000:
                    sent.clear()
                sent.add(hi)
                yield hi, tokens.view(np.int64)

        return each

    found = map_rows(
        docs.select("text"), "hi bigint, tokens array<bigint>", make, size=lambda r: 8 * len(r[1])
    )
    sets = found.groupBy("hi").agg(F.first("tokens").alias("tokens"))
    return written(sets.join(live, "hi"), "able_sets")


def _ordered(sets: DataFrame) -> DataFrame:
    """(hi, n, shared, df): the shingles other able classes have too, rare ones first, of
    the classes that still share as much as a link needs."""
    tokens = sets.select("hi", "n", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = tokens.join(written(counts, "shared_shingles"), "token")
    lists = ranked.groupBy("hi", "n").agg(
        F.array_sort(F.collect_list(F.struct("df", "token"))).alias("pairs")  # one set
    )
    return written(
        lists.where(F.size("pairs") >= needed("n")).select(
            "hi", "n", F.col("pairs.token").alias("shared"), F.col("pairs.df").alias("df")
        ),
        "ordered_sets",
    )


def _prefix(lists: DataFrame, size: int) -> DataFrame:
    """``prefix`` and ``weights``: what the first n - needed + size shingles of each set
    hold besides those that no other set has, which come first."""
    length = F.col("n") - needed("n") + size - (F.col("n") - F.size("shared"))
    length = F.greatest(F.lit(0), F.least(length, F.size("shared"))).cast("int")
    return lists.select(
        "hi", "n", F.slice("shared", 1, length).alias("prefix"), F.slice("df", 1, length).alias("weights")
    )


def small_limit(lists: DataFrame) -> int:
    """The size up to which enumerating pairs costs less than scanning inverted lists."""
    pairs = _prefix(lists, 2).select("hi", (F.size("prefix") * (F.size("prefix") - 1) / 2).alias("pairs"))
    entries = F.aggregate("weights", F.lit(0).cast("bigint"), lambda a, x: a + x)
    scans = _prefix(lists, 1).select(
        "hi", "n", (F.size("prefix") + entries / SCANNED_PER_ROW).alias("scanned")
    )
    costs = (
        scans.where(F.col("n") <= MOST_SMALL)
        .join(pairs, "hi")
        .groupBy("n")
        .agg(F.sum("pairs").alias("pairs"), F.sum("scanned").alias("scanned"))
        .toPandas()  # at most MOST_SMALL rows
        .sort_values("n")
    )
    limit, gain, best = 0, 0.0, 0.0
    for row in costs.itertuples():
        gain += row.scanned - row.pairs
        if gain > best:
            limit, best = int(row.n), gain
    return limit


def _members(lists: DataFrame, limit: int) -> DataFrame:
    """(kind, key, hi, pivot) of all buckets with at least two sets."""
    choose = """
        flatten(transform(sequence(0, size(prefix) - 2), i ->
            transform(sequence(i + 1, size(prefix) - 1), j -> xxhash64(prefix[i], prefix[j]))))
    """
    small = _prefix(lists, 2).where((F.col("n") <= limit) & (F.size("prefix") > 1))
    large = _prefix(lists, 1).where(100 * F.col("n") >= THRESHOLD * (limit + 1))
    keys = small.select(F.lit(2).alias("kind"), F.explode(F.expr(choose)).alias("key"), "hi").unionByName(
        large.select(F.lit(1).alias("kind"), F.explode("prefix").alias("key"), "hi")
    )
    buckets = keys.groupBy("kind", "key").agg(F.count("*").alias("size"), F.min("hi").alias("pivot"))
    buckets = written(buckets.where("size > 1").drop("size"), "buckets")
    return written(keys.join(buckets, ["kind", "key"]), "bucket_members")


# 4: links


def _linking(overlap, n, m):
    return 100 * overlap >= THRESHOLD * (n + m - overlap)


def _pivot_links(members: DataFrame, lists: DataFrame) -> DataFrame:
    """Links (a, b) between a bucket's pivot and its other sets."""
    pairs = members.where("hi <> pivot").select(F.col("hi").alias("a"), F.col("pivot").alias("b"))
    pairs = pairs.distinct()

    def side(name: str) -> DataFrame:
        return lists.select(
            F.col("hi").alias(name), F.col("n").alias(f"n_{name}"), F.col("shared").alias(f"s_{name}")
        )

    overlap = F.size(F.array_intersect("s_a", "s_b"))
    near = 100 * F.least("n_a", "n_b") >= THRESHOLD * F.greatest("n_a", "n_b")
    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .where(near & _linking(overlap, F.col("n_a"), F.col("n_b")))
        .select("a", "b")
    )


def _labelled(nodes: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """``nodes`` with the component of ``hi`` as ``name``, itself if it has no other node."""
    found = nodes.join(labels.withColumnRenamed("node", "hi"), "hi", "left")
    return found.withColumn(name, F.coalesce("component", "hi")).drop("component")


def _tiles(members: DataFrame, lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Sets to compare: (tile, side, hi, component, n, shared), two blocks a tile.

    Buckets that hold several components are joined into groups, groups are dealt to
    blocks of about ``BLOCK`` sets, large components to blocks of their own. Two blocks of
    one component need no comparison.
    """
    known = _labelled(members, labels, "of")
    still_open = (
        known.groupBy("kind", "key")
        .agg(F.min("of").alias("first"), F.max("of").alias("last"))
        .where("first <> last")
        .select("kind", "key")
    )
    left = written(known.join(still_open, ["kind", "key"]), "open_members")
    groups = written(components(left.select(F.col("hi").alias("a"), F.col("pivot").alias("b"))), "groups")
    sets = _labelled(left.select("hi", "of").distinct(), groups, "group_id")
    sets = written(sets.join(lists.select("hi", "n"), "hi"), "open_sets")
    sizes = sets.groupBy("group_id", "of").agg(F.count("*").alias("size"))
    # Sets of small components share the home 0.
    home = F.when(F.col("size") >= BLOCK, F.col("of")).otherwise(F.lit(0))
    parts = sizes.withColumn("home", home)
    slots = parts.groupBy("group_id", "home").agg(F.ceil(F.sum("size") / BLOCK).alias("slots"))
    parts = parts.select("group_id", "of", "home").join(slots, ["group_id", "home"])
    dealt = sets.join(parts, ["group_id", "of"])
    slot = F.pmod(F.xxhash64("hi", F.lit(11)), F.col("slots"))
    block = F.xxhash64("group_id", "home", slot)
    dealt = written(dealt.select("hi", "of", "n", "group_id", block.alias("block")), "blocks")
    blocks = dealt.groupBy("group_id", "block").agg(
        F.min("of").alias("first"), F.max("of").alias("last"), F.min("n").alias("low"), F.max("n").alias("high")
    )
    x, y = blocks.alias("x"), blocks.alias("y")
    pairs = x.join(y, F.expr("x.group_id = y.group_id and x.block <= y.block")).where(
        "not (x.first = x.last and y.first = y.last and x.first = y.first)"
        f" and 100 * least(x.high, y.high) >= {THRESHOLD} * greatest(x.low, y.low)"
    )
    tile = F.xxhash64("x.block", "y.block").alias("tile")
    pairs = pairs.select(tile, F.col("x.block").alias("x"), F.col("y.block").alias("y"))
    ends = pairs.select("tile", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    full = lists.select("hi", "shared")
    return ends.join(dealt, "block").join(full, "hi").select("tile", "block", "hi", "of", "n", "shared")


def _tile_links(tiles: DataFrame) -> DataFrame:
    """Pairs (a, b) of components that a link between two of their sets joins.

    A tile is a group of its own: two blocks are in memory at a time, however many there are.
    """

    def scanned(table: pa.Table) -> pa.Table:
        table = table.sort_by("hi").combine_chunks()
        block, of, n = (np.asarray(table.column(c)) for c in ("block", "of", "n"))
        lists = table.column("shared").combine_chunks()
        found = _scan_lists(np.asarray(lists.values), np.asarray(lists.offsets), block, of, n)
        links = np.array([(of[i], of[j]) for i, j in found], np.int64).reshape(-1, 2)
        return pa.table({"a": links[:, 0], "b": links[:, 1]})

    return with_package(tiles).groupBy("tile").applyInArrow(scanned, "a bigint, b bigint")


def _scan_lists(values, offsets, block, of, n) -> list[tuple[int, int]]:
    """Index pairs that link, by inverted lists over the sets of a tile's second block."""
    two = block[0] != block.max() or block[0] != block.min()
    queries = np.flatnonzero(block == block.min()) if two else np.arange(len(block))
    listed = np.flatnonzero(block != block.min()) if two else np.arange(len(block))
    lengths = offsets[listed + 1] - offsets[listed]
    tokens = np.concatenate([values[offsets[i] : offsets[i + 1]] for i in listed])
    owner = np.repeat(np.arange(len(listed)), lengths)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    found: list[tuple[int, int]] = []
    joined: set[tuple[int, int]] = set()
    for q in queries:
        query = values[offsets[q] : offsets[q + 1]]
        first, last = np.searchsorted(tokens, query, "left"), np.searchsorted(tokens, query, "right")
        counts = last - first
        total = int(counts.sum())
        if not total:
            continue
        at = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
        overlap = np.bincount(owner[at], minlength=len(listed))
        hit = _linking(overlap, n[q], n[listed]) & (of[listed] != of[q])
        for j in listed[np.flatnonzero(hit)]:
            pair = (min(of[q], of[j]), max(of[q], of[j]))
            if pair not in joined:
                joined.add(pair)
                found.append((q, j))
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) per row."""
    rows, live, seed = _classes(docs)
    lists = _ordered(_live_sets(docs, live, seed))
    members = _members(lists, small_limit(lists))
    near = written(components(_pivot_links(members, lists)), "pivot_components")
    rest = written(components(_tile_links(_tiles(members, lists, near))), "tile_components")
    # Components of the first step are the nodes of the second.
    whole = _labelled(rows, near, "of").join(rest.select(F.col("node").alias("of"), "component"), "of", "left")
    whole = whole.withColumn("class", F.coalesce("component", "of")).select("doc_id", "n", "class")
    labelled = written(whole, "labelled_documents")
    least = written(labelled.groupBy("class").agg(F.min("doc_id").alias("least")), "least_documents")
    return labelled.join(least, "class").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    )
