"""Benchmark decontamination by a broadcast set of n-grams, with DataFrame functions only.

Texts are lower-cased (A-Z) and cut into words at ASCII characters that are neither letter
nor digit. A benchmark item's windows are its runs of ``WINDOW`` consecutive words; an item of
fewer words, but not none, is one window. The hashes of all distinct windows form a set that
is broadcast; each document's words are hashed once, its rolling windows of the lengths that
occur in the set are looked up, and every hit is verified word by word.

The set goes out in blocks of about ``BLOCK`` hashes, as many as its counted size needs, so no
broadcast grows with the benchmark; with several blocks the documents' words are written first
and scanned once per block. A window's look-up is a row that lives inside one stage; only
verified hits are shuffled. Hits are counted per document, so a passage that a third of all
documents share is spread like the documents; words under several windows count once.

Documents are told apart by their place in the scan, so repeated and null ids are scanned one
by one. Null texts have no words; a null item id is left out of the sorted ids but counts as
an item; items that repeat an id are one item with the windows of all its rows. An empty
benchmark hits nothing, an empty table gives an empty one. Of the documents only doc_id and
text are read by ``contaminated``; ``decontaminated`` passes all other columns through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from latelane.llm.common import written

WINDOW = 10
BLOCK = 500_000  # hashes a broadcast holds, about

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str) -> Column:
    """The lower-cased words of a text."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lower, _SEPARATORS), "")


def _windows(size: int) -> str:
    """Expression: hashes of all windows of ``size`` words, in text order, from ``hashes``."""
    each = ", ".join(f"hashes[i + {k}]" if k else "hashes[i]" for k in range(size))
    return (
        f"case when size(hashes) < {size} then array() else "
        f"transform(sequence(0, size(hashes) - {size}), i -> xxhash64({each})) end"
    )


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, size, hash, gram) of the distinct windows of every item."""
    items = benchmark.select("item_id", words_of("text").alias("words")).where("size(words) > 0")
    size = F.least(F.size("words"), F.lit(window))
    placed = items.withColumn("size", size).withColumn(
        "at", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size")))
    )
    gram = F.slice("words", F.col("at") + 1, F.col("size")).alias("gram")
    grams = placed.select("item_id", "size", gram).distinct()
    hashed = F.transform("gram", lambda w: F.xxhash64(w))
    # Of a gram's word hashes, as many as it has.
    cases = F.expr(
        "case "
        + " ".join(f"when size = {n} then xxhash64({', '.join(f'hashes[{k}]' for k in range(n))})" for n in range(1, window + 1))
        + " end"
    )
    return grams.withColumn("hashes", hashed).withColumn("hash", cases).drop("hashes")


def worded(docs: DataFrame) -> DataFrame:
    """doc_id, row (its place in the scan) and the words of every document."""
    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words_of("text").alias("words"))


def scan(words: DataFrame, block: DataFrame, sizes: list[int], whole: bool) -> DataFrame:
    """(doc_id, row, n_words, at, size, hash, gram) of windows whose hash is in ``block``;
    if ``whole``, also a row per document with a null hash."""
    hashed = words.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    listed = ", ".join(_windows(size) for size in sizes) or "cast(array() as array<bigint>)"
    # The document's own row stands first; the windows of each size follow in text order.
    lookups = F.expr(f"concat(array(cast(null as bigint)), {listed})")
    looked = hashed.select("doc_id", "row", "words", F.posexplode(lookups).alias("pos", "hash"))
    known = F.broadcast(block.withColumn("known", F.lit(True)))  # about BLOCK hashes
    found = looked.join(known, "hash", "left").where(F.col("known") | F.col("hash").isNull() if whole else F.col("known"))
    count = F.size("words")
    at, of = F.lit(None).cast("int"), F.lit(None).cast("int")
    before = F.lit(1)
    for size in sizes:
        n = F.greatest(count - (size - 1), F.lit(0))
        here = F.col("hash").isNotNull() & (F.col("pos") >= before) & (F.col("pos") < before + n)
        at = F.when(here, F.col("pos") - before).otherwise(at)
        of = F.when(here, F.lit(size)).otherwise(of)
        before = before + n
    placed = found.withColumn("at", at).withColumn("size", of)
    gram = F.when(F.col("hash").isNotNull(), F.slice("words", F.col("at") + 1, F.col("size")))
    return placed.select("doc_id", "row", count.cast("bigint").alias("n_words"), "at", "size", "hash", gram.alias("gram"))


def scanned(docs: DataFrame, windows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``scan`` of all documents against all windows (a written table of this)."""
    hashes = windows.select("hash").distinct()
    n = hashes.count()
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most WINDOW
    blocks = max(1, -(-n // block))
    words = worded(docs)
    if blocks > 1:
        words = written(words, "worded")  # so that a row is the same row for each block
    parts = [
        scan(words, hashes.where(F.pmod(F.xxhash64("hash"), F.lit(blocks)) == b), sizes, b == 0) for b in range(blocks)
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return written(whole, "benchmark_hits")


def verified(found: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, at, size, item_id) of hits whose words are the window's."""
    return found.where("hash is not null").select("row", "at", "size", "hash", "gram").join(
        windows.select("item_id", "hash", "gram"), ["hash", "gram"]
    ).select("row", "at", "size", "item_id")


def spans(hits: DataFrame) -> DataFrame:
    """(row, first, last) word ranges that hits cover: overlapping and touching ones merged."""
    placed = hits.groupBy("row", "at").agg(F.max("size").alias("size"))
    order = Window.partitionBy("row").orderBy("at")
    end = F.col("at") + F.col("size")
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col("at") > reach)).cast("int")
    numbered = placed.withColumn("new", new).withColumn("span", F.sum("new").over(order))
    return numbered.groupBy("row", "span").agg(F.min("at").alias("first"), F.max(end - 1).alias("last")).drop("span")


def _per_row(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, n_hit) and (row, n_items, items): hit words, items and their sorted ids."""
    words = spans(hits).groupBy("row").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n_hit"))
    items = hits.select("row", "item_id").distinct().groupBy("row").agg(
        F.count("*").alias("n_items"),
        # Of the benchmark's ids those of one document.
        F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items"),
    )
    return words, items


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    windows = written(benchmark_windows(benchmark, window), "benchmark_windows")
    found = scanned(docs, windows)
    hits = written(verified(found, windows), "verified_hits")
    words, items = _per_row(hits)
    ids = F.array_join(F.coalesce("items", F.array().cast("array<string>")), ",")
    none = F.lit(0).cast("bigint")
    return (
        found.where("hash is null").select("doc_id", "row", "n_words")
        .join(written(words, "hit_words"), "row", "left")
        .join(written(items, "hit_items"), "row", "left")
        .select(
            "doc_id", "n_words",
            F.coalesce("n_hit", none).alias("n_hit"),
            F.coalesce("n_items", none).alias("n_items"),
            F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents (``remove="documents"``), or with their hit
    words cut out of ``text`` (``"spans"``), each with the separators that follow it.

    Clean rows come back as they were. The documents are written once, with their places.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    names = docs.columns
    placed = written(docs.select("*", F.monotonically_increasing_id().alias("_row")), "placed_documents")
    windows = written(benchmark_windows(benchmark, window), "benchmark_windows")
    # The place takes the id's column: scan numbers rows anew.
    found = scanned(placed.select(F.col("_row").alias("doc_id"), "text"), windows)
    place = found.where("hash is null").select("row", F.col("doc_id").alias("_row"))
    hits = written(verified(found, windows), "verified_hits")
    if remove == "documents":
        hit = place.join(hits.select("row").distinct(), "row", "left_semi").select("_row")
        return placed.join(hit, "_row", "left_anti").select([F.col(f"`{c}`") for c in names])
    ranges = spans(hits).groupBy("row").agg(
        F.collect_list(F.struct("first", "last")).alias("_ranges")  # of one document
    )
    ranges = place.join(ranges, "row").select("_row", "_ranges")
    joined = placed.join(written(ranges, "hit_ranges"), "_row", "left")
    # Separators around the words, one more than words; empty ones at the text's ends.
    parts = joined.withColumn("_words", F.expr(f"regexp_extract_all(text, r'({_WORDS})', 1)")).withColumn(
        "_between", F.split("text", _WORDS, -1)
    )
    kept = F.expr(
        """array_join(concat(array(_between[0]), transform(
             filter(sequence(0, size(_words) - 1),
                    i -> not exists(_ranges, r -> i between r.first and r.last)),
             i -> concat(_words[i], _between[i + 1]))), '')"""
    )
    text = F.when(F.col("_ranges").isNull(), F.col("text")).otherwise(kept)
    return parts.withColumn("text", text).select([F.col(f"`{c}`") for c in names])
