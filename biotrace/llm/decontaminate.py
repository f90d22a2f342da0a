"""Benchmark passages in documents, with built-in expressions only.

A window of a document has as many words as a benchmark item, and starts at any word. For
the similarity asked for, most of its word runs must occur in items of that size: how many
follows from the similarity. Windows with fewer cannot resemble an item and are passed
over; all others get a 64-bit SimHash of their runs, as every item does. A fingerprint is cut
into RADIUS + 1 blocks; two fingerprints within the radius agree in one block at least, so
the join on (words, block, bits) finds them all. Candidates within the radius are verified
by the exact similarity of their runs, each weighted by how often it occurs. Where and in
what order the runs stand in the window plays no part.

Windows of equal runs are fingerprinted and verified once, however many documents hold them.

Words are runs of letters and digits of the lower-cased text. An item with fewer than five
words is one run of all its words, and windows for it come from runs of that many words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotrace.llm.common import BROADCAST_ROWS, materialize

WORDS = 5
BITS = 64
# At similarity 0.8 the cosine of the run weights is 0.89 for equal weights, so a bit differs
# with probability 0.15: 10 of 64 bits, with a standard deviation of 3. About one pair in
# 20,000 that stands exactly at 0.8 lies beyond the radius.
RADIUS = 21
_SPLIT = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Words of a text; empty for null and for texts without letters and digits."""
    return F.filter(F.split(F.lower(text), _SPLIT), lambda w: w != "")


def runs_of(words: Column, size: int = WORDS) -> Column:
    """Hashes of all runs of `size` words, in order; empty for fewer words.

    A run is the hash of its words' hashes, so it costs no new string.
    """

    def runs(hashes: Column) -> Column:
        def run(at: Column) -> Column:
            return F.xxhash64(*[F.get(hashes, at + j) for j in range(size)])

        places = F.sequence(F.lit(0), F.size(hashes) - size)
        none = F.array().cast("array<bigint>")
        return F.when(F.size(hashes) >= size, F.transform(places, run)).otherwise(none)

    # The array of one names the hashes, which are then computed once and not per place.
    return F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), runs)[0]


def _fingerprint(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash of the runs of each key, from rows (keys, run, weight)."""
    bits = [
        F.sum(
            F.when(F.shiftright(F.xxhash64("run"), i).bitwiseAND(1) == 1, F.col("weight")).otherwise(
                -F.col("weight")
            )
        ).alias(f"b{i}")
        for i in range(BITS)
    ]
    sums = weighted.groupBy(*keys).agg(*bits)
    print_ = F.lit(0).cast("long")
    for i in range(BITS):
        print_ = print_.bitwiseOR(F.when(F.col(f"b{i}") > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(0))
    return sums.select(*keys, print_.alias("print"))


def blocks_of(fingerprint: Column) -> Column:
    """The blocks of a fingerprint, as (number, bits)."""
    edges = [round(i * BITS / (RADIUS + 1)) for i in range(RADIUS + 2)]
    return F.array(
        *[
            F.struct(
                F.lit(n).alias("block"),
                F.shiftrightunsigned(fingerprint, low).bitwiseAND(2 ** (high - low) - 1).alias("bits"),
            )
            for n, (low, high) in enumerate(zip(edges, edges[1:], strict=False))
        ]
    )


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    num: int = 4,
    den: int = 5,
) -> DataFrame:
    """(doc_id, item_id, start, words, shared, total) of every window that resembles an item.

    start and words give the window in words of the document; shared / total is the
    weighted similarity of the window and the item, at least num / den. One row per
    document and item: the most similar window, the first of equals. Null and empty texts
    and items match nothing. Texts that share an id are all looked at, and the best window
    of any counts. A document shorter than an item is a window of its own. Other columns are
    not read.
    """
    items = (
        benchmark.select(
            F.col(item_col).cast("long").alias("item_id"),
            words_of(F.col(item_text_col).cast("string")).alias("words"),
        )
        .where("item_id IS NOT NULL AND size(words) > 0")
        .withColumn("size", F.size("words"))
        .withColumn("span", F.least(F.lit(WORDS), F.col("size")))
    )
    spans = [r["span"] for r in items.select("span").distinct().collect()]
    text = F.col(text_col).cast("string")
    # Texts that share an id are told apart by their hash.
    docs = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text")
    ).where("doc_id IS NOT NULL")
    found = [
        _matches(docs, items.where(F.col("span") == span), span, num, den) for span in sorted(spans)
    ]
    if not found:
        return docs.sparkSession.createDataFrame([], _MATCH)
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    best = F.struct(
        (F.col("shared") / F.col("total")).alias("similarity"),
        (-F.col("start")).alias("first"),
        "start",
        "words",
        "shared",
        "total",
    )
    return (
        out.groupBy("doc_id", "item_id")
        .agg(F.max(best).alias("best"))
        .select("doc_id", "item_id", "best.start", "best.words", "best.shared", "best.total")
    )


_MATCH = "doc_id long, item_id long, start int, words int, shared long, total long"


def _starts(size: Column, places: Column, n: Column, span: int, num: int, den: int) -> Column:
    """Starts of all windows of `size` words that hold enough of the places.

    2 * num / (num + den) of the runs of two sets of equal size are shared at num / den. The
    k-th next place lies within the window of each such start, which gives the starts as
    ranges around the places.
    """
    runs = size - span + 1
    own = F.least(n, runs)
    need = F.greatest(F.lit(1), F.ceil((own + runs) * num / F.lit(num + den)).cast("int"))
    count = F.size(places)

    def around(i: Column) -> Column:
        low = F.greatest(F.get(places, i + need - 1) - runs + 1, F.lit(0))
        high = F.least(F.get(places, i), F.greatest(n - runs, F.lit(0)))
        none = F.array().cast("array<int>")
        return F.when(low <= high, F.sequence(low, high)).otherwise(none)

    first = F.sequence(F.lit(0), count - need)
    ranges = F.when(count >= need, F.transform(first, around))
    return F.array_distinct(F.flatten(ranges))


def _matches(docs: DataFrame, items: DataFrame, span: int, num: int, den: int) -> DataFrame:
    runs = items.select("item_id", "size", F.explode(runs_of(F.col("words"), span)).alias("run"))
    # Runs that occur in items of a size: few, as they grow with the benchmark alone.
    known = materialize(runs.select("run", "size").distinct(), "item-runs")
    small = known.count() <= BROADCAST_ROWS
    hint = F.broadcast if small else lambda df: df
    hashed = docs.select("doc_id", "key", runs_of(words_of(F.col("text")), span).alias("runs"))
    hits = hashed.select("doc_id", "key", F.size("runs").alias("n"), F.posexplode("runs").alias("at", "run"))
    places = (
        hits.join(hint(known), "run")
        .groupBy("doc_id", "key", "size")
        .agg(F.array_sort(F.collect_set("at")).alias("places"), F.max("n").alias("n"))
    )
    starts = _starts(F.col("size"), F.col("places"), F.col("n"), span, num, den)
    windows = materialize(places.select("doc_id", "key", "size", F.explode(starts).alias("start")), "windows")
    of_doc = windows.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "size")).alias("places"))
    if windows.count() <= BROADCAST_ROWS:
        of_doc = F.broadcast(of_doc)
    placed = docs.join(of_doc, ["doc_id", "key"]).select(
        "doc_id", "key", "places", runs_of(words_of(F.col("text")), span).alias("runs")
    )
    cut = F.transform(
        "places",
        lambda p: F.struct(
            p["start"].alias("start"),
            p["size"].alias("size"),
            F.array_sort(F.slice("runs", p["start"] + 1, p["size"] - span + 1)).alias("runs"),
        ),
    )
    # Two hashes of all runs name the content of a window.
    content = [F.xxhash64(F.lit(n), "window.runs").alias(f"content{n}") for n in (1, 2)]
    names = ["size", "content1", "content2"]
    cuts = materialize(
        placed.select("doc_id", F.explode(cut).alias("window")).select(
            "doc_id", "window.start", "window.size", *content, "window.runs"
        ),
        "window-runs",
    )
    weighted = materialize(
        cuts.groupBy(*names)
        .agg(F.any_value("runs").alias("runs"))
        .select(*names, F.explode("runs").alias("run"))
        .groupBy(*names, "run")
        .agg(F.count(F.lit(1)).alias("weight")),
        "window-weights",
    )
    item_weights = runs.groupBy("item_id", "size", "run").agg(F.count(F.lit(1)).alias("weight"))
    prints = _fingerprint(weighted, names)
    item_prints = _fingerprint(item_weights, ["item_id", "size"])
    block = [F.col("block.block").alias("block"), F.col("block.bits").alias("bits")]
    left = prints.withColumn("block", F.explode(blocks_of(F.col("print")))).select(*names, "print", *block)
    right = item_prints.withColumn("block", F.explode(blocks_of(F.col("print")))).select(
        "item_id", "size", F.col("print").alias("item_print"), *block
    )
    near = (
        left.join(hint(right), ["size", "block", "bits"])
        .where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
        .select(*names, "item_id")
        .distinct()
    )
    shared = (
        near.join(weighted, names)
        .join(hint(item_weights.select("item_id", "run", F.col("weight").alias("item_weight"))), ["item_id", "run"])
        .groupBy(*names, "item_id")
        .agg(F.sum(F.least("weight", "item_weight")).alias("shared"))
    )
    # A document shorter than the item is a window of fewer runs.
    lengths = weighted.groupBy(*names).agg(F.sum("weight").alias("own"))
    alike = materialize(
        shared.join(lengths, names)
        .withColumn("total", F.col("own") + F.col("size") - span + 1 - F.col("shared"))
        .where(F.col("shared") * den >= F.col("total") * num)
        .select(*names, "item_id", "shared", "total"),
        "alike",
    )
    if alike.count() <= BROADCAST_ROWS:
        alike = F.broadcast(alike)
    return (
        cuts.drop("runs")
        .join(alike, names)
        .select("doc_id", "item_id", "start", F.col("size").alias("words"), "shared", "total")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without those that contain a benchmark item; columns stay as they are."""
    found = find_contamination(docs, benchmark, id_col=id_col, **options)
    ids = found.select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(ids, id_col, "left_anti").select(*docs.columns)
