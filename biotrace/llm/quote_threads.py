"""Conversations in reply order, with quotations linked to what they quote and cut out.

Lines that begin with `>` are quoted; the number of marks is the level. A run of lines of
one level is a passage. Passages and their lines, normalised (lower case, one blank for
white space), are hashed to 128 bits and joined to the own passages and lines of all
messages. The parent of a message is the original of its first passage of level 1 that has
one: the last earlier turn of its conversation with that passage, else the first message of
all with it, if that stands in a conversation with a smaller id. Within a conversation any
passage or line tells; across conversations one must be long enough to be no chance hit
(ACROSS_WORDS and ACROSS_CHARS). Without such a quotation the parent is the turn before. Links between conversations join them into threads; within a thread
messages stand by conversation and turn, so each follows its parent.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from biotrace.llm.common import materialize
from biotrace.llm.components import components

# Turns of a conversation, and ids of conversations, that are numbered in one group.
TURNS = 1_000
CONVERSATIONS = 1_000
# A passage links two conversations if it has so many words and characters: shorter ones
# ("yes", "thank you very much") stand in many unrelated conversations.
ACROSS_WORDS = 5
ACROSS_CHARS = 20

_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.S)
# The line that announces a quotation, in four languages.
_ANNOUNCED = re.compile(
    r"\s*(?:On|Le|Am|El)\b.*\b(?:wrote|a écrit|schrieb.*|escribió)\s*:\s*", re.I
)

_PARSED = (
    "conv_id long, turn long, role string, text string, "
    "quotes array<struct<level:int,keys:array<struct<key:binary,far:boolean>>>>, own array<binary>"
)
_KEYS = pa.list_(pa.struct([("key", pa.binary()), ("far", pa.bool_())]))


def _key(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def tells_across(passage: str) -> bool:
    """Whether a normalised passage may link two conversations."""
    return len(passage) >= ACROSS_CHARS and len(passage.split()) >= ACROSS_WORDS


def _normal(lines: list[str]) -> str:
    return " ".join(" ".join(lines).lower().split())


def parse(text: str) -> tuple[str, list[tuple[int, str, list[str]]], list[str]]:
    """Text without quotations, quoted passages as (level, passage, lines), and own passages."""
    runs: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        marked = _MARKS.fullmatch(line)
        level = marked[1].count(">") if marked else 0
        body = marked[2] if marked else line
        if runs and runs[-1][0] == level:
            runs[-1][1].append(body)
        else:
            runs.append((level, [body]))
    kept: list[str] = []
    for i, (level, lines) in enumerate(runs):
        if level:
            continue
        if i + 1 < len(runs):
            while lines and not lines[-1].strip():
                lines = lines[:-1]
            if lines and _ANNOUNCED.fullmatch(lines[-1]):
                lines = lines[:-1]
        kept.append("\n".join(lines).strip() if len(runs) > 1 else "\n".join(lines))
    quotes = [
        (level, _normal(lines), [n for n in (_normal([x]) for x in lines) if n])
        for level, lines in runs
        if level
    ]
    own: list[str] = []
    for level, lines in runs:
        if not level:
            own.append(_normal(lines))
            own += [_normal([p]) for p in re.split(r"\n\s*\n", "\n".join(lines))]
            own += [_normal([x]) for x in lines]
    return "\n".join(k for k in kept if k), quotes, sorted({o for o in own if o})


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, quotes, own = [], [], []
        for text in batch.column(3):
            plain, found, mine = parse(text.as_py() or "")
            texts.append(plain)
            quotes.append(
                [
                    {"level": level, "keys": [{"key": _key(x), "far": tells_across(x)} for x in (passage, *lines)]}
                    for level, passage, lines in found
                    if passage
                ]
            )
            own.append([_key(x) for x in mine])
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(i) for i in range(3)],
                pa.array(texts, pa.string()),
                pa.array(
                    quotes,
                    pa.list_(pa.struct([("level", pa.int32()), ("keys", _KEYS)])),
                ),
                pa.array(own, pa.list_(pa.binary())),
            ],
            ["conv_id", "turn", "role", "text", "quotes", "own"],
        )


def _previous(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, before) with the turn before each turn, in groups of bounded span."""
    turns = messages.select("conv_id", "turn").distinct().withColumn("span", F.floor(F.col("turn") / TURNS))
    inside = turns.withColumn(
        "near", F.lag("turn").over(Window.partitionBy("conv_id", "span").orderBy("turn"))
    )
    spans = turns.groupBy("conv_id", "span").agg(F.max("turn").alias("top"))
    far = spans.select(
        "conv_id", "span", F.lag("top").over(Window.partitionBy("conv_id").orderBy("span")).alias("far")
    )
    return inside.join(far, ["conv_id", "span"]).select(
        "conv_id", "turn", F.coalesce("near", "far").alias("before")
    )


def _quoted(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, from_conv, from_turn): the original of each message that quotes one."""
    passages = parsed.where(F.size("quotes") > 0).select(
        "conv_id", "turn", F.posexplode("quotes").alias("at", "quote")
    ).where("quote.level = 1")
    keys = passages.select("conv_id", "turn", "at", F.posexplode("quote.keys").alias("choice", "tells"))
    keys = materialize(keys.select("conv_id", "turn", "at", "choice", "tells.key", "tells.far"), "quoted")
    # One row per key and turn, and only keys that anyone quotes.
    sought = keys.select("key").distinct()
    originals = (
        parsed.select("conv_id", "turn", F.explode("own").alias("key"))
        .join(sought, "key", "left_semi")
        .distinct()
    )
    first = originals.groupBy("key").agg(
        F.min(F.struct(F.col("conv_id").alias("conv"), F.col("turn").alias("turn"))).alias("first")
    )
    asked = keys.select("conv_id", "turn", "key").distinct()
    both = (
        originals.withColumn("original", F.lit(True))
        .unionByName(asked.withColumn("original", F.lit(False)))
        .withColumn("span", F.floor(F.col("turn") / TURNS))
    )
    # The last original before a turn: in its own span of turns, else in an earlier one.
    group = ["conv_id", "key"]
    original = F.max(F.when(F.col("original"), F.col("turn")))
    earlier = Window.partitionBy(*group, "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    spans = both.groupBy(*group, "span").agg(original.alias("top"))
    ahead = Window.partitionBy(*group).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    far = spans.select(*group, "span", F.max("top").over(ahead).alias("far_turn"))
    inside = (
        both.withColumn("near", original.over(earlier))
        .where(~F.col("original"))
        .join(far, [*group, "span"])
        .select(*group, "turn", F.coalesce("near", "far_turn").alias("near"))
    )
    found = (
        keys.join(inside, ["conv_id", "turn", "key"])
        .join(first, "key", "left")
        .select(
            "conv_id",
            "turn",
            "at",
            "choice",
            F.when(F.col("near").isNotNull(), F.col("conv_id"))
            .when(F.col("far") & (F.col("first.conv") < F.col("conv_id")), F.col("first.conv"))
            .alias("from_conv"),
            F.coalesce("near", "first.turn").alias("from_turn"),
        )
        .where("from_conv IS NOT NULL")
    )
    best = F.min(F.struct("at", "choice", "from_conv", "from_turn")).alias("best")
    return found.groupBy("conv_id", "turn").agg(best).select(
        "conv_id", "turn", "best.from_conv", "best.from_turn"
    )


def reply_threads(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) in reply order.

    Returns thread_id (smallest conversation of the thread), position (from 1 in the
    thread), conv_id, turn, role, parent_conv_id, parent_turn, n_quotes, quote_depth, and
    text without quotations. Null texts count as empty. Rows of one turn share a parent and
    stand in order of role and text. Rows without conv_id or turn have no parent, thread or
    position. An empty table gives an empty result. Other columns are not read.
    """
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    all_parsed = materialize(rows.mapInArrow(_parse, _PARSED), "messages")
    parsed = all_parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    origin = materialize(_quoted(parsed), "origins")
    across = origin.where("from_conv <> conv_id")
    threads = components(across.select(F.col("conv_id").alias("u"), F.col("from_conv").alias("v"))).toDF(
        "conv_id", "thread"
    )
    turns = _previous(parsed).join(origin, ["conv_id", "turn"], "left").join(threads, "conv_id", "left")
    placed = turns.select(
        "conv_id",
        "turn",
        F.coalesce("thread", "conv_id").alias("thread_id"),
        F.coalesce("from_conv", F.when(F.col("before").isNotNull(), F.col("conv_id"))).alias("parent_conv_id"),
        F.coalesce("from_turn", "before").alias("parent_turn"),
    )
    full = all_parsed.join(placed, ["conv_id", "turn"], "left").withColumn(
        "span", F.floor(F.col("turn") / TURNS)
    )
    group = ["thread_id", "conv_id", "span"]
    by_group = Window.partitionBy(*group).orderBy("turn", "role", "text")
    sizes = full.where("thread_id IS NOT NULL").groupBy(*group).count()
    # A thread may hold very many conversations: they are counted a range of ids at a time.
    sizes = sizes.withColumn("range", F.floor(F.col("conv_id") / CONVERSATIONS))
    ranges = sizes.groupBy("thread_id", "range").agg(F.sum("count").alias("count"))
    ordered = Window.partitionBy("thread_id").orderBy("range")
    starts = ranges.select("thread_id", "range", (F.sum("count").over(ordered) - F.col("count")).alias("start"))
    within = Window.partitionBy("thread_id", "range").orderBy("conv_id", "span")
    before = (
        sizes.withColumn("inside", F.sum("count").over(within) - F.col("count"))
        .join(starts, ["thread_id", "range"])
        .select(*group, (F.col("start") + F.col("inside")).alias("ahead"))
    )
    return (
        full.withColumn("local", F.row_number().over(by_group))
        .join(before, group, "left")
        .select(
            "thread_id",
            (F.col("local") + F.col("ahead")).cast("long").alias("position"),
            "conv_id",
            "turn",
            "role",
            "parent_conv_id",
            "parent_turn",
            F.size("quotes").cast("long").alias("n_quotes"),
            F.coalesce(F.array_max(F.transform("quotes", lambda q: q["level"])), F.lit(0)).alias("quote_depth"),
            "text",
        )
    )
