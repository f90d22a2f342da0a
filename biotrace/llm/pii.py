"""Personal data in texts, with built-in expressions only.

Regular expressions propose spans. Range checks and checksums (Luhn for cards, mod 97 for
account numbers) confirm them, and context words near a span, before or behind it, raise or
lower its score: "call" speaks for a phone number, "version" against an address of four
numbers. Numbers that only a context word can tell from other numbers count as personal
data when the score reaches ACCEPT; the four base kinds count in any case, with their
score. Spans are in code points, with exclusive ends.

Matches of one pattern are found twice in the same way, as the matches and as what lies
between them; the lengths of both give the positions. No pattern can run over a stretch of
text more than a fixed number of times: a lookbehind, or the end of the match before,
holds a match to the first place where it can start. Long lists of matches are worked
through in pieces, so that no list is copied as a whole for each of its members.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classes of characters and tags.
_LOCAL = "[A-Za-z0-9._%+-]"
_HOST = "[A-Za-z0-9-]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# Code points on either side of a span in which a context word counts.
NEAR = 40
ACCEPT = 0.6
# Matches, or spans, worked through at a time.
PIECE = 256
# Code points of a block that a text is cut into before it is masked.
BLOCK = 1_024


def _words(*words: str) -> str:
    return rf"(?i)(?<!\p{{L}})(?:{'|'.join(words)})(?!\p{{L}})"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    # A text without this substring has no match; None if there is no such substring.
    needs: str | None
    # Score of a confirmed match, and what words near it add or take.
    score: float = 1.0
    for_: str | None = None
    more: float = 0.0
    against: str | None = None
    less: float = 0.0


# Words that speak for or against a kind, in four languages.
PHONE_WORDS = _words(
    "phone", "tel", "telephone", "mobile", "call", "fax", "whatsapp", "handy", "telefon",
    "t[eé]l[eé]phone", "tel[eé]fono",
)
CARD_WORDS = _words("card", "credit", "visa", "mastercard", "amex", "karte", "carte", "tarjeta")
ACCOUNT_WORDS = _words("iban", "account", "konto", "compte", "cuenta", "bank", "banque", "banco")
HOST_WORDS = _words("ip", "host", "server", "address", "login", "adresse", "serveur", "servidor")
NUMBER_WORDS = _words("order", "invoice", "tracking", "serial", "isbn", "ticket")
VERSION_WORDS = _words("version", "release", "build", "section", "v", "chapter")

EMAIL = Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++", "@")
IP = Kind(
    "ip",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    ".",
    score=0.8,
    for_=HOST_WORDS,
    more=0.2,
    against=VERSION_WORDS,
    less=0.4,
)
CARD = Kind(
    "card",
    r"[0-9](?:[\x20-]?+[0-9])++",
    None,
    score=0.8,
    for_=CARD_WORDS,
    more=0.2,
    against=NUMBER_WORDS,
    less=0.3,
)
PHONE = Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", score=0.8, for_=PHONE_WORDS, more=0.2)
# In one piece, or in groups of four of which the last may be shorter and holds digits.
IBAN = Kind(
    "iban",
    r"(?i)(?<![A-Z0-9])[A-Z]{2}[0-9]{2}"
    r"(?:[A-Z0-9]{11,30}|(?:[\x20-][A-Z0-9]{4}){2,7}(?:[\x20-][0-9]{1,3})?)(?![A-Z0-9])",
    None,
    score=0.8,
    for_=ACCOUNT_WORDS,
    more=0.2,
)
LOCAL_PHONE = Kind(
    "local_phone",
    r"(?<![0-9+])(?:\([0-9]{2,5}\)[\x20]?|[0-9]{2,5}[\x20./-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
    None,
    score=0.3,
    for_=PHONE_WORDS,
    more=0.4,
    against=NUMBER_WORDS,
    less=0.3,
)
# In this order of ties; the first four are the base.
KINDS = (EMAIL, IP, CARD, PHONE, IBAN, LOCAL_PHONE)
BASE = 4


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def mod97(account: Column) -> Column:
    """Remainder of an account number whose first four characters stand last."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4))

    def step(rest: Column, char: Column) -> Column:
        value = F.ascii(char)
        return F.when(value < 65, (rest * 10 + value - 48) % 97).otherwise(
            (rest * 100 + value - 55) % 97
        )

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _confirmed(kind: Kind, match: Column) -> Column:
    if kind is IP:
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind is CARD:
        digits = _digits(match)
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind is PHONE:
        return F.length(_digits(match)).between(10, 15)
    if kind is IBAN:
        account = F.upper(F.regexp_replace(match, r"[\x20-]", ""))
        return F.length(account).between(15, 34) & (mod97(account) == 1)
    return F.lit(True)


_SPAN = "struct<start:int,kind:int,end:int,score:double>"


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once and not per place where it is used."""
    return F.transform(F.array(value), use)[0]


def _scan(
    items: Column,
    advance: Callable[[Column, Column], Column],
    step: Callable[[Column, Column], Column],
    kind: str,
) -> Column:
    """Flat list of what `step` finds in items, which sees how far the items before it reach.

    advance(at, item) is that reach, an int that starts at 0; it must come out the same from
    a piece's own reach, added or compared. step(at, item) gives an array of `kind`.
    """
    none = F.array().cast(f"array<{kind}>")

    def piece(items: Column, i: Column) -> Column:
        return F.slice(items, i * PIECE + 1, F.lit(PIECE))

    def through(part: Column, at: Column) -> Column:
        def one(state: Column, item: Column) -> Column:
            found = F.concat(state["found"], step(state["at"], item))
            return F.struct(advance(state["at"], item).alias("at"), found.alias("found"))

        return F.aggregate(part, F.struct(at.alias("at"), none.alias("found")), one, lambda s: s["found"])

    def pieces(items: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / PIECE).cast("int"))
        parts = F.transform(numbers, lambda i: piece(items, i))
        return _named(parts, lambda parts: F.flatten(F.zip_with(parts, _reaches(parts, advance), through)))

    return _named(items, lambda items: F.when(F.size(items) > 0, pieces(items)).otherwise(none))


def _reaches(parts: Column, advance: Callable[[Column, Column], Column]) -> Column:
    """How far the parts before each one reach."""

    def more(reached: Column, part: Column) -> Column:
        last = F.element_at(reached, -1)
        return F.concat(reached, F.array(F.aggregate(part, last, advance)))

    every = F.aggregate(parts, F.array(F.lit(0)), more)
    return F.slice(every, F.lit(1), F.size(parts))


def spans_of(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind, in order."""
    number = KINDS.index(kind)
    found = F.struct(
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("matches"),
        F.split(text, kind.pattern, -1).alias("between"),
    )

    def item(found: Column, i: Column) -> Column:
        def match(at: Column) -> Column:
            return F.coalesce(F.get(found["matches"], at), F.lit(""))

        def between(at: Column) -> Column:
            return F.coalesce(F.get(found["between"], at), F.lit(""))

        fields = [between(i).alias("between"), match(i).alias("match")]
        if kind.for_ or kind.against:
            # The two matches before may stand within reach of a word.
            ahead = [F.right(between(i - 2), F.lit(NEAR)), match(i - 2), between(i - 1), match(i - 1), between(i)]
            near = F.concat(F.right(F.concat(*ahead), F.lit(NEAR)), F.lit(" | "), F.left(between(i + 1), F.lit(NEAR)))
            fields.append(near.alias("near"))
        return F.struct(*fields)

    def items(found: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(found["matches"]) - 1)
        return F.transform(places, lambda i: item(found, i))

    def advance(at: Column, item: Column) -> Column:
        return at + F.length(item["between"]) + F.length(item["match"])

    def step(at: Column, item: Column) -> Column:
        start = at + F.length(item["between"])
        score = F.lit(kind.score)
        if kind.for_:
            score = score + F.when(item["near"].rlike(kind.for_), kind.more).otherwise(0.0)
        if kind.against:
            score = score - F.when(item["near"].rlike(kind.against), kind.less).otherwise(0.0)
        span = F.struct(
            start.alias("start"),
            F.lit(number).alias("kind"),
            (start + F.length(item["match"])).alias("end"),
            F.round(score, 2).alias("score"),
        )
        good = _confirmed(kind, item["match"])
        if number >= BASE:
            good &= score >= ACCEPT
        return F.when(good, F.array(span)).otherwise(F.array().cast(f"array<{_SPAN}>"))

    def spans(found: Column) -> Column:
        return _scan(items(found), advance, step, _SPAN)

    none = F.array().cast(f"array<{_SPAN}>")
    needed = text.contains(kind.needs) if kind.needs else text.rlike("[0-9][0-9]")
    if kind is CARD:
        needed = text.rlike(r"[0-9][\x20-]?[0-9]")
    searched = _named(found, lambda f: F.when(F.size(f["matches"]) > 0, spans(f)).otherwise(none))
    return F.when(needed, searched).otherwise(none)


def find_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `pii_spans`: all spans of a text, by start and then kind.

    Null and empty texts have no spans. Every row stands for itself, so repeated rows and
    ids, ties and null ids need no rule; an empty table stays empty. A column that is
    already named pii_spans is replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = F.concat(*[spans_of(text, kind) for kind in KINDS])
    return docs.withColumn("pii_spans", F.array_sort(found))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(kind.name) for kind in KINDS])
    one = F.transform(
        spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(one, ",")


def personal_data_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of the base kinds, a digest of the base spans, all spans and scores."""
    found = find_personal_data(docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(text_col)), text_col)
    spans = F.col("pii_spans")

    def count(kind: Kind) -> Column:
        number = KINDS.index(kind)
        return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")

    base = F.filter(spans, lambda s: s["kind"] < BASE)
    return found.select(
        id_col,
        *[count(kind).alias(f"n_{kind.name}") for kind in KINDS[:BASE]],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in square brackets; overlaps become one.

    Rows without spans keep their text, nulls included. Columns stay as they are.
    """
    names = F.array(*[F.lit(f"[{kind.name.upper()}]") for kind in KINDS])
    text, spans = F.col(text_col), F.col("pii_spans")

    def cut(blocks: Column, start: Column, end: Column) -> Column:
        """Code points [start, end) out of blocks of BLOCK, without a walk from the first one."""
        first = F.floor(start / BLOCK).cast("int")
        joined = F.array_join(F.slice(blocks, first + 1, F.floor(end / BLOCK).cast("int") - first + 1), "")
        return F.substr(joined, start - first * BLOCK + 1, end - start)

    def advance(at: Column, span: Column) -> Column:
        return F.greatest(at, span["end"])

    def masked(blocks: Column) -> Column:
        def step(at: Column, span: Column) -> Column:
            gap = cut(blocks, at, F.greatest(at, span["start"]))
            fresh = F.array(gap, names[span["kind"]])
            return F.when(span["start"] >= at, fresh).otherwise(F.array().cast("array<string>"))

        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        rest = cut(blocks, last, F.length(text))
        return F.concat(F.array_join(_scan(spans, advance, step, "string"), ""), rest)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    hidden = _named(blocks, masked)
    found = find_personal_data(docs, text_col)
    return found.withColumn(
        text_col, F.when(F.size(spans) > 0, hidden).otherwise(text)
    ).select(*docs.columns)
