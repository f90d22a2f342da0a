"""Operators on texts against plain versions, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from biotrace.llm import (
    anchors,
    crf_langid,
    decontaminate,
    minhash_bbit,
    nnls_packing,
    pii,
    shingles,
    suffix_dedup,
    token_shards,
)
from biotrace.llm.components import components
from biotrace.llm.tokens import default_tokenizer
from biotrace.session import new_folder

DOCS = "doc_id long, text string"
# Further columns with names that the operators use inside.
WIDE = "doc_id long, text string, id string, rank int, bucket string, component string"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n: int, seed: int) -> list[str]:
    pick = random.Random(seed)
    return ["".join(pick.choices("abcdefghij", k=4)) for _ in range(n)]


def edited(source: list[str], share: float, seed: int) -> str:
    pick = random.Random(seed)
    return " ".join(w if pick.random() > share else f"x{pick.randrange(10**6)}" for w in source)


@pytest.fixture(scope="module")
def corpus() -> list[tuple]:
    """Copies, a family of near copies around a base that is not the first, and odd texts."""
    base = words(150, 1)
    rows = [(i, edited(base, 0.02 + 0.002 * i, i)) for i in range(12)]
    rows.append((40, " ".join(base)))
    rows += [(50 + i, " ".join(words(60, 100 + i))) for i in range(8)]
    rows += [(70, rows[14][1]), (71, rows[14][1].upper()), (72, rows[14][1])]
    rows += [(80, None), (81, ""), (82, "  \n"), (83, "two words"), (84, "Two Words"), (85, "one")]
    rows += [(90, "é" * 40 + " ü"), (91, "a" * 5000), (92, "b " * 3000), (None, "two words")]
    return rows


def wide(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", None) for r in rows], WIDE)


# --- shingles and components -------------------------------------------------


def plain_set(text: str | None) -> frozenset:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = _WORD.findall(lowered)
    if len(found) < 5:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4))


def test_shingle_sets_name_runs_of_words(corpus):
    texts = [t for _, t in corpus] * 3
    sets = list(shingles.shingle_sets(pa.array(texts).slice(1)))
    names: dict = {}
    for text, found in zip(texts[1:], sets, strict=True):
        wanted = plain_set(text)
        assert len(found) == len(wanted)
        assert names.setdefault(wanted, found.tobytes()) == found.tobytes()
    assert len(set(names.values())) == len(names)


def test_components(spark):
    pick = random.Random(5)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(170)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(50)]
    edges += [(7, None), (9, 9)]
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if v is not None and u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in found} == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- near-duplicates ---------------------------------------------------------


def plain_components(rows, num, den):
    sets = {i: plain_set(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and den * shared >= num * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("num", "den"), [(85, 100), (4, 5)])
def test_near_duplicates_equal_all_pairs(spark, corpus, num, den):
    found = minhash_bbit.near_duplicates(wide(spark, corpus), num=num, den=den).collect()
    assert len(found) == len(corpus)
    wanted = plain_components(corpus, num, den)
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in found if r["id"] is not None} == wanted
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in found if r["id"] is not None)


def test_near_duplicates_of_nothing(spark):
    assert minhash_bbit.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    blank = spark.createDataFrame([(1, None), (1, ""), (2, " ")], DOCS)
    assert [r["kept"] for r in minhash_bbit.near_duplicates(blank).collect()] == [True] * 3


def test_low_bits_estimate_the_similarity():
    pick = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        pool = pick.integers(0, 2**63, 4000).astype(np.uint64)
        n = int(4000 * (1 + share) / 2)
        signs = [
            np.frombuffer(minhash_bbit.planes(minhash_bbit.minima(s)), np.uint8).reshape(
                minhash_bbit.BITS, -1
            )
            for s in (pool[:n], pool[4000 - n :])
        ]
        guess = minhash_bbit.estimates(signs[0][None], signs[1][None])[0]
        assert abs(guess - (2 * n - 4000) / 4000) < 0.12


# --- repeated substrings -----------------------------------------------------


def plain_repeats(rows):
    texts = {i: (t or "").encode() for i, t in sorted((r for r in rows if r[0] is not None))}
    first: dict = {}
    for i, text in texts.items():
        for k in range(len(text) - 49):
            first.setdefault(text[k : k + 50], i)
    out = {}
    for i, text in texts.items():
        gone = np.zeros(len(text), bool)
        for k in range(len(text) - 49):
            if first[text[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_equal_all_substrings(spark, corpus):
    passage = " ".join(words(20, 77))
    rows = corpus + [(200 + i, f"{' '.join(words(30, 300 + i))} {passage[i:]} tail {i}") for i in range(9)]
    rows += [(300, passage[:50]), (301, passage[:49]), (302, "z" + passage[1:51]), (303, passage[:51])]
    found = suffix_dedup.remove_repeats(wide(spark, rows), with_text=True).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found}
    unnamed = got.pop(None)
    assert unnamed[:3] == (9, 0, 0)
    assert got == plain_repeats(rows)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in found)
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_equal_strings_have_equal_anchors():
    pick = np.random.default_rng(1)
    shared = pick.integers(97, 101, 50).astype(np.uint8)
    for _ in range(50):
        places = []
        for _ in range(2):
            left = pick.integers(97, 101, int(pick.integers(0, 90))).astype(np.uint8)
            right = pick.integers(97, 101, int(pick.integers(0, 90))).astype(np.uint8)
            text = np.concatenate([left, shared, right])
            at, _ = anchors.anchors(text, np.array([0, len(text)]))
            inside = (at >= len(left)) & (at <= len(left) + anchors.LENGTH - anchors.GRAM)
            assert inside.any()
            places.append(set((at[inside] - len(left)).tolist()))
        # The least of the string itself is an anchor on both sides.
        assert places[0] & places[1]


# --- personal data -----------------------------------------------------------

_BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _base_ok(kind: str, match: str) -> bool:
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(part) <= 255 for part in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and _luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def plain_base(text: str | None) -> list[str]:
    found = [
        (m.start(), n, f"{kind}:{m.start()}:{m.end()}")
        for n, (kind, pattern) in enumerate(_BASE.items())
        for m in pattern.finditer(text or "")
        if _base_ok(kind, m.group())
    ]
    return [span for _, _, span in sorted(found)]


PRIVATE = [
    "mail a@b.c_d@e.f and x@y",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3",
    "4111 1111 1111 1111, 4111-1111-1111-1111 11, 4111111111111112",
    "+1 (234) 567-8901. +12 +49 30 1234567890",
    "é😀 a@b.co 😀 +49 30 1234567890",
    "x" * 20000 + "@" + "y" * 20000,
    "9" * 20000,
    "1-" * 9000 + "1",
    None,
    "",
]


def test_base_spans_equal_plain_patterns(spark):
    pick = random.Random(8)
    rows = PRIVATE + ["".join(pick.choices("a1@.+- (9%", k=60)) for _ in range(300)]
    docs = wide(spark, list(enumerate(rows)))
    found = {r["doc_id"]: r for r in pii.personal_data_report(docs).collect()}
    for i, text in enumerate(rows):
        base = plain_base(text)
        assert found[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(found[i]["spans"].split(",") if found[i]["spans"] else [])
        for kind in _BASE:
            assert found[i][f"n_{kind}"] == sum(s.startswith(kind + ":") for s in base)
    assert pii.personal_data_report(spark.createDataFrame([], DOCS)).count() == 0


def test_checksums_and_context_decide(spark):
    rows = [
        "pay to GB82WEST12345698765432 now",
        "pay to GB83WEST12345698765432 now",
        "please call 212-555-1234 today",
        "the code 212-555-1234 is old",
    ]
    report = pii.personal_data_report(spark.createDataFrame(list(enumerate(rows)), DOCS))
    spans = [r["spans"] for r in report.orderBy("doc_id").collect()]
    assert spans == ["iban:7:29", "", "local_phone:12:24", ""]


def test_context_on_either_side_counts(spark):
    rows = [
        "call 212-555-1234 or 212-555-9876",
        "212-555-1234 (fax)",
        "account DE89 3704 0044 0532 0130 00 please",
        "de89370400440532013000",
        "BE71 0961 2345 6769 and more",
        "GB83 WEST 1234 5698 7654 32",
        "server 10.0.0.1 here",
        "version 10.0.0.1 here",
        "call order 212-555-1234",
        "called 212-555-1234",
    ]
    report = pii.personal_data_report(spark.createDataFrame(list(enumerate(rows)), DOCS)).orderBy("doc_id").collect()
    assert [r["spans"] for r in report] == [
        "local_phone:5:17,local_phone:21:33",
        "local_phone:0:12",
        "iban:8:35",
        "iban:0:22",
        "iban:0:19",
        "",
        "ip:7:15",
        "ip:8:16",
        "",
        "",
    ]
    assert [r["scores"] for r in report] == ["0.7,0.7", "0.7", "1.0", "0.8", "0.8", "", "1.0", "0.4", "", ""]


def test_very_many_spans_take_linear_time(spark):
    unit = "ü mail a{0}@b.example or +49 30 123456{1} "
    text = "".join(unit.format(i, i % 90 + 10) for i in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, "x" * 300_000 + " a@b.cd " + "1" * 300_000)], DOCS)
    docs.select("doc_id").collect()
    began = time.monotonic()
    found = {r.doc_id: r for r in pii.personal_data_report(docs).collect()}
    assert time.monotonic() - began < 10
    assert found[1].n_email == found[1].n_phone == 20_000
    assert found[1].base_sha256 == hashlib.sha256(",".join(plain_base(text)).encode()).hexdigest()
    began = time.monotonic()
    masked = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert time.monotonic() - began < 15
    assert masked[1] == "ü mail [EMAIL] or [PHONE] " * 20_000
    assert masked[2] == "x" * 300_000 + " [EMAIL] " + "1" * 300_000


def test_masking_covers_every_span_and_keeps_the_rest(spark):
    rows = [*enumerate(PRIVATE[:5]), (7, None), (8, "nothing here")]
    masked = pii.mask(wide(spark, rows))
    assert masked.columns == wide(spark, rows).columns
    texts = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert texts[7] is None
    assert texts[8] == "nothing here"
    assert texts[4] == "é😀 [EMAIL] 😀 [PHONE]"
    assert not any(plain_base(t) for t in texts.values())


def test_number_signs_are_no_letters():
    assert crf_langid.words_of("\u00bd \u00b2 \u2167 3") == []
    assert crf_langid.words_of("x\u00b2 \u00c9t\u00e9 a1b \u4e2d") == ["x", "\u00e9t\u00e9", "a", "b", "\u4e2d"]


# --- decontamination ---------------------------------------------------------


def _alnum_runs(text: str | None, size: int = 5) -> list[tuple]:
    found = re.findall(r"[^\W_]+", (text or "").lower())
    return [tuple(found[i : i + size]) for i in range(len(found) - size + 1)]


def test_contamination_equals_all_windows(spark):
    items = [(i, " ".join(words(15 + 16 * i, 500 + i))) for i in range(6)] + [(20, None), (21, ""), (22, "one two")]
    rows = []
    for i in range(40):
        item = items[i % 6][1].split()
        if i % 3 == 1:
            item = item[: len(item) // 2] + ["new"] * (i % 4) + item[len(item) // 2 :]
        if i % 5 == 2:
            item = item[i % 4 :]
        if i % 7 == 3:
            # Parts change places, which moves few runs.
            cut = len(item) // 3 + i % 5
            item = item[cut:] + item[:cut]
        if i % 11 == 4:
            item = item + item[: len(item) // 2] + item
        rows.append((i, " ".join(words(i % 7 * 10, 600 + i) + item + words(20, 700 + i))))
    rows += [(50, items[3][1].upper().replace(" ", " -- ")), (51, None), (52, ""), (53, "one two"), (None, items[0][1])]
    wanted = set()
    for (i, text), (k, item) in itertools.product(rows, items):
        size = min(5, len(re.findall(r"[^\W_]+", item or "")))
        if i is None or not size:
            continue
        mine, runs = _alnum_runs(item, size), _alnum_runs(text, size)
        for start in range(max(1, len(runs) - len(mine) + 1) if runs else 0):
            window = runs[start : start + len(mine)]
            shared = sum(min(window.count(r), mine.count(r)) for r in set(window))
            if 5 * shared >= 4 * (len(window) + len(mine) - shared):
                wanted.add((i, k))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = wide(spark, rows)
    found = decontaminate.find_contamination(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == wanted
    assert len(wanted) > 15
    assert {(i, i % 6) for i in range(3, 40, 7)} & wanted
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in wanted}
    assert decontaminate.find_contamination(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.find_contamination(docs.limit(0), benchmark).count() == 0


def test_a_passage_with_swapped_halves_is_found(spark):
    first, second, other = words(50, 901), words(50, 902), words(400, 903)
    benchmark = spark.createDataFrame([(1, " ".join(first + second))], "item_id long, text string")
    text = " ".join(other[:200] + second + first + other[200:])
    rows = [(1, text), (1, "another text under the id"), (2, " ".join(other)), (3, text), (3, text)]
    found = decontaminate.find_contamination(wide(spark, rows), benchmark).collect()
    assert sorted((r.doc_id, r.start, r.words, r.shared, r.total) for r in found) == [
        (1, 200, 100, 92, 100),
        (3, 200, 100, 92, 100),
    ]


def test_fingerprints_of_similar_windows_stay_within_the_radius(spark):
    """Pairs just above the similarity: the share that the radius loses is below one in 500."""
    pick = random.Random(77)
    rows = []
    for pair in range(1500):
        shared = [pick.getrandbits(60) for _ in range(160)]
        for side in range(2):
            rows += [(pair, side, run) for run in shared + [pick.getrandbits(60) for _ in range(20)]]
    frame = spark.createDataFrame(rows, "pair long, side int, run long")
    prints = decontaminate._fingerprint(frame.withColumn("weight", F.lit(1)), ["pair", "side"])
    by_pair = prints.groupBy("pair").agg(F.min("print").alias("a"), F.max("print").alias("b"))
    apart = by_pair.select(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("d"))
    assert apart.where(F.col("d") > decontaminate.RADIUS).count() <= 3


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    pick = random.Random(2)
    pairs = []
    for _ in range(300):
        a, flips = pick.getrandbits(64), pick.sample(range(64), decontaminate.RADIUS)
        b = a
        for f in flips:
            b ^= 1 << f
        pairs.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(pairs, "a long, b long")
    both = df.select(*[decontaminate.blocks_of(df[c]).alias(c) for c in "ab"])
    assert both.where("size(array_intersect(a, b)) = 0").count() == 0


# --- language ----------------------------------------------------------------


def test_posteriors_equal_all_paths():
    pick = np.random.default_rng(4)
    scores, moves = pick.normal(size=(9, 3)), pick.normal(size=(3, 3))
    starts, sizes = np.array([0, 4, 5]), np.array([4, 1, 4])
    found, expected = crf_langid.posteriors(scores, starts, sizes, moves)
    counts = np.zeros((3, 3))
    for start, size in zip(starts, sizes, strict=True):
        total, mine = 0.0, np.zeros((size, 3))
        pairs = np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(size)):
            log = sum(scores[start + t, k] for t, k in enumerate(path))
            weight = np.exp(log + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            total += weight
            for t, k in enumerate(path):
                mine[t, k] += weight
            for a, b in itertools.pairwise(path):
                pairs[a, b] += weight
        assert np.allclose(found[start : start + size], mine / total)
        counts += pairs / total
    assert np.allclose(expected, counts)


def test_language_of_texts_that_were_held_out(spark):
    pick = random.Random(6)
    stock = {lang: words(80, seed) for seed, lang in enumerate(["aa", "bb", "cc"])}
    rows = [(i, " ".join(pick.choices(stock[lang], k=30)), lang) for i in range(90) for lang in [list(stock)[i % 3]]]
    rows += [(900, None, "aa"), (901, "12 34 !!", "bb"), (902, "", None), (None, rows[0][1], None)]
    docs = spark.createDataFrame([(*r, 1.0, "s") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")
    field = crf_langid.train(docs)
    found = {r["doc_id"]: r for r in crf_langid.identify(docs, field).collect()}
    assert all(found[i]["lang_pred"] == lang for i, _, lang in rows[:90])
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in found.values())
    mixed = " ".join(stock["aa"][:12] + stock["bb"][:12])
    labels = [label for _, label, _ in crf_langid.label_words(mixed, field)]
    assert labels[:11] == ["aa"] * 11
    assert labels[13:] == ["bb"] * 11
    kept = crf_langid.keep_known(docs, field)
    assert kept.schema == docs.schema
    assert {r["doc_id"] for r in kept.collect()} == {*range(90), None}
    blank = docs.withColumn("lang", docs["text"].substr(0, 0)).where("1 = 0")
    assert crf_langid.train(blank) is None
    assert crf_langid.identify(docs, None).where("lang_pred <> 'und'").count() == 0


# --- tokens ------------------------------------------------------------------

TEXTS = ["Hello  world\n\n it's 12", None, "", "<|endoftext|> x", "é😀 tail ", "word " * 3000, "a"]


def plain_ids(text: str | None) -> list[int]:
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(default_tokenizer()[0])
    return [*coder.encode(text or "", add_special_tokens=False).ids, 1]


def test_packing_places_every_id_once(spark):
    pick = random.Random(3)
    texts = TEXTS + ["some words here " * pick.randrange(1, 900) for _ in range(60)] + [TEXTS[0]] * 20
    rows = [*enumerate(texts), (None, "nobody")]
    found = nnls_packing.pack(wide(spark, rows)).collect()
    ids = {i: plain_ids(t) for i, t in rows}
    seen: dict = {}
    for r in found:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"]
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for i, pieces in seen.items():
        ends = list(itertools.accumulate(n for _, n in sorted(pieces)))
        assert [s for s, _ in sorted(pieces)] == [0, *ends[:-1]]
        assert ends[-1] == len(ids[i])
    assert set(seen) == set(ids)
    by_sequence: dict = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_sequence) == set(range(len(by_sequence)))
    for pieces in by_sequence.values():
        ends = list(itertools.accumulate(n for _, n in sorted(pieces)))
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]]
        assert ends[-1] <= 2048
    assert nnls_packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_plan_places_the_histogram():
    pick = random.Random(1)
    histogram = {pick.randrange(1, 257): pick.randrange(1, 500) for _ in range(200)} | {256: 9, 3: 40000}
    plan = nnls_packing.plan(histogram, 256)
    used: dict = {}
    for lengths, repeats in plan:
        assert sum(lengths) <= 256
        for n in lengths:
            used[n] = used.get(n, 0) + repeats
    assert used == histogram
    total = sum(n * c for n, c in histogram.items())
    assert sum(r for _, r in plan) * 256 < total * 1.03


@pytest.mark.parametrize("size", [1, 2, 3, 100, 4097])
def test_feistel_is_a_permutation(size):
    slots = token_shards.feistel(np.arange(size), size, key=5)
    assert sorted(slots.tolist()) == list(range(size))
    if size > 50:
        assert slots.tolist() != token_shards.feistel(np.arange(size), size, key=6).tolist()


def test_shards_hold_every_sequence_at_its_slot(spark):
    rows = [*enumerate(TEXTS), (None, "nobody")]
    path = new_folder(spark, "test-shards")
    token_shards.write_shards(wide(spark, rows), path, length=64, slots=16, key=9)
    found = token_shards.read_shards(spark, path).collect()
    assert sorted(r["slot"] for r in found) == list(range(len(found)))
    assert all(r["shard"] == r["slot"] // 16 and len(r["ids"]) == 128 for r in found)
    ids = {i: plain_ids(t) for i, t in rows}
    joined: dict = {}
    for r in sorted(found, key=lambda r: r["start"]):
        stored = np.frombuffer(r["ids"], "<u2")
        assert not stored[r["n_tokens"] :].any()
        joined.setdefault(r["doc_id"], []).extend(stored[: r["n_tokens"]].tolist())
    assert joined == ids
    rest = token_shards.read_shards(spark, path, after=20)
    assert sorted(r["slot"] for r in rest.collect()) == list(range(21, len(found)))
    assert token_shards.materialized_order(spark.createDataFrame([], DOCS)).count() == 0


def test_slots_do_not_depend_on_how_rows_are_dealt(spark):
    rows = [*enumerate(TEXTS * 4), (3, "another text"), (3, TEXTS[0]), (3, TEXTS[0]), (None, "nobody")]
    found = []
    for parts in (1, 5):
        path = new_folder(spark, "test-shards")
        docs = wide(spark, rows).repartition(parts, F.rand(parts))
        token_shards.write_shards(docs, path, length=32, slots=16, key=9)
        found.append(sorted(map(repr, token_shards.read_shards(spark, path).drop("shard").collect())))
    assert found[0] == found[1]


def test_a_resumed_read_opens_later_shards_only(spark):
    path = new_folder(spark, "test-shards")
    token_shards.write_shards(wide(spark, [*enumerate(TEXTS * 4)]), path, length=32, slots=16, key=9)
    total = token_shards.read_shards(spark, path).count()
    assert total > 64
    for after in (0, 15, 16, 40):
        rest = token_shards.read_shards(spark, path, after=after)
        assert sorted(r.slot for r in rest.select("slot").collect()) == list(range(after + 1, total))
        plan = rest._jdf.queryExecution().executedPlan().toString()
        assert "(shard#" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
        assert rest.select(F.min("shard")).first()[0] == (after + 1) // 16


def test_binary_shards_are_read_by_byte(spark):
    docs = wide(spark, [*enumerate(TEXTS * 4)])
    plain, raw = new_folder(spark, "test-shards"), new_folder(spark, "test-shards")
    options = dict(length=32, slots=16, key=9, pad_id=0x0A41)
    token_shards.write_shards(docs, plain, **options)
    token_shards.write_shards(docs, raw, binary=True, **options)
    stride = 2 * 32 + 1
    wanted = {r.slot: bytes(r.ids) for r in token_shards.read_shards(spark, plain).collect()}
    files = {}
    for row in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(raw).select("path").collect():
        if "/shard=" in row.path:
            files[int(re.search(r"/shard=(\d+)/", row.path)[1])] = row.path.removeprefix("file:")
    assert sorted(files) == sorted({slot // 16 for slot in wanted})
    for slot in sorted(wanted):
        with open(files[slot // 16], "rb") as shard:
            shard.seek(slot % 16 * stride)
            assert shard.read(stride) == wanted[slot] + b"\n"


def test_an_id_that_does_not_fit_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(token_shards, "MOST_ID", 10)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1]), pa.array([2]), pa.array(["some words"])], ["doc_id", "tie", "text"]
    )
    monkeypatch.setattr(token_shards.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    with pytest.raises(ValueError, match="does not fit"):
        list(token_shards._cut(iter([batch]), 8, 1, default_tokenizer()))
