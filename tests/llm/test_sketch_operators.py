"""Fingerprints, hard negatives and centroid clustering, against plain versions."""

from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest
from conftest import TESTDATA

from biotrace.llm import angular_negatives, iblt_fingerprint, va_file
from biotrace.llm.registry import QUERIES, SQL

SF_DIR = f"{TESTDATA}/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label long, row string, size string, full string"


def sorted_rows(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_statement(spark, name):
    found = QUERIES[name](spark, SF_DIR)
    engine = duckdb.connect()
    for table in ("documents", "embeddings"):
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    names = sorted(found.columns)
    listed = ", ".join(f'"{n}"' for n in names)
    told = sorted(engine.execute(f"SELECT {listed} FROM ({SQL[name]})").fetchall(), key=repr)
    assert sorted_rows(found) == told
    assert told


# --- fingerprints ------------------------------------------------------------


def test_fingerprint_query_equals_plain_sets(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: r for r in QUERIES["op11_iblt_fingerprint"](spark, SF_DIR).collect()}
    assert len(found) == len(docs)
    ordered = sorted(docs, key=lambda r: -r["doc_id"])
    paragraphs = lambda t: set(iblt_fingerprint.paragraph_digests([t.encode()])[0].tolist())
    for this, following in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        got, text, n = found[this["doc_id"]], this["text"], len(this["text"])
        new = text[: n - n // 2] + following["text"][: n // 2]
        assert got["n_chars"] == n
        assert got["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        sets = [paragraphs(t) for t in (text, new, following["text"])]
        for near, other in (("near_edited", sets[1]), ("near_next", sets[2])):
            assert got[near] == pytest.approx(len(sets[0] & other) / len(sets[0] | other))
        assert set(iblt_fingerprint.members(got["fingerprint"]).tolist()) == sets[0]
        assert iblt_fingerprint.compare(got["fingerprint"], got["edited_fingerprint"]) == got["near_edited"]
    ahead = sum(r["near_edited"] > r["near_next"] for r in found.values())
    assert ahead >= 0.9 * len(found)


def test_fingerprints_of_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(iblt_fingerprint, "RANGE", 2)
    monkeypatch.setattr(iblt_fingerprint, "CHUNK", 60)
    rows = [
        (9, "first line\nsecond line\nthird line"),
        (7, None),
        (7, "b twice"),
        (7, "b twice"),
        (5, ""),
        (4, "one two \U0001f600 three four five six seven eight nine ten"),
        (3, "line\n" * 400),
        (2, "first line\nsecond line\nthird line"),
        (None, "no id"),
        (-5, "x"),
    ]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key int, part int")
    ordered = [rows[i] for i in (0, 1, 2, 3, 4, 5, 6, 7, 9, 8)]
    plain = []
    for (i, text), (_, following) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        text, following = text or "", following or ""
        new = iblt_fingerprint.edited(text, following)
        plain.append((i, len(text), hashlib.sha256(new.encode()).hexdigest()))
    found = iblt_fingerprint.document_fingerprints(docs)
    got = found.collect()
    assert sorted(map(repr, plain)) == sorted(repr((r["id"], r["n_chars"], r["edited_sha256"])) for r in got)
    by_id = {r["id"]: r for r in got}
    assert by_id[9]["fingerprint"] == by_id[2]["fingerprint"]
    assert len(iblt_fingerprint.members(by_id[3]["fingerprint"])) == 400
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    assert iblt_fingerprint.document_fingerprints(docs.limit(0)).count() == 0
    one = iblt_fingerprint.document_fingerprints(docs.where("doc_id = 9")).collect()
    assert [r["near_next"] for r in one] == [1.0]


def test_peeling_retries_larger():
    random = np.random.Generator(np.random.PCG64(3))
    left = random.integers(0, 2**64, 3000, dtype=np.uint64)
    right = np.concatenate([left[1000:], random.integers(0, 2**64, 40, dtype=np.uint64)])
    pair = [(s, np.array([0, len(s)])) for s in (left, right)]
    small = iblt_fingerprint.Sketches(np.array([2]))
    small.add(np.zeros(3000, np.int64), left, np.ones(3000, np.int64))
    assert not small.peel()[3].any()
    assert iblt_fingerprint.likeness(*pair)[0] == 2000 / 3040
    # A longer sketch folds to a shorter one.
    for level in (11, 10):
        held = iblt_fingerprint.Sketches(np.array([level]))
        held.add(np.zeros(3000, np.int64), left, np.ones(3000, np.int64))
        if level == 11:
            folded = held.count.reshape(3, 2, 1024).sum(axis=1).ravel()
    assert (folded == held.count).all()


# --- hard negatives ----------------------------------------------------------


def plain_negatives(rows) -> list[tuple]:
    """Every pair scored, for vectors of one length."""
    kept = []
    for i, vector, label in rows:
        if i is None or label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((i, [math.floor(256 * x) for x in vector], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, (anchor, v, label) in enumerate(kept):
        if anchor % 100:
            continue
        each = [
            (-sum(x * y for x, y in zip(v, w, strict=True)), i, l == label)
            for b, (i, w, l) in enumerate(kept)
            if b != a and len(w) == len(v)
        ]
        for s, positive, _ in sorted(e for e in each if e[2])[:5]:
            p = -s
            fit = sorted((t, i) for t, i, same in each if not same and 30 * p <= -100 * t <= 90 * p)
            out += [(anchor, positive, k, i, p, -t) for k, (t, i) in enumerate(fit[:10], 1)]
    return sorted(out)


NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def hard_vectors() -> list[tuple]:
    random = np.random.Generator(np.random.PCG64(8))
    centre = random.normal(size=(6, 5))
    rows = []
    for i in range(700):
        vector = (centre[i % 6] + 0.4 * random.normal(size=5)) * random.choice([0.1, 1, 30])
        rows.append((i, vector.tolist(), int(random.integers(0, 4))))
    hot = [1.0, 0.5, -0.25, 0.0, 2.0]
    rows += [(i, hot, i % 3) for i in range(1000, 1400)]
    rows += [(100, hot, 1), (100, hot, 1), (2000, [0.0] * 5, 1), (2100, [0.0] * 5, 1), (2101, [0.0] * 5, 2)]
    rows += [(3000, [1.0, 2.0], 1), (3001, [1.0, 2.5], 1), (3002, [0.5, 1.0], 2), (3100, [], 1), (3101, [], 1)]
    rows += [(4000, None, 1), (4100, hot, None), (4200, [1.0, None, 0.0, 0.0, 1.0], 1), (None, hot, 1)]
    rows += [(4300, [float("nan")] * 5, 1), (4400, [float("inf")] * 5, 1), (4500, [3.0] * 5, 9), (-700, hot, 2)]
    return rows


def test_hard_negatives_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(angular_negatives, "BLOCK", 64)
    monkeypatch.setattr(angular_negatives, "PARTS", 5)
    monkeypatch.setattr(angular_negatives, "PAGE", 3)
    monkeypatch.setattr(angular_negatives, "ANCHORS", 3)
    rows = hard_vectors()
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS)
    found = angular_negatives.hard_negatives(table)
    assert sorted(tuple(r) for r in found.select(*NAMES).collect()) == plain_negatives(rows)
    for none in (table.limit(0), table.where("label IS NULL"), table.where("vec_id % 100 <> 0")):
        empty = angular_negatives.hard_negatives(none)
        assert empty.count() == 0
        assert empty.dtypes == found.dtypes


def test_score_bounds_hold():
    random = np.random.Generator(np.random.PCG64(5))
    for size in (1, 3, 64):
        rows = random.integers(-500, 500, (300, size))
        rows[:20] = rows[20:40] * 7
        references = random.normal(size=(4, size))
        norms, turned = angular_negatives.angles(rows, references)
        exact = rows @ rows.T
        low, high = angular_negatives.score_bounds(norms, turned, norms, turned, turned)
        assert (low <= exact).all()
        assert (exact <= high).all()
    # In few dimensions the references settle most pairs.
    rows = random.integers(-500, 500, (300, 2))
    norms, turned = angular_negatives.angles(rows, random.normal(size=(16, 2)))
    low, high = angular_negatives.score_bounds(norms, turned, norms, turned, turned)
    assert ((high - low) < 0.2 * norms[:, None] * norms[None, :] + 4).mean() > 0.5


def test_long_products_are_exact_or_refused(spark):
    rows = [(0, [2.0**17, 1.0], 1), (1, [2.0**17, 3.0], 1), (2, [2.0**16, 5.0], 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    found = angular_negatives.hard_negatives(table).select(*NAMES).collect()
    assert sorted(tuple(r) for r in found) == plain_negatives(rows)
    far = spark.createDataFrame([(0, [2.0**40], 1)], "vec_id long, embedding array<double>, label long")
    with pytest.raises(Exception, match="beyond"):
        angular_negatives.hard_negatives(far).count()


# --- centroid clustering -----------------------------------------------------


def plain_clusters(rows, size, clusters, rounds) -> list[tuple]:
    kept = []
    for i, vector in rows:
        if vector is None or len(vector) != size or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(64 * x) for x in vector]
        kept.append((i, whole))

    def first(row):
        content = np.array(row[1], np.int32).tobytes()
        return (row[0] is None, hashlib.sha256(f"1:{row[0]}".encode()).hexdigest(), content)

    centroids = [list(v) for _, v in sorted(kept, key=first)[:clusters]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        groups: dict[int, list] = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for k, own in groups.items():
            centroids[k] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    placed = [(i, *nearest(v)) for i, v in kept]
    inertia: dict[int, int] = {}
    for _, d, k in placed:
        inertia[k] = inertia.get(k, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    total = sum(inertia.values())
    return sorted(((i, k, d, inertia[k], total, digest[k]) for i, d, k in placed), key=repr)


def test_clusters_equal_the_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(va_file, "SAMPLE", 50)
    monkeypatch.setattr(va_file, "BATCH", 37)
    random = np.random.Generator(np.random.PCG64(2))
    rows = [(i, (random.normal(size=6) * random.choice([0.2, 5])).tolist()) for i in range(400)]
    rows += [(i, [1.0, -1.0, 0.5, 0.0, 0.25, 3.0]) for i in range(1000, 1200)]
    rows += [(7, [0.1] * 6), (7, [0.1] * 6), (None, [0.3] * 6), (3000, [0.0] * 6), (3001, [900.0] * 6)]
    rows += [(4000, None), (4001, [1.0]), (4002, []), (4003, [None] * 6), (4004, [float("nan")] * 6)]
    rows += [(4005, [float("-inf")] * 6)]
    table = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], VECTORS)
    found = va_file.cluster_vectors(table, size=6, clusters=9, rounds=4)
    names = ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    got = sorted((tuple(r) for r in found.select(*names).collect()), key=repr)
    assert got == plain_clusters(rows, 6, 9, 4)
    few = va_file.cluster_vectors(table.where("vec_id BETWEEN 3000 AND 3001 OR vec_id = 1000"), size=6)
    assert sorted((tuple(r) for r in few.select(*names).collect()), key=repr) == plain_clusters(
        [r for r in rows if r[0] in (3000, 3001, 1000)], 6, 16, 3
    )
    empty = va_file.cluster_vectors(table.where("vec_id >= 4000"), size=6)
    assert empty.count() == 0
    assert empty.dtypes == found.dtypes


def test_cells_settle_most_vectors():
    """Intervals hold, and leave few vectors to fetch."""
    random = np.random.Generator(np.random.PCG64(4))
    matrix = np.floor(64 * random.normal(size=(3000, 64)) / 8).astype(np.int64)
    low, high = matrix.min(axis=0), matrix.max(axis=0)
    marks = va_file.cell_marks(matrix[:500], low, high)
    assert max(map(len, marks)) <= 2**va_file.BITS
    cells = va_file.decode(va_file.encode(matrix, marks), 64)
    lookup = va_file.Lookup(marks, high, matrix[:16])
    near = lookup.nearest(cells)
    exact = ((matrix[:, None, :] - matrix[None, :16, :]) ** 2).sum(axis=2).argmin(axis=1)
    assert (near[near >= 0] == exact[near >= 0]).all()
    assert (near >= 0).mean() > 0.8
