"""Every corpus query and the whole pipeline over the small tables, as they are registered."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from conftest import TESTDATA
from test_text_operators import plain_base, plain_ids, plain_set

import corpus_pipeline
from biotrace.llm import html_extract, multi_index
from biotrace.llm.registry import QUERIES, SQL

SF_DIR = f"{TESTDATA}/sf0.001"

# Columns of the contract; more may follow.
COLUMNS = {
    "op1_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op2_html_extract": "page_id url text n_chars",
    "op3_quote_threads": "thread_id position conv_id turn text",
    "op4_minhash_bbit": "doc_id n_shingles component_id kept",
    "op5_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op6_multi_index": "vec_id n_links component_id kept",
    "op7_decontamination": "doc_id item_id",
    "op8_token_shards": "slot shard doc_id start n_tokens",
    "op9_crf_langid": "doc_id held_out lang_pred score",
    "op10_nnls_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op11_iblt_fingerprint": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op12_angular_negatives": "anchor_id positive_id rank negative_id positive_score negative_score",
    "op13_va_file": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
}


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def results(spark):
    return {name: query(spark, SF_DIR).collect() for name, query in QUERIES.items()}


def test_columns_of_every_query(results):
    assert set(COLUMNS) == set(QUERIES)
    for name, columns in COLUMNS.items():
        assert results[name], name
        assert set(columns.split()) <= set(results[name][0].asDict()), name
    assert set(SQL) <= set(QUERIES)


def test_texts_of_pages(spark, results):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    assert {r.page_id for r in results["op2_html_extract"]} == set(pages)
    for r in results["op2_html_extract"]:
        assert r.url == pages[r.page_id].url
        assert r.n_chars == len(r.text)
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id].html or "", re.S)
        if inner and "<article" not in inner[1]:
            # What stands between the article's tags, and nothing of the rest.
            assert r.text == html_extract.extract(f"<body>{inner[1]}</body>", [])


def test_shingle_counts(documents, results):
    for r in results["op4_minhash_bbit"]:
        assert r.n_shingles == len(plain_set(documents[r.doc_id].text))
        assert r.kept == (r.component_id == r.doc_id)


def test_personal_data_digests(documents, results):
    for r in results["op5_personal_data"]:
        base = plain_base(documents[r.doc_id].text)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        counts = [sum(s.startswith(f"{kind}:") for s in base) for kind in ("email", "ip", "card", "phone")]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts


def test_languages_of_held_out_documents(documents, results):
    right = total = 0
    for r in results["op9_crf_langid"]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        if r.held_out and documents[r.doc_id].lang is not None:
            total += 1
            right += r.lang_pred == documents[r.doc_id].lang
    assert right >= 0.97 * total > 0


def test_pieces_of_every_document(documents, results):
    pieces: dict = {}
    for r in results["op10_nnls_packing"]:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(documents)
    used: dict = {}
    for i, own in pieces.items():
        ids = plain_ids(documents[i].text)
        own.sort(key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert zlib.crc32(part.tobytes()) == r.ids_crc32
            used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048
    assert sum(used.values()) >= 0.95 * 2048 * len(used)


def test_slots_of_every_sequence(documents, results):
    rows = results["op8_token_shards"]
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    by_doc: dict = {}
    for r in rows:
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.n_tokens
    assert by_doc == {i: len(plain_ids(r.text)) for i, r in documents.items()}


def test_the_whole_pipeline(spark, documents):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = [set(documents)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert kept[-1] <= kept[-2]
        assert kept[-1]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.n_chars == len(texts[r.doc_id]) for r in docs.collect())
    assert not any(plain_base(t) for t in texts.values())
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    tokens: dict = {}
    for r in rows:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {i: len(plain_ids(t)) for i, t in texts.items()}


def test_planted_neighbours_are_found_at_any_codebook(spark, monkeypatch):
    """Recall over vectors at the least similarity, with small cells and split bundles."""
    pick = np.random.default_rng(11)
    base = pick.normal(size=(1500, 24))
    base /= np.linalg.norm(base, axis=1)[:, None]
    turn = pick.normal(size=base.shape)
    turn -= (turn * base).sum(axis=1)[:, None] * base
    turn /= np.linalg.norm(turn, axis=1)[:, None]
    near = 0.951 * base + np.sqrt(1 - 0.951**2) * turn
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for cell, block in ((4, 16), (200, 2048)):
        monkeypatch.setattr(multi_index, "CELL", cell)
        monkeypatch.setattr(multi_index, "BLOCK", block)
        found = {r.id: r.n_links for r in multi_index.near_vectors(frame).collect()}
        assert sum(found[i] >= 1 for i in range(1500)) >= 0.99 * 1500


def test_bundles_hold_bounded_numbers(monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 10)
    counts = np.array([[3, 3, 3, 3], [20, 0, 0, 1], [0, 0, 0, 0]])
    bundles = multi_index.bundles_of(counts)
    assert bundles.tolist() == [[0, 0, 0, 1], [2, 3, 3, 3], [4, 4, 4, 4]]
