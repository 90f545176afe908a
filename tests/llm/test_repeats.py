"""Repeated rows, repeated ids with other contents, null ids and columns with clashing names, for each operator."""

from __future__ import annotations

import hashlib
import math
import random
import re

import public_tokenizers
import pytest

from camwatch.llm import decontam, token_store, topk_search, unigram, warc
from camwatch.llm.common import scratch


def test_warc_keeps_every_payload(spark):
    x, y, z = "x" * 1200, "y" * 1300, "z" * 10
    rows = [(5, "u", x, 1), (5, "u", y, 1), (9, "u", x, 2), (9, "u", x, 2), (5, "u", x, 3), (None, None, x, 4), (None, None, z, 4), (7, "u", None, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(2)
    path = scratch(spark, "warc")
    warc.write_warc(pages, path)
    got = warc.read_warc(spark, path).collect()
    number = lambda u: int(re.search(r"\d+", u).group()) if u else None
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    found = sorted((number(r.record_id) or -1, r.type, r.block_digest if r.type == "response" else r.payload_digest.removeprefix("sha1:"), number(r.refers_to) or 0) for r in got)
    assert found == sorted(
        [(5, "revisit", sha(x), 9), (5, "revisit", sha(x), 9), (5, "response", sha(y), 0), (9, "response", sha(x), 0), (9, "response", sha(x), 0), (-1, "response", sha(x), 0), (-1, "response", sha(z), 0), (7, "response", sha(""), 0)]
    )


def test_contamination_looks_at_each_row(spark):
    words = [f"w{k}" for k in range(12)]  # 8 shingles
    half, rest, whole = " ".join(words[:8]), " ".join(words[4:]), " ".join(words)
    docs = [(2, half, "a"), (2, rest, "b"), (3, half, "a"), (3, whole, "b"), (3, whole, "b"), (None, whole, "c")]
    items = [(7, whole, 1), (7, "quite another item of words", 1), (7, whole, 1), (None, whole, 2)]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string, shingle string"), spark.createDataFrame(items, "item_id long, text string, width int"))
    assert sorted((r.doc_id, r.item_id or -1, r.n_shingles, r.n_found) for r in got.collect()) == [(3, -1, 8, 8), (3, 7, 8, 8)]
    kept = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string, shingle string"), spark.createDataFrame(items, "item_id long, text string, width int"))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 2]


def test_token_files_of_null_and_repeated_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(None, "a b", 1), (None, None, 1), (4, "one two", 2), (4, "three", 2), (4, "one two", 2), (9, "", 3), (-3, "x", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hash int").repartition(3)
    for size in (4, 1 << 20):
        got = sorted(token_store.round_trip(df, path, bytes_per_file=size).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == [None, None, -3, 4, 4, 4, 9]
        assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
        assert len({r.ids_crc32 for r in got if r.doc_id == 4}) == 2


def exact_topk(rows, k):
    """Each row's k best others of another id, with Python's whole numbers."""
    known = [(i, [math.floor(256 * x) for x in e]) for i, e, *_ in rows if i is not None]
    out = []
    for i, a in known:
        best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), j) for j, b in known if j != i)[:k]
        out += [(i, rank, j, -score) for rank, (score, j) in enumerate(best, 1)]
    return sorted(out)


def test_topk_counts_every_row_and_large_components(spark):
    schema = "vec_id long, embedding array<double>, score int"
    rng = random.Random(5)
    few = [[0.25, 0.5], [0.5, 0.5], [1e6, -3e5], [-1e6, 0.5], [300000.0, 400000.0]]
    tables = [
        [(50, [1.0, 0.0], 1), (1, [0.5, 0.0], 1), (1, [0.25, 0.0], 1)],
        [(50, [300000.0, 0.0], 1), (1, [300000.0, 1.0], 1), (2, [400000.0, 0.0], 1), (None, [1.0, 1.0], 3)],
        [(rng.randint(0, 9), rng.choice(few), 0) for _ in range(60)],
        [(7, [1.0, 2.0], 0)] * 9 + [(8, [1.0, 2.0], 0)] * 2 + [(9, [3.0, 2.0], 0)],
    ]
    for rows in tables:
        got = topk_search.top_k(spark.createDataFrame(rows, schema)).collect()
        assert sorted(tuple(r) for r in got) == exact_topk(rows, 5)
    with pytest.raises(ValueError, match="64 bits"):
        topk_search.top_k(spark.createDataFrame([(1, [1e30], 1), (2, [1.0], 1)], schema))


def test_stored_ids_decode(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(1, "some words, ñandú 😀", "a"), (1, "some words, ñandú 😀", "a"), (None, None, "b"), (2, "", "c"), (3, "long " * 20_000, "d")]
    ids = unigram.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, decoded string"), path, ids_out=True, text_out=True)
    got = unigram.decode_ids(ids.withColumn("wanted", ids["decoded"]), path).collect()
    assert len(got) == 5 and all(r.decoded == r.wanted == (r.text or "") and r.round_trip for r in got)
    odd = spark.createDataFrame([(None,), (b"",), ((2**31).to_bytes(4, "little"),)], "piece_ids binary")
    assert sorted((r.decoded is None, r.decoded or "") for r in unigram.decode_ids(odd, path).collect()) == [(False, ""), (False, ""), (True, "")]
