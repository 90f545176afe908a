"""The training-data operators against brute force, round trips and held-out labels, with edge cases."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from camwatch.llm import common, decontam, license_scan, line_dedup, ngram_jaccard, token_store, topk_search, toxicity, unigram, url_filter, warc
from camwatch.llm.common import components, scratch

RNG = random.Random(7)
WORDS = [a + b for a in "ka lo mi nu pe ra so tu".split() for b in "n r s t x".split()]
DOCS = "doc_id long, text string, lang string"


def text(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edit(t, k, rng=RNG):
    w = t.split(" ")
    for _ in range(k):
        w[rng.randrange(len(w))] = rng.choice(WORDS) + "q"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, short, empty and null texts, a long one."""
    rng = random.Random(3)
    base = [text(rng.randint(20, 120), rng) for _ in range(25)]
    docs = []
    for b in base:
        docs += [b] * rng.randint(1, 3) + [edit(b, rng.randint(1, 4), rng) for _ in range(rng.randint(0, 4))]
    docs += ["", None, "One", "one", "two words", "  \n\t ", text(6000, rng), "ünï cödé ßtuff 日本 x"]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_warc_round_trip_with_magic_in_payloads(spark):
    rng = random.Random(1)
    big = "x" * 1200
    fake = "a WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n" + "pad " * 400
    rows = [(i, f"http://h/{i}", t) for i, t in enumerate([big, "small", "small", big, fake, None, "", big, fake + "é", "WARC/1.", "\r\n\r\nWARC/1.1\r\n"] + [text(rng.randint(1, 900), rng) for _ in range(40)])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = scratch(spark, "warc")
    warc.write_warc(pages, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in (old, "3000b", "777b"):  # records over many splits
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = {int(re.search(r"\d+", r.record_id).group()): r for r in warc.read_warc(spark, path).collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert len(got) == len(rows)
        for i, _, t in rows:
            data = (t or "").encode()
            same = [j for j, _, u in rows if (u or "") == (t or "") and len(data) >= 1000]
            revisit = bool(same) and i < max(same)
            assert got[i].type == ("revisit" if revisit else "response"), i
            assert got[i].payload_bytes == len(data)
            assert got[i].payload_digest == "sha1:" + hashlib.sha1(data).hexdigest()
            if revisit:
                assert got[i].refers_to == f"<urn:page:{max(same)}>"
            else:
                assert got[i].block_digest == hashlib.sha1(data).hexdigest()


def test_warc_empty(spark):
    path = scratch(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


def brute_topk(rows, asked, k):
    v = {i: np.floor(256 * np.asarray(e, float)).astype(int) for i, e in rows if e is not None and all(x is not None and np.isfinite(x) for x in e)}
    out = set()
    for q in asked:
        if q in v:
            best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:k]
            out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(best)}
    return out


@pytest.mark.parametrize("copies", [0, 40])
def test_topk(spark, copies):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(120)]
    rows += [(200 + i, rows[50][1]) for i in range(copies)] + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (950, [float("inf")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {tuple(r) for r in topk_search.top_k(df, df.filter("vec_id % 10 = 0"), 5).collect()}
    assert got == brute_topk(rows, [i for i, _ in rows if i % 10 == 0], 5)


def test_topk_few_and_none(spark):
    df = spark.createDataFrame([(0, [0.5, 0.5]), (1, [0.25, 0.0])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk_search.top_k(df).collect()} == {(0, 1, 1, 128 * 64), (1, 1, 0, 128 * 64)}
    assert topk_search.top_k(df.limit(0)).count() == 0


def test_topk_of_few_distinct_vectors_with_copies(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [0.25, 0.0]), (4, [0.25, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk_search.top_k(df).collect()]
    assert len(got) == 12 and set(got) == brute_topk(rows, [1, 2, 3, 4], 5)


def grams(t, n):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_classes(docs, n, percent):
    sets = {i: grams(t, n) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {(i, len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
@pytest.mark.parametrize("chunk", [20_000, 3])
def test_ngram_classes(spark, corpus, n, percent, chunk, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "CHUNK", chunk)  # 3: buckets are cut into chunks
    df = spark.createDataFrame([(i, t, "en") for i, t in corpus], DOCS)
    assert {tuple(r) for r in ngram_jaccard.ngram_classes(df, n, percent).collect()} == brute_classes(corpus, n, percent)


def test_ngram_edges(spark):
    df = spark.createDataFrame([(None, "a b c d", 1), (5, "a b c d", 2), (5, "a b c d", 2), (3, "A  B c\td", 3)], "doc_id long, text string, n int")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_jaccard.ngram_classes(df).collect())
    assert got == [(-1, 2, None), (3, 2, 3), (5, 2, 3), (5, 2, 3)]
    assert ngram_jaccard.ngram_classes(df.limit(0)).count() == 0


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    for k in (0, 1, 7, 40):
        b = np.unique(np.concatenate((a[k:], rng.integers(0, 2**63, k, dtype=np.uint64))))
        apart = int(np.bitwise_count(np.frombuffer(ngram_jaccard.sketch(a), np.uint64) ^ np.frombuffer(ngram_jaccard.sketch(b), np.uint64)).sum())
        assert apart <= 2 * k


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {r.component for r in components(links).filter("id < 100").collect()} == {0}


def test_toxicity(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        w = [rng.choice(WORDS) for _ in range(40)]
        if bad:
            for _ in range(3):
                w[rng.randrange(40)] = "zorg" + rng.choice(["a", "ix", "um"])
        rows.append((i, " ".join(w), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_on(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = {r.doc_id: r.score >= 0.3 for r in toxicity.score_texts(df, model).filter(toxicity.held_out(F.col("doc_id"))).collect()}
    want = {i: bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert got == want


def test_toxicity_grammar_and_edges(spark):
    s = toxicity.Scorer(toxicity.Model({"idiot$": 2.0}))
    plain, aimed, denied, told = (s.evidence(t) for t in ("what an idiot", "you idiot", "he is not an idiot", "they said idiot"))
    assert aimed > plain > denied and plain > told
    assert s.evidence("idiotic machine") == 0 == s.evidence("")
    df = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (2, "idiot " * 50_000, 3.0)], "doc_id long, text string, score double")
    got = {r.doc_id: r.score for r in toxicity.score_texts(df, toxicity.Model({"idiot$": 2.0})).collect()}
    assert got[None] == got[1] < 0.3 <= got[2] <= 1
    assert toxicity.fit_on(df.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).stems


def brute_licenses(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    hits = [(i, label) for p, label in license_scan.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_licenses(spark):
    rng = random.Random(4)
    bits = ["CC BY-NC 4.0", "licensed under cc by", "General  Public\nLicense", "all rights, reserved", "ALL RIGHTS RESERVED.", "ccby", "occ by", "cc bye", "x\0cc\0by", "é", "Zß9"]
    rows = [(i, " ".join(rng.choice(bits + WORDS) for _ in range(rng.randint(0, 30)))) for i in range(150)] + [(900, None), (901, ""), (902, "w " * 200_000 + "all rights reserved")]
    got = {r.doc_id: tuple(r)[1:6] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute_licenses(t) for i, t in rows}


def test_fuzzy_notice(spark):
    t = "prose here. Licenced under the Apache Licence, Version 2.0 and more"
    r = license_scan.scan_licenses(spark.createDataFrame([(1, t), (2, "nothing of the kind")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert "apache-2.0" in r[0].labels and r[0].base_labels == "" and 0.8 < r[0].score < 1
    assert (r[0].spans[0].first_word, r[1].labels, r[1].score) == (2, "", 0.0)


def test_line_dedup(spark):
    rng = random.Random(6)
    pool = [text(rng.randint(1, 25), rng) for _ in range(40)]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) if rng.random() < 0.6 else edit(rng.choice(pool), rng.randint(1, 3), rng) for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(lines + ["", "  "])))
    # any earlier line of the input, removed or not, counts
    earlier, want = [], {}
    for i, t in rows:
        keep = []
        for line in t.split("\n"):
            w = frozenset(line.lower().split(" ")) - {""}
            if not w or not any(100 * len(w & s) >= 80 * len(w | s) for s in earlier):
                keep.append(line)
            if w:
                earlier.append(w)
        want[i] = "\n".join(keep)
    df = spark.createDataFrame([(i, t, "en") for i, t in rows] + [(None, "a b\na b", "en"), (99, None, "en"), (100, "", "de")], DOCS)
    got = line_dedup.dedup_lines(df).collect()
    assert {r.doc_id: r.text for r in got if r.doc_id is not None and r.doc_id < 99} == want
    assert {(r.doc_id, r.text, r.n_removed) for r in got if r.doc_id is None or r.doc_id >= 99} == {(None, "a b\na b", 0), (99, None, 0), (100, "", 0)}
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_rows_for_each_line(spark):
    """Lines that only an equal set is like make no rows, and a word none in bands where it stands too far back."""
    words = lambda n: " ".join(f"w{n}x{k}" for k in range(n))
    sizes = (1, 2, 3, 4, 40, 64)
    texts = spark.createDataFrame([(n, words(n)) for n in sizes], "doc_id long, text string")
    classes = line_dedup.line_table(texts, bytes(line_dedup.BUCKETS), 80).withColumnRenamed("doc_id", "doc")
    rows = {r.doc: r["count"] for r in line_dedup.exploded(classes, 80).groupBy("doc").count().collect()}
    # 40 words: partners have 32 at least, so 32 common words; 64: in its own band 64, so 57 common, in the lower one 52
    assert rows == {4: 1, 40: 9, 64: 8 + 13}


def test_line_dedup_of_crowds(spark, monkeypatch):
    """Near copies in groups larger than those compared at once: what the earliest line doesn't decide, the others do."""
    monkeypatch.setattr(line_dedup, "FEW", 2)
    rng = random.Random(8)
    pool = [text(rng.randint(4, 12), rng) for _ in range(4)]
    rows = [(i, "\n".join(edit(rng.choice(pool), rng.randint(0, 3), rng) for _ in range(5))) for i in range(14)]
    earlier, want = [], {}
    for i, t in rows:
        sets = [frozenset(line.split(" ")) for line in t.split("\n")]
        gone = [any(100 * len(w & s) >= 80 * len(w | s) for s in earlier + sets[:k]) for k, w in enumerate(sets)]
        earlier += sets
        want[i] = "\n".join(line for line, g in zip(t.split("\n"), gone, strict=True) if not g)
    got = line_dedup.dedup_lines(spark.createDataFrame([*rows, (None, pool[0])], "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == want | {None: pool[0]}


def test_token_files(spark, corpus):
    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = [" a  b", "a \n b", "x\ty z ", "\n\n a", " lead", "trail ", "don't I'm 1234 5.6", "<|endoftext|> x", "a\u3000 b", "\x1c a\x85 b", "ok... (fine) 50%."]
    rows = corpus + [(1000 + i, t) for i, t in enumerate(odd)]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS).repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in token_store.round_trip(df, path, bytes_per_file=2000).collect()}
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    start = 0
    for i, t in sorted(rows):
        ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes())), t
        start += len(ids)
    assert token_store.round_trip(df.limit(0), path).count() == 0


def test_added_tokens_in_a_text_are_the_librarys():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["<|endoftext|> x", "some words<|endoftext|>", "a <|endoftext|> b, c", "<|endoftext|>", "a b c", "<|endoftext |> x"]
    encoder, library = token_store.WordEncoder(path), Tokenizer.from_file(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(texts)] == want and 50256 in want[0]


def test_words_encode_as_whole_texts_do():
    """Random strings of what splits words: the ids are those of the library on the whole text."""
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(11)
    bits = [" ", "  ", "\n", "\t", "\r\n", "a", "Word", "don't", "it's", "'", "’s", "1234", "5.6", ",", "...", "!?", "(x)", "é", "日本", "ß", "😀", "\u3000", "\x85", "\x1c", "\u200b", "_", "-", "a_b", "\x00", "ñandú", "I'LL", "%$", "²"]
    texts = ["".join(rng.choice(bits) + (" " if rng.random() < 0.5 else "") for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    encoder, library = token_store.WordEncoder(path), Tokenizer.from_file(path)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(texts)] == want


def test_new_words_go_to_the_library_many_at_a_time():
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(5)
    words = sorted({"".join(rng.choice("aeinrst") for _ in range(rng.randint(3, 12))) for _ in range(3000)})
    texts = [" ".join(w + rng.choice(["", ",", ".\nX"]) for w in words[k : k + 100]) for k in range(0, len(words), 100)]
    encoder, library = token_store.WordEncoder(path), Tokenizer.from_file(path)
    asked = []

    class Asked:
        def __init__(self, of):
            self.of = of

        def __getattr__(self, name):
            asked.append(name)
            return getattr(self.of, name)

    encoder.tokenizer, encoder.model = Asked(library), Asked(library.model)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(texts)] == want
    assert asked.count("encode_batch_fast") < 10 and len(asked) < 2 * len(texts)  # a text's first word alone, and what follows words


def test_frames_are_checked(tmp_path):
    import io

    import xxhash
    import zstandard

    raws = [np.arange(n).astype("<u2").tobytes() for n in (1, 500, 3)]
    out = io.BytesIO()
    token_store.write_frames(out, [(i, zstandard.ZstdCompressor().compress(r), len(r), xxhash.xxh64_intdigest(r) & 0xFFFFFFFF) for i, r in enumerate(raws)], 2)
    data = out.getvalue()
    r = token_store.FrameReader(io.BytesIO(data), len(data))
    assert [len(r.ids(k)) for k in range(3)] == [1, 500, 3]
    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == b"".join(raws)  # any reader skips the tail
    r.entries = r.entries.copy()
    r.entries[1, 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        r.ids(1)


def contained(docs, items):
    """Brute force: (document, item, shingles, found) of distinct ids."""
    want = set()
    for i, t in docs:
        for j, u in items:
            width = min(5, len(re.split(r"\s+", (u or "").strip())))
            a, b = grams(t, width), grams(u, width)
            a = a if all(len(g) == width for g in a) else set()
            if i is not None and b and len(a & b) >= 0.8 * len(b) - 1e-9:
                want.add((i, j, len(b), len(a & b)))
    return want


def test_contamination(spark):
    rng = random.Random(8)
    items = [(i, text(n, rng) + " zz") for i, n in enumerate((1, 2, 3, 4, 5, 6, 12, 40, 90, 200))] + [(90, None), (91, ""), (92, "xyzzy")]
    docs = []
    for i in range(60):
        t = text(rng.randint(3, 300), rng)
        if i % 2:
            w, piece = t.split(" "), edit(items[i % 11 % 10][1], i % 3 if i % 11 > 4 else 0, rng)
            t = " ".join(w[: len(w) // 2] + [piece] + w[len(w) // 2 :])
        docs.append((i, t))
    docs += [(100, None), (101, ""), (102, items[0][1]), (None, items[4][1]), (103, "so Xyzzy it is"), (104, text(6000, rng) + " " + items[9][1])]
    want = contained(docs, items)
    assert {j for _, j, _, _ in want} == {*range(10), 92}
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r) for r in got.collect()} == want
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), empty).count() == 0
    assert decontam.contaminated(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_url_rules(spark):
    urls = ["http://A.Net/x", "http://net", "https://b.example.net/en/1?q", "http://example.com/de/1#f", "http://xexample.com/de/1", "http://w.org/fr/", "nonsense", None, "http://a.net?x=/en/", "x://y://z/p"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.judge_urls(df).collect()}
    assert got == {
        0: ("a.net", "/x", "net/"), 1: ("net", "", None), 2: ("b.example.net", "/en/1", "example.net/en/"), 3: ("example.com", "/de/1", "example.com/de/"), 4: ("xexample.com", "/de/1", None),
        5: ("w.org", "/fr/", "org/fr/"), 6: ("", "", None), 7: ("", "", None), 8: ("a.net", "", None), 9: ("y:", "//z/p", None),
    }
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_pagerank(spark):
    edges = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "c", 2.0)]
    got = {r.host: r["rank"] for r in url_filter.pagerank(spark.createDataFrame(edges, "src string, dst string, w double"), spark.createDataFrame([("a", 2.0), ("d", 2.0)], "host string, seed double"), rounds=6).collect()}
    seed, rank = {"a": 0.5, "d": 0.5}, {"a": 0.5, "d": 0.5}
    out = {s: sum(w for x, _, w in edges if x == s) for s, _, _ in edges}
    for _ in range(6):
        rank = {h: 0.15 * seed.get(h, 0) + 0.85 * sum(rank.get(s, 0) * w / out[s] for s, d, w in edges if d == h) for h in "abcd"}
    assert all(abs(got.get(h, 0) - rank[h]) < 1e-9 for h in "abcd")


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    link = '<a href="http://bad.net/x">l</a>'
    df = spark.createDataFrame([(1, "http://bad.net/x", ""), (2, "http://friend.info/", link), (3, "http://good.info/", "<a href=/x>")], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(df).collect()} == {1: "block", 2: "block", 3: "allow"}


def test_distrust_reaches_siblings_over_a_parent_without_pages(spark):
    hosts = ["bad.site.info", "m.new.site.info", "new.site.info", "other.info", "10.0.0.1", "9.0.0.1"]
    df = spark.createDataFrame([(i, f"http://{h}/x", None) for i, h in enumerate(hosts)], "page_id long, url string, html string")
    edges = {(r.src, r.dst) for r in url_filter.host_edges(df.withColumn("host", url_filter.split_url(F.col("url"))[0]), "html").collect()}
    up = {("bad.site.info", "site.info"), ("m.new.site.info", "new.site.info"), ("new.site.info", "site.info")}
    assert edges == up | {(b, a) for a, b in up}
    got = {r.host: r for r in url_filter.judge_urls(df, rules=[("block", "bad.site.info", "/")], threshold=0.1).collect()}
    assert {h for h in hosts if got[h].method_verdict == "block"} == {"bad.site.info", "m.new.site.info", "new.site.info"}
    assert got["bad.site.info"].distrust > got["new.site.info"].distrust > got["m.new.site.info"].distrust > 0 == got["other.info"].distrust


def test_mostly_unmatched_host_stays_allowed(spark):
    urls = ["http://www.some.info/de/"] + [f"http://www.some.info/{i}" for i in range(5)] + [f"http://all.bad.org/{p}/" for p in ("de", "de", "x")]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judge_urls(df, rules=[("block", "info", "/de/"), ("block", "org", "/de/")]).collect()}
    assert [got[i].verdict for i in range(9)] == ["block", *["allow"] * 5, "block", "block", "block"]
    assert abs(got[1].distrust - 1 / 6) < 1e-9 and abs(got[8].distrust - 2 / 3) < 1e-9


def test_unigram_against_the_library(spark, corpus):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary = unigram.load_vocabulary(path)
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    score = {i: s for i, _, s in vocabulary.pieces}
    for i, p in enumerate(proto.pieces):
        p.score = score.get(i, p.score)
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = [t or "" for _, t in corpus] + ["  two  spaces ", "日本語 😀 ñandú", "tab\tand\nline", "a"]
    model = unigram.Unigram(vocabulary)
    total = lambda ids: sum(score.get(i, 0.0) for i in ids)
    for t, x in zip(texts, model.encode(texts), strict=True):
        ids = np.frombuffer(x, "<u4").tolist()
        want = library.encode(t)
        assert ids == want or abs(total(ids) - total(want)) < 1e-3, t  # the library adds single-precision scores: ties may differ
        assert model.decode(x) == t
    df = spark.createDataFrame([(i, t, "en") for i, t in corpus], DOCS)
    got = unigram.encode_decode(df, path, ids_out=True).collect()
    assert len(got) == len(corpus) and all(r.round_trip for r in got)
    assert unigram.encode_decode(df.limit(0), path).count() == 0


def test_trie_holds_just_its_keys():
    keys = [b"a", b"ab", b"abc", b"b", bytes([255, 0]), "▁é".encode()]
    base, check, value = unigram.build_trie(keys)

    def find(key):
        s = 0
        for b in key:
            t = base[s] + b + 1
            if t >= len(check) or check[t] != s:
                return -1
            s = t
        return value[s]

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert [find(k) for k in (b"ac", b"", b"\xff", b"abcd")] == [-1] * 4


def test_ngram_sets_go_before_the_keys_are_shuffled(spark, corpus, monkeypatch):
    paths, there = {}, {}

    def seen(df, name):
        there[name] = [n for n, p in paths.items() if os.path.exists(p.removeprefix("file:").replace("//", "/"))]
        out = common.table(df, name)
        paths[name] = out.scratch_path
        return out

    monkeypatch.setattr(ngram_jaccard, "table", seen)
    ngram_jaccard.ngram_classes(spark.createDataFrame([(i, t, "en") for i, t in corpus], DOCS)).count()
    assert "rows" in there["buckets"] and "sets" not in there["buckets"]
