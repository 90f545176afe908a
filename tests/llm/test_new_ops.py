"""Prefix trie, byte-level BPE and spelling variants against brute force and the public library, with edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from camwatch.llm import byte_bpe, prefix_trie, queries, spelling

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def brute_trie(seqs):
    """All nodes from all prefixes; sequences of (role, text) by conversation."""
    members, kids = defaultdict(list), defaultdict(list)
    for c in sorted(seqs):
        q = tuple(seqs[c])
        for d in range(len(q) + 1):
            members[q[:d]].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved, out = {}, {}, set()
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
        ends = ",".join(str(c) for c in members[k] if len(seqs[c]) == len(k))
        out.add((members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def some_conversations(rng, n):
    """Copies in a hot group, long ones, shared beginnings, empty ones."""
    seqs = {}
    for c in rng.sample(range(-50, 2000), n):
        k = rng.random()
        seqs[c] = [] if k < 0.05 else [("u", "hot")] * rng.choice([1, 1, 1, 20]) if k < 0.4 else [(rng.choice("ua"), rng.choice(["x", "yy", "zé日", "", "hot"])) for _ in range(rng.choice([1, 2, 3, 5, 9, 18, 30]))]
    return seqs


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("least", [1 << 14, 12, 1])
def test_trie_equals_all_prefixes_however_it_is_sharded(spark, least):
    rng = random.Random(least)
    seqs = some_conversations(rng, 150)
    rows = [(c, i, r, t) for c, q in seqs.items() for i, (r, t) in enumerate(q)]
    rng.shuffle(rows)
    turns = prefix_trie.turn_sequences(spark.createDataFrame(rows, TURNS))
    ids = spark.createDataFrame([(c,) for c in seqs], "conv_id long")
    got = [tuple(r) for r in prefix_trie.prefix_trie(ids.join(turns, "conv_id", "left"), least).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_trie(seqs)


def test_recombination_takes_several_rounds():
    """200 shards of one row each, 64 at a time."""

    class Row:
        def __init__(self, **k):
            self.__dict__.update(k)

    def shard(i, chain):
        return [prefix_trie.Node(Row(key=k, parent_key=chain[d - 1] if d else None, depth=d, first=True, last=True, chars=d, conv_id=i, n_convs=1, n_children=0, n_leaves=0, saved_tokens=0)) for d, k in enumerate(chain)]

    shards, closed = [shard(i, ["", "a", f"a{i // 3}", f"a{i // 3}-{i}"]) for i in range(200)], []
    while len(shards) > 1:
        groups = [shards[k : k + 64] for k in range(0, len(shards), 64)]
        done = [prefix_trie.recombine(g, len(groups) == 1) for g in groups]
        closed += [x for c, _ in done for x in c]
        shards = [o for _, o in done]
    found = {x.key: (x.n, x.conv, x.children, x.leaves, x.saved) for x in closed}
    assert len(found) == len(closed) == 2 + 67 + 200
    assert found[""][:4] == (200, 0, 1, 200) and found["a"][:4] == (200, 0, 67, 200) and found["a5"] == (3, 15, 3, 3, 4)
    assert found[""][4] == 199 * 1 + 2 * (200 - 67)


def test_turns_with_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(1, None, None, None, 5), (1, 2, "u", "b", 5), (1, 2, "u", "b", 5), (1, 1, "a", "é日", 5), (None, 1, "u", "x", 5), (2, None, "", "", 5)]
    seqs = {r.conv_id: r.turns for r in prefix_trie.turn_sequences(spark.createDataFrame(rows, TURNS + ", turns int")).collect()}
    assert set(seqs) == {1, 2} and [t.chars for t in seqs[1]] == [0, 2, 1, 1] and seqs[1][2] == seqs[1][3] and seqs[1][0] == seqs[2][0]
    ties = [(c, 1, "u", t) for c in (1, 2) for t in ("ab"[:: 3 - 2 * c])]
    one, two = (r.turns for r in prefix_trie.turn_sequences(spark.createDataFrame(ties, TURNS)).orderBy("conv_id").collect())
    assert one == two
    assert prefix_trie.prefix_trie(prefix_trie.turn_sequences(spark.createDataFrame([], TURNS))).collect() == []


def test_trie_query_rebuilds_conversations(spark, tmp_path):
    rng = random.Random(2)
    own = {c: [("u", rng.choice("abcd")) for _ in range(rng.choice([1, 2, 4, 8]))] for c in [*range(0, 12), *range(100, 140), 205, 307]}
    spark.createDataFrame([(c, i, r, t) for c, q in own.items() for i, (r, t) in enumerate(q)], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    again = {}
    for c, q in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        again[c] = own.get(c - c % 100, [])[:h] + q[h:]
    assert {tuple(r) for r in queries.op11_prefix_trie(spark, str(tmp_path)).select(*prefix_trie.NODE).collect()} == brute_trie(again)


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.Ranks.read(RANKS)
    return ranks, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=dict(zip(ranks.tokens, ranks.ids, strict=True)), special_tokens={})


def test_perfect_hash_is_minimal(library):
    h = library[0].hash
    assert sorted(h.key_at.tolist()) == list(range(h.n)) and h.find(library[0].tokens).tolist() == list(range(h.n))
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 50, 700):
        keys = list({rng.randbytes(rng.randint(0, 9)) for _ in range(n)})
        own = byte_bpe.PerfectHash(keys)
        assert own.find(keys).tolist() == list(range(len(keys))) and sorted(own.key_at.tolist()) == list(range(len(keys)))


def test_bpe_equals_the_library(library, monkeypatch):
    ranks, known = library
    codec = byte_bpe.ByteBpe(ranks, PATTERN)
    rng = random.Random(4)
    letters = "ab 'sdn\n\t  ,.1é日 \x1c\x85’\U0001f600 "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["", " ", "  ", "word " * 300, "x" * 20_000 + "ab" * 9_000, "日本" * 4000, " lead", "trail ", "a  b   c\n\n d", "don't we'll", "<|endoftext|>"]
    texts += [f"a{chr(c)}{chr(c)} {chr(c)}b  {chr(c)} 1{chr(c)}'{chr(c)}s" for c in range(0, 0x3000)]
    got = codec.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == known.encode_ordinary_batch(texts)
    assert [codec.decode(x) for x in got] == [t.encode() for t in texts]
    assert codec.found and codec.merged
    monkeypatch.setattr(byte_bpe, "CACHE", 20)  # generations come and go, results stay
    small = byte_bpe.ByteBpe(ranks, PATTERN)
    assert small.encode(texts[:2000]) == got[:2000] and max(map(len, small.pre)) < 5000
    assert not any(len(p) > byte_bpe.SHORT for held in (*codec.pre, *codec.words) for p in held)


def test_bpe_rows_with_nulls_and_clashing_names(spark, library):
    rows = [(1, None, "x", 7), (1, "", None, None), (None, "ab  c", "y", 1), (2, "Ünï 日", "z", 2), (2, "Ünï 日", "z", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids string, n_tokens int")
    coded = byte_bpe.encode_texts(docs, RANKS, PATTERN, decoded=True)
    assert coded.columns == ["doc_id", "text", "n_tokens", "token_ids", "decoded_bytes"]
    for r in coded.collect():
        ids = np.frombuffer(r.token_ids, "<u4").tolist()
        assert ids == library[1].encode_ordinary(r.text or "") and r.n_tokens == len(ids) and bytes(r.decoded_bytes) == (r.text or "").encode()
    back = byte_bpe.decode_ids(coded.withColumn("token_ids", F.when(F.col("doc_id") == 2, F.col("token_ids"))), RANKS)
    assert Counter(None if r.decoded_bytes is None else bytes(r.decoded_bytes).decode() for r in back.collect()) == {None: 3, "Ünï 日": 2}
    assert byte_bpe.encode_texts(docs.limit(0), RANKS, PATTERN).collect() == []
    with pytest.raises(ValueError, match="no token"):
        byte_bpe.Ranks({b"a": 0})


def test_bpe_query_equals_the_library_on_a_table(spark, library, tmp_path):
    rng = random.Random(9)
    rows = [(i, None if i % 9 == 0 else " ".join(rng.choice(["thing", "nichtig", "ou", "Été,", "ab\ncd", "", "42"]) for _ in range(rng.randint(0, 80)))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t in rows:
        ids = library[1].encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op12_byte_bpe(spark, str(tmp_path)).collect()} == want


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(n):
    near = {a: [b for b in n if one_edit(a, b)] for a in n}
    form = {}
    for a, others in near.items():
        best = min(others, key=lambda b: (-n[b], b.encode()), default=None)
        form[a] = best if best is not None and n[best] >= 2 * n[a] else None
    out = set()
    for a in n:
        root = a
        while form[root] is not None:
            root = form[root]
        out.add((a, form[a], root, n[a], len(near[a]), n.get(form[a])))
    return out


def test_variants_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(6)
    for letters, size, chunk in (("ab", 300, 2000), ("abcdé", 500, 3), ("aüz", 400, 2000)):
        monkeypatch.setattr(spelling, "CHUNK", chunk)  # hot keys are cut
        words = {"".join(rng.choice(letters) for _ in range(rng.choice([4, 5, 5, 6, 7, 12]))) for _ in range(size)}
        n = {w: rng.choice([1, 2, 3, 4, 6, 8, 8, 16, 70]) for w in words}
        got = spelling.spelling_variants(spark.createDataFrame(list(n.items()), "word string, n long"))
        rows = [tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()]
        assert len(rows) == len(n) and set(rows) == brute_variants(n)


def test_variants_of_odd_rows(spark):
    rows = [("colour", 4, "x"), ("colour", 2, "y"), ("color", 3, None), (None, 9, "z"), ("abc", 5, "z"), ("colours", None, "q"), ("", 1, "")]
    got = spelling.spelling_variants(spark.createDataFrame(rows, "word string, n long, root string"))
    assert {tuple(r) for r in got.collect()} == {("colour", None, "colour", 6, 2, None), ("color", "colour", "colour", 3, 1, 6), ("colours", "colour", "colour", 0, 1, 6)}
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long")).collect() == []


def test_pivots_are_the_rarest_disjoint_pair():
    rng = random.Random(8)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randint(3, 7)))
        weights = [rng.randint(0, 9) for _ in range(12)]
        a, b = spelling.pivots([(p, p) for p in places], weights)
        assert b - a >= 2 and weights[a] + weights[b] == min(weights[x] + weights[y] for x in places for y in places if y - x >= 2)


def test_words_are_counted_with_their_typing_errors(spark, tmp_path):
    rng = random.Random(10)
    words = ["Thing", "thing", "straße", "ÉTÉS", "ÉtÉs", "naïve×ly", "don't", "mañana", "abcde", "ABCDE"]
    rows = [(i if i % 7 else None, " ".join(rng.choice(words) for _ in range(40)) + rng.choice([".", "\n日本abcde", "_x1thing"])) for i in range(120)] + [(5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1))
    want = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            want[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    n = {w: k for w, k in want.items() if k >= 3 and len(w) >= 5}
    assert {r.word: r.n for r in spelling.count_words(docs).collect()} == n
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in queries.op13_spelling(spark, str(tmp_path)).collect()} == brute_variants(n)
    assert spelling.count_words(docs.limit(0)).collect() == []
