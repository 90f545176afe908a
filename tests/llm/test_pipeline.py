"""The pipeline's stages on small documents, and the queries' SQL."""

import itertools
import random
import re
import zlib

import duckdb
import public_tokenizers
import pytest

import corpus_pipeline
from camwatch.llm import unigram
from camwatch.llm.common import shared_dir
from camwatch.llm.queries import ORACLE_SQL, QUERIES
from camwatch.llm.toxicity import fit_on, score_texts

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("" if x != x or x is None else str(x).removesuffix(".0") for x in r) for r in frame.astype(object).where(frame.notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(c.sql(ORACLE_SQL[name]).df())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, SF).cache()
        assert at.columns == docs.columns, name
    kept = at.collect()
    last = corpus_pipeline.STAGES[-1][1](spark, at, SF).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in kept} and all(r.round_trip for r in last)
    assert 0.7 * len(before) < len(kept) < len(before)
    assert all(set(r.text.split("\n")) <= set(before[r.doc_id].split("\n")) for r in kept)
    words = lambda t: (t or "").replace("\n", " ").strip(" ")
    assert all(words(r.text) or not words(before[r.doc_id]) for r in kept)  # none has lost all its words
    assert all(len(r.piece_ids) == 4 * r.n_pieces for r in last)


CAT = " ".join(f"cat{k}" for k in range(12))
MANY = [" ".join(f"w{n}x{k}" for k in range(30)) for n in range(9)]


def small_corpus():
    """Toxic, repeated, near-copied and contaminated documents, with nulls, empty and repeated ones."""
    rng = random.Random(1)
    near = MANY[0].split(" ")
    near[15] = "other"  # one word of 30: lines stay apart at 80 %, documents too by shingles of five (21 of 31)
    tail = lambda n: "\n".join(" ".join(f"d{n}l{j}k{k}" for k in range(60)) for j in range(4))
    words = tail(1).replace("\n", " ").split(" ")
    broken = "\n".join(" ".join(words[max(0, k) : k + 60]) for k in range(-30, 240, 60))  # other lines, the same shingles
    texts = [MANY[0], MANY[1] + "\n" + MANY[2], "You are a stupid idiot, I will kill you.", MANY[0], " ".join(near), None, "", "  \n", tail(1) + "\nend one two", broken + "\nother end here now", tail(2), tail(2) + " tail", f"before it {CAT} and after", "a line\na line\nb", *MANY[3:], MANY[2] + "\n" + MANY[3]]
    texts += [" ".join(rng.choice(MANY[rng.randrange(9)].split(" ")) for _ in range(40)) for _ in range(10)]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def grams(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_line_dedup(docs):
    earlier, out = [], []
    for r in docs:
        if r[1] is None:
            out.append(r)
            continue
        keep, had = [], False
        for line in r[1].split("\n"):
            w = frozenset(line.lower().split(" ")) - {""}
            had |= bool(w)
            if not w or not any(100 * len(w & s) >= 80 * len(w | s) for s in earlier):
                keep.append(line)
            if w:
                earlier.append(w)
        t = "\n".join(keep)
        if not (had and not t.strip(" \n")):
            out.append((r[0], t, *r[2:]))
    return out


def brute_first_of_classes(docs):
    sets = {r[0]: grams(r[1], 5) for r in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [r for r in docs if find(r[0]) == r[0]]


def brute_decontaminated(docs, items):
    sets = [grams(t, min(5, len(t.split()))) for t in items]
    n = [min(5, len(t.split())) for t in items]
    return [r for r in docs if not any(5 * len(s & grams(r[1], k)) >= 4 * len(s) and len(re.findall(r"\S+", r[1] or "")) >= k for s, k in zip(sets, n))]


def test_stages_and_the_whole_against_brute_force(spark, tmp_path):
    """Each stage on what the one before it really kept, and run() from the tables to the ids."""
    docs, items = small_corpus(), [CAT, "short item"]
    table = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    table(docs, "doc_id long, text string, lang string, source string, n_chars long", "documents")
    table(list(enumerate(items)), "item_id long, text string", "benchmark")
    table([(2, 0, 1), *((i, 1, 0) for i in range(14, 24))], "doc_id long, quality int, toxic int", "labels")
    sf, order = str(tmp_path), lambda df: sorted((tuple(r)[:5] for r in df.collect()), key=lambda r: r[0])
    read = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    scored = {r.doc_id: r.score for r in score_texts(read, fit_on(read, spark.read.parquet(f"{sf}/labels.parquet"))).collect()}
    at = order(stages["toxicity"](spark, read, sf))
    assert at == [r for r in docs if scored[r[0]] < corpus_pipeline.TOXIC] and {r[0] for r in docs} - {r[0] for r in at} == {2}
    for name, brute in (("line_dedup", brute_line_dedup), ("ngram_jaccard", brute_first_of_classes), ("decontamination", lambda d: brute_decontaminated(d, items))):
        got = order(stages[name](spark, spark.createDataFrame(at, read.schema), sf))
        assert got == brute(at) and len(got) < len(at), name
        at = got
    result = corpus_pipeline.run(spark, sf)
    assert order(result) == at
    model = unigram.Unigram(unigram.load_vocabulary(public_tokenizers.path("piece_bpe_32k.model")))
    ids = {r[0]: model.encode([r[1] or ""])[0] for r in at}
    assert {r.doc_id: (bytes(r.piece_ids), r.n_pieces, r.ids_crc32, r.round_trip) for r in result.collect()} == {i: (x, len(x) // 4, zlib.crc32(x), True) for i, x in ids.items()}


def test_stages_of_nothing_and_of_nulls(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for rows in ([], [(None, None, None, None, None), (None, "some words", None, None, None), (3, None, "en", None, None)]):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, spark.createDataFrame(rows, schema), SF)
            assert got.count() == len(rows), name


def test_run_leaves_only_its_result(spark, tmp_path):
    """Stage tables and what stages wrote on the way are gone when run() returns."""
    import os

    folder = shared_dir(spark).removeprefix("file://") + "/camwatch"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = corpus_pipeline.run(spark, SF)
    left = set(os.listdir(folder)) - before
    assert len(left) <= 2 and out.count() > 0, left
    before = set(os.listdir(folder))
    for name in ("op3_ngram_jaccard", "op6_line_dedup", "op8_decontamination", "op9_url_filter", "op11_prefix_trie", "op13_spelling"):
        QUERIES[name](spark, SF)
        left = set(os.listdir(folder)) - before
        assert len(left) == 1, (name, left)
        before |= left
