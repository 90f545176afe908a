"""License scans: exact phrases by word, and fuzzy search of short notices.

Texts of a batch are normalised together, a byte for each character: A-Z lower-cased,
every run of other characters than words one space. Letters beyond ASCII that phrases
or notices hold have bytes of their own, all others share one, which matches nothing;
so an error is a character, whatever its bytes. A notice with at most ``k`` errors keeps at least
one of ``k + 1`` disjoint pieces whole (pigeonhole), so an automaton over all pieces
finds every candidate; the regex library's bounded-error matching then verifies it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (phrase, label), matched exactly. Fixed values.
BASE: tuple[tuple[str, str], ...] = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: (notice, label), matched with up to one error for every ``per_error`` characters. Fixed values.
NOTICES: tuple[tuple[str, str], ...] = (
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("creative commons attribution", "cc-by"),
    ("creative commons zero", "cc0"),
    ("dedicated to the public domain", "public-domain"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("all rights reserved", "reserved"),
    ("gnu free documentation license", "gfdl"),
    ("boost software license version 1 0", "bsl-1.0"),
    ("eclipse public license version 2 0", "epl-2.0"),
    ("common development and distribution license", "cddl"),
    ("artistic license version 2 0", "artistic-2.0"),
    ("academic free license version 3 0", "afl-3.0"),
    ("sil open font license version 1 1", "ofl-1.1"),
    ("open database license", "odbl"),
    ("python software foundation license", "psf"),
    ("european union public licence", "eupl"),
    ("microsoft public license", "ms-pl"),
    ("distributed under the isc license", "isc"),
    ("released under the zlib license", "zlib"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("the origin of this software must not be misrepresented", "zlib"),
)
#: Errors that the regex library is asked to allow at most, and characters for each.
MOST_ERRORS, PER_ERROR = 3, 9

#: The byte of all letters beyond ASCII that no phrase and no notice holds.
OTHER = 255


def folding(letters: set[str]) -> np.ndarray:
    """The byte of each code point: 0 for the zero that parts texts, 32 outside words, 128 and on for ``letters``."""
    fold = np.full(0x110000, OTHER, np.uint8)
    fold[:128] = 32
    fold[0] = 0
    fold[48:58] = np.arange(48, 58)
    fold[97:123] = fold[65:91] = np.arange(97, 123)
    if len(letters) >= OTHER - 128:
        raise ValueError(f"phrases and notices hold more than {OTHER - 129} letters beyond ASCII")
    for k, c in enumerate(sorted(letters)):
        fold[ord(c)] = 128 + k
    return fold


class NoticeSearch:
    """Compiled phrases and notices; ``scan`` works on the texts of one batch."""

    def __init__(self, base: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]]):
        self.fold = folding({c for p, _ in (*base, *notices) for c in p if ord(c) > 127})
        folded = lambda p: self.fold[[ord(c) for c in p]].tobytes()
        self.base = [(folded(p), label) for p, label in base]
        self.notices, self.seeds = [], ahocorasick.Automaton()
        held: dict[str, list[tuple[int, int]]] = {}
        for i, (notice, label) in enumerate((folded(p).decode("latin-1"), label) for p, label in notices):
            k = min(MOST_ERRORS, len(notice) // PER_ERROR)
            self.notices.append((regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={k}}}"), len(notice), k, label))
            cuts = [round(j * len(notice) / (k + 1)) for j in range(k + 2)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                held.setdefault(notice[lo:hi], []).append((i, lo))
        for seed, where in held.items():
            self.seeds.add_word(seed, (len(seed), where))
        self.seeds.make_automaton()

    def scan(self, texts: list[str]) -> tuple[np.ndarray, list[tuple[int, int, str]], list[tuple[int, int, int, int, str, float]]]:
        """Word counts; base hits (text, word, label); notice spans (text, first word, words, errors, label, likeness).

        Zero bytes inside a text count as spaces, as any other character outside words.
        """
        n = len(texts)
        if not n:
            return np.zeros(0, np.int64), [], []
        raw = np.frombuffer(("\0".join(t.replace("\0", " ") for t in texts) + "\0").encode("utf-32-le"), "<u4")
        folded = self.fold[raw]
        word = folded > 32
        keep = word | (folded == 0)
        keep[1:] |= word[:-1]
        norm = folded[keep]  # one space after each word, and the zero bytes
        data = norm.tobytes()
        word = norm > 32
        starts = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
        ends = np.flatnonzero(norm == 0)
        before = np.concatenate(([0], np.searchsorted(starts, ends)))  # words before each text
        place = lambda at: (int(d := np.searchsorted(ends, at)), int(np.searchsorted(starts, at) - before[d]))
        exact = []
        for phrase, label in self.base:
            at = data.find(phrase)
            while at >= 0:
                end = at + len(phrase)
                if (at == 0 or data[at - 1] <= 32) and data[end] <= 32:
                    exact.append((*place(at), label))
                at = data.find(phrase, at + 1)
        fuzzy: dict[tuple[int, int, str], tuple[int, int, int, int, str, float]] = {}
        tried: set[tuple[int, int]] = set()
        latin = data.decode("latin-1")
        for last, (length, where) in self.seeds.iter(latin):
            first = last - length + 1
            for i, lo in where:
                if (i, first - lo) in tried:
                    continue
                tried.add((i, first - lo))
                pattern, size, k, label = self.notices[i]
                lo_at = max(latin.rfind("\0", 0, first) + 1, first - lo - k)
                hi_at = min(latin.find("\0", first), first - lo + size + k)
                if (m := pattern.search(latin, lo_at, hi_at)) and m.end() > m.start():
                    # a notice begins and ends with whole words, but for the errors allowed in them
                    at = m.start() + (latin[m.start()] == " ")
                    d, w = place(at if at == 0 or latin[at - 1] <= " " else starts[np.searchsorted(starts, at) - 1])
                    errors = sum(m.fuzzy_counts)
                    hit = (d, w, len(m.group().split()), errors, label, 1 - errors / size)
                    if (old := fuzzy.get((d, w, label))) is None or hit[3] < old[3]:
                        fuzzy[d, w, label] = hit
        return np.diff(before), exact, sorted(fuzzy.values())


def scan_licenses(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    base: Sequence[tuple[str, str]] = BASE,
    notices: Sequence[tuple[str, str]] = NOTICES,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` lists the fuzzy matches: first word, number of words, errors, label.
    ``score`` is 1 with an exact phrase, else the best notice's share of characters
    without errors, else 0. Null and empty texts have no words, no labels (empty
    strings) and score 0; texts of any length are scanned whole. Repeated rows give
    repeated results; an empty table gives none; other columns are ignored.
    """
    kind = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first_word:long,words:long,errors:long,label:string>>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = NoticeSearch(base, notices)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lo = 0
            while lo < len(texts):  # at most some MB at once
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < 4_000_000):
                    size += len(texts[hi])
                    hi += 1
                yield digest(search, batch.column(0).slice(lo, hi - lo), texts[lo:hi])
                lo = hi

    def digest(search: NoticeSearch, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        words, exact, fuzzy = search.scan(texts)
        n = len(texts)
        places: list[list[int]] = [[] for _ in range(n)]
        own: list[set[str]] = [set() for _ in range(n)]
        more: list[set[str]] = [set() for _ in range(n)]
        spans: list[list[dict]] = [[] for _ in range(n)]
        score = [0.0] * n
        for d, w, label in exact:
            places[d].append(w)
            own[d].add(label)
            score[d] = 1.0
        for d, w, size, errors, label, like in fuzzy:
            more[d].add(label)
            spans[d].append({"first_word": w, "words": size, "errors": errors, "label": label})
            score[d] = max(score[d], like)
        return pa.RecordBatch.from_arrays(
            [
                ids, pa.array(words, pa.int64()), pa.array([len(x) for x in places], pa.int64()),
                pa.array([min(x, default=None) for x in places], pa.int64()), pa.array([max(x, default=None) for x in places], pa.int64()),
                pa.array([",".join(sorted(x)) for x in own], pa.string()), pa.array([",".join(sorted(x | y)) for x, y in zip(own, more, strict=True)], pa.string()),
                pa.array(score, pa.float64()), pa.array(spans, pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("errors", pa.int64()), ("label", pa.string())]))),
            ],
            names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
        )

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(scan, kind)
