"""The prefix trie of conversations, from padded matrices of turn ids.

Spark deals the conversations to shards by ranges of their sequences of turns, equal ones
by ranges of their ids: a group of copies, however large, takes as many shards as it
fills. In a shard the sequences are a padded matrix, a few turns wide; numpy's lexsort
sorts its rows; a mask says where a turn differs from the one above, and accumulated by
OR along the row, where a node of each depth begins; ``reduceat`` sums up a node's rows.
Rows that have more turns go on in a next matrix, sorted behind the node they came from,
so that padding is never wider than the matrix.

Only nodes on the path of a shard's first or last row can have rows in other shards. They
stay open; all others are finished in the shard. Open nodes of neighbouring shards are
then recombined, 64 shards at a time, until all are closed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from camwatch.llm.common import table

#: Turns of a matrix, and shards that are recombined at a time.
WIDTH, FAN = 8, 64
#: Turns of a shard up to FEW shards; beyond that, shards grow up to MOST turns before there are more of them.
LEAST, FEW, MOST = 1 << 14, 512, 1 << 20
#: Ids of a piece of a node's list of ends.
PIECE = 4096
PAD = -1  # smaller than any turn id: a sequence sorts before those that it begins

EMPTY = hashlib.sha256(b"").hexdigest()
SCHEMA = (
    "open boolean, shard long, key string, parent_key string, first boolean, last boolean, chars long, pieces array<string>, "
    "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)
KINDS = pa.schema(
    [("open", pa.bool_()), ("shard", pa.int64()), ("key", pa.string()), ("parent_key", pa.string()), ("first", pa.bool_()), ("last", pa.bool_()), ("chars", pa.int64()), ("pieces", pa.list_(pa.string()))]
    + [(c, pa.int64()) for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string())]
)
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_sequences(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns: of each conversation its turns in order, as array<struct<a, b, chars>>.

    a and b identify role and text (63 bits each of two hashes), chars counts the text's
    code points. Null roles and texts are empty; null turns come first; of turns with
    equal numbers the one with the smaller hash comes first; rows that repeat are turns
    that repeat. Rows without an id are left out; other columns are ignored.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, role_col))
    long = lambda seed: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.length(role), role, text), 1)
    turn = F.struct(F.col(turn_col).cast("long").alias("turn"), long(1).alias("a"), long(2).alias("b"), F.length(text).cast("long").alias("chars"))
    held = turns.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("t"))
    return held.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda t: t.dropFields("turn")).alias("turns"))


class Level:
    """The nodes of one depth, in order."""

    def __init__(self, parent: np.ndarray, conv: np.ndarray, n: np.ndarray, chars: np.ndarray):
        self.parent, self.conv, self.n, self.chars = parent, conv, n, chars
        self.children, self.leaves, self.saved = (np.zeros(len(n), np.int64) for _ in range(3))
        self.ends: dict[int, np.ndarray] = {}


def levels_of(conv: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, chars: np.ndarray) -> list[Level]:
    """All nodes of a shard by depth."""
    rows, depth = np.arange(len(conv)), 0
    group = np.zeros(len(conv), np.int64)  # the node of each row at this depth
    zero = np.zeros(1, np.int64)
    levels = [Level(zero, conv.min(keepdims=True), np.array([len(conv)]), zero)]

    def note_ends(level: Level, node: np.ndarray, ids: np.ndarray) -> None:
        """``node`` ascends; the ids of a node ascend."""
        if len(node):
            cuts = np.flatnonzero(node[1:] != node[:-1]) + 1
            level.ends = {int(x[0]): y for x, y in zip(np.split(node, cuts), np.split(ids, cuts), strict=True)}

    at_root = np.sort(conv[size == 0])
    note_ends(levels[0], np.zeros(len(at_root), np.int64), at_root)
    here = size > 0
    rows, group = rows[here], group[here]
    while len(rows):
        has = np.arange(WIDTH) < (size[rows] - depth)[:, None]
        place = ((start[rows] + depth)[:, None] + np.arange(WIDTH))[has]
        matrix = np.full((len(rows), 2 * WIDTH), PAD, np.int64)
        matrix[:, 0::2][has], matrix[:, 1::2][has] = a[place], b[place]
        order = np.lexsort((conv[rows], *matrix.T[::-1], group))
        matrix, rows, group, has = matrix[order], rows[order], group[order], has[order]
        changed = np.ones((len(rows), WIDTH), bool)
        differs = matrix[1:] != matrix[:-1]
        changed[1:] = differs[:, 0::2] | differs[:, 1::2]
        changed[1:, 0] |= group[1:] != group[:-1]
        np.logical_or.accumulate(changed, axis=1, out=changed)
        for j in range(WIDTH):
            at = np.flatnonzero(has[:, j])
            if not len(at):
                break
            begins = np.flatnonzero(changed[at, j])
            node, top = np.cumsum(changed[at, j]) - 1, rows[at[begins]]
            level = Level(group[at[begins]], np.minimum.reduceat(conv[rows[at]], begins), np.diff(np.append(begins, len(at))), chars[start[top] + depth + j])
            ending = size[rows[at]] == depth + j + 1
            note_ends(level, node[ending], conv[rows[at[ending]]])
            levels.append(level)
            group = np.full(len(rows), -1)
            group[at] = node
        more = size[rows] > depth + WIDTH
        rows, group, depth = rows[more], group[more], depth + WIDTH
    return levels


def edge(levels: list[Level], last: bool) -> list[int]:
    """The nodes, by depth, on the path of the first or last row: rows that end at a node come before those that go on."""
    path = [0]
    while len(path) < len(levels):
        parents, node = levels[len(path)].parent, path[-1]
        k = int(np.searchsorted(parents, node, "right" if last else "left")) - last
        if not 0 <= k < len(parents) or parents[k] != node or (not last and node in levels[len(path) - 1].ends):
            break
        path.append(k)
    return path


def keys_of(path_turns: np.ndarray) -> list[str]:
    """A key for each prefix of a path; ``path_turns`` has a and b of each turn."""
    h = hashlib.blake2b(digest_size=16)
    keys = [h.hexdigest()]
    for turn in path_turns:
        h.update(turn.tobytes())
        keys.append(h.copy().hexdigest())
    return keys


def joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def shard_nodes(shard: int, conv: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray, chars: np.ndarray) -> Iterator[dict]:
    """A shard's nodes as columns: those it finishes, depth by depth, then the open ones from the root down."""
    start, size = offsets[:-1], np.diff(offsets)
    levels = levels_of(conv, start, size, a, b, chars)
    paths = {True: edge(levels, True), False: edge(levels, False)}
    # the rows at both edges, to name their prefixes
    named = {}
    for last, path in paths.items():
        i = int(np.flatnonzero(conv == levels[len(path) - 1].ends[path[-1]][-1 if last else 0])[0])
        turns = np.stack((a[start[i] : start[i] + size[i]], b[start[i] : start[i] + size[i]]), axis=1)
        named[last] = keys_of(turns[: len(paths[last]) - 1])
    for d in range(len(levels) - 1, -1, -1):
        level = levels[d]
        open_at = {p[d] for p in paths.values() if d < len(p)}
        closed = np.ones(len(level.n), bool)
        closed[list(open_at)] = False
        level.leaves[closed & (level.children == 0)] = 1
        level.saved[closed] += ((level.n - 1) * level.chars)[closed]
        if d:
            up, parent = levels[d - 1], level.parent[closed]
            up.children += np.bincount(parent, minlength=len(up.n))
            np.add.at(up.leaves, parent, level.leaves[closed])
            np.add.at(up.saved, parent, level.saved[closed])
            over = {p[d - 1]: named[last][d - 1] for last, p in paths.items() if d - 1 < len(p)}
            at = np.flatnonzero(closed)
            keys = [over.get(k) for k in level.parent[at].tolist()]
            yield {
                "open": False, "shard": shard, "parent_key": keys, "depth": d, "conv_id": level.conv[at],
                "parent_conv_id": pa.array(up.conv[level.parent[at]], mask=np.array([k is not None for k in keys], bool)), "n_convs": level.n[at],
                "n_children": level.children[at], "n_leaves": level.leaves[at], "saved_tokens": level.saved[at],
                "ends_sha256": [hashlib.sha256(joined(level.ends[k]).encode()).hexdigest() if k in level.ends else EMPTY for k in at.tolist()],
            }
    for d in range(len(levels)):
        level = levels[d]
        for k in sorted({p[d] for p in paths.values() if d < len(p)}):
            on = {last: d < len(p) and p[d] == k for last, p in paths.items()}
            names, ids = named[not on[False]], level.ends.get(k, ())
            yield {
                "open": True, "shard": shard, "key": names[d : d + 1], "parent_key": [names[d - 1] if d else None], "first": on[False], "last": on[True], "chars": level.chars[k : k + 1],
                "pieces": [[joined(ids[low : low + PIECE]) for low in range(0, len(ids), PIECE)]], "depth": d, "conv_id": level.conv[k : k + 1], "n_convs": level.n[k : k + 1],
                "n_children": level.children[k : k + 1], "n_leaves": level.leaves[k : k + 1], "saved_tokens": level.saved[k : k + 1],
            }


class Node:
    """An open node while shards are recombined."""

    __slots__ = ("chars", "children", "conv", "depth", "first", "key", "last", "leaves", "n", "parent_key", "saved")

    def __init__(self, r):
        self.key, self.parent_key, self.depth, self.first, self.last, self.chars = r.key, r.parent_key, r.depth, r.first, r.last, r.chars
        self.conv, self.n, self.children, self.leaves, self.saved = r.conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens


def recombine(shards: list[list[Node]], close_all: bool) -> tuple[list[Node], list[Node]]:
    """Nodes that neighbouring shards in order close, and those that stay open; a shard's nodes come from the root down."""
    held: dict[str, Node] = {}
    path: dict[str, Node] = {}  # of the last row so far
    for k, nodes in enumerate(shards):
        ahead: dict[str, Node] = {}
        for node in nodes:
            goes_on = node.last
            if node.first and (mate := path.get(node.key)):
                mate.n += node.n
                mate.conv = min(mate.conv, node.conv)
                mate.children += node.children
                mate.leaves += node.leaves
                mate.saved += node.saved
                node = mate
            else:
                node.first = node.first and k == 0
                held[node.key] = node
            if goes_on:
                ahead[node.key] = node
        path = ahead
    closed = []
    for node in reversed(held.values()):  # children come after their parents
        node.last = node.key in path
        if close_all or not (node.first or node.last):
            node.leaves = node.leaves if node.children else 1
            node.saved += (node.n - 1) * node.chars
            closed.append(node)
            if up := held.get(node.parent_key):
                up.children += 1
                up.leaves += node.leaves
                up.saved += node.saved
    done = set(map(id, closed))
    return closed, [x for x in held.values() if id(x) not in done]


def _round(open_nodes: DataFrame, close_all: bool) -> DataFrame:
    """One round of recombination, FAN neighbouring shards a group."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.astype({"parent_key": object}).where(rows.notna(), None).sort_values(["shard", "depth"], kind="stable")
        shards = [[Node(r) for r in part.itertuples()] for _, part in rows.groupby("shard", sort=True)]
        closed, still = recombine(shards, close_all)
        out = [(bool(still_open), int(rows["shard"].iloc[0]) // FAN, x.key, x.parent_key, bool(x.first), bool(x.last), x.chars, x.depth, x.conv, x.n, x.children, x.leaves, x.saved) for still_open, nodes in ((True, still), (False, closed)) for x in nodes]
        return pd.DataFrame(out, columns=[f.split()[0] for f in OPEN.split(", ")])

    rows = open_nodes.select(*(f.split()[0] for f in OPEN.split(", ")))
    return rows.groupBy(F.expr(f"shard div {FAN}")).applyInPandas(work, OPEN)


OPEN = "open boolean, shard long, key string, parent_key string, first boolean, last boolean, chars long, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _hashed_ends(pieces: DataFrame) -> DataFrame:
    """key, ends_sha256: of each open node the hash over its pieces by shard and place, read one after the other."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h, found = None, None, []
        for batch in batches:
            for k, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != key:
                    found += [] if h is None else [(key, h.hexdigest())]
                    key, h = k, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(piece.as_py().encode())
        found += [] if h is None else [(key, h.hexdigest())]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], names=["key", "ends_sha256"])

    order = ["key", "shard", "place"]
    return pieces.repartition("key").sortWithinPartitions(*order).select("key", "piece").mapInArrow(work, "key string, ends_sha256 string")


def prefix_trie(sequences: DataFrame, least: int = LEAST) -> DataFrame:
    """The nodes of the trie of all sequences: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``sequences`` has conv_id (distinct, not null) and turns as ``turn_sequences`` makes
    them; null or empty turns end at the root. A node's conv_id is its smallest member;
    n_leaves counts the childless nodes of its subtree; saved_tokens sums up, over the
    subtree, the code points of a node's last text for each member but one; ends_sha256
    hashes the ids that end there. No sequences give no nodes. A sequence is one row
    and a shard's rows are one task's, so memory grows with a shard (``least`` turns
    or more, see above) and the longest conversation. A node's hash is one stream over
    its ids by nature: it takes constant memory and one task where shards meet.
    """
    held = table(sequences.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("turns", F.array().cast(sequences.schema["turns"].dataType)).alias("turns")), "sequences")
    turns = held.agg(F.sum(F.size("turns") + 1)).first()[0]
    n = 1 if turns is None else max(min(-(-turns // least), FEW), -(-turns // MOST))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got).combine_chunks()
        del got
        lists = rows.column("turns").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat = lists.flatten()
        sizes = np.diff(lists.offsets.to_numpy())
        fields = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(3)]
        for columns in shard_nodes(rows.column("shard")[0].as_py(), rows.column("conv_id").to_numpy(), np.append(0, np.cumsum(sizes)), *fields):
            size = len(columns["conv_id"])
            if size:
                whole = {c: [x] * size if isinstance(x, (bool, int)) else x for c, x in columns.items()}
                yield pa.RecordBatch.from_arrays([pa.array(whole[f.name], f.type) if f.name in whole else pa.nulls(size, f.type) for f in KINDS], schema=KINDS)

    dealt = held.repartitionByRange(n, "turns", "conv_id").select("conv_id", "turns", F.spark_partition_id().cast("long").alias("shard"))
    nodes = table(dealt.mapInArrow(work, SCHEMA), "nodes")
    still = nodes.filter("open")
    left = (still.agg(F.max("shard")).first()[0] or 0) + 1
    done: DataFrame | None = None
    while done is None or left > 1:
        rounds = table(_round(still, left <= FAN), "round")
        closed = rounds.filter("not open")
        done = closed if done is None else done.unionByName(closed)
        still, left = rounds.filter("open"), -(-left // FAN)
    ends = _hashed_ends(nodes.filter("open").select("key", "shard", F.posexplode("pieces").alias("place", "piece")))
    done = table(done.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))), "closed")
    parents = done.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("over"))
    finished = nodes.filter("not open")
    under_open = finished.filter("parent_key is not null").drop("parent_conv_id").unionByName(done, allowMissingColumns=True)
    below = under_open.join(parents, "parent_key", "left").withColumn("parent_conv_id", F.col("over"))
    return finished.filter("parent_key is null").select(*NODE).unionByName(below.select(*NODE))
