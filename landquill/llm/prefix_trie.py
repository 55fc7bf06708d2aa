"""The prefix trie of conversations by a splitter skeleton.

A conversation is a path: one atom of fixed width for each turn (the MD5 of role and text, and the text's length in bytes), so that the order of
the bytes is the order of sequences. Paths are dealt by range of (path, conv_id) to sorted shards. A trie node can only lie in two shards
if it is a prefix of the splitter path between them; the trie of the splitters' prefixes is the skeleton. Every shard finishes all its other
nodes by itself and sends one partial row for each skeleton node it meets; those are reduced by node, then rolled up along the skeleton. A
first turn, or a whole conversation, that a third of all rows share is thus cut into as many shards as it fills.

Only the skeleton is broadcast and comes to the driver. Its size is bounded: at most ``MOST_SHARDS`` splitters, and ``SKELETON`` turns in all
(longer splitter paths are cut, which moves the borders of shards but no result). Splitters come from a sample of ``SAMPLE`` paths a shard;
the sample decides on the balance of the shards, on no result. The texts never leave their first task: only atoms are shuffled. A
conversation's atoms (20 bytes a turn) have to fit into a task, as a row does.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise

ATOM = 20  # bytes: 16 of the digest, 4 of the text's length
LEAST_ROWS, MOST_ROWS, MOST_SHARDS, SAMPLE = 500, 50_000, 1 << 16, 20
SKELETON = 1 << 22
_PIECE = 1 << 20  # bytes of a piece of a skeleton node's list of members
_EMPTY = hashlib.sha256(b"").digest()
_NODE = "conv_id long, depth int, parent_conv_id long, parent_skeleton int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, skeleton int, piece int"


def atoms(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, atom) of each row that has a conv_id; a null role or text counts as empty."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    atom = F.unhex(F.concat(digest, F.lpad(F.hex(F.octet_length(text)), 8, "0")))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), atom.alias("atom"))


def joined(list_of_atoms):
    """One binary of an array of atoms."""
    return F.unhex(F.array_join(F.transform(list_of_atoms, F.hex), ""))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path): each conversation's atoms in the order of its turns, null first; equal turns by the digest of role and text."""
    held = atoms(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "atom"))).alias("a"))
    return held.select("conv_id", joined(F.transform("a", lambda x: x["atom"])).alias("path"))


def rebuilt_paths(conversations: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """(conv_id, path) of conversations that share heads: of conversation c the first h turns of c - c % group, then its own after the first h.

    h is CRC-32 of the decimal id modulo heads. A conversation without its group's first one has no head; it can be left without turns. One
    shuffle, by the group's first id, serves both steps.
    """
    first = (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    dealt = atoms(conversations).select(first, "conv_id", "turn", "atom").repartition("base")
    held = dealt.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "atom"))).alias("a"))
    own = held.select("base", "conv_id", joined(F.transform("a", lambda x: x["atom"])).alias("own"))
    # at most 2 * group - 1 conversations a group
    near = own.groupBy("base").agg(F.max(F.when(F.col("base") == F.col("conv_id"), F.substring("own", 1, ATOM * (heads - 1)))).alias("head"), F.collect_list(F.struct("conv_id", "own")).alias("all"))
    each = near.select("head", F.explode("all").alias("c")).select("head", "c.*")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    tail = F.substring("own", (h * ATOM + 1).cast("int"), F.greatest(F.octet_length("own") - (h * ATOM), F.lit(0)).cast("int"))
    head = F.substring(F.coalesce("head", F.lit(b"")), F.lit(1), (h * ATOM).cast("int"))
    return each.select("conv_id", F.concat(head, tail).alias("path"))


class Skeleton:
    """The trie of the splitter paths: nodes numbered from the root, 0, by path."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.parent, self.depth, self.bytes = [-1], [0], [0]
        self.chains: list[list[int]] = []  # node of each prefix of each splitter
        children: dict[tuple[int, bytes], int] = {}
        for path, _ in splitters:
            chain = [0]
            for k in range(0, len(path), ATOM):
                key = (chain[-1], path[k : k + ATOM])
                node = children.get(key)
                if node is None:
                    node = children[key] = len(self.parent)
                    self.parent.append(chain[-1])
                    self.depth.append(k // ATOM + 1)
                    self.bytes.append(int.from_bytes(key[1][16:], "big"))
                chain.append(node)
            self.chains.append(chain)

    def around(self, shard: int) -> tuple[tuple[bytes, list[int]], tuple[bytes, list[int]]]:
        """(path, chain) of the splitters below and above a shard; the root alone where there is none."""
        return tuple((self.splitters[i][0], self.chains[i]) if 0 <= i < len(self.splitters) else (b"", [0]) for i in (shard - 1, shard))


def choose_splitters(rows: DataFrame) -> list[tuple[bytes, int]]:
    """Ascending (path, conv_id) that cut rows (conv_id, path) into shards: as many as four times their rows' square root, within bounds."""
    n = rows.count()
    each = min(max(LEAST_ROWS, 4 * math.isqrt(n)), MOST_ROWS)
    shards = min(MOST_SHARDS, -(-n // each))
    if shards < 2:
        return []
    cut = SKELETON // shards * ATOM
    sampled = F.pmod(F.xxhash64("conv_id"), F.lit(max(1, n // (shards * SAMPLE)))) == 0
    few = rows.where(sampled).select(F.substring("path", 1, cut).alias("path"), "conv_id").collect()
    if not few:
        return []
    keys = sorted((bytes(r["path"]), r["conv_id"]) for r in few)
    return sorted({keys[len(keys) * i // shards] for i in range(1, shards)})


def _dealt(splitters: list[tuple[bytes, int]]):
    """Adds the shard: how many splitters are at or below (path, conv_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)
            shard = pa.array([bisect_right(splitters, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, shard], [*batch.schema.names, "shard"])

    return run


def common(a: bytes, b: bytes) -> int:
    """Atoms that two paths have in common at their start."""
    n = min(len(a), len(b)) // ATOM * ATOM
    if a[:n] == b[:n]:
        return n // ATOM
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax()) // ATOM


def shard_nodes(path: list[bytes], ids: np.ndarray, low: tuple[bytes, list[int]], high: tuple[bytes, list[int]]) -> list[tuple[np.ndarray | list, ...]]:
    """Columns of _NODE for one shard: sorted paths with ascending ids, between the splitters low and high (path, chain of skeleton nodes).

    Nodes are found depth by depth: the rows of a node are neighbours, so that one pass over the rows that are deep enough gives its members,
    smallest id, parent and own saving; sums over subtrees follow from the deepest nodes up.
    """
    n = len(path)
    size = np.array([len(p) // ATOM for p in path])
    same = np.array([0] + [common(a, b) for a, b in zip(path[:-1], path[1:], strict=True)])
    # skeleton nodes of a row: prefixes that it shares with a splitter
    below, above = np.empty(n, np.int64), np.empty(n, np.int64)
    below[0], above[-1] = common(low[0], path[0]), common(high[0], path[-1])
    below[1:], above[:-1] = same[1:], same[1:]
    below = np.minimum.accumulate(below)
    above = np.minimum.accumulate(above[::-1])[::-1]
    at = np.zeros(n, np.int64)  # node of each row at the current depth
    node = {"row": [np.zeros(1, np.int64)], "depth": [np.zeros(1, np.int64)], "parent": [np.full(1, -1)], "n": [np.full(1, n)], "least": [np.full(1, ids.min())], "bytes": [np.zeros(1, np.int64)], "skeleton": [np.zeros(1, np.int64)]}
    total, rows, depth = 1, np.arange(n), 0
    ends: list[tuple[np.ndarray, np.ndarray]] = []  # (node, row) of the rows that end at each depth
    while True:
        done = size[rows] == depth
        ends.append((at[rows[done]], rows[done]))
        rows = rows[~done]
        if not len(rows):
            break
        depth += 1
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (same[rows[1:]] < depth) | (rows[1:] != rows[:-1] + 1)
        start = np.flatnonzero(fresh)
        first = rows[start]
        node["row"].append(first)
        node["depth"].append(np.full(len(start), depth))
        node["parent"].append(at[first])
        node["n"].append(np.diff(np.append(start, len(rows))))
        node["least"].append(np.minimum.reduceat(ids[rows], start))
        node["bytes"].append(np.array([int.from_bytes(path[r][depth * ATOM - 4 : depth * ATOM], "big") for r in first]))
        node["skeleton"].append(np.array([low[1][depth] if below[r] >= depth else high[1][depth] if above[r] >= depth else -1 for r in first]))
        at[rows] = total + np.cumsum(fresh) - 1
        total += len(start)
    c = {k: np.concatenate(v) for k, v in node.items()}
    parent, skeleton = c["parent"], c["skeleton"]
    whole = skeleton < 0
    children = np.bincount(parent[1:][whole[1:]], minlength=total)
    leaves = ((children == 0) & whole).astype(np.int64)
    saved = np.where(whole, (c["n"] - 1) * c["bytes"], 0)
    # from the deepest up, into parents; what a skeleton node has below it in this shard it gets from whole nodes only
    level = np.searchsorted(c["depth"], np.arange(depth + 2))
    for d in range(depth, 0, -1):
        mine = np.arange(level[d], level[d + 1])
        mine = mine[whole[mine]]
        np.add.at(leaves, parent[mine], leaves[mine])
        np.add.at(saved, parent[mine], saved[mine])
    lists: dict[int, list[bytes]] = {}
    end_node, end_row = (np.concatenate(x) for x in zip(*ends, strict=True))
    order = np.argsort(end_node, kind="stable")
    end_node, end_row = end_node[order], end_row[order]
    cuts = np.flatnonzero(np.diff(end_node, prepend=-1, append=total))
    text = [str(i).encode() for i in ids.tolist()]
    digest: list[bytes | None] = [None] * total
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        words = b",".join([text[r] for r in end_row[s:e]])
        if whole[end_node[s]]:
            digest[end_node[s]] = hashlib.sha256(words).digest()
        else:
            lists[int(end_node[s])] = [words[k : k + _PIECE] for k in range(0, len(words), _PIECE)]
    up = np.where(parent >= 0, parent, 0)
    known = whole & whole[up]
    part = {
        "conv_id": pa.array(c["least"]),
        "depth": pa.array(c["depth"].astype(np.int32)),
        "parent_conv_id": pa.array(c["least"][up], mask=~known),
        "parent_skeleton": pa.array(skeleton[up].astype(np.int32), mask=known | ~whole),
        "n_convs": pa.array(c["n"]),
        "n_children": pa.array(children),
        "n_leaves": pa.array(leaves),
        "saved_tokens": pa.array(saved),
        "ends": pa.array(digest, pa.binary()),
        "skeleton": pa.array(skeleton.astype(np.int32), mask=whole),
        "piece": pa.array(np.zeros(total, np.int32), mask=np.ones(total, bool)),
    }
    out = [pa.RecordBatch.from_arrays(list(part.values()), list(part))]
    for k, pieces in lists.items():
        for i, words in enumerate(pieces):
            none = {name: pa.nulls(1, column.type) for name, column in part.items()}
            row = none | {"ends": pa.array([words], pa.binary()), "skeleton": pa.array([int(skeleton[k])], pa.int32()), "piece": pa.array([i], pa.int32())}
            out.append(pa.RecordBatch.from_arrays(list(row.values()), list(row)))
    return out


def _finished(skeleton: Skeleton):
    """Nodes of the shards in a task; its rows are sorted by (shard, path, conv_id). The column shard goes along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, path, ids = -1, [], []

        def close() -> Iterator[pa.RecordBatch]:
            for batch in shard_nodes(path, np.array(ids, np.int64), *skeleton.around(now)) if path else []:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, now, np.int32))], [*batch.schema.names, "shard"])

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            for s, e in zip(*(lambda c: (c[:-1], c[1:]))(np.flatnonzero(np.diff(shards, prepend=-1, append=-1))), strict=True) if len(shards) else []:
                if shards[s] != now:
                    yield from close()
                    now, path, ids = int(shards[s]), [], []
                path += batch.column("path").slice(s, e - s).to_pylist()
                ids += batch.column("conv_id").slice(s, e - s).to_pylist()
        yield from close()

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(skeleton, ends): SHA-256 over each node's pieces, which come sorted by (skeleton, shard, piece); memory does not grow with them."""
    now, state, shard = None, None, None
    for batch in batches:
        for node, at, piece, words in zip(*(batch.column(c).to_pylist() for c in ("skeleton", "shard", "piece", "ends")), strict=True):
            if node != now:
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([state.digest()], pa.binary())], ["skeleton", "ends"])
                now, state, shard = node, hashlib.sha256(), at
            elif at != shard:
                state.update(b",")
                shard = at
            state.update(words)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([state.digest()], pa.binary())], ["skeleton", "ends"])


def roll_up(skeleton: Skeleton, partial: dict[int, tuple[int, ...]], ends: dict[int, bytes]) -> list[tuple]:
    """Rows of the skeleton's nodes that have members. partial: node -> (smallest id, members, whole children, leaves and saving of whole nodes below)."""
    rows = {k: list(v) for k, v in partial.items()}
    parent = skeleton.parent
    below = dict.fromkeys(rows, 0)
    for k in rows:
        if k:
            below[parent[k]] += 1
    out = []
    for k in sorted(rows, key=lambda k: -skeleton.depth[k]):
        least, n, children, leaves, saved = rows[k]
        children += below[k]
        leaves += not children
        saved += (n - 1) * skeleton.bytes[k]
        out.append((least, skeleton.depth[k], rows[parent[k]][0] if k else None, n, children, leaves, saved, ends.get(k), k))
        if k:
            rows[parent[k]][3] += leaves
            rows[parent[k]][4] += saved
    return out


def trie_nodes(rows: DataFrame) -> DataFrame:
    """One row for each node of the trie of rows (conv_id, path), ids unique and not null, paths of whole atoms:

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless nodes below it or itself),
    saved_tokens (summed over its subtree: (n_convs - 1) * bytes of the last text), ends_sha256 (of the ids that end there, ascending, with commas).
    The root holds all conversations, those without turns too; without any conversation there is no row. Equal (role, text) sequences are one node
    path. 32-bit lengths and 128-bit digests stand for the texts.
    """
    spark = rows.sparkSession
    rows = materialise(rows)
    splitters = choose_splitters(rows)
    skeleton = Skeleton(splitters)
    dealt = rows.mapInArrow(_dealt(splitters), "conv_id long, path binary, shard int")
    nodes = materialise(dealt.repartition("shard").sortWithinPartitions("shard", "path", "conv_id").mapInArrow(_finished(skeleton), _NODE + ", shard int"))
    met = nodes.where("skeleton is not null and piece is null")
    reduced = met.groupBy("skeleton").agg(F.min("conv_id"), F.sum("n_convs"), F.sum("n_children"), F.sum("n_leaves"), F.sum("saved_tokens"))
    partial = {r[0]: tuple(r)[1:] for r in reduced.collect()}  # the skeleton's size at most
    pieces = nodes.where("piece is not null").select("skeleton", "shard", "piece", "ends").repartition("skeleton").sortWithinPartitions("skeleton", "shard", "piece")
    ends = {r[0]: bytes(r[1]) for r in pieces.mapInArrow(_digests, "skeleton int, ends binary").collect()}  # likewise
    frame = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, skeleton int"
    bones = spark.createDataFrame(roll_up(skeleton, partial, ends), frame)
    above = bones.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("above"))
    whole = nodes.where("skeleton is null").join(F.broadcast(above), "parent_skeleton", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    out = whole.select(*columns).unionByName(bones.select(*columns))
    digest = F.lower(F.hex(F.coalesce("ends", F.lit(_EMPTY))))
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest.alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) rebuilt with shared heads; see rebuilt_paths and trie_nodes.

    Rows without a conv_id are left out. Turns are ordered with null first, rows of equal turn by the digest of role and text; repeated rows are
    turns of their own. A null role or text is empty. Other columns are ignored.
    """
    return trie_nodes(rebuilt_paths(conversations, group, heads))


def oracle_sql(group: int = 5, heads: int = 9) -> str:
    """DuckDB SQL for conversation_trie: every prefix of every rebuilt conversation, grouped."""
    return f"""with recursive bits as (select n, 0 as k, n::bigint as v from range(256) r(n) union all
  select n, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
crc as (select list(v order by n) as t from bits where k = 8),
said as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations where conv_id is not null),
own as (select conv_id, md5(length(role) || ':' || role || text) as a, strlen(text) as bytes, turn from said),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, a, lpad(printf('%X', bytes), 8, '0')) as i from own),
ids as (select conv_id, conv_id - conv_id % {group} as base, xor(list_reduce(list_prepend(4294967295, [ord(x)::bigint for x in regexp_extract_all(conv_id::varchar, '.')]), lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) % {heads} as h from (select distinct conv_id from said) u, crc),
turns as (select i.conv_id, p.i, p.a, p.bytes from ids i join placed p on p.conv_id = i.base and p.i <= i.h
  union all select i.conv_id, p.i + 1000000, p.a, p.bytes from ids i join placed p on p.conv_id = i.conv_id and p.i > i.h),
seq as (select conv_id, list(a order by i) as a, list(bytes order by i) as b from turns group by conv_id),
whole as (select i.conv_id, coalesce(a, []) as a, coalesce(b, []) as b from ids i left join seq using (conv_id)),
pre as (select conv_id, len(a) as size, unnest(range(0, len(a) + 1)) as depth, a, b from whole),
node as (select array_to_string(a[1:depth], '') as key, depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(any_value(b[depth]), 0) as bytes,
  sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where size = depth), '')) as ends_sha256 from pre group by 1, 2),
kids as (select substr(key, 1, (32 * (depth - 1))::bigint) as key, depth - 1 as depth, count(*) as n from node where depth > 0 group by 1, 2),
full_ as (select node.*, coalesce(kids.n, 0) as n_children, (n_convs - 1) * bytes as own from node left join kids using (key, depth)),
up as (select substr(key, 1, (32 * d)::bigint) as key, d as depth, own, n_children from (select *, unnest(range(0, depth + 1)) as d from full_)),
sums as (select key, depth, sum(own)::bigint as saved_tokens, count(*) filter (where n_children = 0) as n_leaves from up group by 1, 2)
select f.conv_id, f.depth::bigint as depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
from full_ f join sums s using (key, depth) left join node p on p.depth = f.depth - 1 and p.key = substr(f.key, 1, (32 * (f.depth - 1))::bigint)"""
