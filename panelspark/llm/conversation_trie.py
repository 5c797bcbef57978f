"""Operator 11: prefix trie of conversations in double arrays, one for each prefix shard.

Turns get places by a range sort, and every prefix gets a code that adds up along the conversation (a sum of turn codes times powers), so places and codes
of one long conversation are found in many tasks: each counts and sums its own stretch, and what precedes it is added afterwards.

A node has as many rows below it as its members have turns from it on. Nodes with more rows than a shard holds are upper nodes; the others lie in complete
subtrees, each with a topmost node. Subtrees are dealt to shards, and a shard packs all of its own into one double array: the child of a state
over turn id ``t`` is at ``BASE[state] + t``, and ``CHECK`` there holds the state. Its turn ids are dense. Walking the conversations through the arrays
gives the nodes with all their figures. The upper nodes are summed over all shards: members by their code, subtree figures by doubling the distance to
the ancestor that gets them, so even a chain of upper nodes takes few rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import record_batch, texts, values
from panelspark.session import discard, materialize

#: Conversations whose first turns come from the same one.
FAMILY = 100
#: A conversation takes fewer first turns than this from the head of its family.
HEADS = 6
#: Turns of a shard, on average; a subtree with more is cut.
SHARD_TURNS = 50_000

_PRIME = 2 ** 127 - 1
_BASE = 0x2545F4914F6CDD1D9E3779B97F4A7C15 % _PRIME
_ROOT = bytes(16)
_EMPTY = hashlib.sha256(b"").hexdigest()


def _bytes(code: int) -> bytes:
    return code.to_bytes(16, "big")


def _int(code: bytes) -> int:
    return int.from_bytes(code, "big")


def turn_code(role: bytes, text: bytes) -> int:
    """Code of a turn, never zero."""
    return 1 + xxhash.xxh3_128_intdigest(len(role).to_bytes(8, "big") + role + text) % (_PRIME - 1)


_RANKED = pa.schema([("c", pa.int64()), ("part", pa.int64()), ("nth", pa.int64()), ("sum", pa.binary()), ("code", pa.binary()), ("chars", pa.int64())])


def _ranked(conversations: DataFrame) -> DataFrame:
    """Turns in order, with their place and the sum of codes within the stretch of the conversation that one task has."""
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ordered = turns.repartitionByRange(*order, "tie").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, nth, total, power = TaskContext.get().partitionId(), None, 0, 0, 1
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _RANKED}
            for c, role, text, chars in zip(values(batch, "c"), texts(batch, "role"), texts(batch), values(batch, "chars"), strict=True):
                if c != current:
                    current, nth, total, power = c, 0, 0, 1
                code = turn_code(role, text)
                total = (total + code * power) % _PRIME
                for name, value in zip(out, (c, part, nth, _bytes(total), _bytes(code), chars), strict=True):
                    out[name].append(value)
                nth, power = nth + 1, power * _BASE % _PRIME
            yield record_batch(_RANKED, out)

    return ordered.select("c", "role", "text", F.length("text").cast("long").alias("chars")).mapInArrow(run, "c long, part long, nth long, sum binary, code binary, chars long")


def _before(ranked: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """Turns, and sum of their codes, before a stretch that continues a conversation of an earlier task: two entries for each task at most."""
    ends = ranked.groupBy("c", "part").agg((F.max("nth") + 1).alias("n"), F.max_by("sum", "nth").alias("sum"))
    split = ends.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("part", "n", "sum"))).alias("parts")).where(F.size("parts") > 1)
    out = {}
    for r in split.collect():
        n = total = 0
        for part in r.parts:
            out[r.c, part.part] = (n, total)
            total = (total + _int(part.sum) * pow(_BASE, n, _PRIME)) % _PRIME
            n += part.n
    return out


_PLACED = pa.schema([("c", pa.int64()), ("pos", pa.int64()), ("sum", pa.binary()), ("code", pa.binary()), ("chars", pa.int64())])


def _placed(ranked: DataFrame) -> DataFrame:
    """Turns with their place in the conversation and the sum of codes up to them."""
    before = _before(ranked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, sums = values(batch, "nth"), values(batch, "sum")
            for i, at in enumerate(zip(values(batch, "c"), values(batch, "part"), strict=True)):
                if at in before:
                    n, total = before[at]
                    pos[i], sums[i] = pos[i] + n, _bytes((total + _int(sums[i]) * pow(_BASE, n, _PRIME)) % _PRIME)
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(pos, pa.int64()), pa.array(sums, pa.binary()), batch.column("code"), batch.column("chars")], schema=_PLACED)

    return ranked.mapInArrow(run, "c long, pos long, sum binary, code binary, chars long")


_REBUILT = pa.schema([("c", pa.int64()), ("d", pa.int64()), ("len", pa.int64()), ("path", pa.binary()), ("up", pa.binary()), ("code", pa.binary()), ("chars", pa.int64())])
_REBUILT_DDL = "c long, d long, len long, path binary, up binary, code binary, chars long"


def _rebuilt(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations with the codes of their prefixes; and the conversations with their length."""
    placed = _placed(ranked)
    h = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(HEADS))
    head = F.when(F.col("pos") < HEADS - 1, F.struct("pos", "sum", "code", "chars"))
    own = placed.groupBy("c").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(head)).alias("own"))
    own = materialize(own.withColumn("h", h).withColumn("base", F.col("c") - F.col("c") % FAMILY))
    family = own.select(F.col("c").alias("base"), F.col("own").alias("first"))
    convs = own.join(family, "base", "left").withColumn("first", F.slice(F.coalesce("first", F.array().cast(own.schema["own"].dataType)), F.lit(1), F.col("h").cast("int")))
    convs = convs.withColumn("m", F.size("first").cast("long"))
    last = F.lit(_ROOT)
    convs = convs.select(
        "c", "h", "m", "first", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"),
        F.when((F.col("h") > 0) & (F.col("n") >= F.col("h")), F.try_element_at("own", F.col("h").cast("int"))["sum"]).otherwise(last).alias("left"),
        F.coalesce(F.try_element_at("first", F.when(F.col("m") > 0, F.col("m").cast("int")))["sum"], last).alias("joined"))
    convs = materialize(convs)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, paths, ups = [], [], []
            for pos, h, m, total, left, joined, code in zip(*[values(batch, c) for c in ("pos", "h", "m", "sum", "left", "joined", "code")], strict=True):
                path = (_int(joined) + (_int(total) - _int(left)) * pow(_BASE, m - h, _PRIME)) % _PRIME
                d.append(pos - h + m + 1)
                paths.append(_bytes(path))
                ups.append(_bytes((path - _int(code) * pow(_BASE, d[-1] - 1, _PRIME)) % _PRIME))
            yield record_batch(_REBUILT, {"c": values(batch, "c"), "d": d, "len": values(batch, "len"), "path": paths, "up": ups, "code": values(batch, "code"), "chars": values(batch, "chars")})

    tails = placed.where(F.col("pos") >= h).join(convs.drop("first"), "c")
    tails = tails.mapInArrow(follow, _REBUILT_DDL)
    heads = convs.select("c", "len", F.explode("first").alias("t")).select("c", "len", F.col("t.pos").alias("pos"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("m"), F.col("t.sum").alias("sum"),
                                                                         F.lit(_ROOT).alias("left"), F.lit(_ROOT).alias("joined"), F.col("t.code").alias("code"), F.col("t.chars").alias("chars"))
    rows = materialize(tails.union(heads.mapInArrow(follow, _REBUILT_DDL)))
    discard(own)
    return rows, convs


class DoubleArray:
    """A trie of sequences of dense ids: the child of ``state`` over ``t`` is ``base[state] + t`` if ``check`` there is ``state``."""

    def __init__(self, sequences: list[list[int]], ids: int):
        self.base: list[int] = [0]
        self.check: list[int] = [-2]
        self._next: list[int] = [1]
        self.ids = ids
        rows = sorted(sequences)
        waiting = [(0, 0, len(rows), 0)]
        while waiting:
            state, left, right, depth = waiting.pop()
            while left < right and len(rows[left]) == depth:
                left += 1
            spans, i = [], left
            while i < right:
                first, t = i, rows[i][depth]
                while i < right and rows[i][depth] == t:
                    i += 1
                spans.append((t, first, i))
            if spans:
                base = self._fit([t for t, _, _ in spans])
                self.base[state] = base
                for t, a, b in spans:
                    self.check[base + t] = state
                    self._next[base + t] = base + t + 1
                    waiting.append((base + t, a, b, depth + 1))

    def _free(self, place: int) -> int:
        """The first free place from ``place`` on; the arrays grow up to it."""
        passed = []
        while True:
            if place >= len(self.check):
                grow = place + max(1024, len(self.check)) - len(self.check)
                self._next += range(len(self.check), len(self.check) + grow)
                self.check += [-1] * grow
                self.base += [0] * grow
            if self._next[place] == place:
                break
            passed.append(place)
            place = self._next[place]
        for p in passed:
            self._next[p] = place
        return place

    def _fit(self, symbols: list[int]) -> int:
        """The smallest base at which all places of ``symbols`` (rising) are free."""
        place = self._free(symbols[0] + 1)
        while True:
            base = place - symbols[0]
            self._free(base + symbols[-1])
            if all(self.check[base + t] == -1 for t in symbols):
                return base
            place = self._free(place + 1)

    def step(self, state: int, t: int) -> int:
        place = self.base[state] + t
        if not 0 <= place < len(self.check) or self.check[place] != state:
            raise KeyError(t)
        return place


_NODE = pa.schema([("path", pa.binary()), ("up", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
                   ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("top", pa.bool_())])
_NODE_DDL = ("path binary, up binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
             "saved_tokens long, ends_sha256 string, top boolean")


def shard_nodes(group: pa.Table) -> pa.Table:
    """Nodes of all subtrees of a shard, from rows (c, d, len, path, up, code, chars, top)."""
    group = group.sort_by([("c", "ascending"), ("d", "ascending")])
    c, d, length, path, up, code, chars, top = [group.column(n).to_pylist() for n in ("c", "d", "len", "path", "up", "code", "chars", "top")]
    dense: dict[bytes, int] = {}
    sequences: list[list[int]] = []
    for i, conv in enumerate(c):
        if not i or conv != c[i - 1]:
            sequences.append([dense.setdefault(b"/" + top[i], len(dense))])  # subtrees below different nodes are different
        else:
            sequences[-1].append(dense.setdefault(code[i], len(dense)))
    trie = DoubleArray(list(map(list, {tuple(s) for s in sequences})), len(dense))
    walked, state = [], 0
    for sequence in sequences:
        state = 0
        for t in sequence:
            state = trie.step(state, t)
            walked.append(state)
    states, row, members = np.unique(np.array(walked), return_index=True, return_counts=True)  # rows rise by c, so the first row of a state has its smallest member
    number = {s: i for i, s in enumerate(states.tolist())}
    parents = [number.get(trie.check[s], -1) for s in states.tolist()]
    children, leaves, saved = [0] * len(parents), [0] * len(parents), [0] * len(parents)
    row = row.tolist()
    for p in parents:
        if p >= 0:
            children[p] += 1
    for i in sorted(range(len(parents)), key=lambda i: -d[row[i]]):
        leaves[i] += not children[i]
        saved[i] += (int(members[i]) - 1) * chars[row[i]]
        if parents[i] >= 0:
            leaves[parents[i]] += leaves[i]
            saved[parents[i]] += saved[i]
    ends: dict[int, list[str]] = {}
    for i, s in enumerate(walked):
        if d[i] == length[i]:
            ends.setdefault(number[s], []).append(str(c[i]))
    return pa.table({
        "path": [path[r] for r in row], "up": [up[r] for r in row], "depth": [d[r] for r in row], "conv_id": [c[r] for r in row],
        "parent_conv_id": [c[row[p]] if p >= 0 else None for p in parents], "n_convs": members.tolist(), "n_children": children, "n_leaves": leaves, "saved_tokens": saved,
        "ends_sha256": [hashlib.sha256(",".join(ends.get(i, [])).encode()).hexdigest() for i in range(len(row))], "top": [p < 0 for p in parents]}, schema=_NODE)


def _end_hashes(ends: DataFrame) -> DataFrame:
    """path, ends_sha256 of rows (path, c). A hash is of one text, so its node is one task's work, but members stream through it and are never held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, current, state = pa.schema([("path", pa.binary()), ("ends_sha256", pa.string())]), None, None
        for batch in batches:
            done: list[tuple] = []
            for path, c in zip(values(batch, "path"), values(batch, "c"), strict=True):
                if path == current:
                    state.update(f",{c}".encode())
                else:
                    if current is not None:
                        done.append((current, state.hexdigest()))
                    current, state = path, hashlib.sha256(str(c).encode())
            yield record_batch(schema, {"path": [p for p, _ in done], "ends_sha256": [s for _, s in done]})
        if current is not None:
            yield record_batch(schema, {"path": [current], "ends_sha256": [state.hexdigest()]})

    return ends.repartition("path").sortWithinPartitions("path", "c").mapInArrow(run, "path binary, ends_sha256 string")


def _summed_upwards(nodes: DataFrame) -> DataFrame:
    """path, n_leaves, saved_tokens (and a null) of whole subtrees, stored, from the own figures of nodes (path, up, n_leaves, saved_tokens)."""
    table = materialize(nodes.select("path", F.col("up").alias("above"), "n_leaves", "saved_tokens"))
    while table.where("above IS NOT NULL").limit(1).count():
        given = table.where("above IS NOT NULL").groupBy(F.col("above").alias("path")).agg(F.sum("n_leaves").alias("more"), F.sum("saved_tokens").alias("more_saved"))
        further = table.select(F.col("path").alias("above"), F.col("above").alias("next"))
        step = table.join(given, "path", "left").join(further, "above", "left").select(
            "path", F.col("next").alias("above"), (F.col("n_leaves") + F.coalesce("more", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"))
        done, table = table, materialize(step)
        discard(done)
    return table


def nodes(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row of every node: path (code of the prefix), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversations are rebuilt first: ``h`` is the CRC-32 of the id modulo 6, and the first ``h`` turns of conversation ``c - c % 100`` (sign of ``c % 100`` as of ``c``) come in place of the own first ``h``.
    Turns are in order of ``turn``, nulls first; equal ones by role and text. A null role or text is empty. Rows without ``conv_id`` belong to no conversation and are left out; repeated rows
    are turns of their own. An empty table has no conversation and gives no row, not even a root. Columns other than conv_id, turn, role and text may have any name.
    """
    ranked = materialize(_ranked(conversations))
    rows, convs = _rebuilt(ranked)
    big = materialize(rows.groupBy("path").agg(F.sum(F.col("len") - F.col("d") + 1).alias("below")).where(F.col("below") > shard_turns).select("path"))
    above = materialize(rows.join(big, "path"))
    cut = above.groupBy("c").agg(F.max("d").alias("cut"))
    lower = rows.join(cut, "c", "left").withColumn("cut", F.coalesce("cut", F.lit(0))).where("d > cut")
    tops = lower.where("d = cut + 1").select("c", F.col("path").alias("top"))
    shards = -(-max(rows.count(), 1) // shard_turns)
    dealt = lower.join(tops, "c").select(*_REBUILT.names, "top").withColumn("shard", F.pmod(F.xxhash64("top"), F.lit(shards)))
    below = materialize(dealt.groupBy("shard").applyInArrow(lambda group: shard_nodes(group), _NODE_DDL))

    root = convs.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        F.lit(_ROOT).alias("path"), F.lit(None).cast("binary").alias("up"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("chars"))
    upper = above.groupBy("path", "up").agg(F.max("d").alias("depth"), F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars")).select(root.columns)
    upper = materialize(root.union(upper))
    hung = below.where("top").groupBy("up").agg(F.count("*").alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")).withColumnRenamed("up", "path")
    inner = upper.where("up IS NOT NULL").groupBy(F.col("up").alias("path")).agg(F.count("*").alias("m"))
    counted = upper.join(hung, "path", "left").join(inner, "path", "left").withColumn("n_children", F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0)))
    own = counted.select("path", "up", "n_children", (F.coalesce("leaves", F.lit(0)) + F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("long").alias("n_leaves"),
                         (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    own = materialize(own)
    whole = _summed_upwards(own)
    ends = above.where("d = len").select("path", "c").union(convs.where("len = 0").select(F.lit(_ROOT).alias("path"), "c"))
    names = upper.select(F.col("path").alias("up"), F.col("conv_id").alias("named"))
    upper = (upper.join(own.select("path", "n_children"), "path").join(whole.drop("above"), "path").join(_end_hashes(ends), "path", "left").join(names, "up", "left")
             .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY))).withColumn("parent_conv_id", F.col("named")))
    hanging = below.where("top").join(names, "up", "left").withColumn("parent_conv_id", F.col("named"))
    columns = ["path", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = materialize(below.where("NOT top").select(columns).union(hanging.select(columns)).union(upper.select(columns)))
    discard(ranked, rows, convs, big, above, below, own, whole)
    return out
