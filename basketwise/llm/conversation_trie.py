"""The tries of all prefixes of conversations: double arrays per shard, shared upper nodes merged.

A turn is known by a digest of its role and text. Conversations are dealt by ranges of their first
turns (and ids, so that copies of one spread), and a task cuts its sorted conversations into shards of
a bounded number of turns. In a shard the turns get dense ids, the sorted sequences are packed into the
arrays BASE and CHECK (state s goes to BASE[s] + id where CHECK says s), and every conversation is
traversed through them to count the nodes it passes. Only nodes on the edges of a shard can be in
another one too. Their counts are merged by a digest of their path; what was counted once per shard
instead of once is put right for them and for all nodes above, by doubling steps towards the root.

Defined results: rows without a conversation are in none; a null turn comes first, turns of one
number follow by their digest; null roles and texts are empty ones; repeated rows are turns each; a
conversation without turns is a member of the root; an empty table has no nodes; other columns are not
looked at. Of a conversation longer than LONG only what it shares with another one, and one turn more,
goes through the tries: the nodes after it have a single member and follow from its length. A prefix
that several conversations share must fit a row (36 bytes a turn). The ids of the members that end at
a node are hashed as one stream, in their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from basketwise.session import materialise

#: Turns of a shard, first turns by which conversations are dealt, and turns from which a conversation is a long one.
SHARD, DEAL, LONG = 65_536, 16, 4096

NODE = (
    "shared boolean, key binary, parent_key binary, depth long, chars long, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, bare int, n_leaves long, saved_tokens long, ends string"
)
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes that stand for a turn."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 32))


class DoubleArray:
    """A trie over sorted sequences of dense ids; state 0 is the root, a free place has CHECK -1."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.base, self.check, self.order = [0], [0], []
        free, todo = 1, [(0, 0, len(sequences), 0)]
        while todo:
            state, a, b, depth = todo.pop()
            self.order.append(state)
            while a < b and len(sequences[a]) == depth:
                a += 1
            codes, cuts = [], []
            for k in range(a, b):
                code = sequences[k][depth]
                if not codes or codes[-1] != code:
                    codes.append(code)
                    cuts.append(k)
            if not codes:
                continue
            while free < len(self.check) and self.check[free] >= 0:
                free += 1
            self._place(state, codes, free)
            cuts.append(b)
            todo += [(self.base[state] + code, cuts[k], cuts[k + 1], depth + 1) for k, code in enumerate(codes)]

    def _place(self, state: int, codes: list[int], free: int) -> None:
        """Finds the first place that is free for all children of a state; ids of sorted sequences ascend."""
        base, check, first = self.base, self.check, codes[0]
        place = free
        while any(place - first + c < len(check) and check[place - first + c] >= 0 for c in codes):
            place += 1
        more = place - first + codes[-1] + 1 - len(check)
        if more > 0:
            check += [-1] * more
            base += [0] * more
        base[state] = place - first
        for c in codes:
            check[place - first + c] = state

    def walk(self, sequence: list[int]) -> list[int]:
        """The states of a sequence, the root first; stops where the trie ends."""
        base, check, state, path = self.base, self.check, 0, [0]
        for code in sequence:
            after = base[state] + code
            # No state but the root comes back to 0.
            if not 0 < after < len(check) or check[after] != state:
                break
            path.append(after)
            state = after
        return path


def _shard(rows: list[tuple], deal: int) -> pa.RecordBatch:
    """The nodes of the trie of sorted (conversation, turn digests, their lengths, whether it goes on)."""
    dense: dict[bytes, int] = {}
    for _, turns, _, _ in rows:
        for turn in turns:
            dense.setdefault(turn, 0)
    # Dense ids ascend with the digests, so that sorted conversations are sorted sequences.
    names = sorted(dense)
    dense = {turn: k for k, turn in enumerate(names)}
    sequences = [[dense[turn] for turn in turns] for _, turns, _, _ in rows]
    trie = DoubleArray(sequences)
    size = len(trie.check)
    n, least, depth, chars, goes_on = [0] * size, [0] * size, [0] * size, [0] * size, [0] * size
    ends: dict[int, list[int]] = {}
    shared = set()
    edges = [rows[0][1][:deal], rows[-1][1][:deal]]
    for (conv, turns, lengths, more), sequence in zip(rows, sequences, strict=True):
        path = trie.walk(sequence)
        for d, state in enumerate(path):
            if not n[state]:
                least[state], depth[state], chars[state] = conv, d, lengths[d - 1] if d else 0
            n[state] += 1
            least[state] = min(least[state], conv)
        if more:
            goes_on[path[-1]] += 1
        else:
            ends.setdefault(path[-1], []).append(conv)
        if turns[:deal] in edges:
            shared.update(path)
    children, apart, leaves, saved = [0] * size, [0] * size, [0] * size, [0] * size
    for state in reversed(trie.order):
        if not children[state]:
            leaves[state] = 1
        saved[state] += (n[state] - 1) * chars[state]
        if state:
            up = trie.check[state]
            children[up] += 1
            apart[up] += state not in shared
            leaves[up] += leaves[state]
            saved[up] += saved[state]
    keys: dict[int, bytes] = {0: b""}
    for state in trie.order:
        if state and state in shared:
            up = trie.check[state]
            keys[state] = hashlib.sha256(keys[up] + names[state - trie.base[up]]).digest()[:16]
    out = []
    for state in trie.order:
        up = trie.check[state]
        own, above = keys.get(state), keys.get(up) if state else None
        ending = ",".join(map(str, ends.get(state, ())))
        out.append((
            own is not None, own, above, depth[state], chars[state], least[state], None if above is not None or not state else least[up],
            n[state], (children if own is None else apart)[state] + goes_on[state], int(not children[state]), leaves[state], saved[state],
            hashlib.sha256(ending.encode()).hexdigest() if own is None else ending,
        ))
    kinds = [
        pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(),
        pa.int64(), pa.int64(), pa.string(),
    ]
    columns = [pa.array(values, kind) for values, kind in zip(zip(*out, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in NODE.split(", ")])


def _sharding(size: int, deal: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turns = [], 0
        for batch in batches:
            for row in zip(*(batch.column(name) for name in ("conv", "ids", "chars", "more")), strict=True):
                conv, ids, chars, more = (x.as_py() for x in row)
                if held and (turns + len(ids) > size or len(held) >= size):
                    yield _shard(held, deal)
                    held, turns = [], 0
                held.append((conv, ids, chars, more))
                turns += len(ids)
        if held:
            yield _shard(held, deal)

    return run


def _into_tries(members: DataFrame, turns: DataFrame, long: int) -> DataFrame:
    """(conv, length, kept) of every conversation: how many of its turns go through the tries.

    The prefixes of long conversations are told apart by xors of hashes of their turns with their places.
    """
    longer = members.where(F.col("length") > long)
    if longer.isEmpty():
        return members.withColumn("kept", F.col("length"))
    rows = turns.join(longer.select("conv"), "conv", "left_semi").withColumn("cell", F.floor((F.col("depth") - 1) / long))
    rows = rows.select("conv", "depth", "cell", F.xxhash64("depth", "id").alias("x"), F.xxhash64("id", "depth", F.lit(1)).alias("y"))
    rows = materialise(rows, "long")
    # Within cells first, so that no task follows a conversation from end to end.
    so_far = Window.partitionBy("conv", "cell").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("conv").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy("conv", "cell").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    start = [F.coalesce(F.bit_xor(c).over(ahead), F.lit(0)).alias(f"start_{c}") for c in ("x", "y")]
    within = rows.select("conv", "depth", "cell", F.bit_xor("x").over(so_far).alias("x"), F.bit_xor("y").over(so_far).alias("y"))
    prefix = within.where(F.col("depth") > long).join(cells.select("conv", "cell", *start), ["conv", "cell"])
    prefix = prefix.select("conv", "depth", F.col("x").bitwiseXOR(F.col("start_x")).alias("x"), F.col("y").bitwiseXOR(F.col("start_y")).alias("y"))
    prefix = materialise(prefix, "prefixes")
    common = materialise(prefix.groupBy("depth", "x", "y").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "common")
    deepest = prefix.join(common, ["depth", "x", "y"], "left_semi").groupBy("conv").agg(F.max("depth").alias("deepest"))
    kept = F.least("length", F.greatest(F.coalesce("deepest", F.lit(0)), F.lit(long)) + 1)
    return members.join(deepest, "conv", "left").select("conv", "length", kept.alias("kept"))


def _hashing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of the joined parts of each node; rows come sorted by node and part."""
    key, state, parts = None, None, False
    for batch in batches:
        done = []
        for node, text in zip(batch.column("key"), batch.column("ends"), strict=True):
            node, text = node.as_py(), text.as_py()
            if state is None or node != key:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state, parts = node, hashlib.sha256(), False
            state.update((("," if parts else "") + text).encode())
            parts = True
        yield _digests(done)
    if state is not None:
        yield _digests([(key, state.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    keys, digests = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])


def _below(fixes: DataFrame) -> DataFrame:
    """(key, leaves, saved) summed over all nodes at and below each, of nodes (key, parent_key, leaves, saved, depth).

    Each round doubles the distance to which sums and pointers reach, so that a depth takes its logarithm of rounds.
    """
    depth = fixes.agg(F.max("depth")).first()[0]
    if depth is None:
        return fixes.select("key", "leaves", "saved")
    now = fixes.select("key", F.col("parent_key").alias("up"), "leaves", "saved")
    for _ in range(int(depth).bit_length()):
        lower = now.where("up IS NOT NULL").groupBy("up").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        jump = now.select(F.col("key").alias("up"), F.col("up").alias("next"))
        added = now.join(lower.withColumnRenamed("up", "key"), "key", "left").join(jump, "up", "left")
        now = added.select(
            "key", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        )
        now = materialise(now, "below")
    return now.select("key", "leaves", "saved")


def _merged(parts: DataFrame) -> DataFrame:
    """The nodes that shards share, from what each of them counted."""
    nodes = parts.groupBy("key").agg(
        F.any_value("parent_key").alias("parent_key"), F.any_value("depth").alias("depth"), F.any_value("chars").alias("chars"),
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("apart"), F.count("*").alias("shards"),
        (F.min("bare") - F.sum("bare")).alias("leaves"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
    )
    nodes = materialise(nodes, "shared")
    # A node that several shards counted is one leaf and one copy of its text.
    fixes = nodes.where("shards > 1").select("key", "parent_key", "depth", "leaves", ((F.col("shards") - 1) * F.col("chars")).alias("saved"))
    below = _below(fixes).select("key", F.col("leaves").alias("fix_leaves"), F.col("saved").alias("fix_saved"))
    together = nodes.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("together"))
    pieces = parts.where("ends <> ''").select("key", "ends", F.substring_index("ends", ",", 1).cast("long").alias("first"))
    ends = pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashing, "key binary, ends_sha256 string")
    whole = nodes.join(below, "key", "left").join(together, "key", "left").join(ends, "key", "left")
    zero = F.lit(0)
    return whole.select(
        "key", "parent_key", "depth", "conv_id", "n_convs", (F.col("apart") + F.coalesce("together", zero)).alias("n_children"),
        (F.col("n_leaves") + F.coalesce("fix_leaves", zero)).alias("n_leaves"),
        (F.col("saved_tokens") + F.coalesce("fix_saved", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def nodes(members: DataFrame, turns: DataFrame, shard: int = SHARD, deal: int = DEAL, long: int = LONG) -> DataFrame:
    """The nodes of all prefixes of conversations, of members (conv, length) and turns (conv, depth from 1, id, chars).

    Hand in written tables, as both are read several times.
    """
    into = _into_tries(members, turns, long)
    into = materialise(into, "kept")
    short = turns.join(into.where("kept < length").select("conv", "kept"), "conv", "left").where("kept IS NULL OR depth <= kept")
    turn = F.struct("depth", "id", "chars")
    held = short.groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    lists = into.join(held, "conv", "left").select(
        "conv", F.coalesce(F.transform("turns", lambda t: t["id"]), F.array().cast("array<binary>")).alias("ids"),
        F.coalesce(F.transform("turns", lambda t: t["chars"]), F.array().cast("array<long>")).alias("chars"), (F.col("kept") < F.col("length")).alias("more"),
    )
    lists = materialise(lists, "conversations")
    dealt = lists.repartitionByRange(F.slice("ids", 1, deal), "conv").sortWithinPartitions("ids", "conv")
    found = materialise(dealt.mapInArrow(_sharding(shard, deal), NODE), "nodes")
    merged = materialise(_merged(found.where("shared")), "merged")
    first = merged.where("depth = 0").select("conv_id").scalar()
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    own = found.where("NOT shared").withColumnRenamed("ends", "ends_sha256")
    # Children of the root need no lookup; they may be nearly all nodes.
    edge = own.where("depth > 1 AND parent_key IS NOT NULL").join(above, "parent_key").withColumn("parent_conv_id", F.col("above"))
    rest = own.where("depth = 1 OR parent_key IS NULL").withColumn("parent_conv_id", F.when(F.col("depth") == 1, first).otherwise(F.col("parent_conv_id")))
    upper = merged.join(above, "parent_key", "left").withColumn("parent_conv_id", F.col("above"))
    tails = turns.join(into.where("kept < length"), "conv").where("depth > kept")
    ended = F.when(F.col("depth") == F.col("length"), F.col("conv").cast("string")).otherwise(F.lit(""))
    tails = tails.select(
        F.col("conv").alias("conv_id"), "depth", F.col("conv").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        (F.col("depth") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.sha2(ended, 256).alias("ends_sha256"),
    )
    return rest.select(*OUT).union(edge.select(*OUT)).union(upper.select(*OUT)).union(tails)
