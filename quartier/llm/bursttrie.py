"""Conversation prefix trie by burst tries."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartier.llm.common import WORD, spread_join
from quartier.session import materialise

#: A turn in a sequence: 16 bytes of its digest, 4 bytes of its number of words.
RECORD = 20
#: Conversations that share the first turns of one, and the most turns so shared.
FAMILY, SHARED = 20, 3
#: Sequences and bytes that a container may hold before it bursts; conversation ids per step of a digest.
LIMIT, BYTES, CHUNK = 64, 16_000_000, 256
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = (
    "top boolean, path binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string"
)


def _short(text: Column) -> Column:
    """16 bytes of a SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, key: the turns of each conversation in order, one record of RECORD bytes for each.

    Null turns come first; equal ones are ordered by the record. Null role or text is empty; repeated rows are turns of
    their own. Rows without a conv_id belong to no conversation. Texts are digested where they are read: the shuffle
    carries records only.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    record = F.concat(digest, F.lpad(F.hex(F.regexp_count(text, F.lit(WORD)).cast("long")), 8, "0"))
    read = turns.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", record.alias("r")).alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: t["r"])
    return read.groupBy("conv_id").agg(F.unhex(F.array_join(ordered, "")).alias("key"))


def rebuilt(own: DataFrame) -> DataFrame:
    """conv_id, key: the first h turns of the family's first conversation, then the own turns after the first h."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1)
    donor = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = own.where(f"conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("donor"), F.expr(f"substring(key, 1, {SHARED * RECORD})").alias("head"))
    joined = own.select("conv_id", "key", donor.alias("donor"), h.cast("int").alias("h")).join(heads, "donor", "left")
    return joined.select("conv_id", F.expr(f"concat(coalesce(substring(head, 1, {RECORD} * h), X''), substring(key, {RECORD} * h + 1, length(key)))").alias("key"))


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per sequence from its chunks of ids, which come in order; the digest takes them one after the other."""
    last, digest, out = None, None, []
    for batch in batches:
        for kid, key, ids, n, first in zip(batch["kid"], batch["key"], batch["ids"], batch["n"], batch["first"], strict=True):
            text = ",".join(map(str, ids)).encode()
            if last is not None and kid == last[0]:
                last[2] += n
                digest.update(b"," + text)
                continue
            if last is not None:
                out.append((*last, digest.hexdigest()))
            last, digest = [kid, key, n, first], hashlib.sha256(text)
        if out:
            yield pd.DataFrame([x[1:] for x in out], columns=["key", "n", "first", "sha"])
            out = []
    if last is not None:
        yield pd.DataFrame([(*last[1:], digest.hexdigest())], columns=["key", "n", "first", "sha"])


def distinct_sequences(convs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """key, n, first, sha of each distinct sequence: its conversations' number, smallest id and digest of ids.

    Copies are counted in chunks by ranges of ids first, so a sequence that many share is no hot group; then its ids pass
    through one digest as a stream, whose order SHA-256 sets.
    """
    named = convs.select(_short(F.col("key")).alias("kid"), "key", "conv_id", F.floor(F.col("conv_id") / chunk).alias("chunk"))
    chunks = named.groupBy("kid", "chunk").agg(
        F.any_value("key").alias("key"), F.sort_array(F.collect_list("conv_id")).alias("ids"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first")
    )
    return chunks.repartition("kid").sortWithinPartitions("kid", "chunk").mapInPandas(_ends, "key binary, n long, first long, sha string")


def _shared_records() -> Column:
    """Records that the keys ``low`` and ``high`` share at their start."""
    shorter = f"CAST(least(length(low), length(high)) DIV {RECORD} AS INT)"
    n = F.expr(shorter)
    differ = F.expr(
        f"CAST(array_position(transform(sequence(0, {shorter} - 1), "
        f"i -> substring(low, i * {RECORD} + 1, {RECORD}) = substring(high, i * {RECORD} + 1, {RECORD})), false) AS INT)"
    )
    return F.when(n == 0, 0).otherwise(F.when(differ == 0, n).otherwise(differ - 1))


HEAD = "box binary, at int, up long, path binary, low binary, sha string, n long, first long, till int"


def burst(seqs: DataFrame, limit: int = LIMIT, most: int = BYTES) -> tuple[DataFrame, DataFrame]:
    """(containers' rows, heads) of the trie over ``seqs``.

    A container holds the sequences below one node: ``box`` (its id), ``at`` (the node's depth), ``up`` (the parent's
    conv_id) and ``path`` (ids of the heads above). The root's container, and each with over ``limit`` sequences or ``most``
    bytes, bursts: what all its sequences share becomes a head, a chain of nodes from ``at`` to ``till``, and the sequences
    move to containers by their next turn. The smallest and largest sequence tell how far all agree, so a burst always parts
    sequences and no round is spent on a shared stretch. One sequence alone never bursts. A round is one aggregate and one
    join over the sequences that the round before moved.
    """
    spark = seqs.sparkSession
    whole = seqs.agg(F.min(F.struct("key", "sha")).alias("least"), F.max("key").alias("high"), F.sum("n").alias("n"), F.min("first").alias("first")).first()
    if whole["n"] is None:
        return seqs.selectExpr("X'' AS box", "0 AS at", "0L AS up", "X'' AS path", "*"), spark.createDataFrame([], HEAD)
    low, root = bytes(whole["least"]["key"]), bytes(16)
    till = shared(low, bytes(whole["high"]))
    heads = spark.createDataFrame([(root, 0, None, b"", low, whole["least"]["sha"], whole["n"], whole["first"], till)], HEAD)

    def moved(rows: DataFrame) -> DataFrame:
        """Sequences that go on below the heads of ``rows``, in their new containers."""
        turn = F.expr(f"substring(key, till * {RECORD} + 1, {RECORD})")
        return rows.where(f"length(key) > till * {RECORD}").select(
            _short(F.concat("box", turn)).alias("box"), (F.col("till") + 1).alias("at"), F.col("_up").alias("up"),
            F.concat("path", "box").alias("path"), "key", "n", "first", "sha",
        )

    rows = moved(seqs.select(F.lit(root).alias("box"), F.lit(b"").alias("path"), F.lit(whole["first"]).cast("long").alias("_up"), F.lit(till).alias("till"), "*"))
    ready = None
    while True:
        large = rows.groupBy("box").agg(
            F.count(F.lit(1)).alias("c"), F.sum(F.length("key")).alias("b"), F.any_value("at").alias("at"), F.any_value("up").alias("up"),
            F.any_value("path").alias("path"), F.min(F.struct("key", "sha")).alias("least"), F.max("key").alias("high"), F.sum("n").alias("n"), F.min("first").alias("first"),
        ).where(f"c > 1 AND (c > {limit} OR b > {most})")
        head = large.selectExpr("box", "at", "up", "path", "least.key AS low", "least.sha AS sha", "high", "n", "first")
        head = materialise(head.withColumn("till", _shared_records()).drop("high"))
        if head.isEmpty():
            return (rows if ready is None else ready.unionByName(rows)), heads
        heads = heads.unionByName(head)
        marked = materialise(spread_join(rows, head.select("box", F.col("first").alias("_up"), "till"), ["box"], "left"))
        small = marked.where("till IS NULL").drop("_up", "till")
        ready = small if ready is None else ready.unionByName(small)
        rows = moved(marked.where("till IS NOT NULL"))


class _Run:
    """Nodes of one chain: depths ``at`` to ``till`` along ``key``, all with the same members."""

    __slots__ = ("key", "words", "at", "till", "n", "first", "children", "leaves", "below", "sha", "parent")

    def __init__(self, key, words, at, till, sha):
        self.key, self.words, self.at, self.till, self.sha = key, words, at, till, sha
        self.n, self.first, self.children, self.leaves, self.below, self.parent = 0, None, 0, 0, 0, None

    def take(self, n, first):
        self.n, self.first = self.n + n, first if self.first is None else min(self.first, first)

    def close(self, parent):
        """Adds what is known of the run to its parent."""
        self.leaves, self.parent = self.leaves or 1, parent
        if parent is not None:
            parent.take(self.n, self.first)
            parent.children += 1
            parent.leaves += self.leaves
            parent.below += self.below + (self.n - 1) * int(self.words[self.till] - self.words[max(self.at, 1) - 1])


def words_before(key: bytes) -> np.ndarray:
    """Words in the first d turns, for d from 0."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(key, ">u4")[4::5], dtype=np.int64)])


def shared(a: bytes, b: bytes) -> int:
    """Records that two keys share at their start."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return (int(differ[0]) if len(differ) else n) // RECORD


def sweep(keys: list[bytes], n: list[int], first: list[int], sha: list[str], at: int) -> list[_Run]:
    """Chains of the trie of sorted distinct ``keys`` that share their first ``at`` records, from depth ``at``."""
    done: list[_Run] = []
    stack: list[_Run] = []

    def leave(depth):
        while stack and stack[-1].till > depth:
            run = stack.pop()
            if run.at <= depth:  # the key leaves this chain midway: its upper part stays open
                upper = _Run(run.key, run.words, run.at, depth, EMPTY)
                run.at = depth + 1
                stack.append(upper)
            run.close(stack[-1] if stack else None)
            done.append(run)

    for i, key in enumerate(keys):
        common = shared(keys[i - 1], key) if i else at - 1
        leave(common)
        run = _Run(key, words_before(key), common + 1, len(key) // RECORD, sha[i])
        run.take(n[i], first[i])
        stack.append(run)
    leave(at - 1)
    return done


def _nodes(key_words, at, till, n, first, up, children, leaves, below, sha, top, path) -> Iterator[pd.DataFrame]:
    """The nodes of one chain, deepest last, in frames of bounded size."""
    for a in range(at, till + 1, 65_536):
        depth = np.arange(a, min(a + 65_536, till + 1))
        last, begin = depth == till, depth == at
        parent = pd.array(np.full(len(depth), first), dtype="Int64")
        if begin[0]:
            parent[0] = pd.NA if up is None else up
        yield pd.DataFrame({
            "top": begin & top, "path": [path if t else None for t in begin & top], "conv_id": first, "depth": depth, "parent_conv_id": parent, "n_convs": n,
            "n_children": np.where(last, children, 1), "n_leaves": leaves, "saved_tokens": below + (n - 1) * (key_words[till] - key_words[np.maximum(depth, 1) - 1]),
            "ends_sha256": np.where(last, sha, EMPTY),
        })


def _sweep_boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of all containers; rows come sorted by container and key, and a container may span batches."""
    held, last = [], None

    def flush():
        keys, n, first, sha = (list(x) for x in zip(*held, strict=True))
        _, at, up, path = last
        for run in sweep(keys, n, first, sha, at):
            above = run.parent.first if run.parent else up
            yield from _nodes(run.words, run.at, run.till, run.n, run.first, above, run.children, run.leaves, run.below, run.sha, run.at == at, path)

    def gather(frames):
        some, rows = [], 0
        for f in frames:
            some, rows = [*some, f], rows + len(f)
            if rows > 20_000:
                yield pd.concat(some, ignore_index=True)
                some, rows = [], 0
        if some:
            yield pd.concat(some, ignore_index=True)

    def frames():
        nonlocal held, last
        for batch in batches:
            for box, at, up, path, key, n, first, sha in zip(*(batch[c] for c in ("box", "at", "up", "path", "key", "n", "first", "sha")), strict=True):
                if last is None or box != last[0]:
                    if held:
                        yield from flush()
                    held, last = [], (box, at, up, path)
                held.append((key, n, first, sha))
        if held:
            yield from flush()

    yield from gather(frames())


def _head_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for low, at, till, n, first, up, children, leaves, below, sha in zip(
            *(batch[c] for c in ("low", "at", "till", "n", "first", "up", "children", "leaves", "below", "sha")), strict=True
        ):
            ends = sha if len(low) == till * RECORD else EMPTY
            yield from _nodes(words_before(low), at, till, n, first, None if pd.isna(up) else int(up), children, leaves, below, ends, False, None)


def prefix_trie(convs: DataFrame, limit: int = LIMIT, most: int = BYTES) -> DataFrame:
    """The nodes of the trie of ``convs`` (conv_id, key as in ``sequences``; conv_id unique): conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Copies are counted first, so a container holds distinct sequences. Containers are swept in sorted order, each bounded
    by ``limit`` and ``most`` (or one sequence); heads take the sums of the containers below them. An empty table has no
    nodes, not even a root, as none has members. A conversation's records are one row (20 bytes a turn); its texts are not.
    """
    seqs = materialise(distinct_sequences(convs))
    rows, heads = burst(seqs, limit, most)
    nodes = materialise(rows.repartition("box").sortWithinPartitions("box", "key").mapInPandas(_sweep_boxes, NODE))
    words = F.expr(
        f"aggregate(sequence(greatest(at, 1), till), 0L, (s, i) -> s + CAST(conv(hex(substring(low, i * {RECORD} - 3, 4)), 16, 10) AS LONG))"
    )
    own = F.when(F.col("till") >= F.greatest("at", F.lit(1)), (F.col("n") - 1) * words).otherwise(F.lit(0).cast("long"))
    heads = materialise(heads.withColumn("own", own))
    parts = nodes.where("top").select("path", F.col("saved_tokens").alias("saved"), F.col("n_leaves").alias("leaves")).unionByName(
        heads.where("length(path) > 0").select("path", F.col("own").alias("saved"), F.lit(0).cast("long").alias("leaves"))
    )
    above = parts.selectExpr("saved", "leaves", "path", "explode(sequence(1, CAST(length(path) / 16 AS INT))) AS i").selectExpr(
        "substring(path, 16 * i - 15, 16) AS box", "saved", "leaves", "CAST(i = length(path) / 16 AS LONG) AS children"
    )
    sums = above.groupBy("box").agg(F.sum("saved").alias("below"), F.sum("leaves").alias("leaves"), F.sum("children").alias("children"))
    full = spread_join(heads, sums, ["box"], "left").selectExpr(
        "low", "at", "till", "n", "first", "up", "coalesce(children, 0L) AS children", "greatest(coalesce(leaves, 0L), 1L) AS leaves",
        "coalesce(below, 0L) AS below", "sha",
    )
    return nodes.unionByName(full.mapInPandas(_head_nodes, NODE)).drop("top", "path")


def conversation_trie(turns: DataFrame, limit: int = LIMIT, most: int = BYTES) -> DataFrame:
    """``prefix_trie`` of the rebuilt conversations of ``turns`` (conv_id, turn, role, text); extra columns are not used."""
    return prefix_trie(rebuilt(sequences(turns)), limit, most)
