"""Byte-level BPE: DuckDB recursive queries per partition encode, ordered aggregation decodes."""
from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterator

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.llm.common import text_or_empty

#: Code points of documents handled at once, distinct pieces in one recursive query, and bytes of pieces and their ids in each generation that a worker remembers.
CHUNK, PIECES, REMEMBERED = 500_000, 20_000, 20_000_000
#: Longer pieces (in bytes) take one query each step of which would scan them whole; a linked list does them instead.
LONG_PIECE = 512
#: Sum of squared bytes of the pieces of one query: its memory, as every step's rows stay (at most half as many rows as this).
SQUARES = 2_000_000

# A position's key p is its piece's number times 1,024 plus its place, a pair's key k is a token times 2^32 plus the next.
_CONTRACT = """
WITH RECURSIVE state(step, p, tok) AS (
  SELECT 0, p, tok FROM start
  UNION ALL
  SELECT s.step + 1, s.p - (s.p > c.p)::BIGINT, CASE WHEN s.p = c.p THEN c.merged ELSE s.tok END
  FROM (
    SELECT w, w * 1024 + (least_key & 1023) AS p, least_key >> 10 AS merged
    FROM (
      SELECT s.p >> 10 AS w, min((m.merged << 10) + (s.p & 1023)) AS least_key
      FROM state s JOIN state n ON n.p = s.p + 1 JOIN merges m ON m.k = s.tok * 4294967296 + n.tok
      GROUP BY 1
    )
  ) c JOIN state s ON s.p >> 10 = c.w AND s.p <> c.p + 1
)
SELECT p >> 10 AS w, list(tok ORDER BY p) AS ids
FROM state s JOIN (SELECT p >> 10 AS w, max(step) AS step FROM state GROUP BY 1) l ON l.w = s.p >> 10 AND l.step = s.step
GROUP BY 1
"""
_DECODE = "SELECT d, list(tok ORDER BY pos) AS toks FROM ids GROUP BY d ORDER BY d"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of each line of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _queries(sizes: list[int]) -> Iterator[list[int]]:
    """Numbers of the pieces of each query, by size: at most PIECES, and SQUARES of the sizes squared (or one piece).

    Pieces of like size share a query, so that few queries take the many steps of long ones.
    """
    own, squares = [], 0
    for i in sorted(range(len(sizes)), key=sizes.__getitem__):
        if own and (len(own) == PIECES or squares + sizes[i] ** 2 > SQUARES):
            yield own
            own, squares = [], 0
        own.append(i)
        squares += sizes[i] ** 2
    if own:
        yield own


class Encoder:
    """Encodes and decodes texts; holds one in-memory DuckDB connection with the merge table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.known, self.older, self.held = ranks, regex.compile(pattern), {}, {}, 0
        self.single = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        a, b, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    a.append(left), b.append(right), merged.append(rank)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "120MB", "temp_directory": ""})
        # all tokens' bytes one after the other, and where each begins
        self.size = np.zeros(max(ranks.values(), default=-1) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), dtype=np.uint8)
        self.con.register("given", pa.table({"k": np.array(a, dtype=np.int64) * 4294967296 + np.array(b, dtype=np.int64), "merged": np.array(merged, dtype=np.int64)}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.con.unregister("given")

    def _contract(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of distinct pieces of 2 to LONG_PIECE bytes."""
        n = np.array([len(p) for p in pieces], dtype=np.int64)
        piece = np.repeat(np.arange(len(pieces)), n)
        place = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
        tok = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        self.con.register("start", pa.table({"p": piece * 1024 + place, "tok": tok}))
        got = self.con.sql(_CONTRACT).to_arrow_table().combine_chunks()
        self.con.unregister("start")
        lists = got["ids"].chunk(0)
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        result: list = [None] * len(pieces)
        for i, k in enumerate(got["w"].to_numpy()):
            result[k] = flat[ends[i] : ends[i + 1]]
        return result

    def _long(self, piece: bytes) -> list[int]:
        """The same contraction of one very long piece, by a heap over a linked list of tokens' bytes."""
        import heapq

        part: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(len(part) - 1) if (r := self.ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= len(part) or part[j] != b:
                continue
            part[i], part[j], after[i] = a + b, None, after[j]
            if after[i] < len(part):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(part) and (r := self.ranks.get(part[k] + part[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, part[k], part[after[k]]))
        return [self.ranks[t] for t in part if t is not None]

    def close(self) -> None:
        """Gives back the merge table and what is remembered."""
        self.con.close()
        self.known, self.older, self.held = {}, {}, 0

    def learn(self, pieces: list[str]) -> dict[str, str]:
        """Decimal ids, joined by spaces, of pieces."""
        found, rest, names = {}, [], []
        for p in pieces:
            b = p.encode("utf-8")
            rank = self.ranks.get(b)
            if rank is not None:
                found[p] = str(rank)
            elif len(b) > LONG_PIECE:
                found[p] = " ".join(map(str, self._long(b)))
            else:
                rest.append(b)
                names.append(p)
        for at in _queries([len(b) for b in rest]):
            for i, ids in zip(at, self._contract([rest[i] for i in at]), strict=True):
                found[names[i]] = " ".join(map(str, ids.tolist()))
        return found

    def encode(self, texts: list[str]) -> list[str]:
        """Decimal ids, joined by spaces, of each text."""
        split = [self.pattern.findall(t) for t in texts]
        own, new = {}, []
        for p in set().union(*split):
            ids = self.known.get(p) or self.older.get(p)
            if ids is None:
                new.append(p)
            else:
                own[p] = ids
        own |= self.learn(new)
        # two generations: a piece that doesn't return while the younger one fills is forgotten
        self.held += sum(sys.getsizeof(p) + sys.getsizeof(ids) for p, ids in own.items() if p not in self.known)
        self.known |= own
        if self.held > REMEMBERED:
            self.known, self.older, self.held = {}, self.known, 0
        return [" ".join(map(own.__getitem__, pieces)) for pieces in split]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of each sequence of ids, put together in order by one aggregation."""
        n = np.array([len(x) for x in ids], dtype=np.int64)
        if not n.sum():
            return [b""] * len(ids)
        d = np.repeat(np.arange(len(ids), dtype=np.int32), n)
        pos = (np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        self.con.register("ids", pa.table({"d": d, "pos": pos, "tok": np.concatenate(ids).astype(np.int32)}))
        got = self.con.sql(_DECODE).to_arrow_table().combine_chunks()
        self.con.unregister("ids")
        lists = got["toks"].chunk(0)
        toks, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        size = self.size[toks]
        after = np.cumsum(size)
        data = self.bytes[np.repeat(self.at[toks] - (after - size), size) + np.arange(after[-1])]
        ends = np.concatenate([[0], after])[ends]
        result = [b""] * len(ids)
        for i, k in enumerate(got["d"].to_numpy()):
            result[k] = data[ends[i] : ends[i + 1]].tobytes()
        return result


def _chunks(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    part = batch["text"].str.len().cumsum() // CHUNK
    for _, chunk in batch.groupby(part.to_numpy(), sort=False):
        yield chunk


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, ids: bool = True) -> DataFrame:
    """doc_id, ids (array), n_tokens, ids_sha256, decoded_sha256 of every row of ``docs``; nothing is shuffled.

    Each match of ``pattern`` is encoded separately by the ranks in ``ranks_path`` (read by the driver, a file of
    bounded size), without special tokens; then the ids are decoded. A null text is empty: no ids. Repeated rows
    give repeated results; extra columns are not used. ``ids=False`` leaves the arrays out.

    A worker holds CHUNK code points of texts at a time (or one longer text) and encodes each distinct piece once:
    token positions join the merge table, and each step contracts every piece's leftmost pair of least rank.
    """
    with open(ranks_path, "rb") as f:
        lines = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # one for each task: idle workers, of which an executor may keep several, hold no encoder
        encoder = None
        try:
            for batch in batches:
                encoder = encoder or Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.value.splitlines())}, pattern)
                for chunk in _chunks(batch):
                    joined = encoder.encode(chunk["text"].tolist())
                    tokens = [np.fromstring(s, dtype=np.int32, sep=" ") if s else np.zeros(0, np.int32) for s in joined]
                    out = {
                        "doc_id": chunk["doc_id"].to_numpy(),
                        "n_tokens": [len(t) for t in tokens],
                        "ids_sha256": [hashlib.sha256(s.encode()).hexdigest() for s in joined],
                        "decoded_sha256": [hashlib.sha256(b).hexdigest() for b in encoder.decode(tokens)],
                    }
                    yield pd.DataFrame(out | ({"ids": tokens} if ids else {}))
        finally:
            if encoder:
                encoder.close()
            pa.default_memory_pool().release_unused()

    columns = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInPandas(run, columns)
