"""Document log-likelihood under a gated recurrent language model with a class-factored softmax."""
from __future__ import annotations

import copy
import math
from collections.abc import Iterable, Iterator, Sequence
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartier.llm.common import id_text, spread_join, text_or_empty
from quartier.session import materialise

#: Hidden units; words with outputs of their own (the end included) and their classes at least, classes of all other words.
HIDDEN, HEAD, HEAD_CLASSES, TAIL_CLASSES = 16, 1024, 32, 32
#: Words whose counts each worker holds (the most frequent ones); the others are joined. Times from which a word of the lookup has an output of its own.
LOOKUP, OFTEN = 200_000, 5_000
#: Tokens of a window of truncated backpropagation, documents side by side in the fit and in scoring, learning rate, passes.
WINDOW, FIT_ROWS, SCORE_ROWS, RATE, PASSES = 32, 512, 512, 0.02, 1
#: Tokens of a document that a row of the fit reads on from one state; the next ones begin anew, so that no row is left alone with a long text.
STRETCH = 1_024
#: One document of so many only judges the weights; weights of a row that is summed, and tokens for each weight that a task trains on at least.
JUDGES, BLOCK, TOKENS_A_WEIGHT = 10, 16_384, 8
#: Bytes of the texts counted at once, and code points of the texts numbered or scored at once (or one longer text).
COUNTED, HELD = 6_000_000, 3_000_000

END = b""


def split(texts: Sequence[str] | pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Tokens of all texts one after the other, and where each text's begin (and the last one's end).

    Tokens are UTF-8 words, A-Z lower-cased, and one end a text: ASCII letters and ASCII white space only.
    """
    given = pc.ascii_trim_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string()) if not isinstance(texts, pa.Array) else texts.cast(pa.large_string())))
    empty, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    # one space after the last word leaves an empty part, the end; an empty text is one such part
    given = pc.if_else(pc.equal(pc.binary_length(given), 0), empty, pc.binary_join_element_wise(given, empty, space))
    parts = pc.ascii_split_whitespace(given)
    return parts.values.cast(pa.large_binary()), parts.offsets.to_numpy()


def tokens(text: str) -> list[bytes]:
    """UTF-8 words, A-Z lower-cased, and one end."""
    return split([text])[0].to_pylist()


def tail_class(word: bytes) -> int:
    """Class of a word without an output of its own: by its last byte."""
    return HEAD_CLASSES + (word[-1] if word else 0) % TAIL_CLASSES


def tail_classes(words: pa.Array) -> np.ndarray:
    """``tail_class`` of each word, less HEAD_CLASSES."""
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    if ends[0] == ends[-1]:
        return np.zeros(len(words), dtype=np.int64)
    last = np.frombuffer(data, dtype=np.uint8)[np.maximum(ends[1:], 1) - 1]
    return np.where(np.diff(ends) > 0, last % TAIL_CLASSES, 0).astype(np.int64)


def places(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Place of each word in ``among``, or -1."""
    return pc.index_in(words, value_set=among).fill_null(-1).to_numpy().astype(np.int64)


def head_side(lookup: list[tuple[bytes, int]]) -> int:
    """Classes of the head words, and words of each: the head grows with the words that occur OFTEN, up to the lookup."""
    often = sum(n >= OFTEN for _, n in lookup)
    return max(HEAD_CLASSES, min(math.isqrt(often), math.isqrt(LOOKUP)))


def _tail_class_sql() -> str:
    return f"CASE WHEN length(word) = 0 THEN 0 ELSE cast(conv(hex(substring(word, length(word), 1)), 16, 10) AS int) % {TAIL_CLASSES} END"


def _chunks(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    part = batch["text"].str.len().cumsum() // HELD
    for _, chunk in batch.groupby(part.to_numpy(), sort=False):
        yield chunk


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_string())
        part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // COUNTED
        ends = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for i, j in pairwise(ends):
            n = pc.value_counts(split(texts.slice(i, j - i))[0])
            yield pa.RecordBatch.from_arrays([n.field("values").cast(pa.binary()), n.field("counts")], ["word", "n"])


def count_words(training: DataFrame) -> DataFrame:
    """(word, n) over all rows of ``training``; each task counts before the shuffle."""
    rows = training.select(text_or_empty().alias("text")).mapInArrow(_count, "word binary, n long")
    return materialise(rows.groupBy("word").agg(F.sum("n").alias("n")))


class LanguageModel:
    """Weights and the counted vocabulary that every worker holds.

    Inputs: the head words and the tail classes. A gated recurrent unit carries the state; the output
    is P(class | state), times P(word | class, state) for head words or the smoothed share of the word in its class
    for all others, with one place for unseen words.
    """

    def __init__(self, lookup: list[tuple[bytes, int]], total: int, distinct: int, tail_n: np.ndarray, tail_v: np.ndarray, seed: int = 5):
        self.total, self.distinct = total, distinct
        self.side = head_side(lookup)
        self.head = self.side**2
        head = [w for w, _ in lookup[: self.head]]
        counts = np.array([c for _, c in lookup], dtype=float)
        # head words side by side in classes, most frequent first
        self.head_words = pa.array(head, pa.large_binary())
        self.tail_z = np.log10(tail_n + tail_v + 1)
        self.base_z = float(np.log10(total + distinct + 1))
        # what a word of the lookup adds: output number and log10(count + 1)
        self.words = pa.array([w for w, _ in lookup], pa.large_binary())
        self.log_count = np.log10(counts + 1) if len(counts) else np.zeros(0)
        self.output = np.array([i if i < self.head else self.head + tail_class(w) - HEAD_CLASSES for i, (w, _) in enumerate(lookup)], dtype=np.int64)
        rng = np.random.default_rng(seed)
        in_class = np.zeros((self.side, self.side))
        in_class.flat[: len(head)] = counts[: len(head)]
        share = np.concatenate([in_class.sum(axis=1), tail_n]) + 1
        self.p = {
            "input": rng.normal(0, 0.1, (self.head + TAIL_CLASSES, 3 * HIDDEN)).astype(np.float32),
            "state": rng.normal(0, 0.25, (HIDDEN, 3 * HIDDEN)).astype(np.float32),
            "class": rng.normal(0, 0.05, (HIDDEN, self.side + TAIL_CLASSES)).astype(np.float32),
            "class_0": np.log(share / share.sum()).astype(np.float32),
            "word": rng.normal(0, 0.05, (self.side, HIDDEN, self.side)).astype(np.float32),
            # places without a word never get a share
            "word_0": np.where(np.arange(self.head).reshape(self.side, self.side) < len(head), np.log((in_class + 1) / (in_class.max(axis=1, keepdims=True) + 1)), -60.0).astype(np.float32),
        }

    # --- the network ---------------------------------------------------------------------------------------------

    def advance(self, g: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """State after inputs with weights g in state h; keep: gets what backpropagation needs."""
        u = h @ self.p["state"]
        zr = g[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        un = u[:, 2 * HIDDEN :]
        new = r * un
        new += g[:, 2 * HIDDEN :]
        np.tanh(new, out=new)
        if keep is not None:
            keep.append((h, z, r, un, new))
        after = h - new
        after *= z
        after += new
        return after

    def log_chances(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log P(output y | h) of each row, without the tail words' shares; with grads, fills them (those of words by class) and returns d/dh.

        Places run along columns, so sums over them add whole rows. Logits begin at 0 or below and states lie within -1 and
        1, so no maximum needs to be taken off before the exponential.
        """
        cls = np.where(y < self.head, y // self.side, y - self.head + self.side).astype(np.int16)
        at, states = np.arange(len(y)), np.ascontiguousarray(h.T)
        a = self.p["class"].T @ states
        a += self.p["class_0"][:, None]
        result = a[cls, at].astype(np.float64)
        np.exp(a, out=a)
        total = a.sum(axis=0)
        result -= np.log(total)
        d_h = None
        if grads is not None:
            a /= total
            a[cls, at] -= 1
            grads["class"], grads["class_0"] = states @ a.T, a.sum(axis=1)
            grads["word"], grads["word_0"] = {}, {}
            d_h = (self.p["class"] @ a).T
        # head words side by side by class
        order = np.argsort(cls, kind="stable")
        ends = np.searchsorted(cls[order], np.arange(self.side + 1))
        order = order[: ends[-1]]
        own_states, place = states[:, order], y[order] % self.side
        logs, d_own = np.empty(len(order)), np.empty_like(own_states) if grads is not None else None
        for c in np.flatnonzero(np.diff(ends)):
            i, j = ends[c], ends[c + 1]
            b = self.p["word"][c].T @ own_states[:, i:j]
            b += self.p["word_0"][c][:, None]
            k, own = at[: j - i], place[i:j]
            logs[i:j] = b[own, k]
            np.exp(b, out=b)
            sums = b.sum(axis=0)
            logs[i:j] -= np.log(sums)
            if grads is not None:
                b /= sums
                b[own, k] -= 1
                grads["word"][c], grads["word_0"][c] = own_states[:, i:j] @ b.T, b.sum(axis=1)
                d_own[:, i:j] = self.p["word"][c] @ b
        result[order] += logs
        if grads is not None:
            d_h[order] += d_own.T
        return result, d_h

    def fit(self, documents: list[np.ndarray]) -> None:
        """PASSES over documents at hand, by the rule of ``fit_language_model`` with one partition."""
        judges, documents = documents[JUDGES - 1 :: JUDGES], [d for i, d in enumerate(documents) if i % JUDGES != JUDGES - 1]
        kept, best = {k: v.copy() for k, v in self.p.items()}, self.log_likelihoods(judges).sum()
        for _ in range(PASSES):
            self.train(documents)
            if not judges or (reached := self.log_likelihoods(judges).sum()) > best:
                kept, best = {k: v.copy() for k, v in self.p.items()}, reached if judges else 0.0
        self.p = {k: v.astype(np.float32) for k, v in kept.items()}

    def train(self, documents: Iterable[np.ndarray]) -> int:
        """One pass of Adam with truncated backpropagation; returns the tokens learned from.

        Gradients end at a window's edge, the state goes on to the next window. FIT_ROWS stretches are read side by side;
        each starts from the empty state, and where one ends the next begins; a row without a next one goes. Only these are
        held. Inputs and classes that a window doesn't have keep their weights and moments, and have no gradients.
        """
        start, seen, step = self.input_of(END), 0, 0
        source = (d[i : i + STRETCH] for d in documents for i in range(0, len(d), STRETCH))
        own: list = [x for x in (next(source, None) for _ in range(FIT_ROWS)) if x is not None]
        done, fresh = [0] * len(own), [True] * len(own)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        h = np.zeros((len(own), HIDDEN), dtype=self.p["state"].dtype)
        before = np.zeros(len(own), dtype=np.int64)
        while own:
            y = np.full((len(own), WINDOW), -1, dtype=np.int64)
            first = np.zeros((len(own), WINDOW), dtype=bool)
            for row, doc in enumerate(own):
                at = 0
                while doc is not None and at < WINDOW:
                    first[row, at] = fresh[row]
                    part = doc[done[row] : done[row] + WINDOW - at]
                    y[row, at : at + len(part)] = part
                    at, done[row], fresh[row] = at + len(part), done[row] + len(part), False
                    if done[row] >= len(doc):
                        doc, done[row], fresh[row] = next(source, None), 0, True
                own[row] = doc
            x = np.maximum(np.where(first, start, np.hstack([before[:, None], y[:, :-1]])), 0)
            before = y[:, -1]
            h, n = self._learn(x, y, first, h, m, v2, step := step + 1)
            seen += n
            live = np.array([d is not None for d in own])
            if not live.all():
                kept = np.flatnonzero(live)
                own, done, fresh = ([z[i] for i in kept] for z in (own, done, fresh))
                h, before = h[kept], before[kept]
        return seen

    def _learn(self, x, y, first, h, m, v2, step) -> tuple[np.ndarray, int]:
        """One step of Adam (moments m, v2) from a window of inputs x and outputs y; the state after it and its tokens.

        A window that isn't full takes a step as much shorter.
        """
        rows = len(x)
        keep: list = []
        states = np.empty((WINDOW, rows, HIDDEN), dtype=h.dtype)
        given, starts = self.p["input"][x.T], first.any(axis=0)
        for t in range(WINDOW):
            if starts[t]:
                h = np.where(first[:, t, None], h.dtype.type(0), h)
            h = self.advance(given[t], h, keep)
            states[t] = h
        ys = y.T.ravel()
        on = ys >= 0
        grads: dict = {}
        d_hs = np.zeros((len(on), HIDDEN), dtype=states.dtype)
        _, d_hs[on] = self.log_chances(states.reshape(-1, HIDDEN)[on], ys[on], grads)
        d_hs = d_hs.reshape(states.shape)
        back = np.zeros_like(d_hs[0])
        d_in = np.empty((WINDOW, rows, 3 * HIDDEN), dtype=states.dtype)
        d_us = np.empty_like(d_in)
        for t in range(WINDOW - 1, -1, -1):
            was, z, r, un, new = keep[t]
            d = d_hs[t] + back
            back = d * z
            d_new = d - back
            d_new *= 1 - new * new
            d_in[t, :, :HIDDEN] = back * (was - new) * (1 - z)
            d_in[t, :, HIDDEN : 2 * HIDDEN] = d_new * un * (r - r * r)
            d_in[t, :, 2 * HIDDEN :] = d_new
            d_us[t, :, : 2 * HIDDEN] = d_in[t, :, : 2 * HIDDEN]
            d_us[t, :, 2 * HIDDEN :] = d_new * r
            back += d_us[t] @ self.p["state"].T
            if starts[t]:
                back *= ~first[:, t, None]
        grads["state"] = np.concatenate([k[0] for k in keep]).T @ d_us.reshape(-1, 3 * HIDDEN)
        xs = x.T.ravel()
        order = np.argsort(xs.astype(np.int16) if len(self.p["input"]) < 2**15 else xs, kind="stable")
        inputs, begin = np.unique(xs[order], return_index=True)
        grads["input"] = np.add.reduceat(d_in.reshape(-1, 3 * HIDDEN)[order], begin)
        classes = np.array(sorted(grads["word"]), dtype=np.int64)
        for k in ("word", "word_0"):
            grads[k] = np.stack([grads[k][c] for c in classes]) if len(classes) else np.zeros((0, *self.p[k].shape[1:]), h.dtype)
        n = int(on.sum())
        scale, rate = h.dtype.type(1 / n), RATE * n / (FIT_ROWS * WINDOW)
        for k, g in grads.items():
            at = {"input": inputs, "word": classes, "word_0": classes}.get(k, slice(None))
            g = g * scale
            m_at = m[k][at] * 0.9 + 0.1 * g
            v_at = v2[k][at] * 0.99 + 0.01 * (g * g)
            m[k][at], v2[k][at] = m_at, v_at
            self.p[k][at] -= rate * (m_at / (1 - 0.9**step)) / (np.sqrt(v_at / (1 - 0.99**step)) + 1e-6)
        return h, n

    # --- texts ---------------------------------------------------------------------------------------------------

    def input_of(self, word: bytes) -> int:
        return int(self.numbers([word])[0])

    def numbers(self, words: Sequence[bytes] | pa.Array) -> np.ndarray:
        """Outputs of words: head number, or HEAD and the tail class."""
        words = pa.array(words, pa.large_binary()) if not isinstance(words, pa.Array) else words
        n = places(words, self.head_words)
        return np.where(n < 0, self.head + tail_classes(words), n)

    def documents(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Outputs of each text's tokens."""
        words, ends = split(texts)
        n = self.numbers(words)
        return [n[i:j] for i, j in pairwise(ends.tolist())]

    def log_likelihoods(self, documents: list[np.ndarray]) -> np.ndarray:
        """log10 P of each document's outputs; the state is carried from its start to its end."""
        result = np.zeros(len(documents))
        order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
        start = self.input_of(END)
        for i in range(0, len(order), SCORE_ROWS):
            rows = order[i : i + SCORE_ROWS]
            sizes = np.array([len(documents[k]) for k in rows])
            h = np.zeros((len(rows), HIDDEN), dtype=np.float32)
            x = np.full(len(rows), start, dtype=np.int64)
            at = 0
            while at < sizes[0]:
                live = int((sizes > at).sum())
                # the fewer documents are left, the more of each is looked at together: the work stays near the tokens
                span = min(WINDOW * (SCORE_ROWS // live), int(sizes[0]) - at)
                y = np.full((live, span), -1, dtype=np.int64)
                for k in range(live):
                    own = documents[rows[k]][at : at + span]
                    y[k, : len(own)] = own
                at += span
                h = h[:live]
                states = np.empty((span, live, HIDDEN), dtype=np.float32)
                numbers = np.maximum(np.vstack([x[:live], y.T[:-1]]), 0)
                x = y[:, -1]
                for t in range(span):
                    h = self.advance(self.p["input"][numbers[t]], h)
                    states[t] = h
                on = y.T.ravel() >= 0
                logs = np.zeros(len(on))
                logs[on], _ = self.log_chances(states.reshape(-1, HIDDEN)[on], y.T.ravel()[on])
                result[rows[:live]] += logs.reshape(span, live).sum(axis=0)
        return result / np.log(10)

    def score(self, texts: list[str]) -> pd.DataFrame:
        """n_tokens, known, base, score of each text, as far as the lookup's counts go, and its other words with their numbers."""
        words, ends = split(texts)
        n, classes = places(words, self.words), tail_classes(words)
        there, starts = n >= 0, ends[:-1]
        out = self.head + classes
        out[there] = self.output[n[there]]
        counted = np.zeros(len(n))
        counted[there] = self.log_count[n[there]]
        tail = np.flatnonzero(out >= self.head)
        share = np.zeros(len(n))
        share[tail] = counted[tail] - self.tail_z[out[tail] - self.head]
        # words beyond the lookup, counted by text
        missing = np.flatnonzero(~there)
        rare = words.take(pa.array(missing)).dictionary_encode()
        kinds = max(1, len(rare.dictionary))
        keys, times = np.unique((np.searchsorted(ends, missing, "right") - 1) * kinds + rare.indices.to_numpy(), return_counts=True)
        cuts = list(pairwise(np.searchsorted(keys, np.arange(len(texts) + 1) * kinds).tolist()))
        rare, times = rare.dictionary.take(pa.array(keys % kinds)).to_pylist(), times.tolist()
        return pd.DataFrame({
            "n_tokens": np.diff(ends), "n_known": np.add.reduceat(there.astype(np.int64), starts),
            "base_score": np.add.reduceat(counted, starts) - np.diff(ends) * self.base_z,
            "score": np.add.reduceat(share, starts) + self.log_likelihoods([out[i:j] for i, j in pairwise(ends.tolist())]),
            "words": [rare[i:j] for i, j in cuts], "times": [times[i:j] for i, j in cuts],
        })


def frequent_words(counts: DataFrame, bound: int) -> list[tuple[bytes, int]]:
    """At most ``bound`` words (word, n), most frequent first: all those from a frequency on.

    Words are counted by frequency (in steps of a few per cent above 1,000, so in a few thousand rows) to find the
    least frequency with which they fit; only they come to the driver.
    """
    step = F.expr("CASE WHEN n <= 1000 THEN n ELSE 1000 + floor(32 * log2(n / 1000)) END").cast("long")
    least, words = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True):
        words += r["words"]
        if words > bound:
            break
        least = r["step"]
    if least is None:
        return []
    got = counts.where(step >= least).select("word", "n").toArrow()
    return sorted(zip(got["word"].to_pylist(), got["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


def _flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in weights.values()])


def _weights(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([v.size for v in like.values()])
    return {k: x.reshape(v.shape).astype(np.float32) for (k, v), x in zip(like.items(), np.split(flat, ends[:-1]), strict=True)}


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sum of w by block, weighted by n; only the sums of the task's blocks are held."""
    held: dict[int, list] = {}
    for batch in batches:
        for block, n, w in zip(batch["block"], batch["n"], batch["w"], strict=True):
            own = held.setdefault(block, [0.0, 0.0])
            own[0], own[1] = own[0] + n, own[1] + n * np.asarray(w, dtype=float)
    for block, (n, w) in held.items():
        yield pd.DataFrame({"block": [block], "n": [n], "w": [w]})


def _fit_pass(rows: DataFrame, shared, weights: dict[str, np.ndarray], tasks: int | None) -> tuple[dict[str, np.ndarray], float | None]:
    """Mean weights after each of ``tasks`` (None: no learning) has trained a copy of ``weights`` on its part of ``rows`` (text, judges), by tokens,
    and the judging texts' log likelihood under ``weights`` (None without such texts). Weights go through the shuffle in arrays
    of BLOCK and are summed as they come."""
    given = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, judge = copy.copy(shared.value), copy.copy(shared.value)
        judge.p = given.value
        model.p = {k: v.copy() for k, v in given.value.items()}
        held: list[np.ndarray] = []
        reached: list[float] = []

        def judged() -> None:
            reached.append(float(judge.log_likelihoods(held).sum()))
            held.clear()

        def learned() -> Iterator[np.ndarray]:
            for batch in batches:
                for chunk in _chunks(batch):
                    for document, judges in zip(model.documents(chunk["text"].tolist()), chunk["judges"], strict=True):
                        if not judges:
                            yield document
                            continue
                        held.append(document.copy())
                        if len(held) == SCORE_ROWS or sum(map(len, held)) > HELD:
                            judged()

        seen = model.train(learned())
        if held:
            judged()
        if reached:
            yield pd.DataFrame({"block": [-1], "n": [1.0], "w": [[sum(reached)]]})
        if seen:
            flat = _flat(model.p)
            for i in range(0, len(flat), BLOCK):
                yield pd.DataFrame({"block": [i // BLOCK], "n": [float(seen)], "w": [flat[i : i + BLOCK]]})

    texts = rows.where("judges") if tasks is None else rows.coalesce(tasks)
    trained = texts.mapInPandas(run, "block long, n double, w array<float>")
    got = trained.repartition("block").mapInPandas(_sums, "block long, n double, w array<double>").toArrow()
    given.unpersist()
    sums = {b: (n, w) for b, n, w in zip(*(got[c].to_pylist() for c in ("block", "n")), (np.asarray(w.values) for w in got["w"]), strict=True)}
    reached = float(sums[-1][1][0]) if -1 in sums else None
    own = [sums[b][1] / sums[b][0] for b in sorted(sums) if b >= 0]
    return _weights(np.concatenate(own), weights) if own else weights, reached


def fit_language_model(training: DataFrame, counts: DataFrame) -> LanguageModel:
    """Counts (word, n) of all of ``training`` give the vocabulary, and all its rows fit the network.

    In each pass every task trains a copy of the weights on its rows; their mean, by tokens, begins the next pass. There are
    as many tasks as leave each TOKENS_A_WEIGHT tokens for each weight, so the weights sent stay a share of the input. One
    row of JUDGES (by hash) only judges: the weights that serve these best, before the first or after any pass, stay. The
    driver gets at most LOOKUP of the most frequent words, one row per tail class, and one sum per weight. An empty table leaves the
    weights as they begin.
    """
    lookup = frequent_words(counts, LOOKUP)
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tail_n, tail_v = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    for r in counts.selectExpr(f"{_tail_class_sql()} AS c", "n").groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        tail_n[r["c"]], tail_v[r["c"]] = r["n"], r["v"]
    for w, n in lookup[: head_side(lookup) ** 2]:
        tail_n[tail_class(w) - HEAD_CLASSES] -= n
        tail_v[tail_class(w) - HEAD_CLASSES] -= 1
    model = LanguageModel(lookup, int(sums["n"]), int(sums["v"]), tail_n, tail_v)
    judges = F.pmod(F.xxhash64(id_text(), text_or_empty()), F.lit(JUDGES)) == JUDGES - 1
    rows = training.select(text_or_empty().alias("text"), judges.alias("judges"))
    shared = training.sparkSession.sparkContext.broadcast(model)
    weights, kept, best = model.p, model.p, None
    tasks = max(1, model.total // (TOKENS_A_WEIGHT * sum(v.size for v in weights.values())))
    for i in range(PASSES + 1):  # each pass judges the weights of the one before
        after, reached = _fit_pass(rows, shared, weights, tasks if i < PASSES else None)
        if reached is None or best is None or reached > best:
            kept, best = weights, reached
        weights = after
    model.p = kept
    return model


def likelihoods(docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``, learning from ``training``.

    Whole texts; a null text is empty and scores as one end. ``base_score`` is the smoothed unigram log10 likelihood
    by the exact counts of all of ``training``, ``score`` the model's. Without training every count is 0. Repeated rows
    get equal results; extra columns are not used; an empty table gives an empty result.

    Workers hold the counts of the LOOKUP most frequent words. Each document's other words go, with how often
    they occur, to a join with the full counts; adaptive execution may split a frequent one, and their sums return to
    the document by a row number given before.
    """
    counts = count_words(training)
    model = fit_language_model(training, counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            for chunk in _chunks(batch):
                yield pd.concat([chunk[["doc_id"]].reset_index(drop=True).astype({"doc_id": "Int64"}), own.score(chunk["text"].tolist())], axis=1)

    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double, words array<binary>, times array<long>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(run, schema)
    rows = materialise(rows.withColumn("uid", F.monotonically_increasing_id()))
    pairs = rows.select("uid", F.explode(F.arrays_zip("words", "times")).alias("w")).select("uid", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    more = (
        spread_join(pairs, counts, ["word"])
        .groupBy("uid").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    )
    return rows.join(more, "uid", "left").select(
        "doc_id", "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("logs", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("logs", F.lit(0.0))).alias("score"),
    )
