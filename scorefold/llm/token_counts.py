"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie of byte strings. Every node has a failure link and the number of pieces
that are popped when it is followed; both are computed once, breadth first. A word is then counted
in time linear in its length, and no piece is ever built. Distinct words of a batch, and distinct
segments of long ones, run through the automaton side by side in numpy, one byte per step.

A word is a run of bytes that aren't ASCII white space, with one space before it. Every single byte
must be in the vocabulary, so each word has pieces. Defined cases: null and blank texts have no
words and no pieces; repeated rows are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, spread, table
from .words import chunks, word_spans

#: Words of more bytes are cut into segments of so many.
SEGMENT = 256


class Automaton:
    """Arrays of the trie: sorted transition keys (node x 256 + byte) and targets, failure, popped, rest."""

    def __init__(self, vocabulary: list[bytes]):
        children: list[dict[int, int]] = [{}]
        piece = [False]
        for token in vocabulary:
            node = 0
            for byte in token:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    piece.append(False)
                node = children[node][byte]
            piece[node] = True
        if len(children[0]) < 256 or not all(piece[n] for n in children[0].values()):
            raise ValueError("the vocabulary must hold every single byte")
        failure, popped, rest = ([0] * len(children) for _ in range(3))
        queue = [0]
        for node in queue:
            for byte, child in children[node].items():
                if piece[child]:
                    popped[child] = 1
                else:
                    back, count = failure[node], popped[node]
                    while byte not in children[back]:
                        count += popped[back]
                        back = failure[back]
                    failure[child], popped[child] = children[back][byte], count
                rest[child] = popped[child] + rest[failure[child]]
                queue.append(child)
        keys = np.array([n << 8 | b for n, c in enumerate(children) for b in c], np.int64)
        targets = np.array([t for c in children for t in c.values()], np.int32)
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], targets[order]
        self.failure, self.popped, self.rest = (np.array(x, np.int32) for x in (failure, popped, rest))

    def count(self, buffer: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Pieces of each word ``buffer[start : start + length]``, a space before it.

        Words of up to SEGMENT bytes run side by side. Longer ones are cut into segments, and of each distinct
        segment the runs (start state to end state and popped pieces) are composed: all run from the root, then
        from each state that a segment before them ends in, until no start state is new. A state is an ending of the
        bytes read, so a segment has no more of them than the longest piece has bytes, and mostly one or two.
        """
        space = self.targets[np.searchsorted(self.keys, 32)]
        out = np.empty(len(start), np.int64)
        short = length <= SEGMENT
        state, popped = self._run(buffer, start[short], length[short], np.full(short.sum(), space, np.int64))
        out[short] = popped + self.rest[state]
        long = np.flatnonzero(~short)
        if len(long):
            out[long] = self._count_long(buffer, start[long], length[long], int(space))
        return out

    def _count_long(self, buffer: np.ndarray, start: np.ndarray, length: np.ndarray, space: int) -> np.ndarray:
        many = -(-length // SEGMENT)
        word = np.repeat(np.arange(len(start)), many)
        nth = np.arange(len(word)) - (np.cumsum(many) - many)[word]
        at, size = start[word] + nth * SEGMENT, np.minimum(length[word] - nth * SEGMENT, SEGMENT)
        # equal whole segments are one; the last one of a word is its own
        whole = np.flatnonzero(size == SEGMENT)
        bytes_of = np.lib.stride_tricks.sliding_window_view(buffer, SEGMENT)[at[whole]].view(f"V{SEGMENT}").ravel()
        _, sample, which = np.unique(bytes_of, return_index=True, return_inverse=True)
        rest = np.flatnonzero(size < SEGMENT)
        content = np.empty(len(word), np.int64)
        content[whole], content[rest] = which, len(sample) + np.arange(len(rest))
        shown = np.concatenate([whole[sample], rest])  # a place of each content
        inner = np.flatnonzero(nth + 1 < many[word])
        follow = np.unique(np.stack([content[inner], content[inner + 1]], 1), axis=0)
        nodes = len(self.failure)
        todo = np.unique(np.concatenate([np.arange(len(shown)) * nodes, content[nth == 0] * nodes + space]))
        runs: dict[int, tuple[int, int]] = {}
        while len(todo):
            here, entry = np.divmod(todo, nodes)
            leave, popped = self._run(buffer, at[shown[here]], size[shown[here]], entry)
            runs.update(zip(todo.tolist(), zip(leave.tolist(), popped.tolist(), strict=True), strict=True))
            first, last = (np.searchsorted(follow[:, 0], here, side) for side in ("left", "right"))
            n = last - first
            after = follow[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum()), 1]
            new = np.unique(after * nodes + np.repeat(leave, n))
            todo = np.array([k for k in new.tolist() if k not in runs], np.int64)
        total, state = np.zeros(len(start), np.int64), space
        for w, k, c in zip(word.tolist(), nth.tolist(), content.tolist(), strict=True):
            state, popped = runs[c * nodes + (state if k else space)]
            total[w] += popped
            if k + 1 == many[w]:
                total[w] += self.rest[state]
        return total

    def _run(self, buffer: np.ndarray, start: np.ndarray, length: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, popped pieces) after each run of bytes from the state ``entry``, all runs a byte per step."""
        total = np.zeros(len(start), np.int64)
        state = entry.copy()
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        for step in range(int(length[0]) if len(length) else 0):
            going = order[: np.searchsorted(-length, -step, "left")]  # longer than step
            byte = buffer[start[: len(going)] + step].astype(np.int64)
            waiting = np.arange(len(going))
            while len(waiting):
                words = going[waiting]
                key = state[words] << 8 | byte[waiting]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                found = self.keys[at] == key
                state[words[found]] = self.targets[at[found]]
                waiting, words = waiting[~found], words[~found]
                total[words] += self.popped[state[words]]
                state[words] = self.failure[state[words]]
        return state, total


def read_vocabulary(path: str) -> list[bytes]:
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines]


def token_counts(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n_words, n_tokens, n_bytes of every document."""
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(vocabulary))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in chunks(texts):
                n = part.stop - part.start
                buffer, start, end, hashes, owner = word_spans(texts[part])
                _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
                pieces = automaton.value.count(buffer, start[first], (end - start)[first])[which]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part.start : part.stop],
                        pa.array(np.bincount(owner, minlength=n)),
                        pa.array(np.bincount(owner, pieces, n).astype(np.int64)),
                        pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts[part]], pa.int64()),
                    ],
                    names=["doc_id", "n_words", "n_tokens", "n_bytes"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_arrow(rows, run, "doc_id bigint, n_words bigint, n_tokens bigint, n_bytes bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spread(table(spark, sf_dir, "documents")), read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")))
