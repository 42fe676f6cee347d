"""Alignment of the tokens of two tokenizers by a dangling-suffix transducer.

Two token sequences of the same bytes are read side by side. The state is the side that leads and the
bytes by which it does, the residual. The other side's next token is taken: it shortens the residual or
turns it round. An empty residual closes a group, the shortest stretches of both sides with the same
bytes, and links the tokens that end there. Residuals are ends of vocabulary entries; transitions are
memoised by residual and token, and so are the pairs of tokens that close a group from the empty residual.

Linked tokens end together, so one of them is an ending of the other: the vocabularies alone give all
pairs that can be linked, at most as many as they have bytes together. Counts over the corpus are arrays
over these pairs, summed per task and then by pair, and small enough to broadcast whatever the corpus.

Side A reads a space and the text, strings of special tokens as plain text; side B reads the text and
adds that space. Defined cases: texts that are null or empty, or that a side doesn't give back byte by
byte, have no tokens; repeated rows count each; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialise, spread, table
from .packing import byte_bpe

#: Groups whose text is hashed at once, about.
HASHED = 1 << 16
ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pairs binary, times binary"
SPANS = "doc_id bigint, number bigint, start bigint, end bigint, a_ids array<int>, b_ids array<int>"
LINKED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def byte_level() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def entries_a(model: str) -> list[bytes]:
    """Bytes of each id of a byte-level BPE; added tokens, which plain text never gives, are their own text."""
    with open(model, encoding="utf-8") as file:
        known = json.load(file)
    table, plain = byte_level(), known["model"]["vocab"]
    added = {t["id"]: t["content"].encode() for t in known.get("added_tokens", [])}
    out = [b""] * (max([*plain.values(), *added]) + 1)
    for token, i in plain.items():
        out[i] = added.get(i) or bytes(table[c] for c in token)
    for i, token in added.items():
        out[i] = token
    return out


def entries_b(model: str) -> list[bytes]:
    """Bytes of each piece: U+2581 is a space, <0xHH> the byte HH."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
    return [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-Fa-f]{2}>", n) else n.replace("▁", " ").encode() for n in names]


class Transducer:
    """States are numbers: 0 the empty residual, else 2 x place in ``residuals`` plus 1 where side B leads."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.tokens = (a, b)
        self.names = tuple([str(i) for i in range(len(x))] for x in self.tokens)
        self.shift = len(b).bit_length()
        self.residuals, self.numbers = [b""], {}
        self.steps: dict[tuple[int, int], int] = {}
        self.closing: dict[int, str] = {}

    def state(self, side: int, residual: bytes) -> int:
        if not residual:
            return 0
        if (side, residual) not in self.numbers:
            self.numbers[side, residual] = 2 * len(self.residuals) + side
            self.residuals.append(residual)
        return self.numbers[side, residual]

    def step(self, state: int, token: int) -> int:
        """The state after the lagging side's next token; side A lags at the empty residual."""
        lead, residual = (state & 1, self.residuals[state >> 1]) if state else (1, b"")
        data = self.tokens[1 - lead][token]
        if residual.startswith(data):
            new = self.state(lead, residual[len(data) :])
        elif data.startswith(residual):
            new = self.state(1 - lead, data[len(residual) :])
        else:
            raise ValueError("the sides differ")
        self.steps[state, token] = new
        return new

    def groups(self, a: list[int], b: list[int]) -> Iterator[tuple[int, int, int, str]]:
        """(tokens of A and of B so far, the pair of ids that ends there, the group as text) of each group."""
        steps, closing, shift, names_a, names_b = self.steps, self.closing, self.shift, *self.names
        i = j = 0
        n = len(a)
        while i < n:
            x, y = a[i], b[j]
            pair = x << shift | y
            text = closing.get(pair)
            if text is not None:
                i += 1
                j += 1
                yield i, j, pair, text
                continue
            p, q = i, j
            state = steps.get((0, x))
            if state is None:
                state = self.step(0, x)
            i += 1
            while state:
                if state & 1:
                    x = a[i]
                    i += 1
                else:
                    x = b[j]
                    j += 1
                new = steps.get((state, x))
                state = self.step(state, x) if new is None else new
            text = f"{','.join([names_a[t] for t in a[p:i]])}|{','.join([names_b[t] for t in b[q:j]])}"
            pair = a[i - 1] << shift | b[j - 1]
            if i - p == j - q == 1:
                closing[pair] = text
            yield i, j, pair, text


def linkable(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """All pairs that can be linked, as id of A shifted and id of B, sorted: of two tokens one ends in the other."""
    shift = len(b).bit_length()
    by = []
    for side in (a, b):
        ids: dict[bytes, list[int]] = {}
        for i, token in enumerate(side):
            ids.setdefault(token, []).append(i)
        by.append(ids)
    found = set()
    for i, token in enumerate(a):
        found.update(i << shift | j for k in range(len(token)) for j in by[1].get(token[k:], ()))
    for j, token in enumerate(b):
        found.update(i << shift | j for k in range(len(token)) for i in by[0].get(token[k:], ()))
    return np.array(sorted(found), np.int64)


class Reader:
    """Ids of both sides of a text, none where a side doesn't give its bytes back."""

    def __init__(self, model_a: str, ranks_a: str, model_b: str):
        import sentencepiece

        self.encode_a = byte_bpe(model_a, ranks_a, plain=True)
        self.encode_b = sentencepiece.SentencePieceProcessor(model_file=model_b)
        self.transducer = Transducer(entries_a(model_a), entries_b(model_b))

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[int]]]:
        bytes_a, bytes_b = (side.__getitem__ for side in self.transducer.tokens)
        for text in texts:
            if text:
                data = f" {text}".encode()
                a = np.frombuffer(self.encode_a(f" {text}"), "<u4").tolist()
                b = self.encode_b.encode(text, num_threads=1)
                if b"".join(map(bytes_a, a)) == data and b"".join(map(bytes_b, b)) == data:
                    yield a, b
                    continue
            yield [], []


def aligned(read: Callable[[], Reader], pairs) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text) to ALIGNED; ``pairs`` is a broadcast of ``linkable``, whose places name the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known = read(), pairs.value
        for batch in batches:
            rows = []
            for doc_id, (a, b) in zip(batch.column(0).to_pylist(), reader(batch.column(1).to_pylist()), strict=True):
                links, names, hashed = [], [], hashlib.sha256()
                for _, _, pair, text in reader.transducer.groups(a, b):
                    links.append(pair)
                    names.append(text)
                    if len(names) > HASHED:  # the last group has no separator after it
                        last = names.pop()
                        hashed.update(f"{';'.join(names)};".encode())
                        names = [last]
                hashed.update(";".join(names).encode())
                n = len(links)
                ids, times = np.unique(np.array(links, np.int64), return_counts=True)
                rows.append((doc_id, len(a), len(b), n, hashed.hexdigest() if n else "", np.searchsorted(known, ids).astype("<i4").tobytes(), times.astype("<i4").tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in ALIGNED.split(", ")])

    return run


def spans(read: Callable[[], Reader]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, text) to SPANS; bytes are counted in the text with its leading space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = read()
        data = reader.transducer.tokens[0]
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for a, b in reader([text]):
                    rows, i, j, at = [], 0, 0, 0
                    for number, (p, q, _, _) in enumerate(reader.transducer.groups(a, b)):
                        end = at + sum(len(data[t]) for t in a[i:p])
                        rows.append((doc_id, number, at, end, a[i:p], b[j:q]))
                        i, j, at = p, q, end
                    kinds = (*[pa.int64()] * 4, *[pa.list_(pa.int32())] * 2)
                    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in SPANS.split(", ")])

    return run


def totals(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(pairs, times) to (pair, count), one row for each pair that the task's rows hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(size, np.int64)
        for batch in batches:
            pairs, times = (np.frombuffer(b"".join(c.to_pylist()), "<i4") for c in batch.columns)
            count += np.bincount(pairs, times, size).astype(np.int64)
        pairs = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int32)), pa.array(count[pairs])], names=["pair", "count"])

    return run


def linked(known) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """ALIGNED to LINKED; ``known`` is a broadcast of the pairs' counts and of whether each is the highest of its B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = known.value
        for batch in batches:
            pairs, times = (batch.column(c).to_pylist() for c in ("pairs", "times"))
            n = np.array([len(p) // 4 for p in pairs], np.int64)
            pairs, times = (np.frombuffer(b"".join(c), "<i4").astype(np.int64) for c in (pairs, times))
            ends = np.cumsum(n)
            columns = {c: batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")}
            for name, values in (("n_links", times), ("n_best", times * best[pairs]), ("count_sum", times * count[pairs])):
                sums = np.concatenate([[0], np.cumsum(values)])
                columns[name] = pa.array(sums[ends] - sums[ends - n])
            names = [c.split()[0] for c in LINKED.split(", ")]
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return run


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def _paths(model_a: str | None, ranks_a: str | None, model_b: str | None) -> tuple[str, str, str]:
    import public_tokenizers

    given = (model_a, ranks_a, model_b)
    return tuple(p or public_tokenizers.path(n) for p, n in zip(given, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"), strict=True))


def groups(docs: DataFrame, model_a: str | None = None, ranks_a: str | None = None, model_b: str | None = None) -> DataFrame:
    """SPANS: every group of every document with its bytes and the ids of both sides."""
    paths = _paths(model_a, ranks_a, model_b)
    return map_arrow(_plain(docs), spans(lambda: Reader(*paths)), SPANS)


def align(docs: DataFrame, model_a: str | None = None, ranks_a: str | None = None, model_b: str | None = None) -> DataFrame:
    """LINKED: tokens, groups and links of every document, links weighed by their counts over all documents."""
    spark, paths = docs.sparkSession, _paths(model_a, ranks_a, model_b)
    b = entries_b(paths[2])
    pairs = linkable(entries_a(paths[0]), b)
    rows = map_arrow(_plain(docs), aligned(lambda: Reader(*paths), spark.sparkContext.broadcast(pairs)), ALIGNED)
    rows = materialise(rows, "aligned")
    summed = map_arrow(rows.select("pairs", "times"), totals(len(pairs)), "pair int, count bigint").groupBy("pair").agg(F.sum("count").alias("count"))
    found = summed.toArrow()  # at most as many rows as the vocabularies have bytes
    count = np.zeros(len(pairs), np.int64)
    count[found.column("pair").to_numpy()] = found.column("count").to_numpy()
    highest, side = np.zeros(len(b), np.int64), pairs & ((1 << len(b).bit_length()) - 1)
    np.maximum.at(highest, side, count)
    return map_arrow(rows, linked(spark.sparkContext.broadcast((count, count == highest[side]))), LINKED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spread(table(spark, sf_dir, "documents")))
