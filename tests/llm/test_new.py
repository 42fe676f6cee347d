"""Filter audit, tokenizer alignment and top-k search against plain versions, and texts of long runs in the token operators."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from scorefold.llm import alignment, filter_audit, packing, token_counts, topk_search

SCHEMA = "doc_id bigint, text string, source string, part string, `row` string, stopped int, label string, `set` int"
EXTRA = ("p", "r", 1, "l", 2)


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(n))


TEXTS = [
    words(1, 80), words(1, 80), None, "", " \n\t", words(2, 60) + " # ", "A B " * 100, words(3, 200).upper(), words(4, 30), "$", None,
    "x\x0by\x0cz " * 30, "one two " * 60, words(5, 70) + " É", "Привет мир " * 20, "  spaces   in    runs", "日本語 text", "a\r\nb", "▁x", "<0x41> <|endoftext|>",
]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, [None, "", "s1", "s2"][i % 4], *EXTRA) for i, t in enumerate(TEXTS)]
    # repeated rows, null ids with a known and a new text, one id with two texts
    return [*out, out[0], out[6], (None, TEXTS[0], "s1", *EXTRA), (None, "only here", "s2", *EXTRA), (None, "only here", "s2", *EXTRA), (3, words(9, 90), "s1", *EXTRA)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


LABELS = [(0, 1, 0), (1, 0, 1), (1, 1, None), (6, None, 1), (7, 1, 1), (None, 1, 1), (99, 1, 1), (8, 1, 0)]


def test_audit_equals_a_walk_of_every_order(spark, docs, rows):
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs, labels).collect()}
    good = {i for i, q, _ in LABELS if q == 1 and i is not None}
    toxic = {i for i, _, x in LABELS if x == 1 and i is not None}
    key = lambda i: float("inf") if i is None else i
    first = {}
    for i, t, *_ in rows:
        first[t or ""] = min(first.get(t or "", key(i)), key(i))
    fails = []
    for i, t, source, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": first[t] < key(i)}
        fails.append((source or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    assert any({"A", "D"} <= f for _, f, *_ in fails) and any("E" in f for _, f, *_ in fails) and any("C" in f for _, f, *_ in fails)
    want, total = {}, Counter()
    for part in {p for p, *_ in fails}:
        mine = [x for x in fails if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[1]]
                left = [x for x in left if name not in x[1]]
                failing = sum(name in x[1] for x in mine)
                total[part, name] += len(gone)
                want[part, order, step] = [len(left), len(gone), failing - len(gone), sum(x[1] == {name} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    assert found == {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in want.items()}


def test_audit_equals_its_sql(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(filter_audit.ORACLE_SQL).df()
    found = filter_audit.query(spark, str(tmp_path)).toPandas()[want.columns]
    plain = lambda df: sorted(map(tuple, df.itertuples(index=False)))
    assert plain(found) == plain(want)


def test_audit_of_hot_texts_and_parts_and_of_nothing(spark, none):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', concat('t', id)) as text", "if(id % 2 = 0, 'hot', cast(id as string)) as source")
    found = filter_audit.audit(df.repartition(5), labels).where("filter_order = 'EABCD' AND step = 1").collect()
    assert len(found) == 1501
    hot = next(r for r in found if r.part == "hot")
    assert (hot.kept, hot.removed, hot.unique_fails) == (1001, 499, 0)
    assert sum(r.removed for r in found) == 999


@pytest.fixture(scope="module")
def tokenizers():
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    full.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    from tokenizers.decoders import ByteLevel

    level = ByteLevel()

    def a(text):
        ids = full.encode(f" {text}", add_special_tokens=False).ids
        table = alignment.byte_level()
        return ids, [bytes(table[c] for c in full.id_to_token(i)) for i in ids], level

    def b(text):
        ids = pieces.encode(text)
        byte = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
        return ids, [byte(pieces.id_to_piece(i)) for i in ids]

    return a, b


def test_alignment_equals_common_offsets(docs, none, rows, tokenizers):
    a, b = tokenizers
    plans, count = [], Counter()
    for i, t, *_ in rows:
        groups = []
        ids_a, data_a, ids_b, data_b = [], [], [], []
        if t:
            ids_a, data_a, _ = a(t)
            ids_b, data_b = b(t)
            if b"".join(data_a) != b"".join(data_b) or b"".join(data_a) != f" {t}".encode():
                ids_a, data_a, ids_b, data_b = [], [], [], []
        ends_a, ends_b = (np.cumsum([len(x) for x in d]).tolist() if d else [] for d in (data_a, data_b))
        p = q = 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((ids_a[p:x], ids_b[q:y]))
            p, q = x, y
        links = [(x[-1], y[-1]) for x, y in groups]
        count.update(links)
        plans.append((i, len(ids_a), len(ids_b), groups, links))
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    text = lambda gs: ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in gs)
    want = Counter(
        (i, na, nb, len(gs), len(ls), sum(count[k] == top[k[1]] for k in ls), sum(count[k] for k in ls), hashlib.sha256(text(gs).encode()).hexdigest() if gs else "")
        for i, na, nb, gs, ls in plans
    )
    assert Counter(map(tuple, alignment.align(docs).collect())) == want
    assert any(na == 0 for _, na, *_ in plans[3:]) and any(len(gs) < min(na, nb) for _, na, nb, gs, _ in plans)
    assert alignment.align(none).count() == 0
    spans = {}
    for r in alignment.groups(docs).collect():
        spans.setdefault(r.doc_id, []).append((r.number, r.start, r.end, r.a_ids, r.b_ids))
    one = next(x for x in plans if x[0] == 15)
    assert [(x, y) for *_, x, y in sorted(spans[15])] == one[3] and max(s[2] for s in spans[15]) == len(f" {TEXTS[15]}".encode())


def test_long_groups_are_hashed_whole(monkeypatch):
    monkeypatch.setattr(alignment, "HASHED", 3)
    import pyarrow as pa

    class Held:
        value = alignment.linkable(alignment.entries_a(PATHS[0]), alignment.entries_b(PATHS[2]))

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["one two three four five six", "one two three"])], names=["doc_id", "text"])
    reader = alignment.Reader(*PATHS)
    for row, text in zip(next(alignment.aligned(lambda: reader, Held)(iter([batch]))).to_pylist(), batch.column(1).to_pylist(), strict=True):
        names = [t for *_, t in reader.transducer.groups(*next(reader([text])))]
        assert row["groups_sha256"] == hashlib.sha256(";".join(names).encode()).hexdigest()


PATHS = tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))
LONG = [" " * 200_000 + "x", "\n" * 200_000 + "x", " " * 5000 + "x", "a" * 200_000, "ab" * 100_000, "=" * 100_000, " \n" * 50_000 + "x <|endoftext|>"]


@pytest.mark.parametrize("plain", [False, True])
def test_ids_of_long_runs_are_those_of_the_models_tokenizer(plain):
    full = Tokenizer.from_file(PATHS[0])
    full.encode_special_tokens = plain
    ids = packing.byte_bpe(*PATHS[:2], plain=plain)
    for text in LONG:
        assert np.frombuffer(ids(text), "<u4").tolist() == full.encode(text, add_special_tokens=False).ids, text[:5]


def test_long_runs_are_packed_and_aligned(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([" " * 1_000_000 + "x", *LONG[1:]])], "doc_id bigint, text string")
    assert packing.pack_documents(df).where("doc_id = 0").count() > 900
    assert all(r.n_groups > 0 or r.doc_id in (2,) for r in alignment.align(df).collect())


def test_token_counts_of_long_words_equal_a_plain_walk():
    vocabulary = token_counts.read_vocabulary(PATHS[1])
    known, most = set(vocabulary), max(map(len, vocabulary))

    def plain(word: bytes) -> int:
        data, n, i = b" " + word, 0, 0
        while i < len(data):
            i += next(k for k in range(min(most, len(data) - i), 0, -1) if data[i : i + k] in known)
            n += 1
        return n

    r = random.Random(4)
    inputs = [b"a" * 3000, b"ab" * 2000, b"=" * 5001, b"-" * 257, b"a" * 256, b"x", bytes(r.choices(b"abcdef", k=4000)), "é".encode() * 900, b"aaab" * 700 + b"b", b"=" * 255 + b"a" * 300, b"-=" * 600 + b"-" * 600]
    buffer = np.frombuffer(b"\n".join(inputs) + b"\n", np.uint8)
    length = np.array([len(w) for w in inputs])
    start = np.cumsum([0, *(length + 1)])[:-1]
    assert token_counts.Automaton(vocabulary).count(buffer, start, length).tolist() == [plain(w) for w in inputs]


def plain_search(rows, k=5):
    usable = []
    for n, (i, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v):
            usable.append((n, i, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = Counter()
    for n, i, q in usable:
        if i is None or i % 50:
            continue
        scores = [(-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j if j is not None else 0) for m, j, v in usable if m != n and len(v) == len(q)]
        out.update((i, rank, None if null else j, -s) for rank, (s, null, j) in enumerate(sorted(scores)[:k], 1))
    return out


@pytest.mark.parametrize("dim", [1, 7, 64])
def test_search_equals_brute_force(spark, monkeypatch, dim):
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(6, dim))
    rows = [(i, (centres[i % 6] * (i % 3 > 0) + rng.normal(size=dim) * 0.3).astype(np.float32).tolist()) for i in range(700)]
    rows[100] = (100, rows[50][1])  # copies
    rows += [(i, rows[7][1]) for i in range(700, 760)] + [(150, rows[3][1]), (None, rows[7][1]), (None, rows[8][1])]
    rows += [(800, None), (850, []), (900, [None] * dim), (950, [float("nan")] * dim), (1000, [float("inf")] * dim), (1050, rows[1][1][:-1] if dim > 1 else [0.5] * 2), (1051, [0.0] * dim), (1100, [0.0] * dim)]
    for name, value in (("STEP", 64), ("BLOCK", 8), ("DENSE", 0.3 if dim == 7 else 0.1)):
        monkeypatch.setattr(topk_search, name, value)
    schema = "vec_id bigint, embedding array<float>, `row` string, score double, id int, kind int"
    df = spark.createDataFrame([(*r, "r", 0.5, 1, 1) for r in rows], schema).repartition(3)
    from pyspark.sql import functions as F

    found = topk_search.top_k(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, queries=4).collect()
    assert Counter(map(tuple, found)) == plain_search(rows)
    assert topk_search.top_k(df.where("false"), "vec_id", "embedding", F.col("vec_id") % 50 == 0).count() == 0


def test_search_keeps_large_components_exact(spark):
    from pyspark.sql import functions as F

    rows = [(i, [float(np.float32((-1) ** i * 3.1e4 * (i + 1))), float(np.float32(1e7 + i)), 0.25]) for i in range(0, 60, 5)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = topk_search.top_k(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0).collect()
    assert Counter(map(tuple, found)) == plain_search(rows)


def test_fewer_than_k_candidates(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0, [1.0, 2.0]), (3, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in topk_search.top_k(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 3, 256 * 256 * 3)]
    alone = topk_search.top_k(df.where("vec_id = 0"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)
    assert alone.count() == 0
