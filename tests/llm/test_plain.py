"""Operators against plain versions of their method, and the registered queries on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorefold.llm import fingerprints, language, mixing, quality, queries, sharding, toxicity


def prose(seed: int, n: int = 60) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Null and repeated ids, ties, repeated rows, null, empty and long texts, clashing columns; labels with nulls and repeats."""
    texts = [prose(1), prose(1), None, "", " \n", "one two", prose(2, 9000), prose(3), "x" * 30_000, "    a", "12 34 !!", *[prose(i) for i in range(10, 40)]]
    rows = [(i, t, "xy"[i % 2] if i % 5 else None, f"s{i % 3}" if i % 7 else None, 1, "c", "d", "e") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, prose(3), "x", "s1", 1, "c", "d", "e"), (None, "no id", "y", "s1", 1, "c", "d", "e"), (5, "another text of five", "x", "s2", 1, "c", "d", "e")]
    path = str(tmp_path_factory.mktemp("odd"))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, `row` string, block string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, i % 2, (i // 2) % 2) for i in range(40)] + [(None, 1, 1), (3, None, None), (4, 1, 1), (4, 0, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_a_row_for_each_odd_document(spark, folder, name):
    path, rows = folder
    found = queries.QUERIES[name](spark, path).collect()
    if name.startswith(("op3", "op5")):  # pieces; a stream within a budget
        assert {r.doc_id for r in found} <= {r[0] for r in rows} and len(found) >= len(rows) - 5
    else:
        assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    for column in ("score", "near_edited", "near_next"):
        assert all(0 <= r[column] <= 1 for r in found if column in r)
    if name.startswith("op8"):
        plain = {i: t for i, t, *_ in rows}
        assert all(r.lang_pred == "und" for r in found if r.doc_id not in (None, 5, 7) and not re.search(r"[^\W\d_]", plain[r.doc_id] or ""))


@pytest.mark.parametrize("epsilon", [0.0, 0.25])
def test_ring_equals_a_walk_row_by_row(spark, epsilon):
    df = spark.range(600).select((F.col("id") * 7).alias("doc_id")).withColumn("place", F.xxhash64("doc_id"))
    points, owners = sharding.ring(7, 16)
    arcs = {}
    for r in sorted(df.collect(), key=lambda r: (r.place, r.doc_id)):
        arcs.setdefault(int(np.searchsorted(points, r.place)) % len(points), []).append(r.doc_id)
    room, used, want = sharding.capacities(600, 7, epsilon).tolist(), [0] * 7, {}
    waiting = [(arc, arc, n, doc) for arc, docs in arcs.items() for n, doc in enumerate(docs)]
    while waiting:
        left = []
        for at, arc, n, doc in sorted(waiting):
            shard = owners[at]
            if room[shard]:
                want[doc] = (shard, used[shard])
                room[shard] -= 1
                used[shard] += 1
            else:
                left.append((at, arc, n, doc))
        step = lambda at: next((at + i) % len(owners) for i in range(1, len(owners) + 1) if room[owners[(at + i) % len(owners)]])
        waiting = [(step(at), arc, n, doc) for at, arc, n, doc in left]
    found = sharding.bounded_ring(df.select("doc_id"), ["doc_id"], 7, 16, epsilon).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in found} == want


def test_one_more_shard_moves_a_limited_share_at_exact_balance(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"))
    before, after = ({r.doc_id: r.shard for r in sharding.bounded_ring(df, ["doc_id"], n).collect()} for n in (40, 41))
    moved = sum(before[i] != after[i] for i in before) / len(before)
    assert moved < 0.1  # 1/41 is the least, 0.042 was measured on sf0.1


def test_noisy_or_equals_the_plain_product():
    sample = [(f"{prose(i, 30)}. {'zorkel blarg' if i % 2 else 'hello there'} {prose(i + 500, 5)}!", i % 2) for i in range(80)]
    model = toxicity.fit(sample)
    for text, _ in sample[:20]:
        rest = 1.0
        for sentence in re.findall(r"[^.!?\n]+[.!?]*", text):
            z = model.bias + sum(model.weights.features.get(f, 0.0) for w in set(re.findall(r"\w+", sentence)) for f in toxicity.parts(w))
            rest *= 1 - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        assert abs(model.score(text)[0] - (1 - rest)) < 1e-9


def test_machine_equals_the_sum_over_all_pairs():
    machine = quality.FactorisationMachine()
    machine.w = np.random.default_rng(1).normal(0, 1, len(machine.w))
    texts = [prose(i, 25) for i in range(4)] + [""]
    text, feature, value = quality.features(texts)
    got = machine.raw(text, feature, value, len(texts))[0]
    for t in range(len(texts)):
        f, x = feature[text == t], value[text == t]
        pairs = sum(machine.v[f[i]] @ machine.v[f[j]] * x[i] * x[j] for i in range(len(f)) for j in range(i))
        assert abs(got[t] - (machine.bias + machine.w[f] @ x + pairs)) < 1e-9


def test_sketch_is_the_bottom_k_of_all_shingle_hashes(spark):
    texts = [prose(i, n) for i, n in enumerate((300, 90, 3, 0, 400))]
    df = fingerprints.with_words(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text", "words")
    found = {r.id: r.s for r in df.select("id", fingerprints.sketch(F.col("words"), 32).alias("s")).collect()}
    wide = [(i, *(w[j : j + 5])) for i, t in enumerate(texts) for w in [t.split()] for j in range(len(w) - 4)]
    hashes = {}
    for r in spark.createDataFrame(wide, "id int, a string, b string, c string, d string, e string").select("id", F.xxhash64(*"abcde").alias("h")).collect():
        hashes.setdefault(r.id, set()).add(r.h)
    for i in (0, 1, 4):
        assert found[i] == sorted(hashes[i])[:32]
    assert len(found[2]) == 1 and found[3] == []
    grouped = df.select((F.col("id") % 2).alias("g"), fingerprints.sketch(F.col("words"), 32).alias("s"))
    merged = {r.g: r.s for r in fingerprints.merge_groups(grouped, ["g"], "s", 32).collect()}
    assert merged[1] == sorted(hashes[1])[:32] and merged[0] == sorted({*found[0], *found[2], *found[4]})[:32]


def test_containment_of_a_part_in_the_whole(spark):
    whole = prose(77, 900)
    part = " ".join(whole.split()[200:500])
    df = fingerprints.with_words(fingerprints.with_words(spark.createDataFrame([(part, whole)], "p string, w string"), "p", "pw"), "w", "ww")
    pair = df.select(fingerprints.sketch(F.col("pw")).alias("p"), fingerprints.sketch(F.col("ww")).alias("w"))
    inside, around = pair.select(fingerprints.containment(F.col("p"), F.col("w")), fingerprints.containment(F.col("w"), F.col("p"))).first()
    assert inside > 0.7 and abs(around - 296 / 896) < 0.15


def test_stream_is_whole_epochs_up_to_each_budget(spark):
    r = random.Random(4)
    rows = [(i, prose(i, r.randint(1, 80)), s) for i, s in enumerate(["a"] * 120 + ["b"] * 25 + [None] * 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    size = {i: len(t.split()) for i, t, _ in rows}
    budget = sum(size.values())
    stream = mixing.mix(docs, ["doc_id"], budget).collect()
    totals = [sum(size[i] for i, _, s in rows if s == source) for source in ("a", "b", None)]
    _, shares, _ = mixing.weights(totals, budget)
    for source, total, share in zip(("a", "b", None), totals, shares, strict=True):
        own = [x for x in stream if x.source == source]
        spent, ids = sum(size[x.doc_id] for x in own), {i for i, _, s in rows if s == source}
        assert share * budget <= spent + 1e-6 and spent < share * budget + 80
        last = max(x.epoch for x in own)
        assert last == math.ceil(share * budget / total - 1e-9) - 1
        for epoch in range(last + 1):
            seen = Counter(x.doc_id for x in own if x.epoch == epoch)
            assert max(seen.values()) == 1 and (epoch == last or set(seen) == ids)


def test_sizes_stand_for_sources_and_joins_for_broadcasts(spark, monkeypatch):
    counts = [5, 5, 5, 90, 90, 1000, 0]
    one = mixing.weights(counts, 700)
    many = mixing.weights([0, 5, 90, 1000], 700, many=[1, 3, 2, 1])
    assert many[0] == pytest.approx(one[0]) and many[2] == one[2]
    assert [many[1][[0, 5, 90, 1000].index(c)] for c in counts] == pytest.approx(one[1])
    rows = [(i, " ".join(["w"] * (i % 7)), f"s{i % 40}" if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    want = Counter(map(tuple, mixing.mix(df, ["doc_id"], 900).collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 1)
    assert Counter(map(tuple, mixing.mix(df, ["doc_id"], 900).collect())) == want


def test_whole_queries_equal_plain_values(spark, folder):
    """What op1, op2 and op8 say of every row, from the rows alone."""
    path, rows = folder
    texts = [(r[0], r[1] or "") for r in rows]
    found = queries.QUERIES["op2_sharding"](spark, path).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in found) == Counter((i, len(t.encode()) + 16, zlib.crc32(t.encode()), "rows", None) for i, t in texts)
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1

    known = [(i, t) for i, t in texts if i is not None and i not in (5, 7)]  # ids that occur once
    ordered = sorted({i for i, _ in texts if i is not None}, reverse=True)
    by = dict(known)
    one = {r.doc_id: r for r in queries.QUERIES["op1_fingerprints"](spark, path).collect() if r.doc_id in by}
    prints = {}
    for i, t in known:
        assert one[i].n_chars == len(t)
        assert prints.setdefault(t, one[i].fingerprint) == one[i].fingerprint
        after = ordered[ordered.index(i) + 1] if ordered.index(i) + 1 < len(ordered) else None
        if after in by:
            half = len(t) // 2
            edited = t[: len(t) - half] + by[after][:half]
            assert one[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert (one[i].edited_fingerprint == one[i].fingerprint) or edited != t
            assert one[i].near_next == 1 or t.split() != by[after].split()
    assert len(set(prints.values())) > 20

    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = language.fit(language.sample(docs))

    def plain(text):
        if not re.search(r"[^\W\d_]", text):
            return "und", 0.0
        data, mass = text.encode(), np.zeros(len(model.languages))
        for at in range(0, len(data), language.WINDOW):
            window = np.frombuffer(data[at : at + language.WINDOW].ljust(language.WINDOW, b"\0"), np.uint8)
            seen = model.embedding[window]
            hidden = [max(sum(seen[p + j] @ kernel[j][:, f] for j in range(width)) for p in range(language.PLACES)) for width, kernel in zip(language.WIDTHS, model.filters, strict=True) for f in range(language.FILTERS)]
            z = np.maximum(hidden, 0) @ model.out + model.bias
            e = np.exp(z - z.max())
            mass += e / e.sum() * min(language.WINDOW, len(data) - at)
        return model.languages[int(mass.argmax())], float(mass.max() / mass.sum())

    short = {i: t for i, t in known if len(t) < 600}
    for r in queries.QUERIES["op8_language"](spark, path).collect():
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id in short and r.doc_id % 3 == 0:
            name, score = plain(short[r.doc_id])
            assert r.score == pytest.approx(score, abs=1e-4) and (r.lang_pred == name or abs(score - 0.5) < 1e-4)
