"""Small tables with nulls, empty and long texts, ties, repeated rows, no rows and clashing columns; plain brute force."""

import base64
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from scorefold.llm import exact_dedup, fingerprints, language, mixing, near_dedup, packing, quality, sharding, token_counts, toxicity, words

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `_rank` string, `label` string, `place` string"


def text(seed: int, n: int = 60) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def rows():
    base = text(1)
    near = base.replace(base.split()[30], "other", 1)
    texts = [base, base, near, None, "", " \n ", "one two", "one\ttwo", text(2, 8000), text(3), None, text(4) * 2]
    out = [(i, t, "en" if i % 2 else None, None if i == 5 else f"s{i % 3}", 1, "x", "y", "z") for i, t in enumerate(texts)]
    return [*out, out[9], (None, "no id here at all", "en", "s0", 1, "x", "y", "z")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, none, rows):
    found = exact_dedup.exact_dedup(docs).collect()
    by = {}
    for i, t, *_ in rows:
        by.setdefault(exact_dedup_key(t), []).append(i)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in found) == Counter(
        (i, min((x for x in ids if x is not None), default=None), len(ids)) for ids in by.values() for i in ids
    )
    assert sum(r.kept for r in found) == len(by)
    assert exact_dedup.exact_dedup(none).count() == 0


def exact_dedup_key(t):
    import re

    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def test_exact_dedup_compares_bytes_where_digests_clash(docs):
    from pyspark.sql import functions as F

    plain = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs.where("doc_id is not null")).collect()}
    weak = exact_dedup.exact_dedup(docs.where("doc_id is not null"), digest=lambda t: F.substring(exact_dedup.sha256(t), 1, 1))
    assert {(r.doc_id, r.keep_id, r.group_size) for r in weak.collect()} == plain


def test_exact_dedup_goes_on_from_its_state(spark, docs):
    dedup = exact_dedup.StreamingDeduplicator(spark)
    dedup.ingest(docs.where("doc_id < 5"))
    dedup.ingest(docs.where("doc_id >= 5"))
    with pytest.raises(ValueError):  # rows in memory have no locator
        dedup.resolve()
    once = exact_dedup.exact_dedup(docs.where("doc_id is not null"))
    found = dedup.resolve(docs.where("doc_id is not null"))
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in found.collect()) == sorted((r.doc_id, r.keep_id, r.group_size) for r in once.collect())


def test_exact_dedup_reads_hits_through_their_locators(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    parts = [docs.where("doc_id < 5"), docs.where("doc_id >= 5"), docs.where("doc_id is null")]
    weak = lambda t: F.substring(exact_dedup.sha256(t), 1, 1)
    dedup = exact_dedup.StreamingDeduplicator(spark, digest=weak)
    for i, part in enumerate(parts):
        part.write.parquet(f"{tmp_path}/{i}")
        dedup.ingest(spark.read.parquet(f"{tmp_path}/{i}"))
    rows = lambda df: Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect())
    assert rows(dedup.resolve()) == rows(exact_dedup.exact_dedup(docs))


@pytest.mark.parametrize("stage", [exact_dedup.stage, near_dedup.stage, mixing.stage])
def test_stages_leave_clashing_columns_alone(spark, stage, tmp_path):
    names = ["kept_id", "bytes", "copy", "_id", "_times", "_copy", "_row", "row", "digest", "block", "position", "text_sha256", "locator"]
    data = [(i, text(i // 2, 40), "en", f"s{i % 2}", 1, *[f"{n}{i}" for n in names]) for i in range(8)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(data, schema)
    want = set(data) if stage is mixing.stage else {r for r in data if r[0] % 2 == 0}
    docs.write.parquet(f"{tmp_path}/docs")
    for docs in (docs, spark.read.parquet(f"{tmp_path}/docs")):
        assert {tuple(r) for r in stage(spark, docs, "").collect()} == want


def test_only_reads_of_whole_files_are_not_written_again(spark, docs, tmp_path):
    from scorefold.llm.common import whole_read

    docs.repartition(3).write.parquet(f"{tmp_path}/docs")
    read = spark.read.parquet(f"{tmp_path}/docs")
    assert whole_read(read) and whole_read(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    for other in (docs, read.union(read), read.where("doc_id > 3"), read.selectExpr("*", "explode(array(1, 2)) AS i").drop("i"), read.groupBy("doc_id").count()):
        assert not whole_read(other)


def test_fingerprints(spark, docs, none):
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    known = {r.doc_id: r.text or "" for r in unique.collect()}
    order = sorted(known, reverse=True)
    for r in fingerprints.edited_fingerprints(unique).collect():
        mine, other = known[r.doc_id], known[order[(order.index(r.doc_id) + 1) % len(order)]]
        half = len(mine) // 2
        edited = mine[: len(mine) - half] + other[:half]
        import hashlib

        assert r.n_chars == len(mine) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for likeness, b in ((r.near_edited, edited), (r.near_next, other)):
            x, y = shingle_set(mine), shingle_set(b)
            assert abs(likeness - (len(x & y) / len(x | y) if x | y else 1.0)) < 0.2
    assert fingerprints.edited_fingerprints(docs).count() == docs.count()
    assert fingerprints.edited_fingerprints(none).count() == 0
    halves = spark.createDataFrame([(0, text(5, 400), text(6, 400))], "id int, a string, b string")
    split = fingerprints.with_words(fingerprints.with_words(halves, "a", "wa"), "b", "wb").selectExpr("*")
    from pyspark.sql import functions as F

    both = split.select(fingerprints.sketch(F.col("wa")).alias("a"), fingerprints.sketch(F.col("wb")).alias("b"))
    n = both.select(fingerprints.distinct_shingles(fingerprints.merge(F.col("a"), F.col("b")))).first()[0]
    assert abs(n - 792) < 250


def shingle_set(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sharding(docs, none, spark):
    many = spark.range(2003).selectExpr("id AS doc_id", "id * 7 AS text_crc32")
    found = sharding.bounded_ring(many, ["doc_id", "text_crc32"], 40).collect()
    sizes = Counter(r.shard for r in found)
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in found if r.shard == s) == list(range(n)) for s, n in sizes.items())
    grown = {r.doc_id: r.shard for r in sharding.bounded_ring(many, ["doc_id", "text_crc32"], 41, epsilon=0.25).collect()}
    before = {r.doc_id: r.shard for r in sharding.bounded_ring(many, ["doc_id", "text_crc32"], 40, epsilon=0.25).collect()}
    assert sum(grown[i] != before[i] for i in grown) < 0.15 * len(grown)
    assert sharding.bounded_ring(docs.select("doc_id", "text"), ["doc_id", "text"], 3).count() == docs.count()
    assert sharding.bounded_ring(none.select("doc_id"), ["doc_id"], 3).count() == 0


def test_packing(docs, none):
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in docs.collect():
        ids = full.encode(r.text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        at, piece = 0, 0
        while at < len(ids):
            n = first if at == 0 else 1024
            want[r.doc_id, piece, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at, piece = at + n, piece + 1
    found = packing.pack_documents(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    for s in {r.sequence_id for r in found}:
        at = 0
        for r in sorted((r for r in found if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack_documents(none).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_sweep_gives_longest_first_the_smallest_slot(spark, parts):
    r = random.Random(parts)
    units, gaps = ([r.randint(1, 30) for _ in range(n)] for n in (150, 120))
    open_, want = [], []
    for size, is_unit in sorted([(s, True) for s in units] + [(s, False) for s in gaps], key=lambda x: (-x[0], x[1])):
        if not is_unit:
            open_.append(size)
        else:
            want.append((size, open_.pop() if open_ else None))
    found = packing.sweep(
        spark.createDataFrame([(i, s, s, 0) for i, s in enumerate(gaps)], "key bigint, whole bigint, size bigint, slot int"),
        spark.createDataFrame(list(enumerate(units)), "key bigint, size bigint"),
        packing.heads_of(Counter(gaps), Counter(units)),
        parts,
    ).collect()
    mates = [(x.size, x.mate.size if x.mate else None) for x in found if x.kind == packing.UNIT]
    assert Counter(mates) == Counter(want)
    taken = [x.mate.key for x in found if x.kind == packing.UNIT and x.mate]
    assert len(set(taken)) == len(taken)
    both = lambda kind: {(x.key, x.mate.key) for x in found if x.kind == kind and x.mate}
    assert both(packing.GAP) == {(b, a) for a, b in both(packing.UNIT)}


@pytest.mark.parametrize("lengths", [[1] * 700, [64] * 3, [33, 32, 31] * 20, [random.Random(5).randint(1, 64) for _ in range(300)], [20] * 50 + [7] * 90 + [50] * 9])
def test_packing_needs_about_as_few_sequences_as_best_fit_decreasing(spark, lengths):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= length]
        if fitting:
            gaps.remove(min(fitting))
        gaps.append((min(fitting) if fitting else 64) - length)
    found = packing.pack(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id bigint, length bigint"), 64).collect()
    assert sorted((r.doc_id, r.length) for r in found) == list(enumerate(lengths))
    held = {}
    for r in sorted(found, key=lambda r: r.offset):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= 64
    assert len(held) <= len(gaps) + max(1, len(gaps) // 50)


@settings(deadline=None, max_examples=150)
@given(st.text(st.sampled_from("  \n\t ab1,.é'<|>　中\u00a0\u2003\u0085\x1c") | st.characters(exclude_categories=["Cs"]), min_size=1, max_size=40))
@example("a \u00a0 \u00a0 \u00a0 b")
@example("a \u00a0 \u00a0")
@example("x <|endoftext|> y<|endoftext|>\u00a0 z")
def test_texts_get_the_tokenizers_ids(t):
    full = _tokenizer()
    assert np.frombuffer(_ids()(t), "<u4").tolist() == full.encode(t, add_special_tokens=False).ids


def test_all_sure_characters_get_the_tokenizers_ids():
    sure = [c for c in map(chr, range(0xD800)) if not packing.UNSURE.match(c)]
    texts = [f"{a}{c}{b}" for c in sure for a, b in (("a", "b"), ("a ", " b"), (" ", "1"), ("1", ""), ("'s", "'"), (". ", "!"), ("\u00a0 ", "\u00a0"))]
    for t, want in zip(texts, _tokenizer().encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(_ids()(t), "<u4").tolist() == want.ids, repr(t)


_kept: dict = {}


def _tokenizer():
    return _kept.setdefault("t", Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))


def _ids():
    if "i" not in _kept:
        _kept["i"] = packing.byte_bpe(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return _kept["i"]


def test_token_counts(docs, none):
    vocabulary = token_counts.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = set(vocabulary)
    longest = max(map(len, known))

    def greedy(word: bytes) -> int:
        n = at = 0
        while at < len(word):
            at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in known)
            n += 1
        return n

    found = {r.doc_id: r for r in token_counts.token_counts(docs, vocabulary).collect()}
    for r in docs.collect():
        split = (r.text or "").encode().split()
        assert (found[r.doc_id].n_words, found[r.doc_id].n_tokens) == (len(split), sum(greedy(b" " + w) for w in split))
    assert token_counts.token_counts(none, vocabulary).count() == 0


def test_near_dedup(spark, docs, none):
    found = {r.doc_id: r for r in near_dedup.near_classes(docs).collect()}
    assert found[0].class_id == found[1].class_id == found[2].class_id == 0 and found[0].class_size == 3
    assert found[3].class_id == found[4].class_id == found[5].class_id == 3
    assert found[6].class_id == found[7].class_id == 6 and found[8].class_id == 8
    assert near_dedup.near_classes(docs).count() == docs.count()
    assert near_dedup.near_classes(none).count() == 0


def test_near_dedup_equals_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    r = random.Random(3)
    texts = []
    for g in range(6):
        base = text(100 + g, 80).split()
        for _ in range(25):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(80)] = f"w{r.randrange(10**6)}"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bags = [Counter(tuple(t.split()[i : i + 5]) for i in range(76)) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (bags[i] & bags[j]).total() >= 0.8 * (bags[i] | bags[j]).total():
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert {x.doc_id: x.class_id for x in near_dedup.near_classes(df).collect()} == {i: root(i) for i in range(len(texts))}


def near_pieces(texts):
    """The classes of texts by brute force, as lists of their numbers."""
    bags = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").split()) else Counter() for t in texts]
    classes = []
    for i, bag in enumerate(bags):
        alike = [c for c in classes if any((bag & bags[j]).total() >= 0.8 * (bag | bags[j]).total() for j in c)]
        classes = [c for c in classes if c not in alike] + [[i, *(j for c in alike for j in c)]]
    return classes


def near_rows():
    """(doc_id, text): clear near copies and unrelated texts; null and repeated ids with different texts."""

    def copy(seed, at):
        w = text(seed, 120).split()
        w[at] = "changed"
        return " ".join(w)

    return [
        (None, text(41, 120)), (None, text(42, 120)), (None, copy(42, 60)), (None, None), (None, " "), (7, text(43, 120)), (7, text(44, 120)),
        (7, text(44, 120)), (9, copy(44, 30)), (9, text(45, 120)), (3, copy(45, 90)), (None, copy(43, 50)), (2**63 - 1, text(46, 120)), (None, copy(46, 9)),
    ]


def test_near_dedup_tells_rows_of_null_and_repeated_ids_apart(spark):
    data = near_rows()
    found = near_dedup.near_classes(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    place = lambda i: (i is None, i or 0)
    want = Counter()
    for c in near_pieces([t for _, t in data]):
        first = min((data[i][0] for i in c), key=place)
        want.update((data[i][0], first, len(c)) for i in c)
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in found) == want
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.class_key for r in found}) == len(near_pieces([t for _, t in data]))
    assert all(r.doc_id == r.class_id and r.text_key == r.class_key for r in kept)


def test_near_dedup_stage_keeps_one_row_of_each_class(spark):
    data = near_rows()
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    left = [(r.doc_id, r.text) for r in near_dedup.stage(spark, docs, "").collect()]
    classes = near_pieces([t for _, t in data])
    assert len(left) == len(classes)
    for c in classes:
        assert sum((data[i][0], data[i][1]) in left for i in {data.index(data[i]) for i in c}) == 1


def test_signatures_estimate_weighted_overlap():
    a, b = " ".join(text(7, 40).split() * 3), " ".join(text(7, 40).split() * 2)
    owner, shingle, weight = near_dedup.multisets([a, b])
    s = near_dedup.bag_minhash(owner, shingle, weight, 2, 20_000)
    x, y = (dict(zip(shingle[owner == i].tolist(), weight[owner == i].tolist(), strict=True)) for i in (0, 1))
    true = sum(min(x.get(k, 0), y.get(k, 0)) for k in {*x, *y}) / sum(max(x.get(k, 0), y.get(k, 0)) for k in {*x, *y})
    assert abs((s[0] == s[1]).mean() - true) < 0.02


def test_word_hashes_depend_on_the_words_alone():
    h, owner = words.word_hashes(["a bb\n\nccc", "", "ccc  a"])
    assert owner.tolist() == [0, 0, 0, 2, 2] and h[2] == h[3] and h[0] == h[4] and len(set(h.tolist())) == 3


def test_mixing(docs, none):
    counts = [9000, 500, 400, 0]
    exponent, shares, budget = mixing.weights(counts, 9900, target=0.9, limit=100)
    assert abs(sum(shares) - 1) < 1e-9 and mixing.entropy(shares) >= 0.9 * np.log(3) - 1e-6 and 0 < exponent < 1
    assert max(w * 9900 / c for w, c in zip(mixing.weights(counts, 9900, target=1.0, limit=2)[1], counts, strict=True) if c) <= 2 + 1e-6
    plain = docs.drop("_rank", "label", "place")
    whole = mixing.mix(plain, ["doc_id"], None, whole=True).collect()
    assert {r.doc_id for r in whole} == {r.doc_id for r in docs.collect()}
    for b in {r.block for r in whole}:
        assert sorted(r.position for r in whole if r.block == b) == list(range(sum(r.block == b for r in whole)))
    assert mixing.mix(none, ["doc_id"], 10).count() == 0


def test_toxicity_learns_and_locates_sentences(spark, docs, none):
    r = random.Random(5)
    sample = []
    for i in range(300):
        sentences = [" ".join(f"w{r.randrange(200)}" for _ in range(8)) + "." for _ in range(6)]
        if i % 2:
            sentences[3] = f"you are a {r.choice(['blarg', 'zorkel'])} w1."
        sample.append((" ".join(sentences), i % 2))
    model = toxicity.fit(sample)
    score, spans = model.score("w1 w2 w3. what a blarg it is. w5 w6.")
    assert score > 0.5 and ["what a blarg it is." in "w1 w2 w3. what a blarg it is. w5 w6."[a:b] for a, b, _ in spans] == [True]
    assert model.score("w1 w2 w3 w4.")[0] < 0.5
    found = toxicity.score(docs, model).collect()
    assert len(found) == docs.count() and {x.score for x in found if x.doc_id in (3, 4, 10)} == {0.0}
    assert toxicity.score(none, model).count() == 0 and toxicity.fit([]).score("a b.")[0] < 0.5


def test_quality_and_language_handle_odd_rows(docs, none):
    machine = quality.FactorisationMachine().fit([(text(i), 1) for i in range(60)] + [(text(i).upper() + "!!", 0) for i in range(60)])
    assert machine.scores([text(999)])[0] > 0.5 > machine.scores([text(998).upper() + "!!"])[0]
    found = quality.score(docs, machine).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found) and quality.score(none, machine).count() == 0
    r = random.Random(1)
    sample = [(" ".join("".join(r.choices(a, k=5)) for _ in range(60)), lang) for _ in range(60) for a, lang in (("abcde", "x"), ("vwxyz", "y"))]
    model = language.fit(sample)
    named = {x.doc_id: x for x in language.identify(docs, model).collect()}
    assert named[3].lang_pred == named[4].lang_pred == "und" and named[8].lang_pred == "x"
    assert language.identify(none, model).count() == 0 and language.fit([]) is None


def test_filter_tables_equal_the_convolution():
    model = language.ByteConvolution(["x", "y"])
    data = np.random.default_rng(0).integers(0, 256, (3, language.WINDOW)).astype(np.uint8)
    h = []
    for width, kernel in zip(language.WIDTHS, model.filters, strict=True):
        made = [np.tensordot(model.embedding[data[:, t : t + width]], kernel, 2) for t in range(language.PLACES)]
        h.append(np.maximum(np.max(made, 0), 0))
    want = model._softmax(np.concatenate(h, 1) @ model.out + model.bias)
    assert np.allclose(model.probabilities(data, model.tables()), want, atol=1e-5)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == names, name
    assert corpus_pipeline.run(spark, FOLDER).count() > 0


def kept_by_brute_force(data):
    """(doc_id, text) after exact and near dedup; no two near texts have equal ids, so one row of each class comes first."""
    place = lambda r: (r[0] is None, r[0] or 0)
    first = {}
    for r in data:
        first[exact_dedup_key(r[1])] = min(first.get(exact_dedup_key(r[1]), r), r, key=place)
    left = list(first.values())
    return Counter(min((left[i] for i in c), key=place) for c in near_pieces([t for _, t in left]))


def test_pipeline_of_null_and_repeated_ids_equals_brute_force(spark, tmp_path):
    a, b = text(51, 120), text(52, 120)
    # a stays with id 3 only, b without an id; one id holds a and another text
    data = [(3, a), (None, a), (None, b), (3, text(53, 120)), *near_rows()[:2], *near_rows()[5:]]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(i, t, "en", "s", len(t)) for i, t in data]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    full = _tokenizer()
    want = Counter()
    for (i, t), n in kept_by_brute_force(data).items():
        ids = full.encode(t, add_special_tokens=False).ids + [2]
        assert len(ids) <= 1024
        want[i, zlib.crc32(np.array(ids, "<u4").tobytes())] += n
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.ids_crc32) for r in found) == want


def test_mixing_stage_repeats_rows_of_one_id_no_more_than_others(spark):
    rows = [(None, text(i), "en", "s", 1) for i in range(9)] + [(5, text(i), "en", "s", 1) for i in range(20, 24)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert Counter(map(tuple, mixing.stage(spark, docs, "").collect())) == Counter(rows)


def test_vocabulary_must_hold_all_bytes():
    with pytest.raises(ValueError):
        token_counts.Automaton([b"a", base64.b64decode("YWI=")])
