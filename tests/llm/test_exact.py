"""Top-k, mixing, byte pairs, SimHash and sketches against brute force."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from inquest.llm import bytepairs, mixing, simhash, sketches, topk

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, "one", "the same words here again", "the same words here again",
         "x" * 5000, "a b c d e f g\nsecond line. And more! Yes? no", "naïve café ½ Ⅷ 漢字 🤖 'll",
         "\x1c odd\x85 space here \t\t end  ", "1 2 3 " * 400, "word " * 3000]


def docs(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or ""), "clash", 7)
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                                       "n_chars long, score string, u int")


def empty(spark):
    return docs(spark, ["x"]).limit(0)


def plain_top(rows, k):
    whole = {i: [int(x) for x in np.floor(64 * np.asarray(v, dtype=float))] for i, v in rows}
    out = []
    for q in whole:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i)
                          for i, v in whole.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.05, 1.0, 3e6])
def test_top_k(spark, spread, monkeypatch):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.normal(0, spread, 8).astype(np.float32)])
            for i in range(200)]
    rows += [(i, rows[7][1]) for i in range(200, 260)]          # ties
    odd = [(300, None), (301, [1.0, None] * 4), (302, [float("nan")] * 8),
           (303, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn(
        "score", F.lit("clash")).repartition(5)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 20, block_rows=6)
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows, 20)
    assert topk.top_k(df.filter("vec_id < 3"), F.col("vec_id") % 20 == 0, 20).count() == 2
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_wide_products_are_exact():
    big = np.array([[2.0 ** 40, 3.0], [1.0, -2.0 ** 41]])
    assert topk.products(big, big)[0, 0] == 2 ** 63 - 1          # clipped


def test_mix(spark):
    texts = TEXTS + [" ".join(["w"] * (i % 37)) for i in range(400)]
    df = docs(spark, texts)
    rows = mixing.mix(df).collect()
    assert len(rows) == len(texts)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
    assert {r.doc_id: r["size"] for r in rows} == size
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(r["size"] for r in rows if r.source == s) for s in sources}
    weight = dict(zip(sources, [5, 2, 1] * 9))
    left, budget, target = set(sources), 1.5 * sum(total.values()), {}
    while True:                       # deal again what a full source cannot use
        rate = (budget - sum(target.values())) / sum(weight[s] for s in left)
        full = {s for s in left if weight[s] * rate >= 2 * total[s]}
        target |= {s: 2.0 * total[s] for s in full}
        left -= full
        if not full:
            break
    target |= {s: weight[s] * rate for s in left}
    longest = max(size.values())
    for s in sources:
        mine = [r for r in rows if r.source == s]
        assert mine[0].target == pytest.approx(target[s]) and mine[0].source_size == total[s]
        assert abs(sum(r["size"] * r.copies for r in mine) - target[s]) <= longest
        assert all(0 <= r.copies <= 2 for r in mine)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert mixing.mix(empty(spark)).count() == 0
    assert {r.copies for r in mixing.mix(docs(spark, [None, ""])).collect()} == {0}


def test_byte_pairs(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                              special_tokens={})
    draw = random.Random(5)
    texts = TEXTS + ["".join(draw.choice("ab éß'sx1 \n 漢.") for _ in range(200))
                     for _ in range(60)] + ["ab" * 20000]
    df = docs(spark, texts).repartition(3)
    ids = {r.doc_id: r.ids for r in bytepairs.encoded(df, PATH, public_tokenizers.PATTERN).collect()}
    assert ids == {i: known.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = bytepairs.decoded(bytepairs.encoded(df, PATH, public_tokenizers.PATTERN), PATH,
                             public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.bytes) for r in back.collect()} == {
        i: (t or "").encode() for i, t in enumerate(texts)}
    trip = {r.doc_id: r for r in bytepairs.round_trip(df, PATH, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert trip[i].n_tokens == len(ids[i])
        assert trip[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids[i])).encode()).hexdigest()
        assert trip[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bytepairs.round_trip(empty(spark), PATH, public_tokenizers.PATTERN).count() == 0


def test_perfect_hash_has_a_slot_for_each_key():
    keys = [f"key{i}".encode() for i in range(3000)]
    assert sorted(bytepairs.PerfectHash(keys).slots(keys).tolist()) == list(range(3000))


def plain_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(fps, radius=2):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_simhash(spark):
    texts = TEXTS + ["The Same words HERE again", "the same words here again éÉ"]
    got = {r.doc_id: r for r in simhash.classes(docs(spark, texts)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert [got[i].fp % (1 << 64) for i in range(len(texts))] == fps
    assert [got[i].component_id for i in range(len(texts))] == plain_classes(fps)
    assert simhash.classes(empty(spark)).count() == 0
    kept = simhash.one_per_class(docs(spark, texts).unionByName(docs(spark, texts)))
    assert kept.columns == docs(spark, texts).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(plain_classes(fps)))


@pytest.mark.parametrize("radius,leaf", [(2, 20000), (2, 40), (3, 60)])
def test_vantage_point_links(spark, monkeypatch, radius, leaf):
    monkeypatch.setattr(simhash, "LEAF_ROWS", leaf)
    draw = random.Random(radius * leaf)
    base = [draw.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for x in base[:20]:                      # chains of near fingerprints
        for _ in range(12):
            for b in draw.sample(range(64), draw.randint(1, radius + 1)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    stars = {r.node: r.root for r in simhash.components(simhash.links(df, radius)).collect()}
    root = plain_classes(fps, radius)
    found = [stars.get(simhash.signed(x), simhash.signed(x)) for x in fps]
    groups = {}
    for r, f in zip(root, found):
        groups.setdefault(r, set()).add(f)
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len(set(found))


@pytest.mark.parametrize("radius", [2, 3])
def test_links_of_shards_dealt_twice(spark, monkeypatch, radius):
    monkeypatch.setattr(simhash, "LEAF_ROWS", 2)
    draw, depths, deal = random.Random(radius), [], simhash.deal
    monkeypatch.setattr(simhash, "deal", lambda rows, vantage, depth, radius: depths.append(
        depth) or deal(rows, vantage, depth, radius))
    flip = lambda x, n: x ^ sum(1 << b for b in draw.sample(range(64), n))
    base = draw.getrandbits(64)
    ones = [flip(base, 14) for _ in range(60)]
    pairs = [(x, flip(x, draw.randint(1, radius))) for x in ones]
    df = spark.createDataFrame([(simhash.signed(x),) for x in {y for p in pairs for y in p}],
                               "fp long")
    stars = {r.node: r.root for r in simhash.components(simhash.links(df, radius)).collect()}
    root = lambda x: stars.get(simhash.signed(x), simhash.signed(x))
    assert set(depths) == {0, 1, 2}
    assert [root(x) for x, _ in pairs] == [root(y) for _, y in pairs]


@pytest.mark.parametrize("radius", [2, 3])
def test_dealing_makes_a_bounded_number_of_rows(spark, monkeypatch, radius):
    monkeypatch.setattr(simhash, "LEAF_ROWS", 2)
    draw, made, deal = random.Random(radius), [], simhash.deal

    def counted(rows, vantage, depth, radius):
        made.append((depth, rows.count(), deal(rows, vantage, depth, radius).count()))
        return deal(rows, vantage, depth, radius)
    monkeypatch.setattr(simhash, "deal", counted)
    base = draw.getrandbits(64)
    fps = {base ^ sum(1 << b for b in draw.sample(range(64), 8)) for _ in range(200)}
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    stars = {r.node: r.root for r in simhash.components(simhash.links(df, radius)).collect()}
    # 21 and 65 rows of a fingerprint before, then 73 to 833 of each of those
    assert made[0][1:] == (len(fps), (radius + 1) * len(fps)) and {d for d, _, _ in made} == {0, 1, 2}
    assert all(out <= (n if depth == 1 else (radius + 1) * n) for depth, n, out in made)
    for x in fps:
        for y in fps:
            if (x ^ y).bit_count() <= radius:
                a, b = simhash.signed(x), simhash.signed(y)
                assert stars.get(a, a) == stars.get(b, b)


def test_components_take_as_many_tasks_as_their_pairs_need(spark):
    set_to = {"spark.sql.shuffle.partitions": "40", "spark.sql.autoBroadcastJoinThreshold": "-1",
              "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in set_to}
    sc = spark.sparkContext
    near = [(i, i + 1) for i in range(1, 60) if i % 20] + [(100, 101), (101, 100), (7, 7)]
    try:
        for k, v in set_to.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(near, "a long, b long").repartition(8, "a").localCheckpoint()
        sc.setJobGroup("few tasks", "few tasks")
        stars = {r.node: r.root for r in simhash.components(df).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in was.items():
            spark.conf.set(k, v)
    assert stars == {x: x - (x - 1) % 20 for x in range(1, 61) if (x - 1) % 20} | {101: 100}
    track = sc.statusTracker()
    stages = {s for j in track.getJobIdsForGroup("few tasks") for s in track.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for i in map(track.getStageInfo, stages) if i)
    assert 0 < tasks < 40 * 25, tasks      # every round took 11 times the shuffle partitions


def test_sketches(spark, monkeypatch):
    draw = random.Random(9)
    texts = TEXTS + ["\n".join(f"line {draw.randint(0, 80)}." for _ in range(n))
                     for n in (3, 30, 300, 900, 30)]
    rows = docs(spark, texts)
    got = {r.doc_id: r for r in sketches.fingerprints(rows.repartition(3)).collect()}
    assert len(got) == len(texts)

    def pieces(t):
        return set(re.split(r"\n| (?<=[.!?] )", t))
    order = sorted(got, reverse=True)
    for at, i in enumerate(order):
        text, after = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, e, b = pieces(text), pieces(edited), pieces(after)
        assert got[i].near_edited == pytest.approx(len(a & e) / len(a | e))
        assert got[i].near_next == pytest.approx(len(a & b) / len(a | b))
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (a == e)
    assert got[3].fingerprint == got[4].fingerprint
    one = sketches.fingerprints(docs(spark, ["alone. here"])).first()
    assert one.near_next == 1.0
    assert sketches.fingerprints(empty(spark)).count() == 0
    twice = sketches.fingerprints(docs(spark, ["a b", "c d"]).unionByName(docs(spark, ["a b"])))
    assert twice.count() == 3
