"""Line dedup, toxicity, licences, token rollups, personal data and the pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inquest.llm import licences, lines, pii, shinglesets, tokencounts, toxicity
from test_exact import docs, empty

LONG = ["a line that has eight words or more {}", "another line with quite enough words in it {}"]


def plain_kept(texts, min_words=8):
    """Delete each line of a substantial run that occurs before."""
    seqs = [(t or "").split("\n") for t in texts]
    runs, first = {}, {}
    for i, s in enumerate(seqs):
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                first.setdefault(tuple(s[a:b]), (i, a))
    gone = [set() for _ in texts]
    for i, s in enumerate(seqs):
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                run = tuple(s[a:b])
                big = len(run) >= 4 or any(len(x.split()) >= min_words for x in run)
                if big and first[run] < (i, a):
                    gone[i].update(range(a, b))
    return [None if t is None else "\n".join(x for n, x in enumerate(s) if n not in g)
            for t, s, g in zip(texts, seqs, gone)]


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    draw = random.Random(seed)
    pool = [x.format(i) for x in LONG for i in range(3)] + ["Yes.", "No.", "", "Short one.", "End"]
    texts = [None, "", ""] + ["\n".join(draw.choice(pool) for _ in range(draw.randint(1, 9)))
                              for _ in range(12)]
    texts += [texts[5], "\n".join(str(n) for n in range(40)), "\n".join(str(n) for n in range(40))]
    df = docs(spark, texts)
    want = plain_kept(texts)
    got = {r.doc_id: r for r in lines.deduplicated(df.repartition(3)).collect()}
    assert [got[i].text for i in range(len(texts))] == want
    assert lines.deduplicated(df).columns == df.columns
    assert all(r.n_chars == len(r.text or "") for r in got.values())
    both = lines.deduplicated(df.unionByName(df)).collect()          # repeated rows are one document
    assert sorted((r.doc_id, r.text or "") for r in both) == sorted(
        2 * [(i, t or "") for i, t in enumerate(want)])
    assert lines.deduplicated(empty(spark)).count() == 0


def toy(spark):
    draw = random.Random(4)
    plain = ["".join(draw.choice(["th", "on", "er", "ing", "al", "me"]) for _ in range(3))
             for _ in range(300)]
    insults = ["grobnik", "grobnak", "flumpox"]
    texts, labels = [], []
    for i in range(400):
        words = [draw.choice(plain) for _ in range(draw.randint(5, 40))]
        bad = i % 3 == 0
        if bad:
            words.insert(draw.randrange(len(words)), draw.choice(insults))
        texts.append(" ".join(words))
        labels.append((i, 1, int(bad)))
    more = ["", None, "a g r o b n i k here", "said grob.nik aloud", "onthal ingme",
            "x" * 5000, "word " * 20000]
    return docs(spark, texts + more), spark.createDataFrame(
        labels + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int"), labels, more


def test_toxicity(spark):
    df, known, labels, more = toy(spark)
    model = toxicity.train(df, known, landmarks=40)
    got = {r.doc_id: r.score for r in toxicity.scores(df.repartition(3), model).collect()}
    assert len(got) == len(labels) + len(more)
    fold = {r.doc_id for r in df.filter(toxicity.fold(F.col("doc_id"))).collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, _, y in labels if i in fold]
    assert sum(right) / len(right) > 0.97
    n = len(labels)
    assert got[n + 2] > 0.5 and got[n + 3] > 0.5            # gapped and interrupted
    assert all(got[n + k] < 0.5 for k in (0, 1, 4, 5, 6))
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}
    none = toxicity.train(df, known.limit(0))
    assert max(r.score for r in toxicity.scores(df, none).collect()) < 0.5
    assert toxicity.scores(empty(spark), model).count() == 0


def test_licences(spark):
    draw = random.Random(8)
    plain = ["".join(draw.choice(["th", "on", "er", "ing", "al", "me"]) for _ in range(3))
             for _ in range(300)]
    def prose():
        return " ".join(draw.choice(plain + ["the", "of", "and", "to"]) for _ in range(15)) + "."
    texts = [prose() + "\n" + prose() for _ in range(150)] + [
        "Released under the MIT License.", prose() + "\nLicensed under the Apache License, Version 2.0.",
        "This work is licensed under the GNU General Public License, version 3.\n" + prose(),
        "Licensed under CC BY-NC 4.0.", "", None]
    df = docs(spark, texts)
    rows = licences.scan(df, licences.train(df)).collect()
    sure = {(r.doc_id, r.line): r.family for r in rows if r.confirmed}
    assert sure == {(150, 0): "mit", (151, 1): "apache", (152, 0): "gpl", (153, 0): "cc"}
    assert all(r.family == "unknown" for r in rows if not r.confirmed)
    model = licences.train(df)
    assert licences.scan(empty(spark), model).count() == 0


def test_token_rollup(spark, folder):
    df = docs(spark, ["one two", "three", None, "four five six"])
    counted = tokencounts.counted(df, F.col("text"))
    box = tokencounts.Rollup(spark, folder)
    assert box.totals().count() == 0
    assert box.apply("a", inserts=counted) and not box.apply("a", inserts=counted)

    def words():
        return {r.source: (r.docs, r.tokens) for r in
                box.totals().filter("version = 'words-1'").collect()}
    assert words() == {None: (1, 2), "s1": (1, 1), "s2": (1, 0), "s0": (1, 3)}
    longer = tokencounts.counted(df.filter("doc_id = 1"), F.lit("now four words here"))
    gone = df.filter("doc_id = 3").select("doc_id")
    for _ in range(2):
        box.apply("b", revisions=longer)
        box.apply("c", deletes=gone.unionByName(gone).unionByName(
            spark.createDataFrame([(77,), (None,)], "doc_id long")))
    assert words() == {None: (1, 2), "s1": (1, 4), "s2": (1, 0)}
    counted.limit(0).write.parquet(f"{folder}/ledger/cut-off")      # no commit record
    assert words() == {None: (1, 2), "s1": (1, 4), "s2": (1, 0)}
    assert box.apply("empty", inserts=counted.limit(0))


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10))
                for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def plain_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                  "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_personal_data(spark):
    draw = random.Random(3)
    texts = ["", None, "é🤖 a@b.c.d%x@e.f and x@y", "1.2.3.4.5.6.7.8 999.1.1.1 4111 1111-1111 1111",
             "+1 (988) 555-2485 +12", "9" * 6000, "a" * 20000 + "@x", "4111111111111111",
             "0001.2.3.4 000000000000000000001.2.3.4"]
    texts += ["".join(draw.choice("ab.@-+ 0123456789()%é\n") for _ in range(120)) for _ in range(150)]
    texts += [f"{w} met Zygmunt at zyg@corp.org.\nothers {w} met" for w in ("One", "Two", "Three", "Four")]
    texts += ["One plain line", "Two plain lines with zygmunt"]
    df = docs(spark, texts)
    found = pii.spans(df.repartition(3))
    got = {r.doc_id: r for r in pii.report(found).collect()}
    for i, t in enumerate(texts):
        base = plain_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), t
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("term")] == base
        assert got[i].n_card == sum(s.startswith("card") for s in base)
    first = len(texts) - 6
    assert "term:8:15" in got[first].spans            # the name, not the other words
    assert got[len(texts) - 2].spans == "" and got[len(texts) - 1].spans == "term:21:28"
    clean = {r.doc_id: r.text for r in pii.sanitised(found).collect()}
    assert clean[first] == "One met [term] at [email].\nothers One met"
    assert clean[1] == "" and clean[len(texts) - 2] == "One plain line"
    assert pii.spans(empty(spark)).count() == 0


def test_pipeline(spark, tmp_path):
    df, known, labels, _ = toy(spark)
    copy = df.filter("doc_id = 1").withColumn("doc_id", F.lit(9001).cast("long"))
    texts = df.select("doc_id", "text", "lang", "source", "n_chars")
    texts.unionByName(copy.select(texts.columns)).write.parquet(str(tmp_path / "documents.parquet"))
    known.write.parquet(str(tmp_path / "labels.parquet"))
    rows, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        columns = rows.columns
        stage(spark, rows, str(tmp_path)).write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
        sizes[name] = rows.count()
        assert name == "byte_bpe" or rows.columns == columns
    held = {i for i, _, y in labels if y}
    left = {r.doc_id for r in spark.read.parquet(str(tmp_path / "toxicity")).collect()}
    assert len(left & held) <= 0.05 * len(held)
    assert sizes["line_dedup"] == sizes["toxicity"] > sizes["simhash_near_dedup"]
    copies = spark.read.parquet(str(tmp_path / "mix_sources")).groupBy("doc_id").count()
    assert copies.filter("count > 2").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sizes["byte_bpe"]


def shingle_classes(texts):
    """Brute force: the classes of texts linked by exact Jaccard 0.8 of five-word shingles."""
    def shingles(text):
        words = text.lower().split()
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    sets, root = [shingles(x) for x in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * all_ and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


@pytest.mark.parametrize("often,blocks", [(8, 4096), (1, 4096), (8, 3)])
def test_near_copies_by_shingles(spark, monkeypatch, often, blocks):
    monkeypatch.setattr(shinglesets, "LIST", blocks)
    monkeypatch.setattr(shinglesets, "OFTEN", often)
    monkeypatch.setattr(shinglesets, "SAMPLE", 16 if often > 1 else 1)
    draw, texts = random.Random(often), ["", " ", "one", "One", "two words"]
    for i in range(40):
        words = [f"w{draw.randrange(400)}" for _ in range(draw.choice([6, 30, 90, 200]))]
        for _ in range(6):                       # chains of copies, around similarity 0.8
            words = list(words)
            for _ in range(draw.choice([0, 1, 1, max(1, len(words) // 60)])):
                words[draw.randrange(len(words))] = f"w{draw.randrange(400)}"
            if draw.random() < 0.3:
                words += [f"w{draw.randrange(400)}" for _ in range(len(words) // 10)]
            texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = shingle_classes(texts)
    kept = {r.doc_id for r in shinglesets.one_per_class(df.repartition(3)).collect()}
    assert kept == set(root) and len(kept) < 200


def test_a_member_that_thousands_of_sets_share(spark, monkeypatch):
    monkeypatch.setattr(shinglesets, "LIST", 500)
    monkeypatch.setattr(shinglesets, "OFTEN", 1 << 30)          # so it stays in the prefixes
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"{passage} own{i} words{i}" for i in range(3000)]           # 0.9: one class
    texts += [passage + " " + " ".join(f"o{i}x{k}" for k in range(60)) for i in range(1500)]   # 0.2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in shinglesets.one_per_class(df.repartition(4)).collect()}
    assert kept == {0, *range(3000, 4500)}


def test_sketches_bound_the_difference():
    draw = np.random.default_rng(1)
    for n in (1, 30, 200, 3000):
        whole = draw.integers(0, 1 << 63, n * 2, dtype=np.uint64)
        for m in (n, n + n // 4, 2 * n):
            a, b = np.unique(whole[:n]), np.unique(whole[n // 10:m])
            far = shinglesets.apart(shinglesets.sketch(a), shinglesets.sketch(b))
            assert far <= len(np.setxor1d(a, b))
    assert shinglesets.apart(shinglesets.sketch(a), shinglesets.sketch(a)) == 0


def test_only_shared_members_become_rows(spark, monkeypatch):
    draw = random.Random(3)
    texts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(200)) for _ in range(60)]
    texts += [t + " and one more" for t in texts[:10]] + texts[50:]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, real = [], shinglesets.cells

    def spy(sets):
        shared = (sets.selectExpr("explode(prefix) AS member").groupBy("member").count()
                  .filter("count > 1").select("member"))
        rows = shinglesets.posted(sets, shinglesets.bit_table(shared)).collect()
        held = {(r.id, k, m) for r in sets.collect() for k, m in enumerate(r.prefix)}
        seen.append((held, {r.member for r in shared.collect()}, rows, sets.count()))
        return real(sets)
    monkeypatch.setattr(shinglesets, "cells", spy)
    kept = {r.doc_id for r in shinglesets.one_per_class(df.repartition(3)).collect()}
    held, shared, rows, n = seen[0]
    got = {(r.id, r.at, r.member) for r in rows}
    assert len(got) == len(rows) and got <= held
    assert {x for x in held if x[2] in shared} <= got           # none is lost
    assert shared and len(got) < len(held) / 2                  # all were dealt before
    assert kept == set(range(60)) and n == 70                   # the ten repeats are no sets


def test_near_copies_keep_columns_named_like_helpers(spark):
    df = spark.createDataFrame([(1, "a b", "h", 1, 5), (2, "A b", "i", 2, 6), (3, "c", "j", 3, 7)],
                               "doc_id long, text string, hash string, nth int, __hash int")
    got = shinglesets.one_per_class(df.unionByName(df))
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [(1, "a b", "h", 1, 5), (3, "c", "j", 3, 7)]
    assert shinglesets.one_per_class(df.limit(0)).count() == 0


def test_near_copies_with_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(1, long), (2, long + " more"), (2, "another text"), (3, "a third"), (3, "a third"),
            (None, "alone"), (None, "a Third"), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, shinglesets.one_per_class(df).collect()), key=str)
    empty = [x for x in got if not x[1]]
    assert len(empty) == 1
    assert [x for x in got if x[1]] == sorted([(1, long), (2, "another text"), (3, "a third"),
                                               (None, "alone")], key=str)


def test_stages_keep_columns_named_like_helpers(spark):
    import corpus_pipeline
    rows = [(i, f"own {i}\nthe very same line of eight words comes again here\nend {i}", "s", 40, *range(10))
            for i in range(6)] + [(9, None, None, None, *range(10)), (9, None, None, None, *range(10))]
    extra = ("__gone", "__before", "__o", "__h", "gone", "before", "of", "u", "copies", "v")
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, "
                               + ", ".join(f"{c} int" for c in extra))
    once = corpus_pipeline.drop_repeated_lines(spark, df, "")
    assert once.columns == df.columns and once.count() == 8
    kept = {r.doc_id: r.text for r in once.collect()}
    assert kept[0].count("\n") == 2 and kept[1] == "own 1\nend 1" and kept[9] is None
    assert {tuple(r)[4:] for r in once.collect()} == {tuple(range(10))}
    mixed = corpus_pipeline.mix_sources(spark, df, "")
    assert mixed.columns == df.columns and {tuple(r)[4:] for r in mixed.collect()} == {tuple(range(10))}
    for stage in (corpus_pipeline.drop_repeated_lines, corpus_pipeline.mix_sources):
        assert stage(spark, df.limit(0), "").count() == 0


def test_many_deleted_lines_take_linear_time(spark):
    import time
    shared = [f"shared line number {i} of more than eight words in all" for i in range(20000)]
    df = spark.createDataFrame([(1, "\n".join(shared)), (2, "first\n" + "\n".join(shared) + "\nlast")],
                               "doc_id long, text string")
    begun = time.time()
    assert {r.doc_id: r.text for r in lines.deduplicated(df).collect()} == {
        1: "\n".join(shared), 2: "first\nlast"}
    assert time.time() - begun < 120


def test_near_copies_go_through_simhash(spark, monkeypatch):
    from inquest.llm import simhash
    draw, texts = random.Random(5), []
    for _ in range(12):
        words = [f"w{draw.randrange(3000)}" for _ in range(900)]
        for k in range(4):
            texts.append(" ".join(words[:-1] + [f"w{k}"] if k else words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = [simhash.fingerprint(t.encode(), 5) for t in texts]
    asked, real = [], shinglesets.fingerprint_pairs

    def spy(sets):
        ids = {r.id: r.fp for r in sets.collect()}
        asked.append((ids, [(r.a, r.b) for r in real(sets).collect()]))
        return real(sets)
    monkeypatch.setattr(shinglesets, "fingerprint_pairs", spy)
    kept = {r.doc_id for r in shinglesets.one_per_class(df).collect()}
    ids, pairs = asked[0]
    assert len(asked) == 1 and set(ids.values()) == {simhash.signed(x) for x in fps}
    root = {x: x for x in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        assert a != b
        root[find(a)] = find(b)
    for a in ids:
        for b in ids:
            if ((ids[a] ^ ids[b]) & ((1 << 64) - 1)).bit_count() <= 3:
                assert find(a) == find(b)
    assert len(pairs) > 20 and kept == set(range(0, 48, 4))
