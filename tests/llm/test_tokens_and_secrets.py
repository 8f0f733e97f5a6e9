"""Tokenizer alignment, hard negatives and secret scans against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inquest.llm import alignment, hardnegatives, secretscan

TEXTS = ["", None, "one", "the same words here again", "the same words here again", "x" * 3000,
         "naïve café ½ Ⅷ 漢字 🤖 'll", "  two  spaces and\ttab \n\n lines  ", "▁ mark", "<s> <|endoftext|>",
         "\x1c odd\x85 space here", "1 2 3 " * 300, "nul\x00 inside", "<0x0A> ▁", " "]


def docs(spark, texts):
    rows = [(i if i % 6 else None, t, 7, "clash", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, block int, spans string, "
                                       "a int, part int")


# -- alignment ---------------------------------------------------------------------------------

def plain_alignment(texts):
    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}

    def b_bytes(i):
        piece = b_model.id_to_piece(i)
        hexed = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(hexed[1], 16)]) if hexed else piece.replace("▁", " ").encode()
    out = []
    for text in texts:
        row = {"a": [], "b": [], "groups": [], "links": Counter()}
        out.append(row)
        if not text:
            continue
        whole = (" " + text).encode()
        a = a_model.encode(" " + text, add_special_tokens=False).ids
        b = b_model.encode(text)
        a_parts = [bytes(byte[c] for c in a_model.id_to_token(i)) for i in a]
        b_parts = [b_bytes(i) for i in b]
        if b"".join(a_parts) != whole or b"".join(b_parts) != whole:
            continue
        ends = [set(np.cumsum([len(x) for x in parts]).tolist()) for parts in (a_parts, b_parts)]
        groups, start = [], 0
        for stop in sorted(ends[0] & ends[1]):
            def inside(ids, parts):
                at, kept = 0, []
                for i, p in zip(ids, parts):
                    if start <= at < stop:
                        kept.append(i)
                    at += len(p)
                return kept
            groups.append((inside(a, a_parts), inside(b, b_parts)))
            start = stop
        row |= {"a": a, "b": b, "groups": groups}
        for left, right in groups:
            row["links"].update((x, y) for x in left for y in right)
    held = Counter(p for row in out for p in row["links"])
    highest = defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    return [(len(r["a"]), len(r["b"]), len(r["groups"]), sum(r["links"].values()),
             sum(n for p, n in r["links"].items() if held[p] == highest[p[0]]),
             sum(n * held[p] for p, n in r["links"].items()),
             hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y))
                                     for x, y in r["groups"]).encode()).hexdigest()
             if r["groups"] else "") for r in out]


def test_runs_are_numbered_by_their_values():
    draw = np.random.default_rng(1)
    sizes = draw.integers(1, 4, 500)
    starts = np.cumsum(sizes) - sizes
    one, two = draw.integers(0, 3, sizes.sum()), draw.integers(0, 2, 500)
    number, first = alignment.numbered([(one, starts), (two, np.arange(500))])
    runs = [(tuple(one[s:s + n]), t) for s, n, t in zip(starts, sizes, two)]
    assert [runs[f] for f in first[number]] == runs
    assert len(set(runs)) == len(first)


@pytest.mark.parametrize("block_rows,tokens", [(4096, 1 << 22), (7, 1 << 22), (4096, 50)])
def test_alignment(spark, monkeypatch, block_rows, tokens):
    monkeypatch.setattr(alignment, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(alignment, "BLOCK_TOKENS", tokens)
    draw = random.Random(4)
    words = ["the", "then", "there", "é", "漢", "in", "ing", "\n", "  ", "x1", ".", "Reoush", "🤖"]
    texts = TEXTS + ["".join(draw.choice(words) + draw.choice(["", " "])
                             for _ in range(draw.randint(1, 60))) for _ in range(60)]
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    got = alignment.align(docs(spark, texts).repartition(3), *paths)
    want = plain_alignment(texts)
    key = lambda r: tuple(map(str, r))
    assert sorted([tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best",
                                        "count_sum", "groups_sha256")) for r in got.collect()],
                  key=key) == sorted([(i if i % 6 else None, *w) for i, w in enumerate(want)], key=key)
    assert alignment.align(docs(spark, ["x"]).limit(0), *paths).count() == 0
    assert alignment.align(docs(spark, ["", None]), *paths).count() == 2


# -- hard negatives ----------------------------------------------------------------------------

def plain_hard(rows, scale=256):
    known = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(
                x is None or not math.isfinite(x) for x in v):
            continue
        known.append((i, [math.floor(scale * float(x)) for x in v], label))
    out = []
    for at, (anchor, a, label) in enumerate(known):
        if anchor % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i, other == label)
                        for n, (i, v, other) in enumerate(known) if n != at)
        for positive, i, _ in [s for s in scored if s[2]][:5]:
            band = [s for s in scored if not s[2]
                    and 80 * -positive <= 100 * -s[0] <= 100 * -positive][:5]
            out += [(anchor, i, n + 1, s[1], -positive, -s[0]) for n, s in enumerate(band)]
    return sorted(out)


@pytest.mark.parametrize("spread,width", [(0.1, 16), (30.0, 5), (3e5, 3)])
def test_hard_negatives(spark, monkeypatch, spread, width):
    monkeypatch.setattr(hardnegatives, "PACK", 32)
    draw = np.random.default_rng(int(spread * 10))
    middle = np.abs(draw.normal(0, spread, width))
    rows = [(i * 4, [float(x) for x in (middle + draw.normal(0, spread / 3, width)).astype(np.float32)],
             i % 3) for i in range(250)]
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(1, 40)]              # ties
    rows += [rows[25], rows[25], (100, rows[30][1], 0), (200, [0.0] * width, 1)]   # repeated
    odd = [(100, None, 1), (300, [1.0, None, 1.0], 1), (400, [float("nan")] * 3, 1),
           (500, [float("inf")] * 3, 2), (600, [1.0] * width, None), (None, [1.0] * width, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn(
        "rank", F.lit("clash")).withColumn("a", F.lit(3)).repartition(4)
    got = hardnegatives.hard_negatives(df, F.col("vec_id") % 100 == 0, block_rows=6)
    assert sorted(tuple(r) for r in got.collect()) == plain_hard(rows)
    alone = df.filter("vec_id = 0")
    assert hardnegatives.hard_negatives(alone, F.col("vec_id") % 100 == 0).count() == 0
    assert hardnegatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_wide_fields_are_exact(spark):
    draw = random.Random(2)
    rows = [(i * 50, [float(draw.choice([-1, 1, 3]) * 2 ** draw.randint(10, 40)) for _ in range(3)],
             i % 2) for i in range(60)]
    assert hardnegatives.field_bytes(256 * 2 ** 42, 256 * 2 ** 42, 3) > 8
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r for r in map(tuple, hardnegatives.hard_negatives(df, F.col("vec_id") % 100 == 0).collect())}
    long = 2 ** 63 - 1
    assert got and all(r in got for r in plain_hard(rows) if max(r[4:]) < long)


# -- secrets -----------------------------------------------------------------------------------

KEY = "".join(f"[{c.upper()}{c}]" for c in "key")
BASE = {
    "assign": (re.compile("(?:" + "|".join(
        "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
        for w in ("password", "passwd", "secret", "token", "api_?key"))
        + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)}
BITS = ["token", "secret", "=", ":", " ", "'", '"', "AKIA", "A0B1C2D3", "deadbeef", "KEY",
        "0123456789abcdef", "x", "api_key", "APIKEY", "passwd", "PassWord", "é", "漢", "==", "\n",
        "abc", "K", "🤖", "eyJ", ".", "-----BEGIN RSA PRIVATE KEY-----", "ghp_", "http://", "@", "a" * 30]


def plain_secrets(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, (pattern, keep)) in enumerate(BASE.items())
             for m in pattern.finditer(text or "") if keep(m)]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def more_secrets(text):
    """The added rules by the plain patterns; none of them starts differently when read longest."""
    found = [(m.start(), k, m.end(), r.kind) for k, r in enumerate(secretscan.MORE)
             for m in re.finditer(r.pattern, text or "")
             if re.fullmatch(r.keep or r.pattern, m[0])]
    return {f"{kind}:{a}:{b}" for a, _, b, kind in found}


def test_secrets(spark):
    draw = random.Random(3)
    texts = TEXTS + ["".join(draw.choice(BITS) for _ in range(draw.randint(0, 25))) for _ in range(600)]
    texts += ["a=" * 20000 + "token: 'abcdef'", "f" * 20000, "token=" * 3000,
              "eyJhbGci.eyJzdWIi.abc_-9 ghp_" + "a1B2" * 9 + " xoxb-1234567890-a https://me:pw@host.org",
              "-----BEGIN PRIVATE KEY----- sk_live_" + "x" * 16 + " AIza" + "b" * 35]
    found = secretscan.secrets(docs(spark, texts).repartition(3))
    got = sorted(map(tuple, secretscan.report(found).collect()), key=str)
    want = []
    for i, t in enumerate(texts):
        base = plain_secrets(t)
        n = Counter(s.split(":")[0] for s in base)
        want.append((i if i % 6 else None, n["assign"], n["access"], n["hex"],
                     hashlib.sha256(",".join(base).encode()).hexdigest(), base, more_secrets(t)))
    kinds = tuple(BASE)
    listed = [(*r[:5], [s for s in r[5].split(",") if s.startswith(kinds)],
               {s for s in r[5].split(",") if s and not s.startswith(kinds)}) for r in got]
    assert sorted(listed, key=str) == sorted(want, key=str)
    assert sum(len(w[6]) for w in want) > 5
    assert secretscan.report(secretscan.secrets(docs(spark, ["x"]).limit(0))).count() == 0


def test_secrets_are_masked(spark):
    df = docs(spark, ["é token=abcdef1 end", "clean", None, "secret: " + "0af" * 10])
    assert [r.text for r in secretscan.masked(df).collect()] == [
        "é [assign] end", "clean", "", "[assign]"]


def test_patterns_read_as_regular_expressions():
    draw = random.Random(8)
    parts = ["a", "b", "[ab]", "[^a]", "(ab|b)", "c", r"\.", "[a-c]", "(a|bc)"]
    for _ in range(300):
        text = "".join(draw.choice(parts) + draw.choice(["", "", "?", "*", "+", "{2}", "{1,3}", "{2,}"])
                       for _ in range(draw.randint(1, 4)))
        if re.fullmatch(text, ""):
            with pytest.raises(ValueError):
                secretscan.Automaton([(text, False)], True)
            continue
        data = "".join(draw.choice("abc.") for _ in range(40))
        auto = secretscan.Automaton([(text, False)], False)
        coded = data.encode().translate(auto.classes)
        for start in range(len(data)):
            ends = [e for e in range(start + 1, len(data) + 1) if re.fullmatch(text, data[start:e])]
            assert auto.longest(coded, start)[0] == max(ends, default=start), (text, data, start)
        back = secretscan.Automaton([(text, False)], True, backward=True)
        assert back.begins(data.encode())[::-1] == [
            s for s in range(len(data)) if auto.longest(coded, s)[0] > s]
    with pytest.raises(ValueError):
        secretscan.Automaton([("(ab", False)], True)
    with pytest.raises(ValueError):
        secretscan.Automaton([("a{9}b{9}", False)], True, most_states=5)


def test_combined_automaton_is_minimal():
    auto = secretscan.Automaton([("abc", False), ("(a)bc|abc", False)], True)
    assert auto.states == 4
