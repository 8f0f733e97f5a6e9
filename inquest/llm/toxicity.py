"""Toxicity by a subsequence string kernel and a support vector machine on Nyström landmarks.

Two strings are alike when they share subsequences of three letters; a subsequence counts less
the more characters it spans, so a gap or an inserted character lowers the likeness but does
not break it. Strings are the terms of a sentence (white-space separated, in windows when long;
runs of single characters are joined). The machine learns from labelled sentences whose label
is known for the document only: in a toxic document the worst term of its sentences stands for
it, in a clean one every term is clean, and after each fit the worst terms are chosen again.
Landmarks turn the kernel into a few coordinates (Nyström); the fitted weights fold into one
weight per subsequence, so scoring a term costs a look-up per subsequence.

Fitting reads a bounded sample of labelled rows, ``sample_clean`` and ``sample_toxic`` documents
chosen by a hash of the id. Scoring reads every text whole; a document scores as its worst term.

Defined results: null and empty texts score as a text without any term. Without labels of
both kinds every document scores the toxic share, or 0. Repeated ids with differing labels
count as toxic. Rows with null labels or ids teach nothing. Ids and other columns are no inputs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from inquest.llm.common import SPACE, present, spool

SPAN, DECAY = 5, 0.6      # a subsequence spans at most SPAN + 1 characters
WINDOW = 24               # longer terms are cut into windows of so many characters
REMEMBER = 100_000        # terms whose margin a task remembers
CODES = 32 ** 3
STRONG = 20.0             # log-likelihood from which a term is toxic on its own evidence
LEAST_RATIO = 5.0         # times as frequent in toxic documents, at least


def letter_classes() -> np.ndarray:
    """A class from 1 to 31 for each letter below U+3000, accents folded; 0 for other characters."""
    out = np.zeros(0x3000, dtype=np.int64)
    for c in range(len(out)):
        if unicodedata.category(chr(c))[0] == "L":
            base = unicodedata.normalize("NFKD", chr(c))[0].lower()
            out[c] = ord(base) - 96 if "a" <= base <= "z" else 27 + c % 5
    return out


CLASSES = letter_classes()
EDGE = "\x02"             # stands before each term, so that its beginning counts as such
CLASSES[ord(EDGE)] = 31


def subsequences(terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``term, code, weight``: each term's distinct subsequences of three letters, summed."""
    terms = [EDGE + t for t in terms]
    lengths = np.fromiter(map(len, terms), dtype=np.int64, count=len(terms))
    points = np.frombuffer("".join(terms).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = np.where(points < len(CLASSES), CLASSES[np.minimum(points, len(CLASSES) - 1)], 27)
    owner = np.repeat(np.arange(len(terms)), lengths)
    keys, weights = [], []
    for end in range(2, SPAN + 1):
        n = len(letters) - end
        if n <= 0:
            break
        first, last, same = letters[:n], letters[end:], owner[:n] == owner[end:]
        for mid in range(1, end):
            middle = letters[mid:mid + n]
            at = np.nonzero(same & (first > 0) & (middle > 0) & (last > 0))[0]
            keys.append(owner[at] * CODES + (first[at] * 32 + middle[at]) * 32 + last[at])
            weights.append(np.full(len(at), DECAY ** (end - 2)))
    if not keys:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(float)
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    cut = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1]) if len(key) else []
    if len(key):
        weight, key = np.add.reduceat(weight, cut), key[cut]
    return key // CODES, key % CODES, weight


def unit(terms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with each term's weights scaled to length one."""
    term, code, weight = subsequences(terms)
    norm = np.sqrt(np.bincount(term, weight ** 2, minlength=len(terms)))
    return term, code, weight / np.maximum(norm[term], 1e-12)


def kernel(terms: list[str], landmarks: np.ndarray, rows: int = 128) -> np.ndarray:
    """Likeness, 0 to 1, of each term to each landmark (columns of ``landmarks``)."""
    out = np.zeros((len(terms), landmarks.shape[1]))
    for at in range(0, len(terms), rows):
        term, code, weight = unit(terms[at:at + rows])
        if len(term):
            cut = np.concatenate([[0], np.nonzero(np.diff(term))[0] + 1])
            out[at + term[cut]] = np.add.reduceat(landmarks[code] * weight[:, None], cut, axis=0)
    return out


def dense(terms: list[str]) -> np.ndarray:
    out = np.zeros((CODES, len(terms)), dtype=np.float32)
    term, code, weight = unit(terms)
    out[code, term] = weight
    return out


class Model:
    """A weight for each subsequence, an offset, and the scale from margins to scores."""

    def __init__(self, weights: np.ndarray, offset: float):
        self.weights, self.offset = weights, offset
        self.slope, self.shift = 1.0, 0.0

    def margins(self, terms: list[str]) -> np.ndarray:
        term, code, weight = unit(terms)
        return np.bincount(term, weight * self.weights[code], minlength=len(terms)) + self.offset

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))


def terms_of(text: str) -> list[str]:
    """All terms of a text: its words, windows of long words, joined runs of single characters."""
    words = text.lower().split()
    out, run = words, []
    if max(map(len, words), default=0) > WINDOW:
        out = []
        for w in words:
            out.extend([w] if len(w) <= WINDOW else
                       [w[i:i + WINDOW] for i in range(0, len(w) - WINDOW // 2, WINDOW // 2)])
    joined = []
    for w in words:
        if len(w) == 1:
            run.append(w)
        elif run:
            if len(run) > 2:
                joined.append("".join(run))
            run = []
    if len(run) > 2:
        joined.append("".join(run))
    for w in joined:
        out = out + [w[i:i + WINDOW] for i in range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2)]
    return out


class Scorer:
    """Margins of texts, remembering the terms seen."""

    def __init__(self, model: Model):
        self.model, self.seen = model, {}

    def worst(self, texts: list[str]) -> tuple[np.ndarray, list[str]]:
        margins, words = np.full(len(texts), self.model.offset), [""] * len(texts)
        for i, text in enumerate(texts):
            terms = terms_of(text)
            for at in range(0, len(terms), REMEMBER):
                part = terms[at:at + REMEMBER]
                if len(self.seen) + len(part) > 2 * REMEMBER:
                    self.seen = {}
                new = list({w for w in part if w not in self.seen})
                if new:
                    self.seen.update(zip(new, self.model.margins(new).tolist()))
                top = max(part, key=self.seen.__getitem__)
                if self.seen[top] > margins[i]:
                    margins[i], words[i] = self.seen[top], top
        return margins, words


def machine(toxic: dict[str, float], clean: dict[str, float], landmarks: int, seed: int) -> Model:
    """Fit the support vector machine on weighted terms of both kinds."""
    draw = np.random.default_rng(seed)
    bad, good = sorted(toxic), sorted(w for w in clean if w not in toxic)
    # tolerate an inserted character and a separator after each letter
    extra = []
    for w in bad:
        if len(w) > 3:
            at = int(draw.integers(1, len(w)))
            extra += [w[:at] + chr(97 + int(draw.integers(26))) + w[at:], ".".join(w)]
    words = bad + extra + good
    y = np.array([1.0] * (len(bad) + len(extra)) + [-1.0] * len(good))
    weight = np.array([toxic[w] for w in bad] + [1.0] * len(extra) + [clean[w] for w in good])
    weight = np.sqrt(weight)
    for side in (y > 0, y < 0):              # both kinds weigh alike
        weight[side] *= len(y) / 2 / max(weight[side].sum(), 1e-12)
    # landmarks: toxic terms far from each other, and clean ones at random
    pool = sorted(bad, key=lambda w: (-toxic[w], w))[:400]
    spread = kernel(pool, dense(pool)) if pool else np.zeros((0, 0))
    chosen, near = [], np.zeros(len(pool))
    while len(chosen) < min(landmarks * 2 // 3, len(pool)):
        at = int(np.argmin(near)) if chosen else 0
        if chosen and near[at] > 0.98:
            break
        chosen.append(at)
        near = np.maximum(near, spread[at])
    marks = [pool[i] for i in chosen]
    marks += [good[i] for i in draw.permutation(len(good))[:landmarks - len(marks)]]
    phi = dense(marks)
    values, vectors = np.linalg.eigh(kernel(marks, phi))
    keep = values > 1e-6
    half = vectors[:, keep] / np.sqrt(values[keep])
    z = np.column_stack([kernel(words, phi) @ half, np.ones(len(words))])
    w, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1]) * 0.5
    ridge[-1, -1] = 1e-6
    for _ in range(30):                      # Newton steps on the squared hinge loss
        inside = y * (z @ w) < 1
        a, c = z[inside], weight[inside]
        new = np.linalg.solve(ridge + (a * c[:, None]).T @ a, (a * c[:, None]).T @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return Model(phi @ (half @ w[:-1]), float(w[-1]))


def calibrate(model: Model, margin: np.ndarray, y: np.ndarray, toxic_share: float) -> None:
    """Logistic scale from margins to scores, with softened labels, at the given share."""
    n1, n0 = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y > 0, toxic_share / n1, (1 - toxic_share) / n0) * len(y)
    x, w = np.column_stack([margin, np.ones(len(margin))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        h = weight * np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((x * h[:, None]).T @ x + np.eye(2) * 1e-6,
                               x.T @ (weight * (p - goal)))
        w = w - step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.shift = max(float(w[0]), 1e-6), float(w[1])


def fold(id_col: Column) -> Column:
    """True for the rows that are never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_clean: int = 8000, sample_toxic: int = 4000,
          landmarks: int = 160, rounds: int = 2, id_col: str = "doc_id",
          text_col: str = "text") -> Model:
    """Fit on a sample of labelled documents outside the held-out fold."""
    known = (labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()
                           & ~fold(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("y")))
    ids = None
    for y, n in ((0, sample_clean), (1, sample_toxic)):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        ids = part if ids is None else ids.unionByName(part)
    # the sample's size is bounded by the two parameters
    sample = spool(docs.select(F.col(id_col).alias("doc_id"),
                               present(F.col(text_col)).alias("text"))
                   .join(F.broadcast(ids), "doc_id"))
    size = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not size.get(0) or not size.get(1):
        model = Model(np.zeros(CODES), 0.0)
        model.slope, model.shift = 1e-6, (50.0 if size.get(1) else -50.0)
        return model
    share = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    words = F.filter(F.split(F.lower("text"), SPACE + "+"), lambda w: w != "")
    pairs = F.arrays_zip(F.col("words").alias("word"), F.concat(
        F.array(F.lit("")), F.col("words")).alias("before"))
    seen = (sample.select("doc_id", "y", words.alias("words"))
            .select("doc_id", "y", F.explode(pairs).alias("p"))
            .select("doc_id", "y", F.col("p.word").alias("word"), F.col("p.before").alias("before"))
            .filter(F.length("word").between(3, WINDOW)))
    # evidence counts different neighbours: a copied document is no new evidence
    varied = seen.filter("y = 1").groupBy("word", "before").count().groupBy("word").agg(
        F.count("*").alias("contexts"))
    docs_with = seen.groupBy("word", "doc_id").agg(F.max("y").alias("y")).groupBy("word").agg(
        F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    ratio = F.col("p") / size[1] / ((F.col("n") + 0.5) / size[0])
    # a common word is a little more frequent here or there, however much evidence there is
    counts = spool(docs_with.join(varied, "word", "left").withColumn(
        "odds", F.when(ratio >= LEAST_RATIO, F.least("p", "contexts") * F.log(ratio))
        .otherwise(-1.0)))
    # the witnesses: every strong term; with too little evidence, each toxic document's best one
    strong = counts.filter(F.col("odds") >= STRONG)
    witness = (seen.filter("y = 1").join(counts.filter("odds > 0"), "word").groupBy("doc_id")
               .agg(F.max_by("word", F.struct("odds", "word")).alias("word")))
    toxic = {r["word"]: float(r["p"]) for r in
             strong.orderBy(F.desc("odds"), "word").limit(2000).collect()}
    if not toxic:
        toxic = {r["word"]: float(r["count"]) for r in witness.groupBy("word").count().collect()}
    plain = counts.filter("n > 0")
    clean = {r["word"]: float(r["n"]) for part in (
        plain.orderBy(F.desc("n"), "word").limit(4000),
        plain.orderBy(F.xxhash64("word"), "word").limit(20000)) for r in part.collect()}
    for step in range(rounds + 1):
        model = machine(toxic or {"": 1.0}, clean, landmarks, step)
        found = worst_terms(sample, model).collect()
        if step == rounds:
            break
        # what clean documents hold is clean, however alike it is to a toxic term
        hard = {r["term"] for r in found if r["y"] == 0 and r["margin"] > -0.5 and r["term"]}
        clean |= {w: max(clean.get(w, 0.0), 5.0) for w in hard}
        clean = {w: n for w, n in clean.items() if w not in toxic}
    calibrate(model, np.array([r["margin"] for r in found]), np.array([r["y"] for r in found]),
              share[1] / (share[0] + share[1]))
    return model


def worst_terms(sample: DataFrame, model: Model) -> DataFrame:
    """``y, margin, term`` for each row of the bounded sample."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in parts:
            margin, term = scorer.worst(part.column(1).to_pylist())
            yield pa.record_batch([part.column(0), pa.array(margin), pa.array(term, pa.string())],
                                  names=["y", "margin", "term"])
    return sample.select(F.col("y").cast("int"), "text").mapInArrow(
        run, "y int, margin double, term string")


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in parts:
            margin, _ = scorer.worst(part.column(1).to_pylist())
            yield pa.record_batch([part.column(0), pa.array(shared.value.score(margin))],
                                  names=["doc_id", "score"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       present(F.col(text_col)).alias("text")).mapInArrow(
        run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text",
                  threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in parts:
            margin, _ = scorer.worst([x or "" for x in part.column(at).to_pylist()])
            yield part.filter(pa.array(shared.value.score(margin) < threshold))
    return docs.mapInArrow(run, docs.schema)
