"""Secrets: all rules in one byte pass of one deterministic automaton.

Each rule is a regular expression over bytes. Their positions (one for each byte class of a
pattern) form one automaton of all rules; subset construction makes it deterministic, partition
refinement makes it minimal, and its transitions lie in one array of states by byte classes. A
text is read once, byte by byte; the pass tells which rules can have a match in it that is
kept. Only for those the exact spans follow: the rule's reversed automaton marks every place
where a match begins, and its forward one finds the longest match from the leftmost of them.

A rule's matches are leftmost, longest and do not overlap each other; a match that does not fit
the rule's ``keep`` pattern is used up and dropped. Matches of different rules may overlap.

Defined results: a null text is the empty text, without spans. Offsets count code points, ends
are exclusive. Every row has a result, repeated and null ids too; ties of start are listed in
the order of the rules. Texts of any length take linear time. An empty table gives an empty
result. Patterns that match the empty text are refused, so are rules whose automaton would
have more states than ``most_states``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from inquest.llm.common import present

BYTES = (1 << 256) - 1                   # a byte class is a set of bytes as a bit mask


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches, ``keep`` (by default the same) says which of them count.

    ``sight`` (by default ``pattern``) is what the pass over all rules looks for: every match to be
    kept must hold it. Open ends and counts in it multiply the states of the combined automaton.
    """
    kind: str
    pattern: str
    keep: str | None = None
    sight: str | None = None
    fold: bool = False                   # ASCII letters in either case


# The base rules, as the contract names them, then public formats of credentials.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""
BASE = (
    Rule("assign", ASSIGN + "+", ASSIGN + "{6,}", ASSIGN, fold=True),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16,}", "AKIA[A-Z0-9]"),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{24,}", "[0-9a-f]{24}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN\x20([A-Z0-9]+\x20)*PRIVATE\x20KEY-----",
         sight=r"-----BEGIN\x20"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", sight="eyJ"),
    Rule("code_host", r"gh[opsru]_[A-Za-z0-9]+", r"gh[opsru]_[A-Za-z0-9]{36,}", "gh[opsru]_"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]+", r"AIza[A-Za-z0-9_-]{35,}", "AIza"),
    Rule("payment", r"[rs]k_(live|test)_[A-Za-z0-9]+", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}",
         "[rs]k_(live|test)_"),
    Rule("address", r"[a-z]+://[A-Za-z0-9._~%+-]+:[A-Za-z0-9._~%!$&*+=-]+@[A-Za-z0-9.-]+",
         sight=r"[a-z]://[A-Za-z0-9._~%+-]+:"),
)
RULES = (*BASE, *MORE)


# -- patterns ---------------------------------------------------------------------------------

@dataclass
class Piece:
    """Part of a pattern: whether it may be empty, and its first and last positions."""
    empty: bool
    first: int
    last: int


@dataclass
class Positions:
    """All positions of some patterns: a byte class each, and the positions that may follow."""
    classes: list[int] = field(default_factory=list)
    follow: list[int] = field(default_factory=list)

    def add(self, byte_class: int) -> Piece:
        self.classes.append(byte_class)
        self.follow.append(0)
        bit = 1 << len(self.classes) - 1
        return Piece(False, bit, bit)

    def join(self, left: Piece, right: Piece) -> Piece:
        for p in members(left.last):
            self.follow[p] |= right.first
        return Piece(left.empty and right.empty,
                     left.first | (right.first if left.empty else 0),
                     right.last | (left.last if right.empty else 0))

    def loop(self, piece: Piece) -> Piece:
        for p in members(piece.last):
            self.follow[p] |= piece.first
        return piece


def members(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


class Pattern:
    """Reads one pattern: literals, classes, groups, ``|``, ``? * +``, ``{m}``, ``{m,}``, ``{m,n}``."""

    def __init__(self, text: str, fold: bool, into: Positions):
        self.text, self.fold, self.into, self.at = text, fold, into, 0
        self.whole = self.either()
        if self.at < len(text):
            raise ValueError(f"pattern {text!r}: unexpected {text[self.at]!r} at {self.at}")

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        c = self.peek()
        if not c:
            raise ValueError(f"pattern {self.text!r} ends too soon")
        self.at += 1
        return c

    def either(self) -> Piece:
        out = self.sequence()
        while self.peek() == "|":
            self.take()
            other = self.sequence()
            out = Piece(out.empty or other.empty, out.first | other.first, out.last | other.last)
        return out

    def sequence(self) -> Piece:
        out = Piece(True, 0, 0)
        while self.peek() not in ("", "|", ")"):
            out = self.into.join(out, self.repeated())
        return out

    def repeated(self) -> Piece:
        start = self.at
        piece = self.atom()
        stop = self.at
        least, most = self.times()

        def copy() -> Piece:
            end, self.at = self.at, start
            again = self.atom()
            assert self.at == stop
            self.at = end
            return again
        if least == 0 and most == 0:
            return Piece(True, 0, 0)
        out = piece
        for _ in range(1, least):
            piece = copy()
            out = self.into.join(out, piece)
        if most is None:                  # the last copy may come again
            self.into.loop(piece)
        else:
            for _ in range(max(1, least), most):
                more = copy()
                out = self.into.join(out, Piece(True, more.first, more.last))
        return Piece(True, out.first, out.last) if least == 0 else out

    def times(self) -> tuple[int, int | None]:
        c = self.peek()
        if c in ("?", "*", "+") and c:
            self.take()
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if c != "{":
            return 1, 1
        self.take()
        inside = ""
        while self.peek() != "}":
            inside += self.take()
        self.take()
        low, comma, high = inside.partition(",")
        return int(low), (int(high) if high else None) if comma else int(low)

    def atom(self) -> Piece:
        c = self.take()
        if c == "(":
            out = self.either()
            if self.take() != ")":
                raise ValueError(f"pattern {self.text!r}: group not closed")
            return out
        if c == "[":
            return self.into.add(self.byte_class())
        if c == ".":
            return self.into.add(BYTES & ~(1 << 10))
        if c in "?*+{":
            raise ValueError(f"pattern {self.text!r}: nothing to repeat at {self.at - 1}")
        return self.into.add(self.cases(1 << (self.escape() if c == "\\" else self.byte(c))))

    def byte(self, c: str) -> int:
        if ord(c) > 127:
            raise ValueError(f"pattern {self.text!r}: write bytes beyond ASCII as \\xHH")
        return ord(c)

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            return int(self.take() + self.take(), 16)
        if c.isalnum():
            known = {"n": 10, "r": 13, "t": 9}
            if c not in known:
                raise ValueError(f"pattern {self.text!r}: unknown escape \\{c}")
            return known[c]
        return self.byte(c)

    def byte_class(self) -> int:
        negated = self.peek() == "^"
        if negated:
            self.take()
        mask, first = 0, True
        while first or self.peek() != "]":
            first = False
            c = self.take()
            low = high = self.escape() if c == "\\" else self.byte(c)
            if self.peek() == "-" and self.text[self.at + 1:self.at + 2] not in ("]", ""):
                self.take()
                c = self.take()
                high = self.escape() if c == "\\" else self.byte(c)
            mask |= ((1 << high + 1) - 1) & ~((1 << low) - 1)
        self.take()
        mask = self.cases(mask)
        return BYTES & ~mask if negated else mask

    def cases(self, mask: int) -> int:
        if self.fold:
            for b in list(members(mask)):
                if chr(b).isascii() and chr(b).isalpha():
                    mask |= 1 << (b ^ 32)
        return mask


# -- automata ---------------------------------------------------------------------------------

class Automaton:
    """The minimal deterministic automaton of some patterns, as a flat transition array.

    ``anywhere`` lets a match begin at each byte. ``backward`` reads the patterns from their
    ends. ``tags`` has, for each state, the set of patterns that end there as a bit mask; states
    with tags have the highest numbers. State numbers are multiples of the class count.
    """

    def __init__(self, patterns: list[tuple[str, bool]], anywhere: bool, backward: bool = False,
                 most_states: int = 50_000):
        known = Positions()
        wholes = [Pattern(text, fold, known).whole for text, fold in patterns]
        for (text, _), whole in zip(patterns, wholes):
            if whole.empty:
                raise ValueError(f"pattern {text!r} matches the empty text")
        follow, begins, ends = known.follow, [w.first for w in wholes], [w.last for w in wholes]
        if backward:
            before = [0] * len(follow)
            for p, after in enumerate(follow):
                for q in members(after):
                    before[q] |= 1 << p
            follow, begins, ends = before, ends, begins
        signature: dict[tuple, int] = {}
        classes, inside = bytearray(256), []
        for b in range(256):
            fits = 0
            for p, mask in enumerate(known.classes):
                fits |= (mask >> b & 1) << p
            if fits not in signature:
                signature[fits] = len(inside)
                inside.append(fits)
            classes[b] = signature[fits]
        table, tags, start, dead = self.determined(follow, begins, ends, inside, anywhere,
                                                   most_states)
        self.minimise(table, tags, start, dead)
        self.classes = bytes(classes)

    @staticmethod
    def determined(follow, begins, ends, inside, anywhere, most_states):
        first = 0
        for b in begins:
            first |= b
        START = 1 << len(follow)                          # before the first byte
        number, order = {START: 0, 0: 1}, [START, 0]
        table, tags = [], []
        for state in order:
            after = first if anywhere or state == START else 0
            for p in members(state & ~START):
                after |= follow[p]
            row = []
            for fits in inside:
                to = after & fits
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                    if len(order) > most_states:
                        raise ValueError(f"the rules need more than {most_states} states")
                row.append(number[to])
            table.append(row)
            tags.append(sum(1 << i for i, e in enumerate(ends) if e & state))
        return np.array(table, dtype=np.int32), tags, 0, 1

    def minimise(self, table: np.ndarray, tags: list[int], start: int, dead: int) -> None:
        """Refine the partition by tags until no two states of a block part ways."""
        kinds = {t: i for i, t in enumerate(dict.fromkeys(tags))}
        block = np.array([kinds[t] for t in tags], dtype=np.int32)
        count = len(kinds)
        while True:
            rows = np.ascontiguousarray(np.column_stack([block, block[table]]))
            keys = rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
            _, block = np.unique(keys, return_inverse=True)
            block = block.astype(np.int32)
            if block.max() + 1 == count:
                break
            count = int(block.max()) + 1
        one = np.zeros(count, dtype=np.int64)
        one[block] = np.arange(len(block))                # any state of each block
        marks = [tags[s] for s in one]
        order = sorted(range(count), key=lambda b: marks[b] != 0)
        place = np.empty(count, dtype=np.int64)
        place[order] = np.arange(count)
        self.width = table.shape[1]
        self.table = (place[block[table[one[order]]]] * self.width).ravel().tolist()
        self.tags = dict((i * self.width, marks[b]) for i, b in enumerate(order) if marks[b])
        self.accepting = min(self.tags)                   # states from here on have tags
        self.start = int(place[block[start]]) * self.width
        self.dead = int(place[block[dead]]) * self.width if not self.alive(place[block[dead]]) else -1
        self.states = count

    def alive(self, state: int) -> bool:
        """Whether any other state can be reached, as it always can when matches begin anywhere."""
        at = int(state) * self.width
        return any(to != at for to in self.table[at:at + self.width])

    def seen(self, data: bytes) -> int:
        """The patterns that end somewhere in ``data``, in one pass over its bytes."""
        table, accepting, tags, state, out = self.table, self.accepting, self.tags, self.start, 0
        for c in data.translate(self.classes):
            state = table[state + c]
            if state >= accepting:
                out |= tags[state]
        return out

    def begins(self, data: bytes) -> list[int]:
        """Backward only: every offset where a match begins, from the last to the first."""
        table, accepting, state, out = self.table, self.accepting, self.start, []
        at = len(data)
        for c in reversed(data.translate(self.classes)):
            state = table[state + c]
            at -= 1
            if state >= accepting:
                out.append(at)
        return out

    def longest(self, data: bytes, start: int) -> tuple[int, int]:
        """End and tags of the longest match from ``start`` on; ``data`` in byte classes."""
        table, accepting, tags, dead = self.table, self.accepting, self.tags, self.dead
        state, end, mark = self.start, start, 0
        for at in range(start, len(data)):
            state = table[state + data[at]]
            if state >= accepting:
                end, mark = at + 1, tags[state]
            elif state == dead:
                break
        return end, mark


class Scanner:
    """The combined automaton of all rules, and each rule's own pair for exact spans."""

    def __init__(self, rules: tuple[Rule, ...], most_states: int = 50_000):
        self.rules = rules
        kept = [(r.keep or r.pattern, r.fold) for r in rules]
        self.every = Automaton([(r.sight or r.pattern, r.fold) for r in rules], True,
                               most_states=most_states)
        self.back = [Automaton([(r.pattern, r.fold)], True, backward=True, most_states=most_states)
                     for r in rules]
        self.ahead = [Automaton([(r.pattern, r.fold), keep], False, most_states=most_states)
                      for r, keep in zip(rules, kept)]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """``start, rule, end`` in bytes, ordered."""
        out = []
        for k in members(self.every.seen(data)):
            ahead, free = self.ahead[k], 0
            coded = data.translate(ahead.classes)
            for start in reversed(self.back[k].begins(data)):
                if start >= free:
                    free, mark = ahead.longest(coded, start)
                    if mark & 2:
                        out.append((start, k, free))
        return sorted(out)


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES, most_states: int = 50_000) -> Scanner:
    return Scanner(rules, most_states)


def code_points(data: bytes, offsets: list[int]) -> list[int]:
    """How many code points precede each byte offset."""
    if data.isascii():
        return offsets
    leads = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [int(leads[x]) for x in offsets]


# -- tables -----------------------------------------------------------------------------------

def inputs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       present(F.col(text_col)).cast("binary").alias("text"))


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, most_states: int = 50_000,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` for every document: an array of ``kind, start, end``."""
    scan = scanner(tuple(rules), most_states)           # travels with the task, by value

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [r.kind for r in scan.rules]
        form = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()),
                                   ("end", pa.int32())]))
        for part in parts:
            found = []
            for data in part.column(1).to_pylist():
                spans = scan.spans(data)
                if spans:
                    starts = code_points(data, [s for s, _, _ in spans])
                    ends = code_points(data, [e for _, _, e in spans])
                    spans = [{"kind": kinds[k], "start": s, "end": e}
                             for (_, k, _), s, e in zip(spans, starts, ends)]
                found.append(spans)
            yield pa.record_batch([part.column(0), pa.array(found, form)],
                                  names=["doc_id", "spans"])
    return inputs(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def masked(docs: DataFrame, rules: tuple[Rule, ...] = RULES, most_states: int = 50_000,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` with every secret replaced by the name of its kind."""
    scan = scanner(tuple(rules), most_states)           # travels with the task, by value

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = []
            for data in part.column(1).to_pylist():
                out, at = [], 0
                for start, k, end in scan.spans(data):
                    if end <= at:
                        continue
                    if start >= at:               # a span that runs on only widens what goes
                        out += [data[at:start], b"[" + scan.rules[k].kind.encode() + b"]"]
                    at = end
                texts.append(b"".join([*out, data[at:]]).decode("utf-8", "replace"))
            yield pa.record_batch([part.column(0), pa.array(texts, pa.string())],
                                  names=["doc_id", "text"])
    return inputs(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"], s["end"])), ",")


def report(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans, of ``secrets``' rows."""
    def among(kinds: list[str]) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(kinds))
    kinds = [r.kind for r in base]
    return found.select("doc_id", *[F.size(among([k])).cast("long").alias(f"n_{k}") for k in kinds],
                        F.sha2(listed(among(kinds)), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))
