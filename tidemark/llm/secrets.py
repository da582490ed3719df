"""Secret scans by one combined deterministic automaton.

Rule patterns (a plain subset of regex syntax: literals, classes, optional parts, repeats,
alternatives) become an NFA, the NFA a DFA by subset construction, and the DFA is minimised.
The combined automaton of all rules finds, in one pass over the bytes, which rule begins to
match in which line; its transitions are one numpy array, and many lines advance in lockstep.
Lines that hit are then scanned rule by rule with that rule's own arrays: a forward pass for
the first end, a backward pass for the leftmost start, a forward pass for the longest end.

Cases: null text counts as empty; spans are code points, end exclusive; matches of a rule do
not overlap; a match that fails its length test still takes its place, as leftmost
non-overlapping search demands; columns besides id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from re import _constants as C, _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.common import byte_view, column, slices, small_batches

# ---- fixed values: the rules, as the contract and public key formats state them ----
#: (name, pattern, least length in all, least length of the value at the match's end, value's class)
BASE_RULES = (
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 1, 12, r"[A-Za-z0-9+/_.=-]"),
    ("access", r"AKIA[A-Z0-9]+", 18, 0, ""),
    ("hex", r"[0-9a-f]+", 16, 0, ""),
)
MORE_RULES = (
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 40, 0, ""),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20, 0, ""),
    ("google", r"AIza[A-Za-z0-9_-]+", 39, 0, ""),
    ("stripe", r"[sr]k_live_[A-Za-z0-9]+", 24, 0, ""),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, 0, ""),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, 0, ""),
)
RULES = BASE_RULES + MORE_RULES


class _Nfa:
    """States with moves on byte sets and empty moves."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, tree, start: int, reverse: bool = False) -> int:
        """Append a parsed pattern after ``start``; the end state."""
        for op, arg in reversed(tree) if reverse else tree:
            if op is C.LITERAL:
                start = self._move(start, frozenset([arg]))
            elif op is C.IN:
                start = self._move(start, _members(arg))
            elif op is C.SUBPATTERN:
                start = self.add(arg[3], start, reverse)
            elif op is C.BRANCH:
                end = self.state()
                for part in arg[1]:
                    self.empty[self.add(part, start, reverse)].append(end)
                start = end
            elif op is C.MAX_REPEAT:
                least, most, part = arg
                for _ in range(least):
                    start = self.add(part, start, reverse)
                if most is C.MAXREPEAT:
                    loop = self.state()
                    self.empty[start].append(loop)
                    self.empty[self.add(part, loop, reverse)].append(loop)
                    start = loop
                else:
                    end = self.state()
                    self.empty[start].append(end)
                    for _ in range(most - least):
                        start = self.add(part, start, reverse)
                        self.empty[start].append(end)
                    start = end
            else:
                raise ValueError(f"unsupported in a rule: {op}")
        return start

    def _move(self, start: int, members: frozenset) -> int:
        end = self.state()
        self.moves[start].append((members, end))
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


def _members(items) -> frozenset:
    found: set[int] = set()
    for op, arg in items:
        found |= {arg} if op is C.LITERAL else set(range(arg[0], arg[1] + 1))
    return frozenset(found)


class Automaton:
    """Minimised DFA: ``move[state, byte]`` with state 0 dead (anchored) or start (unanchored)."""

    def __init__(self, move: np.ndarray, accepts: np.ndarray, start: int):
        self.move, self.accepts, self.start = move, accepts, start

    @classmethod
    def of(cls, patterns: list[str], anchored: bool, reverse: bool = False) -> "Automaton":
        nfa, ends = _Nfa(), {}
        start = nfa.state()
        for k, pattern in enumerate(patterns):
            ends[nfa.add(_parser.parse(pattern), start, reverse)] = k
        base = nfa.closure([start])
        order, table, todo = {base: 0}, [], [base]
        for states in todo:  # subset construction; grows as it runs
            row = np.zeros(256, np.int32)
            reach: list[set[int]] = [set() for _ in range(256)]
            for s in states:
                for members, end in nfa.moves[s]:
                    for b in members:
                        reach[b].add(end)
            made: dict[frozenset, int] = {}
            for b in range(256):
                key = frozenset(reach[b])
                if key not in made:
                    nxt = nfa.closure(key if anchored else key | {start})
                    if nxt not in order:
                        order[nxt] = len(order)
                        todo.append(nxt)
                    made[key] = order[nxt]
                row[b] = made[key]
            table.append(row)
        accepts = np.array([sum(1 << ends[s] for s in states if s in ends) for states in order], np.int64)
        return cls._minimised(np.array(table), accepts)

    @classmethod
    def _minimised(cls, move: np.ndarray, accepts: np.ndarray) -> "Automaton":
        """Moore's refinement: split classes until moves agree."""
        block = np.unique(accepts, return_inverse=True)[1]
        while True:
            refined = np.unique(np.column_stack([block, block[move]]), axis=0, return_inverse=True)[1].ravel()
            if refined.max() == block.max():
                break
            block = refined
        first = np.unique(block, return_index=True)[1]
        return cls(block[move[first]].astype(np.int32), accepts[first], int(block[0]))

    def first_end(self, data: bytes, at: int) -> int:
        """End of the first accepted prefix of data[at:] (an unanchored automaton: of any match), or -1."""
        rows, good, s = self._lists()
        for i in range(at, len(data)):
            s = rows[s][data[i]]
            if good[s]:
                return i + 1
        return -1

    def longest(self, data: bytes, at: int, step: int = 1, stop: int | None = None) -> int:
        """Farthest accepted place from ``at`` going by ``step`` (anchored), or -1."""
        rows, good, s, best = *self._lists(), -1
        stop = (len(data) if step > 0 else 0) if stop is None else stop
        dead = self.dead
        i = at
        while i != stop:
            s = rows[s][data[i if step > 0 else i - 1]]
            i += step
            if s == dead:
                break
            if good[s]:
                best = i
        return best

    def _lists(self):
        if not hasattr(self, "_rows"):
            self._rows, self._good = self.move.tolist(), (self.accepts > 0).tolist()
            alone = [s for s in range(len(self._rows)) if not self._good[s] and set(self._rows[s]) == {s}]
            self.dead = alone[0] if alone else -1
        return self._rows, self._good, self.start


def _detection(rule) -> str:
    """What must be seen before a rule can match: the pattern with its last repeat taken once.

    Only a rule that is nothing but one repeated class counts to its least length here;
    counting behind prefixes would multiply the states of the combined automaton.
    """
    _, pattern, least, _, _ = rule
    once = pattern.removesuffix("+")
    return f"{once}{{{least}}}" if once.startswith("[") and once.find("]") == len(once) - 1 else once


@lru_cache(maxsize=4)
def _automata(rules: tuple) -> tuple[Automaton, list[tuple[Automaton, Automaton, Automaton]], np.ndarray]:
    combined = Automaton.of([_detection(r) for r in rules], anchored=False)
    own = [(Automaton.of([p], False), Automaton.of([p], True, reverse=True), Automaton.of([p], True)) for _, p, *_ in rules]
    # bytes after which every state is the start state: nothing spans them
    resets = (combined.move == combined.start).all(axis=0)
    return combined, own, resets


def _hits(raw: np.ndarray, ends: np.ndarray, combined: Automaton, resets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, rules that hit as bits) of each line with a hit; one pass over the bytes."""
    cut = np.flatnonzero(resets[raw] & (raw == 10)) + 1 if resets[10] else np.zeros(0, np.int64)
    begins = np.unique(np.concatenate([ends[:-1], cut]))
    begins = begins[begins < len(raw)]
    lengths = np.diff(begins, append=len(raw))
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[order], lengths[order]
    live = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), "right")
    flat, width = combined.move.ravel(), 256
    state = np.full(len(begins), combined.start, np.int32)
    got = np.zeros(len(begins), np.int64)
    accepts, final = combined.accepts, combined.accepts > 0
    for i, n in enumerate(live.tolist()):
        if n < 24:  # few long lines are left: plain loops are quicker than short arrays
            rows, good, _ = combined._lists()
            for j in range(n):
                s, found = int(state[j]), 0
                for b in raw[begins[j] + i : begins[j] + lengths[j]].tobytes():
                    s = rows[s][b]
                    if good[s]:
                        found |= int(accepts[s])
                got[j] |= found
            break
        s = flat[state[:n] * width + raw[begins[:n] + i]]
        state[:n] = s
        hit = final[s]
        if hit.any():
            got[:n][hit] |= accepts[s[hit]]
    line = np.flatnonzero(got)
    return np.searchsorted(ends, begins[line], "right") - 1, got[line]


def _spans(data: bytes, rule, automata) -> list[tuple[int, int]]:
    """Leftmost non-overlapping byte spans of a rule that pass its length tests."""
    _, _, least, value, chars = rule
    seek, back, ahead = automata
    members = _value_bytes(chars) if value else None
    out, at = [], 0
    while (end := seek.first_end(data, at)) >= 0:
        start = back.longest(data, end, -1, at)
        if start < 0:
            raise AssertionError(f"rule {rule[0]}: an end without a start")
        end = ahead.longest(data, start)
        n = end - start
        if value:
            n = end - _value_start(data, start, end, members)
        if n >= (value or least):
            out.append((start, end))
        at = end
    return out


@lru_cache(maxsize=16)
def _value_bytes(chars: str) -> frozenset:
    return _members(_parser.parse(chars)[0][1])


def _value_start(data: bytes, start: int, end: int, members: frozenset) -> int:
    """Where the value after the first : or = of an assignment begins."""
    i = start
    while data[i] not in b":=":
        i += 1
    i += 1
    while data[i] not in members or data[i] in b"\"' ":
        i += 1
    return i


def scan_texts(text: pa.Array, rules: tuple = RULES) -> list[dict[str, list[tuple[int, int]]]]:
    """Code-point spans by rule of each text."""
    combined, own, resets = _automata(rules)
    out: list[dict] = [{} for _ in range(len(text))]
    for at, part in slices(text):
        raw, ends = byte_view(part)
        bits = np.zeros(len(part), np.int64)
        which, got = _hits(raw, ends, combined, resets)
        np.bitwise_or.at(bits, which, got)
        for i in np.flatnonzero(bits).tolist():
            data = raw[ends[i] : ends[i + 1]].tobytes()
            wide = not data.isascii()
            for k, rule in enumerate(rules):
                if bits[i] >> k & 1:
                    spans = _spans(data, rule, own[k])
                    if wide:
                        spans = [((a := len(data[:s].decode("utf-8", "surrogatepass"))), a + e - s) for s, e in spans]
                    if spans:
                        out[at + i][rule[0]] = spans
    return out


def _digest(spans: dict[str, list[tuple[int, int]]], names: list[str]) -> str:
    found = sorted((s, k, e) for k, name in enumerate(names) for s, e in spans.get(name, ()))
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in found)


def find_secrets(docs: DataFrame, rules: tuple = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id and ``found``, an array of (kind, start, stop) in order of start, then of rule."""
    small_batches(docs.sparkSession)
    names = [r[0] for r in rules]
    kind = docs.schema[id_col].dataType
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("found", T.ArrayType(span)), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    base = [r[0] for r in rules if r in BASE_RULES]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = scan_texts(column(batch, text_col), rules)
            rows = [[{"kind": names[k], "start": s, "stop": e} for s, k, e in sorted((s, k, e) for k, n in enumerate(names) for s, e in x.get(n, ()))] for x in spans]
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, id_col),
                    pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))),
                    pa.array([hashlib.sha256(_digest(x, base).encode()).hexdigest() for x in spans], pa.string()),
                    pa.array([_digest(x, names) for x in spans], pa.string()),
                ],
                names=schema.names,
            )

    return docs.select(id_col, text_col).mapInArrow(scan, schema)


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts by base kind and the digests that the query returns."""
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return find_secrets(docs).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), "base_sha256", "spans"
    )
