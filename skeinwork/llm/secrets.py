"""Secret scans with one deterministic automaton for all rules.

Every rule is a small regular expression over bytes. Each is turned into a
position automaton, determinised by subset construction with leftmost-longest
order (a state is the ordered list of live starts, so that the earliest start
wins), minimised, and the rules' automata are multiplied into one machine that
is minimised again. Scanning reads each byte of a text once for all rules; the
states in which a match has just ended are the only ones that cost more than a
table look-up.

Defined results: a null or empty text has no spans; offsets are code points,
end exclusive; rules do not influence one another, so spans of different kinds
may overlap; repeated rows give repeated results; columns other than the id and
the text are not read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import fresh, map_batches, read

# --------------------------------------------------------------------------
# rules


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds spans; a span stays if it is ``min_bytes`` long and, when
    ``min_group`` is set, the pattern's last group has that many bytes.

    Once a match could end, every further byte must either extend it or end it;
    ``compile_rules`` refuses other patterns, which would need a second pass.
    """

    kind: str
    pattern: str
    min_bytes: int = 0
    min_group: int = 0


_PEM = "-----{} (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"

#: The base kinds, in the order in which ties are listed, then the added ones.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", min_group=6),
    Rule("access", r"AKIA[A-Z0-9]+", min_bytes=20),
    Rule("hex", r"[0-9a-f]{24,}", min_bytes=24),
    Rule("pem", _PEM.format("BEGIN")),  # also of a block that is cut off
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", min_bytes=40),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]+", min_bytes=20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", min_bytes=40),
    # The whole key; up to four hyphens for headers such as DEK-Info, the backslash for escaped line ends.
    Rule("pem_block", rf"{_PEM.format('BEGIN')}(?:-{{0,4}}[A-Za-z0-9+/=:,\\\x20\x09-\x0D])+{_PEM.format('END')}"),
)
BASE_KINDS = ("assign", "access", "hex")

# --------------------------------------------------------------------------
# regular expression -> position automaton


class _Parser:
    """Literals, escapes, classes, groups, ``(?i:)``, alternation and quantifiers."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0
        self.fold = False
        self.moves: list[frozenset[int]] = []  # byte set of each position
        self.follow: list[set[int]] = []

    def parse(self):
        node = self._alternatives()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} in {self.p!r}")
        return node

    def _alternatives(self):
        branches = [self._sequence()]
        while self._peek() == "|":
            self.i += 1
            branches.append(self._sequence())
        return branches[0] if len(branches) == 1 else ("alt", branches)

    def _peek(self):
        return self.p[self.i] if self.i < len(self.p) else ""

    def _sequence(self):
        items = []
        while self._peek() not in ("", "|", ")"):
            items.append(self._repeated())
        return ("seq", items)

    def _repeated(self):
        atom = self._atom()
        c = self._peek()
        bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c)
        if bounds:
            self.i += 1
        elif c == "{":
            m = re.compile(r"\{(\d+)(,(\d*))?\}").match(self.p, self.i)
            self.i = m.end()
            low = int(m[1])
            bounds = (low, low if not m[2] else int(m[3]) if m[3] else None)
        return ("rep", atom, *bounds) if bounds else atom

    def _atom(self):
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            before = self.fold
            if self.p.startswith("?:", self.i):
                self.i += 2
            elif self.p.startswith("?i:", self.i):
                self.i += 3
                self.fold = True
            inner = self._alternatives()
            if self._peek() != ")":
                raise ValueError(f"unclosed group in {self.p!r}")
            self.i += 1
            self.fold = before
            return inner
        if c == "[":
            return ("set", self._set())
        if c in "*+?{^$.":
            raise ValueError(f"{c!r} is not supported in {self.p!r}")
        return ("set", self._folded({self._literal()}))

    def _literal(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "\\":
            c = self.p[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
            if c.isalnum():
                raise ValueError(f"\\{c} is not supported in {self.p!r}")
        if ord(c) > 127:
            raise ValueError("patterns are ASCII")
        return ord(c)

    def _folded(self, found: set[int]) -> frozenset[int]:
        if self.fold:
            found = found | {ord(chr(b).swapcase()) for b in found if chr(b).isalpha()}
        return frozenset(found)

    def _set(self) -> frozenset[int]:
        self.i += 1
        if self._peek() == "^":
            raise ValueError("negated classes are not supported")
        found: set[int] = set()
        while self._peek() != "]":
            low = self._literal()
            if self._peek() == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                found.update(range(low, self._literal() + 1))
            else:
                found.add(low)
        self.i += 1
        return self._folded(found)

    # Glushkov: (can be empty, first positions, last positions)
    def build(self, node):
        kind = node[0]
        if kind == "set":
            self.moves.append(node[1])
            self.follow.append(set())
            k = len(self.moves) - 1
            return False, {k}, {k}
        if kind == "alt":
            parts = [self.build(x) for x in node[1]]
            return any(p[0] for p in parts), set().union(*(p[1] for p in parts)), set().union(*(p[2] for p in parts))
        if kind == "seq":
            out = (True, set(), set())
            for x in node[1]:
                out = self._then(out, self.build(x))
            return out
        _, inner, low, high = node
        out = (True, set(), set())
        for _ in range(low):
            out = self._then(out, self.build(inner))
        if high is None:
            loop = self.build(inner) if not low else None
            if loop is None:  # x{n,}: the last copy repeats
                first, last = self._last_copy
            else:
                first, last = loop[1], loop[2]
            for k in last:
                self.follow[k] |= first
            return out if loop is None else self._then(out, (True, loop[1], loop[2]))
        for _ in range(high - low):
            empty, first, last = self.build(inner)
            out = self._then(out, (True, first, last))
        return out

    def _then(self, a, b):
        self._last_copy = (b[1], b[2])
        for k in a[2]:
            self.follow[k] |= b[1]
        return a[0] and b[0], a[1] | (b[1] if a[0] else set()), b[2] | (a[2] if b[0] else set())


# --------------------------------------------------------------------------
# subset construction and minimisation


def _minimise(table: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moore's partition refinement; state 0 stays state 0."""
    part = np.unique(label, return_inverse=True)[1].reshape(-1)
    count = part.max() + 1
    while True:
        key = np.column_stack([part, part[table]])
        new = np.unique(key, axis=0, return_inverse=True)[1].reshape(-1)
        if new.max() + 1 == count:
            break
        part, count = new, new.max() + 1
    first = np.zeros(count, dtype=np.int64)
    first[part[::-1]] = np.arange(len(part))[::-1]
    order = np.argsort(first, kind="stable")  # states in order of first appearance
    rank = np.empty(count, dtype=np.int64)
    rank[order] = np.arange(count)
    keep = first[order]
    return rank[part[table[keep]]], label[keep]


def _rule_machine(rule: Rule, classes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Table over byte classes and labels: bit 0, a match has just ended before
    the byte just read; bit 1, the bytes so far end in a match."""
    parser = _Parser(rule.pattern)
    empty, first, last = parser.build(parser.parse())
    if empty:
        raise ValueError(f"{rule.kind} matches nothing at all")
    moves, follow = parser.moves, parser.follow

    def step(groups, byte):
        """Groups of live positions by start, earliest first; then a start here."""
        seen: set[int] = set()
        out = []
        for g in [*groups, None]:
            into = first if g is None else set().union(*(follow[k] for k in g))
            now = frozenset(k for k in into if byte in moves[k]) - seen
            if now:
                out.append(now)
                seen |= now
                if now & last:
                    break
        return tuple(out)

    accepting = lambda groups: any(g & last for g in groups)
    start = ((), False)
    states, queue, rows = {start: 0}, [start], []
    while queue:
        groups, _ = queue.pop(0)
        row = []
        for byte in classes:
            if accepting(groups):
                seen: set[int] = set()
                live = []
                for g in groups:
                    now = frozenset(k for x in g for k in follow[x] if byte in moves[k]) - seen
                    seen |= now
                    if now:
                        live.append(now)
                        if now & last:
                            break
                if live and not accepting(live):
                    raise ValueError(f"{rule.kind}: a match may end before its longest try does")
                nxt = (tuple(live), False) if live else (step((), byte), True)
            else:
                nxt = (step(groups, byte), False)
            if nxt not in states:
                states[nxt] = len(states)
                queue.append(nxt)
            row.append(states[nxt])
        rows.append(row)
    table = np.array(rows, dtype=np.int64)
    label = np.array([e + 2 * accepting(g) for g, e in states], dtype=np.int64)
    return _minimise(table, label)


@dataclass(frozen=True)
class Machine:
    """``table[state, byte]``; bit k of ``ended``/``open``: rule k's match ended
    before the last byte / ends with it."""

    rules: tuple[Rule, ...]
    table: np.ndarray
    ended: np.ndarray
    open: np.ndarray


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Machine:
    """One minimal machine for all rules."""
    sets = []
    for r in rules:
        parser = _Parser(r.pattern)
        parser.build(parser.parse())
        sets += parser.moves
    distinct = sorted(set(sets), key=sorted)
    signature = {}
    byte_class = np.zeros(256, dtype=np.int64)
    classes: list[int] = []
    for b in range(256):
        sig = tuple(b in s for s in distinct)
        if sig not in signature:
            signature[sig] = len(classes)
            classes.append(b)
        byte_class[b] = signature[sig]
    table, label = _rule_machine(rules[0], classes)
    label = label.copy()
    for k, rule in enumerate(rules[1:], 1):
        other, other_label = _rule_machine(rule, classes)
        pairs, queue, rows = {(0, 0): 0}, [(0, 0)], []
        while queue:
            a, b = queue.pop(0)
            row = []
            for nxt in zip(table[a].tolist(), other[b].tolist()):
                if nxt not in pairs:
                    pairs[nxt] = len(pairs)
                    queue.append(nxt)
                row.append(pairs[nxt])
            rows.append(row)
        label = np.array([label[a] | other_label[b] << 2 * k for a, b in pairs], dtype=np.int64)
        table, label = _minimise(np.array(rows, dtype=np.int64), label)
    ended = sum(((label >> 2 * k) & 1) << k for k in range(len(rules)))
    opened = sum(((label >> 2 * k + 1) & 1) << k for k in range(len(rules)))
    return Machine(tuple(rules), table[:, byte_class].astype(np.int32), ended.astype(np.int64), opened.astype(np.int64))


# --------------------------------------------------------------------------
# scanning


class _Backwards:
    """From where a match ends to its leftmost start: the rule's positions, reversed."""

    def __init__(self, rule: Rule):
        parser = _Parser(rule.pattern)
        _, self.first, last = parser.build(parser.parse())
        before = [frozenset(i for i, f in enumerate(parser.follow) if k in f) for k in range(len(parser.moves))]
        self.last, self.before, self.moves = frozenset(last), before, parser.moves

    def start(self, data: bytes, low: int, end: int) -> int:
        live, found, at = self.last, end, end
        while live and at > low:
            at -= 1
            live = frozenset(k for k in live if data[at] in self.moves[k])
            if live & self.first:
                found = at
            live = frozenset().union(*(self.before[k] for k in live))
        return found


class Scanner:
    """Runs a machine over bytes."""

    def __init__(self, machine: Machine):
        self.rules = machine.rules
        rows = [[None] * 258 for _ in machine.table]
        for row, nxt, ended, opened in zip(rows, machine.table, machine.ended.tolist(), machine.open.tolist()):
            row[:256] = [rows[k] for k in nxt.tolist()]
            row[256], row[257] = ended, opened
        self.start = rows[0]
        self.back = [_Backwards(r) for r in machine.rules]
        self.parts = [re.compile(r.pattern.encode()) for r in machine.rules]

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(rule, end) of every match, by end, from one pass over the bytes."""
        row, out = self.start, []
        for i, b in enumerate(data):
            row = row[b]
            if row[256]:
                for k in range(len(self.rules)):
                    if row[256] >> k & 1:
                        out.append((k, i))
        for k in range(len(self.rules)):
            if row[257] >> k & 1:
                out.append((k, len(data)))
        return out

    def byte_spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) of the spans that stay, by start, then rule."""
        after = [0] * len(self.rules)
        out = []
        for k, end in self.ends(data):
            rule, start = self.rules[k], self.back[k].start(data, after[k], end)
            after[k] = end
            if end - start >= rule.min_bytes and self._long_group(k, data[start:end]) >= rule.min_group:
                out.append((start, k, end))
        return sorted(out)

    def _long_group(self, k: int, found: bytes) -> int:
        """Bytes in the last group of a span that the machine has found."""
        if not self.rules[k].min_group:
            return 0
        m = self.parts[k].fullmatch(found)
        return len(m[m.lastindex])

    def spans(self, data: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points."""
        found = self.byte_spans(data)
        if not found:
            return []
        at, done, points = {}, 0, 0
        for off in sorted({x for s, _, e in found for x in (s, e)}):
            points += len(data[done:off].translate(None, _CONTINUATION))
            done = off
            at[off] = points
        return [(self.rules[k].kind, at[s], at[e]) for s, k, e in found]


_CONTINUATION = bytes(range(0x80, 0xC0))
_scanners: dict[tuple[Rule, ...], Scanner] = {}


def scanner_of(machine: Machine) -> Scanner:
    """The process's scanner of these rules; the last one is kept for the next task. It
    takes some 15 MB, and its rows refer to one another, so it goes late."""
    if machine.rules not in _scanners:
        _scanners.clear()
        _scanners[machine.rules] = Scanner(machine)
    return _scanners[machine.rules]


def _joined(spans) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind, s, e in spans)


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``found``, the array of (kind, start, end) of each row's text."""
    machine = compile_rules(rules)
    schema = T.StructType([df.schema[id_col], T.StructField("found", SPAN)])

    def make():
        scanner = scanner_of(machine)

        def work(cols):
            return {
                id_col: cols[id_col],
                "found": [[dict(zip(("kind", "start", "end"), s)) for s in scanner.spans(x or b"")] for x in cols["data"]],
            }

        return work

    return map_batches(df.select(F.col(id_col), F.col(text_col).cast("binary").alias("data")), schema, make)


def redact_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The same rows and columns with each secret replaced by ``[kind]``;
    overlapping spans become one, under the first one's kind. A null text stays null."""
    machine = compile_rules(rules)

    def make():
        scanner = scanner_of(machine)

        def clean(data):
            if data is None:
                return None
            out, done = [], 0
            for start, k, end in scanner.byte_spans(data):
                if start >= done:
                    out += [data[done:start], f"[{scanner.rules[k].kind}]".encode()]
                done = max(done, end)
            return b"".join([*out, data[done:]])

        return lambda cols: {**cols, data_col: [clean(x) for x in cols[data_col]]}

    (data_col,) = fresh(df, "data")
    columns = df.columns
    inner = df.withColumn(data_col, F.col(text_col).cast("binary")).drop(text_col)
    out = map_batches(inner, inner.schema, make)
    return out.select(*(F.col(data_col).cast("string").alias(c) if c == text_col else F.col(c) for c in columns))


def op1_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Base counts, a hash of the base spans, and all spans of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    machine = compile_rules(RULES)
    schema = T.StructType(
        [docs.schema["doc_id"], *(T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    )

    def make():
        scanner = scanner_of(machine)

        def work(cols):
            out = {f.name: [] for f in schema.fields}
            out["doc_id"] = cols["doc_id"]
            for data in cols["data"]:
                spans = scanner.spans(data or b"")
                base = [s for s in spans if s[0] in BASE_KINDS]
                for k in BASE_KINDS:
                    out[f"n_{k}"].append(sum(s[0] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out["spans"].append(_joined(spans))
            return out

        return work

    return map_batches(docs.select("doc_id", F.col("text").cast("binary").alias("data")), schema, make)
