"""Token counts that follow edits.

A text is kept as a segment tree over its pre-tokens: leaves hold runs of them with
their token counts, inner nodes the sums of characters and tokens below. An edit
re-encodes only from a little before its start, where the pattern cannot have seen
the change, to the first old piece boundary after its end at which the new split
falls in step with the old one; sums are then updated along the leaves' paths.

Defined results: a null or empty text has no tokens; edits are (start, end,
replacement) in code points of the text before any edit, sorted and not
overlapping; repeated rows give repeated results; further columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import WORD, map_batches, read
from .bpe import LONGEST_KEPT, UNITS_KEPT, _loader, public_vocabulary

LEAF_PIECES = 32
#: A piece is settled by the text up to this many characters after its end.
CONTEXT = 2


class PieceCounter:
    """Token counts of pieces, learnt in batches."""

    def __init__(self, coder):
        self.coder, self.known, self.long = coder, {}, []

    def learn(self, pieces) -> None:
        if len(self.known) > UNITS_KEPT:
            self.known.clear()
        new = [p for p in set(pieces) if p not in self.known]
        self.known.update((p, len(i)) for p, i in self.coder.learn(new).items())
        self.long += [p for p in new if len(p) > LONGEST_KEPT]

    def of(self, pieces: list[str]) -> list[int]:
        try:
            return [self.known[p] for p in pieces]
        except KeyError:
            self.learn(pieces)
            return [self.known[p] for p in pieces]

    def forget_long(self) -> None:
        for p in self.long:
            self.known.pop(p, None)
        self.long.clear()


class CountedText:
    """The tree of one text. ``total`` is its number of tokens."""

    def __init__(self, pieces: list[str], counter: PieceCounter):
        self.counter = counter
        counts = counter.of(pieces)
        k = LEAF_PIECES
        self.leaves = [(pieces[i : i + k], counts[i : i + k]) for i in range(0, len(pieces), k)] or [([], [])]
        size = 1
        while size < len(self.leaves):
            size *= 2
        self.size = size
        self.chars, self.tokens = [0] * (2 * size), [0] * (2 * size)
        for i, (p, c) in enumerate(self.leaves):
            self.chars[size + i], self.tokens[size + i] = sum(map(len, p)), sum(c)
        for n in range(size - 1, 0, -1):
            self.chars[n] = self.chars[2 * n] + self.chars[2 * n + 1]
            self.tokens[n] = self.tokens[2 * n] + self.tokens[2 * n + 1]
        self.reencoded = 0

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(p for leaf, _ in self.leaves for p in leaf)

    def _find(self, at: int) -> tuple[int, int]:
        """(leaf, offset of its start) of the leaf that holds character ``at``."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def _set(self, leaf: int, pieces: list[str], counts: list[int]) -> None:
        self.leaves[leaf] = (pieces, counts)
        node = self.size + leaf
        chars, tokens = sum(map(len, pieces)) - self.chars[node], sum(counts) - self.tokens[node]
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from ``start`` to ``end`` of the text as it is now. With
        a pattern of which it is not known how far it looks, the whole text is split anew."""
        if not self.counter.coder.by_units:
            text = self.text()
            pieces, before = self.counter.coder.pieces(text[:start] + new + text[end:]), self.reencoded
            self.__init__(pieces, self.counter)
            self.reencoded = before + len(pieces)
            return
        length = self.chars[1]
        first, low = self._find(max(0, min(start - CONTEXT, length - 1)))
        last, _ = self._find(max(0, min(end, length - 1)))
        while True:
            more = last + 1 < len(self.leaves)
            old = [p for k in range(first, last + 1) for p in self.leaves[k][0]]
            old_counts = [c for k in range(first, last + 1) for c in self.leaves[k][1]]
            bounds = [low]
            for p in old:
                bounds.append(bounds[-1] + len(p))
            # Pieces that end CONTEXT before the edit are as they were.
            keep = max(0, bisect_right(bounds, start - CONTEXT) - 1)
            origin = bounds[keep]
            before = "".join(old[keep:])
            window = before[: start - origin] + new + before[end - origin :]
            shift, at = len(new) - (end - start), origin
            place = {b: k for k, b in enumerate(bounds)}
            fresh: list[str] = []
            step = None
            for m in self.counter.coder.matches(window):
                at = origin + m.start()
                if at - shift >= end and at >= start + len(new) and (at - shift) in place:
                    step = place[at - shift]
                    break
                fresh.append(m[0])
            if step is None and more:
                # Out of step to the window's end: what follows may matter. Widen.
                widen = max(1, last - first + 1)
                last = min(len(self.leaves) - 1, last + widen)
                continue
            break
        tail = (old[step:], old_counts[step:]) if step is not None else ([], [])
        self.reencoded += len(fresh)
        pieces, counts = old[:keep] + fresh + tail[0], old_counts[:keep] + self.counter.of(fresh) + tail[1]
        # Spread over the leaves that were read, so that none grows with many edits.
        each = -(-len(pieces) // (last - first + 1))
        for k in range(first, last + 1):
            lo = (k - first) * each
            self._set(k, pieces[lo : lo + each], counts[lo : lo + each])

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Edits in the coordinates of the text before the first of them."""
        moved = 0
        for s, e, new in edits:
            self.edit(s + moved, e + moved, new)
            moved += len(new) - (e - s)


_has_word = re.compile(WORD).search
_marks = re.compile(r"[#*$%&|<>]{2,}")


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """Deletions of a light cleaning: lines (with a word) equal to an earlier line,
    with the line end before them, and runs of two or more marks elsewhere."""
    out, seen, at = [], set(), 0
    for line in text.split("\n"):
        if _has_word(line) and line in seen:
            out.append((at - 1, at + len(line), ""))
        else:
            seen.add(line)
            out += [(at + m.start(), at + m.end(), "") for m in _marks.finditer(line)]
        at += len(line) + 1
    return out


def edited_counts(df: DataFrame, edits=cleaning_edits, vocabulary: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_tokens``, ``n_edits``, ``n_tokens_edited`` and ``n_reencoded`` (pieces
    encoded anew, of ``n_pieces``) of every row; ``edits`` maps a text to its edits."""
    get = _loader(vocabulary or public_vocabulary())
    names = ("n_tokens", "n_edits", "n_tokens_edited", "n_pieces", "n_reencoded")
    schema = T.StructType([df.schema[id_col], *(T.StructField(n, T.LongType()) for n in names)])

    def make():
        counter = PieceCounter(get())

        def work(cols):
            out = []
            texts = cols[text_col]
            for lo in range(0, len(texts), 500):
                some = texts[lo : lo + 500]
                split = [counter.coder.pieces(t) if t else [] for t in some]
                counter.learn(p for s in split for p in s)
                for t, pieces in zip(some, split):
                    script = edits(t) if t else []
                    if not script:
                        n = sum(counter.of(pieces))
                        out.append((n, 0, n, len(pieces), 0))
                        continue
                    tree = CountedText(pieces, counter)
                    n = tree.total
                    tree.apply(script)
                    out.append((n, len(script), tree.total, len(pieces), tree.reencoded))
                counter.forget_long()
            return {id_col: cols[id_col]} | {k: [o[i] for o in out] for i, k in enumerate(names)}

        return work

    return map_batches(df.select(F.col(id_col), F.col(text_col)), schema, make)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after its cleaning edits."""
    return edited_counts(read(spark, sf_dir, "documents"))
