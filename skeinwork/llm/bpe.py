"""Byte-level BPE encoding and decoding with the tokenizers library.

A text is split by the vocabulary's pattern; each distinct piece of an Arrow
batch is mapped to byte characters and encoded once by the tokenizers library's
BPE model, built from a rank file. Merges apply by rank of the joined token, as
with plain ranks: every split of a token into two tokens is a merge rule.

Offsets are code points: a token that ends within a character covers that whole
character, so that neighbours may share one. Decoding goes by the byte table; ids
cut within a character decode to U+FFFD for the incomplete part, or as raw bytes.

Defined results: a null or empty text has no tokens; repeated rows give repeated
results; columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_batches, read

#: Distinct space-parted units a worker keeps with their ids; beyond it, it starts
#: anew. Bounds memory only.
UNITS_KEPT = 300_000
#: Longer units are encoded but not kept.
LONGEST_KEPT = 64


def byte_characters() -> list[str]:
    """The printable stand-in of each byte: visible Latin-1 characters stand for
    themselves, the others for code points from 256 on, in order."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path} has gaps in its ranks")
    return [ranks[k] for k in range(len(ranks))]


class ByteBPE:
    """Encoder and decoder of one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        import public_tokenizers
        from tokenizers import Tokenizer, models, pre_tokenizers

        # Known of this pattern: no piece holds an inner space, a space and letters are one
        # piece, and a piece is settled by two characters after it. Any other is applied to
        # whole texts.
        self.by_units = pattern == public_tokenizers.PATTERN
        self.tokens = read_ranks(path)
        self.rank = {t: k for k, t in enumerate(self.tokens)}
        stand_in = byte_characters()
        name = ["".join(map(stand_in.__getitem__, t)) for t in self.tokens]
        merges = []
        for k, token in enumerate(self.tokens):
            parts = [(self.rank[token[:i]], self.rank[token[i:]]) for i in range(1, len(token)) if token[:i] in self.rank and token[i:] in self.rank]
            merges += [(name[a], name[b]) for a, b in sorted(parts)]
        self.model = Tokenizer(models.BPE({n: k for k, n in enumerate(name)}, merges, ignore_merges=True, cache_capacity=0))
        # Byte 255 is in no UTF-8 text; it parts the pieces of one call.
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.to_stand_in = {b: c for b, c in enumerate(stand_in)} | {255: "\n"}
        self.pieces = regex.compile(pattern).findall
        self.matches = regex.compile(pattern).finditer
        self.unit_ids: dict[str, tuple[int, ...] | None] = {}

    def learn(self, pieces) -> dict[str, tuple[int, ...]]:
        """Ids of distinct pieces, from the tokenizers library. Whole pieces that are
        tokens need no merging; the library sees to that, too."""
        found, pieces = {}, list(pieces)
        for k in range(0, len(pieces), 2000):
            some = pieces[k : k + 2000]
            line = b"\xff".join([p.encode() for p in some]).decode("latin-1").translate(self.to_stand_in)
            coded = self.model.encode(line, add_special_tokens=False)
            ids, words = coded.ids, np.array(coded.word_ids)
            cuts = [0, *(np.flatnonzero(np.diff(words)) + 1).tolist(), len(ids)]
            found.update(zip(some, [tuple(ids[i:j]) for i, j in zip(cuts, cuts[1:])]))
        return found

    def _plain(self, texts: list[str]) -> list[tuple[int, ...]]:
        """Ids of texts that are cut by the pattern alone."""
        split = [self.pieces(t) for t in texts]
        known, found = self.unit_ids, {}
        distinct = set(chain.from_iterable(split))
        for p in distinct:  # a space and letters: one piece, and a unit
            if p[0] == " " and p[1:].isalpha() and p[1:] in known:
                found[p] = known[p[1:]]
        found.update(self.learn([p for p in distinct if p not in found]))
        return [tuple(chain.from_iterable(map(found.__getitem__, s))) for s in split]

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text.

        No piece holds a space but at its start or among white space. So a text cut
        before its single spaces is encoded unit by unit, and units recur. A unit
        that is empty, or begins or ends with white space, sends its text the plain
        way, as a whole. So do all texts if the pattern is another.
        """
        if not self.by_units:
            return [list(ids) for ids in self._plain([t or "" for t in texts])]
        units = [t.split(" ") if t else [""] for t in texts]
        known = self.unit_ids
        if len(known) > UNITS_KEPT:
            known.clear()
        new = {u for u in set().union(*units) if u not in known}
        letters = [u for u in new if u.isalpha()]  # one piece, with its space
        fresh = dict(zip(letters, self.learn([" " + u for u in letters]).values()))
        known.update((u, i) for u, i in fresh.items() if len(u) <= LONGEST_KEPT)
        new.difference_update(fresh)
        mixed = [u for u in new if u and not (u[0].isspace() or u[-1].isspace())]
        fresh |= dict.fromkeys(new - set(mixed)) | dict(zip(mixed, self._plain([" " + u for u in mixed])))
        known.update((u, i) for u, i in fresh.items() if len(u) <= LONGEST_KEPT)
        long = {u: i for u, i in fresh.items() if len(u) > LONGEST_KEPT}
        get = known.__getitem__ if not long else lambda u: long[u] if u in long else known[u]
        heads = {u[0] for u in units} - {""}
        heads = [h for h in heads if not h[-1].isspace()]
        head_ids = {"": ()} | dict(zip(heads, self._plain(heads)))
        out = []
        for t, u in zip(texts, units):
            try:
                out.append([*head_ids[u[0]], *chain.from_iterable(map(get, u[1:]))])
            except (KeyError, TypeError):  # an unsafe head or unit
                out.append(list(self._plain([t])[0]))
        return out

    def spans(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """(start, end) in code points of each token of ``text``."""
        start_of, char = [], -1  # character index of each byte
        for b in text.encode():
            char += b & 0xC0 != 0x80
            start_of.append(char)
        out, at = [], 0
        for k in ids:
            size = len(self.tokens[k])
            out.append((start_of[at], start_of[at + size - 1] + 1))
            at += size
        return out

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def public_vocabulary() -> tuple[str, str]:
    """Name and pattern of the many-language rank file; workers find its path."""
    import public_tokenizers

    return "byte_bpe_multi_50k.tiktoken", public_tokenizers.PATTERN


def _loader(vocabulary):
    name, pattern = vocabulary

    def get() -> ByteBPE:
        import os

        import public_tokenizers

        return load(name if os.path.sep in name else public_tokenizers.path(name), pattern)

    return get


def encode(df: DataFrame, vocabulary: tuple[str, str] | None = None, text_col: str = "text", offsets: bool = False) -> DataFrame:
    """All columns, and ``ids`` and, if asked for, ``offsets``; columns of these
    names are replaced. ``vocabulary``: rank file (a name of public_tokenizers or
    a path that every machine has) and pattern."""
    get = _loader(vocabulary or public_vocabulary())
    added = [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if offsets:
        pair = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
        added.append(T.StructField("offsets", T.ArrayType(pair)))
    base = df.drop(*(f.name for f in added))
    schema = T.StructType([*base.schema.fields, *added])

    def make():
        coder = get()

        def work(cols):
            texts = cols[text_col]
            ids = coder.encode_batch(texts)
            out = {**cols, "ids": ids}
            if offsets:
                out["offsets"] = [[{"start": s, "end": e} for s, e in coder.spans(t, i)] if t else [] for t, i in zip(texts, ids)]
            return out

        return work

    return map_batches(base, schema, make)


def decode(df: DataFrame, vocabulary: tuple[str, str] | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns and the text of ``ids``; null ids give null text."""
    get = _loader(vocabulary or public_vocabulary())
    base = df.drop(out_col)
    schema = T.StructType([*base.schema.fields, T.StructField(out_col, T.StringType())])

    def make():
        coder = get()
        return lambda cols: {**cols, out_col: [None if i is None else coder.decode(i) for i in cols[ids_col]]}

    return map_batches(base, schema, make)


def digests(df: DataFrame, vocabulary: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, number of tokens, and hashes of the ids and of the bytes they decode to."""
    get = _loader(vocabulary or public_vocabulary())
    schema = T.StructType(
        [df.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    )

    def make():
        coder = get()
        decimal = [str(k) for k in range(len(coder.tokens))]

        def work(cols):
            ids = coder.encode_batch(cols[text_col])
            return {
                id_col: cols[id_col],
                "n_tokens": [len(i) for i in ids],
                "ids_sha256": [hashlib.sha256(",".join(map(decimal.__getitem__, i)).encode()).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(coder.decode_bytes(i)).hexdigest() for i in ids],
            }

        return work

    return map_batches(df.select(F.col(id_col), F.col(text_col)), schema, make)


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of every document."""
    return digests(read(spark, sf_dir, "documents"))
