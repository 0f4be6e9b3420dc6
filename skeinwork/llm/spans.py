"""Substring dedup with sliding sentence spans.

A text is cut into sentences; spans are runs of SENTENCES or more of them with
WORDS words or more, known by a hash of their sentences: from every sentence on the
shortest such run, and up to every sentence the shortest. They slide by one sentence
and together cover every sentence of any longer run that repeats. Counting hashes over
the whole table finds the spans that occur more than once; each of their occurrences
then learns which is the first (by id, then position). Sentences that an occurrence
covers which is not the first of its span are removed.

Sentences end at ``.``, ``!``, ``?`` or an ellipsis before white space, at the full-width
marks of Chinese and Japanese, and at line ends. Where no end is near, words decide: a
word with FAR words of its sentence before it and after it closes a piece if its hash is
the least among the NEAR words before and after. So where a text is cut depends on the
words close by alone, not on how long the sentence is, and a passage that stands in
sentences of different lengths, or in none, is cut alike. For spans, pieces are sentences.
A run that starts or ends at such an inner cut needs INNER_WORDS words only; its
occurrence is extended word by word beyond the cut as far as the first occurrence reads
the same. Occurrences of a document that overlap are one stretch. It counts if it has
WORDS words and a sentence's end inside, or SENTENCES * WORDS words without one.

``n_sentences`` and ``n_removed`` count sentences, and ones that are gone whole, of which
very long ones are cut by the same rule with WORDS words on either side. A word is a run
without white space; in scripts written without spaces (Han, kana, Thai, Lao, Khmer,
Burmese) each character is one. White space does not count in hashes.

A single sentence of fewer than SENTENCES * WORDS words that repeats is kept, and so is a
run of one word over and over, which has no inner cuts.

Defined results: a null text has no sentences and stays null; empty stays empty;
null ids come last in the order; rows that agree in id and text are one document
and keep or lose the same words; further columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch
from ._common import heavy_keys, looked_up, read, slices

SENTENCES = 2
WORDS = 20
INNER_WORDS = 12
FAR = 6
NEAR = 2
#: Pieces of a sentence in which cuts near a passage's edge may differ, as cuts are
#: more than NEAR words apart, and the one before them.
EDGE_PIECES = FAR // (NEAR + 1) + 1

_ends = re.compile(r"[.!?…]+[\"')\]»”]*\s+|[。！？]+[\"')\]»”』」]*\s*|\n\s*")
_SCRIPTS = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_unspaced = re.compile(f"[{_SCRIPTS}]").search
_word = re.compile(r"\S+")
_character = re.compile(rf"[{_SCRIPTS}]|[^\s{_SCRIPTS}]+")


def _closing(words: list[str]) -> list[int]:
    """Places of a sentence's words that close a piece inside it."""
    n = len(words)
    if n <= 2 * FAR:
        return []
    lo = FAR - NEAR
    h = [xxhash.xxh3_64_intdigest(w) for w in words[lo : n - lo]]
    out = []
    for k in range(NEAR, len(h) - NEAR):
        x = h[k]
        # The first comparison spares most of the others.
        if h[k - 1] > x <= h[k + 1] and x < min(h[k - NEAR : k]) and x <= min(h[k + 1 : k + NEAR + 1]):
            out.append(lo + k)
    return out


#: How a piece starts: with its sentence, at an inner cut, or at one that parts a very
#: long sentence for the counts, too.
WHOLE, INNER, COUNTED = 0, 1, 2


def _pieces(text: str) -> tuple[list[int], list[list[str]], list[int]]:
    """Starts, words and kinds of a text's pieces. A piece reaches to the next one's
    start (the first from 0, the last to the end), so that they tile the text; parts
    without words belong to the one before."""
    words_of = _character if not text.isascii() and _unspaced(text) else None
    starts, pieces, kinds = [], [], []
    at = 0
    for end in [*(m.end() for m in _ends.finditer(text)), len(text)]:
        part = text[at:end]
        words = words_of.findall(part) if words_of else part.split()
        if words:
            starts.append(at)
            kinds.append(WHOLE)
            closing = _closing(words)
            if closing:
                where = [m.start() for m in words_of.finditer(part)] if words_of else None
                lo, n, rest = 0, len(words), part
                for c in closing:
                    pieces.append(words[lo : c + 1])
                    if not words_of:  # the part from the next piece on
                        rest = rest.split(None, c + 1 - lo)[-1]
                    lo = c + 1
                    starts.append(at + where[lo] if words_of else end - len(rest))
                    kinds.append(COUNTED if WORDS <= c < n - WORDS else INNER)
                words = words[lo:]
            pieces.append(words)
        at = end
    if starts:
        starts[0] = 0
    return starts, pieces, kinds


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence with the white space after it; they tile the text."""
    starts, _, kinds = _pieces(text)
    counted = [s for s, k in zip(starts, kinds) if k != INNER]
    return list(zip(counted, [*counted[1:], len(text)]))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _runs(pieces: list[list[str]], kinds: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First piece and last piece + 1 of each span, and whether it starts or ends at an
    inner cut."""
    n = len(pieces)
    upto = np.zeros(n + 1, dtype=np.int64)
    np.cumsum([len(p) for p in pieces], out=upto[1:])
    if n < SENTENCES or upto[-1] < INNER_WORDS:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(bool)
    at = np.arange(n + 1)
    inner = np.array([*kinds, WHOLE]) != WHOLE
    least = np.where(inner, INNER_WORDS, WORDS)
    # The shortest from every start on, and the shortest up to every end.
    end = np.maximum(np.searchsorted(upto, upto + least), at + SENTENCES)
    start = np.minimum(np.searchsorted(upto, upto - least, side="right") - 1, at - SENTENCES)
    runs = np.unique(np.concatenate([at[end <= n] * (n + 1) + end[end <= n], start[start >= 0] * (n + 1) + at[start >= 0]]))
    i, j = runs // (n + 1), runs % (n + 1)
    return i, j, inner[i] | inner[j]


def spans(text: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of sentences; of each span its hash, and whether it is at an inner cut."""
    _, pieces, kinds = _pieces(text)
    i, j, inner = _runs(pieces, kinds)
    n = len(pieces)
    if not len(i):
        return n - kinds.count(INNER), i, inner
    # Polynomials in the sentences' hashes, modulo 2**64.
    own = np.fromiter((xxhash.xxh3_64_intdigest(" ".join(p)) for p in pieces), dtype=np.uint64, count=n)
    before = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(own * _powers(_BASE, n), out=before[1:])
    key = (before[j] - before[i]) * _powers(_INVERSE, n)[i]
    key = (key ^ (key >> np.uint64(33)) ^ (j - i).astype(np.uint64)) * _MIX
    return n - kinds.count(INNER), (key ^ (key >> np.uint64(29))).view(np.int64), inner


def _found(docs: DataFrame) -> DataFrame:
    """``id``, ``row``, number of sentences ``n``, and ``span`` and ``open`` (at an inner
    cut) of the spans of every row."""
    schema = T.StructType(
        [docs.schema["id"], docs.schema["row"], T.StructField("n", T.IntegerType()), T.StructField("span", T.ArrayType(T.LongType())), T.StructField("open", T.ArrayType(T.BooleanType()))]
    )

    def arrays(parts):
        upto = np.zeros(len(parts) + 1, dtype=np.int32)
        np.cumsum([len(p) for p in parts], out=upto[1:])
        return pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate(parts)))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                n, span, inner = zip(*map(spans, part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("row"), pa.array(n, pa.int32()), arrays(span), arrays(inner)], names=schema.names)

    return docs.select("id", "row", "text").mapInArrow(run, schema)


def _edges(rows: DataFrame) -> DataFrame:
    """``span``, and the words of its sentences beyond its inner cuts, ``back`` and
    ``ahead`` (four bytes of each word's hash; of the EDGE_PIECES pieces next to it),
    from ``text`` and ``wanted`` (an array of ``span``, ``at``)."""

    def marks(pieces):
        return b"".join([xxhash.xxh32_digest(w) for p in pieces for w in p])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = []
                for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist()):
                    _, pieces, inner = _pieces(text)
                    i, j, _ = _runs(pieces, inner)
                    for w in wanted:
                        lo = first = int(i[w["at"] // 2])
                        while inner[lo] and first - lo < EDGE_PIECES:
                            lo -= 1
                        hi = last = int(j[w["at"] // 2])
                        while hi < len(inner) and inner[hi] and hi - last < EDGE_PIECES:
                            hi += 1
                        out.append((w["span"], marks(pieces[lo:first]), marks(pieces[last:hi])))
                span, back, ahead = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(span, pa.int64()), pa.array(back, pa.binary()), pa.array(ahead, pa.binary())], names=["span", "back", "ahead"])

    return rows.select("text", "wanted").mapInArrow(run, "span long, back binary, ahead binary")


def _reach(first: int, last: int, words: list[str], back: bytes, ahead: bytes) -> tuple[int, int]:
    """First word and last word + 1 of a span's occurrence, extended beyond inner cuts as
    far as the words are those of the span's first occurrence."""
    k = len(back)
    while k and first and xxhash.xxh32_digest(words[first - 1]) == back[k - 4 : k]:
        first, k = first - 1, k - 4
    k = 0
    while k < len(ahead) and last < len(words) and xxhash.xxh32_digest(words[last]) == ahead[k : k + 4]:
        last, k = last + 1, k + 4
    return first, last


def _without(text: str, cuts: list[dict]) -> tuple[str, int, list[dict]]:
    """What is left of a text, the number of sentences that are gone whole and what was
    removed."""
    starts, pieces, kinds = _pieces(text)
    i, j, _ = (x.tolist() for x in _runs(pieces, kinds))
    upto = [0, *accumulate(map(len, pieces))]
    words = list(chain.from_iterable(pieces))
    words_of = _character if not text.isascii() and _unspaced(text) else _word

    def offset(word: int) -> int:
        """Where a word starts in the text; for the number of words its end."""
        if word == len(words):
            return len(text)
        k = bisect_right(upto, word) - 1
        if word == upto[k]:
            return starts[k]
        return next(islice(words_of.finditer(text, starts[k]), word - upto[k], None)).start()

    ends = [w for w, kind in zip(upto, kinds) if kind == WHOLE]
    stretches: list[list[int]] = []
    reached = {_reach(upto[i[c["at"] // 2]], upto[j[c["at"] // 2]], words, c["back"] or b"", c["ahead"] or b"") for c in cuts}
    for s, e in sorted(reached):
        if stretches and s < stretches[-1][1]:
            stretches[-1][1] = max(e, stretches[-1][1])
        else:
            stretches.append([s, e])
    removed: list[dict] = []
    for s, e in stretches:
        k = bisect_right(ends, s)  # the next sentence's first word
        if e - s >= (WORDS if k < len(ends) and ends[k] < e else SENTENCES * WORDS):
            start, end = offset(s), offset(e)
            if removed and removed[-1]["end"] == start:
                removed[-1]["end"] = end
            else:
                removed.append({"start": start, "end": end})
    if not removed:
        return text, 0, []
    kept = [0, *(x for r in removed for x in (r["start"], r["end"])), len(text)]
    n, k = 0, 0
    counted = [s for s, kind in zip(starts, kinds) if kind != INNER]
    for s, e in zip(counted, [*counted[1:], len(text)]):
        while k < len(removed) and removed[k]["end"] < e:
            k += 1
        n += k < len(removed) and removed[k]["start"] <= s
    return "".join([text[s:e] for s, e in zip(kept[::2], kept[1::2])]), n, removed


_REMOVED = "array<struct<start: bigint, end: bigint>>"


def _cleaned(rows: DataFrame) -> DataFrame:
    """``id``, ``text``, ``n_sentences``, ``n_removed``, ``removed`` from ``id``, ``text``,
    ``n`` and ``cuts``. Only texts with cuts become Python objects."""
    schema = T.StructType([rows.schema["id"], T.StructField("text", T.StringType()), T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.DataType.fromDDL(_REMOVED))])
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts, cuts = part.column("text"), part.column("cuts")
                some = pc.is_valid(cuts)
                done = [_without(t, c) for t, c in zip(texts.filter(some).to_pylist(), cuts.filter(some).to_pylist())]
                lost = np.zeros(part.num_rows, dtype=np.int64)
                lost[some.to_numpy(zero_copy_only=False)] = [d[1] for d in done]
                each = iter(done)
                removed = [next(each)[2] if x else [] for x in some.to_pylist()]
                text = pc.replace_with_mask(texts, some, pa.array([d[0] for d in done], texts.type))
                yield pa.RecordBatch.from_arrays([part.column("id"), text, part.column("n").cast(pa.int64()), pa.array(lost), pa.array(removed, pair)], names=schema.names)

    return rows.select("id", "text", "n", "cuts").mapInArrow(run, schema)


def dedup_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``text`` without repeated sentences, ``n_sentences``, ``n_removed`` and
    ``removed`` (start and end in code points) of every row."""
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(9), F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    filled = docs.filter("text != ''")
    with Scratch(df.sparkSession) as scratch:
        found = scratch.keep(_found(filled))
        # Spans that occur more than once; those with a large share of all are few.
        again = scratch.keep(found.select(F.explode("span").alias("span")).groupBy("span").agg(F.count("*").alias("n")).filter("n > 1"))
        total = found.agg(F.coalesce(F.sum(F.size("span")), F.lit(0)).alias("n")).first()["n"]
        heavy = heavy_keys(again, "span", total)
        each = found.select("row", F.posexplode(F.arrays_zip("span", "open")).alias("k", "s")).select("s.span", "row", (2 * F.col("k") + F.col("s.open").cast("int")).alias("at"))
        occurrences = scratch.keep(looked_up(each, "span", again.select("span"), heavy))
        ids = found.select("row", "id", F.col("id").isNull().alias("none")).distinct()
        place = F.struct("none", "id", "row", "at")
        first = scratch.keep(occurrences.join(ids, "row").groupBy("span").agg(F.min(place).alias("f")).select("span", F.col("f.row").alias("first_row"), F.col("f.at").alias("first_at")))
        later = scratch.keep(looked_up(occurrences, "span", first, heavy).filter((F.col("row") != F.col("first_row")) | (F.col("at") != F.col("first_at"))))
        scratch.drop(again, occurrences)
        # What first occurrences at inner cuts read beyond them.
        is_open = F.col("first_at") % 2 == 1
        wanted = first.filter(is_open).groupBy(F.col("first_row").alias("row")).agg(F.collect_list(F.struct("span", F.col("first_at").alias("at"))).alias("wanted"))
        edges = scratch.keep(_edges(filled.join(wanted, "row")).groupBy("span").agg(F.first("back").alias("back"), F.first("ahead").alias("ahead")))
        none = F.lit(None).cast("binary")
        plain = later.filter(~is_open).select("row", "at", none.alias("back"), none.alias("ahead"))
        read_on = looked_up(later.filter(is_open), "span", edges, heavy).select("row", "at", "back", "ahead")
        cuts = scratch.keep(plain.unionByName(read_on).groupBy("row").agg(F.collect_set(F.struct("at", "back", "ahead")).alias("cuts")))
        plan = scratch.keep(found.select("row", "n").distinct().join(cuts, "row", "left"))
        scratch.returned(plan)
    # Both sides are plain tables, so that a row that repeats very often can be split.
    out = _cleaned(filled.join(plan, "row")).withColumnRenamed("id", id_col)
    none = docs.filter("text is null or text = ''")
    zero = F.lit(0).cast("long")
    rest = none.select(F.col("id").alias(id_col), "text", zero.alias("n_sentences"), zero.alias("n_removed"), F.array().cast(_REMOVED).alias("removed"))
    return out.unionByName(rest)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Cleaned text of every document, and what was removed."""
    return dedup_spans(read(spark, sf_dir, "documents"))
