"""Quality rules that vote, combined by weak supervision.

Each rule looks at counts of a text and votes good, bad, or abstains. The votes'
patterns are counted over all rows (a table of at most 3 ** rules lines, whatever
the input's size), and expectation-maximisation on these counts estimates how
often each rule is right for good and for bad texts, and the share of good ones.
A row's verdict is its posterior probability of being good. The base rules stay
absolute: a row that fails one is out.

Two rules look at letters: a capital is one of A-Z or of the Latin-1 capitals, a letter
any character of a word but digits and the underscore. Combining marks are no letters,
and a text without spaces has long words; such texts get some bad votes.

Defined results: null text counts as empty, which fails the base rules; rows
with equal texts get equal verdicts; an empty table gives an empty result;
columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch, freeing_shuffles
from ._common import WORD, map_batches, read

SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_bang", "n_ended", "n_distinct", "n_marked", "n_bare")
_words = re.compile(WORD).findall
_not_letters = re.compile(r"[\W\d_]+")
_not_capitals = re.compile("[^A-ZÀ-ÖØ-Þ]+")
_content = re.compile(r"[^\W_]").search
_marked = re.compile(rf"[{re.escape(SYMBOLS)}]{{2}}").search
_not_symbols = re.compile(f"[^{re.escape(SYMBOLS)}]+")
#: Words may end with these; '!' and '?' at a line's end count as an end, too.
_ended = re.compile(r"[.!?:;\"')\]»”]\s*$")


def features(text: str | None) -> tuple[int, ...]:
    """The counts that the rules look at, in the order of FEATURES."""
    text = text or ""
    words = _words(text)
    n = len(words)
    lines = [line for line in text.split("\n") if _words(line)] if "\n" in text else [text] * (n > 0)
    repeated = 0
    if n > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        if len(set(windows)) < len(windows):
            count, covered = Counter(windows), 0
            for i, w in enumerate(windows):
                if count[w] > 1:
                    repeated += i + 5 - max(i, covered)
                    covered = i + 5
    symbols = len(_not_symbols.sub("", text))
    return (
        n,
        sum(map(len, words)),
        symbols,
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(_not_letters.sub("", text)),
        len(_not_capitals.sub("", text)),
        text.count("!"),
        sum(1 for line in lines if _ended.search(line)),
        len(set(words)),
        sum(1 for w in words if _marked(w)) if symbols > 1 else 0,
        sum(1 for w in words if not w.isalnum() and not _content(w)),
    )


# Votes: 1 good, -1 bad, 0 abstain. Each compares counts only, so it runs in the JVM.


def _vote(good, bad):
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict:
    """Name to vote, as expressions over FEATURES."""
    c = {f: F.col(f) for f in FEATURES}
    n, lines = c["n_words"], c["n_lines"]
    return {
        "length": _vote(n >= 20, (n < 15) | (n > 100_000)),
        "word_length": _vote((c["word_chars"] >= 3 * n) & (c["word_chars"] <= 9 * n), (c["word_chars"] < 2 * n) | (c["word_chars"] > 12 * n)),
        "symbols": _vote(100 * c["n_symbols"] <= 2 * n, 10 * c["n_symbols"] > 3 * n),
        "duplicate_lines": _vote((lines > 1) & (c["n_dup_lines"] == 0), 10 * c["n_dup_lines"] > 3 * lines),
        "repeats": _vote(100 * c["n_repeat_words"] <= 5 * n, 100 * c["n_repeat_words"] > 15 * n),
        "capitals": _vote(100 * c["n_upper"] <= 10 * c["n_letters"], 10 * c["n_upper"] > 3 * c["n_letters"]),
        "shouting": _vote(c["n_bang"] == 0, 10 * c["n_bang"] > n),
        "letters": _vote(100 * c["n_letters"] >= 90 * c["word_chars"], 100 * c["n_letters"] < 88 * c["word_chars"]),
        "endings": _vote(10 * c["n_ended"] >= 7 * lines, 10 * c["n_ended"] < 3 * lines),
        "marked_words": _vote(100 * c["n_marked"] <= 2 * n, 10 * c["n_marked"] > 2 * n),
        "bare_words": _vote(100 * c["n_bare"] <= 3 * n, 100 * c["n_bare"] > 15 * n),
        "variety": _vote(10 * c["n_distinct"] > 4 * n, (n >= 50) & (10 * c["n_distinct"] < 2 * n)),
    }


def base_failed():
    n = F.col("n_words")
    return (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)


def fit(counts: dict[tuple[int, ...], int], rounds: int = 200, tolerance: float = 1e-9) -> dict[tuple[int, ...], float]:
    """Posterior probability of good for each vote pattern, by EM on its count.

    Votes are independent given the class; each class has its own chances of the
    three votes per rule, with a weak prior that a rule is right in four of five
    of the cases in which it votes, which also fixes which class is the good one.
    The start is the share of good votes. Abstaining has one chance for both
    classes, so that silence is no evidence.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}
    m = len(patterns[0])
    total = sum(counts.values())
    strength = max(1.0, total / 50)
    post = {p: (1 + sum(v > 0 for v in p)) / (2 + sum(v != 0 for v in p)) for p in patterns}
    for _ in range(rounds):
        good = sum(counts[p] * post[p] for p in patterns)
        share = (good + 0.8 * strength) / (total + strength)
        right = []
        for k in range(m):
            tally = {(c, v): 0.0 for c in (0, 1) for v in (-1, 1)}
            for p in patterns:
                if p[k]:
                    tally[1, p[k]] += counts[p] * post[p]
                    tally[0, p[k]] += counts[p] * (1 - post[p])
            right.append(
                (
                    (tally[1, 1] + 0.8 * strength) / (tally[1, 1] + tally[1, -1] + strength),
                    (tally[0, -1] + 0.8 * strength) / (tally[0, 1] + tally[0, -1] + strength),
                )
            )
        moved, new = 0.0, {}
        for p in patterns:
            odds = math.log(share / (1 - share))
            for v, (g, b) in zip(p, right):
                odds += math.log(g / (1 - b)) if v > 0 else math.log((1 - g) / b) if v < 0 else 0.0
            new[p] = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            moved = max(moved, abs(new[p] - post[p]))
        post = new
        if moved < tolerance:
            break
    return post


#: A row stays if it is at least as likely good as not.
KEEP_FROM = 0.5


def _with_features(df: DataFrame, text_col: str) -> DataFrame:
    """All columns and the counts."""
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in FEATURES)])

    def make():
        return lambda cols: dict(zip(FEATURES, zip(*map(features, cols[text_col]))))

    return map_batches(df, schema, make, [text_col])


def _pattern():
    return F.concat_ws(",", *(v.cast("string") for v in rules().values()))


def _judged(counted: DataFrame, keep_from: float) -> DataFrame:
    """The rows of a kept table with ``base_failed`` and ``kept``: the base rules hold
    and the posterior of the vote pattern is high enough.

    The driver gets a line a pattern, and sends those that count as good back as a
    broadcast table: at most 3 ** rules lines, whatever the input."""
    spark = counted.sparkSession
    with freeing_shuffles(spark):
        tally = {tuple(map(int, r["p"].split(","))): r["n"] for r in counted.groupBy(_pattern().alias("p")).agg(F.count("*").alias("n")).collect()}
    good = [(",".join(map(str, p)), True) for p, share in fit(tally).items() if share >= keep_from]
    table = spark.createDataFrame(good, "pattern string, good boolean")
    joined = counted.withColumn("pattern", _pattern()).join(F.broadcast(table), "pattern", "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.col("good").isNotNull()).drop("pattern", "good")


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """Id, the counts, ``base_failed`` and ``kept`` of every row."""
    with Scratch(df.sparkSession) as scratch:
        # Narrow; saves counting all texts again.
        counted = scratch.keep(_with_features(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").drop("text"))
        scratch.returned(counted)
        return _judged(counted, keep_from).withColumnRenamed("id", id_col)


def keep_good(df: DataFrame, text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows that stay, with the columns they came with. The rows are written once
    with their counts, so that each text is looked at once."""
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    with Scratch(df.sparkSession) as scratch:
        counted = scratch.keep(_with_features(df.select(whole.alias("payload"), F.col(text_col).alias("text")), "text").drop("text"))
        scratch.returned(counted)
        return _judged(counted, keep_from).filter("kept").select("payload.*")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    out = judge(read(spark, sf_dir, "documents"))
    return out.select("doc_id", *FEATURES[:5], "base_failed", "kept")
