"""Quality rules whose cutoffs carry a guarantee on false rejection.

Each rule compares a ratio of text counts with a cutoff. Cutoffs come from labelled documents: within a stratum (language)
and a rule they are tested from the loosest to the tightest, each against the hypothesis that it rejects more than
risk / rules of the good documents, by the exact binomial tail (the Clopper-Pearson bound). Testing stops at the first
cutoff that is not certified, so the order spends no error; over strata and rules the error is divided (Bonferroni).
With confidence 1 - error, the rules together reject at most `risk` of the good documents of every stratum. Among the
certified cutoffs rules are added one by one, each for the bad labelled documents that it catches beyond the rules before it. A stratum with too few good
labels to certify anything rejects nothing beyond the base rule.

Defined results: null text has no words and fails the base rule; a null language is a stratum of its own; labels that are null or contradict each other
count as bad (the least of a document's labels, nulls left out); without labels only the base rule rejects; repeated rows are each judged;
an empty table gives an empty result; other columns are ignored by the digest and kept by keep_good().
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut, lean, words

_HAS_WORD = re.compile(WORD_PATTERN)
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_bangs")
_GRID = (300, 200, 150, 100, 75, 60, 50, 40, 30, 25, 20, 15, 12, 10, 8, 6, 5, 4, 3, 2, 1)
#: name: (count, of which count, cutoffs in percent from loose to tight). A rule rejects above its cutoff.
RULES = {
    "symbols": ("n_symbols", "n_words", _GRID),
    "shouts": ("n_shouts", "n_words", _GRID[4:]),
    "bangs": ("n_bangs", "n_words", _GRID),
    "dup_lines": ("n_dup_lines", "n_lines", _GRID[4:]),
    "repeats": ("n_repeat_words", "n_words", _GRID[6:]),
    "long_words": ("word_chars", "n_words", (4000, 3000, 2500, 2000, 1500, 1200, 1000, 900)),
}
RISK, ERROR = 0.05, 0.05


def measure(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one whole text."""
    if not text:
        return (0,) * len(COUNTS)
    w = words(text)
    n = len(w)
    dup = lines = 0
    if "\n" in text:
        seen: set[str] = set()
        for line in text.split("\n"):
            if line in seen:
                dup += 1
                lines += 1
            elif _HAS_WORD.search(line):
                seen.add(line)
                lines += 1
    else:
        lines = int(n > 0)
    repeat = 0
    if n >= 3:
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) < len(windows):
            times = Counter(windows)
            hit = np.zeros(n, bool)
            again = np.fromiter((times[x] > 1 for x in windows), bool, n - 2)
            for i in range(3):
                hit[i : n - 2 + i] |= again
            repeat = int(hit.sum())
    return n, sum(map(len, w)), sum(map(text.count, SYMBOLS)), dup, repeat, lines, sum(map(str.isupper, w)), text.count("!")


def _measured(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([measure(t) for t in batch.column(text).to_pylist()], np.int64).reshape(batch.num_rows, len(COUNTS))
            keep = [i for i, name in enumerate(batch.schema.names) if name != text or text != "_text"]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(values[:, j]) for j in range(len(COUNTS))], names=[batch.schema.names[i] for i in keep] + [f"_{c}" for c in COUNTS])

    return run


def measures(documents: DataFrame) -> DataFrame:
    """doc_id, _stratum and the COUNTS (with an underscore before) of every text."""
    rows = documents.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_stratum"), F.col("text").alias("_text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    return rows.mapInArrow(lean(_measured("_text")), ddl + "".join(f", _{c} bigint" for c in COUNTS))


def base_failed() -> F.Column:
    return (F.col("_n_words") < 50) | (100 * F.col("_n_repeat_words") > 50 * F.col("_n_words"))


def tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k)."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


Counts = dict[tuple[str, str, int, int], int]


def strata_and_level(good: dict[str, int], risk: float = RISK, error: float = ERROR) -> tuple[list[str], float]:
    """The strata with enough good labels to certify anything, and the error of one (stratum, rule).

    Which strata take part depends on how many good labels they have, not on what the rules do to them.
    """
    each = risk / len(RULES)
    for m in range(len(good), 0, -1):
        part = [s for s, n in sorted(good.items()) if (1 - each) ** n <= error / (m * len(RULES))]
        if len(part) >= m:
            return part, error / (len(part) * len(RULES))
    return [], 0.0


def certified(counts: Counts, stratum: str, rule: str, n_good: int, level: float, risk: float = RISK) -> list[tuple[int, int, int]]:
    """(cutoff, bad documents caught, good ones rejected) of the certified cutoffs, loosest first. x of counts is how many cutoffs are exceeded."""
    each, grid, out = risk / len(RULES), RULES[rule][2], []
    own = [(x, y, n) for (s, r, x, y), n in counts.items() if s == stratum and r == rule]
    for j, cutoff in enumerate(grid):
        # Whoever exceeds a cutoff exceeds all tighter ones, so x counts from the tight end.
        bad, good = (sum(n for x, y, n in own if x >= len(grid) - j and y == label) for label in (0, 1))
        if good >= each * n_good or tail(good, n_good, each) > level:
            break
        out.append((cutoff, bad, good))
    return out


def next_rules(counts: Counts, good: dict[str, int], chosen: dict[str, dict[str, int]], risk: float = RISK, error: float = ERROR) -> dict[str, tuple[str, int]]:
    """For each stratum the rule to add: of the certified cutoffs of unused rules the one with the largest gain, if any gains.

    The gain is bad documents caught less two for each good one rejected; ties go to fewer good rejections, the earlier rule, the looser cutoff.
    """
    part, level = strata_and_level(good, risk, error)
    out = {}
    for stratum in part:
        options = [
            (bad - 2 * rejected, -rejected, -i, -j, rule, cutoff)
            for i, rule in enumerate(RULES)
            if rule not in chosen.get(stratum, {})
            for j, (cutoff, bad, rejected) in enumerate(certified(counts, stratum, rule, good[stratum], level, risk))
        ]
        if options and (best := max(options))[0] > 0:
            out[stratum] = best[4], best[5]
    return out


def calibrate(measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> dict[str, dict[str, int]]:
    """Cutoffs from the labelled documents that pass the base rule, rule by rule on the bad documents that the rules before have not caught.

    Only counts come to the driver: 2 x rules x cutoffs a stratum.
    """
    label = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_y"))
    rows = cut(measured.where(~base_failed()).join(label, F.col("doc_id") == F.col("_id")).withColumn("_y", (F.col("_y") == 1).cast("int")).drop("doc_id", "_id"))
    # Strata of too few good labels to certify anything even alone stay away.
    least = math.ceil(math.log(error / len(RULES)) / math.log1p(-risk / len(RULES)))
    good = {r["_stratum"]: r["count"] for r in rows.where("_y = 1").groupBy("_stratum").count().where(F.col("count") >= least).collect()}
    exceeded = []
    for rule, (count, of, grid) in RULES.items():
        n = sum((100 * F.col(f"_{count}") > c * F.col(f"_{of}")).cast("int") for c in grid)
        exceeded.append(F.struct(F.lit(rule).alias("rule"), n.alias("x")))
    chosen: dict[str, dict[str, int]] = {}
    for _ in RULES:
        left = rows.where((F.col("_y") == 1) | verdict(chosen).isNull())
        found = left.select("_stratum", "_y", F.explode(F.array(*exceeded)).alias("e")).groupBy("_stratum", "e.rule", "e.x", "_y").count().collect()
        added = next_rules({(r["_stratum"], r["rule"], r["x"], r["_y"]): r["count"] for r in found}, good, chosen, risk, error)
        for stratum, (rule, cutoff) in added.items():
            chosen.setdefault(stratum, {})[rule] = cutoff
        if not added:
            break
    return chosen


def verdict(cutoffs: dict[str, dict[str, int]]) -> F.Column:
    """The name of the first rule that rejects the row, or null."""
    rules = [
        F.when((F.col("_stratum") == stratum) & (100 * F.col(f"_{RULES[rule][0]}") > c * F.col(f"_{RULES[rule][1]}")), F.lit(rule))
        for stratum, own in cutoffs.items()
        for rule, c in own.items()
    ]
    return F.coalesce(*rules, F.lit(None).cast("string"))


def judge(documents: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """A row per document: the base counts, base_failed, kept and the rule that rejected it."""
    measured = cut(measures(documents))
    rule = verdict(calibrate(measured, labels, risk, error))
    return measured.select(
        "doc_id", *[F.col(f"_{c}").alias(c) for c in COUNTS[:5]], base_failed().alias("base_failed"),
        (~base_failed() & rule.isNull()).alias("kept"), F.when(base_failed(), F.lit("base")).otherwise(rule).alias("rejected_by"),
    )


def keep_good(documents: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The documents that judge() keeps, with their columns. Texts are measured twice rather than moved."""
    rule = verdict(calibrate(measures(documents), labels, risk, error))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    rows = documents.mapInArrow(lean(_measured("text")), fields + "".join(f", _{c} bigint" for c in COUNTS))
    rows = rows.withColumn("_stratum", F.coalesce(F.col("lang").cast("string"), F.lit("")))
    return rows.where(~base_failed() & rule.isNull()).select(documents.columns)
