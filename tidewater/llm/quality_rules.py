"""Quality rules: a decision list, learned by sequential covering, as one Spark conditional expression.

document_stats() measures texts with SQL functions. learn_rules() grows threshold conjunctions, one
condition at a time, on two thirds of the labelled rows and prunes them on the rest. Each step is one
grouped sum over (statistic, bin), so what reaches the driver is statistics times bins rows, whatever
the number of labels. as_expression() turns the list into nested CASE WHEN.

Defined cases: null and empty texts have no words, fail the base rule and are rejected; labels that are
null, of unknown documents or contradictory count as they stand, row by row; without labels of both
kinds the list is empty and the base rule alone decides. Repeated rows are judged alike, each by itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound, table, words_column, written

SPACES = "\\x20\\x09-\\x0D"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
WINDOW = 8
#: What conditions may name: shares and means, so that thresholds hold for texts of any length.
RATIOS = {
    "symbols_per_100_words": lambda: 100 * F.col("n_symbols") / F.col("n_words"),
    "repeated_words_share": lambda: F.col("n_repeat_words") / F.col("n_words"),
    "duplicate_lines_share": lambda: F.col("n_dup_lines") / F.col("n_lines"),
    "mean_word_chars": lambda: F.col("word_chars") / F.col("n_words"),
    "upper_share": lambda: F.col("n_upper") / F.col("word_chars"),
    "exclamations_per_100_words": lambda: 100 * F.col("n_exclaim") / F.col("n_words"),
    "digits_share": lambda: F.col("n_digits") / F.col("word_chars"),
    "distinct_words_share": lambda: F.col("n_distinct_words") / F.col("n_words"),
}


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.name)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (c.column() for c in self.conditions))

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _count_of(text: Column, chars: str) -> Column:
    """Characters of a class. A pattern goes through a text several times as fast as a table of characters does."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))).cast("long")


def _repeated_words(words: Column, width: int) -> Column:
    """Words inside windows that occur at least twice: sorted (hash, place) pairs show equal neighbours; sorted places, how far each window reaches."""

    def covered(pairs: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            before = F.get(pairs, i - 1)["h"] == x["h"]
            after = F.get(pairs, i + 1)["h"] == x["h"]
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        places = F.array_sort(F.transform(F.filter(pairs, twin), lambda x: x["i"]))
        return bound(
            places,
            lambda ps: F.aggregate(
                F.transform(ps, lambda p, k: F.coalesce(F.least(F.lit(width), F.get(ps, k + 1) - p), F.lit(width))),
                F.lit(0).cast("long"),
                lambda total, x: total + x,
            ),
        )

    def counted(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            bound(F.array_sort(pairs), covered)
        )

    windows = bound(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _windows(h, width))
    return F.when(F.size(words) <= width, F.lit(0).cast("long")).otherwise(bound(windows, counted))


def _windows(hashes: Column, width: int) -> Column:
    """A hash for each run of width hashes (a power of two): of neighbours, then of neighbouring pairs, and so on, so a word is hashed once."""
    if width == 1:
        return hashes
    half = width // 2

    def joined(x: Column) -> Column:
        n = F.greatest(F.size(x) - half, F.lit(0))
        return F.zip_with(F.slice(x, 1, n), F.slice(x, half + 1, n), lambda a, b: F.xxhash64(a, b))

    return bound(_windows(hashes, half), joined)


def document_stats(docs: DataFrame, kept: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The kept columns and integer statistics of each document."""
    staged = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    text = F.col("_text")

    def measured(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            _repeated_words(words, WINDOW).alias("n_repeat_words"),
            F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
        )

    def lines(found: Column) -> Column:
        return F.struct(
            F.size(found).cast("long").alias("n_lines"),
            (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("n_dup_lines"),
        )

    with_words = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    out = staged.select(
        *kept,
        bound(words_column(text), measured).alias("_w"),
        bound(with_words, lines).alias("_l"),
        F.length(F.regexp_replace(text, f"[{SPACES}]+", "")).cast("long").alias("word_chars"),
        _count_of(text, SYMBOLS).alias("n_symbols"),
        _count_of(text, "!").alias("n_exclaim"),
        _count_of(text, "0-9").alias("n_digits"),
        _count_of(text, "A-Z").alias("n_upper"),
    )
    return out.select(
        *kept, "_w.n_words", "word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words",
        "_l.n_lines", "_w.n_distinct_words", "n_exclaim", "n_digits", "n_upper",
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def with_ratios(stats: DataFrame) -> DataFrame:
    """stats with RATIOS; where there is nothing to divide by, 0."""
    return stats.withColumns(
        {k: F.coalesce(F.when(F.greatest("n_words", "n_lines", "word_chars") > 0, f()), F.lit(0.0)) for k, f in RATIOS.items()}
    )


def _thresholds(labelled: DataFrame, bins: int) -> dict[str, list[float]]:
    """Cut points by approximate quantiles of the rejected and of all rows: rare faults need cuts in their own range."""
    at = [(i + 0.5) / bins for i in range(bins)]
    aggs = []
    for k in RATIOS:
        aggs.append(F.percentile_approx(k, at, 10000).alias(f"{k}|all"))
        aggs.append(F.percentile_approx(F.when(F.col("bad") == 1, F.col(k)), at, 10000).alias(f"{k}|bad"))
    row = labelled.agg(*aggs).first()
    return {k: sorted({*(row[f"{k}|all"] or []), *(row[f"{k}|bad"] or [])}) for k in RATIOS}


def _bin(value: Column, points: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, points)).cast("array<double>"), lambda p: p < value))


def _histogram(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """For each statistic and bin: rows and bad rows. Bin i holds what is above cut i-1 and not above cut i."""
    entries = []
    for k, points in cuts.items():
        entries.append(F.struct(F.lit(k).alias("name"), _bin(F.col(k), points).alias("bin")))
    grouped = (
        rows.select("bad", F.explode(F.array(*entries)).alias("e"))
        .groupBy("e.name", "e.bin")
        .agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
        .collect()
    )
    out = {k: [(0, 0)] * (len(points) + 1) for k, points in cuts.items()}
    for r in grouped:
        out[r["name"]][r["bin"]] = (r["n"], int(r["bad"]))
    return out


def _best_condition(hist: dict, cuts: dict, taken: tuple, least: int) -> tuple[float, Condition] | None:
    """The condition of the highest precision (Laplace), then of the widest cover."""
    best = None
    for k, bins in hist.items():
        n_all, bad_all = sum(n for n, _ in bins), sum(b for _, b in bins)
        n = bad = 0
        for (dn, db), cut in zip(bins, cuts[k], strict=False):
            n, bad = n + dn, bad + db
            for above, m, hits in ((False, n, bad), (True, n_all - n, bad_all - bad)):
                c = Condition(k, above, cut)
                if hits < least or m == n_all or c in taken:
                    continue
                key = (round((hits + 1) / (m + 2), 3), hits, k, above)
                if best is None or key > best[0]:
                    best = (key, c)
    return None if best is None else (best[0][0], best[1])


def learn_rules(
    labelled: DataFrame,
    bins: int = 24,
    max_rules: int = 6,
    max_conditions: int = 3,
    precision: float = 0.97,
    least: int = 5,
) -> list[Rule]:
    """Rules for rejection. labelled: RATIOS, bad (0 or 1) and fold (0 prunes, others grow).

    Each rule grows until it is precise on the growing rows, then loses its last conditions as long as
    the pruning rows' precision does not fall, and is kept if it is precise there too.
    """
    cuts = _thresholds(labelled, bins)
    rules: list[Rule] = []
    left = labelled
    for _ in range(max_rules):
        grow, prune = left.where("fold <> 0"), left.where("fold = 0")
        conditions: tuple[Condition, ...] = ()
        rows = grow
        while len(conditions) < max_conditions:
            found = _best_condition(_histogram(rows, cuts), cuts, conditions, least)
            if found is None:
                break
            conditions += (found[1],)
            rows = rows.where(found[1].column())
            if found[0] >= 0.995:
                break
        if not conditions:
            break
        heads = [Rule(conditions[:i]) for i in range(1, len(conditions) + 1)]
        sums = [x for i, h in enumerate(heads) for x in (
            F.coalesce(F.sum(h.column().cast("long")), F.lit(0)).alias(f"n{i}"),
            F.coalesce(F.sum((h.column() & (F.col("bad") == 1)).cast("long")), F.lit(0)).alias(f"b{i}"))]
        seen = prune.agg(*sums).first()
        value = [(seen[f"b{i}"] + 1) / (seen[f"n{i}"] + 2) for i in range(len(heads))]
        i = max(range(len(heads)), key=lambda j: (round(value[j], 3), -j))
        n, bad = seen[f"n{i}"], seen[f"b{i}"]
        if not n or bad / n < precision:
            break
        rules.append(heads[i])
        left = left.where(~heads[i].column())
    return rules


def as_expression(rules: list[Rule]) -> Column:
    """0 where no rule holds, else the number (from 1) of the first that does."""
    if not rules:
        return F.lit(0)
    out = F.when(rules[0].column(), F.lit(1))
    for i, rule in enumerate(rules[1:], 2):
        out = out.when(rule.column(), F.lit(i))
    return out.otherwise(F.lit(0))


def _rules(stats: DataFrame, labels: DataFrame, **learning) -> list[Rule]:
    """stats: of document_stats."""
    known = labels.where(F.col("quality").isin(0, 1)).select("doc_id", (1 - F.col("quality")).cast("int").alias("bad"))
    labelled = with_ratios(stats).where(~base_failed()).join(known, "doc_id").select(
        "bad", *RATIOS, F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("fold")
    )
    return learn_rules(written(labelled, "labelled"), **learning)


def quality_rules(docs: DataFrame, labels: DataFrame, **learning) -> tuple[DataFrame, list[Rule]]:
    """Every document's statistics, base_failed, the first rule that rejects it (0: none) and kept; the rules."""
    stats = written(document_stats(docs), "stats")
    rules = _rules(stats, labels, **learning)
    judged = (
        with_ratios(stats).withColumn("base_failed", base_failed())
        .withColumn("rule", as_expression(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
        .drop(*RATIOS)
    )
    return judged, rules


def accepted(docs: DataFrame, labels: DataFrame, **learning) -> DataFrame:
    """The rows of docs that are kept. Texts are measured once and never shuffled: they are written beside their statistics."""
    whole = F.struct(*(F.col(c) for c in docs.columns)).alias("_doc")
    held = written(document_stats(docs.select(whole, "text", "doc_id"), ("_doc", "doc_id")), "measured")
    rules = _rules(held.drop("_doc"), labels, **learning)
    judged = with_ratios(held)
    return judged.where(~base_failed() & (as_expression(rules) == 0)).select("_doc.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged, _ = quality_rules(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    return judged
