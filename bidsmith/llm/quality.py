"""Quality rules: learned decision lists over text statistics, in DataFrame operations only.

`statistics` computes every figure with built-in expressions in one pass over the text.
`learn` fits an ordered list of threshold conjunctions by sequential covering: a rule grows
by the condition of best gain, is pruned on held-back rows, and is kept while it stays precise.
The fit reads a bounded sample of labelled rows (`sample_rows`, the rows of smallest
hash); `verdict` emits the list as one ordered Spark conditional expression.

Defined results: a null or empty text has no words and fails the base rule; an empty table gives no rows; repeated rows are
judged alike, and of repeated labels of a doc_id the lowest counts; of conditions with equal gain the first figure in
FIGURES, then the lowest threshold, is taken; very long texts are judged whole; further columns, whatever their names, are dropped;
without labels every row the base passes is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidsmith.llm.common import SPACE, cut

#: (name, how the figure follows from the statistics); all are ratios, so no length dominates.
FIGURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "bang_per_word": "n_bangs / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "n_words": "n_words",
}


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words covered by five-word windows that occur twice or more. n log n in the words of a text."""

    def covered(spots: Column) -> Column:
        def gaps(at: Column) -> Column:
            n = F.size(at)
            return F.aggregate(F.transform(at, lambda x, i: F.when(i + 1 < n, F.least(F.lit(5), F.get(at, i + 1) - x)).otherwise(5)), F.lit(0), lambda a, x: a + x)

        return let(F.sort_array(spots), gaps)

    def windows(hashes: Column) -> Column:
        n = F.size(hashes) - 4
        keys = F.transform(F.slice(hashes, 1, n), lambda h, i: F.struct(F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2), F.get(hashes, i + 3), F.get(hashes, i + 4)).alias("k"), i.alias("i")))
        return let(F.sort_array(keys), repeats)

    def repeats(order: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(order, j)["k"] == x["k"], F.lit(False))
        spots = F.transform(F.filter(order, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])
        return covered(spots)

    return F.when(F.size(words) < 6, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), windows)).cast("long")


def statistics(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, further columns that are named, and the counts of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    gone = lambda pattern: (F.length("_text") - F.length(F.regexp_replace("_text", pattern, ""))).cast("long")
    split = docs.select("doc_id", *more, text.alias("_text"), F.filter(F.split(text, SPACE), lambda w: w != "").alias("_words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    return split.select(
        "doc_id",
        *more,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        gone("[#*$%&|<>]+").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        gone("!+").alias("n_bangs"),
        gone("[A-Z]+").alias("n_upper"),
        gone("[0-9]+").alias("n_digits"),
    )


@dataclass(frozen=True)
class Rule:
    """Reject where all (figure, is_above, threshold) hold."""

    conditions: tuple[tuple[str, bool, float], ...]

    def covers(self, row: dict) -> bool:
        return all((row[f] > t) == above for f, above, t in self.conditions)

    def column(self) -> Column:
        out = F.lit(True)
        for f, above, t in self.conditions:
            x = F.expr(FIGURES[f])
            out = out & ((x > t) if above else ~(x > t))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>' if above else '<='} {t:.4g}" for f, above, t in self.conditions) + " -> reject"


def learn(rows: list[tuple[dict, int]], max_rules: int = 12, max_conditions: int = 3, least_precision: float = 0.9, least_cover: int = 3) -> list[Rule]:
    """An ordered decision list that rejects label 0; rows: (figures, label). Every third row is held back for pruning."""
    grow = [r for i, r in enumerate(rows) if i % 3]
    prune = [r for i, r in enumerate(rows) if not i % 3]
    rules: list[Rule] = []

    def counts(rule: Rule, of: list) -> tuple[int, int]:
        hit = [y for x, y in of if rule.covers(x)]
        return len(hit) - sum(hit), sum(hit)

    import math

    for _ in range(max_rules):
        rule, inside = Rule(()), grow
        for _ in range(max_conditions):
            bad, good = sum(1 for _, y in inside if not y), sum(1 for _, y in inside if y)
            if not bad or not good:
                break
            base, best = math.log2(bad / (bad + good)), (1e-9, None)
            for f in FIGURES:
                order = sorted((x[f], y) for x, y in inside)
                b = g = 0
                for i, (v, y) in enumerate(order[:-1]):
                    b, g = b + (not y), g + y
                    if order[i + 1][0] == v:
                        continue
                    t = (v + order[i + 1][0]) / 2
                    for above, p, n in ((True, bad - b, good - g), (False, b, g)):
                        if p and (gain := p * (math.log2((p + 0.5) / (p + n + 1)) - base)) > best[0]:
                            best = (gain, (f, above, t))
            if best[1] is None:
                break
            rule = Rule((*rule.conditions, best[1]))
            inside = [r for r in inside if rule.covers(r[0])]
        while len(rule.conditions) > 1:
            worth = lambda r: (lambda p, n: (p - n) / (p + n) if p + n else -1.0)(*counts(r, prune))
            shorter = Rule(rule.conditions[:-1])
            if worth(shorter) < worth(rule):
                break
            rule = shorter
        p, n = (a + b for a, b in zip(counts(rule, grow), counts(rule, prune), strict=True))
        if not rule.conditions or p < least_cover or p / (p + n) < least_precision:
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not rule.covers(r[0])] for part in (grow, prune))
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def labelled(docs: DataFrame, labels: DataFrame, sample_rows: int) -> list[tuple[dict, int]]:
    """Figures and labels of at most sample_rows labelled rows that pass the base, the smallest hashes of doc_id first."""
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # written first: else Spark computes the statistics of every document and joins after that
    own = cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "labelled")  # the broadcast side: sample_rows ids
    names = [f"f_{f}" for f in FIGURES]
    figures = [F.expr(e).cast("double").alias(n) for n, e in zip(names, FIGURES.values(), strict=True)]
    found = statistics(own, "quality").select("doc_id", "quality", base_failed().alias("failed"), *figures, F.xxhash64("doc_id").alias("order")).collect()
    found = sorted((r for r in found if not r["failed"]), key=lambda r: (r["order"], r["doc_id"], r["quality"], *(r[n] for n in names)))
    return [({f: r[f"f_{f}"] for f in FIGURES}, int(r["quality"])) for r in found]


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: true keeps."""
    out = F.when(base_failed(), False)
    for r in rules:
        out = out.when(r.column(), False)
    return out.otherwise(True)


def quality_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000) -> DataFrame:
    """Statistics, base_failed and kept of every document; kept follows the list learned from labels.quality."""
    rules = learn(labelled(docs, labels, sample_rows))
    return statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", verdict(rules))
