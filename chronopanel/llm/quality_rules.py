"""Document quality by weak supervision.

Each rule votes good, votes bad or abstains. Expectation-maximisation over the counts of vote
patterns estimates how often each rule votes what on good and on bad documents, and a document
is kept by its posterior probability of being good instead of by passing every rule.

The main path is DataFrame functions only. The driver sees one row per vote pattern: at most
3 ** (number of rules), whatever the number of documents.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.registry import query, table
from chronopanel.llm.text import SPACE_CLASS, id_and_text

BAD, ABSTAIN, GOOD = 0, 1, 2


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def _repeated_words(words: Column, width: int = 3) -> Column:
    """Words inside windows of ``width`` words that the text holds twice or more.

    A text whose windows are all different, as most are, needs one hash set. Otherwise windows are
    sorted with their places, equal neighbours marked, and the covered words added up.
    """
    n = F.size(words) - (width - 1)
    grams = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(width)])
    )

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def marked(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
            return F.array_sort(F.transform(twice, lambda x: x["p"]))

        return _let(_let(placed, marked), lambda at: F.aggregate(
            F.transform(at, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - p, F.lit(width)))),
            F.lit(0), lambda a, x: a + x))

    unlike = _let(grams, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n >= 2, unlike).otherwise(F.lit(0))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id and the counts that the rules read. Null text counts as no words.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines, n_repeat_words, and of
    the rules' own: n_unlike (different words), n_lines (with a word), n_upper (A-Z), n_punct (ASCII
    punctuation), n_shout (pairs of ``!``).
    """
    base = id_and_text(docs, id_col, text_col).withColumn("__text", F.coalesce(F.col("__text"), F.lit("")))
    text = F.col("__text")
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("bigint")
    return base.select(
        F.col("__id").alias(id_col),
        _let(_words(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), F.size(F.array_distinct(w)).cast("bigint").alias("u"), _repeated_words(w).cast("bigint").alias("r"))).alias("__w"),
        (F.length(text).cast("bigint") - count(SPACE_CLASS)).alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        _let(lines, lambda v: F.struct(F.size(v).cast("bigint").alias("n"), (F.size(v) - F.size(F.array_distinct(v))).cast("bigint").alias("d"))).alias("__l"),
        count("[A-Z]").alias("n_upper"),
        count(r"[!-/:-@\[-`{-~]").alias("n_punct"),
        count("!!").alias("n_shout"),
    ).select(
        id_col, F.col("__w.n").alias("n_words"), "word_chars", "n_symbols", F.col("__l.d").alias("n_dup_lines"),
        F.col("__w.r").alias("n_repeat_words"), F.col("__w.u").alias("n_unlike"), F.col("__l.n").alias("n_lines"), "n_upper", "n_punct", "n_shout",
    )


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""

    name: str
    bad: Column
    good: Column

    def vote(self) -> Column:
        return F.when(F.coalesce(self.bad, F.lit(False)), BAD).when(F.coalesce(self.good, F.lit(False)), GOOD).otherwise(ABSTAIN)


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def default_rules() -> list[Rule]:
    length = _share("word_chars", "n_words")
    # Each kind of junk meets two rules at least: what rules agree on is all that EM can learn from.
    return [
        Rule("word_length", ~length.between(2.5, 12.0), length.between(3.5, 7.0)),
        Rule("symbols", _share("n_symbols", "n_words") > 0.1, _share("n_symbols", "n_words") < 0.02),
        Rule("punctuation", _share("n_punct", "word_chars") > 0.08, _share("n_punct", "word_chars") < 0.06),
        Rule("repeated_words", _share("n_repeat_words", "n_words") > 0.3, _share("n_repeat_words", "n_words") < 0.1),
        Rule("few_words", _share("n_unlike", "n_words") < 0.3, _share("n_unlike", "n_words") > 0.45),
        Rule("repeated_lines", _share("n_dup_lines", "n_lines") > 0.35, F.col("n_dup_lines") == 0),
        Rule("capitals", _share("n_upper", "word_chars") > 0.3, _share("n_upper", "word_chars") < 0.1),
        Rule("shouting", _share("n_shout", "n_words") > 0.1, F.col("n_shout") == 0),
    ]


@dataclass
class LabelModel:
    """What EM learned: the prior of good, and each rule's vote probabilities by class."""

    prior: float
    votes: list[list[list[float]]]  # [rule][class: 0 bad, 1 good][vote]
    rounds: int = 0
    names: list[str] = field(default_factory=list)

    def accuracies(self) -> dict[str, float]:
        """Of each rule, how often its vote is right when it votes."""
        out = {}
        for name, (bad, good) in zip(self.names, self.votes, strict=True):
            right = (1 - self.prior) * bad[BAD] + self.prior * good[GOOD]
            wrong = (1 - self.prior) * bad[GOOD] + self.prior * good[BAD]
            out[name] = right / (right + wrong)
        return out

    def log_odds(self, j: int, vote: int) -> float:
        return math.log(self.votes[j][1][vote]) - math.log(self.votes[j][0][vote])


def fit_label_model(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 200, tolerance: float = 1e-9) -> LabelModel:
    """EM on (vote pattern, count). Pseudo-counts worth 1 % of the documents, and 50 at least, say
    that rules are right more often than wrong; they name the two classes and keep them from
    swapping. Without documents the model is what they say."""
    patterns = sorted(patterns)
    total = sum(n for _, n in patterns)
    weight = max(50.0, 0.01 * total)
    anchor = ([0.25, 0.15, 0.6], [0.01, 0.14, 0.85])
    model = LabelModel(0.8, [[list(anchor[0]), list(anchor[1])] for _ in range(n_rules)])
    last = -math.inf
    for step in range(rounds):
        sums = [[[weight * p for p in anchor[y]] for y in (0, 1)] for _ in range(n_rules)]
        mass = [0.2 * weight, 0.8 * weight]
        likelihood = 0.0
        for votes, n in patterns:
            log = [math.log(1 - model.prior), math.log(model.prior)]
            for j, v in enumerate(votes):
                log[0] += math.log(model.votes[j][0][v])
                log[1] += math.log(model.votes[j][1][v])
            top = max(log)
            e = [math.exp(x - top) for x in log]
            likelihood += n * (top + math.log(sum(e)))
            for y in (0, 1):
                share = n * e[y] / sum(e)
                mass[y] += share
                for j, v in enumerate(votes):
                    sums[j][y][v] += share
        model = LabelModel(mass[1] / sum(mass), [[[s / sum(row) for s in row] for row in rule] for rule in sums], step + 1)
        if total and abs(likelihood - last) <= tolerance * total:
            break
        last = likelihood
    return model


def posterior(model: LabelModel, votes: list[Column]) -> Column:
    """Probability that a document with these votes is good."""
    odds = F.lit(math.log(model.prior) - math.log(1 - model.prior))
    for j, vote in enumerate(votes):
        w = [model.log_odds(j, v) for v in (BAD, ABSTAIN, GOOD)]
        odds = odds + F.when(vote == BAD, w[BAD]).when(vote == GOOD, w[GOOD]).otherwise(w[ABSTAIN])
    return 1 / (1 + F.exp(-odds))


def label_quality(counts: DataFrame, rules: list[Rule] | None = None) -> tuple[DataFrame, LabelModel]:
    """``counts`` with a column ``quality`` (posterior of good), and the model.

    The counts are aggregated to vote patterns in one pass; store them first if they are costly.
    """
    rules = default_rules() if rules is None else rules
    votes = [r.vote() for r in rules]
    names = [f"v{j}" for j in range(len(rules))]
    found = counts.select(*[v.alias(n) for v, n in zip(votes, names, strict=True)]).groupBy(*names).count()
    patterns = [(tuple(row[n] for n in names), row["count"]) for row in found.collect()]
    model = fit_label_model(patterns, len(rules))
    model.names = [r.name for r in rules]
    return counts.withColumn("quality", posterior(model, votes)), model


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50,
                   max_repeat_pct: int = 50, min_quality: float = 0.5, rules: list[Rule] | None = None) -> DataFrame:
    """One row per input row: id, counts, base_failed, quality, kept.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat_pct`` % of them in repeated
    windows. Other rows are kept if ``quality`` >= ``min_quality``.

    Null and empty texts have no words and fail. Repeated rows and null ids are rows like others. An
    empty table gives an empty result. Columns other than id and text are not read.
    """
    from chronopanel.session import materialize

    counts = materialize(text_counts(docs, id_col, text_col))
    scored, _ = label_quality(counts, rules)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= min_quality))


@query("op5_quality_rules")
def op5_quality_rules(spark, sf_dir):
    out = quality_filter(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
