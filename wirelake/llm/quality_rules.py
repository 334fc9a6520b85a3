"""Quality by weak supervision, in DataFrame operations alone.

Rules look at counts of a text and vote good or bad, or abstain. How often each rule is right about good
documents, and about those that are bad in its way or another, is estimated without labels, by
expectation-maximisation over the histogram of vote patterns; every document then has a posterior
probability of being good.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

WHITE = r"[\x20\x09-\x0D]+"
WINDOW = 5
PREFIX = "__quality_"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE, -1), "")


def _repeated(words: Column, hashes: Column) -> Column:
    """Words in windows whose hash is found twice or more: sorted hashes tell the windows, and the words are the length of their union."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s):
        twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def union(p):
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"), lambda acc, k: acc + F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(WINDOW))).cast("long"))

    let = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  evaluates the value once
    found = let(pairs, lambda s: let(places(s), union))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), found).otherwise(F.lit(0).cast("long"))


def with_counts(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_symbol_ends (words that end in one), n_stops (sentence marks), n_dup_lines, n_repeat_words, n_lines and n_distinct_words (long).

    Words are ``[^\\x20\\x09-\\x0D]+``; a null text has none. Windows are told apart by a 64-bit hash of their words.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    own = PREFIX + "words", PREFIX + "lines", PREFIX + "hashes"
    words, lines, hashes = (F.col(x) for x in own)
    n = F.size(words)
    has_word = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    made = df.withColumns({own[0]: words_of(F.col(text)), own[1]: F.filter(F.split(t, "\n", -1), has_word)})
    made = made.withColumn(own[2], F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")))
    counts = {
        "n_words": n,
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")),
        "n_symbol_ends": F.regexp_count(t, F.lit(r"[#*$%&|<>](?![^\x20\x09-\x0D])")),
        "n_stops": F.regexp_count(t, F.lit("[.!?\u3002\u0964]")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_lines": F.size(lines),
        "n_distinct_words": F.size(F.array_distinct(words)),
        "n_repeat_words": _repeated(words, hashes),
    }
    return made.withColumns({prefix + k: c.cast("long") for k, c in counts.items()}).drop(*own)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_symbol_ends", "n_stops", "n_dup_lines", "n_lines", "n_distinct_words", "n_repeat_words")

#: Rule: when it votes bad, when it votes good; otherwise it abstains. {x} stands for a count. Variety is held against the square root of the length, as vocabularies grow.
RULES: dict[str, tuple[str, str]] = {
    "length": ("{n_words} < 10", "{n_words} >= 25"),
    "symbols": ("10 * {n_symbols} > {n_words}", "50 * {n_symbols} <= {n_words}"),
    "repeats": ("100 * {n_repeat_words} > 20 * {n_words}", "100 * {n_repeat_words} <= 5 * {n_words}"),
    "lines": ("2 * {n_dup_lines} > {n_lines}", "{n_lines} >= 3 and 10 * {n_dup_lines} <= {n_lines}"),
    "word_length": ("{word_chars} > 12 * {n_words} or {word_chars} < 2 * {n_words}", "{word_chars} between 3 * {n_words} and 9 * {n_words}"),
    "variety": ("{n_words} >= 20 and {n_distinct_words} * {n_distinct_words} < 4 * {n_words}", "{n_words} >= 20 and {n_distinct_words} * {n_distinct_words} >= 9 * {n_words}"),
    "symbol_ends": ("20 * {n_symbol_ends} > {n_words}", "100 * {n_symbol_ends} <= {n_words}"),
    "stops": ("{n_words} >= 25 and 25 * {n_stops} < {n_words}", "{n_words} >= 25 and 20 * {n_stops} >= {n_words}"),
}


def votes(prefix: str = "") -> dict[str, Column]:
    """1 good, 0 bad, null abstains."""
    fill = {k: f"`{prefix}{k}`" for k in COUNTS}
    return {name: F.when(F.expr(bad.format(**fill)), 0).when(F.expr(good.format(**fill)), 1) for name, (bad, good) in RULES.items()}


GOOD = "good"


@dataclass
class LabelModel:
    """Documents are good, or bad in the way that one of the rules is about. share: of each of these classes; accuses: how
    often a rule that doesn't abstain votes bad on documents of a class, so 1 - accuses[GOOD][rule] is its accuracy on good ones."""

    share: dict[str, float]
    accuses: dict[str, dict[str, float]]
    rounds: int = 0

    def weights(self, cast: dict[str, int | None]) -> dict[str, float]:
        """The probability of each class."""
        logs = {c: math.log(p) + sum(math.log(1 - self.accuses[c][r] if v else self.accuses[c][r]) for r, v in cast.items() if v is not None) for c, p in self.share.items()}
        most = max(logs.values())
        parts = {c: math.exp(x - most) for c, x in logs.items()}
        total = sum(parts.values())
        return {c: x / total for c, x in parts.items()}

    def posterior(self, cast: dict[str, Column]) -> Column:
        """The probability that a document with these votes is good."""
        odds = F.lit(0.0)
        for c in self.share:
            if c == GOOD:
                continue
            log = F.lit(math.log(self.share[c] / self.share[GOOD]))
            for r, vote in cast.items():
                b, g = self.accuses[c][r], self.accuses[GOOD][r]
                log = log + F.coalesce(F.when(vote == 1, F.lit(math.log((1 - b) / (1 - g)))).when(vote == 0, F.lit(math.log(b / g))), F.lit(0.0))
            odds = odds + F.exp(log)
        return 1 / (1 + odds)


#: Prior rates at which a rule accuses good documents, those bad in its way, and those bad in another, and the share of good documents.
#: WEIGHT: so many votes at the prior rate of good documents and of a rule's own class, and so much of all votes at that of other classes.
PRIOR_GOOD, PRIOR_OWN, PRIOR_OTHER, PRIOR_SHARE, WEIGHT, OTHER_WEIGHT = 0.01, 0.9, 0.05, 0.8, 5.0, 0.02
LEAST = 1e-4


def fit(patterns: list[tuple[dict[str, int | None], int]], rounds: int = 500) -> LabelModel:
    """Expectation-maximisation over (votes, number of documents), at most 3 to the number of rules of them.

    Rates are free between 1 in 10,000 and all but that; priors, not bounds, tell the classes apart. The one that matters is that what is bad in
    some way is accused by other rules as well, at PRIOR_OTHER or, where rules are about the same thing, as often as the data say. So accusations that
    no other rule ever shares are taken for a rule's errors about good documents, and rules that fire together are not taken for
    independent witnesses: their agreement is what a class of bad documents looks like. An empty histogram gives the starting model.
    """
    rules = list(RULES)
    classes = [GOOD, *rules]
    prior = np.full((len(classes), len(rules)), PRIOR_OTHER)
    prior[0] = PRIOR_GOOD
    prior[1:][np.eye(len(rules), dtype=bool)] = PRIOR_OWN
    begin = np.array([PRIOR_SHARE, *[(1 - PRIOR_SHARE) / len(rules)] * len(rules)])
    patterns = sorted(patterns, key=lambda p: [(-1 if p[0][r] is None else p[0][r]) for r in rules])
    said = np.array([[-1 if v[r] is None else v[r] for r in rules] for v, _ in patterns]).reshape(-1, len(rules))
    count = np.array([c for _, c in patterns], float)
    n = count.sum()
    bad, cast = (said == 0).astype(float), (said >= 0).astype(float)
    weight = np.full(prior.shape, max(WEIGHT, OTHER_WEIGHT * n))
    weight[0] = WEIGHT
    weight[1:][np.eye(len(rules), dtype=bool)] = WEIGHT
    share, rate, done = begin, prior, 0
    for done in range(1, rounds + 1) if n else ():
        logs = np.log(share) + bad @ np.log(rate).T + (cast - bad) @ np.log(1 - rate).T
        of = np.exp(logs - logs.max(1, keepdims=True))
        of *= (count / of.sum(1))[:, None]
        new_share = (of.sum(0) + WEIGHT * begin) / (n + WEIGHT)
        new_rate = np.clip((of.T @ bad + weight * prior) / (of.T @ cast + weight), LEAST, 1 - LEAST)
        moved = max(np.abs(new_share - share).max(), np.abs(new_rate - rate).max())
        share, rate = new_share, new_rate
        if moved < 1e-9:
            break
    return LabelModel(dict(zip(classes, share.tolist())), {c: dict(zip(rules, row)) for c, row in zip(classes, rate.tolist())}, done)


def fit_on(counted: DataFrame, prefix: str = "") -> LabelModel:
    """The model for a table of counts. The histogram is all that reaches the driver: at most 3 ** len(RULES) rows."""
    histogram = counted.select(*[v.alias(r) for r, v in votes(prefix).items()]).groupBy(*RULES).count().collect()
    return fit([({r: row[r] for r in RULES}, row["count"]) for row in histogram])


def verdicts(counted: DataFrame, model: LabelModel, prefix: str = "", threshold: float = 0.5) -> DataFrame:
    """Adds good_probability, base_failed and kept."""
    failed = base_failed(F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words"))
    return counted.withColumns({prefix + "good_probability": model.posterior(votes(prefix)), prefix + "base_failed": failed}).withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & (F.col(prefix + "good_probability") >= threshold))


def judged(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep, all counts, base_failed, good_probability and kept, for every row.

    Counts are written once; the histogram and the verdicts both read that table. Null and empty texts have no words and fail
    the base rules. Repeated rows count as often as they occur. An empty table gives an empty table. Extra columns are ignored.
    """
    counted = stored(with_counts(df.select(*keep, text), text).drop(text), "counts")
    return verdicts(counted, fit_on(counted))


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns and no others. Rows with a null or empty text go; rows that repeat one stay or go together; no rows give no rows."""
    # All columns travel in one struct, so none clashes with a count.
    counted = stored(with_counts(df.select(F.struct("*").alias("row"), F.col(text).alias("text")), "text").drop("text"), "counts")
    return verdicts(counted, fit_on(counted)).where("kept").select("row.*")
