"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, the posterior decides.

Native: column expressions only. Rows are judged alone, so nothing is shuffled but
the counts of vote patterns.

A fixed base rule rejects what is too short or mostly repeats itself. Of the rest, each rule says good,
bad or nothing; the rules overlap, so EM learns from their agreement how far each can be
trusted, and a document stays if the posterior probability of good quality is a half or more.

Defined cases: null text has no words; a document without words fails the base rule;
repeated rows are judged each; an empty table gives an empty table; other columns pass
through ``filter_quality`` untouched and can't clash, as its own column takes an unused name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.em import VoteModel, fit_votes
from waymark.llm.text import SPACES, let, words
from waymark.plans.scratch import materialize

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: What a line that is a sentence ends with.
ENDS = (".", "!", "?", ":", ";", '"', "'", ")", "\u2019", "\u201d", "\u00bb", "\u3002")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_marks", "n_others", "n_ended_lines")


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """How many words of the array lie in windows of ``window`` words (a power of two) that occur twice or more."""

    def covered(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, i: (
            ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
        starts = let(placed, lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
        return F.aggregate(
            starts, F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n")),
            lambda a: a["n"])

    def runs(h: Column, k: int) -> Column:
        """From hashes of the runs of ``k`` words those of ``window`` words; runs over the end are cut off last."""
        if k < window:
            wider = F.zip_with(h, F.slice(h, F.lit(k + 1), F.size(h) - k), lambda a, b: F.xxhash64(a, b))
            return let(wider, lambda x: runs(x, 2 * k))
        return let(F.slice(h, F.lit(1), F.size(h) - (window - 1)), lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(0))

    return F.when(F.size(w) > window, let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: runs(h, 1))).otherwise(0)


def measures(text: Column) -> Column:
    """A struct of MEASURES (bigint) for one text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda c, name: c.cast("bigint").alias(name)
    return let(words(text), lambda w: let(lines, lambda s: F.struct(
        long(F.size(w), "n_words"),
        long(F.length(F.array_join(w, "")), "word_chars"),
        long(F.regexp_count(text, F.lit(SYMBOLS)), "n_symbols"),
        long(F.size(s), "n_lines"),
        long(F.size(s) - F.size(F.array_distinct(s)), "n_dup_lines"),
        long(repeated_words(w), "n_repeat_words"),
        long(F.regexp_count(text, F.lit(r"[!?]")), "n_marks"),
        long(F.regexp_count(text, F.lit(r"[^\p{L}\x20\x09-\x0D]")), "n_others"),
        long(F.size(F.filter(s, lambda x: F.substring(F.rtrim(x, F.lit(" \t\x0b\x0c\r")), -1, 1).isin(*ENDS))), "n_ended_lines"),
    )))


def base_failed(m) -> Column:
    """The fixed rule: too short, or mostly repeated windows. ``m``: gives a measure by its name."""
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def votes(m) -> list[Column]:
    """Per rule +1 (good), -1 (bad) or 0 (abstains)."""
    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    n = m["n_words"]
    return [
        vote(n >= 60, n < 30),
        vote((10 * m["word_chars"] >= 35 * n) & (10 * m["word_chars"] <= 65 * n), (m["word_chars"] < 3 * n) | (m["word_chars"] > 8 * n)),
        vote(100 * m["n_symbols"] <= 5 * n, 100 * m["n_symbols"] > 20 * n),
        vote(100 * m["n_others"] <= 10 * m["word_chars"], 100 * m["n_others"] > 20 * m["word_chars"]),
        vote(m["n_dup_lines"] == 0, 100 * m["n_dup_lines"] > 15 * m["n_lines"]),
        vote(100 * m["n_repeat_words"] <= 2 * n, 100 * m["n_repeat_words"] > 15 * n),
        vote(100 * m["n_ended_lines"] >= 95 * m["n_lines"], 100 * m["n_ended_lines"] < 90 * m["n_lines"]),
        vote(100 * m["n_marks"] <= 10 * n, 100 * m["n_marks"] > 40 * n),
    ]


RULES = 8


def pattern(m) -> Column:
    """The votes as one of '+', '-', '0' per rule; null where the base rule has decided."""
    signs = F.concat(*[F.when(v > 0, "+").when(v < 0, "-").otherwise("0") for v in votes(m)])
    return F.when(~base_failed(m), signs)


def _counted(patterns: DataFrame) -> VoteModel:
    """Rows that fail the base rule are decided, so their (null) patterns don't shape the votes' weights."""
    counts = patterns.where("votes is not null").groupBy("votes").count().collect()  # at most 3 ** RULES rows
    return fit_votes({r["votes"]: r["count"] for r in counts}, RULES)


def fit_rules(docs: DataFrame, text: str = "text") -> VoteModel:
    """The vote model over every row of ``docs``."""
    return _counted(docs.select(let(measures(F.col(text)), pattern).alias("votes")))


def verdict(m, model: VoteModel) -> Column:
    return ~base_failed(m) & (model.log_odds_column(votes(m)) >= 0)


def judge_quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, MEASURES, base_failed, p_good (posterior) and kept."""
    measured = materialize(docs.select(F.col(key), measures(F.col(text)).alias("m")).select(key, "m.*"), "quality")
    model = _counted(measured.select(pattern(measured).alias("votes")))
    odds = model.log_odds_column(votes(measured))
    return measured.select("*", base_failed(measured).alias("base_failed"), (1 / (1 + F.exp(-odds))).alias("p_good"),
                           verdict(measured, model).alias("kept"))


def filter_quality(docs: DataFrame, model: VoteModel | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns.

    A verdict hangs on the votes alone. Without a ``model``, rows are written once with their votes, so that
    the measures, nearly all of the work, aren't taken a second time after the fit.
    """
    if model:
        return docs.where(let(measures(F.col(text)), lambda m: verdict(m, model)))
    votes_ = "votes"
    while votes_ in docs.columns:
        votes_ += "_"
    voted = materialize(docs.withColumn(votes_, let(measures(F.col(text)), pattern)), "voted")
    fitted = _counted(voted.select(F.col(votes_).alias("votes")))
    signs = [F.when(F.substring(votes_, i + 1, 1) == "+", 1).when(F.substring(votes_, i + 1, 1) == "-", -1).otherwise(0) for i in range(RULES)]
    return voted.where(F.col(votes_).isNotNull() & (fitted.log_odds_column(signs) >= 0)).drop(votes_)
