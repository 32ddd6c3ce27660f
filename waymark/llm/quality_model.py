"""Quality classifier from weak labels.

Heuristic labellers (the votes of the quality rules) overlap and abstain. EM estimates
their accuracies from the counts of vote patterns over all documents. The posterior of a document is
its soft label; a bounded sample, MAX_TRAIN documents in expectation drawn by hash, trains a
logistic scorer on hashed features: words and word shapes (case, digits and marks), scaled to
length 1. The scorer then judges every document by its text alone.

Defined cases: null and blank texts have no features and get the intercept's score; repeated rows are
scored alike; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.em import VoteModel, fit_votes
from waymark.llm.quality_rules import RULES, measures, votes
from waymark.llm.text import let, words
from waymark.plans.scratch import materialize

MAX_TRAIN = 20_000
FEATURES = 1 << 18


def tokens(text: Column) -> Column:
    """Words; their shapes, with runs of capitals, small letters and digits as A, a and 0; and a mark for each word or line that repeats the one before."""
    shape = text
    for pattern, to in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"\p{N}+", "0")):
        shape = F.regexp_replace(shape, pattern, to)

    def again(parts: Column, mark: str) -> Column:
        same = F.zip_with(parts, F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda x, y: F.when(x == y, F.lit(mark)))
        return F.filter(same, lambda x: x.isNotNull())

    return F.concat(let(words(F.lower(text)), lambda w: F.concat(w, again(w, "\1"))), again(F.split(text, "\n"), "\2"),
                    F.transform(words(shape), lambda s: F.concat(F.lit("\0"), s)))


def labellers(m: Column) -> list[Column]:
    """The quality rules' votes, but for length: a short text may be good, so shortness alone abstains."""
    return [F.when(m["n_words"] >= 60, 1).otherwise(0), *votes(m)[1:]]


def fit_labellers(docs: DataFrame, text: str = "text") -> tuple[VoteModel, int]:
    """The vote model over all rows, and how many rows there are."""
    def signs(m: Column) -> Column:
        return F.concat(*[F.when(v > 0, "+").when(v < 0, "-").otherwise("0") for v in labellers(m)])

    counts = {r["v"]: r["count"] for r in docs.select(let(measures(F.col(text)), signs).alias("v")).groupBy("v").count().collect()}  # at most 3 ** RULES rows
    return fit_votes(counts, RULES), sum(counts.values())


def fit_scorer(docs: DataFrame, key: str = "doc_id", text: str = "text", max_train: int = MAX_TRAIN) -> PipelineModel | None:
    """The hashed linear scorer; None if there are no documents."""
    model, n = fit_labellers(docs, text)
    if not n:
        return None
    share = min(1.0, max_train / n)
    draw = F.xxhash64(F.col(key), F.col(text), F.monotonically_increasing_id())  # equal rows are drawn apart
    sample = docs.where(draw <= F.lit(min(int(share * 2**64), 2**64 - 1) - 2**63))
    odds = let(measures(F.col(text)), lambda m: model.log_odds_column(labellers(m)))
    sample = sample.select((1 / (1 + F.exp(-odds))).alias("p"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    hashed = HashingTF(numFeatures=FEATURES, inputCol="tokens", outputCol="counts")
    scaled = Normalizer(inputCol="counts", outputCol="features")
    ready = materialize(scaled.transform(hashed.transform(sample)).select("p", "features"), "train")
    both = ready.select("features", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")))).alias("y"))
    both = both.select("features", "y.label", "y.weight").where("weight > 0.001")
    linear = LogisticRegression(weightCol="weight", regParam=0.001, maxIter=25).fit(both)
    return PipelineModel([hashed, scaled, linear])


def score_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: float = 0.5, max_train: int = MAX_TRAIN) -> DataFrame:
    """Per row: key, score (probability of good quality) and kept (score at or above ``limit``)."""
    model = fit_scorer(docs, key, text, max_train)
    rows = docs.select(F.col(key).alias("key"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    if model is None:
        return rows.select(F.col("key").alias(key), F.lit(1.0).alias("score"), F.lit(True).alias("kept"))
    scored = model.transform(rows).select("key", vector_to_array("probability")[1].alias("score"))
    return scored.select(F.col("key").alias(key), "score", (F.col("score") >= limit).alias("kept"))
