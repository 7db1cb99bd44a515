"""Answer quality: verdict tables to per-sample scores to means.

Who makes the verdicts is open: any table of 0/1 verdicts will do. :func:`statement_verdicts`
and :func:`context_verdicts` are a deterministic judge by token overlap, and the scores they
lead to are not those of a model judge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.functions.binding import let
from groundwell.functions.text import tokens
from groundwell.functions.vectors import cosine
from groundwell.operators.running import running_sum

# Metric names.
METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")

NAN = float("nan")


def select_metrics(names: Sequence[str] | None = None) -> list[str]:
    """Known metrics among ``names``; all of them for none. Raises when none is known."""
    known = [name for name in (names or METRICS) if name in METRICS]
    if not known:
        raise ValueError(f"none of {list(names or ())} is a metric; there are {list(METRICS)}")
    return known


def complete_samples(samples: DataFrame) -> DataFrame:
    """Samples with defaults: no answer is "", no contexts are an empty list, and a missing
    ground truth stays null. A table cannot tell a missing field from a null one."""
    present = set(samples.columns)

    def given(name: str, kind: str) -> Column:
        return F.col(name) if name in present else F.lit(None).cast(kind)

    own = {"question", "answer", "contexts", "ground_truth"}
    return samples.select(
        *[c for c in samples.columns if c not in own],
        "question",
        F.coalesce(given("answer", "string"), F.lit("")).alias("answer"),
        F.coalesce(given("contexts", "array<string>"), F.array().cast("array<string>")).alias(
            "contexts"
        ),
        given("ground_truth", "string").alias("ground_truth"),
    )


def collect_answers(
    questions: DataFrame, answers: DataFrame, key: str = "sample_id"
) -> DataFrame:
    """Samples: every question with its answer, contexts and optional ground truth.

    Joined by a key given when the questions are read, as question texts may repeat.
    """
    joined = questions.select(
        key,
        "question",
        *(["ground_truth"] if "ground_truth" in questions.columns else []),
    ).join(answers.select(key, "answer", "contexts"), key, "left")
    return complete_samples(joined)


def share_scores(verdicts: DataFrame, metric: str, key: str = "sample_id") -> DataFrame:
    """Per sample the share of statements with verdict 1 (faithfulness, context recall)."""
    return (
        verdicts.groupBy(key)
        .agg((F.sum("verdict") / F.count("verdict")).alias("value"))
        .select(key, F.lit(metric).alias("metric"), F.coalesce("value", F.lit(NAN)).alias("value"))
    )


def precision_scores(
    verdicts: DataFrame, key: str = "sample_id", metric: str = "context_precision"
) -> DataFrame:
    """Per sample the mean of precision@rank over its relevant ranks, 0 when none is relevant.

    ``rank`` counts from 1 without gaps. Verdicts are summed in blocks of ranks, so a sample
    with very many contexts does not fill one task.
    """
    summed = running_sum(verdicts.select(key, "rank", "verdict"), [key], "rank", "verdict", "seen")
    gain = F.col("verdict") * F.col("seen") / F.col("rank")
    return summed.groupBy(key).agg(
        F.sum(gain).alias("gain"), F.sum("verdict").alias("relevant")
    ).select(
        key,
        F.lit(metric).alias("metric"),
        F.when(F.col("relevant") > 0, F.col("gain") / F.col("relevant"))
        .otherwise(F.lit(0.0))
        .alias("value"),
    )


def relevancy_scores(
    questions: DataFrame, generated: DataFrame, key: str = "sample_id",
    metric: str = "answer_relevancy",
) -> DataFrame:
    """Per sample the mean cosine of its question and questions generated from its answer.

    Both sides have ``vector``; ``questions`` has one row per sample.
    """
    pairs = generated.select(key, F.col("vector").alias("generated")).join(
        questions.select(key, F.col("vector").alias("asked")), key
    )
    return pairs.groupBy(key).agg(
        F.avg(cosine(F.col("asked"), F.col("generated"))).alias("value")
    ).select(key, F.lit(metric).alias("metric"), "value")


def metric_means(scores: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """``metric, value``: the mean of each metric over its values that are numbers.

    Takes ``metric, value`` rows; one aggregate, so a frequent metric is no hot key. A metric
    without any number has NaN.
    """
    names = select_metrics(metrics)

    def mean(name: str) -> Column:
        mine = (F.col("metric") == name) & ~F.isnan("value")
        return F.coalesce(F.avg(F.when(mine, F.col("value"))), F.lit(NAN)).alias(name)

    wide = scores.where(F.col("metric").isin(names)).agg(*[mean(n) for n in names])
    return wide.unpivot([], names, "metric", "value")


def metric_report(means: DataFrame) -> DataFrame:
    """Add ``label`` (4 decimals, ``N/A`` for NaN) and ``logged`` (whether a run logs it)."""
    number = ~F.isnan("value")
    return means.select(
        "metric",
        "value",
        F.when(number, _four_decimals(F.col("value"))).otherwise("N/A").alias("label"),
        number.alias("logged"),
    )


def _four_decimals(value: Column) -> Column:
    """``value`` with 4 decimals, rounded as the binary number that it is and not as the
    shortest decimal that stands for it: 0.00015 is a little less than that.

    The value is split in two halves whose multiples are exact, so that the side of the
    midpoint between two labels on which it lies can be told; a true tie goes to the even one.
    """
    size = F.abs(value)
    below = F.floor(size * 10_000).cast("double")
    big = size * 134_217_729.0
    high = big - (big - size)
    over = (high * 20_000 - (2 * below + 1)) + (size - high) * 20_000
    up = (over > 0) | ((over == 0) & (below % 2 == 1))
    steps = (below + up.cast("int")).cast("long")
    label = F.format_string(
        "%s%d.%04d",
        F.when(value < 0, "-").otherwise(""),
        F.floor(steps / 10_000),
        steps % 10_000,
    )
    return F.when(size < 1e9, label).otherwise(F.format_string("%.4f", value))


# Fixed values of the token-overlap judge.
STATEMENT_PATTERN = r"[^.!?\n]+"
PUNCTUATION = ".,;:!?"


def _words(text: Column) -> Column:
    """Distinct lower-case tokens without punctuation."""
    bare = F.translate(F.lower(text), PUNCTUATION, " " * len(PUNCTUATION))
    return F.array_distinct(tokens(bare))


def statement_judgement(text: str, support: float = 0.5) -> Column:
    """Verdicts on the statements of a column: 1 where ``support`` of a statement's distinct
    words are in ``contexts``. Statements without words are left out.

    Stays within the row: a sample's contexts are bounded by its top-k.
    """
    statements = F.regexp_extract_all(
        F.coalesce(text, F.lit("")), F.lit(STATEMENT_PATTERN), F.lit(0)
    )
    said = F.filter(F.transform(statements, _words), lambda words: F.size(words) > 0)
    return let(
        F.flatten(F.transform("contexts", _words)),
        lambda known: F.transform(said, lambda words: _holds(words, known, support)),
    )


def statement_verdicts(
    samples: DataFrame, text: str, key: str = "sample_id", support: float = 0.5
) -> DataFrame:
    """:func:`statement_judgement` as rows ``key, statement_no, verdict``."""
    return samples.select(
        key, F.posexplode(statement_judgement(text, support)).alias("statement_no", "verdict")
    )


def context_judgement(reference: str = "ground_truth", support: float = 0.1) -> Column:
    """Verdicts on ``contexts`` in rank order: 1 for those that hold ``support`` of the
    reference's words."""
    return let(
        _words(F.coalesce(reference, F.lit(""))),
        lambda wanted: F.transform(
            "contexts",
            lambda context: F.when(F.size(wanted) == 0, 0).otherwise(
                _holds(wanted, _words(context), support)
            ),
        ),
    )


def context_verdicts(
    samples: DataFrame, reference: str = "ground_truth", key: str = "sample_id",
    support: float = 0.1,
) -> DataFrame:
    """:func:`context_judgement` as rows ``key, rank, verdict``."""
    verdicts = context_judgement(reference, support)
    return samples.select(key, F.posexplode(verdicts).alias("place", "verdict")).select(
        key, (F.col("place") + 1).alias("rank"), "verdict"
    )


def share_of(verdicts: Column) -> Column:
    """:func:`share_scores` of one array of verdicts; null for an empty one."""
    total = F.aggregate(verdicts, F.lit(0), lambda a, v: a + v)
    return F.when(F.size(verdicts) > 0, total / F.size(verdicts))


def precision_of(verdicts: Column) -> Column:
    """:func:`precision_scores` of one array of verdicts; null for an empty one."""
    start = F.struct(
        F.lit(0).alias("rank"), F.lit(0).alias("seen"), F.lit(0.0).alias("gain")
    )

    def step(now: Column, verdict: Column) -> Column:
        seen = now["seen"] + verdict
        rank = now["rank"] + 1
        return F.struct(
            rank.alias("rank"),
            seen.alias("seen"),
            (now["gain"] + verdict * seen / rank).alias("gain"),
        )

    score = F.aggregate(
        verdicts, start, step,
        lambda end: F.when(end["seen"] > 0, end["gain"] / end["seen"]).otherwise(F.lit(0.0)),
    )
    return F.when(F.size(verdicts) > 0, score)


def _holds(words: Column, known: Column, support: float) -> Column:
    return (F.size(F.array_intersect(words, known)) >= support * F.size(words)).cast("int")
