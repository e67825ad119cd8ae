"""Word and character error rates of predictions against references."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribelake.functions import distance, text
from scribelake.functions.roles import canonical
from scribelake.operators.ids import IncompleteError, audit_of, counts_by_id, pairing_audit, repeated
from scribelake.operators.ordering import By, first_rows
from scribelake.operators.selection import top_per_group
from scribelake.session import dealt, materialise

EDIT_COLUMNS = ("char_edits", "char_total", "word_edits", "word_total")


def check_pairing(reference: DataFrame, prediction: DataFrame) -> None:
    """Raise unless every reference id is unique and has exactly one prediction.

    Reads the id columns only.  Extra predictions are allowed.
    """
    _need_pairs(pairing_audit(reference, prediction))


def _need_pairs(audited: DataFrame) -> None:
    audit = audited.first()
    problems = {
        name: audit[name]
        for name in ("missing", "repeated_reference", "repeated_other", "null_reference")
        if audit[name]
    }
    if problems:
        raise IncompleteError(f"predictions do not match references one to one: {problems}")


def pair(
    reference: DataFrame,
    prediction: DataFrame,
    *,
    keep: Sequence[str] = (),
    checked: bool = True,
) -> DataFrame:
    """``id, reference_text, prediction_text`` (plus kept reference columns).

    With ``checked`` every reference id must be unique and have exactly one prediction, as
    :func:`check_pairing` says.  Both tables are then read once: their rows meet in one
    aggregation by id, in which a repeated id costs one row per task, and its result is stored
    before it is audited and read again, dealt evenly for what is counted on it.
    """
    left = canonical(reference, text="reference_text", keep=keep)
    right = canonical(prediction, text="prediction_text")
    if not checked:
        return left.join(right, "id", "inner")
    sides = {"a": (left, "_left"), "b": (right, "_right")}
    stacked = [
        side.select(
            "id",
            *(F.lit(int(other == name)).cast("long").alias(other) for other in sides),
            F.struct(*(F.col(f"`{c}`") for c in side.columns if c != "id")).alias(row),
        )
        for name, (side, row) in sides.items()
    ]
    met = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), stacked).groupBy("id").agg(
        *(F.sum(name).alias(name) for name in sides),
        *(F.first(row, ignorenulls=True).alias(row) for _, row in sides.values()),
    )
    met = materialise(met, "pairs")
    _need_pairs(audit_of(met.select("id", *sides)))
    # beyond these there are only predictions that nothing asked for
    return dealt(met.where("a = 1 AND b = 1").select("id", "_left.*", "_right.*"), "id")


def _cleaned(pairs: DataFrame, normalised: bool, forms: str) -> DataFrame:
    """Add the texts as they are compared, ``_r`` and ``_p``."""

    def clean(name: str) -> Column:
        if not normalised:
            return F.coalesce(F.col(name), F.lit(""))
        return text.normalise(name, engine=forms)

    texts = {"_r": clean("reference_text"), "_p": clean("prediction_text")}
    if not normalised or forms != "arrow":
        return pairs.withColumns(texts)
    # as columns of a generator, the texts are made once, not anew wherever they are used
    return pairs.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in texts.items())))))


def _counted(prepared: DataFrame, normalised: bool, forms: str) -> DataFrame:
    """Add the counts of :func:`with_edits` to :func:`_cleaned` pairs."""
    if not normalised and forms == "arrow":
        edits, total = distance.raw_word_edits("_r", "_p")
    else:
        ref_words, hyp_words = F.col("_r"), F.col("_p")
        if not normalised:
            ref_words, hyp_words = text.raw_words_text("_r"), text.raw_words_text("_p")
            prepared = prepared.withColumns({"_rw": ref_words, "_pw": hyp_words})
            ref_words, hyp_words = F.col("_rw"), F.col("_pw")
        edits, total = distance.word_edits(ref_words, hyp_words, forms), text.word_count(ref_words)
    return prepared.withColumns(
        {
            "char_edits": distance.char_edits("_r", "_p", forms),
            "char_total": F.char_length("_r"),
            "word_edits": edits,
            "word_total": total,
        }
    ).drop("_r", "_p", "_rw", "_pw")


def with_edits(pairs: DataFrame, *, normalised: bool = True, forms: str = "arrow") -> DataFrame:
    """Add edit counts and reference lengths, by character and by word.

    Each text is normalised once, into a column.  ``forms`` says who brings texts to NFKC
    (:func:`text.unicode_form`) and counts edits (:mod:`scribelake.functions.distance`): with
    ``jvm`` no row goes to Python.
    """
    return _counted(_cleaned(pairs, normalised, forms), normalised, forms)


def with_length_bucket(scored: DataFrame) -> DataFrame:
    """Add the bucket of the reference length; needs :func:`with_edits` first."""
    return scored.withColumn("length_bucket", text.length_bucket("word_total"))


def totals(scored: DataFrame, *by: str) -> DataFrame:
    """Additive sums per key; everything below is computed from these."""
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(F.col(name).cast("long")).alias(name) for name in EDIT_COLUMNS],
    )


def combine(wer: Column, cer: Column) -> tuple[Column, Column]:
    """``error`` and ``score`` of a pair of rates."""
    # Equal weights of the two rates.
    error = F.lit(0.5) * wer + F.lit(0.5) * cer
    return error, F.lit(1.0) - error


def rates(sums: DataFrame, *keys: str) -> DataFrame:
    """Micro-averaged rates from :func:`totals`; an empty reference counts as length 1."""

    def rate(kind: str) -> Column:
        edits = F.coalesce(F.col(f"{kind}_edits"), F.lit(0)).cast("double")
        return edits / F.greatest(F.coalesce(F.col(f"{kind}_total"), F.lit(0)), F.lit(1)).cast(
            "double"
        )

    named = sums.select(*keys, "rows", rate("word").alias("wer"), rate("char").alias("cer"))
    error, score = combine(F.col("wer"), F.col("cer"))
    return named.withColumns({"error": error, "score": score})


def metrics(scored: DataFrame) -> DataFrame:
    """One row ``rows, wer, cer, error, score`` over all pairs."""
    return rates(totals(scored))


def metrics_by(scored: DataFrame, *keys: str) -> DataFrame:
    """Metrics per key; rows whose key is NULL are left out; sorted by key."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return rates(totals(scored.where(known), *keys), *keys).orderBy(*keys)


def sliced_metrics(scored: DataFrame, *slices: str) -> DataFrame:
    """Overall metrics and those of each slice column, in one pass over the pairs.

    Edits are summed once per combination of slice values; that small table is then
    regrouped, so the pairs are neither scored nor expanded once per slice.  Output:
    ``slice, value, rows, wer, cer, error, score``; the overall row has slice
    ``overall`` and an empty value.
    """
    cells = totals(scored, *slices)
    entries = F.array(
        F.struct(F.lit("overall").alias("slice"), F.lit("").alias("value")),
        *[
            F.struct(F.lit(name).alias("slice"), F.col(name).cast("string").alias("value"))
            for name in slices
        ],
    )
    long = cells.select(F.explode(entries).alias("s"), "rows", *EDIT_COLUMNS).select("s.*", "*")
    sums = (
        long.where(F.col("value").isNotNull())
        .groupBy("slice", "value")
        .agg(F.sum("rows").alias("rows"), *[F.sum(n).alias(n) for n in EDIT_COLUMNS])
    )
    return rates(sums, "slice", "value").orderBy("slice", "value")


def with_row_rates(scored: DataFrame) -> DataFrame:
    """Rates of each single pair."""

    def rate(kind: str) -> Column:
        return F.col(f"{kind}_edits").cast("double") / F.greatest(
            F.col(f"{kind}_total"), F.lit(1)
        ).cast("double")

    named = scored.withColumns({"wer": rate("word"), "cer": rate("char")})
    return named.withColumn("error", combine(F.col("wer"), F.col("cer"))[0])


def worst_rows(scored: DataFrame, n: int = 100, by: str | None = None) -> DataFrame:
    """The ``n`` pairs with the highest error, for any ``n``; ties go to the smaller id.

    With ``by``, the ``n`` worst of each value of that column, with their rank.  Without, the
    pairs are scored once, into a table, and come in no order.
    """
    rated = with_row_rates(scored)
    if by is None:
        return first_rows(materialise(rated, "rated"), n, By("error", descending=True), "id")
    known = rated.where(F.col(by).isNotNull())
    return top_per_group(known, [by], [F.desc("error"), F.asc("id")], n, spread="id")


def disagreements(first: DataFrame, second: DataFrame, *, forms: str = "arrow") -> DataFrame:
    """Ids on which two prediction tables differ, with how far apart they are.

    An id that only one table has counts as the empty text in the other; ``in_both`` tells
    it apart from an empty prediction, and it is reported whatever its text.  Repeated or
    unknown ids are refused on either side, by one shuffle of ids.
    """
    left = canonical(first, text="reference_text")
    right = canonical(second, text="prediction_text")
    null = F.col("id").isNull()
    audit = counts_by_id({"a": left, "b": right}).agg(
        *(repeated(c).alias(f"repeated_{n}") for c, n in (("a", "first"), ("b", "second"))),
        *(F.coalesce(F.sum(F.when(null, F.col(c))), F.lit(0)).alias(f"null_{n}")
          for c, n in (("a", "first"), ("b", "second"))),
    ).first()
    if problems := {name: n for name, n in audit.asDict().items() if n}:
        raise IncompleteError(f"ids do not tell predictions apart: {problems}")
    joined = left.withColumn("a", F.lit(True)).join(right.withColumn("b", F.lit(True)), "id", "full")
    in_both = (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("in_both")
    told = joined.select("id", "reference_text", "prediction_text", in_both)
    # texts are told apart before edits are counted, as a condition on the counts would move
    # below them and have all edits counted twice
    cleaned = _cleaned(told, True, forms).where((F.col("_r") != F.col("_p")) | ~F.col("in_both"))
    scored = _counted(cleaned, True, forms)
    return with_row_rates(scored).select(
        "id",
        "in_both",
        F.col("reference_text").alias("first_text"),
        F.col("prediction_text").alias("second_text"),
        "word_edits",
        "char_edits",
        "error",
    )


def metrics_with_length(scored: DataFrame) -> DataFrame:
    """Overall metrics plus the mean length of the raw predictions in characters."""
    sums = scored.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.sum(F.col(name).cast("long")).alias(name) for name in EDIT_COLUMNS],
        F.avg(F.char_length(F.coalesce("prediction_text", F.lit("")))).alias("mean_pred_len"),
    )
    return rates(sums, "mean_pred_len").select(
        "rows", "wer", "cer", "error", "score", "mean_pred_len"
    )
