"""Mixing sources to target weights: raked token weights and calibrated sampling.

DataFrame operations only, from the texts to the sampled documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.llm.common import WORD, free_name, staged

#: Marginals in the order in which they are fitted.
MARGINALS = ("source", "language", "topic")
#: Topics of the registered query, tested in order against the whole text.
TOPICS = (("licence", r"(?i)\b(licen[cs]ed?|copyright)\b"), ("contact", r"[@]|\d{3}[ -]\d{3,}"),
          ("table", r" \| "), ("lines", r"\n"))
OTHER_TOPIC = "other"


#: Cells that are raked in one partition, with the same steps but no exchange.
LOCAL_CELLS = 50_000
#: Raking rounds in one plan; their result is written before the next ones.
ROUNDS_A_STAGE = 4


@dataclass(frozen=True)
class Plan:
    """How to mix. ``flatten`` makes the default targets: a category's share of the tokens to that
    power (1 keeps the mix, 0 makes all equal), scaled to sum to one. ``keep`` is the share of all
    tokens to expect in the sample; ``rounds`` the number of raking rounds. ``within`` rakes what a
    cell can give, so that no cell is asked for more than its tokens; without it the raking knows
    no such bound and what it asks too much of some cells is spread over all others."""

    flatten: float = 0.7
    keep: float = 0.8
    rounds: int = 12
    seed: str = "mix"
    within: bool = True


def token_count(text: Column) -> Column:
    """Words of the whole text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: Column, topics=TOPICS) -> Column:
    """The first topic whose pattern the text holds."""
    found = F.lit(OTHER_TOPIC)
    for name, pattern in reversed(topics):
        found = F.when(F.rlike(text, F.lit(pattern)), F.lit(name)).otherwise(found)
    return found


def category(column: Column) -> Column:
    """A category's name; null is a category too, apart from every string."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def flattened_targets(cells: DataFrame, by: str, power: float) -> DataFrame:
    """(by, target): tokens of a category to ``power``; only their proportions matter."""
    return cells.groupBy(by).agg(F.sum("tokens").alias("sum")).select(
        by, F.pow(F.col("sum").cast("double"), F.lit(float(power))).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int,
         keep: float | None = None) -> DataFrame:
    """``cells`` (a column for each marginal and tokens > 0) with weight, fitted to the targets.

    Iterative proportional fitting: in turn, for each marginal, the weights of a category are
    scaled so that they add up to its target, round after round. A target for a category without
    tokens cannot be met and is left out; a category without a target gets weight 0; the rest of
    each marginal's targets is scaled to one; those named twice add up, and a null or negative one
    is 0. Weights begin in proportion to the tokens.

    With ``keep`` targets are tokens, ``keep`` of all, and a cell gives at most its own: a
    category scarcer than its target is wanted whole, what it lacks goes to the marginal's others
    in proportion to their targets, and a category's scale is that at which its cells, each cut at
    its tokens, add up to what is wanted. A weight above the tokens then means the whole cell.
    """
    fitted = cells.withColumn("weight", F.col("tokens").cast("double"))
    targets = {by: target.groupBy(by).agg(F.sum(F.greatest(
        F.col("target").cast("double"), F.lit(0.0))).alias("target"))
        for by, target in targets.items()}
    for by, target in targets.items():
        fitted = fitted.join(target.withColumnRenamed("target", f"target_{by}"), by, "left")
    fitted = fitted.fillna(0.0, [f"target_{by}" for by in targets])
    for by, target in targets.items():
        total = target.join(cells.select(by).distinct(), by).agg(
            F.sum("target")).first()[0] or 1.0
        fitted = fitted.withColumn(f"target_{by}", F.col(f"target_{by}") / total)
    fitted = staged(fitted, "mix-targets")[0]
    if keep is not None:
        for by in targets:
            given = calibrated(fitted.groupBy(by).agg(
                F.sum("tokens").alias("tokens"), F.max(f"target_{by}").alias("weight")), keep)
            fitted = fitted.drop(f"target_{by}").join(given.select(
                by, (F.col("probability") * F.col("tokens")).alias(f"target_{by}")), by)
        fitted = staged(fitted, "mix-targets")[0]
    fitted = _gathered(fitted)
    for at in range(rounds):
        for by in targets:
            if keep is not None:
                fitted = _filled(fitted, by)
                continue
            now = F.sum("weight").over(Window.partitionBy(by))
            fitted = fitted.withColumn("weight", F.when(
                now > 0, F.col("weight") * F.col(f"target_{by}") / now).otherwise(0.0))
        if at % ROUNDS_A_STAGE == ROUNDS_A_STAGE - 1:
            fitted = _gathered(staged(fitted, "mix-weights")[0])
    return fitted.drop(*[f"target_{by}" for by in targets])


def _filled(cells: DataFrame, by: str) -> DataFrame:
    """Weights of each category scaled so that, each cut at its cell's tokens, they add up to its
    target, or so that none is below its tokens.

    The sum rises with the scale along the least of its lines, one for each number of full cells
    (taken in the order in which they fill up), so the scale is the largest that a line gives.
    """
    fills = F.when(F.col("weight") > 0, F.col("tokens") / F.col("weight"))
    first = Window.partitionBy(by).orderBy(fills.asc_nulls_last(), *MARGINALS)
    last = Window.partitionBy(by).orderBy(
        fills.desc_nulls_first(), *[F.col(m).desc() for m in MARGINALS])
    full = F.coalesce(F.sum(F.col("tokens").cast("double")).over(
        first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(last.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lines = cells.withColumn("full", full).withColumn("rest", rest).withColumn(
        "scale", F.when(F.col("rest") > 0, (F.col(f"target_{by}") - F.col("full")) / F.col("rest")))
    return lines.withColumn("weight", F.col("weight") * F.coalesce(
        F.max("scale").over(Window.partitionBy(by)), F.lit(0.0))).drop("full", "rest", "scale")


def _gathered(cells: DataFrame) -> DataFrame:
    return cells.coalesce(1) if cells.count() <= LOCAL_CELLS else cells


def calibrated(cells: DataFrame, keep: float) -> DataFrame:
    """``cells`` with probability: min(1, c * weight / tokens), with c such that the expected
    tokens are ``keep`` of all (or all with a weight, if these are fewer).

    c rises step by step: what cells at probability 1 cannot give is spread over the others. Each
    step is one aggregation to two numbers and caps at least one more cell, or ends the search.
    """
    cells, _ = staged(cells.withColumn("ratio", F.col("weight") / F.col("tokens")), "mix-cells")
    wanted = keep * (cells.agg(F.sum("tokens")).first()[0] or 0)
    factor = 0.0
    while True:
        full = factor * F.col("ratio") >= 1.0
        capped, free = cells.agg(
            F.sum(F.when(full, F.col("tokens").cast("double")).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        new = (wanted - capped) / free if capped is not None and free > 0 else factor
        if not new > factor * (1 + 1e-12):
            break
        factor = new
    return cells.withColumn("probability", F.least(F.lit(1.0), F.lit(factor) * F.col("ratio")))


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone; null ids share one."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(
        1 << 48)


def _told(docs: DataFrame, topic: Column | None, text: str, source: str,
          lang: str) -> tuple[DataFrame, str]:
    """``docs`` with a struct of each row's categories and tokens, and its name."""
    cell = free_name(docs, "_cell")
    topic = topic_of(F.col(f"`{text}`")) if topic is None else topic
    return docs.withColumn(cell, F.struct(
        category(F.col(f"`{source}`")).alias("source"),
        category(F.col(f"`{lang}`")).alias("language"),
        F.coalesce(topic, F.lit(OTHER_TOPIC)).alias("topic"),
        token_count(F.col(f"`{text}`")).alias("n_tokens"))), cell


def _rated(row: DataFrame, cell: str, plan: Plan, targets: dict[str, DataFrame] | None
           ) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Cells with tokens and probability, and the targets of all marginals."""
    cells, _ = staged(row.select(f"{cell}.*").groupBy(*MARGINALS).agg(
        F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "mix-tokens")
    wanted = {m: (targets or {}).get(m) for m in MARGINALS}
    wanted = {m: flattened_targets(cells, m, plan.flatten) if t is None else t
              for m, t in wanted.items()}
    raked = rake(cells, wanted, plan.rounds, plan.keep if plan.within else None)
    return calibrated(raked, plan.keep), wanted


def shares(docs: DataFrame, plan: Plan = Plan(), targets: dict[str, DataFrame] | None = None,
           topic: Column | None = None, text: str = "text", source: str = "source",
           lang: str = "lang") -> DataFrame:
    """(marginal, category, table, target, sample): a category's share of the table's tokens, of
    the targets that :func:`sampled` rakes to, and of the tokens expected in its sample.

    Where target and sample differ, ``plan.keep`` asks for more tokens than the scarce categories
    can give at the target mix.
    """
    rated, wanted = _rated(*_told(docs, topic, text, source, lang), plan, targets)
    rated, _ = staged(rated, "mix-rated")
    whole = Window.partitionBy("marginal")
    rows = None
    for by in MARGINALS:
        target = wanted[by].groupBy(by).agg(F.sum(F.greatest(
            F.col("target").cast("double"), F.lit(0.0))).alias("target"))
        one = rated.groupBy(by).agg(
            F.sum(F.col("tokens").cast("double")).alias("table"),
            F.sum(F.col("tokens") * F.col("probability")).alias("sample")).join(
            target, by, "left").select(
            F.lit(by).alias("marginal"), F.col(by).alias("category"), "table",
            F.coalesce("target", F.lit(0.0)).alias("target"), "sample")
        rows = one if rows is None else rows.unionByName(one)
    return rows.select("marginal", "category", *[
        F.try_divide(F.col(c), F.sum(c).over(whole)).alias(c)
        for c in ("table", "target", "sample")])


def sampled(docs: DataFrame, plan: Plan = Plan(), targets: dict[str, DataFrame] | None = None,
            topic: Column | None = None, doc_id: str = "doc_id", text: str = "text",
            source: str = "source", lang: str = "lang") -> tuple[DataFrame, str]:
    """``docs`` with a struct column, and its name: source, language, topic (category names),
    n_tokens, probability, draw and sampled (draw < probability).

    ``targets`` gives for each of MARGINALS a DataFrame (marginal, target) of category names (see
    :func:`category`; topics as they are); those missing are flattened by ``plan``. ``topic`` is
    an expression on ``docs``, by default the first of TOPICS in the text.

    A text without words has no tokens and is never sampled. Null source and language are
    categories; null ids share one draw, and so do repeated ids. An empty table gives an empty
    one. Documents are sampled one by one, so the token total only nears its expectation. Targets
    that ``plan.keep`` leaves no room for are met as far as the tokens go; :func:`shares` says how
    far.

    One pass counts the tokens of every cell (source, language, topic), pre-aggregated; then only
    cells are raked, and joined to the documents, which are not shuffled while the cells are few.
    """
    row, cell = _told(docs, topic, text, source, lang)
    rates, _ = staged(_rated(row, cell, plan, targets)[0].select(
        F.struct(*MARGINALS).alias("at"), "probability"), "mix-rates")
    if rates.count() <= LOCAL_CELLS:
        rates = F.broadcast(rates)
    key = F.struct(*[F.col(f"{cell}.{m}") for m in MARGINALS])
    joined = row.join(rates, key == rates["at"], "left")
    chance = F.coalesce(rates["probability"], F.lit(0.0))
    lot = draw(F.col(f"`{doc_id}`"), plan.seed)
    counted = F.col(f"{cell}.n_tokens")
    return joined.select(*[docs[f"`{c}`"] for c in docs.columns], F.struct(
        f"{cell}.*", F.when(counted > 0, chance).otherwise(0.0).alias("probability"),
        lot.alias("draw"), ((counted > 0) & (lot < chance)).alias("sampled")).alias(cell)), cell


def sample_documents(docs: DataFrame, plan: Plan = Plan(), **names) -> DataFrame:
    """The sampled rows of ``docs``, columns unchanged; see :func:`sampled`."""
    marked, cell = sampled(docs, plan, **names)
    return marked.where(F.col(f"{cell}.sampled")).drop(cell)
