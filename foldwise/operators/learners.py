"""Fitting MLlib learners on raw tables, and scoring with the fitted result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions.nulls import fill_aggregates, null_fill
from foldwise.functions.scores import binary_label, positive_class, sigmoid
from foldwise.operators.categories import (
    category_dictionary,
    index_categories,
    index_stages,
    one_hot_encoder,
    vocabulary,
    with_sizes,
)
from foldwise.operators.grouping import apply_groups, target_groups
from foldwise.operators.order_stats import ordered_target_stats
from foldwise.operators.tables import refuse_columns
from foldwise.operators.target_stats import (
    apply_target_stat,
    ordered_target_stat,
    target_stat_table,
)
from foldwise.workspace import materialize, scratch_path, shared_dir

SEED = 96

# MLlib's own default.
MAX_BINS = 32

# The label as the learners read it, and what MLlib adds to a table.
LABEL = "_label"
RESERVED = (LABEL, "features", "rawPrediction", "probability", "prediction")


@dataclass(frozen=True)
class Arm:
    """One run: a learner, its parameters and the columns it sees.

    How a category is encoded is declared and the same in every fold and fit. ``categorical`` are
    nominal for trees, which need a bin for each category (one more than there are), and one-hot
    for a logistic learner, however many there are. ``target_stat`` get an ordered target
    statistic. ``derived`` maps the name of an added feature to its expression. The id is a feature
    only if it is listed in ``numeric``. ``stages`` are numbers of boosting rounds after which one
    fit is scored, increasing; its last round is the last of them. ``grouped`` categories of trees,
    however many values they have, become at most a group per bin in the order of their labels'
    means. ``orders`` is how many seeded orders a target statistic is averaged over.
    """

    run: str
    learner: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    target_stat: tuple[str, ...] = ()
    derived: Mapping[str, Column] = field(default_factory=dict, compare=False)
    params: Mapping[str, object] = field(default_factory=dict, compare=False)
    stages: tuple[int, ...] = ()
    grouped: tuple[str, ...] = ()
    orders: int = 1

    @property
    def runs(self) -> tuple[str, ...]:
        """The names its scores go by: one, or one per stage."""
        return tuple(f"{self.run}, {rounds} rounds" for rounds in self.stages) or (self.run,)

    def without(self, column: str, run: str | None = None) -> Arm:
        """The same arm with one column less, for training and scoring alike."""
        return replace(
            self,
            run=run or f"{self.run} - {column}",
            numeric=tuple(c for c in self.numeric if c != column),
            categorical=tuple(c for c in self.categorical if c != column),
            target_stat=tuple(c for c in self.target_stat if c != column),
            grouped=tuple(c for c in self.grouped if c != column),
            derived={n: e for n, e in self.derived.items() if n != column},
        )

    def adding(self, name: str, expression: Column, run: str | None = None) -> Arm:
        """The same arm with one more derived feature."""
        return replace(
            self, run=run or f"{self.run} + {name}", derived={**self.derived, name: expression}
        )

    def with_params(self, run: str, **params) -> Arm:
        """The same arm under other learner parameters."""
        return replace(self, run=run, params={**self.params, **params})

    def staged(self, rounds: Sequence[int]) -> Arm:
        """The same trees scored after each number of rounds, all from one fit of the most."""
        stages = tuple(sorted(set(rounds)))
        if self.learner != "gbt" or not stages or stages[0] < 1:
            raise ValueError("stages are positive numbers of boosting rounds")
        return replace(self, stages=stages, params={**self.params, "maxIter": stages[-1]})


@dataclass(frozen=True)
class Encodings:
    """What scored rows look their categories up in.

    ``stats`` are target-statistic tables; ``dictionaries`` are the one-hot dictionaries with their
    sizes; ``groups`` are the groups of categories. A category whose statistic is a column of every
    row already has no entry.
    """

    id_col: str
    stats: Mapping[str, DataFrame]
    dictionaries: Mapping[str, tuple[DataFrame, int]]
    groups: Mapping[str, DataFrame] = field(default_factory=dict)

    def add_to(self, df: DataFrame, categories: Sequence[str]) -> DataFrame:
        """``df`` with the encodings of those of ``categories`` that have a table."""
        rows = df
        for c in categories:
            if c in self.groups:
                rows = apply_groups(rows, self.groups[c], self.id_col, c, group_name(c), base=df)
            if c in self.stats:
                rows = apply_target_stat(
                    rows, self.stats[c], self.id_col, c, stat_name(c), base=df
                )
            if c in self.dictionaries:
                rows = self._indexed(rows, c)
        return rows

    def _indexed(self, rows: DataFrame, category: str) -> DataFrame:
        table, size = self.dictionaries[category]
        out = code_name(category)
        return index_categories(rows, self.id_col, category, table, out=out, size=size)


@dataclass(frozen=True)
class FittedArm:
    """A fitted arm: lookup tables for its categories, and a savable pipeline."""

    arm: Arm
    encodings: Encodings
    pipeline: PipelineModel
    inputs: tuple[str, ...]
    leaves: DataFrame | None = None

    @property
    def looked_up(self) -> tuple[str, ...]:
        one_hot = self.arm.categorical if self.arm.learner == "logistic" else ()
        return (*self.arm.target_stat, *one_hot, *self.arm.grouped)

    @property
    def stats(self) -> Mapping[str, DataFrame]:
        return {c: t for c, t in self.encodings.stats.items() if c in self.arm.target_stat}

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """``df`` with the probability of class 1 added; after the last round for a staged arm."""
        if self.arm.stages:
            return replace(self, arm=replace(self.arm, stages=())).score(df, out)
        return score_all([self], df, [out])

    def score_stages(self, df: DataFrame, outs: Sequence[str]) -> DataFrame:
        """``df`` with the probability of class 1 after each of the arm's stages."""
        return score_all([self], df, outs)

    def _scored(self, rows: DataFrame, outs: Sequence[str]) -> DataFrame:
        """Rows with their encodings, scored by the pipeline."""
        if not self.arm.stages:
            scored = self.pipeline.transform(rows)
            return scored.withColumn(outs[0], positive_class(F.col("probability")))
        return staged_scores(self.pipeline, self.leaves, rows, self.arm.stages, outs)

    def importance(self) -> DataFrame:
        """``(run, feature, importance, rank)``, summing to 100, largest first."""
        model = self.pipeline.stages[-1]
        if not hasattr(model, "featureImportances"):
            raise ValueError(f"a {self.arm.learner!r} learner has no feature importances")
        weights = model.featureImportances.toArray()
        named = sorted(zip(self.inputs, weights, strict=True), key=lambda x: (-x[1], x[0]))
        rows = [
            (self.arm.run, name, float(weight) * 100.0, rank)
            for rank, (name, weight) in enumerate(named, 1)
        ]
        schema = "run string, feature string, importance double, rank int"
        return SparkSession.active().createDataFrame(rows, schema).orderBy("rank")


def score_all(fitted: Sequence[FittedArm], df: DataFrame, outs: Sequence[str]) -> DataFrame:
    """``df`` with the scores of arms that share their encodings: one scan, each lookup once.

    ``outs`` has a name for every run of every arm, in order.
    """
    refuse_columns(df, (*RESERVED, *outs))
    categories = dict.fromkeys(c for one in fitted for c in one.looked_up)
    rows = fitted[0].encodings.add_to(df, list(categories))
    kept = rows.columns
    names = iter(outs)
    for one in fitted:
        own = [next(names) for _ in one.arm.runs]
        wide = rows.withColumns(dict(one.arm.derived)) if one.arm.derived else rows
        kept = [*kept, *own]
        rows = one._scored(wide, own).select(*[F.col(f"`{c}`") for c in kept])
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], *outs)


def weighted_leaves(model: GBTClassificationModel) -> DataFrame:
    """One row, ``leaves``: what each leaf of each tree adds to the margin, leaves from the left.

    Read from the saved model, whose nodes are rows in order of their place in the tree. The row is
    as large as the model: rounds times leaves.
    """
    path = scratch_path(SparkSession.active(), "model")
    model.write().save(path)
    spark = SparkSession.active()
    nodes = spark.read.parquet(f"{path}/data").where("nodeData.leftChild < 0")
    found = nodes.groupBy("treeID").agg(
        F.sort_array(F.collect_list(F.struct("nodeData.id", "nodeData.prediction"))).alias("leaf")
    )
    weights = F.array(*[F.lit(float(w)) for w in model.treeWeights])
    weight = F.element_at(weights, F.col("treeID") + 1)
    tree = F.struct("treeID", F.transform("leaf", lambda x: x.prediction * weight).alias("adds"))
    whole = found.agg(F.sort_array(F.collect_list(tree)).alias("trees"))
    return materialize(whole.select(F.transform("trees", lambda x: x.adds).alias("leaves")), "leaves")


def staged_scores(
    pipeline: PipelineModel, leaves: DataFrame, rows: DataFrame, stages: Sequence[int], outs: Sequence[str]
) -> DataFrame:
    """Probability of class 1 after each stage: every tree is walked once per row.

    The trees give the leaf a row falls in; the margins are running sums of what the leaves add.
    """
    *before, model = pipeline.stages
    walker = model.copy({})
    for unused in ("predictionCol", "rawPredictionCol", "probabilityCol"):
        walker.set(walker.getParam(unused), "")
    walker.setLeafCol("_leaf")
    walked = PipelineModel([*before, walker]).transform(rows)
    walked = walked.crossJoin(F.broadcast(leaves.select(F.col("leaves").alias("_leaves"))))  # one row
    adds = F.zip_with(vector_to_array("_leaf"), "_leaves", lambda leaf, own: F.get(own, leaf.cast("int")))
    walked = walked.withColumn("_adds", adds)
    cuts = [0, *stages]
    steps = [
        F.aggregate(F.slice("_adds", a + 1, b - a), F.lit(0.0), lambda total, x: total + x)
        for a, b in zip(cuts, cuts[1:], strict=False)
    ]
    walked = walked.withColumns({f"_step_{i}": step for i, step in enumerate(steps)})
    margin, scores = F.lit(0.0), {}
    for i, out in enumerate(outs):
        margin = margin + F.col(f"_step_{i}")
        scores[out] = sigmoid(margin * 2)
    return walked.withColumns(scores)


@dataclass(frozen=True)
class TrainingRows:
    """Training rows with their categories encoded, to be shared by all arms fitted on them.

    ``nominal`` are the categories trees see as such. ``n_rows`` and ``known`` (minimum and mean of
    every number, by column, and by run for derived ones) come from one pass for all arms.
    """

    rows: DataFrame
    encodings: Encodings
    nominal: Mapping[str, list[str]]
    n_rows: int
    known: Mapping[tuple[str | None, str], tuple[float | None, float | None]]


def prepare_training(
    train: DataFrame, arms: Sequence[Arm], id_col: str, label: str, encoded: Sequence[str] = ()
) -> TrainingRows:
    """Check the label, encode the arms' categories and learn their fill values.

    Statistics and one-hot indices are computed and written once however many arms use them.
    ``encoded`` names categories whose statistic ``train`` already has.
    """
    unknown = sorted({a.learner for a in arms} - {"logistic", "gbt"})
    if unknown:
        raise ValueError(f"unknown learner {unknown[0]!r}")
    if any(a.grouped and a.learner != "gbt" for a in arms):
        raise ValueError("grouped categories are for trees")
    refuse_columns(train, RESERVED)
    base = train.withColumn(LABEL, binary_label(F.col(f"`{label}`")))
    bins: dict[str, list[int]] = {}
    for arm in arms:
        if arm.learner == "gbt":
            for category in arm.categorical:
                bins.setdefault(category, []).append(_category_limit(arm))
    nominal = vocabulary(base, list(bins), [min(limits) for limits in bins.values()])

    rows, stats, dictionaries = base, {}, {}
    orders = shared_orders(arms)
    for category in dict.fromkeys(c for arm in arms for c in arm.target_stat):
        if category not in encoded:
            table = target_stat_table(base, category, LABEL)
            stats[category] = materialize(table, "target-stats")
            if orders > 1:
                rows = materialize(rows, "before-orders") if rows is not base else rows
                rows = ordered_target_stats(
                    rows, id_col, category, LABEL, orders, stat_name(category), seed=SEED, base=base
                )
            else:
                rows = ordered_target_stat(
                    rows, id_col, category, LABEL, stat_name(category), seed=SEED, base=base
                )
    groups: dict[str, DataFrame] = {}
    for category in dict.fromkeys(c for arm in arms for c in arm.grouped):
        most = min(_category_limit(arm) for arm in arms if category in arm.grouped)
        groups[category] = materialize(target_groups(base, category, LABEL, most), "groups")
        rows = apply_groups(rows, groups[category], id_col, category, group_name(category), base=base)
    one_hot = [c for arm in arms if arm.learner == "logistic" for c in arm.categorical]
    for category in dict.fromkeys(one_hot):
        table = materialize(category_dictionary(base, category), "dictionary")
        dictionaries[category] = (table, table.count())
    encodings = Encodings(id_col, stats, dictionaries, groups)
    for category in dictionaries:
        rows = encodings._indexed(rows, category)
    if stats or dictionaries or groups:
        rows = materialize(rows, "encoded")
    return TrainingRows(rows, encodings, nominal, *_fill_values(rows, arms))


def _fill_values(rows: DataFrame, arms: Sequence[Arm]) -> tuple[int, dict]:
    """Row count, and minimum and mean of every number that any arm uses: one pass."""
    keys = dict.fromkeys((None, c) for arm in arms for c in arm.numeric)
    plain = [c for _, c in keys]
    wide, names = rows, [f"_n{i}" for i in range(len(plain))]
    wide = rows.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(plain, names, strict=True)],
        *[
            expression.alias(f"_d{i}_{j}")
            for i, arm in enumerate(arms)
            for j, expression in enumerate(arm.derived.values())
        ],
    )
    for arm in arms:
        keys |= dict.fromkeys((arm.run, name) for name in arm.derived)
    columns = wide.columns
    seen = wide.agg(
        F.count(F.lit(1)), *fill_aggregates(columns, True), *fill_aggregates(columns, False)
    ).first()
    least, means = seen[1 : 1 + len(columns)], seen[1 + len(columns) :]
    return seen[0], dict(zip(keys, zip(least, means, strict=True), strict=True))


def fit_arm(train: DataFrame, arm: Arm, id_col: str, label: str) -> FittedArm:
    """Fit encoders, null fills and the learner on the training rows."""
    return fit_prepared(prepare_training(train, [arm], id_col, label), arm)


def fit_prepared(train: TrainingRows, arm: Arm) -> FittedArm:
    """Fit an arm on training rows that were prepared for it (and perhaps for others)."""
    rows = train.rows.withColumns(dict(arm.derived)) if arm.derived else train.rows
    fit = {"logistic": _fit_logistic, "gbt": _fit_gbt}[arm.learner]
    return fit(train, rows, arm)


def _known(train: TrainingRows, arm: Arm, place: int) -> tuple[list[str], list[float | None]]:
    """The arm's numbers, and their minimum (0) or mean (1)."""
    keys = [*((None, c) for c in arm.numeric), *((arm.run, n) for n in arm.derived)]
    return [c for _, c in keys], [train.known[k][place] for k in keys]


def _fit_logistic(train: TrainingRows, rows: DataFrame, arm: Arm) -> FittedArm:
    """L2 logistic regression on raw numbers, target statistics and one-hot categories."""
    numeric, known = _known(train, arm, 1)
    stages, inputs, names = [], [], []
    if numeric:
        fill = null_fill(numeric, known, for_trees=False)
        stages.append(fill.stage())
        inputs += fill.outputs
        names += [*numeric, *(f"{c} missing" for c in numeric)]
    inputs += [stat_name(c) for c in arm.target_stat]
    if arm.categorical:
        sizes = {c: train.encodings.dictionaries[c][1] for c in arm.categorical}
        rows = with_sizes(rows, sizes)
        stages.append(one_hot_encoder(sizes))
        inputs += [f"{c}__hot" for c in arm.categorical]
    params = {"C": 1.0, "maxIter": 100, "elasticNetParam": 0.0, "standardization": False}
    params.update(arm.params)
    # A penalty of C on the summed loss is 1 / (C n) on the mean loss that MLlib minimises.
    penalty = 1.0 / (params.pop("C") * max(train.n_rows, 1))
    params.setdefault("regParam", penalty)
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    stages.append(LogisticRegression(featuresCol="features", labelCol=LABEL, **params))
    fitted = Pipeline(stages=stages).fit(rows)
    return FittedArm(arm, train.encodings, fitted, (*names, *arm.target_stat, *arm.categorical))


def _fit_gbt(train: TrainingRows, rows: DataFrame, arm: Arm) -> FittedArm:
    """Boosted trees on nominal categories, target statistics and filled numbers."""
    shared_dir(rows.sparkSession)  # names the folder in which boosting cuts its own lineage
    stages = index_stages({c: train.nominal[c] for c in arm.categorical})
    inputs = [f"{c}__idx" for c in arm.categorical] + [stat_name(c) for c in arm.target_stat]
    inputs += [group_name(c) for c in arm.grouped]
    numeric, known = _known(train, arm, 0)
    if numeric:
        fill = null_fill(numeric, known, for_trees=True)
        stages.append(fill.stage())
        inputs += fill.outputs
    params = {"maxBins": MAX_BINS, "seed": SEED, "checkpointInterval": 10, **arm.params}
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    stages.append(GBTClassifier(featuresCol="features", labelCol=LABEL, **params))
    fitted = Pipeline(stages=stages).fit(rows)
    names = (*arm.categorical, *arm.target_stat, *arm.grouped, *numeric)
    leaves = weighted_leaves(fitted.stages[-1]) if arm.stages else None
    return FittedArm(arm, train.encodings, fitted, names, leaves)


def _category_limit(arm: Arm) -> int:
    """Categories that fit in an arm's bins, one bin being kept for unseen and NULL values."""
    return int(arm.params.get("maxBins", MAX_BINS)) - 1


def shared_orders(arms: Sequence[Arm]) -> int:
    """The number of orders of arms that share their statistics."""
    orders = {arm.orders for arm in arms if arm.target_stat} or {1}
    if len(orders) > 1:
        raise ValueError("arms that run together average their statistics over as many orders")
    return orders.pop()


def group_name(category: str) -> str:
    return f"{category}__group"


def stat_name(category: str) -> str:
    return f"{category}__stat"


def code_name(category: str) -> str:
    return f"{category}__code"
