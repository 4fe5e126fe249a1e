"""Quality classifier: a sparse ensemble of rules over text statistics, as Spark columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from riskgrove.llm.common import quoted, settled, text_of

#: Labelled training rows that a fit reads at most; the sample is the rows of lowest id hash.
TRAIN_ROWS = 20_000

TREES, DEPTH, PENALTY, SEED = 30, 3, 0.002, 11
THRESHOLD = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text (null: empty), each a double; none depends on the label."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: F.length(w) > 0)
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) > 0)
    share = lambda part, whole: part / F.greatest(whole, F.lit(1)).cast("double")
    left = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    chars, n, n_lines = F.length(text), F.size(words), F.size(lines)
    return {
        "chars": chars.cast("double"),
        "words": n.cast("double"),
        "word_length": share(chars, n),
        "distinct_words": share(F.size(F.array_distinct(words)), n),
        "distinct_lines": share(F.size(F.array_distinct(lines)), n_lines),
        "words_a_line": share(n, n_lines),
        "capitals": share(left("[A-Z]+"), chars),
        "digits": share(left("[0-9]+"), chars),
        "stops": share(left("[.,;:]+"), n),
        "symbols": share(left(r"[^\p{L}\p{N}\s.,;:'\"()-]+"), n),
    }


@dataclass(frozen=True)
class Test:
    """``value(name) <= cut`` or, if not ``below``, ``value(name) > cut``."""

    name: str
    cut: float
    below: bool

    def column(self) -> Column:
        value = F.col(self.name)
        return value <= self.cut if self.below else value > self.cut


Rule = tuple[Test, ...]


def rule_column(rule: Rule) -> Column:
    """All tests of a rule."""
    out = F.lit(True)
    for test in rule:
        out = out & test.column()
    return out


def paths(forest, names: list[str]) -> list[Rule]:
    """Every path from a root to an inner node or leaf, as a rule; tests of one statistic in one
    direction are merged into the tightest."""
    found: dict[Rule, None] = {}

    def tightest(tests: list[Test]) -> Rule:
        best: dict[tuple[str, bool], float] = {}
        for t in tests:
            key = (t.name, t.below)
            pick = min if t.below else max
            best[key] = pick(best.get(key, t.cut), t.cut)
        return tuple(Test(n, c, b) for (n, b), c in sorted(best.items()))

    def walk(node, tests: list[Test]) -> None:
        if tests:
            found[tightest(tests)] = None
        if node.numDescendants() > 0:
            split = node.split()
            name, cut = names[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), [*tests, Test(name, cut, True)])
            walk(node.rightChild(), [*tests, Test(name, cut, False)])

    for tree in forest.trees:
        walk(tree._call_java("rootNode"), [])
    return list(found)


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules; ``column`` scores rows that carry the statistics as columns."""

    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def column(self) -> Column:
        margin = F.lit(self.intercept)
        for rule, weight in self.rules:
            margin = margin + F.when(rule_column(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))


def sample_of(labelled: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most about ``most`` rows, those of lowest id hash, by one threshold on the hash."""
    rows = labelled.count()
    if rows <= most:
        return labelled
    place = F.pmod(F.xxhash64(quoted(id_col)), F.lit(1 << 30))
    return labelled.where(place < int((1 << 30) * most / rows))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    most_rows: int = TRAIN_ROWS,
) -> RuleModel:
    """Learn from labelled rows whose crc32 of the id as text leaves a remainder other than 0 by 5.

    A random forest on the statistics gives paths as rules; a logistic fit with an L1 penalty on
    the rules' truth values keeps a few. Only rows of a bounded sample of the labels are read
    into the fit (``most_rows``, about); it is broadcast to the documents, as its size is bounded.

    Labels that are null or of unknown ids are left out; a repeated label counts as often as it
    stands there. Without labelled rows, or with one class only, the model has no rules and the
    score is the share of label 1 (one half without rows), kept off 0 and 1.
    """
    own = labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("double").alias("label"))
    own = own.where(learns(F.col("id")) & F.col("label").isin(0.0, 1.0))
    own = sample_of(own, "id", most_rows)
    rows = docs.select(quoted(id_col).alias("id"), text_of(text_col).alias("text"))
    rows = rows.join(F.broadcast(own), "id").select("label", *_named(F.col("text")))
    rows = settled(rows, "quality-train")

    total, ones = rows.agg(F.count("*"), F.sum("label")).first()
    share = ((ones or 0) + 0.5) / (total + 1)
    prior = RuleModel((), float(_logit(share)))
    if not total or ones in (0, total):
        return prior
    names = [n for n in rows.columns if n != "label"]
    trained = rows.select("label", array_to_vector(F.array(*names)).alias("features")).cache()
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, maxBins=64, subsamplingRate=0.7, seed=SEED, minInstancesPerNode=5
    ).fit(trained)
    trained.unpersist()
    rules = paths(forest, names)
    if not rules:
        return prior
    truth = [rule_column(rule).cast("double") for rule in rules]
    trained = rows.select("label", array_to_vector(F.array(*truth)).alias("features")).cache()
    line = LogisticRegression(
        elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False
    ).fit(trained)
    trained.unpersist()
    kept = tuple((r, float(w)) for r, w in zip(rules, line.coefficients.toArray()) if w)
    return RuleModel(kept, float(line.intercept))


def _logit(share: float) -> float:
    import math

    return math.log(share / (1 - share))


def _named(text: Column) -> list[Column]:
    return [c.alias(n) for n, c in statistics(text).items()]


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, by 5 (null id: of the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5


def learns(id_col: Column) -> Column:
    return fold(id_col) != 0


def score(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """Columns ``row`` (the whole row) and ``score``, 0 to 1, for every row.

    Statistics are computed once for each row and the rules are plain conditions on them, so a
    row is scored where it is read. Null text is scored as empty. An empty table gives an empty
    table.
    """
    every = F.struct(*[quoted(c).alias(c) for c in docs.columns]).alias("row")
    rows = docs.select(every, *_named(text_of(text_col)))
    return rows.select("row", model.column().alias("score"))


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD, **kw
) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    model = fit(docs, labels, id_col, **kw)
    text_col = kw.get("text_col", "text")
    return score(docs, model, text_col).where(F.col("score") >= threshold).select("row.*")
