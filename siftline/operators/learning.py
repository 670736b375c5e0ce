"""Learning loops: text classifiers, uncertainty sampling and bandit statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from siftline.functions.text import let
from siftline.session import bound_batches


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / F.size(values)


def _entropy(p: Column) -> Column:
    p = F.greatest(F.lit(1e-10), F.least(F.lit(1 - 1e-10), p))
    return -(p * F.log2(p) + (1 - p) * F.log2(1 - p))


def committee(scores: Column) -> Column:
    """Largest score, smallest distance from 0.5, mean entropy and population variance."""
    mean = _mean(scores)
    return F.struct(
        F.array_max(scores).alias("top"),
        F.array_min(F.transform(scores, lambda p: F.abs(p - 0.5))).alias("margin"),
        _mean(F.transform(scores, _entropy)).alias("entropy"),
        (_mean(F.transform(scores, lambda p: p * p)) - mean * mean).alias("variance"),
    )


def informativeness(df: DataFrame, ident: str, keep: list[str] = (), scores: str = "scores") -> DataFrame:
    """How much a label would teach: uncertainty, margin, entropy and disagreement, weighted."""
    c = committee(F.col(scores))
    value = (
        0.25 * (1 - F.col("_c.top"))
        + 0.35 * (1 - 2 * F.col("_c.margin"))
        + 0.20 * F.col("_c.entropy")
        + 0.20 * F.col("_c.variance")
    )
    return df.withColumn("_c", c).select(ident, *keep, F.round(value, 6).alias("informativeness"))


def select_batch(
    scored: DataFrame, preferred: Column, newest: str, pool: int | None = None, batch: int = 50, enough: int | None = None
) -> DataFrame:
    """The ``batch`` most informative candidates of the preferred kind.

    ``enough``: all kinds are candidates if there are fewer of the preferred one.  ``pool``: only so many newest
    candidates count.  Neither limits anything by default.
    """
    if enough is not None:
        preferred = preferred | ~scored.agg((F.count_if(preferred) >= enough).alias("p")).scalar()
    candidates = scored.filter(preferred)
    if pool is not None:
        candidates = candidates.orderBy(F.desc(newest)).limit(pool)
    return candidates.orderBy(F.desc("informativeness"), newest).limit(batch)


def text_features(df: DataFrame, text: str):
    """1- to 3-gram counts weighted by inverse document frequency: pipeline stages and output column."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, SQLTransformer

    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"(?U)\W+", minTokenLength=2),
            NGram(n=2, inputCol="_words", outputCol="_pairs"),
            NGram(n=3, inputCol="_words", outputCol="_triples"),
            SQLTransformer(statement="SELECT *, concat(_words, _pairs, _triples) AS _grams FROM __THIS__"),
            CountVectorizer(inputCol="_grams", outputCol="_counts", vocabSize=1000, minDF=2.0),
            IDF(inputCol="_counts", outputCol="features"),
        ]
    )


#: Distinct words, or grams of them, that a task counts before it hands them on.
HELD = 200_000


def _gram_counts(words: DataFrame, column: str, size: int, known: list, parts: set | None):
    """``gram, n, rows``: how often grams of ``size`` words occur, and in how many rows, counted in Arrow batches.

    ``known``: the words that grams are made of (all, if ``size`` is 1).  ``parts``: places in ``known`` of the grams that are
    shorter by one word and that a gram must begin and end with."""
    import pyarrow as pa

    place = {w: i for i, w in enumerate(known)}
    most = len(known) + 1
    inner = None if parts is None else np.array(sorted(a * most + b for a, b in parts), dtype=np.int64)

    def grams(batch):
        """Codes of the grams of a batch, the rows that hold them, and the names of codes."""
        texts = batch.column(0)
        flat, lengths = texts.flatten(), np.diff(texts.offsets.to_numpy())
        row = np.repeat(np.arange(len(lengths)), lengths)
        coded = flat.dictionary_encode()
        code, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        if size == 1:
            return code, row, lambda c: names[c]
        code = np.array([place.get(w, -1) for w in names] or [-1], dtype=np.int64)[code] if len(code) else code
        pair = code[:-1] * most + code[1:]
        fits = (row[:-1] == row[1:]) & (code[:-1] >= 0) & (code[1:] >= 0)
        if size == 2:
            return pair[fits], row[:-1][fits], lambda c: f"{known[c // most]} {known[c % most]}"
        fits &= np.isin(pair, inner)
        fits = fits[:-1] & fits[1:]
        triple = pair[:-1] * most + code[2:]
        return triple[fits], row[:-2][fits], lambda c: f"{known[c // most // most]} {known[c // most % most]} {known[c % most]}"

    def run(batches):
        total = {}

        def handed():
            keys = list(total)
            counts = np.array([total[k] for k in keys], dtype=np.int64).reshape(-1, 2)
            for at in range(0, len(keys), 10_000):
                part = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[part], pa.string()), pa.array(counts[part, 0]), pa.array(counts[part, 1])], ["gram", "n", "rows"])
            total.clear()

        for batch in batches:
            code, row, name = grams(batch)
            if not len(code):
                continue
            if int(code.max()) < (1 << 62) // batch.num_rows:  # one number sorts faster than two
                code, row = np.divmod(np.sort(code * batch.num_rows + row), batch.num_rows)
            else:
                order = np.lexsort((row, code))
                code, row = code[order], row[order]
            new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            in_rows = np.add.reduceat(np.r_[True, (code[1:] != code[:-1]) | (row[1:] != row[:-1])].astype(np.int64), new)
            for c, n, rows in zip(code[new].tolist(), np.diff(np.r_[new, len(code)]).tolist(), in_rows.tolist()):
                held = total.setdefault(name(c), [0, 0])
                held[0] += n
                held[1] += rows
            if len(total) > HELD:
                yield from handed()
        yield from handed()

    counted = words.select(column).where(F.size(column) >= size).mapInArrow(run, "gram string, n long, rows long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"))


def common_grams(words: DataFrame, column: str, most: int, least_rows: int = 2) -> list[str]:
    """The ``most`` most frequent grams of one to three words that at least ``least_rows`` rows hold, of equals the first by name.

    A gram is at most as frequent as its words and the shorter grams in it, so pairs are counted of words only that are
    themselves frequent enough, and triples of such pairs: what travels is bounded by ``most``, not by the text."""
    bound_batches()
    found, least, known, parts = [], 1, [], None
    for size in (1, 2, 3):
        enough = _gram_counts(words, column, size, known, parts).where((F.col("rows") >= least_rows) & (F.col("n") >= least)).cache()
        # only grams that can be among the most frequent ones travel to the driver
        sizes, held = enough.groupBy("n").agg(F.count(F.lit(1)).alias("grams")).orderBy(F.desc("n")).limit(most).collect(), 0
        for row in sizes:
            held += row["grams"]
            if held >= most:
                least = max(least, row["n"])
                break
        fresh = [(-r["n"], r["gram"]) for r in enough.where(F.col("n") >= least).select("gram", "n").collect()]
        enough.unpersist()
        found = sorted(found + fresh)
        if len(found) >= most:
            least = -found[most - 1][0]
            found = [g for g in found if -g[0] >= least]
        if size == 1:
            known = sorted(g for _, g in fresh)
        else:
            place = {w: i for i, w in enumerate(known)}
            parts = {tuple(place[w] for w in g.split(" ")) for n, g in fresh if -n >= least}
        if not fresh:
            break
    return [g for _, g in found[:most]]


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Weight each class by the inverse of its share.

    The weights, a row for each class, travel to the rows: joined by a shuffle, all rows of a class would meet in one task.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("t"), F.count(F.lit(1)).alias("k"))
    per_row = sizes.select(
        label, (total.select("t").scalar() / (total.select("k").scalar() * F.col("_n"))).alias("weight")
    )
    return df.join(F.broadcast(per_row), label)


def stratified_split(df: DataFrame, ident: str, label: str, share: float = 0.8, seed: int = 42):
    """Deterministic split by a hash of the id within each class: the ``share`` point of the hash per class.

    The point is read from a 1024-bin histogram of each class, so no class is collected or sorted.
    """
    from pyspark.sql import Window

    bins = 1024
    hashed = df.withColumn("_bin", F.pmod(F.xxhash64(F.lit(seed), F.col(ident)), F.lit(bins)))
    histogram = hashed.groupBy(label, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(label).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(label)
    marked = histogram.select(
        label, "_bin", (F.sum("_n").over(upto) <= share * F.sum("_n").over(whole)).alias("_train")
    )
    split = hashed.join(F.broadcast(marked), [label, "_bin"])  # as many rows as there are bins and classes
    return split.filter("_train").drop("_bin", "_train"), split.filter("NOT _train").drop("_bin", "_train")


def train(df: DataFrame, ident: str, text: str, label: str, kind: str = "logistic", minimum: int = 50):
    """Fit a classifier of texts; returns (model, metrics) or (None, reason) with too few rows.

    ``kind``: ``logistic`` (balanced logistic regression) or ``bayes`` (the second committee member).
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression, NaiveBayes
    from pyspark.ml.feature import CountVectorizerModel

    rows = df.count()
    if rows < minimum:
        return None, {"rows": rows, "reason": f"needs {minimum} labelled rows"}
    train_rows, test_rows = stratified_split(df, ident, label)
    weighted = balanced(train_rows.withColumn(label, F.col(label).cast("double")), label).cache()
    if kind == "logistic":
        final = LogisticRegression(labelCol=label, weightCol="weight", maxIter=1000, regParam=0.01)
    else:
        final = NaiveBayes(labelCol=label, weightCol="weight")
    *cutting, vectorizer, idf = text_features(df, text).getStages()
    words = cutting[0].transform(weighted)
    vocabulary = common_grams(words, cutting[0].getOutputCol(), vectorizer.getVocabSize(), int(vectorizer.getMinDF()))
    if not vocabulary:
        raise ValueError("no word is in two rows")
    named = CountVectorizerModel.from_vocabulary(vocabulary, vectorizer.getInputCol(), vectorizer.getOutputCol())
    counter = PipelineModel([*cutting, named])
    counted = counter.transform(weighted).select(label, "weight", "_counts").cache()  # words are cut once for all later steps
    weigher = Pipeline(stages=[idf, final]).fit(counted)
    model = PipelineModel([*counter.stages, *weigher.stages])
    scores = {}
    for name, judge, part in (("train_accuracy", weigher, counted), ("test_accuracy", model, test_rows)):
        judged = judge.transform(part).agg(
            F.avg((F.col("prediction") == F.col(label).cast("double")).cast("double")).alias("a")
        )
        scores[name] = judged.first()["a"]
    counted.unpersist()
    weighted.unpersist()
    return model, {"rows": rows, **scores}


def predict(model, df: DataFrame, method: str = "ml") -> DataFrame:
    """Add probability, is_lead and method; an untrained model says no with probability 0."""
    if model is None:
        return df.withColumns(
            {"probability": F.lit(0.0), "is_lead": F.lit(False), "method": F.lit(f"{method}_not_trained")}
        )
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(df)
    p = vector_to_array("probability")[1]
    return scored.select(
        *df.columns, p.alias("probability"), (p > 0.5).alias("is_lead"), F.lit(method).alias("method")
    )


def metrics(df: DataFrame, label: Column, predicted: Column) -> DataFrame:
    """Binary accuracy, precision, recall and F1 from one pass of confusion counts."""
    both = df.agg(
        F.count_if(label & predicted).alias("tp"),
        F.count_if(~label & predicted).alias("fp"),
        F.count_if(label & ~predicted).alias("fn"),
        F.count_if(~label & ~predicted).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def ratio(a, b):
        return F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))

    return both.select(
        "tp", "fp", "fn", "tn",
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def retrain_due(labelled: DataFrame, enough: int = 50) -> DataFrame:
    counted = labelled.agg(F.count(F.lit(1)).alias("labelled"))
    return counted.select("labelled", (F.col("labelled") >= enough).alias("retrain"))


def reward(replied: Column, reply_seconds: Column, length: Column, closed: Column, amount: Column) -> Column:
    """Reward of an outcome: reply, speed, length of the talk, deal and its size."""
    deal = F.when(amount > 50000, 0.5).when(amount > 20000, 0.2).otherwise(0.0)
    value = (
        F.lit(0.3)
        + F.when((reply_seconds > 0) & (reply_seconds < 3600), 0.1).otherwise(0.0)
        + F.when(length >= 5, 0.2).when(length >= 3, 0.1).otherwise(0.0)
        + F.when(closed, 1.0 + deal).otherwise(0.0)
    )
    return F.when(replied, value).otherwise(F.lit(0.0))


def posterior(strategies: DataFrame, outcomes: DataFrame, key: str, reward_col: str = "reward") -> DataFrame:
    """Priors plus the outcomes: Beta parameters, attempts, successes and running mean reward."""
    won = F.col(reward_col) > 0
    seen = outcomes.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(won).alias("_won"), F.sum(reward_col).alias("_sum")
    )
    none = F.lit(0)
    joined = strategies.join(seen, key, "left")
    n, won_n = F.coalesce("_n", none), F.coalesce("_won", none)
    attempts = F.col("total_attempts") + n
    mean = F.when(
        attempts > 0, (F.col("avg_reward") * F.col("total_attempts") + F.coalesce("_sum", F.lit(0.0))) / attempts
    ).otherwise(F.lit(0.0))
    return joined.select(
        key,
        (F.col("alpha") + won_n).alias("alpha"),
        (F.col("beta") + n - won_n).alias("beta"),
        attempts.alias("total_attempts"),
        (F.col("successful_attempts") + won_n).alias("successful_attempts"),
        mean.alias("avg_reward"),
    )


def best_by_mean(arms: list[tuple[str, float, float]], boosts: dict[str, Column]) -> Column:
    """Name of the arm with the largest boosted posterior mean; the first of equals."""
    values = [
        F.struct(
            F.round(boosts.get(name, F.lit(1.0)) * (alpha / (alpha + beta)), 9).alias("value"),
            F.lit(-order).alias("order"),
            F.lit(name).alias("name"),
        )
        for order, (name, alpha, beta) in enumerate(arms)
    ]
    return F.array_max(F.array(*values))["name"]


def select_strategy(df: DataFrame, ident: str, strategies: list[tuple], boosts: dict[str, Column], epsilon=0.2, seed=42):
    """Thompson sampling per row: ``epsilon`` of rows take any strategy, the others the best Beta draw times
    the boost of their context.  Draws are seeded by the row id, so a retried task repeats them.

    ``strategies``: (strategy_id, alpha, beta), the arms of one bandit.
    """
    names = [s[0] for s in strategies]
    shape = [(float(s[1]), float(s[2])) for s in strategies]

    @F.pandas_udf(ArrayType(DoubleType()))
    def draws(ids: pd.Series) -> pd.Series:
        def one(i):
            rng = np.random.default_rng([seed, int(i) & 0xFFFFFFFFFFFF])
            return [rng.random(), rng.random(), *(rng.beta(a, b) for a, b in shape)]

        return ids.map(one)

    df = df.withColumn("_draws", draws(ident))
    explored = F.element_at(F.array(*map(F.lit, names)), F.floor(F.col("_draws")[1] * len(names)).cast("int") + 1)
    sampled = F.array_max(
        F.array(
            *[
                F.struct((F.col("_draws")[i + 2] * boosts.get(n, F.lit(1.0))).alias("v"), F.lit(-i).alias("o"),
                         F.lit(n).alias("n"))
                for i, n in enumerate(names)
            ]
        )
    )["n"]
    explore = F.col("_draws")[0] < epsilon
    return df.withColumn("explored", explore).withColumn("strategy", F.when(explore, explored).otherwise(sampled)).drop(
        "_draws"
    )


#: Attempts of a Gamma draw; each one is taken with a chance above 0.95, so that all fail in one of 10**15 draws.
ATTEMPTS = 12


def uniform(ident: Column, seed: int, *parts) -> Column:
    """A number in (0, 1) that depends on the row, the seed and what it is for: 52 bits of a digest, the same in any engine."""
    digest = F.md5(F.concat_ws(":", ident.cast("string"), F.lit(str(seed)), *[F.lit(str(p)) if not isinstance(p, Column) else p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def gamma_draw(ident: Column, seed: int, purpose: str, shape: float) -> Column:
    """A Gamma(shape, 1) draw by rejection from a cubed normal, with a fixed number of attempts and the mean after them."""
    d = max(shape, 1.0) - 1 / 3 if shape >= 1 else shape + 2 / 3
    c = 1 / (9 * d) ** 0.5

    def attempt(i):
        u = [uniform(ident, seed, purpose, i, k) for k in range(3)]
        z = F.sqrt(-2 * F.log(u[0])) * F.cos(F.lit(2 * np.pi) * u[1])

        def judged(p):
            v = F.pow(1 + c * p["z"], F.lit(3.0))
            return F.when((v > 0) & (F.log(p["u"]) < p["z"] * p["z"] / 2 + d - d * v + d * F.log(F.when(v > 0, v))), d * v)

        return let(F.struct(z.alias("z"), u[2].alias("u")), judged)

    drawn = F.aggregate(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), F.lit(None).cast("double"), lambda found, i: F.coalesce(found, attempt(i)))
    drawn = F.coalesce(drawn, F.lit(d + 1 / 3))
    return drawn if shape >= 1 else drawn * F.pow(uniform(ident, seed, purpose, "power"), F.lit(1 / shape))


def beta_draw(ident: Column, seed: int, purpose: str, alpha: float, beta: float) -> Column:
    x, y = gamma_draw(ident, seed, f"{purpose}/a", alpha), gamma_draw(ident, seed, f"{purpose}/b", beta)
    return let(F.struct(x.alias("x"), y.alias("y")), lambda g: g["x"] / (g["x"] + g["y"]))


def sample_strategy(df: DataFrame, ident: str, arms: list[tuple[str, float, float]], boosts: dict[str, Column], epsilon: float = 0.2, seed: int = 42) -> DataFrame:
    """``select_strategy`` in built-in functions: ``epsilon`` of rows take any strategy, the others the best Beta draw times the
    boost of their context (to nine digits; the first of equals).  Draws depend on the row's id and the seed only."""
    key = F.col(ident)
    explore = uniform(key, seed, "explore") < epsilon
    names = F.array(*[F.lit(name) for name, _, _ in arms])
    anyone = F.get(names, F.floor(uniform(key, seed, "any") * len(arms)).cast("int"))
    values = [
        F.struct(F.round(beta_draw(key, seed, name, alpha, beta) * boosts.get(name, F.lit(1.0)), 9).alias("v"), F.lit(-i).alias("o"), F.lit(name).alias("n"))
        for i, (name, alpha, beta) in enumerate(arms)
    ]
    return df.withColumn("explored", explore).withColumn("strategy", F.when(F.col("explored"), anyone).otherwise(F.array_max(F.array(*values))["n"]))


def saved(model, folder: str):
    """The model as written to a shared folder and read from it again."""
    from pyspark.ml import PipelineModel

    model.write().overwrite().save(folder)
    return PipelineModel.load(folder)
