import math
import random
import statistics
from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from boutframe.functions import distributions as dist
from boutframe.learning import model, power, sampling, scaling


def columns(spark, **named):
    rows = list(zip(*named.values()))
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in named))


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(3)
    n = 4000
    return columns(
        spark,
        bell=[rng.gauss(10, 2) for _ in range(n)],
        skewed=[math.exp(rng.gauss(0, 1)) for _ in range(n)],
        gappy=[None if i % 50 == 0 else rng.gauss(0, 1) for i in range(n)],
        flat=[1.0] * n,
    )


def test_normality_verdicts(samples):
    out = {r["feature"]: r for r in scaling.normality(samples, samples.columns).collect()}
    assert {f: r["is_normal"] for f, r in out.items()} == {
        "bell": True, "skewed": False, "gappy": False, "flat": False,
    }
    assert out["bell"]["p_value"] == pytest.approx(math.exp(-out["bell"]["k2"] / 2))


def test_normality_rejects_about_five_percent(spark):
    rng = random.Random(11)
    names = [f"f{i}" for i in range(200)]
    df = columns(spark, **{n: [rng.gauss(0, 1) for _ in range(150)] for n in names})
    verdicts = scaling.normality(df, names).agg(F.avg(F.col("is_normal").cast("double")), F.avg("k2")).first()
    assert 0.88 <= verdicts[0] <= 0.99
    assert 1.5 <= verdicts[1] <= 2.6


def test_small_samples_have_no_verdict(spark):
    df = columns(spark, x=[1.0, 2.0, 4.0, 8.0, 9.0])
    r = scaling.normality(df, ["x"]).first()
    assert r["k2"] is None and r["is_normal"] is False


@pytest.mark.parametrize("lam", [-1.5, 0.0, 0.5, 1.0, 2.0, 3.0])
def test_yeo_johnson_formula(spark, lam):
    xs = [-3.0, -0.5, 0.0, 0.25, 4.0]
    got = columns(spark, x=xs).select("x", dist.yeo_johnson(F.col("x"), F.lit(lam)).alias("y")).collect()
    for r in got:
        x = r["x"]
        if x >= 0:
            want = math.log(x + 1) if lam == 0 else ((x + 1) ** lam - 1) / lam
        else:
            want = -math.log(1 - x) if lam == 2 else -((1 - x) ** (2 - lam) - 1) / (2 - lam)
        assert r["y"] == pytest.approx(want, abs=1e-12)


def test_fitted_lambda_recovers_the_log(spark):
    rng = random.Random(5)
    df = columns(spark, x=[math.expm1(abs(rng.gauss(3, 0.5))) for _ in range(4000)], y=[rng.gauss(0, 1) for _ in range(4000)])
    lams = {r["feature"]: r["lam"] for r in scaling.yeo_johnson_lambdas(df, ["x", "y"]).collect()}
    assert abs(lams["x"]) < 0.25
    assert lams["y"] == pytest.approx(1.0, abs=0.1)


def test_scaled_features_are_standard(samples):
    features = ["bell", "skewed", "gappy", "flat"]
    params = scaling.fit_scaling(samples, features)
    kinds = {r["feature"]: r["kind"] for r in params.collect()}
    assert kinds == {"bell": "normal", "skewed": "power", "gappy": "power", "flat": "constant"}
    out = scaling.apply_scaling(samples, params, features)
    r = out.agg(*[F.avg(f).alias(f) for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    for f in ("bell", "skewed", "gappy"):
        assert r[f] == pytest.approx(0.0, abs=1e-9) and r[f"s_{f}"] == pytest.approx(1.0, abs=1e-9)
    assert r["flat"] == 0.0 and r["s_flat"] == 0.0
    assert out.where("gappy IS NULL").count() == 80


def plain_likelihood(xs, lam):
    """In whole numbers of 200 digits, as differences of the plain transform are lost in doubles."""
    with localcontext() as precise:
        precise.prec = 200
        xs, lam = [Decimal(x) for x in xs], Decimal(lam)
        ys = [((x + 1) ** lam - 1) / lam if x >= 0 else -((1 - x) ** (2 - lam) - 1) / (2 - lam) for x in xs]
        mean = sum(ys) / len(ys)
        variance = sum((y - mean) ** 2 for y in ys) / len(ys)
        logs = sum((1 if x >= 0 else -1) * (1 + abs(x)).ln() for x in xs)
        return float(-len(xs) * variance.ln() / 2 + (lam - 1) * logs)


def test_lambdas_have_no_bound_and_the_highest_likelihood(spark):
    rng = random.Random(8)
    n = 400
    df = columns(
        spark,
        far=[1500 + 40 * rng.expovariate(1) for _ in range(n)],
        below=[-1500 - 40 * rng.expovariate(1) for _ in range(n)],
        steep=[1e4 - 30 * rng.expovariate(1) for _ in range(n)],
        narrow=[i * 1e-14 for i in range(n)],
        both=[rng.expovariate(1) - 0.6 for _ in range(n)],
        zeros=[float(i % 3 == 0) for i in range(n)],
    )
    rows = {c: [r[c] for r in df.collect()] for c in df.columns}
    found = {r["feature"]: r["lam"] for r in scaling.yeo_johnson_lambdas(df, df.columns).collect()}
    assert found["far"] < -20 and found["below"] > 22 and found["steep"] > 50
    for f in ("far", "below", "steep", "both", "zeros"):
        best = plain_likelihood(rows[f], found[f])
        for off in (-1.0, -0.1, -0.003, 0.003, 0.1, 1.0):
            assert plain_likelihood(rows[f], found[f] + off) < best
    params = scaling.fit_scaling(df, df.columns)
    out = scaling.apply_scaling(df, params, df.columns)
    r = out.agg(*[F.avg(f).alias(f) for f in df.columns], *[F.stddev_pop(f).alias(f"s_{f}") for f in df.columns]).first()
    for f in df.columns:
        assert r[f] == pytest.approx(0.0, abs=1e-8) and r[f"s_{f}"] == pytest.approx(1.0, abs=1e-8)


def test_powers_take_two_passes(spark, monkeypatch):
    """The summary alone is right to a hundredth of a feature's scale; one exact pass does the rest."""
    rng = random.Random(12)
    df = columns(
        spark,
        wide=[math.exp(rng.gauss(0, 3)) for _ in range(5000)],
        both=[rng.gauss(1, 2) ** 3 for _ in range(5000)],
        far=[1500 + 40 * rng.expovariate(1) for _ in range(5000)],
        tiny=[rng.expovariate(1) * 1e-9 for _ in range(5000)],
        gaps=[None if i % 3 else rng.expovariate(1) for i in range(5000)],
    )
    passes, exact = [], power._tried

    def counted(values, guesses, at):
        passes.append({f: lam for f, (lam, _) in at.items()} | {f"{f}_unit": g["unit"] for f, g in guesses.items()})
        return exact(values, guesses, at)

    monkeypatch.setattr(power, "_tried", counted)
    found = {r["feature"]: r["lam"] for r in scaling.yeo_johnson_lambdas(df, df.columns).collect()}
    assert len(passes) == 1
    for f, lam in found.items():
        assert abs(lam - passes[0][f]) < 1e-2 * passes[0][f"{f}_unit"]


def test_summaries_of_parts_and_of_the_whole_agree(spark):
    rng = random.Random(2)
    df = columns(spark, x=[rng.gauss(0, 5) for _ in range(3000)] + [0.0] * 50)
    keys = ["feature", "sign", "cell"]
    one = power.summarised(scaling.unpivoted(df.coalesce(1), ["x"])).orderBy(*keys).collect()
    many = power.summarised(scaling.unpivoted(df.repartition(16), ["x"])).orderBy(*keys).collect()
    assert sum(r["n"] for r in one) == 3050 and [r[:4] for r in one] == [r[:4] for r in many]
    assert [r["m2"] for r in one] == pytest.approx([r["m2"] for r in many], rel=1e-6, abs=1e-15)


def test_constants_are_zero(spark):
    df = columns(spark, c=[1523.7] * 3000, n=[-0.1] * 3000, gap=[None] * 3000)
    params = scaling.fit_scaling(df, ["c", "n", "gap"])
    out = scaling.apply_scaling(df, params, ["c", "n", "gap"]).distinct().collect()
    assert [tuple(r) for r in out] == [(0.0, 0.0, None)]


def test_new_values_of_the_other_sign_keep_their_order(spark):
    train = columns(spark, x=[5.0 + i % 17 + (i % 5) ** 2 for i in range(500)])
    params = scaling.fit_scaling(train, ["x"])
    new = columns(spark, x=[-40.0, -3.0, -0.5, 0.0, 0.5, 3.0, 40.0])
    out = [r["x"] for r in scaling.apply_scaling(new, params, ["x"]).collect()]
    assert out == sorted(out) and len(set(out)) == 7
    lam = params.first()["lam"]
    plain = [r["y"] for r in new.select(dist.yeo_johnson(F.col("x"), F.lit(lam)).alias("y")).collect()]
    slopes = [(b - a) / (d - c) for a, b, c, d in zip(out, out[1:], plain, plain[1:])]
    assert slopes == pytest.approx([slopes[0]] * 6, rel=1e-6)


def test_population_sigma(spark):
    xs = [1.0, 2.0, 4.0, 9.0]
    z = columns(spark, x=xs).select(scaling.standardised(F.col("x"), statistics.fmean(xs), statistics.pstdev(xs))).collect()
    assert z[3][0] == pytest.approx((9 - 4) / statistics.pstdev(xs))


def test_holdout_is_a_fixed_share_of_keys(spark):
    keys = spark.range(20000)
    held = keys.select("id", sampling.in_holdout(F.col("id")).alias("h"))
    assert 0.28 < held.where("h").count() / 20000 < 0.32
    again = keys.repartition(13).select("id", sampling.in_holdout(F.col("id")).alias("h"))
    assert held.exceptAll(again).count() == 0
    big = spark.range(2).select((F.col("id") + 6_000_000_000_000).alias("id"))
    assert big.where(sampling.in_holdout(F.col("id")).isNotNull()).count() == 2


def test_folds_are_dealt_within_each_target(spark):
    """A third of all rows share one target; folds still differ by one row at most."""
    df = spark.range(30000).withColumn("y", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).cast("int"))
    out = sampling.stratified_folds(df, "y", "id", folds=5, buckets=64)
    assert out.count() == 30000
    sizes = out.groupBy("y", "fold").count().groupBy("y").agg(F.max("count") - F.min("count"), F.count("*"))
    assert all(r[1] <= 1 and r[2] == 5 for r in sizes.collect())
    finer = sampling.stratified_folds(df.repartition(7), "y", "id", folds=5, buckets=1024)
    assert out.exceptAll(finer).count() == 0  # neither buckets nor partitions change the deal


def test_search_space(spark):
    draws = model.draw_settings(model.SEARCH_SPACE, 100, seed=42)
    assert draws == model.draw_settings(model.SEARCH_SPACE, 100, seed=42)
    assert all(len(v) == 10 for v in model.SEARCH_SPACE.values())
    assert {d["maxIter"] for d in draws} <= set(range(200, 401))
    assert all(isinstance(d["maxDepth"], int) for d in draws)


def test_error_summary(spark):
    df = columns(spark, y=[1.0, 2.0, 3.0], p=[1.0, 4.0, 2.0])
    r = model.error_summary(df, "y", "p").first()
    assert (r["n"], r["mae"]) == (3, 1.0)
    assert r["root_mae"] == 1.0 and r["rmse"] == pytest.approx(math.sqrt(5 / 3))


def test_rounding_is_half_even(one):
    assert one(model.rounded_prediction(F.lit(20.25))) == 20.2
    assert one(model.rounded_prediction(F.lit(20.35))) == 20.4


def test_models_learn_and_score(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        x = rng.gauss(0, 1)
        rows.append((2020, i % 18 + 1, f"a{i}", f"b{i}", x, None if i % 40 == 0 else rng.expovariate(1.0),
                     20.0 + round(5 * x), 20.0 - round(5 * x)))
    schema = ("season int, week int, away_abbr string, home_abbr string, form_diff double, other_diff double, "
              "away_score double, home_score double")
    done = spark.createDataFrame(rows, schema)
    coming = spark.createDataFrame([(2021, 1, "u", "v", 1.5, 1.0, None, None), (2021, 1, "w", "x", -1.5, None, None, None)], schema)
    space = {"maxIter": [10], "stepSize": [0.3, 0.5], "maxDepth": [3]}
    scored, errors = model.train_and_score(done, coming, space=space, draws=2, folds=2)
    found = {r["away_abbr"]: r for r in scored.collect()}
    assert found["u"]["predicted_away_score"] > 24 > 16 > found["w"]["predicted_away_score"]
    assert found["u"]["predicted_home_score"] < 16
    assert found["u"]["form_diff"] == 1.5  # features come back unscaled
    assert all(r["mae"] < 2.5 and r["rmse"] >= r["mae"] for r in errors.collect())
