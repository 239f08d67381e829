"""The study over gold tables: stages that each make result tables from earlier ones, saved as soon as they stand.

A stage names the tables it reads and the function that makes its own. run() takes the stages in order;
what one has saved survives the failure of a later one, and with `resume` such a stage is not run again.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermocline.config import Config
from thermocline.functions.columns import winter_label
from thermocline.operators import climate as K
from thermocline.operators import energy as E
from thermocline.operators import mining as N
from thermocline.operators import models as D
from thermocline.operators import relational as R
from thermocline.operators import stats as S
from thermocline.plans import warehouse
from thermocline.plans.mining import permuted_correlation, shuffle_p
from thermocline.session import written

Tables = dict[str, DataFrame]
LEAST_FAMILY, DRAWS, STEPS = 3, 20_000, 24


@dataclass(frozen=True)
class Stage:
    name: str
    needs: tuple[str, ...]
    makes: tuple[str, ...]
    make: Callable[[Tables, Config], Tables]


def index(t: Tables) -> DataFrame:
    """year, month, x"""
    return t["enso_month"].select(F.year("date").alias("year"), F.month("date").alias("month"), F.col("index").alias("x"))


def long_climate(t: Tables, variables: list[str]) -> DataFrame:
    """variable, unit, year, month, value"""
    return R.melted(t["unit_climate"].select("unit", "year", "month", *variables), ["unit", "year", "month"], variables)


def field_of(cfg: Config) -> list[str]:
    """The states whose tests are the field: all but DC, whose climate is another state's."""
    return sorted(s for own in cfg.regions.values() for s in own if s != "DC")


def calendar(t: Tables, cfg: Config) -> Tables:
    """Events and winters."""
    from thermocline.plans.build import winters

    events, cold = winters(t["enso_month"], cfg)
    return {"enso_event": events, "enso_winter": cold}


def field(t: Tables, cfg: Config) -> Tables:
    """Teleconnections of the states and their summary."""
    c = cfg.teleconnect
    rows = long_climate(t, c.variables).where(F.col("unit").isin(field_of(cfg)))
    found = K.teleconnections(rows, index(t), cfg.climate.anomaly_half_window, c.max_lead, c.surrogates, c.fdr_method, c.fdr_q, c.seed)
    found = written(found, "teleconnection")
    return {"teleconnection": found, "teleconnection_summary": K.summary(found, c.fdr_q)}


def seasons(t: Tables, cfg: Config) -> Tables:
    """Season data of all units, their fingerprint and the states' features."""
    c, e = cfg.teleconnect, cfg.enso
    data = written(K.season_data(long_climate(t, c.variables), index(t), cfg.climate.anomaly_half_window), "seasons")
    found = K.fingerprint(data, F.col("unit").isin(field_of(cfg)), e.threshold, e.strength_edges[-1], c.surrogates, c.bootstrap, c.fdr_method, c.fdr_q, c.seed)
    return {"season": data, "fingerprint": found, "cluster_feature": K.features(data.where(F.col("unit").isin(field_of(cfg)) & F.col("variable").isin(cfg.cluster.variables)))}


def clusters(t: Tables, cfg: Config) -> Tables:
    """States clustered by their features for each k; k by silhouette, then the smaller; agreement with resampled years."""
    c = cfg.cluster
    data = t["season"].where(F.col("unit").isin(field_of(cfg)) & F.col("variable").isin(c.variables))

    def cluster(g, rng):
        units, points = K.feature_matrix(g)
        merges, apart = N.ward_merges(points), np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
        out = []
        for k in range(c.k_min, min(c.k_max, len(units) - 1) + 1):
            label = N.cut_merges(merges, len(points), k)
            score = float(N.silhouette(apart, label).mean()) if (g["rep"] == 0).all() else math.nan
            out += [{"unit": u, "k": k, "cluster": int(x), "silhouette": score} for u, x in zip(units, label, strict=True)]
        return out

    rows = K.drawn_years(data, c.bootstrap, c.seed).withColumn("r", F.col("rep")).select(F.col("r").alias("replicate"), "rep", "variable", "season", "year", "unit", "x", "value", "times")
    labels = written(S.grouped(rows, ["replicate"], "replicate int, unit string, k int, cluster int, silhouette double", cluster, seed=c.seed).withColumnRenamed("replicate", "rep"), "clusterings")
    stable = N.agreement(labels, "unit").groupBy("k").agg(F.avg("ari").alias("stability_ari"), F.percentile("ari", F.lit(0.1)).alias("stability_ari_p10"))
    score = labels.where("rep = 0").groupBy("k").agg(F.first("silhouette").alias("silhouette")).join(stable, "k", "left")
    best = score.agg(F.max_by("k", F.struct(F.round("silhouette", 12), -F.col("k"))).alias("best"))
    score = written(score.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("k") == F.col("best")).drop("best"), "cluster-score")  # best is one row

    own = labels.where("rep = 0").join(score.where("chosen").select("k"), "k").select("unit", F.col("cluster").alias("raw"))
    wide = t["cluster_feature"].groupBy("unit").pivot("feature").agg(F.first("r"))
    names = [x for x in wide.columns if x != "unit"]
    met = own.join(wide, "unit")
    lead = f"{c.variables[0]}_{K.NAMES[0]}"
    means = met.groupBy("raw").agg(*[F.avg(x).alias(x) for x in names], F.array_join(F.array_sort(F.collect_list("unit")), " ").alias("states"))
    order = means.select("raw", F.row_number().over(_alone().orderBy(lead, "raw")).alias("cluster"))  # a row a cluster
    sign = lambda x, up, down, none: F.when(F.col(x) > 0.05, up).when(F.col(x) < -0.05, down).otherwise(none) if x in names else F.lit(none)
    label = F.concat(sign(f"tmp_{K.NAMES[0]}", "warm", "cold", "mild"), F.lit(" and "), sign(f"pcpn_{K.NAMES[0]}", "wet", "dry", "ordinary"), F.lit(" winters of a warm ocean"))
    profile = means.join(order, "raw").withColumn("name", label).drop("raw")
    state = met.join(order, "raw").drop("raw").withColumnRenamed("unit", "state").join(profile.select("cluster", "name"), "cluster")
    return {"cluster_score": score, "cluster_profile": profile, "cluster_state": state}


def _alone():
    from pyspark.sql import Window

    return Window.partitionBy()


def analogs(t: Tables, cfg: Config) -> Tables:
    """The years whose index went most like the current year's so far, by time warping, with their winters."""
    a, rows = cfg.analog, index(t).where("x is not null")
    year, last = rows.agg(F.max(F.struct("year", "month")).alias("m")).select("m.year", "m.month").first()
    paths = written(E.trajectories(rows, a.start_month, last), "trajectories")
    asked = paths.where(F.col("winter") == year).select(F.lit(year).alias("q"), F.col("a").alias("qa"))
    found = N.nearest(R.in_blocks(paths.where(F.col("winter") != year), asked, "q"), "q", "winter", "qa", "a", a.band, a.top_k)
    pairs = found.join(paths, "winter").join(asked.drop("q"), F.lit(True))
    named = pairs.join(t["enso_winter"], "winter", "left")
    months = F.lit(f"{a.start_month}-{last}")
    return {"analog": named.select("rank", F.col("winter").alias("year"), "label", F.col("d").alias("dtw"), N.euclidean(F.col("a"), F.col("qa")).alias("euclidean"), "predictor", "djf", "category", months.alias("months"), "pruned")}


def families(t: Tables, cfg: Config) -> Tables:
    """Complete warm events by their two years' course, k-medoids over time warping distances. Events are few: one group."""
    rows = index(t).where("x is not null").withColumn("at", F.col("year") * 12 + F.col("month") - 1)
    first = F.year("peak_at") - (F.month("peak_at") < 7).cast("int")
    warm = t["enso_event"].where("phase = 'el_nino' and status = 'complete'").select("event_id", first.alias("year0"), "peak", "strength")
    steps = warm.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1)))).withColumn("at", F.col("year0") * 12 + F.col("step")).join(rows.select("at", "x"), "at")
    whole = steps.groupBy("event_id", "year0", "peak", "strength").agg(F.array_sort(F.collect_list(F.struct("step", "x"))).alias("p")).where(F.size("p") == STEPS)
    paths = written(whole.withColumn("a", F.transform("p", lambda v: v["x"])).drop("p"), "events")
    other = paths.select(F.col("event_id").alias("other"), F.col("a").alias("b"))
    table = R.in_blocks(paths, other, "other").select(F.lit("warm").alias("kind"), "event_id", "other", "year0", "peak", "strength", N.warping(cfg.analog.band)("a", "b").alias("d"))

    def grouped(g, rng):
        distance, head = g.pivot(index="event_id", columns="other", values="d").to_numpy(), g.groupby("event_id").first()
        n, best = len(head), None
        for k in range(2, min(cfg.analog.family_k_max, n - 1) + 1):
            centre, label, _ = N.medoids(distance, k, rng)
            score = float(N.silhouette(distance, label).mean())
            if np.bincount(label, minlength=k).min() >= LEAST_FAMILY and (best is None or score > best[2]):
                best = (centre, label, score)
        if best is None:  # too few events for families of their own
            centre, label, _ = N.medoids(distance, min(2, n), rng)
            best = (centre, label, float(N.silhouette(distance, label).mean()))
        centre, label, score = best
        order = np.argsort([-head["peak"].to_numpy()[label == c].mean() for c in range(len(centre))], kind="stable")
        name = {int(c): chr(ord("A") + k) for k, c in enumerate(order)}
        return [{"event_id": e, "year0": int(r.year0), "peak": float(r.peak), "strength": r.strength, "family": name[int(f)], "medoid": i in centre, "silhouette": score} for i, ((e, r), f) in enumerate(zip(head.iterrows(), label, strict=True))]

    found = S.grouped(table, ["kind"], "kind string, event_id string, year0 int, peak double, strength string, family string, medoid boolean, silhouette double", grouped, seed=5, order=["event_id", "other"]).drop("kind")
    course = paths.select("event_id", F.posexplode("a").alias("step", "value")).withColumn("month", F.col("step") % 12 + 1)
    return {"event_family": found, "event_trajectory": course}


def baskets(percent: DataFrame, winters: DataFrame, units: list[str], wet: list[str]) -> DataFrame:
    """winter, label, items: phase and strength of each winter, units colder or milder, wetter or drier than a third of winters.

    Winters in which all units' degree days are known. An item of strong winters that says the same as
    another phase item is left out.
    """
    own = percent.where((F.col("variable") == "hdd") & F.col("unit").isin(units) | (F.col("variable") == "pcpn") & F.col("unit").isin(wet)).where("pct is not null")
    whole = own.where("variable = 'hdd'").groupBy("winter").agg(F.count("*").alias("n")).where(F.col("n") == len(units)).select("winter").join(winters.select("winter"), "winter", "left_semi")
    own = own.join(F.broadcast(whole), "winter", "left_semi")
    cuts = own.groupBy("variable", "unit").agg(F.percentile("pct", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("c"))
    high, low = F.when(F.col("variable") == "hdd", "cold:").otherwise("wet:"), F.when(F.col("variable") == "hdd", "mild:").otherwise("dry:")
    item = F.when(F.col("pct") > F.col("c")[1], F.concat(high, "unit")).when(F.col("pct") < F.col("c")[0], F.concat(low, "unit"))
    third = own.join(cuts, ["variable", "unit"]).select("winter", item.alias("item")).where("item is not null")
    strong = F.col("category").startswith("strong") | F.col("category").startswith("very_strong")
    said = F.array_compact(F.array(F.concat(F.lit("enso="), "phase"), F.when(F.col("phase") != "neutral", F.concat(F.lit("enso="), "category")), F.when((F.col("phase") != "neutral") & strong, F.concat(F.lit("enso="), "phase", F.lit("_strong_plus")))))
    phase = winters.join(F.broadcast(whole), "winter", "left_semi").select("winter", F.explode(said).alias("item"))
    held = written(phase.groupBy("item").agg(F.array_sort(F.collect_list("winter")).alias("w")), "phases")
    same = held.where(F.col("item").endswith("_strong_plus")).select(F.col("item").alias("alias"), "w").join(held, "w").where("item <> alias").select(F.col("alias").alias("item"))
    items = third.unionByName(phase.join(same, "item", "left_anti"))
    return items.groupBy("winter").agg(F.array_sort(F.collect_set("item")).alias("items")).join(winters.select("winter", "label"), "winter")


def rules(t: Tables, cfg: Config) -> Tables:
    """Closed rules from a phase to what the winter brought, with a permutation p and q."""
    r, units = cfg.rules, [*cfg.regions, "US"]
    percent = K.winter_percent(long_climate(t, ["hdd", "pcpn"]), cfg.climate.anomaly_half_window)
    rows = written(baskets(percent, t["enso_winter"], units, r.precip_regions), "baskets")
    n = rows.count()
    sets = written(N.itemsets(rows, "items", max(2, math.ceil(r.min_support * n - 1e-9)), r.max_len), "itemsets")
    closed = N.closed_rules(N.rules(sets, n, "enso=", r.min_confidence, r.min_lift), rows, "winter", "items", "enso=").select("antecedent", "consequent", F.col("n").alias("count"), "hits")
    item = rows.select("winter", F.explode("items").alias("i"))
    times = item.groupBy(F.col("i").alias("antecedent")).agg(F.count("*").alias("antecedent_n"))
    want = closed.select("antecedent", "consequent", F.explode("consequent").alias("i")).join(item, "i")
    base = want.groupBy("antecedent", "consequent", "winter").agg(F.count("*").alias("k")).where(F.col("k") == F.size("consequent")).groupBy("antecedent", "consequent").agg(F.count("*").alias("consequent_n"))
    found = written(closed.join(times, "antecedent").join(base, ["antecedent", "consequent"]).withColumnRenamed("count", "n"), "rules")
    p = shuffle_p(found.select("antecedent", "consequent", "n", "antecedent_n"), rows, "winter", F.col("winter").cast("string"), r.permutations)
    labels = found.select("antecedent", "consequent", F.explode("hits").alias("winter")).join(rows.select("winter", "label"), "winter").groupBy("antecedent", "consequent").agg(F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("winters"))
    both = found.join(p.drop("n"), ["antecedent", "consequent"]).join(labels, ["antecedent", "consequent"])
    share, often = F.col("n") / F.col("antecedent_n"), F.col("consequent_n") / F.lit(max(n, 1))
    shown = both.select("antecedent", F.array_join("consequent", " & ").alias("consequent"), F.size("consequent").alias("size"), F.col("n").alias("count"), F.col("antecedent_n").alias("antecedent_count"), share.alias("confidence"), often.alias("base_rate"), (share / often).alias("lift"), "p", "winters")
    return {"rule_basket": rows.select("winter", "label", F.array_join("items", " ").alias("items")), "rule": S.with_q(shown, "p").withColumn("significant", F.col("q") <= r.fdr_q)}


def backtests(t: Tables, cfg: Config) -> Tables:
    """Hindcasts of winter degree days and sales by the chosen methods, and their scores."""
    f, half = cfg.forecast, cfg.climate.anomaly_half_window
    predictor = t["enso_winter"].where("predictor is not null").select("winter", F.col("predictor").alias("x"))
    rows = t["unit_climate"].select("unit", "year", "month", "days", "hdd", "cdd")
    sales = t["unit_sales"].where(F.col("sector") == f.sector).select("unit", "year", "month", "days", "sales_mwh")
    last = rows.agg(F.max("year")).first()[0] - 1
    methods = dict(bandwidth=f.bandwidth, least=f.min_ess, gate=f.gate, analogs=cfg.analog.top_k, interval=f.interval)
    spans = [list(range(first, last + 1)) for first in (f.first_climate_winter, f.first_sales_winter)]
    near = [E.trajectory_distances(index(t), years, cfg.analog.start_month, cfg.enso.predictor_month, cfg.analog.band) for years in spans]
    level = E.climate_hindcasts(rows, predictor, spans[0], half, **methods, distance=near[0])
    sold = E.sales_hindcasts(sales, rows, predictor, spans[1], list(f.billing_weights), half, f.train_years, f.data_through_month, **methods, distance=near[1], lags=f.hac_lags)
    found = level.withColumn("level", F.lit("climate")).unionByName(sold.withColumn("level", F.lit("sales")), allowMissingColumns=True)
    found = written(found.where(F.col("method").isin([*f.methods, "perfect_weather"])), "backtest")
    return {"backtest": found.withColumnRenamed("target", "winter"), "backtest_score": E.scores(found, predictor, cfg.enso.threshold, f.gate, f.bootstrap, f.seed)}


def outlook(t: Tables, cfg: Config) -> Tables:
    """The coming winter by level, unit and method, its scenarios, analogs and the sales model's terms."""
    f, half, target = cfg.forecast, cfg.climate.anomaly_half_window, cfg.outlook.winter
    cold = t["enso_winter"]
    predictor = cold.where("predictor is not null").select("winter", F.col("predictor").alias("x"))
    if not predictor.where(F.col("winter") == target).limit(1).count():
        raise ValueError(f"no predictor for the winter {target} yet")
    rows = t["unit_climate"].select("unit", "year", "month", "days", "hdd", "cdd")
    sales = t["unit_sales"].where(F.col("sector") == f.sector).select("unit", "year", "month", "days", "sales_mwh")
    near = written(E.trajectory_distances(index(t), [target], cfg.analog.start_month, cfg.enso.predictor_month, cfg.analog.band), "distances")
    given = (f.bandwidth, f.min_ess, f.gate, cfg.analog.top_k, near)
    known = E.by_target(rows.select("unit", "year", "month", F.col("hdd").alias("h"), F.col("cdd").alias("c")), [target], half)
    percent = written(E.percent_of_normal(known), "percent")
    members = written(E.members(percent, predictor, "value", *given), "members")
    climate = E.outlooks(members, None, f.interval).withColumn("level", F.lit("climate"))

    blended = E.billed(E.by_target(E.daily(sales, rows), [target], half), list(f.billing_weights))
    fits = written(E.fits(E.training(blended, f.train_years, f.data_through_month), list(f.billing_weights), f.hac_lags), "fits")
    winter = E.winters_of(blended, fits)
    spread = written(E.calibration(winter, fits, f.train_years), "spread")
    moved = E.members(E.effects(winter), predictor, "effect", *given)
    both = climate.unionByName(E.outlooks(moved, spread, f.interval).withColumn("level", F.lit("sales")))
    model = E.coefficients(fits).join(spread, E.KEYS).drop("target")

    djf = cold.where("djf is not null").select("winter", "djf")
    fan = percent.where((F.col("winter") < target) & F.col("value").isNotNull()).join(djf, "winter").withColumn("scenario_djf", F.explode(F.array(*map(F.lit, cfg.outlook.scenarios))))
    weighed = S.kernel_weights(fan, ["unit", "scenario_djf"], "djf", F.col("scenario_djf"), f.bandwidth, f.min_ess)

    def summed(g, rng):
        got = D.summary(g["value"].to_numpy(), g["w"].to_numpy(), 0.0, None, f.interval)
        return {k: float(got[k]) for k in ("mean", "lo", "median", "hi", "prob_above")} | {"ess": float(g["ess"].iloc[0])}

    scenario = S.grouped(weighed.select("unit", "scenario_djf", "winter", "value", "w", "ess"), ["unit", "scenario_djf"], "unit string, scenario_djf double, mean double, lo double, median double, hi double, prob_above double, ess double", summed, order=["winter"])
    analog = members.where("method = 'analog' and unit = 'US'").select("winter", F.col("value").alias("us_hdd_pct")).join(cold.select("winter", "label"), "winter")
    return {"outlook": both.where(F.col("method").isin(list(f.methods))).drop("target"), "outlook_member": members.drop("target"), "outlook_scenario": scenario, "outlook_analog": analog, "outlook_model": model}


def _season(rows: DataFrame, months: list[int], winter: bool, name: str) -> DataFrame:
    """market, winter, mean of the months, all of which must be there."""
    at = F.col("year") - (F.col("month") < 7).cast("int") if winter else F.col("year")
    return R.complete_mean(rows.where(F.col("month").isin(months)).withColumn("winter", at), ["market", "winter"], "value", len(months)).withColumnRenamed("mean", name)


def prices(t: Tables, cfg: Config) -> Tables:
    """Winter premiums of gas and hubs, their regression on degree days, and the premiums that the outlook draws."""
    pr, spark = cfg.prices, t["price_month"].sparkSession
    markets = spark.createDataFrame([("gas", "US"), *pr.hub_regions.items()], "market string, region string")
    gas = t["gas_month"].where(F.col("trading_days") >= pr.gas_min_days).select(F.lit("gas").alias("market"), "year", "month", F.col("henry_hub").alias("value"))
    rows = written(gas.unionByName(t["price_month"].where(F.col("hub").isin(list(pr.hub_regions))).select(F.col("hub").alias("market"), "year", "month", F.col("price").alias("value"))), "prices")
    percent = K.winter_percent(long_climate(t, ["hdd"]), cfg.climate.anomaly_half_window).select(F.col("unit").alias("region"), "winter", F.col("pct").alias("hdd_pct"))
    both = _season(rows, pr.fall_months, False, "fall").join(_season(rows, pr.winter_months, True, "winter_price"), ["market", "winter"])
    info = t["enso_winter"].select("winter", "label", "predictor", "djf", "phase", "category")
    table = both.join(F.broadcast(markets), "market").join(info, "winter").join(percent, ["region", "winter"], "left").withColumn("premium", 100 * F.ln(F.col("winter_price") / F.col("fall")))
    table = written(table, "premiums")

    known = table.where("premium is not null and hdd_pct is not null")
    enough = known.groupBy("market").agg(F.count("*").alias("n")).where(F.col("n") >= pr.min_winters).select("market")
    known = written(known.join(enough, "market", "left_semi"), "known")
    error = F.sqrt(F.regr_syy("premium", "hdd_pct") * (1 - F.pow(F.corr("premium", "hdd_pct"), 2)) / F.greatest(F.count("*") - 2, F.lit(1)))
    phases = ("el_nino", "neutral", "la_nina")
    means = [c for p in phases for c in (F.count_if(F.col("phase") == p).alias(f"{p}_n"), F.avg(F.when(F.col("phase") == p, F.col("premium"))).alias(f"{p}_mean"))]
    strong = F.col("category").isin("strong_el_nino", "very_strong_el_nino")
    told = [F.avg(F.when(strong, F.col("premium"))).alias("strong_el_nino_mean"), F.array_join(F.array_sort(F.collect_list(F.when(strong, F.col("label")))), ", ").alias("strong_el_nino_winters")]
    fit = known.groupBy("market", "region").agg(F.count("*").alias("winters"), F.min("winter").alias("first"), F.max("winter").alias("last"), F.regr_slope("premium", "hdd_pct").alias("slope_per_hdd_pct"), F.regr_intercept("premium", "hdd_pct").alias("intercept"), error.alias("resid_sd"), *means, *told)
    tested = permuted_correlation(known, ["market"], "winter", "hdd_pct", "premium", pr.permutations)
    limits = S.bootstrap(known, ["market", "phase"], F.col("premium"), F.lit(1.0), ["winter"], 2000, seed=pr.seed)
    wide = limits.groupBy("market").pivot("phase", list(phases)).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    summary = written(fit.join(tested, "market", "left").join(wide, "market", "left"), "premium-summary")

    members = t["outlook_member"].where(F.col("method").isin(list(cfg.forecast.methods))).select(F.col("unit").alias("region"), "method", "winter", "value", "weight", "x", "x0")
    each = members.join(summary.select("market", "region", "intercept", F.col("slope_per_hdd_pct").alias("slope"), "resid_sd", "winters"), "region").withColumn("key", F.xxhash64("market", "method")).withColumn("m", F.col("method"))

    def drawn(g, rng):
        first = g.iloc[0]
        mu, w, sigma = g["value"].to_numpy(), g["weight"].to_numpy(), 0.0
        if first["m"] == "linear":
            if len(g) < 3 or np.ptp(g["x"]) == 0:
                return []
            mean, sigma = D.linear_forecast(g["x"].to_numpy(), mu, float(first["x0"]))
            mu, w = np.array([mean]), np.ones(1)
        hdd = D.draws(mu, w, sigma, int(first["key"]), DRAWS, pr.seed)
        noise = D.draws(np.zeros(1), np.ones(1), float(first["resid_sd"]), int(first["key"]), DRAWS, pr.seed + 1)
        paid = float(first["intercept"]) + float(first["slope"]) * hdd + noise
        lo, mid, hi = map(float, np.quantile(paid, [0.1, 0.5, 0.9]))
        return {"region": first["region"], "hdd_median": float(np.median(hdd)), "premium_median": mid, "premium_lo": lo, "premium_hi": hi, "prob_premium_negative": float((paid < 0).mean()), "slope": float(first["slope"]), "resid_sd": float(first["resid_sd"]), "winters": int(first["winters"])}

    schema = "market string, method string, region string, hdd_median double, premium_median double, premium_lo double, premium_hi double, prob_premium_negative double, slope double, resid_sd double, winters long"
    price = S.grouped(each, ["market", "method"], schema, drawn, order=["winter"])
    return {"price_premium": table, "price_premium_summary": summary, "outlook_price": price}


def hydro(t: Tables, cfg: Config) -> Tables:
    """A hub's spread over another by month against the rain before and the index, and its springs."""
    pr = cfg.prices
    wet = K.winter_percent(long_climate(t, ["pcpn"]).where(F.col("unit").isin(pr.hydro_states)), cfg.climate.anomaly_half_window, pr.hydro_precip_months)
    basin = wet.groupBy("winter").agg(F.avg("pct").alias("precip"), F.count("pct").alias("n")).where(F.col("n") == len(set(pr.hydro_states))).drop("n")
    of = lambda hub, name: t["price_month"].where(F.col("hub") == hub).select("year", "month", F.col("price").alias(name))
    spread = of(pr.hydro_hub, "a").join(of(pr.hydro_reference, "b"), ["year", "month"]).select("year", "month", (100 * F.ln(F.col("a") / F.col("b"))).alias("spread")).where("spread is not null")
    usual = spread.groupBy("month").agg(F.avg("spread").alias("usual"))
    rows = spread.join(usual, "month").select((F.col("year") - 1).alias("winter"), "month", "spread", (F.col("spread") - F.col("usual")).alias("anomaly"))
    info = t["enso_winter"].select("winter", "label", "djf", "phase")
    both = written(rows.join(basin, "winter", "left").join(info, "winter"), "hydro")
    drivers = R.melted(both.where(F.col("month") <= pr.hydro_max_lag).where("precip is not null and djf is not null").select("winter", "month", "anomaly", "precip", "djf"), ["winter", "month", "anomaly"], ["precip", "djf"], "driver", "x")
    drivers = written(drivers, "drivers")
    fit = drivers.groupBy("driver", "month").agg(F.count("*").alias("winters"), F.regr_slope("anomaly", "x").alias("slope"))
    lag = S.with_q(fit.join(permuted_correlation(drivers, ["driver", "month"], "winter", "x", "anomaly", pr.permutations), ["driver", "month"]), "p")
    spring = R.complete_mean(both.where(F.col("month").between(4, 7)), ["winter", "label", "precip", "djf", "phase"], "spread", 4)
    return {"hydro_lag": lag, "hydro_season": spring.where("precip is not null").select("winter", F.col("mean").alias("spring_spread"), "label", F.col("precip").alias("precip_pct"), "djf", "phase")}


STAGES = [
    Stage("calendar", ("enso_month",), ("enso_event", "enso_winter"), calendar),
    Stage("field", ("enso_month", "unit_climate"), ("teleconnection", "teleconnection_summary"), field),
    Stage("seasons", ("enso_month", "unit_climate"), ("season", "fingerprint", "cluster_feature"), seasons),
    Stage("clusters", ("season", "cluster_feature"), ("cluster_score", "cluster_profile", "cluster_state"), clusters),
    Stage("analogs", ("enso_month", "enso_winter"), ("analog",), analogs),
    Stage("families", ("enso_month", "enso_event"), ("event_family", "event_trajectory"), families),
    Stage("rules", ("unit_climate", "enso_winter"), ("rule_basket", "rule"), rules),
    Stage("backtests", ("enso_month", "enso_winter", "unit_climate", "unit_sales"), ("backtest", "backtest_score"), backtests),
    Stage("outlook", ("enso_month", "enso_winter", "unit_climate", "unit_sales"), ("outlook", "outlook_member", "outlook_scenario", "outlook_analog", "outlook_model"), outlook),
    Stage("prices", ("price_month", "gas_month", "unit_climate", "enso_winter", "outlook_member"), ("price_premium", "price_premium_summary", "outlook_price"), prices),
    Stage("hydro", ("price_month", "unit_climate", "enso_winter"), ("hydro_lag", "hydro_season"), hydro),
]


def run(spark: SparkSession, cfg: Config, folder: str, stages: list[Stage] | None = None, resume: bool = False) -> Tables:
    """All current tables after the stages; each stage's are saved when it ends, with `resume` only those not there yet."""
    for stage in stages or STAGES:
        there = warehouse.tables(spark, folder)
        if resume and set(stage.makes) <= set(there):
            continue
        if lost := [n for n in stage.needs if n not in there]:
            raise ValueError(f"{stage.name} needs the tables {', '.join(lost)}")
        made = stage.make(there, cfg)
        if set(made) != set(stage.makes):
            raise ValueError(f"{stage.name} makes other tables than it names")
        warehouse.save(made, folder, add=True)
    return warehouse.tables(spark, folder)
