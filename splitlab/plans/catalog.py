"""Every operator bound to the test tables, one query per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitlab.functions.coerce import coerce_cells, coerce_columns
from splitlab.functions.odds import CLAMPS
from splitlab.functions.outcomes import FINE_OUTCOMES, OUTCOMES, not_other
from splitlab.operators import (
    bins, boards, design, estimates, plate, rates, regress, seasonal, solvers, spread,
)
from splitlab.operators.ranking import ordinal_in_group
from splitlab.plans import testbed
from splitlab.session import written
from splitlab.sources import html_tables, readers

Query = Callable[[SparkSession, str], DataFrame]
METRICS = ("AVG", "OBP", "WOBA", "FIP")


def rounded(df: DataFrame, columns=None, digits: int = 12) -> DataFrame:
    """DOUBLE columns rounded, so that two engines' last bits do not matter."""
    names = [n for n, t in df.dtypes if t == "double" and (columns is None or n in columns)]
    return df.withColumns({n: F.round(F.col(f"`{n}`"), digits) for n in names})


def batting(
    spark: SparkSession, sf_dir: str, vocabulary: str = "coarse", sites: bool = False
) -> DataFrame:
    """Plate events of the test tables; ``sites`` for queries that read gamesite.

    The derived games are then written first: computed once, and of known size.
    """
    games = testbed.games(spark, sf_dir)
    if sites:
        games = written(games, "games")
    return plate.plate_events(testbed.plays(spark, sf_dir), games, testbed.ORDER, vocabulary)


def kept(spark: SparkSession, sf_dir: str, sites: bool = False) -> DataFrame:
    return batting(spark, sf_dir, sites=sites).filter(not_other())


def plate_events(spark, sf_dir):
    return batting(spark, sf_dir, sites=True).select(
        *testbed.ORDER, "season", "gameid", "gamesite", "batter", "pitcher", "batterhand",
        "pitcherhand", "event", "timesthrough", "pitbathand",
    )


def rates_by(split: str) -> Query:
    def query(spark, sf_dir):
        events = batting(spark, sf_dir, sites="gamesite" in split)
        table = rates.rate_table(events, split, testbed.constants(spark))
        return rounded(table.select("season", split, "PA", *OUTCOMES, *METRICS))

    return query


def rates_v1_by(split) -> Query:
    def query(spark, sf_dir):
        events = batting(spark, sf_dir, sites="gamesite" in split)
        return rounded(rates.fixed_rate_table(events, split))

    return query


def rates_all_splits(spark, sf_dir):
    return rounded(rates.split_rates(batting(spark, sf_dir, sites=True)))


def rates_fine(spark, sf_dir):
    table = rates.fine_table(batting(spark, sf_dir, "fine"), "batter", minpa=10)
    return rounded(
        table.select("season", "batter", "PA", "AB", *FINE_OUTCOMES, "BA", "OBP", "WOBA"), digits=12
    )


def fine_percentages(spark, sf_dir):
    return rounded(rates.fine_percentages(batting(spark, sf_dir, "fine"), "batter", minpa=10))


def event_freq(spark, sf_dir):
    return rounded(rates.event_freq(kept(spark, sf_dir)))


def event_freq_of_all(spark, sf_dir):
    return rounded(rates.event_freq_of_all(batting(spark, sf_dir), ["season"]))


def event_freq_by_season(spark, sf_dir):
    return rounded(rates.season_freq(batting(spark, sf_dir)))


def fip_by_season_tto(spark, sf_dir):
    table = rates.rate_table(batting(spark, sf_dir), "timesthrough", testbed.constants(spark))
    series = rates.metric_by_season(table, "timesthrough", "FIP", [0, 1, 2])
    return rounded(series.select("season", *[F.col(f"`{t}`").alias(f"tto_{t}") for t in range(3)]))


def meeting_number(spark, sf_dir):
    met = plate.meeting_number(batting(spark, sf_dir), testbed.ORDER)
    return met.select(*testbed.ORDER, "gameid", "batter", "pitcher", "meeting")


def event_meeting_number(spark, sf_dir):
    events = testbed.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return ordinal_in_group(events, ["user_id", "event_type"], ["event_id"], "meeting")


def matchup_counts(spark, sf_dir):
    return rates.matchup_counts(batting(spark, sf_dir))


def events_nonnull(spark, sf_dir):
    return rates.present_count(batting(spark, sf_dir), "event")


def pitches(spark, sf_dir):
    thrown = testbed.pitches(spark, sf_dir)
    found = readers.pitches_between(thrown, "1996-02-01", "1998-04-23")
    return found.select("index", "game_date", "batter", "pitcher", "events", "p_throws")


def top_batters(spark, sf_dir):
    table = rates.rate_table(batting(spark, sf_dir), "batter", testbed.constants(spark), minpa=20)
    table = boards.named(table, testbed.batter_names(spark, sf_dir), "batter", how="inner")
    table = rounded(table.select("season", "batter", "Name", "PA", "WOBA"))
    return boards.top(table, "WOBA", 20, ["season", "batter"])


def bottom_pitchers(spark, sf_dir):
    table = rates.rate_table(batting(spark, sf_dir), "pitcher", testbed.constants(spark), minpa=20)
    table = boards.named(table, testbed.people(spark, sf_dir), "pitcher")
    table = rounded(table.select("season", "pitcher", "Name", "PA", "FIP"))
    return boards.bottom(table, "FIP", 20, ["season", "pitcher"])


def park_rates(spark, sf_dir):
    table = rates.rate_table(batting(spark, sf_dir, sites=True), "gamesite", testbed.constants(spark))
    table = boards.placed(table, testbed.parks(spark, sf_dir))
    return rounded(table.select("season", "gamesite", "NAME", "PA", *OUTCOMES, *METRICS))


def rate_spread(spark, sf_dir):
    return rounded(spread.rate_spread(batting(spark, sf_dir, sites=True)))


def level_freq(spark, sf_dir):
    return rounded(spread.level_freq(batting(spark, sf_dir, sites=True)))


def weighted_split_means(spark, sf_dir):
    return rounded(spread.weighted_means(rates.split_rates(batting(spark, sf_dir, sites=True))))


def rates_long(spark, sf_dir):
    return rounded(rates.long_rates(rates.split_rates(batting(spark, sf_dir, sites=True))))


def rates_wide(spark, sf_dir):
    freq = spread.level_freq(batting(spark, sf_dir, sites=True)).withColumnRenamed("frac", "value")
    return rounded(rates.wide_rates(freq, values=OUTCOMES))


def freq_grid(spark, sf_dir):
    """Class shares of every level of all splits with every outcome, absent pairs 0."""
    freq = spread.level_freq(batting(spark, sf_dir, sites=True))
    return rounded(rates.complete_grid(freq, "frac"))


def dh_value(spark, sf_dir):
    board = boards.leaderboard(testbed.season_lines(spark, sf_dir), 1996, 2000, minpa=3)
    valued = boards.dh_value(board, positive_only=True)
    columns = ("Name", "Season", "G", "Def", "WAR", "DefDH", "DefImp", "DefImp162")
    return boards.top(rounded(valued.select(*columns), digits=9), "DefImp", 25, ["Name", "Season"])


def _dh_board(spark, sf_dir, **scope):
    board = boards.leaderboard(testbed.season_lines(spark, sf_dir), **scope)
    return rounded(boards.dh_value(board, positive_only=True), digits=9)


def dh_value_full_season(spark, sf_dir):
    """The same study by value over 162 games."""
    board = _dh_board(spark, sf_dir, first=1996, last=2000, minpa=3)
    columns = ("Name", "Season", "G", "Def", "WAR", "DefDH", "DefImp", "DefImp162")
    return boards.top(board.select(*columns), "DefImp162", 25, ["Name", "Season"])


def dh_value_full_career(spark, sf_dir):
    board = _dh_board(spark, sf_dir, first=1900, last=2100, by_season=False, minpa=10)
    columns = ("Name", "G", "Def", "WAR", "DefDH", "DefImp", "DefImp162")
    return boards.top(board.select(*columns), "DefImp162", 25, ["Name"])


def dh_value_ordered(spark, sf_dir):
    """The whole board in order, for every player and season."""
    board = _dh_board(spark, sf_dir, first=1900, last=2100)
    columns = ("Name", "Season", "G", "Def", "WAR", "DefImp", "DefImp162")
    return boards.ordered(board.select(*columns), "DefImp", True, ["Name", "Season"])


def dh_value_career(spark, sf_dir):
    lines = testbed.season_lines(spark, sf_dir)
    board = boards.leaderboard(lines, 1900, 2100, by_season=False, minpa=10)
    valued = boards.dh_value(board, positive_only=True)
    return rounded(valued.select("Name", "G", "Def", "WAR", "DefDH", "DefImp", "DefImp162"), digits=9)


def overrated(spark, sf_dir):
    lines = testbed.season_lines(spark, sf_dir)
    board = boards.leaderboard(lines, 1900, 2100, teams=["BUILDING", "MACHINERY"])
    board = boards.overrated(board.drop("G", "PA", "Def"))
    return boards.bottom(rounded(board, digits=9), "Bat_RBI", 20, ["Name", "Season"])


def overrated_by_runs(spark, sf_dir):
    """The other list of the study: runs created less runs batted in."""
    board = boards.leaderboard(testbed.season_lines(spark, sf_dir), 1900, 2100)
    board = boards.overrated(board).select("Name", "Season", "RBI", "wRC", "WAR", "wRC_RBI")
    return boards.bottom(rounded(board, digits=9), "wRC_RBI", 20, ["Name", "Season"])


def hand_matchup_counts(spark, sf_dir):
    """Match-ups by hands, some of which are missing."""
    return rates.matchup_counts(batting(spark, sf_dir), ("season", "pitbathand", "pitcher"))


def rates_all_splits_by_season(spark, sf_dir):
    """Rates of all splits, each season for itself, in one scan."""
    table = rates.split_rates(batting(spark, sf_dir, sites=True), extra=["season"])
    return rounded(table.select("season", "split", "level", "PA", *OUTCOMES))


def hist_estimates(spark, sf_dir):
    _, made = _shrunk(spark, sf_dir, "share")
    long = rates.long_rates(rounded(made, digits=9), ("split", "level"), OUTCOMES)
    return rounded(bins.histogram(long))


def pa_check(spark, sf_dir):
    counts = rates.fine_counts(batting(spark, sf_dir, "fine"), "batter", minpa=10)
    board = counts.select(
        "season", "batter", "PA", "AB", F.col("SNGL").alias("1B"), F.col("DBL").alias("2B"),
        F.col("TRPL").alias("3B"), "HR", (F.col("UBB") + F.col("IBB")).alias("BB"), "IBB",
        F.col("K").alias("SO"), "HBP", "SF", "SH",
    )
    return boards.pa_check(board).select("season", "batter", "PA", "AB", "xPA")


def gram(spark, sf_dir):
    return design.gram(batting(spark, sf_dir, sites=True))


def xty(spark, sf_dir):
    sums = design.xty(batting(spark, sf_dir, sites=True))
    return rounded(rates.long_rates(sums, values=OUTCOMES), digits=6)


def long_design(spark, sf_dir):
    return design.long_design(kept(spark, sf_dir, sites=True), testbed.ORDER)


def centred_outcomes(spark, sf_dir):
    events = kept(spark, sf_dir)
    rows = design.residual_outcomes(events, design.event_means(events), "share")
    return rounded(rows.select(*testbed.ORDER, *OUTCOMES), digits=9)


def logit_outcomes(spark, sf_dir):
    events = kept(spark, sf_dir)
    rows = design.residual_outcomes(events, design.event_means(events), "logit")
    return rounded(rows.select(*testbed.ORDER, *OUTCOMES), digits=9)


def class_weights(spark, sf_dir):
    return rounded(design.class_weights(batting(spark, sf_dir)))


def balanced_weights(spark, sf_dir):
    return rounded(design.class_weights(batting(spark, sf_dir), "balanced"))


def _counts(events: DataFrame) -> DataFrame:
    return written(design.level_counts(events), "counts")


def shrunk_means(spark, sf_dir):
    return rounded(regress.shrunken_means(_counts(batting(spark, sf_dir, sites=True)), 100.0), digits=9)


def ridge_single_split(spark, sf_dir):
    """The iterative solver where a closed form exists."""
    effects = regress.ridge(batting(spark, sf_dir), 100.0, ["batter"])
    return rounded(effects, digits=7)


def shrunk_by_season(spark, sf_dir):
    """Effects of every split, each season for itself, in closed form."""
    counts = written(seasonal.season_counts(batting(spark, sf_dir, sites=True)), "counts")
    return rounded(seasonal.shrunken_by_season(counts, 100.0), digits=9)


def ridge_by_season(spark, sf_dir):
    """The solver of all seasons at once, where each of them has a closed form."""
    effects = seasonal.ridge_by_season(batting(spark, sf_dir), 100.0, ["batter"])
    return rounded(effects, digits=7)


def _season_board(spark, sf_dir, split):
    counts = written(seasonal.season_counts(batting(spark, sf_dir), [split]), "counts")
    made = seasonal.probabilities_by_season(seasonal.shrunken_by_season(counts, 100.0), counts)
    return rounded(seasonal.season_board(made, counts, testbed.constants(spark), split), digits=9)


def est_top_batters_by_season(spark, sf_dir):
    """The best batters of every season, by the weights of that season."""
    board = _season_board(spark, sf_dir, "batter").filter(F.col("PA") >= 20)
    return seasonal.top_of_season(board, "WOBA", 5, ["batter"])


def est_bottom_pitchers_by_season(spark, sf_dir):
    board = _season_board(spark, sf_dir, "pitcher").filter(F.col("PA") >= 20)
    return seasonal.top_of_season(board, "FIP", 5, ["pitcher"], ascending=True)


def _small(gap_columns, allowed):
    worst = F.greatest(*[F.abs(column) for column in gap_columns])
    return worst <= allowed


def ridge_check(spark, sf_dir):
    """Stationarity of ridge: X'(y - Xb) = alpha b."""
    events = batting(spark, sf_dir, sites=True)
    made = regress.system(events)
    gap = regress.normal_gap(events, regress.ridge(events, 1.0, made=made), made=made)
    solvers.released(made.left)
    slack = [F.col(e) - 1.0 * F.col(f"b_{e}") for e in OUTCOMES]
    return gap.select("split", "level", "n", _small(slack, 1e-6 * F.col("n")).alias("ok"))


def ridge_logit_check(spark, sf_dir):
    events = batting(spark, sf_dir, sites=True)
    made = regress.system(events, space="logit")
    gap = regress.normal_gap(events, regress.ridge(events, 100.0, made=made), made=made)
    solvers.released(made.left)
    slack = [F.col(e) - 100.0 * F.col(f"b_{e}") for e in OUTCOMES]
    return gap.select("split", "level", "n", _small(slack, 1e-5 * F.col("n")).alias("ok"))


def minnorm_check(spark, sf_dir):
    """Normal equations of the least-norm solution: X'(y - Xb) = 0."""
    events = batting(spark, sf_dir, sites=True)
    made = regress.system(events, space="logit")
    gap = regress.normal_gap(events, regress.min_norm(events, made=made), made=made)
    solvers.released(made.left)
    slack = [F.col(e) for e in OUTCOMES]
    ok = _small(slack, 1e-5 * F.col("n")) & _least_norm(gap)
    return gap.select("split", "level", "n", ok.alias("ok"))


def _least_norm(gap: DataFrame, tau: dict[str, float] | None = None):
    """Whether effects are orthogonal to the null space of the design.

    Splits without missing levels each add up to the column of ones, so their sums of effects,
    over their factors, must be equal; plain least squares does not keep them so.
    """
    factor = F.create_map(*[F.lit(x) for pair in (tau or dict.fromkeys(plate.MODEL_SPLITS, 1.0)).items() for x in pair])
    sums = gap.groupBy("split").agg(F.sum("n").alias("n"), *[F.sum(f"b_{e}").alias(e) for e in OUTCOMES])
    whole = sums.withColumns({e: F.col(e) / factor[F.col("split")] for e in OUTCOMES})
    most = sums.agg(F.max("n").alias("n")).scalar()
    spread = [F.max(e) - F.min(e) for e in OUTCOMES]
    return whole.filter(F.col("n") == most).agg((F.greatest(*spread) <= 1e-4).alias("ok")).scalar()


TAU = {"batter": 3.0, "pitcher": 2.0, "gamesite": 1.0, "timesthrough": 5.0, "pitbathand": 1.0}


def tau_check(spark, sf_dir):
    events = batting(spark, sf_dir, sites=True)
    made = regress.system(events, space="logit", clamp_pair=CLAMPS["wide"], tau=TAU)
    gap = regress.normal_gap(events, regress.min_norm(events, made=made), made=made)
    solvers.released(made.left)
    slack = [F.col(e) for e in OUTCOMES]
    ok = _small(slack, 1e-4 * F.col("n")) & _least_norm(gap, TAU)
    return gap.select("split", "level", "n", ok.alias("ok"))


def lasso_check(spark, sf_dir):
    """Subgradient of lasso: |X'(y - Xb) / N| <= alpha, with equality where b is not 0."""
    alpha = 0.1
    events = batting(spark, sf_dir, sites=True)
    made = regress.system(events, space="logit")
    gap = regress.normal_gap(events, regress.lasso(events, alpha, made=made), made=made)
    solvers.released(made.left)
    total = made.counts.filter(F.col("split") == rates.TOTAL).select(F.col("n").cast("double")).scalar()
    slack = []
    for e in OUTCOMES:
        pull, b = F.col(e) / total, F.col(f"b_{e}")
        slack.append(
            F.when(b == 0, F.greatest(F.abs(pull) - alpha, F.lit(0.0))).otherwise(
                pull - alpha * F.signum(b)
            )
        )
    return gap.select("split", "level", "n", _small(slack, F.lit(1e-4)).alias("ok"))


def ols_fit(spark, sf_dir):
    """Fitted totals of plain least squares equal observed totals per level."""
    events = batting(spark, sf_dir, sites=True)
    made = regress.system(events, space="logit")
    gap = regress.normal_gap(events, regress.least_squares(events, made=made), made=made)
    solvers.released(made.left)
    slack = [F.col(e) for e in OUTCOMES]
    return gap.select("split", "level", "n", _small(slack, 1e-4 * F.col("n")).alias("ok"))


def _logistic(spark, sf_dir, splits, weighted):
    events = batting(spark, sf_dir, sites="gamesite" in splits)
    made = design.equal_events(events, splits)
    weights = written(design.class_weights(events, made=made), "weights") if weighted else None
    packed = regress.in_blocks(made, splits)
    effects, intercepts = regress.multinomial(events, splits, weights, made=made, packed=packed)
    gap = regress.multinomial_gap(events, effects, intercepts, splits, weights, made=made, packed=packed)
    slack = [F.col(c) for c in effects.columns[2:]]
    return gap.select("split", "level", "n", _small(slack, 1e-4 * F.col("n")).alias("ok"))


def logistic_check(spark, sf_dir):
    """Gradient of the unweighted two-split multinomial fit."""
    return _logistic(spark, sf_dir, ["batter", "pitcher"], False)


def weighted_logistic_check(spark, sf_dir):
    """Gradient of the weighted five-split multinomial fit."""
    return _logistic(spark, sf_dir, list(plate.MODEL_SPLITS), True)


def logistic_shares(spark, sf_dir):
    """Mean fitted shares of the two-split fit; they equal the observed ones."""
    events, splits = batting(spark, sf_dir), ["batter", "pitcher"]
    made = design.equal_events(events, splits)
    effects, intercepts = regress.multinomial(events, splits, made=made)
    return rounded(regress.fitted_shares(events, effects, intercepts, splits, made=made), digits=5)


def lasso_single_split(spark, sf_dir):
    """The lasso solver where a closed form exists."""
    effects = regress.lasso(batting(spark, sf_dir), 0.005, ["batter"])
    return rounded(effects, digits=5)


def logistic_means(spark, sf_dir):
    """Model means from the intercepts next to observed shares."""
    events = batting(spark, sf_dir)
    _, intercepts = regress.multinomial(events, ["batter", "pitcher"])
    return estimates.mean_ratio(intercepts, rates.event_freq(events.filter(not_other())))


def gram_rank(spark, sf_dir):
    return solvers.gram_rank(design.gram(batting(spark, sf_dir, sites=True)))


def _shrunk(spark, sf_dir, space):
    events = batting(spark, sf_dir, sites=True)
    counts = _counts(events)
    effects = regress.shrunken_means(counts, 100.0, space)
    return counts, estimates.to_probabilities(effects, design.means_of_counts(counts), space)


def estimates_share(spark, sf_dir):
    _, made = _shrunk(spark, sf_dir, "share")
    return rounded(estimates.with_total(made), digits=9)


def estimates_logit(spark, sf_dir):
    """Log-odds effects back in probabilities, scaled to sum to one."""
    _, made = _shrunk(spark, sf_dir, "logit")
    return rounded(estimates.normalise(made), digits=9)


def estimates_odds(spark, sf_dir):
    counts = _counts(batting(spark, sf_dir, sites=True))
    effects = regress.shrunken_means(counts, 100.0, "logit")
    made = estimates.to_odds(effects, design.means_of_counts(counts))
    return rounded(spread.estimate_spread(made).select("split", "event", "mean"), digits=9)


def estimates_ridge(spark, sf_dir):
    events = batting(spark, sf_dir, sites=True)
    made = estimates.to_probabilities(regress.ridge(events, 1.0), design.event_means(events))
    return rounded(estimates.with_total(made), digits=6)


def est_vs_obs(spark, sf_dir):
    counts, made = _shrunk(spark, sf_dir, "share")
    both = estimates.observed_and_estimated(design.rates_of_counts(counts), made)
    return rounded(both, digits=9)


def est_vs_obs_long(spark, sf_dir):
    counts, made = _shrunk(spark, sf_dir, "share")
    return rounded(estimates.long_comparison(design.rates_of_counts(counts), made), digits=9)


def est_spread(spark, sf_dir):
    _, made = _shrunk(spark, sf_dir, "share")
    return rounded(spread.estimate_spread(made), digits=9)


def est_shrinkage(spark, sf_dir):
    _, made = _shrunk(spark, sf_dir, "share")
    return rounded(spread.shrinkage(made, batting(spark, sf_dir, sites=True)), digits=9)


def mean_fitted(spark, sf_dir):
    counts, made = _shrunk(spark, sf_dir, "share")
    return rounded(estimates.mean_over_events(counts, made), digits=9)


def _stored_events(spark, sf_dir):
    """Kept events with what lookups by level read, written once: a table of levels and the lookups both read them."""
    events = kept(spark, sf_dir, sites=True)
    return written(events.select(*testbed.ORDER, *plate.MODEL_SPLITS, "event"), "events")


def fitted_values(spark, sf_dir):
    """X b per event, from the closed-form effects."""
    events = _stored_events(spark, sf_dir)
    effects = regress.shrunken_means(_counts(events), 100.0)
    rows = estimates.fitted(events, effects)
    return rounded(rows.select(*testbed.ORDER, *OUTCOMES), digits=9)


def star_rates(spark, sf_dir):
    events = _stored_events(spark, sf_dir)
    joined = estimates.star_rates(events, rates.split_rates(events))
    made = [f"{s}_{e}" for s in plate.MODEL_SPLITS for e in OUTCOMES]
    return rounded(joined.select(*testbed.ORDER, "event", *made))


def _estimated(spark, sf_dir, split):
    counts, made = _shrunk(spark, sf_dir, "share")
    return estimates.estimated_board(made, counts, testbed.constants(spark), 2000, split)


def est_top_batters(spark, sf_dir):
    board = boards.named(_estimated(spark, sf_dir, "batter"), testbed.batter_names(spark, sf_dir), "batter")
    board = board.filter(F.col("PA") >= 100)
    columns = ("batter", "Name", "PA", *OUTCOMES, *METRICS)
    return boards.top(rounded(board.select(*columns), digits=9), "WOBA", 10, ["batter"])


def est_bottom_pitchers(spark, sf_dir):
    board = boards.named(_estimated(spark, sf_dir, "pitcher"), testbed.people(spark, sf_dir), "pitcher")
    board = board.filter(F.col("PA") >= 100)
    columns = ("pitcher", "Name", "PA", *OUTCOMES, *METRICS)
    return boards.bottom(rounded(board.select(*columns), digits=9), "FIP", 10, ["pitcher"])


def est_parks(spark, sf_dir):
    board = boards.placed(_estimated(spark, sf_dir, "gamesite"), testbed.parks(spark, sf_dir))
    return rounded(board.select("gamesite", "NAME", *OUTCOMES, "WOBA", "FIP"), digits=9)


def _long_values(spark, sf_dir):
    table = rates.split_rates(batting(spark, sf_dir, sites=True))
    long = rates.long_rates(table, ("split", "level", "PA"), OUTCOMES)
    return long


def hist(spark, sf_dir):
    return rounded(bins.histogram(_long_values(spark, sf_dir)))


def weighted_hist(spark, sf_dir):
    return rounded(bins.histogram(_long_values(spark, sf_dir), 50, "PA"))


def bins2d(spark, sf_dir):
    counts, made = _shrunk(spark, sf_dir, "share")
    both = estimates.observed_and_estimated(design.rates_of_counts(counts), made)
    return bins.bins2d(rounded(both, digits=9), "SNGL_obs", "HR_obs", 8)


def hexbins(spark, sf_dir):
    counts, made = _shrunk(spark, sf_dir, "share")
    both = estimates.observed_and_estimated(design.rates_of_counts(counts), made)
    return rounded(bins.hexbins(rounded(both, digits=9), "SNGL_obs", "HR_obs", 9), digits=9)


def kde2d(spark, sf_dir):
    table = rates.split_rates(batting(spark, sf_dir, sites=True))
    return rounded(bins.kde2d(table, "SNGL", "HR", "PA", 0.02), digits=9)


def binned_density(spark, sf_dir):
    table = rounded(rates.split_rates(batting(spark, sf_dir, sites=True)).select("split", "SNGL", "HR", "PA"), digits=9)
    made = bins.binned_density(table, "SNGL", "HR", "PA", 0.02)
    # grid points may lie half-way between two digits; products are rounded there as in SQL, F.round goes by the digits
    return made.withColumns({n: F.round(F.col(n) * 1e8) / 1e8 for n, t in made.dtypes if t == "double"})


def html_cells(spark, sf_dir):
    pages = testbed.board_pages(spark, sf_dir)
    return html_tables.leaderboard_cells(html_tables.table_cells(pages, testbed.BOARD_ID))


def html_promoted(spark, sf_dir):
    pages = testbed.board_pages(spark, sf_dir)
    # stored, so that pages are read once although two of its parts are joined
    grid = written(html_tables.table_cells(pages, testbed.BOARD_ID), "cells")
    return html_tables.promote_header(grid)


def html_table(spark, sf_dir):
    rows = html_tables.table_rows(html_cells(spark, sf_dir), testbed.BOARD_COLUMNS)
    return coerce_cells(rows, ["#", "Nation", "Balance"])


def coerced_columns(spark, sf_dir):
    return coerce_columns(testbed.text_columns(spark, sf_dir))


def coerced_cells(spark, sf_dir):
    return coerce_cells(testbed.text_columns(spark, sf_dir), ["number", "mixed", "word"])


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {"plate_events": plate_events}
    for split in plate.SPLITS:
        found[f"rates_by_{split}"] = rates_by(split)
        found[f"rates_v1_by_{split}"] = rates_v1_by(split)
    found["rates_two_key"] = rates_v1_by(["pitcherhand", "batterhand"])
    for query in (
        rates_all_splits, rates_fine, fine_percentages, event_freq, event_freq_of_all,
        event_freq_by_season, fip_by_season_tto, meeting_number, event_meeting_number,
        matchup_counts, events_nonnull, pitches, top_batters, bottom_pitchers, park_rates,
        rate_spread, level_freq, freq_grid, weighted_split_means, rates_long, rates_wide, dh_value,
        dh_value_career, overrated, pa_check, gram, xty, long_design, centred_outcomes,
        logit_outcomes, class_weights, balanced_weights, shrunk_means, ridge_single_split,
        ridge_check, ridge_logit_check, minnorm_check, tau_check, lasso_check, ols_fit,
        logistic_check, weighted_logistic_check, logistic_means, gram_rank, estimates_share,
        estimates_logit, estimates_odds, estimates_ridge, est_vs_obs, est_vs_obs_long,
        est_spread, est_shrinkage, mean_fitted, fitted_values, star_rates, est_top_batters,
        est_bottom_pitchers, est_parks, hist, weighted_hist, bins2d, kde2d, html_cells,
        html_promoted, html_table, coerced_columns, coerced_cells, dh_value_full_season,
        dh_value_full_career, dh_value_ordered, overrated_by_runs, hand_matchup_counts,
        rates_all_splits_by_season, hist_estimates, logistic_shares, lasso_single_split,
        shrunk_by_season, ridge_by_season, est_top_batters_by_season, est_bottom_pitchers_by_season, hexbins,
        binned_density,
    ):
        found[query.__name__] = query
    return found
