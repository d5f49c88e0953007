"""Topic profiles, correlation with indicators, association rules, gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plenum.functions import text as tx
from plenum.functions.text import direction
from plenum.operators.rollcall import SUBSTANTIAL, affiliation, cast_votes, open_end, share, with_subject
from plenum.plans.model import TOPICS as TOPIC_ORDER
from plenum.plans.model import Model
from plenum.session import saved


def party_main_group(m: Model) -> DataFrame:
    """term, party, grp: the group of most of a national party's members in the term; ties to the lowest."""
    over = lambda a, b: (F.col(f"{a}_from") <= F.col(f"{b}_to")) & (F.col(f"{b}_from") <= F.col(f"{a}_to"))
    spell = lambda d, k, *c: d.select(*c, F.col("d_from").alias(f"{k}_from"), F.coalesce("d_to", open_end()).alias(f"{k}_to"))
    a = spell(m.memberships.where("kind <> 'group'"), "a", "member_id", F.col("subject_id").alias("party"))
    b = spell(m.memberships.where("kind = 'group'"), "b", "member_id", F.col("subject_id").alias("grp"))
    t = spell(m.terms, "t", "term")
    n = a.join(b, "member_id").where(over("a", "b")).join(F.broadcast(t), over("a", "t") & over("b", "t")).groupBy("term", "party", "grp").agg(F.countDistinct("member_id").alias("n"))  # a row a term
    return n.groupBy("term", "party").agg(F.max_by("grp", F.struct("n", -F.col("grp"))).alias("grp"))


def party_topics(m: Model, min_votes: int = 5) -> DataFrame:
    """Share of yes of each national party and topic."""
    votes = with_subject(cast_votes(m).where(SUBSTANTIAL).where("topic IS NOT NULL"), affiliation(m, "national")).withColumnRenamed("subject_id", "party")
    return votes.groupBy("term", "party", "topic").agg(F.count("*").alias("n"), share(F.col("option") == 1).alias("share")).where(F.col("n") >= min_votes)


def party_profile(m: Model, min_votes: int = 5) -> DataFrame:
    """One row a party: its country, main group and colour, and a map of topic to share and number of votes."""
    cells = party_topics(m, min_votes).withColumn("share", F.round("share", 4))
    topics = cells.groupBy("term", "party").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", F.struct("share", "n"))))).alias("topics"))
    colour = tx.colour(F.lit(None).cast("string"), F.col("party").cast("string"))
    return topics.join(party_main_group(m), ["term", "party"], "left").join(party_countries(m), "party", "left").withColumn("colour", colour)


def party_countries(m: Model) -> DataFrame:
    """party, country: that of its members, the first by name if there are several."""
    return m.memberships.where("kind <> 'group'").join(m.members, "member_id").groupBy(F.col("subject_id").alias("party")).agg(F.min("country").alias("country"))


def country_topics(m: Model) -> DataFrame:
    votes = cast_votes(m).where(SUBSTANTIAL).where("final IS TRUE AND topic IS NOT NULL").join(m.members, "member_id")
    return votes.groupBy("term", "topic", "country").agg(F.count("*").alias("n"), share(F.col("option") == 1).alias("share"))


def coded(rows: DataFrame) -> DataFrame:
    """rows with `code`, the country as indicators write it: two letters where the votes have three, other names as they are."""
    return rows.withColumn("code", tx.country_code(F.col("country")))


def term_indicators(m: Model, as_of: Column | None = None) -> DataFrame:
    """Mean of each indicator and country over the years of a term (null end: as_of, else no end)."""
    end = F.coalesce("d_to", open_end() if as_of is None else as_of)
    t = m.terms.select("term", F.year("d_from").alias("y0"), F.year(end).alias("y1"))
    return m.indicators.where("value IS NOT NULL").join(F.broadcast(t), F.col("year").between(F.col("y0"), F.col("y1"))).groupBy("term", "name", "country").agg(F.avg("value").alias("value"))  # a row a term


def two_sided_p(r: Column, n: Column) -> Column:
    """p of a correlation: Student's t with n - 2 degrees of freedom by its finite trigonometric series."""
    k = (n - 2).cast("int")
    cos2 = 1 - r * r  # of the angle whose tangent is t / sqrt(k)
    theta, sin = F.asin(F.abs(r)), F.abs(r)
    odd = k % 2 == 1
    terms = F.when(odd, F.expr("0") + F.floor((k - 1) / 2)).otherwise(F.floor(k / 2)).cast("int")
    # the sum of the series: each term is the one before times cos2 and a ratio
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    step = lambda s, i: F.struct((s["term"] * F.when(odd, 2.0 * i / (2.0 * i + 1)).otherwise((2.0 * i - 1) / (2.0 * i)) * cos2).alias("term"), (s["sum"] + s["term"]).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), start, step, lambda s: s["sum"])
    total = F.when(terms >= 1, total).otherwise(0.0)
    inner = F.when(odd, 2 / F.pi() * (theta + F.when(k > 1, sin * F.sqrt(cos2) * total).otherwise(0.0))).otherwise(sin * total)
    return F.when(n < 3, None).when(F.abs(r) >= 1, 0.0).otherwise(F.greatest(1 - inner, F.lit(0.0)))


def stars(p: Column) -> Column:
    return F.when(p.isNull(), "").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def correlations(m: Model) -> DataFrame:
    """Pearson r, two-sided p and the least-squares line of share on indicator; null under three countries or without spread."""
    points = coded(country_topics(m)).join(term_indicators(m).withColumnRenamed("country", "code"), ["term", "code"])
    by = points.groupBy("term", "topic", "name").agg(F.count("*").alias("n"), F.corr("value", "share").alias("r"), F.regr_slope("share", "value").alias("slope"), F.regr_intercept("share", "value").alias("intercept"))
    r = F.when((F.col("n") >= 3) & ~F.isnan("r"), F.col("r"))
    return by.withColumn("r", r).withColumn("p", two_sided_p(F.col("r"), F.col("n")))


def points(m: Model) -> DataFrame:
    """The points behind a correlation: country, indicator (x), share of yes (y)."""
    both = coded(country_topics(m)).join(term_indicators(m).withColumnRenamed("country", "code"), ["term", "code"])
    return both.select("term", "topic", "name", "country", "code", F.col("value").alias("x"), F.col("share").alias("y"))


def lines(m: Model, beyond: float = 0.02) -> DataFrame:
    """End points of the least-squares line of each correlation, a little beyond the outermost points."""
    fit = points(m).groupBy("term", "topic", "name").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("at"), (F.min("x") - beyond).alias("x1"), (F.max("x") + beyond).alias("x2"))
    fit = fit.where("n >= 2 AND slope IS NOT NULL")
    y = lambda x: F.col("at") + F.col("slope") * F.col(x)
    return fit.select("term", "topic", "name", "x1", y("x1").alias("y1"), "x2", y("x2").alias("y2"))


def rule_keys(rules: DataFrame, items: DataFrame) -> DataFrame:
    """The keys of items(scope, key, item) that hold all items of a rule's both sides."""
    wanted = F.split(F.concat_ws(",", "antecedents", "consequents"), ",")
    each = rules.select("scope", "antecedents", "consequents", F.size(wanted).alias("k"), F.explode(wanted).alias("item"))
    held = each.join(items.select("scope", "key", "item").distinct(), ["scope", "item"]).groupBy("scope", "antecedents", "consequents", "key", "k").agg(F.count("*").alias("n"))
    return held.where("n = k").select("scope", "antecedents", "consequents", "key")


def item_keys(cells: DataFrame, items: list[str]) -> DataFrame:
    """Parties of cells(term, party, topic, share) whose shares have the direction of every item `topic:DIR`."""
    wanted = [tuple(x.rsplit(":", 1)) for x in items]
    fits = [(F.col("topic") == t) & (direction(F.col("share")) == d) for t, d in wanted]
    return cells.groupBy("term", "party").agg(*(F.bool_or(f).alias(f"f{k}") for k, f in enumerate(fits))).where(" AND ".join(f"f{k}" for k in range(len(fits)))).select("term", "party")


def top_rules(rules: DataFrame, n: int = 30) -> DataFrame:
    """The n rules of greatest lift of each scope, with their place; ties by antecedents, then consequents."""
    best = Window.partitionBy("scope").orderBy(F.desc("lift"), "antecedents", "consequents")
    return rules.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n)


def filled_by(series: DataFrame, methods: dict[str, str], since: int = 1990) -> DataFrame:
    """filled() with the method of each indicator's name, years from `since` on; one pass over the series for all methods."""
    known = F.create_map(*(F.lit(x) for pair in methods.items() for x in pair))
    return filled(series.where(F.col("name").isin(list(methods))), F.element_at(known, F.col("name"))).where(F.col("year") >= since)


def deviation_items(m: Model, threshold: float = 0.10) -> DataFrame:
    """key (party), item `TOPIC:ABOVE` or `TOPIC:BELOW`: a share that differs from the group's mean by more than threshold."""
    cells = party_topics(m).join(party_main_group(m), ["term", "party"])
    mean = cells.groupBy("term", "grp", "topic").agg(F.round(F.avg("share"), 4).alias("mean"))
    gap = F.round(F.col("share") - F.col("mean"), 6)
    both = cells.join(mean, ["term", "grp", "topic"]).where(F.abs(gap) > threshold)
    return both.select(F.col("term").cast("long").alias("scope"), F.col("party").alias("key"), F.concat_ws(":", "topic", F.when(gap > 0, "ABOVE").otherwise("BELOW")).alias("item")).distinct()


def frequent_itemsets(items: DataFrame, min_support: float, longest: int = 3, least_items: int = 1) -> DataFrame:
    """items(scope, key, item) to scope, items (sorted array), support; sets of up to three items.

    Level by level: only items that are frequent themselves are joined to pairs, only frequent
    pairs to triples.
    """
    items = saved(items, "items")  # every level is planned from here
    sizes = items.groupBy("scope", "key").agg(F.count("*").alias("k")).where(F.col("k") >= least_items)
    rows = items.join(sizes.drop("k"), ["scope", "key"])
    total = sizes.groupBy("scope").agg(F.count("*").cast("double").alias("total"))

    def frequent(level: DataFrame, names: list[str]) -> DataFrame:
        n = level.groupBy("scope", *names).agg(F.count("*").alias("n")).join(total, "scope")
        return n.withColumn("support", F.col("n") / F.col("total")).where(F.col("support") >= min_support).select("scope", *names, "support")

    one = frequent(rows.withColumnRenamed("item", "a"), ["a"])
    rows = rows.withColumnRenamed("item", "a").join(one.select("scope", "a"), ["scope", "a"])
    sets = one.select("scope", F.array("a").alias("items"), "support")
    if longest >= 2:
        other = rows.withColumnRenamed("a", "b")
        two = rows.join(other, ["scope", "key"]).where("a < b")
        found = frequent(two, ["a", "b"])
        sets = sets.union(found.select("scope", F.array("a", "b").alias("items"), "support"))
        if longest >= 3:
            two = two.join(found.select("scope", "a", "b"), ["scope", "a", "b"])
            three = two.join(rows.withColumnRenamed("a", "c"), ["scope", "key"]).where("b < c")
            sets = sets.union(frequent(three, ["a", "b", "c"]).select("scope", F.array("a", "b", "c").alias("items"), "support"))
    return sets


def rules(sets: DataFrame, min_confidence: float = 0.7, min_lift: float = 1.15) -> DataFrame:
    """The split of each itemset with the best lift: antecedents, consequents, support, confidence, lift.

    Ties of the rounded lift: fewer antecedents, then their order.
    """
    sets = saved(sets, "itemsets")
    n = F.size("items")
    masks = F.sequence(F.lit(1), F.shiftleft(F.lit(1), 3) - 2)
    split = sets.where(n >= 2).withColumn("mask", F.explode(masks)).where(F.col("mask") < F.pow(F.lit(2), n) - 1)
    pick = lambda yes: F.filter("items", lambda x, i: (F.expr("mask").bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0) == F.lit(yes))
    split = split.withColumn("antecedents", pick(True)).withColumn("consequents", pick(False))
    known = lambda name: sets.select("scope", F.col("items").alias(name), F.col("support").alias(f"s_{name}"))
    both = split.join(known("antecedents"), ["scope", "antecedents"]).join(known("consequents"), ["scope", "consequents"])
    both = both.withColumn("confidence", F.col("support") / F.col("s_antecedents")).withColumn("lift", F.round(F.col("confidence") / F.col("s_consequents"), 4)).where(F.round("confidence", 9) >= min_confidence)
    best = Window.partitionBy("scope", "items").orderBy(F.desc("lift"), F.size("antecedents"), F.concat_ws(",", "antecedents"))
    kept = both.withColumn("r", F.row_number().over(best)).where("r = 1").where(F.col("lift") >= min_lift)
    return kept.select("scope", F.concat_ws(",", "antecedents").alias("antecedents"), F.concat_ws(",", "consequents").alias("consequents"), F.round("support", 4).alias("support"), F.round("confidence", 4).alias("confidence"), "lift")


def filled(series: DataFrame, method: str | Column) -> DataFrame:
    """series(name, country, year, value) with gaps filled and `predicted`; method linear, loglinear or mean, one or one a row's name.

    linear: missing years lie on the line through the last observation whose slope blends the
    country's with that of all countries (weight r squared, one half at least); no data: the
    common slope through the overall mean. loglinear: the same in logarithms after the last
    observation, the common slope before the first, straight lines in gaps; no data: the common
    curve. mean: the mean of the last five observations, else of all. Rounded to 2 places, not
    under 0 (loglinear cannot be).
    """
    rows = series.withColumn("method", F.lit(method) if isinstance(method, str) else method)
    logs = F.col("method") == "loglinear"
    rows = rows.withColumn("v", F.when(logs, F.when(F.col("value") > 0, F.ln("value"))).otherwise(F.col("value")))
    seen = F.when(F.col("v").isNotNull(), F.col("year"))
    common = rows.groupBy("name").agg(
        F.regr_slope("v", "year").alias("g_slope"), F.regr_intercept("v", "year").alias("g_at"), F.avg("v").alias("g_mean"), F.avg(seen).alias("g_year")
    )
    place = Window.partitionBy("name", "country").orderBy("year")
    past, later = place.rowsBetween(Window.unboundedPreceding, 0), place.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy("name", "country")
    rows = rows.withColumn("no", F.row_number().over(place))
    at = F.when(F.col("v").isNotNull(), F.col("no"))
    latest = F.row_number().over(Window.partitionBy("name", "country").orderBy(F.col("value").isNull(), F.desc("year")))
    rows = rows.withColumns({"a": F.last("value", True).over(past), "ia": F.last(at, True).over(past), "b": F.first("value", True).over(later), "ib": F.first(at, True).over(later), "latest": latest})
    rows = rows.withColumns({
        "n": F.count("v").over(whole), "slope": F.regr_slope("v", "year").over(whole), "r2": F.regr_r2("v", "year").over(whole),
        "last": F.max_by("v", seen).over(whole), "last_year": F.max(seen).over(whole), "first": F.min_by("v", seen).over(whole), "first_year": F.min(seen).over(whole),
        "recent": F.avg(F.when((F.col("latest") <= 5) & F.col("value").isNotNull(), F.col("value"))).over(whole),
    })
    both = rows.join(common, "name")
    weight = F.greatest(F.lit(0.5), F.coalesce("r2", F.lit(0.0)))
    slope = F.when(F.col("n") < 2, F.col("g_slope")).otherwise(weight * F.col("slope") + (1 - weight) * F.col("g_slope"))
    line = F.col("last") + slope * (F.col("year") - F.col("last_year"))
    inner = F.col("a") + (F.col("b") - F.col("a")) * (F.col("no") - F.col("ia")) / (F.col("ib") - F.col("ia"))
    straight = F.when(F.col("n") == 0, F.col("g_mean") + F.col("g_slope") * (F.col("year") - F.col("g_year"))).otherwise(line)
    curved = (
        F.when(F.col("n") == 0, F.exp(F.col("g_at") + F.col("g_slope") * F.col("year")))
        .when(F.col("year") > F.col("last_year"), F.exp(line))
        .when(F.col("year") < F.col("first_year"), F.exp(F.col("first") + F.col("g_slope") * (F.col("year") - F.col("first_year"))))
        .otherwise(inner)
    )
    guess = F.when(logs, curved).when(F.col("method") == "linear", straight).otherwise(F.coalesce("recent", "g_mean"))
    result = F.round(F.coalesce("value", guess), 2)
    return both.select("name", "country", "year", F.when(logs, result).otherwise(F.greatest(result, F.lit(0.0))).alias("value"), F.col("value").isNull().alias("predicted"))
