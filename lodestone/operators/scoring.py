"""Scores of discovered items, trends, and market series. The date of the run is a parameter, as_of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.relational import top_k

#: Weights of the parts of an item's priority.
WEIGHTS = {"popularity": 0.15, "freshness": 0.10, "bridge": 0.25, "gap": 0.15, "trust": 0.15, "information": 0.20}


def clamped(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def log_scaled(value: Column, low: Column, high: Column) -> Column:
    """From 0 at low to 1 at high, by powers of ten; 0 for what is missing or not positive."""
    at = lambda c: F.log10(F.greatest(c, F.lit(1)) * 1.0)
    return F.when(value > 0, clamped(F.coalesce(F.try_divide(at(value) - at(low), at(high) - at(low)), F.lit(1.0)))).otherwise(0.0)


def popularity(items: DataFrame, thresholds: DataFrame, metric: str) -> DataFrame:
    """thresholds(source, low, high): sources that it does not have score 0."""
    j = items.join(thresholds, "source", "left")
    return j.withColumn("popularity", F.when(F.col("low").isNotNull(), log_scaled(F.col(metric), F.col("low"), F.col("high"))).otherwise(0.0)).drop("low", "high")


def freshness(published: Column, as_of: Column, half_life: float) -> Column:
    """Halves every half_life days; 0.5 for an unknown date, 1 for one to come."""
    days = F.datediff(as_of, published)
    return F.when(published.isNull(), 0.5).when(days <= 0, 1.0).otherwise(F.pow(F.lit(2.0), -days / half_life))


def bridge_score(domains: Column) -> Column:
    return F.when(domains >= 4, 1.0).when(domains == 3, 0.6).when(domains == 2, 0.2).otherwise(0.0)


def gap_score(known: Column) -> Column:
    """What one concept with so many known documents is worth."""
    return F.when(known == 0, 1.0).when(known < 5, 0.8).when(known < 20, 0.4).otherwise(0.1)


def gap_fill(items: DataFrame, key: str, concepts: str, known: DataFrame) -> DataFrame:
    """key, gap: the mean worth of an item's concepts; known(concept, n). 0.5 for an item without concepts."""
    each = items.select(key, F.explode(concepts).alias("concept")).join(known, "concept", "left")
    worth = each.groupBy(key).agg(F.avg(gap_score(F.coalesce("n", F.lit(0)))).alias("gap"))
    return items.select(key).join(worth, key, "left").select(key, F.coalesce("gap", F.lit(0.5)).alias("gap"))


def trust(authors: Column, trusted: list[str], labs: list[str], affiliation: Column) -> Column:
    """0.95 for a trusted laboratory, 0.8 for a trusted author, else 0.3."""
    low = F.lower(F.coalesce(affiliation, F.lit("")))
    lab = reduce(lambda a, b: a | b, (low.contains(x) for x in labs), F.lit(False))
    return F.when(lab, 0.95).when(F.coalesce(F.exists(authors, lambda a: F.lower(a).isin(*trusted)), F.lit(False)), 0.8).otherwise(0.3)


def information_gain(concepts: Column, questions: list[tuple[list[str], float]]) -> Column:
    """The most, over open questions, of the share of a question's concepts that are there times its uncertainty."""
    return F.greatest(F.lit(0.0), *(F.size(F.array_intersect(concepts, F.array(*map(F.lit, q)))) / len(q) * u for q, u in questions))


def priority(parts: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a + b, (F.coalesce(parts[k], F.lit(0.0)) * w for k, w in WEIGHTS.items()))


def hidden_gem(popularity: Column, bridge: Column, information: Column) -> Column:
    """Little known, and yet bridging or telling."""
    return (popularity < 0.3) & ((bridge >= 0.6) | (information >= 0.5))


def velocity_step(pushed: Column, as_of: Column) -> Column:
    d = F.datediff(as_of, pushed)
    return F.when(d < 7, 1.0).when(d < 30, 0.8).when(d < 90, 0.5).when(d < 180, 0.2).otherwise(0.0)


def tone_class(tone: Column) -> Column:
    return F.when(tone >= 5, "very_positive").when(tone >= 1.5, "positive").when(tone >= -1.5, "neutral").when(tone >= -5, "negative").otherwise("very_negative")


def sentiment_trend(series: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """key, early and recent (means of the first and last three days; below three days the first and last value),
    change and direction."""
    d = series.groupBy(key, day).agg(F.avg(value).alias("v"))
    w, z = Window.partitionBy(key).orderBy(day), Window.partitionBy(key).orderBy(F.desc(day))
    r = d.withColumn("a", F.row_number().over(w)).withColumn("z", F.row_number().over(z)).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    k = F.when(F.col("n") >= 3, 3).otherwise(1)
    g = r.groupBy(key).agg(F.avg(F.when(F.col("a") <= k, F.col("v"))).alias("early"), F.avg(F.when(F.col("z") <= k, F.col("v"))).alias("recent"))
    change = F.col("recent") - F.col("early")
    return g.withColumn("change", change).withColumn("direction", F.when(change > 0.5, "improving").when(change < -0.5, "declining").otherwise("stable"))


def volume_velocity(counts: DataFrame, key: str, day: str) -> DataFrame:
    """counts(key, day, n): total, mean a day, the sum of the last three days over that mean, and whether above 1.5."""
    z = Window.partitionBy(key).orderBy(F.desc(day))
    r = counts.withColumn("z", F.row_number().over(z))
    g = r.groupBy(key).agg(F.sum("n").alias("total"), F.avg("n").alias("mean"), F.sum(F.when(F.col("z") <= 3, F.col("n"))).alias("last3"))
    return g.withColumn("ratio", F.try_divide("last3", "mean")).withColumn("trending", F.col("ratio") > 1.5)


def trend_radar(names: DataFrame, name: str, year: str, now: int) -> DataFrame:
    """name, recent (this year and the last), before (three and four years ago), velocity, state."""
    y = F.col(year)
    g = names.groupBy(name).agg(F.count_if(y.isin(now, now - 1)).alias("recent"), F.count_if(y.isin(now - 3, now - 4)).alias("before"), F.max(F.when(y <= now - 3, 1)).alias("__old"), F.max(F.when(y >= now - 1, 1)).alias("__new"))
    state = F.when(F.col("__new").isNull(), "gone").when(F.col("__old").isNull(), "emerging").otherwise("established")
    return g.select(name, "recent", "before", (F.col("recent") - F.col("before")).alias("velocity"), state.alias("state"))


def landscape_gap(rows: DataFrame, code: str, year: str, now: int) -> DataFrame:
    """code, count, trend: the last three years against the three before them; rare below three rows."""
    y = F.col(year)
    g = rows.groupBy(code).agg(F.count("*").alias("count"), F.count_if(y > now - 3).alias("late"), F.count_if((y <= now - 3) & (y > now - 6)).alias("early"))
    trend = F.when(F.col("late") < 0.7 * F.col("early"), "declining").when(F.col("late") > 1.3 * F.col("early"), "growing").otherwise("stable")
    return g.withColumn("trend", trend).withColumn("rare", F.col("count") <= 2)


def novelty(distance: Column, papers: Column, links: Column) -> Column:
    """A base by how far apart two domains are (0 to 4), more for what few papers or links cover; 0.3 to 0.95."""
    far = F.element_at(F.array(*map(F.lit, (0.0, 0.2, 0.3, 0.4, 0.35))), (F.least(distance, F.lit(4)) + 1).cast("int"))
    cover = F.when(papers == 0, 0.4).when(papers < 3, 0.3).when(papers < 10, 0.2).when(papers < 30, 0.15).otherwise(0.05)
    rare = F.when(links == 0, 0.2).when(links < 5, 0.15).otherwise(0.1)
    return clamped(far + cover + rare, 0.3, 0.95)


def support_balance(text: Column) -> Column:
    """-1 for a text that says that something does not hold, else 1."""
    low = F.lower(text)
    return F.when(low.contains("not ") | low.contains("failed") | low.contains("unable") | low.contains("incorrect"), -1).otherwise(1)


def verdict(support: Column, contra: Column) -> Column:
    c = F.coalesce(F.try_divide(support * 1.0, support + contra), F.lit(0.5))
    return F.struct(c.alias("confidence"), F.when(c > 0.6, "supported").when(c > 0.4, "needs_investigation").otherwise("not_supported").alias("verdict"))


def repository_relevance(description: Column, stars: Column, language: Column, tier: Column, keywords: list[tuple[list[str], float]], tiers: dict[str, float]) -> Column:
    """The weight of each group of keywords of which the description has one, up to 0.3 for stars (a tenth for each power
    of ten), 0.1 for Python and the tier's own."""
    said = F.lower(F.coalesce(description, F.lit("")))
    groups = [F.when(reduce(lambda a, b: a | b, (said.contains(k) for k in ks)), w).otherwise(0.0) for ks, w in keywords]
    liked = F.when(stars > 0, F.least(F.lit(0.3), F.log10(stars + 1) / 10)).otherwise(0.0)
    own = reduce(lambda c, x: c.when(tier == x[0], x[1]), list(tiers.items())[1:], F.when(tier == next(iter(tiers)), tiers[next(iter(tiers))])).otherwise(0.0) if tiers else F.lit(0.0)
    return reduce(lambda a, b: a + b, groups, F.lit(0.0)) + liked + F.when(language == "Python", 0.1).otherwise(0.0) + own


def key_file_priority(text: Column, name: Column, definition: str, sweet: tuple[int, int], favoured: str, plain: str) -> Column:
    """0.3 for definitions in a hundred lines (10 and more count full), 0.4 for a number of lines in the sweet spot (else
    half), 0.3 for the name (1.5 times if favoured, 0.7 times if plain)."""
    lines = F.regexp_count(text, F.lit("\n")) + 1
    density = F.least(F.regexp_count(text, F.lit(definition)) * 100 / lines / 10, F.lit(1.0))
    size = F.when(lines.between(*sweet), 1.0).otherwise(0.5)
    return 0.3 * density + 0.4 * size + 0.3 * F.when(name.rlike(favoured), 1.5).when(name.rlike(plain), 0.7).otherwise(1.0)


def hypothesis_rank(method: Column, concept: Column, proven: dict[str, float], hot: dict[str, float], base: float = 7.0) -> Column:
    """The base for a pair that nobody has tried, with boosts for proven methods and hot concepts, by parts of names."""
    boosts = [F.when(method.contains(k), w).otherwise(0.0) for k, w in proven.items()] + [F.when(F.lower(concept).contains(k), w).otherwise(0.0) for k, w in hot.items()]
    return reduce(lambda a, b: a + b, boosts, F.lit(base))


def topic_gaps(hits: DataFrame, concepts: DataFrame, key: str, year: str, concept: str, now: int, methods: list[str]) -> DataFrame:
    """One row on a topic's papers (hits, of a bounded search): how many, how many of the last three years and whether
    those are fewer than five, the ten most frequent concepts, up to ten that one paper has, and whether none of the
    methods is among the frequent ones."""
    own = concepts.join(hits.select(key), key, "left_semi").groupBy(concept).agg(F.count("*").alias("n"))
    first = lambda rows, *order: rows.orderBy(*order).limit(10).agg(F.array_sort(F.collect_list(F.struct(*(o for o in ("n", concept))))).alias("x"))
    top = first(own, F.desc("n"), concept).select(F.transform(F.array_sort("x", lambda a, b: F.when(a["n"] != b["n"], b["n"].cast("int") - a["n"].cast("int")).when(a[concept] < b[concept], -1).when(a[concept] > b[concept], 1).otherwise(0)), lambda s: s[concept]).alias("top_concepts"))
    rare = first(own.filter("n = 1"), concept).select(F.transform("x", lambda s: s[concept]).alias("rare_concepts"))
    papers = hits.agg(F.count("*").alias("papers"), F.count_if((F.col(year) <= now) & (F.col(year) > now - 3)).alias("recent"))
    gap = ~F.arrays_overlap("top_concepts", F.array(*map(F.lit, methods)))
    return papers.join(top).join(rare).select("papers", "recent", (F.col("recent") < 5).alias("recency_gap"), "top_concepts", "rare_concepts", gap.alias("method_gap"))


def assignee_velocity(filings: DataFrame, assignee: str, year: str, code: str, now: int, k: int = 10) -> DataFrame:
    """assignee, filings in all and of this and the last year, and its k most frequent codes (ties by name)."""
    by_code = filings.groupBy(assignee, code).agg(F.count("*").alias("n"))
    top = top_k(by_code, [assignee], [F.desc("n"), F.asc(code)], k, "r")
    listed = top.groupBy(assignee).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", code))), lambda s: s[code]).alias("areas"))
    total = filings.groupBy(assignee).agg(F.count("*").alias("total"), F.count_if(F.col(year).isin(now, now - 1)).alias("recent"))
    return total.join(listed, assignee)


def jurisdiction_coverage(cases: DataFrame, court: str, k: int = 10) -> DataFrame:
    """court, cases, percent of all cases, of the k courts that have most."""
    n = cases.groupBy(court).agg(F.count("*").alias("cases"))
    return n.join(F.broadcast(n.agg(F.sum("cases").alias("total")))).orderBy(F.desc("cases"), court).limit(k).select(court, "cases", F.round(100.0 * F.col("cases") / F.col("total"), 1).alias("percent"))


def precedents(found: DataFrame, key: str, court: str, score: str, per_court: int = 10, k: int = 20) -> DataFrame:
    """The k best cases of the per_court best of each court; a case that several courts give counts once, by its best."""
    best = top_k(found, [court], [F.desc(score), F.asc(key)], per_court)
    return best.groupBy(key).agg(F.max(score).alias(score)).orderBy(F.desc(score), key).limit(k)


def _methods(papers: DataFrame, concepts: DataFrame, by: str, key: str, concept: str) -> DataFrame:
    return papers.select(key, by).join(concepts.select(key, concept), key).groupBy(by, concept).agg(F.count("*").alias("n"))


def watched(papers: DataFrame, concepts: DataFrame, by: str, key: str, year: str, concept: str, top: int = 10) -> DataFrame:
    """by, papers, velocity (year and n of its papers, by year) and methods (the `top` most frequent concepts of its papers,
    ties by name) of every lab, author or venue at once. papers(key, by, year), concepts(key, concept). A paper without a
    year counts as a paper only; one without concepts has no methods."""
    years = papers.groupBy(by, year).agg(F.count("*").alias("n"))
    entry = F.when(F.col(year).isNotNull(), F.struct(F.col(year).alias("year"), "n"))
    velocity = years.groupBy(by).agg(F.sum("n").alias("papers"), F.array_sort(F.collect_list(entry)).alias("velocity"))  # one a year
    best = top_k(_methods(papers, concepts, by, key, concept), [by], [F.desc("n"), F.asc(concept)], top, "r")
    named = best.groupBy(F.col(by).alias("__by")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", concept))), lambda x: x[concept]).alias("methods"))
    out = velocity.join(named, F.col(by).eqNullSafe(F.col("__by")), "left")
    return out.select(by, "papers", "velocity", F.coalesce("methods", F.array().cast("array<string>")).alias("methods"))


def topic_overlap(papers: DataFrame, concepts: DataFrame, by: str, key: str, concept: str, topics: list[str]) -> DataFrame:
    """by, topic, concept, frequency: the concepts of each lab's papers that contain one of the topics, whatever the case.
    Concepts are counted before topics are looked for in them."""
    found = F.filter(F.array(*map(F.lit, topics)), lambda x: F.lower(concept).contains(F.lower(x)))
    return _methods(papers, concepts, by, key, concept).select(by, F.explode(found).alias("topic"), concept, F.col("n").alias("frequency"))
