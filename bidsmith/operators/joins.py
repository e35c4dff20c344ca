"""Joins by time and by name. Each interval join carries an equality, so Spark can hash or sort on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidsmith.operators.fuzzy import alike_names
from bidsmith.sources.sinks import settled

SLOT = 32


def forward_asof(left: DataFrame, right: DataFrame, key: str, at: str, then: str, days: int, take: str) -> DataFrame:
    """left with the first right row (same key) on or after `at`, within days; null where there is none.

    One sort of both sides by key, time slot and time: no join, so a key's rows aren't multiplied. A null key has no match.
    """
    return _asof(left, right, key, at, then, days, take, forward=True)


def backward_asof(left: DataFrame, right: DataFrame, key: str, at: str, then: str, days: int | None, take: list[str] | str) -> DataFrame:
    """left with the last right row (same key) on or before `at`, within days."""
    return _asof(left, right, key, at, then, days, take, forward=False)


def _asof(left: DataFrame, right: DataFrame, key: str, at: str, then: str, days: int | None, take, forward: bool) -> DataFrame:
    """A key's rows are dealt into slots of time, so that a hot key is many tasks. A fact goes to each slot that it may
    serve: those within `days`, or, without a limit, its own, and the last fact of each slot to the next slot with rows."""
    take = [take] if isinstance(take, str) else list(take)
    span = SLOT if days is None else max(SLOT, days)
    slot = lambda c, shift=0: F.floor((F.unix_date(F.to_date(c)) + shift) / span)
    found = F.struct(F.col(then).alias("_when"), *(F.col(c) for c in take if c != then))
    facts = right.where(F.col(key).isNotNull() & F.col(then).isNotNull()).select(F.col(key), F.col(then).alias("_time"), F.lit(0).alias("_own"), found.alias("_found"))
    # null keys are spread over as many groups as there are slots, and meet no fact
    rows = left.select("*", F.col(at).alias("_time"), F.lit(1).alias("_own"), F.coalesce(slot(at), F.lit(0)).alias("_slot")).withColumn("_found", F.lit(None).cast(facts.schema["_found"].dataType))
    if days is None:
        own = facts.withColumn("_slot", slot("_time"))
        edge = own.groupBy(key, "_slot").agg((F.min_by if forward else F.max_by)("_found", "_time").alias("_edge"))
        seen = edge.unionByName(rows.where(F.col(key).isNotNull()).select(key, "_slot").distinct(), allowMissingColumns=True).groupBy(key, "_slot").agg(F.first("_edge", ignorenulls=True).alias("_edge"))
        order = Window.partitionBy(key).orderBy(F.col("_slot").desc() if forward else F.col("_slot").asc())  # a row a key and slot
        last = F.last("_edge", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        carried = seen.withColumn("_found", last).where("_found is not null").select(key, F.col("_found._when").alias("_time"), F.lit(0).alias("_own"), "_found", "_slot")
        facts = own.unionByName(carried)
    else:
        first, end = (slot("_time", -days), slot("_time")) if forward else (slot("_time"), slot("_time", days))
        facts = facts.withColumn("_slot", F.explode(F.sequence(first, end)))
    both = rows.unionByName(facts, allowMissingColumns=True)
    # at one time a fact sorts before the rows it serves: backwards in time for the forward join
    order = Window.partitionBy(key, "_slot").orderBy(F.col("_time").desc() if forward else F.col("_time").asc(), "_own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = both.withColumn("_got", F.when(F.col(key).isNotNull(), F.last("_found", ignorenulls=True).over(order))).where("_own = 1")
    gap = F.abs(F.datediff(F.col("_got._when"), F.col("_time")))
    fits = F.col("_got").isNotNull() if days is None else gap <= days
    return got.select(*left.columns, *(F.when(fits, F.col("_got._when" if c == then else f"_got.{c}")).alias(c) for c in take))


def _nearest(left: DataFrame, facts: DataFrame, key: str, at: str, then: str, days: int, after: bool) -> DataFrame:
    """left with `_fact`, the day of the nearest fact (same key) within days before (or after) the day of `at`, inclusive."""
    days_of = left.withColumn("_day", F.to_date(at))
    return _asof(days_of, facts.select(F.col(key), F.to_date(then).alias("_fact")), key, "_day", "_fact", days, "_fact", forward=after).drop("_day")


def recent(left: DataFrame, facts: DataFrame, key: str, at: str, then: str, days: int, after: bool = False) -> DataFrame:
    """left rows for which some fact (same key) lies within days before (or after) `at`, inclusive."""
    return _nearest(left, facts, key, at, then, days, after).where("_fact is not null").drop("_fact")


def not_recent(left: DataFrame, facts: DataFrame, key: str, at: str, then: str, days: int, after: bool = False) -> DataFrame:
    """The rows that `recent` leaves out."""
    return _nearest(left, facts, key, at, then, days, after).where("_fact is null").drop("_fact")


def having(left: DataFrame, facts: DataFrame, key: str, at: str, then: str, kinds: dict[str, tuple[Column, int]]) -> DataFrame:
    """left with a flag for each kind: whether some fact of that kind (same key) lies within its days before `at`, inclusive.

    kinds: a condition on facts and days. One pass for all kinds: rows and facts are sorted once by key, time slot and
    day, and each kind's last day is carried along; a hot key is many tasks, and a null key has no fact.
    """
    span = max(SLOT, *(days for _, days in kinds.values()))
    own = left.withColumn("_day", F.to_date(at))
    rows = own.withColumns({"_own": F.lit(1), "_slot": F.coalesce(F.floor(F.unix_date("_day") / span), F.lit(0)), **{f"_is_{k}": F.lit(False) for k in kinds}})
    marks = facts.where(F.col(key).isNotNull()).select(F.col(key), F.to_date(then).alias("_day"), F.lit(0).alias("_own"), *(F.coalesce(c, F.lit(False)).alias(f"_is_{k}") for k, (c, _) in kinds.items()))
    first = F.floor(F.unix_date("_day") / span)
    marks = marks.where(" or ".join(f"_is_{k}" for k in kinds)).where("_day is not null").withColumn("_slot", F.explode(F.array(first, first + 1)))
    order = Window.partitionBy(key, "_slot").orderBy("_day", "_own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = {f"_last_{k}": F.last(F.when(F.col(f"_is_{k}"), F.col("_day")), ignorenulls=True).over(order) for k in kinds}
    both = rows.unionByName(marks, allowMissingColumns=True).withColumns(last).where("_own = 1")
    flags = [(F.col(key).isNotNull() & F.coalesce(F.datediff("_day", f"_last_{k}") <= days, F.lit(False))).alias(k) for k, (_, days) in kinds.items()]
    return both.select(*left.columns, *flags)


def earliest_in_band(left: DataFrame, facts: DataFrame, key: str, at: str, then: str, before: int, after: int, name: str) -> DataFrame:
    """left with the earliest fact (same key) from `before` days before to `after` days after `at`; null where there is none."""
    start = left.withColumn("_start", F.date_sub(F.to_date(at), before))
    return forward_asof(start, facts.select(F.col(key), F.to_date(then).alias(name)), key, "_start", name, before + after, name).drop("_start")


def earliest_of_searches(left: DataFrame, searches: list[DataFrame], key: str, at: str, then: str, before: int, after: int, name: str) -> DataFrame:
    """`earliest_in_band` of the first search that finds any; the others count only where those before found none."""
    out = left
    for i, facts in enumerate(searches):
        out = earliest_in_band(out, facts, key, at, then, before, after, f"_{name}_{i}")
    return out.withColumn(name, F.coalesce(*(f"_{name}_{i}" for i in range(len(searches))))).drop(*(f"_{name}_{i}" for i in range(len(searches))))


#: Texts of one three-character part that a text is compared with.
HOT = 200


def _grams(text: Column, least: int = 1) -> Column:
    """The different substrings of least to 3 characters."""
    size = F.length(text)
    of = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*(of(n) for n in range(least, 4))))


def held(short: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs (s, l) of texts of which l holds s. Each side has one column of different texts, s and l.

    No nested loop: a short text is looked up by the rarest of its three-character parts (itself, if shorter); where more than
    HOT texts have even that part, by the whole of it among the parts as long of each long text.
    """
    posted = long.where("l <> ''").select("l", F.explode(_grams(F.col("l"))).alias("gram"))
    often = posted.groupBy("gram").agg(F.count("*").alias("often"))
    parts = short.where("s <> ''").select("s", F.explode(F.when(F.length("s") < 3, F.array("s")).otherwise(_grams(F.col("s"), 3))).alias("gram"))
    rarest = parts.join(often, "gram", "left").groupBy("s").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram")).alias("x")).where("x.often > 0").select("s", "x.gram", "x.often")
    rarest = settled(rarest, "rarest")
    found = rarest.where(F.col("often") <= HOT).join(posted, "gram").where(F.contains("l", F.col("s"))).select("s", "l")
    many = rarest.where(F.col("often") > HOT).select("s")
    sizes = [r[0] for r in many.select(F.length("s")).distinct().collect()]  # different lengths of names
    if not sizes:
        return found
    n = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spots = F.explode(F.filter(F.array(*map(F.lit, sorted(sizes))), lambda k: k <= F.length("l"))).alias("k")
    whole = long.where("l <> ''").repartition(n, "l").select("l", spots).select("l", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("l") - F.col("k") + 1), lambda i: F.substring("l", i, F.col("k"))))).alias("s"))
    return found.union(many.join(whole, "s").select("s", "l"))


def name_candidates(names: DataFrame, name: str, companies: DataFrame, limit: int = 10) -> DataFrame:
    """Companies whose name holds the other or is held by it (any case): the first `limit` in list order.

    companies: ordinal, company, ticker and more, of any size. An empty name is held by every company: it has the first ones.
    """
    own = names.select(F.lower(name).alias("x")).where("x is not null").distinct()
    listed = companies.select(F.lower("company").alias("y")).where("y is not null").distinct()
    inside = held(own.toDF("s"), listed.toDF("l")).toDF("x", "y").union(held(listed.toDF("s"), own.toDF("l")).select("l", "s")).distinct()
    every = inside.where("x <> '' and y <> ''").join(companies.withColumn("y", F.lower("company")), "y").select("x", *companies.columns)
    # an empty text is held by all others: at most `limit` companies each way count, so they are a literal
    for which, some in (("x = ''", companies), ("x <> ''", companies.where("company = ''"))):
        first = some.orderBy("ordinal").limit(limit).collect()
        if first:
            kind = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in companies.schema)
            rows = F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in companies.columns)) for r in first)).cast(f"array<struct<{kind}>>")
            every = every.union(own.where(which).select("x", F.inline(rows)))
    w = Window.partitionBy("x").orderBy("ordinal")
    best = every.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")
    return names.withColumn("x", F.lower(name)).join(best, "x").drop("x")


#: How sure a way of finding a company is.
WAYS = {"cage_lei_openfigi": (1, "high"), "exact": (2, "high"), "substring": (3, "medium"), "fuzzy_90": (4, "medium"), "fuzzy_85": (5, "low")}


def resolved(awards: DataFrame, ident: str, name: str, parent: str, companies: DataFrame, cage_lei: DataFrame, lei_ticker: DataFrame, caps: DataFrame) -> DataFrame:
    """ident, resolved_ticker, resolved_cik, confidence, evidence_type, audit_trail (step, outcome) and market_cap of every award.

    Different names are matched once, whatever field they stand in; what is found for them is written to the shared folder.
    Ways in order: identifiers by two hops (a trail of two steps), then the awardee's name, exactly, as a part, and alike by edits
    (90, then 85 in 100), then the parent's name by the same; the first that finds a ticker counts, and of one way's companies the
    first listed. An award that none finds has null fields, confidence none and the trail of what failed.
    """
    step = lambda s, o: F.struct(F.lit(s).alias("step"), o.cast("string").alias("outcome"))
    listed = settled(companies.select("ordinal", "company", "ticker", "cik"), "companies")
    names = settled(awards.select(F.explode(F.array(name, parent)).alias("_name")).where("trim(_name) <> ''").distinct(), "names")
    exact = settled(names.join(listed, F.lower("_name") == F.lower("company")).withColumn("way", F.lit("exact")), "exact")
    left = names.join(exact.select("_name"), "_name", "left_anti")  # a better way counts first: what it finds needs no other
    parts = settled(name_candidates(left, "_name", listed).withColumn("way", F.lit("substring")), "parts")
    near = alike_names(left.join(parts.select("_name"), "_name", "left_anti"), "_name", listed, 85).withColumn("way", F.when(F.col("ratio") >= 90, "fuzzy_90").otherwise("fuzzy_85")).drop("ratio")
    tier = F.coalesce(*(F.when(F.col("way") == w, t) for w, (t, _) in WAYS.items()))
    every = exact.unionByName(parts).unionByName(near).withColumn("tier", tier)
    best = settled(every.groupBy("_name").agg(F.min_by(F.struct("way", "ticker", "company"), F.struct("tier", "ordinal")).alias("x")), "best")  # a row a name

    def by(column: str, prefix: str) -> DataFrame:
        way = F.concat(F.lit(prefix), F.col("x.way"))
        return best.select(F.col("_name").alias(column), F.struct(way.alias("way"), F.col("x.ticker").alias("ticker"), F.array(step("", F.col("x.company")).withField("step", way)).alias("trail")).alias(f"_{prefix or 'own'}"))

    trail = F.array(step("cage_to_lei", F.col("lei")), step("lei_to_ticker", F.col("ticker")))
    hop = F.when(F.col("ticker").isNotNull(), F.struct(F.lit("cage_lei_openfigi").alias("way"), "ticker", trail.alias("trail")))
    failed = F.array(step("cage_to_lei", F.col("rejection_reason")), step("names", F.lit("not_found")))
    hops = two_hops(awards.select(ident, "cage_code", F.col(name).alias("_n"), F.col(parent).alias("_p")), cage_lei, lei_ticker).select(ident, "_n", "_p", hop.alias("_hop"), failed.alias("_failed"))
    found = hops.join(by("_n", ""), "_n", "left").join(by("_p", "parent_"), "_p", "left").withColumn("x", F.coalesce("_hop", "_own", "_parent_"))
    label = F.coalesce(*(F.when(F.col("x.way").endswith(w), c) for w, (_, c) in WAYS.items()), F.lit("none"))
    ciks = listed.groupBy("ticker").agg(F.min("cik").alias("resolved_cik"))
    out = found.select(ident, F.col("x.ticker").alias("ticker"), label.alias("confidence"), F.col("x.way").alias("evidence_type"), F.coalesce("x.trail", "_failed").alias("audit_trail"))
    return out.join(ciks, "ticker", "left").join(caps.select("ticker", "market_cap"), "ticker", "left").select(ident, F.col("ticker").alias("resolved_ticker"), "resolved_cik", "confidence", "evidence_type", "audit_trail", "market_cap")


def service_reason(service: str, valid: Column, invalid: str, status: Column, timed_out: Column, error: Column, found: Column, missing: str, usable: Column | None = None, unusable: str = "") -> Column:
    """Why a lookup gave nothing: a bad identifier, a timeout, another error (its first 50 characters), an HTTP status other than 200, no record, or
    no usable one; null where it gave one."""
    code = F.when(~valid, invalid).when(timed_out, f"{service}_timeout").when(error.isNotNull(), F.concat(F.lit("api_error: "), F.substring(error, 1, 50))).when(status != 200, F.concat(F.lit(f"{service}_http_"), status.cast("string"))).when(~found, missing)
    return code if usable is None else code.when(~usable, unusable)


def first_match(candidates: DataFrame, ident: list[str], ordinal: str, fits: Column, take: list[str]) -> DataFrame:
    """Of each ident's candidates that fit, the one of least ordinal."""
    return candidates.where(fits).groupBy(*ident).agg(F.min_by(F.struct(*take), ordinal).alias("_x")).select(*ident, *(F.col(f"_x.{c}").alias(c) for c in take))


def search_names(watchlist: DataFrame) -> DataFrame:
    """One row for each name and alias of a ticker; position 0 is the name."""
    return watchlist.select("ticker", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("position", "search_name"))


def two_hops(awards: DataFrame, cage_lei: DataFrame, lei_ticker: DataFrame) -> DataFrame:
    """awards (with cage_code) with lei, ticker, confidence and rejection_reason, by way of the two mappings."""
    from bidsmith.functions.cleaning import is_cage

    found = awards.withColumn("_cage", F.when(is_cage("cage_code"), F.upper(F.trim("cage_code")))).join(cage_lei.withColumnRenamed("cage", "_cage"), "_cage", "left").join(lei_ticker, "lei", "left")
    reason = F.when(~is_cage("cage_code"), "invalid_cage_format").when(F.col("lei").isNull(), "cage_not_found").when(F.col("ticker").isNull(), "lei_not_found")
    return found.withColumns({"rejection_reason": reason, "confidence": F.when(reason.isNull(), 0.9).otherwise(0.0)}).drop("_cage")


def cross_checked(hits: DataFrame, entities: DataFrame) -> DataFrame:
    """Hits by lei: 0.1 more confidence (1 at most) and PUBLIC where the entity is known, else PRIVATE."""
    known = entities.select("lei", F.lit(True).alias("_known"))
    return hits.join(known, "lei", "left").withColumns({"confidence": F.when(F.col("_known"), F.least(F.lit(1.0), F.col("confidence") + 0.1)).otherwise(F.col("confidence")), "entity_type": F.when(F.col("_known"), "PUBLIC").otherwise("PRIVATE")}).drop("_known")


def consensus(paths: DataFrame, ident: str) -> DataFrame:
    """Per ident, the ticker that most paths agree on, with its label and the paths as a trail.

    paths: ident, tier, path, ticker. Two agreeing paths are very_high, one of tier 1 high, of tier
    2 medium, else low; ties go to the lower tier, then the ticker.
    """
    per = paths.where("ticker is not null").groupBy(ident, "ticker").agg(F.countDistinct("path").alias("n_paths"), F.min("tier").alias("tier"), F.sort_array(F.collect_set("path")).alias("trail"))
    w = Window.partitionBy(ident).orderBy(F.desc("n_paths"), "tier", "ticker")
    label = F.when(F.col("n_paths") >= 2, "very_high").when(F.col("tier") == 1, "high").when(F.col("tier") == 2, "medium").otherwise("low")
    return per.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(ident, "ticker", "n_paths", label.alias("confidence"), F.array_join("trail", ">").alias("trail"))
