"""Names alike by edits, completely and without comparing all pairs: segments that a few edits cannot all touch.

A name within t edits of another has one of that name's t + 1 even segments unchanged in it (Pass-Join). The edits allowed
depend on the longer name, so a company is cut once for each number of edits that a partner may allow, and a name
looks its substrings up for each length a partner may have, at the few places where an unchanged segment can stand.

Where many names share a segment, as names of one form with a number do, that segment says too little. Such names are looked up
by what is left of them without as many characters as the edits may touch: two names within a few edits have such a rest in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidsmith.sources.sinks import settled

#: Companies of one segment that a name's substring is compared with; where there are more, their rests are looked up.
HOT = 200
#: The most edits for which rests are made (a name of n characters has at most n over this many); with more, hot segments are dealt in parts.
MOST = 3
_KEY = ["size", "edits", "at", "part"]


def alikeness(x: Column, y: Column) -> Column:
    """100 * (1 - edits / longer length), floored."""
    return F.floor(100 * (1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))).cast("int")


def _segments(text: str, least: int) -> Column:
    """(size, edits, at, part) of a text's segments, for each number of edits from its own to the most a longer partner allows."""
    size, e = f"length({text})", 100 - least
    part = f"substring({text}, at * (n div (t + 1)) + greatest(0, at - (t + 1 - n % (t + 1))) + 1, n div (t + 1) + if(at >= t + 1 - n % (t + 1), 1, 0))".replace("n ", f"{size} ").replace("n)", f"{size})")
    most = f"({e} * ({size} * 100 div {least})) div 100"
    return F.expr(f"flatten(transform(sequence(cast({size} * {e} div 100 as int), cast({most} as int)), t -> transform(sequence(0, t), at -> struct({size} as size, t as edits, at as at, {part} as part))))")


def _substrings(text: str, least: int) -> Column:
    """(size, edits, at, part) of every substring of a text that may be a partner's segment."""
    n, e = f"length({text})", 100 - least
    t = f"cast(greatest({n}, l) * {e} div 100 as int)"
    sizes = f"filter(transform(sequence(cast(greatest(1, {n} - {n} * {e} div 100) as int), cast({n} * 100 div {least} as int)), l -> struct(cast(l as int) as l, {t} as t)), z -> abs({n} - z.l) <= z.t)"
    where = "struct(z.l as l, z.t as t, at as at, at * (z.l div (z.t + 1)) + greatest(0, at - (z.t + 1 - z.l % (z.t + 1))) as p, z.l div (z.t + 1) + if(at >= z.t + 1 - z.l % (z.t + 1), 1, 0) as k)"
    spots = f"flatten(transform({sizes}, z -> transform(sequence(0, z.t), at -> {where})))"
    gap = f"({n} - s.l)"
    low, high = f"greatest(0, s.p - s.at, s.p + {gap} - (s.t - s.at))", f"least({n} - s.k, s.p + s.at, s.p + {gap} + s.t - s.at)"
    found = f"if({low} <= {high}, transform(sequence(cast({low} as int), cast(greatest({low}, {high}) as int)), p -> struct(s.l as size, s.t as edits, s.at as at, substring({text}, p + 1, cast(s.k as int)) as part)), array())"
    return F.expr(f"array_distinct(flatten(transform({spots}, s -> {found})))")


def _rests(text: str, out: str) -> Column:
    """What is left of a text without `out` characters (0 to MOST), each rest once, as 64-bit hashes.

    Characters go from left to right, and of equal neighbours the first goes first: every rest is made in one way only.
    """
    step = "flatten(transform({0}, s -> transform(filter(if(s.i <= length(s.v), sequence(s.i, length(s.v)), array()), i -> i = 1 or substring(s.v, i, 1) <> substring(s.v, i - 1, 1)), i -> struct(concat(substring(s.v, 1, i - 1), substring(s.v, i + 1)) as v, i as i))))"
    made = [f"array(struct({text} as v, 1 as i))"]
    for _ in range(MOST):
        made.append(step.format(made[-1]))
    return F.expr(f"transform(case {' '.join(f'when least({out}, length({text})) = {k} then {m}' for k, m in enumerate(made))} end, s -> xxhash64(s.v))")


def _by_rests(asked: DataFrame, cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(n, size, rest) of names x, and of companies y: a pair of n and size characters within t edits has the rest in common that
    is the longer one's without t characters, and the shorter one's without t less the difference."""
    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but many rests each: the names are spread before
    own = asked.select("x", F.length("x").alias("n"), "size", "edits").distinct().repartition(n, "x", "size")
    theirs = cut.select("y", "size", "edits").distinct().join(F.broadcast(own.select("n", "size", "edits").distinct()), ["size", "edits"]).repartition(n, "y", "n")  # a row two lengths
    x = own.select("x", "n", "size", F.explode(_rests("x", "(edits + least(0, n - size))")).alias("rest"))
    y = theirs.select("y", "n", "size", F.explode(_rests("y", "(edits - greatest(0, n - size))")).alias("rest"))
    return x, y


def alike(left: DataFrame, right: DataFrame, least: int) -> DataFrame:
    """All pairs (x, y) of texts that are at least `least` alike, with ratio. Each side has one column of different texts, x and y.

    Nothing is blocked by how texts begin, and pairs are compared as they are joined, so that only alike ones leave the join. Segments
    that more than HOT texts of the right side share are replaced by rests (`_by_rests`) for pairs that allow MOST edits or fewer;
    for others they are dealt in parts of about HOT.
    """
    if not 60 < least <= 100:
        raise ValueError("names must be more than 60 in 100 alike")
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = right.where("y <> ''").repartition(n, "y").select("y", F.inline(_segments("y", least)))
    asked = left.where("x <> ''").repartition(n, "x").select("x", F.inline(_substrings("x", least)))
    hot = settled(cut.groupBy(*_KEY).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(*_KEY, F.ceil(F.col("n") / HOT).cast("int").alias("parts")), "segments")
    few, many = hot.where(F.col("edits") <= MOST).drop("parts"), hot.where(F.col("edits") > MOST)
    cold = lambda df: df.join(few, _KEY, "left_anti").join(many, _KEY, "left")
    dealt = cold(cut).withColumn("part_no", F.pmod(F.xxhash64("y"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    every = cold(asked).withColumn("part_no", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    ratio = alikeness(F.col("x"), F.col("y"))

    def met(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
        a, b = a.alias("a"), b.alias("b").hint(how)  # never a broadcast: both sides are far larger than the names that they are made of
        return a.join(b, [*(F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys), ratio >= least]).select("x", "y")

    pairs = met(every, dealt, [*_KEY, "part_no"], "merge")
    if few.take(1):
        pairs = pairs.union(met(*_by_rests(asked.join(few, _KEY, "left_semi"), cut.join(few, _KEY, "left_semi")), ["n", "size", "rest"], "shuffle_hash"))  # few companies' rests a task, many names'
    return pairs.distinct().withColumn("ratio", ratio)


def alike_names(names: DataFrame, name: str, companies: DataFrame, least: int) -> DataFrame:
    """names with each company whose name is at least `least` alike (any case), and ratio. Null and empty names have none."""
    pairs = alike(names.select(F.lower(name).alias("x")).where("x is not null").distinct(), companies.select(F.lower("company").alias("y")).where("y is not null").distinct(), least)
    found = pairs.join(companies.withColumn("y", F.lower("company")), "y").drop("y")
    return names.withColumn("x", F.lower(name)).join(found, "x").drop("x")
