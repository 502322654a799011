"""Relational operators that Spark SQL has no word for: distinct-on, keep-first, upserts, division, cascades.

Every operator that picks a row takes a total order, so results do not depend on how rows are dealt out. Orders are
lists of columns such as F.desc("score"); ties that are left are broken by the whole row where that is said.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.scratch import materialise


def distinct_on(df: DataFrame, keys: list[str], order: list[Column], limit: int | None = None, limit_by: list[Column] | None = None) -> DataFrame:
    """One row for each key, the first in the order. limit keeps so many of them by limit_by (default: the keys)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    return out if limit is None else out.orderBy(*(limit_by or keys)).limit(limit)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each key; with their rank from 1, if it is given a name."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k)
    return out.drop("__r") if rank is None else out.withColumnRenamed("__r", rank)


def ranked(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """Rows numbered from 1 in a total order. Numbers come from range partitions and the sizes of those before, so no
    single task sorts all rows."""
    names = df.columns
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    parts = materialise(parts)  # dealt out once: a second exchange could get other bounds
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__i").alias("__first"))
    before = sizes.select("__p", "__first", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return parts.join(F.broadcast(before), "__p").select(*names, (F.col("__b") + F.col("__i") - F.col("__first") + 1).alias(rank))


def keep_max(df: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """One row for each key, that with the largest `by` (a struct for ties), by aggregation and without a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("__row")).select(*keys, "__row.*")


def upsert_last(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The union, of which the row with the latest order stays for each key; on ties the new one."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return keep_max(both, keys, F.struct(order, "__new")).drop("__new")


def upsert_coalesce(old: DataFrame, new: DataFrame, keys: list[str], prefer_new: bool = True) -> DataFrame:
    """New values over old ones where they are not null, or the other way round; new must have each key once."""
    a, b = old.alias("a"), new.alias("b")
    rest = [c for c in old.columns if c not in keys]
    pick = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) if prefer_new else F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}"))
    return a.join(b, keys, "full_outer").select(*keys, *(pick(c).alias(c) for c in rest))


def upsert_counters(updates: DataFrame, keys: list[str], counters: list[str], state: str, order: str) -> DataFrame:
    """Counters add up; the state is the last in the order."""
    return updates.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in counters), F.max_by(state, order).alias(state))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old rows, and new ones of keys that were not there: the first of each in the order."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__row")).select(*keys, "__row.*")
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti"))


def having_all(df: DataFrame, key: str, item: str, wanted: DataFrame) -> DataFrame:
    """Relational division: the keys that have every item of wanted (one column). Only matching rows are shuffled."""
    need = wanted.select(F.col(wanted.columns[0]).alias("__item")).distinct()
    hits = df.select(key, item).join(need, F.col(item) == F.col("__item"), "left_semi").groupBy(key).agg(F.count_distinct(item).alias("__n"))
    return hits.join(need.agg(F.count("*").alias("__all")), F.col("__n") == F.col("__all"), "left_semi").select(key)


def cascade(df: DataFrame, lookups: list[tuple[str, DataFrame, str, str]], out: str) -> DataFrame:
    """The first lookup that knows a row gives its value. lookups: the row's column, a table, its key and its value;
    a key that a table has twice gives its smallest value."""
    hits = []
    for i, (own, table, key, value) in enumerate(lookups):
        one = table.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"__k{i}")).agg(F.min(value).alias(f"__v{i}"))
        df = df.join(one, F.col(own) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
        hits.append(f"__v{i}")
    return df.withColumn(out, F.coalesce(*hits)).drop(*hits)


def share(part: Column, whole: Column, digits: int = 2) -> Column:
    """A percentage; null where there is nothing."""
    return F.round(F.try_divide(part * 100.0, whole), digits)


def bucketed(value: Column, bounds: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first bound that the value is below."""
    first, *more = bounds
    out = F.when(value < first[0], first[1])
    for b, name in more:
        out = out.when(value < b, name)
    return out.otherwise(rest)


def where(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Only the conditions that are set."""
    return reduce(lambda d, c: d.filter(c), (c for c in conditions if c is not None), df)


def year_between(year: str, low: int | None, high: int | None) -> Column | None:
    """A bound of None or 0 is none."""
    parts = [F.col(year) >= low] if low else []
    parts += [F.col(year) <= high] if high else []
    return reduce(lambda a, b: a & b, parts) if parts else None


def contains_all(joined: Column, terms: list[str]) -> Column:
    """Each term is part of the joined text; so it is found within longer names too."""
    return reduce(lambda a, b: a & b, (joined.contains(t) for t in terms), F.lit(True))


def has_all(items: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.array_contains(items, t) for t in terms), F.lit(True))


def wildcard(value: Column, pattern: str) -> Column:
    """* stands for anything; without it, equality."""
    return value.like(pattern.replace("*", "%")) if "*" in pattern else value == pattern


def matches_any(value: Column, terms: list[str]) -> Column:
    """ILIKE %term% for some term; _ and % in a term are wildcards."""
    return reduce(lambda a, b: a | b, (value.ilike(f"%{t}%") for t in terms), F.lit(False))


def junk_name(name: Column, known: tuple[str, ...] = ("unknown", "none", "other", "misc", "n_a")) -> Column:
    return name.isin(*known) | name.startswith("test_") | name.startswith("_") | (F.length(name) <= 2)


#: Nodes of a parsed plan that only read; any other refuses the statement.
READING = frozenset("Project Filter Join Aggregate Sort GlobalLimit LocalLimit Limit Offset Tail UnresolvedRelation SubqueryAlias Union Distinct OneRowRelation UnresolvedWith UnresolvedInlineTable UnresolvedHaving Generate Except Intersect UnresolvedSubqueryColumnAliases WithWindowDefinition Sample Pivot Unpivot LateralJoin UnresolvedTableValuedFunction LocalRelation Window".split())
#: Functions that call other code, or read other files than tables.
CALLING = frozenset("reflect java_method try_reflect read_files sql_keywords python_worker_logs".split())


def _members(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


class _Known:
    """What a statement may use: functions, and tables (None: any that has a name of one part, which is never a file)."""

    def __init__(self, functions: set[str], tables: set[str] | None):
        self.functions, self.tables, self.common = functions, tables, set()

    def table(self, name: str, parts: int) -> bool:
        if self.tables is not None:
            return name in self.tables or (parts == 1 and name in self.common)
        return parts == 1


def _reads(plan, known: _Known) -> bool:
    kind = plan.getClass().getSimpleName().rstrip("$")
    if kind not in READING:
        return False
    if kind == "UnresolvedWith":
        known.common |= {x._1().lower() for x in _members(plan.cteRelations())}
    if kind == "UnresolvedRelation" and not known.table(".".join(parts := _members(plan.multipartIdentifier())).lower(), len(parts)):
        return False
    if kind == "UnresolvedTableValuedFunction" and ".".join(_members(plan.name())).lower() not in known.functions:
        return False
    return all(_reads(x, known) for x in [*_members(plan.children()), *(x for x in _members(plan.innerChildren()) if hasattr(x, "children") and "plans.logical" in x.getClass().getName())]) and all(_calls_known(e, known) for e in _members(plan.expressions()))


def _calls_known(e, known: _Known) -> bool:
    kind = e.getClass().getSimpleName()
    if kind == "UnresolvedFunction" and ".".join(_members(e.nameParts())).lower() not in known.functions:
        return False
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery") and not _reads(e.plan(), known):
        return False
    return all(_calls_known(x, known) for x in _members(e.children()))


def read_only(spark, sql: str, tables: list[str] | None = None) -> bool:
    """Whether a statement only reads: all nodes of its parsed plan, with those of common tables and subqueries, are
    known to read, all functions are built in and call no other code, and all relations are names: of `tables` (which may
    have several parts) and the statement's own common tables, or, if no list is given, of one part. A name of two parts such
    as csv.`/path` would read a file."""
    state = spark._jsparkSession.sessionState()
    builtin = spark._jvm.org.apache.spark.sql.catalyst.analysis
    known = set()
    for registry in (builtin.FunctionRegistry.builtin(), builtin.TableFunctionRegistry.builtin()):
        known |= {f.funcName().lower() for f in _members(registry.listFunction())}
    return _reads(state.sqlParser().parsePlan(sql), _Known(known - CALLING, None if tables is None else {x.lower() for x in tables}))
