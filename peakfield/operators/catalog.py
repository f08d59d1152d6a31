"""Catalogs of micrographs and jobs: joins, ranges, differences and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import indexed


def last_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, as a later duplicate of a group wins; counted inside partitions first."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("x")).select(key, "x.*")


def first_present(*cols):
    """The first value that is neither null nor one of the tokens for none."""
    return F.coalesce(*[F.when(~c.isin("", ".", "?", "None"), c) for c in cols[:-1]], cols[-1])


def ranked_range(df: DataFrame, order: str, first: int, last: int) -> DataFrame:
    """Rows first to last, both included, from 0 in the given order."""
    return indexed(df, order).where(F.col("row_index").between(first, last)).withColumn("row_index", F.col("row_index").cast("int"))


def compared(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join on a key with the status of each."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    status = F.when(F.col("l").isNull(), "missing_reference").when(F.col("r").isNull(), "missing_candidate").otherwise("compared")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def with_missing(jobs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Results of all jobs: those of the table of results, and `failed` for jobs without one."""
    ok = jobs.select(key).join(done.select(key), key, "left_semi").withColumn("status", F.lit("ok"))
    return ok.unionByName(jobs.select(key).join(done.select(key), key, "left_anti").withColumn("status", F.lit("failed")))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def error_metrics(df: DataFrame, reference: str, candidate: str, rtol: float = 1e-5, atol: float = 1e-6) -> DataFrame:
    d = F.abs(F.col(candidate) - F.col(reference))
    return df.agg(
        F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"), F.sqrt(F.avg(d * d)).alias("rmse"),
        (F.sqrt(F.sum(d * d)) / F.sqrt(F.sum(F.col(reference) * F.col(reference)))).alias("relative_l2"),
        F.bool_and(d <= atol + rtol * F.abs(F.col(reference))).alias("all_close"),
    )


#: Shares that a report of percentiles gives.
SHARES = (0.5, 0.9, 0.95, 0.99)


def percentiles(df: DataFrame, value: str, group: str) -> DataFrame:
    """Exact percentiles, of one table of counts of values for each group, and the mean, least, most and number."""
    one = df.groupBy(group).agg(F.percentile(value, F.array(*[F.lit(q) for q in SHARES])).alias("p"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.count("*").alias("n"))
    return one.select(group, *[F.get("p", i).alias(f"p{round(100 * q)}") for i, q in enumerate(SHARES)], "mean", "least", "most", "n")


#: The spaces of Unicode (its space separators), which stand around a field; line and other control characters are none.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def fixed_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each line of each text that is not null: key, line (from 1), record, chain, element, x, y, z. The element is that of columns 77 and 78, or else the first
    letter of the name; a coordinate that is no decimal number, but for spaces of any kind around it, is null. Lines end with a line feed, alone or after a carriage return."""
    line = df.select(key, F.posexplode(F.split(text, "\r?\n")).alias("at", "row"))
    # \z, as $ also matches before a line's end
    number = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\z"
    bare = lambda c: F.btrim(c, F.lit(SPACES))

    def place(at: int):
        t = bare(F.substring("row", at, 8))
        return F.when(t.rlike(number), t.try_cast("double"))

    stated = bare(F.substring("row", 77, 2))
    element = F.when(stated != "", stated).otherwise(F.regexp_extract(F.substring("row", 13, 4), "[A-Za-z]", 0))
    fields = [F.substring("row", 1, 6).alias("record"), F.substring("row", 22, 1).alias("chain"), element.alias("element"), place(31).alias("x"), place(39).alias("y"), place(47).alias("z")]
    return line.select(key, (F.col("at") + 1).cast("long").alias("line"), *fields)
