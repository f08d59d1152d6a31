"""URL filters whose lists change over time: every capture is judged by the entries active when it was fetched.

Dated changes of an entry (add or remove) become validity intervals, each up to the next change of the same entry. A capture asks
for its own keys: its host, all parent domains, and all path prefixes. The as-of join is an equi-join on key and time bucket,
which an interval enters once for each bucket that it covers, with the exact times compared after it; so neither a long history nor a
busy key brings rows of other times together. Keys that are on no list, such as top-level domains, are dropped before they are shuffled. Of the active entries the most specific decides; of equal ones, a block.

Cases: a null url or fetch time matches nothing and is kept. Changes with a null key, action or time are left out. Changes of one entry
at the same time: the remove counts last. Repeated changes and captures count once and are judged alike. Empty lists keep all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import written

BUCKET_DAYS = 32
#: Cells of the filter of listed keys: so many for each, and at most 4 MB in words of 64 cells; with more keys it lets more through, and the join decides.
CELLS_PER_KEY, LEAST_CELLS, MOST_CELLS = 16, 1 << 10, 1 << 24


def intervals(changes: DataFrame) -> DataFrame:
    """changes: list, kind (domain or prefix), key, verdict (block or allow), action (add or remove), at (date). One row for each time
    that an entry was active: since, until (exclusive, null: still active)."""
    entry = ["list", "kind", "key", "verdict"]
    own = changes.select(*entry, "action", "at").where("key is not null and action is not null and at is not null")
    # of changes at the same time the remove, which is the greater word, stays; counted inside each partition first
    last = own.groupBy(*entry, "at").agg(F.max("action").alias("action"))
    w = Window.partitionBy(*entry).orderBy("at")
    return last.withColumn("until", F.lead("at").over(w)).where("action = 'add'").select(*entry, F.col("at").alias("since"), "until")


def keys(captures: DataFrame) -> DataFrame:
    """id, url, fetched, kind, key: what a capture may be listed under."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?([^?#]*)", 1)
    rows = captures.where("url is not null and fetched is not null").select("id", "url", "fetched", F.split(host, r"\.").alias("h"), F.array_remove(F.split(path, "/"), "").alias("p"))
    domains = F.expr("transform(sequence(1, size(h)), i -> named_struct('kind', 'domain', 'key', array_join(slice(h, i, size(h)), '.')))")
    prefixes = F.expr("transform(sequence(0, size(p)), i -> named_struct('kind', 'prefix', 'key', concat_ws('/', array_join(h, '.'), array_join(slice(p, 1, i), '/'))))")
    return rows.where(F.expr("h[0] != ''")).select("id", "url", "fetched", F.explode(F.array_distinct(F.concat(domains, prefixes))).alias("k")).select("id", "url", "fetched", "k.kind", "k.key")


def judge(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """id, url, fetched, verdict (keep, block or allow), list, key and since of the entry that decided, for each distinct capture
    (id, url, fetched: date)."""
    captures = captures.select("id", "url", "fetched")
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / BUCKET_DAYS)
    span = captures.agg(F.min("fetched").alias("lo"), F.max("fetched").alias("hi"))  # one row
    active = intervals(changes).crossJoin(F.broadcast(span)).where("since <= hi and (until is null or until > lo)")
    active = active.withColumn("bucket", F.explode(F.sequence(bucket(F.greatest("since", "lo")), bucket(F.least(F.coalesce(F.date_sub("until", 1), F.col("hi")), F.col("hi")))))).drop("lo", "hi")
    # most keys that captures ask for, top-level domains above all, are on no list: those that are pass a filter of hashes before anything is shuffled
    listed = active.select("kind", "key").distinct()
    size = min(MOST_CELLS, max(LEAST_CELLS, 1 << (CELLS_PER_KEY * listed.count()).bit_length()))
    cell = lambda: F.pmod(F.xxhash64("kind", "key"), F.lit(size))
    words = written(listed.select(cell().alias("c")).groupBy(F.floor(F.col("c") / 64).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(c % 64 as int))) as bits")), "listed")
    own = keys(captures).withColumns({"word": F.floor(cell() / 64), "bit": (cell() % 64).cast("int")})
    asked = own.join(F.broadcast(words), "word").where(F.getbit("bits", F.col("bit")) == 1).drop("word", "bits", "bit").withColumn("bucket", bucket(F.col("fetched")))
    hit = asked.join(active, ["kind", "key", "bucket"]).where("since <= fetched and (until is null or fetched < until)")
    rank = F.struct(F.length("key").alias("n"), F.col("kind").alias("k"), (F.col("verdict") == "block").alias("b"), "since", "list", "key")
    best = hit.groupBy("id", "url", "fetched").agg(F.max(F.struct(rank.alias("rank"), "verdict")).alias("x")).select(F.col("id").alias("i"), F.col("url").alias("u"), F.col("fetched").alias("f"), "x")
    every = captures.distinct()
    on = every["id"].eqNullSafe(best["i"]) & (every["url"] == best["u"]) & (every["fetched"] == best["f"])
    return every.join(best, on, "left").select("id", "url", "fetched", F.coalesce("x.verdict", F.lit("keep")).alias("verdict"), F.col("x.rank.list").alias("list"), F.col("x.rank.key").alias("key"), F.col("x.rank.since").alias("since"))


#: Lists and fetch times that the pages themselves give, as the tables have none: a number from the md5 of a name sets dates.
NUMBER = "cast(conv(substr(md5({}), 1, 7), 16, 10) as bigint)"


def fetch_times(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").alias("id"), "url", F.expr(f"date_add(date'2023-01-01', cast({NUMBER.format('cast(page_id as string)')} % 730 as int))").alias("fetched"))


def listed(pages: DataFrame) -> DataFrame:
    """Changes for the hosts and first path segments of all pages: each is added, removed and perhaps added again at dates that its name gives; three of
    eight hosts are blocked, and one of four path prefixes is allowed."""
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]*)", 1))
    first = F.regexp_extract("url", r"^[a-z]+://[^/?#]*/([^/?#]*)", 1)
    hosts = pages.select(F.lit("hosts").alias("list"), F.lit("domain").alias("kind"), host.alias("key"), F.lit("block").alias("verdict"), F.lit(8).alias("of"), F.lit(3).alias("take"))
    parts = pages.select(F.lit("paths"), F.lit("prefix"), F.concat_ws("/", host, first), F.lit("allow"), F.lit(4), F.lit(1))
    n = F.expr(NUMBER.format("key"))
    own = hosts.union(parts).distinct().withColumn("n", n).where("n % of < take")
    day = lambda e: F.expr(f"date_add(date'2023-01-01', cast({e} as int))")
    step = lambda action, at: F.struct(F.lit(action).alias("action"), day(at).alias("at"))
    steps = F.array(step("add", "(n div 8) % 300"), step("remove", "(n div 8) % 300 + 30 + (n div 64) % 200"), step("add", "(n div 8) % 300 + 300 + (n div 512) % 300"))
    return own.select("list", "kind", "key", "verdict", F.explode(steps).alias("s")).select("list", "kind", "key", "verdict", "s.*")
