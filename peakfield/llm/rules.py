"""Learned decision lists of quality rules, with built-in functions only.

features() gives whole-text statistics as column expressions. fit() grows rules by sequential covering: a rule is a
conjunction of thresholds, grown condition by condition for the best information gain on one part of the labelled rows, then
pruned on the other part, then the rows that it covers are set aside. verdict() is the ordered list as one CASE expression.

Cases: a null or empty text has no words and zero in every count. Rows without a label, or with a null one, teach nothing;
a document with several labels counts once for each. With no labelled rows, or only one class, the list is empty and keeps
all. Ties between conditions go to the feature and threshold that sort first. Repeated rows get the same verdict, as it
depends on the text alone. Columns of the table keep their names, and features get a prefix that is free. Very long texts are counted whole, an
empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import slim, written

#: Fixed values of the base: white space between words, and the characters that count as symbols.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What a rule may test; each is a share or a length, so that it means the same in a short text and a long one.
RATIOS = {
    "words": "n_words",
    "word_length": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "distinct_share": "n_distinct / n_words",
    "upper_share": "n_upper / word_chars",
    "words_per_line": "n_words / n_lines",
}


def features(df: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """df with columns of the whole text's counts and ratios, and these columns by name; their names in the table have a prefix
    that no other column has. One row stays one row; nothing is shuffled.

    Every intermediate is a column of its own, used by those after it, so that the optimizer computes it once. Repeated windows:
    a hash of every window of five words; only where two are equal are hashes and places sorted together, and the words that
    the repeated windows cover summed without counting any twice."""
    prefix = "q_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "q" + prefix
    own = [f"`{c}`" for c in df.columns]

    def then(*names: str, **cols: str) -> None:
        nonlocal df
        df = df.selectExpr(*own, *[f"{prefix}{k}" for k in names], *[f"{e.replace('@', prefix)} as {prefix}{k}" for k, e in cols.items()])

    space = SPACE.replace("\\", "\\\\")
    blank = space.replace("[", "[^")
    then(text=f"coalesce(`{text}`, '')")
    then("text", words=f"array_remove(split(@text, '{space}', -1), '')", lines=f"filter(split(@text, '\\n', -1), x -> x rlike '{blank}')")
    then("text", "words", "lines", hashes="transform(@words, x -> xxhash64(x))")
    more = ("text", "words", "lines", "hashes")
    then(*more, windows="case when size(@hashes) < 5 then array() else transform(sequence(0, size(@hashes) - 5), i -> xxhash64(@hashes[i], @hashes[i + 1], @hashes[i + 2], @hashes[i + 3], @hashes[i + 4])) end")
    # windows sorted by hash, then place: equal ones are neighbours
    then(*more, "windows", placed="case when size(array_distinct(@windows)) < size(@windows) then sort_array(transform(@windows, (x, i) -> named_struct('h', x, 'i', i))) end")
    same = "@placed[{}].h = x.h"
    then(*more, places=f"case when @placed is not null then sort_array(transform(filter(@placed, (x, k) -> (k > 0 and {same.format('greatest(k - 1, 0)')}) or (k < size(@placed) - 1 and {same.format('least(k + 1, size(@placed) - 1)')})), x -> x.i)) end")
    counts = {
        "n_words": "size(@words)",
        "word_chars": "length(array_join(@words, ''))",
        "n_symbols": f"length(regexp_replace(@text, '[^{SYMBOLS}]+', ''))",
        "n_dup_lines": "size(@lines) - size(array_distinct(@lines))",
        "n_repeat_words": "case when @places is null then 0 else aggregate(@places, named_struct('n', 0, 'end', 0), (a, p) -> named_struct('n', a.n + p + 5 - greatest(p, a.end), 'end', p + 5), a -> a.n) end",
        "n_lines": "size(@lines)",
        "n_distinct": "size(array_distinct(@hashes))",
        "n_upper": "length(regexp_replace(@text, '[^A-Z]+', ''))",
    }
    # a generator of one row: the optimizer moves no filter on the counts below it, where it would write all of the above into the filter
    fields = ", ".join(f"'{prefix}{k}', cast({e.replace('@', prefix)} as bigint)" for k, e in counts.items())
    df = df.selectExpr(*own, f"inline(array(named_struct({fields})))")
    ratios = {k: f"coalesce(try_divide({', '.join('@' + x for x in e.split(' / '))}), 0D)" if " / " in e else f"cast(@{e} as double)" for k, e in RATIOS.items()}
    then(*counts, **ratios)
    return df, {k: F.col(prefix + k) for k in (*counts, *RATIOS)}


def base_failed(stats: dict[str, Column]) -> Column:
    """Fewer than ten words, or more than a fifth of the words in repeated windows."""
    return (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])


@dataclass
class Rule:
    """Rejects a text that meets all conditions: (feature, '>=' or '<', threshold)."""

    conditions: list[tuple[str, str, float]] = field(default_factory=list)
    covered: int = 0
    precision: float = 0.0

    def column(self, stats: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, sign, at in self.conditions:
            out = out & (stats[name] >= at if sign == ">=" else stats[name] < at)
        return out


@dataclass
class DecisionList:
    rules: list[Rule]

    def verdict(self, stats: dict[str, Column]) -> Column:
        """Number of the first rule that rejects the text, from 1 in the order learned, or 0: keep."""
        if not self.rules:
            return F.lit(0)
        out = F.when(self.rules[0].column(stats), 1)
        for k, r in enumerate(self.rules[1:], 2):
            out = out.when(r.column(stats), k)
        return out.otherwise(0)


def lowest(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """The rows, bound at most, whose keys hash lowest. A cut among the hashes that leaves bound rows or more is found by counts first, so that about so many
    rows are sorted, whatever the number of partitions."""
    share = 1.25 * bound / max(1, rows.count())
    while share < 1:
        below = rows.where(F.xxhash64(key) < int(share * 2.0**64) - (1 << 63))
        if below.count() >= bound:
            rows = below
            break
        share *= 2
    return rows.orderBy(F.xxhash64(key), key, *[c for c in rows.columns if c != key]).limit(bound)


def labelled(df: DataFrame, labels: DataFrame, bound: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The ratios and bad (quality 0) of at most bound labelled documents, those whose ids hash lowest; the bound also makes the
    ids small enough to broadcast, so that only their texts leave the scan."""
    some = labels.where("quality is not null").select(F.col("doc_id").alias("__id"), (F.col("quality") == 0).alias("bad"))
    rows = slim(df, __id=key, text=text).join(F.broadcast(lowest(some, "__id", bound)), "__id")
    rows, stats = features(rows)
    return rows.select("bad", *[stats[k].alias(k) for k in RATIOS], F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(3)).alias("fold"))


def fit(rows: DataFrame, max_rules: int = 8, max_conditions: int = 3, steps: int = 32, least_precision: float = 0.95, least_cover: int = 30) -> DecisionList:
    """rows: bad, fold and the ratios, as labelled() gives them. Every step is one aggregation over all rows; the driver sees counts for
    each feature and threshold only, whatever the number of rows."""
    names = list(RATIOS)
    rows = written(rows, "labelled")
    grid = rows.agg(*[F.expr(f"percentile_approx({k}, array({', '.join(f'{i / steps:.6f}D' for i in range(1, steps))}), 10000)").alias(k) for k in names]).first()
    cuts = {k: sorted(set(grid[k] or [])) for k in names}
    stats, left, rules = {k: F.col(k) for k in names}, rows, []
    place = lambda k: F.expr(f"size(filter(array({', '.join(f'{c!r}D' for c in cuts[k])}), c -> c <= {k}))") if cuts[k] else F.lit(0)
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), place(k).alias("place")) for k in names]))

    def tally(part: DataFrame) -> dict[str, dict[int, tuple[int, int]]]:
        out: dict = {k: {} for k in names}
        for r in part.select("bad", long.alias("x")).groupBy("x.name", "x.place").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect():
            out[r["name"]][r["place"]] = (r.p, r.n)
        return out

    def best(part: DataFrame) -> tuple[float, tuple, int, int] | None:
        found, counts = None, tally(part)
        p0, n0 = (sum(v[i] for v in counts[names[0]].values()) for i in (0, 1))
        if not p0 or not n0:
            return None
        for k in names:
            for i, cut in enumerate(cuts[k], 1):
                above = [sum(v[j] for at, v in counts[k].items() if at >= i) for j in (0, 1)]
                for sign, (p, n) in ((">=", above), ("<", (p0 - above[0], n0 - above[1]))):
                    gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0
                    if gain > (found[0] if found else 1e-9):
                        found = gain, (k, sign, cut), p, n
        return found

    for _ in range(max_rules):
        grow, prune, rule = left.where("fold != 0"), left.where("fold = 0"), Rule()
        while len(rule.conditions) < max_conditions and (got := best(grow.where(rule.column(stats)))):
            rule.conditions.append(got[1])
            if got[3] == 0:
                break
        if not rule.conditions:
            break
        parts = [Rule(rule.conditions[:i]) for i in range(1, len(rule.conditions) + 1)]
        c = prune.agg(*[F.count_if((F.col("bad") == b) & r.column(stats)).alias(f"{'pn'[1 - b]}{i}") for i, r in enumerate(parts) for b in (True, False)]).first()
        worth = [(c[f"p{i}"] - c[f"n{i}"]) / max(1, c[f"p{i}"] + c[f"n{i}"]) for i in range(len(parts))]
        i = max(range(len(parts)), key=lambda i: (worth[i], -i))
        rule, p, n = parts[i], c[f"p{i}"], c[f"n{i}"]
        if p + n < least_cover / 3 or p < least_precision * (p + n):
            break
        rule.covered, rule.precision = p + n, p / (p + n)
        rules.append(rule)
        left = left.where(~rule.column(stats))
    return DecisionList(rules)
