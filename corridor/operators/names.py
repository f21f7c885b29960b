"""Names matched to an alias table within a bounded edit distance.

Names that no alias equals are compared with aliases that share a rare token. Tokens are
2-grams (numbered when they repeat): an edit changes at most two of them, so of two strings
within k edits the 2k+1 rarest tokens of each meet, in one order of rarity for all strings. A
string too short for that has all its forms with up to k characters left out as tokens; strings
within k edits of each other share one. Only pairs that meet in a token are verified, by the
edit distance itself, bounded at k. No pair of all names and all aliases is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .coverage import _norm
from .joins import small

Q = 2


def _grams(text: Column) -> Column:
    """The 2-grams of the padded text, each with the number of equal ones before it."""
    padded = F.concat(F.lit("\x02"), text, F.lit("\x03"))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - (Q - 1)), lambda i: padded.substr(i, F.lit(Q)))
    return F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, F.lit(1), i), lambda h: h == g)).cast("string")))


def _shorter(text: Column, k: int) -> Column:
    """All forms of the text with up to k characters left out, marked as such."""
    forms = F.array(text)
    for _ in range(k):
        cut = F.transform(forms, lambda s: F.when(F.length(s) > 0, F.transform(
            F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.length(s))))).otherwise(F.array().cast("array<string>")))
        forms = F.array_distinct(F.concat(forms, F.flatten(cut)))
    return F.transform(forms, lambda s: F.concat(F.lit("\x04"), s))


def tokens(strings: DataFrame, column: str, frequency: DataFrame, k: int) -> DataFrame:
    """(column, token): the tokens under which a string is looked up; ``frequency``: (gram, n) over all strings."""
    # a string of at most Q*k grams may share none with its neighbours; those have at most k more
    short = F.length(column) + 1 <= (Q + 1) * k
    by_gram = strings.select(column, F.explode(_grams(F.col(column))).alias("gram")).join(small(frequency), "gram")
    rare = F.slice(F.transform(F.sort_array(F.collect_list(F.struct("n", "gram"))), lambda x: x["gram"]), 1, Q * k + 1)
    by_gram = by_gram.groupBy(column).agg(rare.alias("rare")).select(column, F.explode("rare").alias("token"))
    return by_gram.unionByName(strings.where(short).select(column, F.explode(_shorter(F.col(column), k)).alias("token")))


def candidates(names: DataFrame, aliases: DataFrame, k: int = 2) -> DataFrame:
    """(name, alias, distance) of all pairs within k edits; ``names`` (name) and ``aliases`` (alias) are distinct."""
    both = names.select(F.col("name").alias("s")).unionByName(aliases.select(F.col("alias").alias("s")))
    frequency = both.select(F.explode(_grams(F.col("s"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    met = tokens(names, "name", frequency, k).join(tokens(aliases, "alias", frequency, k), "token")
    met = met.where(F.abs(F.length("name") - F.length("alias")) <= k).select("name", "alias").distinct()
    return met.withColumn("distance", F.levenshtein("name", "alias", k)).where(F.col("distance") >= 0)


def resolve_near(df: DataFrame, name_col: str, aliases: DataFrame, k: int = 2) -> DataFrame:
    """(name, n_rows, iso3, distance, candidates, status) of every distinct name of ``df``.

    ``status``: ``exact`` (an alias equals the name but for case and spaces at the ends), ``near``
    (the nearest aliases within k edits have one code), ``ambiguous`` (several codes: none is
    chosen, all are listed), ``none``; a null name is ``none``. An alias with several codes is ambiguous too. Aliases without a text or code are ignored.
    """
    counted = df.groupBy(F.col(name_col).alias("name")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("norm", _norm(F.col("name")))
    al = aliases.select(_norm(F.col("alias")).alias("alias"), "iso3").where(F.col("alias").isNotNull() & F.col("iso3").isNotNull()).distinct()
    known = al.select("alias").distinct()
    unknown = counted.select("norm").where(F.col("norm").isNotNull()).distinct().join(known, F.col("norm") == F.col("alias"), "left_anti")
    near = candidates(unknown.select(F.col("norm").alias("name")), known, k)
    exact = known.select(F.col("alias").alias("name"), "alias", F.lit(0).alias("distance")).join(counted.select(F.col("norm").alias("name")).distinct(), "name", "left_semi")
    pairs = near.unionByName(exact).join(al, "alias")
    per = pairs.groupBy("name", "distance").agg(F.array_sort(F.collect_set("iso3")).alias("codes"))
    best = per.groupBy(F.col("name").alias("norm")).agg(F.min("distance").alias("distance"), F.min_by("codes", "distance").alias("codes"))
    one = F.size("codes") == 1
    found = counted.join(best, "norm", "left")
    status = F.when(F.col("codes").isNull(), "none").when(~one, "ambiguous").when(F.col("distance") == 0, "exact").otherwise("near")
    return found.select("name", "n_rows", F.when(one, F.col("codes")[0]).alias("iso3"), "distance", F.array_join("codes", ",").alias("candidates"), status.alias("status"))
