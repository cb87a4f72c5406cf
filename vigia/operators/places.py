"""Place names, drill-down and rates per inhabitant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigia.functions.text import STANDARD_TEXT, without_accents
from vigia.model import DEFAULT, Columns
from vigia.operators.clean import in_steps

# Short forms of the capital's name without accents, and the full form.
CAPITAL_ALIASES = {"S.PAULO": "SAO PAULO", "S. PAULO": "SAO PAULO", "SP": "SAO PAULO"}


def normalise_names(df: DataFrame, aliases: DataFrame | None = None, column: str = DEFAULT.city) -> DataFrame:
    """Put place names into one spelling: upper case, no accents, short forms spelled out.

    A longer alias list comes as a DataFrame (alias, name). It is reduced to one name per
    alias and joined without a hint: Spark broadcasts it when its size allows and otherwise
    shuffles, splitting hot names.
    """
    plain = in_steps(df, {column: (*STANDARD_TEXT, without_accents)})
    if aliases is None:
        return plain.replace(CAPITAL_ALIASES, subset=[column])
    one_name = aliases.groupBy(F.col("alias").alias("_alias")).agg(F.min("name").alias("_name"))
    joined = plain.join(one_name, F.col(column) == F.col("_alias"), "left")
    name = F.coalesce(F.col("_name"), F.col(column))
    return joined.withColumn(column, name).drop("_alias", "_name")


def drill_down(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Counts for the whole, each municipality and each neighbourhood (``level`` 0, 1, 2).

    Rows are counted per neighbourhood first; the rollup expands those counts, not the rows.
    """
    places = [cols.city, cols.district]
    counts = df.groupBy(*places).agg(F.count("*").alias("n"))
    level = F.lit(2) - F.grouping(cols.city) - F.grouping(cols.district)
    return counts.rollup(*places).agg(
        level.cast("int").alias("level"), F.sum("n").alias("occurrences")
    )


def rate_per_capita(
    df: DataFrame,
    population: DataFrame,
    per: int = 100_000,
    column: str = DEFAULT.city,
    aliases: DataFrame | None = None,
) -> DataFrame:
    """Rows per ``per`` inhabitants; null where the population is unknown or zero.

    Names on both sides are put into one spelling first (``aliases`` as in ``normalise_names``),
    so that a place has one rate. Both sides have one row per place before they meet.
    """
    named = normalise_names(df.select(column), aliases, column)
    counts = named.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("occurrences"))
    people = normalise_names(population, aliases, column).groupBy(column).agg(F.sum("population").alias("population"))
    rate = F.try_divide(F.col("occurrences"), F.col("population")) * per
    return counts.join(people, column, "left").withColumn("rate", rate)


def without_letters(c: Column, most: int) -> Column:
    """A text and all that is left of it after taking up to ``most`` characters out."""
    out = F.array(c)
    for _ in range(most):
        one_less = F.transform(out, lambda t: F.transform(
            F.sequence(F.lit(1), F.greatest(F.char_length(t), F.lit(1))),
            lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.char_length(t))),
        ))
        out = F.array_distinct(F.concat(out, F.flatten(one_less)))
    return out


def allowed_distance(length: Column) -> Column:
    """How many letters may be wrong: none of three, one of seven, two of more."""
    return F.when(length >= 8, 2).when(length >= 4, 1).otherwise(0)


def nearest_names(values: DataFrame, names: DataFrame, column: str = DEFAULT.city) -> DataFrame:
    """(column, name): the misspelled among the distinct ``values`` and the name each is nearest to.

    A value is taken for the name (column ``name`` of ``names``) of the smallest edit distance that
    ``allowed_distance`` of the name's length lets pass; values that are names themselves, and those
    as near to several, are left out. Two texts at most two edits apart have a text in common after
    each has lost up to two letters: values and names meet by an equal join on these, and only what
    meets is measured. Values much longer than any name meet none and are not cut up.
    """
    known = names.select(F.col("name")).where(F.col("name").isNotNull()).distinct()
    longest = known.agg(F.max(F.char_length("name"))).first()[0] or 0
    asked = values.select(F.col(column).alias("value")).where(F.char_length("value") <= longest + 2).distinct()
    asked = asked.join(known, F.col("value") == F.col("name"), "left_anti")
    left = asked.select("value", F.explode(without_letters(F.col("value"), 2)).alias("part"))
    right = known.select("name", F.explode(without_letters(F.col("name"), 2)).alias("part"))
    met = left.join(right, "part").select("value", "name").distinct()
    measured = met.withColumn("distance", F.levenshtein("value", "name"))
    near = measured.where(F.col("distance") <= allowed_distance(F.char_length("name")))
    best = near.groupBy("value", "distance").agg(F.min("name").alias("name"), F.count("*").alias("n"))
    best = best.groupBy("value").agg(F.min_by(F.struct("name", "n"), "distance").alias("best"))
    return best.where("best.n = 1").select(F.col("value").alias(column), "best.name")


def correct_names(
    df: DataFrame, names: DataFrame, column: str = DEFAULT.city, aliases: DataFrame | None = None
) -> DataFrame:
    """``normalise_names``, then misspelled ones replaced by what ``nearest_names`` finds; others stay.

    The corrections, one row per misspelling, are joined without a hint.
    """
    plain = normalise_names(df, aliases, column)
    spelled = names.select(without_accents(F.upper(F.trim("name"))).alias("name"))
    longer = "_" * (1 + max(map(len, plain.columns)))  # names that the table does not have
    wrong, right = f"{longer}wrong", f"{longer}right"
    found = nearest_names(plain.select(column), spelled, column).withColumnsRenamed({column: wrong, "name": right})
    joined = plain.join(found, F.col(column) == F.col(wrong), "left")
    return joined.withColumn(column, F.coalesce(right, column)).drop(wrong, right)


def rate_by_year(
    df: DataFrame,
    censuses: DataFrame,
    per: int = 100_000,
    cols: Columns = DEFAULT,
    aliases: DataFrame | None = None,
) -> DataFrame:
    """Rows per ``per`` inhabitants of each place and year, by the latest census not after the year.

    ``censuses`` has the place, ``census_year`` and ``population`` (rows of one place and year add
    up). Before a place's first census the population is null, as is the rate. Counts and censuses,
    one row per place and year each, are laid in one sequence per place, in which every count takes
    the last census before it: one shuffle, and no pairs.
    """
    city, year = cols.city, cols.year
    named = normalise_names(df.select(city, year), aliases, city).where(F.col(city).isNotNull() & F.col(year).isNotNull())
    counts = named.groupBy(city, year).agg(F.count("*").alias("occurrences"))
    people = normalise_names(censuses, aliases, city).where(F.col("census_year").isNotNull())
    people = people.groupBy(city, "census_year").agg(F.sum("population").alias("population"))
    census = F.struct("census_year", "population")
    both = counts.select(city, year, "occurrences", F.lit(None).cast(people.select(census).schema[0].dataType).alias("census")).union(
        people.select(city, F.col("census_year").cast(counts.schema[year].dataType).alias(year), F.lit(None).cast("long"), census)
    )
    # a census of the year itself comes before its count
    order = Window.partitionBy(city).orderBy(year, F.col("occurrences").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("census", F.last("census", True).over(order)).where(F.col("occurrences").isNotNull())
    rate = F.try_divide(F.col("occurrences"), F.col("population")) * per
    return held.select(city, year, "occurrences", "census.census_year", "census.population").withColumn("rate", rate)
