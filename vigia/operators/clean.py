"""Cleaning of raw, all-string exports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigia.functions.dates import DAY_FIRST_TIMESTAMP
from vigia.functions.numbers import DECIMAL_COMMA, WHOLE_NUMBER, inside_box
from vigia.functions.text import KEY_TEXT, STANDARD_TEXT
from vigia.model import DEFAULT, Columns

Steps = Sequence[Callable[[Column], Column]]


def in_steps(df: DataFrame, columns: Mapping[str, Steps]) -> DataFrame:
    """Replace each column by its steps, all first steps in one projection, then the second.

    A step uses its input more than once; as one nested expression the inner steps would be
    evaluated once per use, which Spark does not share between branches of a condition.
    """
    for i in range(max(map(len, columns.values()), default=0)):
        df = df.withColumns(
            {c: steps[i](F.col(c)) for c, steps in columns.items() if i < len(steps)}
        )
    return df


def text_columns(df: DataFrame, cols: Columns = DEFAULT) -> list[str]:
    """String columns that are not keys, dates, numbers or coordinates."""
    other = {*cols.keys, *cols.integers, *cols.timestamps, *cols.coordinates}
    return [
        f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in other
    ]


def clean_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Upper case, stripped, texts that mean "missing" to null."""
    return in_steps(df, dict.fromkeys(columns, STANDARD_TEXT))


def null_outside_box(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """A pair of coordinates outside the box becomes null, its row stays."""
    valid = inside_box(*map(F.col, cols.coordinates))
    return df.withColumns({c: F.when(valid, F.col(c)) for c in cols.coordinates})


def clean_coordinates(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Decimal-comma text to doubles inside the box."""
    return null_outside_box(in_steps(df, dict.fromkeys(cols.coordinates, DECIMAL_COMMA)), cols)


def clean_timestamps(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Day-first text to timestamps, bad dates to null."""
    return in_steps(df, dict.fromkeys(columns, DAY_FIRST_TIMESTAMP))


def clean_integers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """'2024' and '2024.0' to ints, everything else to null."""
    return in_steps(df, dict.fromkeys(columns, WHOLE_NUMBER))


def cleaning(df: DataFrame, cols: Columns = DEFAULT, text: Sequence[str] | None = None) -> dict[str, Steps]:
    """The steps of every column that ``clean`` changes."""
    texts = text_columns(df, cols) if text is None else text
    strings = {c for c, t in df.dtypes if t == "string"}
    steps = {
        **dict.fromkeys((c for c in cols.keys if c in strings), KEY_TEXT),
        **dict.fromkeys(texts, STANDARD_TEXT),
        **dict.fromkeys(cols.timestamps, DAY_FIRST_TIMESTAMP),
        **dict.fromkeys(cols.integers, WHOLE_NUMBER),
        **dict.fromkeys(cols.coordinates, DECIMAL_COMMA),
    }
    return {c: s for c, s in steps.items() if c in df.columns}


def boxed(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """``null_outside_box`` of tables that have coordinates."""
    return null_outside_box(df, cols) if set(cols.coordinates) <= set(df.columns) else df


def clean(df: DataFrame, cols: Columns = DEFAULT, text: Sequence[str] | None = None) -> DataFrame:
    """All of it, on whatever of the columns is present; no shuffle. Keys are stripped, and null
    where they say so, before reports are compared by them.
    """
    return boxed(in_steps(df, cleaning(df, cols, text)), cols)


def clean_of_years(
    df: DataFrame, wanted: Column, observation: Observation | str, observed: Column, cols: Columns = DEFAULT
) -> DataFrame:
    """``clean`` of the rows whose clean report year is ``wanted``; ``observed`` is of all rows.

    Other rows are spared all but the cleaning of their year. The observation has to be between that and
    the filter: a filter on a cleaned column is otherwise moved below the cleaning, whose steps it
    then repeats, nested, several times over.
    """
    steps = cleaning(df, cols)
    year = {c: steps.pop(c) for c in (cols.number_year,) if c in steps}
    kept = in_steps(df, year).observe(observation, observed).where(wanted)
    return boxed(in_steps(kept, steps), cols)
