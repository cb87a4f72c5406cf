"""Data model: column roles, schemas and the fixed values of the domain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Columns:
    """Names of the columns an incident table plays its roles with.

    Every operator takes one of these, so a table with other column names needs only
    another instance, not another operator.
    """

    number: str = "NUM_BO"
    number_year: str = "ANO_BO"
    station_id: str = "ID_DELEGACIA"
    year: str = "ANO"
    month: str = "MES"
    heading: str = "RUBRICA"
    station: str = "NOME_DELEGACIA"
    city: str = "NOME_MUNICIPIO"
    district: str = "BAIRRO"
    period: str = "DESCR_PERIODO"
    occurred: str = "DATA_OCORRENCIA_BO"
    registered: str = "DATAHORA_REGISTRO_BO"
    reported: str = "DATA_COMUNICACAO_BO"
    latitude: str = "LATITUDE"
    longitude: str = "LONGITUDE"

    @property
    def keys(self) -> tuple[str, str]:
        return self.number, self.number_year

    @property
    def integers(self) -> tuple[str, ...]:
        return self.year, self.month, self.number_year, self.station_id

    @property
    def timestamps(self) -> tuple[str, ...]:
        return self.occurred, self.registered, self.reported

    @property
    def coordinates(self) -> tuple[str, str]:
        return self.latitude, self.longitude


DEFAULT = Columns()

CLEAN_SCHEMA = T.StructType(
    [
        T.StructField("NUM_BO", T.StringType()),
        T.StructField("ANO_BO", T.IntegerType()),
        T.StructField("ID_DELEGACIA", T.IntegerType()),
        T.StructField("ANO", T.IntegerType()),
        T.StructField("MES", T.IntegerType()),
        T.StructField("RUBRICA", T.StringType()),
        T.StructField("NOME_DELEGACIA", T.StringType()),
        T.StructField("NOME_MUNICIPIO", T.StringType()),
        T.StructField("BAIRRO", T.StringType()),
        T.StructField("DESCR_PERIODO", T.StringType()),
        T.StructField("DATA_OCORRENCIA_BO", T.TimestampNTZType()),
        T.StructField("DATAHORA_REGISTRO_BO", T.TimestampNTZType()),
        T.StructField("DATA_COMUNICACAO_BO", T.TimestampNTZType()),
        T.StructField("LATITUDE", T.DoubleType()),
        T.StructField("LONGITUDE", T.DoubleType()),
    ]
)

# Spellings of the capital, after upper-casing and trimming.
CAPITAL_SPELLINGS = ("S.PAULO", "SAO PAULO", "SÃO PAULO", "S. PAULO", "SP")

# Category label and the heading prefix that defines it; what has neither
# prefix belongs to the remaining category.
CATEGORY_PREFIXES = {"Furto": "FURTO", "Roubo": "ROUBO"}
OTHER_CATEGORY = "Outros"

# Labels of months 1-12 and of weekdays in reading order.
MONTH_LABELS = ("Jan", "Fev", "Mar", "Abr", "Mai", "Jun", "Jul", "Ago", "Set", "Out", "Nov", "Dez")
WEEKDAY_LABELS = ("Seg", "Ter", "Qua", "Qui", "Sex", "Sáb", "Dom")

# Texts that stand for a missing value once upper-cased and stripped.
NULL_TOKENS = ("NAN", "NONE", "")

# Bounding box of the state, degrees.
LATITUDE_RANGE = (-25.5, -19.5)
LONGITUDE_RANGE = (-53.0, -44.0)
