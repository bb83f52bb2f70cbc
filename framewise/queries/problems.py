"""Queries of the general training-data problems (1, 4, 5, 6, 7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.operators.hotkeys import key_profile
from framewise.operators.impute import KPrototypesImputer, filled_cells, known_code, known_number, known_text
from framewise.operators.ingest import Field, at_most, has_letter, is_clean, parse_lines, plain_number, split_valid
from framewise.operators.profile import departures, profile, table_profile
from framewise.operators.segment import split_packed
from framewise.plans.scale import table

FILLED = ["Age", "Embarked", "Pclass", "Sex"]


def sex_value(c) -> object:
    """The sex a cell tells, in one spelling."""
    text = F.lower(known_text(c))
    return F.coalesce(F.get(F.array(F.lit("male"), F.lit("female"), F.lit("female")), F.instr(F.lit("mfw"), F.substring(text, 1, 1)) - 1), text)


def titanic_imputer() -> KPrototypesImputer:
    values = {"Age": known_number(F.col("Age")), "Embarked": known_text(F.col("Embarked"), r"\A[A-Z]{1,3}\z"), "Pclass": known_code(F.col("Pclass"), [1, 2, 3]), "Sex": sex_value(F.col("Sex"))}
    numeric = {"Age": None, "Fare": F.log1p(F.abs(known_number(F.col("Fare")))), "SibSp": F.col("SibSp"), "Parch": F.col("Parch")}
    title = F.regexp_extract(F.lower("Name"), r"\b(mrs|mr|miss|master)\b", 1)
    categorical = {"Sex": None, "Pclass": None, "Embarked": None, "title": F.when(title != "", title), "hour": F.hour("boarded_at")}
    return KPrototypesImputer(values=values, targets=FILLED, numeric=numeric, categorical=categorical, parent=["Pclass", "Sex"], group_key=F.col("Ticket"), group_targets=["Embarked", "Pclass"])


PASSENGERS = ["rec_id", "Age", "Embarked", "Pclass", "Sex", "Fare", "SibSp", "Parch", "Ticket", "Name", "boarded_at"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "titanic").select(*PASSENGERS)
    return filled_cells(titanic_imputer().transform(t), "rec_id", FILLED).where("method <> 'none'").select("rec_id", "field_name")


def p1_filled(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "titanic").select(*PASSENGERS)
    return titanic_imputer().transform(t).select("rec_id", *[f"{c}_{x}" for c in FILLED for x in ("filled", "method")])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "titanic").select("rec_id", "Cabin")
    several = split_packed(t, "Cabin", value="cabin_value", at_least=2)
    return several.select("rec_id", F.col("pos").cast("int"), F.col("cabin_value").alias("cabin"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "titanic").select("Embarked", "Survived", "Fare")
    return key_profile(t, ["Embarked", "Survived"], "Fare", [0.25, 0.5, 0.75]).where("row_share > 0.02 and Embarked is not null and Survived is not null").select("Embarked", "Survived")


def p5_key_quantiles(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "titanic").select("Embarked", "Survived", "Fare")
    return key_profile(t, ["Embarked", "Survived"], "Fare", [0.25, 0.5, 0.75]).select("Embarked", "Survived", "n_rows", "n_values", "least", "most", "q25", "q50", "q75")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "titanic")
    return departures(profile(t, "load_id", ["Age", "Cabin", "Fare"]), "load_id").select("load_id", "column_name")


PROFILED = ["PassengerId", "Survived", "Pclass", "Name", "Sex", "Age", "SibSp", "Parch", "Ticket", "Fare", "Cabin", "Embarked"]


def p6_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile(table(spark, d, "titanic"), "load_id", PROFILED)


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile(table(spark, d, "titanic"), "load_id", ["Pclass", "Survived", "Embarked"]).select("load_id", "column_name", "n_rows", "n_missing", "n_distinct")


def p6_table(spark: SparkSession, d: str) -> DataFrame:
    """The whole table by column; nulls and extrema from footers."""
    return table_profile(table(spark, d, "titanic"), PROFILED).select("column_name", "n_rows", "n_nulls", F.round("null_rate", 9).alias("null_rate"), "least", "most", "low", "high", "n_distinct")


TITANIC_FIELDS = [
    Field("PassengerId", "long"), Field("Survived", "long"), Field("Pclass", "long"),
    Field("Name", "string", (("invalid", lambda x: has_letter(x) & is_clean(x)),)),
    Field("Sex"), Field("Age", "double", (("invalid", plain_number), ("invalid", at_most(120)))),
    Field("SibSp", "long"), Field("Parch", "long"), Field("Ticket"), Field("Fare", "double", (("invalid", plain_number),)), Field("Cabin"), Field("Embarked"),
]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    _, bad = split_valid(parse_lines(table(spark, d, "titanic_raw"), "raw_line", TITANIC_FIELDS))
    return bad.select("line_id", "reason")


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    good, _ = split_valid(parse_lines(table(spark, d, "titanic_raw"), "raw_line", TITANIC_FIELDS))
    return good.drop("raw_line")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_filled, p4_found, p5_found, p5_key_quantiles, p6_found, p6_profile, p6_counts, p6_table, p7_found, p7_records)}


#: One field of a raw line: in quotes, with doubled quotes and tabs inside, or without any.
_FIELD = r'(?: *"(?:[^"]|"")*" *|[^"\t]*)'
_NUMBERS = ("PassengerId", "Survived", "Pclass", "Age", "SibSp", "Parch", "Fare")
_UNKNOWN = "('','?','??','-','--','.','*','n/a','n.a.','n.a','na','nan','none','null','nil','unk','unknown','undefined','not known','missing','u')"


def oracle_sql() -> dict[str, str]:
    line = "coalesce(raw_line, '')"
    field = lambda k: f"regexp_extract({line}, '^(?:{_FIELD}\\t){{{k}}}({_FIELD})(?:\\t|$)', 1)"
    plain = lambda k: f"trim(CASE WHEN trim({field(k)}, ' ') LIKE '\"%' THEN replace(substr(trim({field(k)}, ' '), 2, length(trim({field(k)}, ' ')) - 2), '\"\"', '\"') ELSE {field(k)} END, ' ')"
    number = lambda x: f"regexp_full_match({x}, '([0-9]+(\\.[0-9]+)?)?')"
    return {
        "p1_found": f"""
            SELECT rec_id, 'Age' AS field_name FROM titanic WHERE Age IS NULL OR isnan(Age) OR Age < 0 OR Age IN (999, 9999, 99999)
            UNION ALL SELECT rec_id, 'Embarked' FROM titanic WHERE Embarked IS NULL OR (lower(trim(Embarked)) IN {_UNKNOWN} AND NOT regexp_full_match(trim(Embarked), '[A-Z]{{1,3}}'))
            UNION ALL SELECT rec_id, 'Pclass' FROM titanic WHERE Pclass IS NULL OR Pclass NOT IN (1, 2, 3)
            UNION ALL SELECT rec_id, 'Sex' FROM titanic WHERE Sex IS NULL OR lower(trim(Sex)) IN {_UNKNOWN}""",
        # Pieces: quoted ones whole, else what stands between separators; the word "and" between pieces is no value.
        "p4_found": r"""
            WITH c AS (SELECT rec_id, list_filter(regexp_extract_all(Cabin, '"(?:[^"]|"")*"|''(?:[^'']|'''')*''|[^\s,;/|+&]+'), lambda x: lower(x) <> 'and') AS xs FROM titanic WHERE Cabin IS NOT NULL),
            v AS (SELECT rec_id, list_filter(list_transform(xs, lambda x: trim(CASE WHEN x LIKE '"%"' AND length(x) > 1 THEN replace(x[2:-2], '""', '"') WHEN x LIKE '''%''' AND length(x) > 1 THEN replace(x[2:-2], '''''', '''') ELSE x END)), lambda x: x <> '') AS xs FROM c)
            SELECT rec_id, unnest(range(1, len(xs) + 1))::INT AS pos, unnest(xs) AS cabin FROM v WHERE len(xs) > 1""",
        "p7_found": f"""
            WITH r AS (SELECT line_id, CASE WHEN NOT regexp_full_match({line}, '{_FIELD}(?:\\t{_FIELD})*') THEN 'quoting' WHEN length(regexp_replace(regexp_replace({line}, '"(?:[^"]|"")*"', 'q', 'g'), '[^\\t]', '', 'g')) <> 11 THEN 'columns'
                WHEN NOT regexp_matches({plain(3)}, '\\p{{L}}') OR regexp_matches(replace({plain(3)}, chr(9), ' '), '[\\x00-\\x1f\\x7f-\\x{{9f}}\\x{{fffd}}]') OR NOT {number(plain(5))} OR NOT {number(plain(9))} OR coalesce(TRY_CAST({plain(5)} AS DOUBLE), 0) > 120 THEN 'invalid' END AS reason FROM titanic_raw)
            SELECT line_id, reason FROM r WHERE reason IS NOT NULL""",
        "p5_found": "SELECT Embarked, Survived FROM titanic GROUP BY ALL HAVING Embarked IS NOT NULL AND Survived IS NOT NULL AND count(*) > 0.02 * (SELECT count(*) FROM titanic)",
        "p5_key_quantiles": """
            WITH v AS (SELECT Embarked, Survived, Fare, row_number() OVER (PARTITION BY Embarked, Survived ORDER BY Fare) r, count(*) OVER (PARTITION BY Embarked, Survived) n FROM titanic WHERE Fare IS NOT NULL AND NOT isnan(Fare)),
            q AS (SELECT Embarked, Survived, count(*) n_values, min(Fare) AS "least", max(Fare) AS most, max(CASE WHEN r = greatest(1, ceil(0.25 * n)) THEN Fare END) q25, max(CASE WHEN r = greatest(1, ceil(0.5 * n)) THEN Fare END) q50, max(CASE WHEN r = greatest(1, ceil(0.75 * n)) THEN Fare END) q75 FROM v GROUP BY ALL)
            SELECT t.Embarked, t.Survived, t.n_rows, coalesce(q.n_values, 0) AS n_values, q."least", q.most, q.q25, q.q50, q.q75
            FROM (SELECT Embarked, Survived, count(*) n_rows FROM titanic GROUP BY ALL) t
            LEFT JOIN q ON t.Embarked IS NOT DISTINCT FROM q.Embarked AND t.Survived IS NOT DISTINCT FROM q.Survived""",
        "p6_table": " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count(x) AS n_nulls, round((count(*) - count(x)) / count(*), 9) AS null_rate, {'NULL::VARCHAR' if c in _NUMBERS else 'min(x)'} AS "least", {'NULL::VARCHAR' if c in _NUMBERS else 'max(x)'} AS most,
            {'min(x)::DOUBLE + 0.0' if c in _NUMBERS else 'NULL::DOUBLE'} AS low, {'max(x)::DOUBLE + 0.0' if c in _NUMBERS else 'NULL::DOUBLE'} AS high, count(DISTINCT x) AS n_distinct FROM (SELECT {f'CASE WHEN NOT isnan({c}::DOUBLE) THEN {c} END' if c in _NUMBERS else c} AS x FROM titanic)"""
            for c in PROFILED
        ),
        "p6_counts": f"""
            WITH v AS (
                SELECT load_id, 'Pclass' AS column_name, CASE WHEN Pclass NOT IN (-1, -9, -99, -999, 999, 9999) THEN Pclass::VARCHAR END AS x FROM titanic
                UNION ALL SELECT load_id, 'Survived', CASE WHEN Survived NOT IN (-1, -9, -99, -999, 999, 9999) THEN Survived::VARCHAR END FROM titanic
                UNION ALL SELECT load_id, 'Embarked', CASE WHEN lower(trim(Embarked)) NOT IN {_UNKNOWN} THEN trim(Embarked) END FROM titanic)
            SELECT load_id, column_name, count(*) AS n_rows, count(*) - count(x) AS n_missing, count(DISTINCT x) AS n_distinct FROM v GROUP BY ALL""",
    }
