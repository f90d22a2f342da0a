"""Functions for ``spark.sql`` over the registered views."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Ages follow functions.exprs.age_months: full months between two dates.
_AGE_YEARS = """
CREATE OR REPLACE TEMPORARY FUNCTION
age_in_years(dob DATE, as_of DATE DEFAULT current_date()) RETURNS INT
RETURN CAST((
    (year(as_of) - year(dob)) * 12 + month(as_of) - month(dob)
    - CASE WHEN day(as_of) < day(dob) THEN 1 ELSE 0 END
) DIV 12 AS INT)
"""

# For a column of ids and dates: one row per call, NULL for an unknown patient. The lookup
# becomes a join on the id.
_RETRIEVE_AGE = """
CREATE OR REPLACE TEMPORARY FUNCTION
retrieve_age(pat_id BIGINT, as_of DATE DEFAULT current_date()) RETURNS INT
RETURN age_in_years((SELECT max(dob) FROM demographics WHERE patientid = pat_id), as_of)
"""

# For FROM, with an id and date that are known: the filter on the id reaches the scan, and an
# unknown patient gives no row.
_AGE_OF_PATIENT = """
CREATE OR REPLACE TEMPORARY FUNCTION
retrieve_age(pat_id BIGINT, as_of DATE DEFAULT current_date())
RETURNS TABLE (patientid BIGINT, age INT)
RETURN SELECT patientid, age_in_years(dob, as_of) FROM demographics WHERE patientid = pat_id
"""

# Grouping by day inside lets a column of dates, joined laterally, meet the result by an
# equal day; a single date is turned into a range of times that reaches the scan.
_RETRIEVE_MIN_GLUCOSE = """
CREATE OR REPLACE TEMPORARY FUNCTION retrieve_min_glucose(input_date DATE)
RETURNS TABLE (min_glucose DOUBLE, patient_id BIGINT)
RETURN SELECT lowest, patientid FROM (
    SELECT min(glucose_value_mgdl) AS lowest, patientid, to_date(datestamp) AS day
    FROM dexcom GROUP BY patientid, to_date(datestamp)
) WHERE day = input_date
"""


def register_sql_functions(spark: SparkSession) -> None:
    """Create ``age_in_years``, ``retrieve_age`` and ``retrieve_min_glucose``.

    ``retrieve_age`` is a value in an expression and a table in FROM. The views
    ``demographics`` and ``dexcom`` must exist (``Tables.register_views``).
    """
    for statement in (_AGE_YEARS, _RETRIEVE_AGE, _AGE_OF_PATIENT, _RETRIEVE_MIN_GLUCOSE):
        spark.sql(statement)
