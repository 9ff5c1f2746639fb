"""Row policies: expected visible rows, composition, and plans."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from wardline.config import TableId
from wardline.functions import roles as R
from wardline.functions import rowaccess as A
from wardline.operators import policy_checks, secure
from wardline.sources import demo, registry

AS_OF = date(2025, 1, 15)
TABLE = TableId("ORG_DEV", "GOVERNANCE", "TEST_ROW_ACCESS")
SCHEMA = (
    "student_id string, enrollment_status string, is_active boolean, academic_year string, term_code string, "
    "department_code string, ferpa_consent boolean, program_type string"
)
ROWS = [
    ("S001", "ENROLLED", True, "2024", "202403", "MATH", True, "UNDERGRADUATE"),
    ("S002", "ADMITTED", True, "2024", "202403", "ENG", True, "UNDERGRADUATE"),
    ("S003", "PROSPECTIVE", True, "2024", "202403", "BIOL", None, "UNDERGRADUATE"),
    ("S004", "GRADUATED", True, "2023", "202303", "HIST", True, "UNDERGRADUATE"),
    ("S005", "WITHDRAWN", False, "2023", "202301", "PSYC", False, "UNDERGRADUATE"),
    ("S006", "ENROLLED", True, "2024", "202403", "MBA", True, "GRADUATE"),
    ("S007", "ENROLLED", True, "2022", "202203", "COMP", True, "UNDERGRADUATE"),
]
POLICIES = {
    ("GOVERNANCE", "TEST_ROW_ACCESS"): {
        "ENROLLMENT_ROW_ACCESS": "ENROLLMENT_STATUS",
        "ACTIVE_RECORDS_ONLY": "IS_ACTIVE",
        "CURRENT_AY_ACCESS": "ACADEMIC_YEAR",
    }
}
ALL = "1234567"
VISIBLE = {
    R.GOVERNANCE_ADMIN: ALL,
    R.DATA_ADMIN: ALL,
    R.DATA_ENGINEER: ALL,
    R.DBT_CLOUD_PROD: ALL,
    R.DBT_CLOUD_DEV: ALL,
    R.IR_ANALYST: "123467",
    R.ENROLLMENT_ANALYST: "1236",
    R.REGISTRAR_ANALYST: "146",
    R.FINANCIAL_AID_ANALYST: "126",
    R.DATA_ANALYST: "16",
    R.UNLISTED_ROLE: "",
    R.SYSADMIN: "",
}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def attached(spark):
    return registry.row_policy_attachments(spark, POLICIES, ["DEV"])


def ids(df):
    return "".join(sorted(r.student_id[-1] for r in df.collect()))


@pytest.mark.parametrize("role", VISIBLE)
def test_three_policies_together(table, attached, role):
    assert ids(secure.secured(table, TABLE, role, AS_OF, attached)) == VISIBLE[role]


def test_the_clock_is_a_parameter(table, attached):
    at = lambda year: ids(secure.secured(table, TABLE, R.DATA_ANALYST, date(year, 6, 1), attached))
    assert (at(2024), at(2025), at(2027)) == ("167", "16", "")


@pytest.mark.parametrize(
    ("role", "visible"),
    [(R.IR_ANALYST, "123456"), (R.ENROLLMENT_ANALYST, "1236"), (R.REGISTRAR_ANALYST, "1456")],
)
def test_status_policy_alone(spark, role, visible):
    rows = [("1", "ENROLLED"), ("2", "ADMITTED"), ("3", "PROSPECTIVE"), ("4", "WITHDRAWN"), ("5", "GRADUATED"), ("6", "enrolled")]
    df = spark.createDataFrame(rows, "student_id string, status string")
    assert ids(df.filter(A.ENROLLMENT_ROW_ACCESS.predicate(F.col("status"), role, AS_OF))) == visible


def test_null_hides_the_row_except_for_consent(spark):
    df = spark.createDataFrame([(None, None, None)], "s string, b boolean, y string")
    role = R.DATA_ANALYST
    assert df.filter(A.ENROLLMENT_ROW_ACCESS.predicate(F.col("s"), role, AS_OF)).count() == 0
    assert df.filter(A.ACTIVE_RECORDS_ONLY.predicate(F.col("b"), role, AS_OF)).count() == 0
    assert df.filter(A.CURRENT_TERM_ACCESS.predicate(F.col("y"), role, AS_OF)).count() == 0
    assert df.filter(A.FERPA_CONSENT_ACCESS.predicate(F.col("b"), role, AS_OF)).count() == 1


def test_thresholds():
    assert A.years_before(date(2025, 1, 15), 2) == "2023"
    assert A.months_before(date(2025, 1, 15), 24) == "202301"
    assert A.months_before(date(2024, 2, 29), 14) == "202212"


def test_limited_roles(table):
    policy = A.department_access({"MATH_ANALYST": ["MATH", "COMP"]})
    assert ids(table.filter(policy.predicate(F.col("department_code"), "MATH_ANALYST", AS_OF))) == "17"
    programs = A.program_type_access(A.EXAMPLE_PROGRAMS)
    assert ids(table.filter(programs.predicate(F.col("program_type"), R.GRADUATE_ANALYST, AS_OF))) == "6"
    assert ids(table.filter(A.department_access().predicate(F.col("department_code"), "MATH_ANALYST", AS_OF))) == ""


def test_combined_is_the_intersection(spark, sf_dir):
    df = demo.person(spark, sf_dir)
    policies = {
        "enrollment_status": A.ENROLLMENT_ROW_ACCESS,
        "is_active": A.ACTIVE_RECORDS_ONLY,
        "academic_year": A.CURRENT_AY_ACCESS,
    }
    pairs = lambda p: {
        tuple(r)
        for r in policy_checks.visible_by_role(df, "person_id", p, R.MATRIX_ROLES, demo.AS_OF_DATE).collect()
    }
    single = [pairs({column: policy}) for column, policy in policies.items()]
    together = pairs(policies)
    assert together == set.intersection(*single)
    assert not any(role == R.UNLISTED_ROLE for _, role in together)


# -- plans ----------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored_person(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("person") / "person")
    demo.person(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def pushed(df):
    text = plan(df)
    return text[text.index("PushedFilters") : text.index("ReadSchema")]


@pytest.mark.parametrize(
    ("policy", "column", "expected"),
    [
        (A.ACTIVE_RECORDS_ONLY, "is_active", "EqualTo(is_active,true)"),
        (A.CURRENT_AY_ACCESS, "academic_year", "GreaterThanOrEqual(academic_year,1998)"),
        (A.CURRENT_TERM_ACCESS, "term_code", "GreaterThanOrEqual(term_code,199806)"),
        (A.FERPA_CONSENT_ACCESS, "ferpa_consent", "Or(EqualTo(ferpa_consent,true),IsNull(ferpa_consent))"),
    ],
)
def test_row_policies_reach_the_scan(stored_person, policy, column, expected):
    df = stored_person.filter(policy.predicate(F.col(column), R.DATA_ANALYST, demo.AS_OF_DATE))
    assert expected in pushed(df)


def test_no_access_reads_nothing_and_full_access_filters_nothing(stored_person):
    for policy, column in ((A.ENROLLMENT_ROW_ACCESS, "enrollment_status"), (A.department_access(), "department_code")):
        hidden = stored_person.filter(policy.predicate(F.col(column), R.UNLISTED_ROLE, demo.AS_OF_DATE))
        assert "FileScan" not in plan(hidden)
        open_ = stored_person.filter(policy.predicate(F.col(column), R.DATA_ADMIN, demo.AS_OF_DATE))
        assert "Filter" not in plan(open_).replace("PushedFilters", "").replace("DataFilters", "").replace("PartitionFilters", "")


def test_secured_read_is_one_narrow_scan(spark, stored_person):
    attached = demo.person_attachments(spark)
    table = TableId("ORG_PROD", *demo.PERSON_TABLE)
    read = secure.secured(stored_person, table, R.DATA_ANALYST, demo.AS_OF_DATE, attached)
    text = plan(read.groupBy().agg(F.count("ssn"), F.max("birth_date")))
    assert "Python" not in text and text.count("FileScan") == 1
    schema = text[text.index("ReadSchema") :]
    assert "ssn" not in schema  # the role sees a constant: the column is not read
    assert "address" not in schema and "birth_date" in schema
    assert "Exchange" not in plan(read)


def test_filters_of_the_reader_see_masked_values(spark, stored_person):
    attached = demo.person_attachments(spark)
    table = TableId("ORG_PROD", *demo.PERSON_TABLE)
    read = secure.secured(stored_person, table, R.REGISTRAR_ANALYST, demo.AS_OF_DATE, attached)
    assert read.filter("aid_amount % 100 <> 0").count() == 0
    assert secure.secured(stored_person, table, R.DATA_ANALYST, demo.AS_OF_DATE, attached).filter("ssn LIKE '1%'").count() == 0
