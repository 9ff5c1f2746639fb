"""Masking policies: expected values for every role, edge values and properties."""

from datetime import date
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardline.config import TableId
from wardline.functions import masking as M
from wardline.functions import roles as R
from wardline.operators import policy_checks, secure
from wardline.sources import registry

TABLE = TableId("ORG_DEV", "GOVERNANCE", "TEST_MASKING")
SCHEMA = (
    "student_id string, student_name string, ssn string, email string, dob date, phone string, address string, "
    "financial_aid_amount decimal(10,2)"
)
ROWS = [
    (
        "S12345",
        "John Doe",
        "123-45-6789",
        "john.doe@university.edu",
        date(2000, 1, 15),
        "555-123-4567",
        "123 Main St, Springfield, IL 62701",
        Decimal("15000.00"),
    ),
    (
        "S67890",
        "Jane Smith",
        "987-65-4321",
        "jane.smith@university.edu",
        date(1999, 12, 31),
        "555-987-6543",
        "456 Oak Ave, Chicago, IL 60601",
        Decimal("22500.50"),
    ),
]
MASKS = {
    ("GOVERNANCE", "TEST_MASKING"): {
        "student_name": "NAME_MASK",
        "ssn": "SSN_MASK",
        "email": "EMAIL_MASK",
        "dob": "DOB_MASK",
        "phone": "PHONE_MASK",
        "address": "ADDRESS_MASK",
        "financial_aid_amount": "FINANCIAL_AMOUNT_MASK",
    }
}
YEARS = (date(2000, 1, 1), date(1999, 1, 1))
CITIES = ("*** Springfield, IL 62701", "*** Chicago, IL 60601")
HIDDEN = {"ssn": ("XXX-XX-XXXX",) * 2}
ENGINEER = {
    "student_name": ("Student e", "Student h"),
    "ssn": ("XXX-XX-6789", "XXX-XX-4321"),
    "email": ("***@university.edu",) * 2,
    "dob": YEARS,
    "phone": ("XXX-XXX-XXXX (formatted)",) * 2,
    "address": ("*** (Address Present)",) * 2,
    "financial_aid_amount": (Decimal("15000.00"), Decimal("23000.00")),
}
HUNDREDS = {"financial_aid_amount": (Decimal("15000.00"), Decimal("22500.00"))}
NO_AMOUNT = {"financial_aid_amount": (None, None)}
# What differs from the raw rows, per role.
EXPECTED = {
    R.GOVERNANCE_ADMIN: {},
    R.DATA_ADMIN: {},
    R.FINANCIAL_AID_ANALYST: {},
    R.DATA_ENGINEER: ENGINEER,
    R.DBT_CLOUD_PROD: ENGINEER,
    R.DBT_CLOUD_DEV: ENGINEER,
    R.REGISTRAR_ANALYST: HUNDREDS,
    R.IR_ANALYST: {
        **HIDDEN,
        **HUNDREDS,
        "student_name": ("J. D.", "J. S."),
        "dob": YEARS,
        "phone": ("555-XXX-XXXX",) * 2,
        "address": CITIES,
    },
    R.ENROLLMENT_ANALYST: {**HIDDEN, **NO_AMOUNT, "dob": YEARS, "address": CITIES},
    R.DATA_ANALYST: {
        **HIDDEN,
        **NO_AMOUNT,
        "student_name": ("J. D.", "J. S."),
        "email": ("***@***.***",) * 2,
        "dob": YEARS,
        "phone": ("XXX-XXX-XXXX",) * 2,
        "address": CITIES,
    },
    R.UNLISTED_ROLE: {
        **HIDDEN,
        **NO_AMOUNT,
        "student_name": ("***",) * 2,
        "email": ("***@***.***",) * 2,
        "dob": (None, None),
        "phone": ("XXX-XXX-XXXX",) * 2,
        "address": ("***",) * 2,
    },
    R.SYSADMIN: None,  # owns the admin role, yet sees what an unlisted role sees
}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def attached(spark):
    return registry.mask_attachments(spark, MASKS, ["DEV"])


@pytest.mark.parametrize("role", EXPECTED)
def test_expected_values(table, attached, role):
    out = secure.masked(table, TABLE, role, attached)
    assert out.schema == table.schema or [f.dataType for f in out.schema] == [f.dataType for f in table.schema]
    changed = EXPECTED[R.UNLISTED_ROLE] if role == R.SYSADMIN else EXPECTED[role]
    names = table.columns
    expected = [
        tuple(changed[n][i] if n in changed else value for n, value in zip(names, row)) for i, row in enumerate(ROWS)
    ]
    assert sorted(map(tuple, out.collect())) == sorted(expected)


def one(spark, policy, value, role, ddl="string"):
    df = spark.createDataFrame([(value,)], f"v {ddl}")
    return df.select(M.MASKING_POLICIES[policy].mask(F.col("v"), role, df.schema["v"].dataType)).first()[0]


@pytest.mark.parametrize(
    ("policy", "role", "value", "expected"),
    [
        ("SSN_MASK", R.DATA_ENGINEER, None, None),
        ("SSN_MASK", R.DATA_ENGINEER, "12", "XXX-XX-12"),
        ("SSN_MASK", R.DATA_ENGINEER, "", "XXX-XX-"),
        ("SSN_MASK", R.DATA_ANALYST, None, "XXX-XX-XXXX"),
        ("EMAIL_MASK", R.DATA_ENGINEER, "@x", "@x"),
        ("EMAIL_MASK", R.DATA_ENGINEER, "noat", "***"),
        ("EMAIL_MASK", R.DATA_ENGINEER, "", ""),
        ("EMAIL_MASK", R.DATA_ENGINEER, None, None),
        ("EMAIL_MASK", R.DATA_ENGINEER, "a@b@c", "***@b@c"),
        ("EMAIL_MASK", R.DATA_ENGINEER, "é\n@x.edu", "***@x.edu"),
        ("ADDRESS_MASK", R.IR_ANALYST, ",x,y", ",x,y"),
        ("ADDRESS_MASK", R.IR_ANALYST, "1 Main St, Apt 4\nSpringfield, IL", "1 Main St, Apt 4\nSpringfield, IL"),
        ("ADDRESS_MASK", R.IR_ANALYST, "1 A, B", "*** B"),
        ("ADDRESS_MASK", R.IR_ANALYST, "PO Box 9", "*** (Address)"),
        ("ADDRESS_MASK", R.IR_ANALYST, None, "*** (Address)"),
        ("ADDRESS_MASK_STRICT", R.IR_ANALYST, ",x,y", "*** (Address)"),
        ("ADDRESS_MASK_STRICT", R.IR_ANALYST, "1 A, B", "*** B"),
        ("ADDRESS_MASK_STRICT", R.IR_ANALYST, None, "*** (Address)"),
        ("NAME_MASK", R.IR_ANALYST, "Cher", "C."),
        ("NAME_MASK", R.IR_ANALYST, "Mary Ann Lee", "M. A."),
        ("NAME_MASK", R.IR_ANALYST, "J  D", "J. ."),
        ("NAME_MASK", R.IR_ANALYST, " John", " . J."),
        ("NAME_MASK", R.IR_ANALYST, "", "."),
        ("NAME_MASK", R.IR_ANALYST, None, None),
        ("PHONE_MASK", R.DATA_ENGINEER, "(555)", "(XXX) XXX-XXXX (formatted)"),
        ("PHONE_MASK", R.DATA_ENGINEER, "(555) 123-4567", "XXXXXXXXXX (unformatted)"),
        ("PHONE_MASK", R.DATA_ENGINEER, None, "XXXXXXXXXX (unformatted)"),
        ("PHONE_MASK", R.DATA_ENGINEER, "555-123-4567\n", "XXXXXXXXXX (unformatted)"),
        ("PHONE_MASK", R.IR_ANALYST, "(555)123-4567", "(555) XXX-XXXX"),
        ("PHONE_MASK", R.IR_ANALYST, "x 555-123-4567", "XXX-XXX-XXXX"),
        ("STUDENT_ID_MASK", R.DATA_ENGINEER, "S12345", "ID_2345"),
        ("STUDENT_ID_MASK", R.UNLISTED_ROLE, None, "XXXXXXXX"),
    ],
)
def test_edge_values(spark, policy, role, value, expected):
    assert one(spark, policy, value, role) == expected


@pytest.mark.parametrize(
    ("ddl", "value", "role", "expected"),
    [
        ("decimal(10,2)", Decimal("22500.50"), R.DATA_ENGINEER, Decimal("23000.00")),
        ("decimal(10,2)", Decimal("-250.00"), R.IR_ANALYST, Decimal("-300.00")),
        ("decimal(10,2)", Decimal("99999999.99"), R.IR_ANALYST, None),  # rounds out of the type
        ("bigint", 1250, R.IR_ANALYST, 1300),
        ("double", 1250.0, R.IR_ANALYST, 1300.0),
    ],
)
def test_amounts_keep_their_type(spark, ddl, value, role, expected):
    assert one(spark, "FINANCIAL_AMOUNT_MASK", value, role, ddl) == expected


def test_policy_refuses_a_column_of_another_type(spark):
    with pytest.raises(TypeError):
        one(spark, "DOB_MASK", "2000-01-01", R.IR_ANALYST)


def test_undefined_policy_refuses_the_read(spark, table):
    unknown = registry.mask_attachments(spark, {("GOVERNANCE", "TEST_MASKING"): {"ssn": "NO_SUCH_MASK"}}, ["DEV"])
    with pytest.raises(secure.UnknownPolicy):
        secure.masked(table, TABLE, R.DATA_ADMIN, unknown)


def test_attachment_names_match_in_any_case(spark, table):
    upper = registry.mask_attachments(spark, {("GOVERNANCE", "TEST_MASKING"): {"SSN": "SSN_MASK"}}, ["DEV"])
    out = secure.masked(table, TABLE, R.DATA_ANALYST, upper)
    assert {r.ssn for r in out.collect()} == {"XXX-XX-XXXX"}


def test_attachment_of_another_environment_does_not_count(spark, table):
    prod = registry.mask_attachments(spark, MASKS, ["PROD"])
    out = secure.masked(table, TABLE, R.UNLISTED_ROLE, prod)
    assert sorted(map(tuple, out.collect())) == sorted(ROWS)


def _python_email(v):
    if v is None or v == "" or v.startswith("@"):
        return v
    return "***" + (v[v.index("@") :] if "@" in v else "")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a@é .\n,-1", max_size=8), min_size=1, max_size=30))
def test_email_domain_on_any_text(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    out = df.select("v", M.EMAIL_MASK.mask(F.col("v"), R.DATA_ENGINEER, df.schema["v"].dataType).alias("m")).collect()
    assert all(r.m == _python_email(r.v) for r in out)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab ,1-()\n@", max_size=10)), min_size=1, max_size=20))
def test_all_roles_at_once_equals_one_role_at_a_time(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "k int, v string")
    dtype = df.schema["v"].dataType
    for name in ("SSN_MASK", "EMAIL_MASK", "PHONE_MASK", "ADDRESS_MASK_STRICT", "NAME_MASK"):
        policy = M.MASKING_POLICIES[name]
        together = {
            (r.k, r.role): r.masked
            for r in policy_checks.mask_for_roles(df, "k", "v", policy, R.MATRIX_ROLES).collect()
        }
        role = R.IR_ANALYST
        alone = {r.k: r.m for r in df.select("k", policy.mask(F.col("v"), role, dtype).alias("m")).collect()}
        assert alone == {k: m for (k, r), m in together.items() if r == role}
        admin = {k: m for (k, r), m in together.items() if r == R.DATA_ADMIN}
        assert admin == dict(enumerate(values))
        hidden = {m for (k, r), m in together.items() if r == R.UNLISTED_ROLE}
        assert hidden <= set(policy.constants)
