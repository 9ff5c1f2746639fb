"""Masking, row access and governed reads in SQL."""

from __future__ import annotations

from sql_checks.fixtures import ROLE_GROUP, sql

# policy -> column, and what each group of roles gets; * is everyone else.
RAW = "{v}"
MASKS: dict[str, tuple[str, dict[str, str]]] = {
    "SSN_MASK": ("ssn", {"ADMIN FA REG": RAW, "ENGINEER": "'XXX-XX-' || right({v}, 4)", "*": "'XXX-XX-XXXX'"}),
    "EMAIL_MASK": (
        "email",
        {"ADMIN ENR REG IR FA": RAW, "ENGINEER": "regexp_replace({v}, '^[^@]+', '***')", "*": "'***@***.***'"},
    ),
    "DOB_MASK": (
        "birth_date",
        {
            "ADMIN FA REG": RAW,
            "IR ENR DA ENGINEER": "make_date(CAST(year({v}) AS INT), 1, 1)",
            "*": "CAST(NULL AS DATE)",
        },
    ),
    "PHONE_MASK": (
        "phone",
        {
            "ADMIN ENR REG FA": RAW,
            "IR": r"""CASE
                WHEN regexp_full_match({v}, '\d{{3}}-\d{{3}}-\d{{4}}')
                  THEN regexp_replace({v}, '(\d{{3}})-\d{{3}}-\d{{4}}', '\1-XXX-XXXX')
                WHEN regexp_full_match({v}, '\(\d{{3}}\)\s*\d{{3}}-\d{{4}}')
                  THEN regexp_replace({v}, '(\(\d{{3}}\))\s*\d{{3}}-\d{{4}}', '\1 XXX-XXXX')
                ELSE 'XXX-XXX-XXXX' END""",
            "ENGINEER": r"""CASE
                WHEN regexp_full_match({v}, '\d{{3}}-\d{{3}}-\d{{4}}') THEN 'XXX-XXX-XXXX (formatted)'
                WHEN regexp_full_match({v}, '\(\d{{3}}\)') THEN '(XXX) XXX-XXXX (formatted)'
                ELSE 'XXXXXXXXXX (unformatted)' END""",
            "*": "'XXX-XXX-XXXX'",
        },
    ),
    "ADDRESS_MASK": (
        "address",
        {
            "ADMIN REG FA": RAW,
            "IR ENR DA": r"CASE WHEN {v} LIKE '%,%' THEN regexp_replace({v}, '^[^,]+,\s*(.*)$', '*** \1') ELSE '*** (Address)' END",
            "ENGINEER": "'*** (Address Present)'",
            "*": "'***'",
        },
    ),
    "FINANCIAL_AMOUNT_MASK": (
        "aid_amount",
        {
            "ADMIN FA": RAW,
            "REG IR": "CAST(round({v}, -2) AS DECIMAL(12,2))",
            "ENGINEER": "CAST(round({v}, -3) AS DECIMAL(12,2))",
            "*": "CAST(NULL AS DECIMAL(12,2))",
        },
    ),
    "STUDENT_ID_MASK": (
        "student_id",
        {"ADMIN REG ENR FA IR DA": RAW, "ENGINEER": "'ID_' || right({v}, 4)", "*": "'XXXXXXXX'"},
    ),
    "NAME_MASK": (
        "student_name",
        {
            "ADMIN REG ENR FA": RAW,
            "IR DA": "CASE WHEN strpos({v}, ' ') > 0 THEN left({v}, 1) || '. ' || left(split_part({v}, ' ', 2), 1) || '.' ELSE left({v}, 1) || '.' END",
            "ENGINEER": "'Student ' || right({v}, 1)",
            "*": "'***'",
        },
    ),
}
_locality = MASKS["ADDRESS_MASK"][1]["IR ENR DA"]
MASKS["ADDRESS_MASK_STRICT"] = (
    "address",
    {
        **MASKS["ADDRESS_MASK"][1],
        "IR ENR DA": f"CASE WHEN ({_locality}) = {{v}} THEN '*** (Address)' ELSE {_locality} END",
    },
)
CONSTANTS = {
    "SSN_MASK": ["XXX-XX-XXXX"],
    "EMAIL_MASK": ["***@***.***"],
    "PHONE_MASK": [
        "XXX-XXX-XXXX",
        "XXX-XXX-XXXX (formatted)",
        "(XXX) XXX-XXXX (formatted)",
        "XXXXXXXXXX (unformatted)",
    ],
    "ADDRESS_MASK": ["*** (Address)", "*** (Address Present)", "***"],
    "ADDRESS_MASK_STRICT": ["*** (Address)", "*** (Address Present)", "***"],
    "STUDENT_ID_MASK": ["XXXXXXXX"],
    "NAME_MASK": ["***"],
}


def _expr(policy: str, group: str) -> str:
    column, cases = MASKS[policy]
    for groups, text in cases.items():
        if group in groups.split():
            return text.format(v=column)
    return cases["*"].format(v=column)


def _by_group(policy: str) -> str:
    whens = " ".join(f"WHEN '{g}' THEN {_expr(policy, g)}" for g in dict.fromkeys(ROLE_GROUP.values()))
    return f"CASE grp {whens} END"


def _mask_key(policy: str) -> str:
    return sql(f"SELECT person_id, role, {_by_group(policy)} AS masked FROM person CROSS JOIN roles", "person", "roles")


PERSON_COLUMNS = (
    "person_id student_id student_name ssn email birth_date phone address aid_amount enrollment_status is_active "
    "academic_year term_code department_code ferpa_consent program_type"
).split()
ATTACHED = {
    MASKS[p][0]: p
    for p in (
        "NAME_MASK",
        "SSN_MASK",
        "EMAIL_MASK",
        "DOB_MASK",
        "PHONE_MASK",
        "ADDRESS_MASK",
        "FINANCIAL_AMOUNT_MASK",
    )
}


def _person_as(role: str) -> str:
    group = ROLE_GROUP[role]
    return ", ".join(f"{_expr(ATTACHED[c], group)} AS {c}" if c in ATTACHED else c for c in PERSON_COLUMNS)


# policy -> condition per group; a group that is absent sees nothing.
_ALL = "TRUE"
_HISTORY = {"ADMIN": _ALL, "ENGINEER": _ALL, "IR": _ALL}
ROWS: dict[str, dict[str, str]] = {
    "enrollment": {
        **_HISTORY,
        "ENR": "upper(enrollment_status) IN ('PROSPECTIVE', 'ADMITTED', 'ENROLLED', 'DEPOSITED', 'APPLIED')",
        "REG": "upper(enrollment_status) IN ('ENROLLED', 'GRADUATED', 'WITHDRAWN', 'LEAVE_OF_ABSENCE', 'COMPLETED')",
        "FA": "upper(enrollment_status) IN ('ADMITTED', 'ENROLLED', 'DEPOSITED')",
        "DA": "upper(enrollment_status) = 'ENROLLED'",
    },
    "active": {"ADMIN": _ALL, "ENGINEER": _ALL, **{g: "is_active" for g in ("IR", "ENR", "REG", "FA", "DA")}},
    "academic_year": {**_HISTORY, **{g: "academic_year >= '1998'" for g in ("ENR", "REG", "FA", "DA")}},
    "term": {**_HISTORY, **{g: "term_code >= '199806'" for g in ("ENR", "REG", "FA", "DA")}},
    "department": {g: _ALL for g in ("ADMIN", "ENGINEER", "IR", "ENR", "REG", "FA", "DA")}
    | {"BUSINESS": "department_code IN ('ACCT', 'FIN', 'MGMT', 'MKTG')"},
    "ferpa_consent": {"ADMIN": _ALL, "ENGINEER": _ALL, "REG": _ALL}
    | {g: "coalesce(ferpa_consent, TRUE)" for g in ("IR", "ENR", "FA", "DA")},
    "program_type": {g: _ALL for g in ("ADMIN", "ENGINEER", "IR", "ENR", "REG", "FA", "DA")}
    | {"UNDERGRAD": "upper(program_type) = 'UNDERGRADUATE'", "GRADUATE": "upper(program_type) IN ('GRADUATE', 'DOCTORAL')"},
}
EXTRA_ROLES = {
    "BUSINESS_SCHOOL_ANALYST_ROLE": "BUSINESS",
    "UNDERGRAD_ANALYST_ROLE": "UNDERGRAD",
    "GRADUATE_ANALYST_ROLE": "GRADUATE",
}
COMBINED = ("enrollment", "active", "academic_year")


def _visible(role: str, *policies: str) -> str:
    group = {**ROLE_GROUP, **EXTRA_ROLES}[role]
    return " AND ".join(f"({ROWS[p].get(group, 'FALSE')})" for p in policies)


def _row_key(*policies: str, extra: tuple[str, ...] = ()) -> str:
    parts = [
        f"SELECT person_id, '{role}' AS role FROM person WHERE {_visible(role, *policies)}"
        for role in (*ROLE_GROUP, *extra)
    ]
    return sql("\nUNION ALL\n".join(parts), "person")


def _role_key(role: str) -> str:
    return role.removesuffix("_ROLE").lower()


def _shape_counts() -> str:
    parts = []
    for policy, (column, _) in MASKS.items():
        constants = CONSTANTS.get(policy)
        is_constant = f"m IN ({', '.join(repr(c) for c in constants)})" if constants else "FALSE"
        parts.append(
            f"""SELECT '{policy}' AS policy, role,
              count(*) FILTER (WHERE m = {column}) AS raw_rows,
              count(*) FILTER (WHERE (m = {column}) IS NOT TRUE AND m IS NOT NULL AND NOT ({is_constant})) AS partial_rows,
              count(*) FILTER (WHERE (m = {column}) IS NOT TRUE AND {is_constant}) AS constant_rows,
              count(*) FILTER (WHERE m IS NULL) AS null_rows
            FROM (SELECT role, {column}, {_by_group(policy)} AS m FROM person CROSS JOIN roles) GROUP BY role"""
        )
    return sql("\nUNION ALL\n".join(parts), "person", "roles")


def _leaks() -> str:
    parts = []
    for policy, (column, cases) in MASKS.items():
        entitled = next(iter(cases)).split()
        groups = ", ".join(f"'{g}'" for g in entitled)
        parts.append(
            f"""SELECT '{policy}' AS policy, role, count(*) AS total_rows, count({column}) AS present_rows,
              count(*) FILTER (WHERE m = {column} AND grp NOT IN ({groups})) AS leaked_rows
            FROM (SELECT role, grp, {column}, {_by_group(policy)} AS m FROM person CROSS JOIN roles) GROUP BY role"""
        )
    return sql("\nUNION ALL\n".join(parts), "person", "roles")


def _status_counts() -> str:
    parts = [
        f"SELECT '{role}' AS role, enrollment_status, count(*) AS visible_rows FROM person "
        f"WHERE {_visible(role, *COMBINED)} GROUP BY enrollment_status"
        for role in ROLE_GROUP
    ]
    return sql("\nUNION ALL\n".join(parts), "person")


SQL: dict[str, str] = {
    "mask_ssn": _mask_key("SSN_MASK"),
    "mask_email": _mask_key("EMAIL_MASK"),
    "mask_dob": _mask_key("DOB_MASK"),
    "mask_phone": _mask_key("PHONE_MASK"),
    "mask_address": _mask_key("ADDRESS_MASK"),
    "mask_address_strict": _mask_key("ADDRESS_MASK_STRICT"),
    "mask_financial_amount": _mask_key("FINANCIAL_AMOUNT_MASK"),
    "mask_student_id": _mask_key("STUDENT_ID_MASK"),
    "mask_name": _mask_key("NAME_MASK"),
    "mask_matrix": _shape_counts(),
    "policy_value_audit": _leaks(),
    "row_enrollment": _row_key("enrollment"),
    "row_active": _row_key("active"),
    "row_academic_year": _row_key("academic_year"),
    "row_term": _row_key("term"),
    "row_department": _row_key("department", extra=("BUSINESS_SCHOOL_ANALYST_ROLE",)),
    "row_ferpa_consent": _row_key("ferpa_consent"),
    "row_program_type": _row_key("program_type", extra=("UNDERGRAD_ANALYST_ROLE", "GRADUATE_ANALYST_ROLE")),
    "row_combined": _row_key(*COMBINED),
    "row_role_counts": _status_counts(),
    "masked_aggregate": sql(
        "SELECT count(*) AS student_count, avg(year(birth_date)) AS avg_birth_year "
        f"FROM (SELECT {_person_as('IR_ANALYST_ROLE')} FROM person WHERE {_visible('IR_ANALYST_ROLE', *COMBINED)})",
        "person",
    ),
    "masked_predicate": sql(
        "SELECT enrollment_status, count(*) AS persons, CAST(sum(aid_amount) AS DECIMAL(22,2)) AS aid_total "
        f"FROM (SELECT {_person_as('REGISTRAR_ANALYST_ROLE')} FROM person "
        f"WHERE {_visible('REGISTRAR_ANALYST_ROLE', *COMBINED)}) "
        "WHERE aid_amount > 100000 GROUP BY enrollment_status",
        "person",
    ),
    "secured_status_counts": sql(
        "SELECT enrollment_status, count(*) AS persons FROM person "
        f"WHERE {_visible('ENROLLMENT_ANALYST_ROLE', *COMBINED)} GROUP BY enrollment_status",
        "person",
    ),
}
for _role in ROLE_GROUP:
    SQL[f"secured_person_{_role_key(_role)}"] = sql(f"SELECT {_person_as(_role)} FROM person", "person")
    SQL[f"secured_table_{_role_key(_role)}"] = sql(
        f"SELECT {_person_as(_role)} FROM person WHERE {_visible(_role, *COMBINED)}", "person"
    )
