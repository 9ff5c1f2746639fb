"""Role names and the role groups every policy is written in."""

from __future__ import annotations

# Role names.
GOVERNANCE_ADMIN = "GOVERNANCE_ADMIN_ROLE"
DATA_ADMIN = "DATA_ADMIN"
DATA_ENGINEER = "DATA_ENGINEER_ROLE"
DBT_CLOUD_PROD = "DBT_CLOUD_PROD_ROLE"
DBT_CLOUD_DEV = "DBT_CLOUD_DEV_ROLE"
DATA_ANALYST = "DATA_ANALYST_ROLE"
IR_ANALYST = "IR_ANALYST_ROLE"
REGISTRAR_ANALYST = "REGISTRAR_ANALYST_ROLE"
ENROLLMENT_ANALYST = "ENROLLMENT_ANALYST_ROLE"
FINANCIAL_AID_ANALYST = "FINANCIAL_AID_ANALYST_ROLE"
SYSADMIN = "SYSADMIN"

ADMINS = (GOVERNANCE_ADMIN, DATA_ADMIN)
ENGINEERS = (DATA_ENGINEER, DBT_CLOUD_PROD, DBT_CLOUD_DEV)
ANALYSTS = (DATA_ANALYST, IR_ANALYST, REGISTRAR_ANALYST, ENROLLMENT_ANALYST, FINANCIAL_AID_ANALYST)

LISTED_ROLES = ADMINS + ENGINEERS + ANALYSTS

# A role in no policy: stands for "anyone else" wherever all roles are compared.
UNLISTED_ROLE = "PUBLIC"

# Example roles limited to a list of departments or programme types.
BUSINESS_SCHOOL_ANALYST = "BUSINESS_SCHOOL_ANALYST_ROLE"
UNDERGRAD_ANALYST = "UNDERGRAD_ANALYST_ROLE"
GRADUATE_ANALYST = "GRADUATE_ANALYST_ROLE"

MATRIX_ROLES = LISTED_ROLES + (UNLISTED_ROLE,)
