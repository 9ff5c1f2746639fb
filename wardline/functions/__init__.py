"""Column expressions: roles, masking policies, row policies, name detection."""
