"""Errors raised before a job starts when an argument breaks a contract."""


class ContractError(ValueError):
    """An argument, rule, manifest or parameter is not acceptable."""
