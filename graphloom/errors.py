"""Refusals, one class for each kind."""


class CypherError(Exception):
    """Any refusal of a statement."""


class SyntaxError_(CypherError):
    """The text is no statement."""


class NotSupported(CypherError):
    """Understood, but outside what this engine does."""


class SemanticError(CypherError):
    """Unknown or repeated names, a clause where it may not stand, columns that do not match."""


class ArgumentError(CypherError):
    """A function or procedure got an argument it cannot take."""


class ExecutionFailed(CypherError):
    """A rule of the data was broken while running (constraints, deletes of connected nodes)."""
