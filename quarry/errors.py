"""The engine's exceptions; `code` is the SQLSTATE a SQL client would see."""


class EngineError(Exception):
    code = "XX000"


class SyntaxProblem(EngineError):
    code = "42601"


class TableExists(EngineError):
    code = "42P07"


class TableMissing(EngineError):
    code = "42P01"


class ConstraintViolation(EngineError):
    code = "23000"


class WriteConflict(EngineError):
    code = "40001"
