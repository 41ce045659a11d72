"""Errors of the engine: one class for each way in which input can be wrong."""


class EngineError(Exception):
    """Base of all."""


class InvalidParquetFile(EngineError):
    """Not a columnar file, or a writer used out of order."""


class InvalidSchema(EngineError):
    """A schema that can't be written."""


class InvalidColumnData(EngineError):
    """A column that isn't there, or data that doesn't fit its column."""


class UnsupportedCompression(EngineError):
    pass


class UnsupportedEncoding(EngineError):
    pass


class UnsupportedNestedSchema(EngineError):
    """A repeated column where only flat ones are allowed."""


class UnsupportedType(EngineError):
    pass


class CorruptMetadata(EngineError):
    pass


class CorruptPage(EngineError):
    """Levels or values of a page that contradict each other."""


class TemplateError(EngineError):
    """Base of the template language's errors."""


class BadSyntax(TemplateError):
    pass


class BadExpression(TemplateError):
    pass


class UnknownTag(TemplateError):
    pass


class UnexpectedEnd(TemplateError):
    pass


class IncludeNotFound(TemplateError):
    pass


class TypeMismatch(TemplateError):
    pass
