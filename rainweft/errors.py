"""Exceptions raised at pipeline boundaries."""


class MissingOptionalDependency(Exception):
    """A reader or writer needs a library that is not installed."""


class DirectoryNotEmpty(Exception):
    """A sink was asked to write into a directory that holds files."""


class DataModelError(Exception):
    """A table lacks a column, or a column has an unusable type."""
