"""Errors of the table engine."""


class TableError(Exception):
    """Any error of a log-structured table."""


class NotFound(TableError):
    pass


class Corruption(TableError):
    pass


class ChecksumMismatch(Corruption):
    pass


class ManifestError(TableError):
    pass


class Fenced(TableError):
    """Another writer has opened the table since; this one may not write any more."""


class EngineOverloaded(TableError):
    """Work was shed: too many operations at once, or flushing and compaction are behind."""
