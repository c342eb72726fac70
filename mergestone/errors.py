"""Errors of the engine."""


class StorageError(Exception):
    """Base of the engine's errors."""


class EngineClosed(StorageError):
    """An operation on an engine that is closed."""


class KeyTooLong(StorageError):
    """A key longer than its length field can say."""


class CorruptFile(StorageError):
    """A file that isn't what its name promises."""


class ConcurrentUpdate(StorageError):
    """Another writer was first; what was read is no longer the newest."""


class NoSharedFolder(StorageError):
    """A cluster without a folder that all its executors share."""
