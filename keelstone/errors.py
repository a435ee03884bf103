"""Errors of sessions, tables, cursors and snapshots."""


class KeelstoneError(Exception):
    """Base of all errors below."""


class SessionDirDoesNotExistError(KeelstoneError):
    """The session folder is not there."""


class SessionDirLockedError(KeelstoneError):
    """Another session holds the folder's lock."""


class SessionDirCorruptedError(KeelstoneError):
    """The folder is neither empty nor a session's."""


class SessionClosedError(KeelstoneError):
    """The session was closed."""


class TableClosedError(KeelstoneError):
    """The table was closed."""


class TableCorruptedError(KeelstoneError):
    """A file of the table is missing or short."""


class TableTooLargeError(KeelstoneError):
    """A run would hold 2**40 entries or more."""


class TableUnionNotCompatibleError(KeelstoneError):
    """Tables of a union differ in session, types or resolver; ``first`` and ``other`` are their positions."""

    def __init__(self, message: str, first: int = 0, other: int = 0) -> None:
        super().__init__(message)
        self.first, self.other = first, other


class SnapshotExistsError(KeelstoneError):
    """A snapshot of that name is there already."""


class SnapshotDoesNotExistError(KeelstoneError):
    """No snapshot has that name."""


class SnapshotCorruptedError(KeelstoneError):
    """A file of the snapshot does not match its checksum."""


class SnapshotNotCompatibleError(KeelstoneError):
    """The snapshot's label is not the expected one."""


class SnapshotImportDirDoesNotExistError(KeelstoneError):
    """The folder to import from is not there."""


class SnapshotExportDirExistsError(KeelstoneError):
    """The folder to export to is there already."""


class BlobRefInvalidError(KeelstoneError):
    """A blob reference cannot be followed; ``index`` is the first such one's."""

    def __init__(self, index: int) -> None:
        super().__init__(f"blob reference {index} is invalid")
        self.index = index


class CursorClosedError(KeelstoneError):
    """The cursor was closed."""


class InvalidSnapshotNameError(KeelstoneError):
    """A snapshot name holds other characters than a-z, 0-9, - and _, or is too long, or is reserved."""
