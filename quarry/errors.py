"""Errors that callers can tell apart; all are raised before or instead of writing anything."""


class ArgumentError(ValueError):
    """An argument that no retry makes valid."""


class UnknownObject(ArgumentError):
    """A row names an origin, visit, authority or fetcher that isn't known."""


class HashCollision(ArgumentError):
    """Contents share some hashes but not all; ``hashes`` has them."""

    def __init__(self, hashes):
        super().__init__("contents share some hashes but not all")
        self.hashes = hashes


class MaskedObject(Exception):
    """A result is masked; ``masked`` maps identifiers to (request, state) lists."""

    def __init__(self, masked):
        super().__init__(f"{len(masked)} masked objects")
        self.masked = masked


class BlockedOrigin(Exception):
    """An origin may not be added; ``blocked`` maps urls to (rule, request, state)."""

    def __init__(self, blocked):
        super().__init__(f"{len(blocked)} blocked origins")
        self.blocked = blocked
