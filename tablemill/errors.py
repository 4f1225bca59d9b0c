"""The one exception type the library raises for bad requests."""


class RequestError(ValueError):
    """A request that can't be run: unknown key, bad name, missing column."""
