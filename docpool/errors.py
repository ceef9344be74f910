"""Errors that clients can tell apart by code."""

from __future__ import annotations


class ServiceError(Exception):
    """A refused request; `code` and `numeric` stay the same across versions, `data` is what a client gets."""

    code, numeric = "", 0

    def __init__(self, key: str, message: str):
        super().__init__(f"{self.code}: {message}")
        self.key = key

    @property
    def data(self) -> dict[str, str]:
        return {"code": self.code, "key": self.key}


class KeyNotFound(ServiceError):
    code, numeric = "KEY_NOT_FOUND", -31001

    def __init__(self, key: str):
        super().__init__(key, f"there is no key {key!r}")


class KeyTrashed(ServiceError):
    code, numeric = "KEY_TRASHED", -31002

    def __init__(self, key: str):
        super().__init__(key, f"key {key!r} is in the trash; restore it first")
