"""Zip containers with XML parts, by the standard library."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree


class Unreadable(Exception):
    """A container or a part that can't be read; ``kind`` says which."""

    def __init__(self, kind: str, detail: str):
        super().__init__(detail)
        self.kind = kind


class Container:
    def __init__(self, raw: bytes):
        try:
            self.archive = zipfile.ZipFile(io.BytesIO(raw))
        except Exception as error:  # the archive module raises many kinds for damaged input
            raise Unreadable("container", f"{type(error).__name__}: {error}") from error

    def blob(self, name: str) -> bytes | None:
        """A member's bytes, None if it is missing or damaged."""
        try:
            return self.archive.read(name)
        except Exception:  # damage, encryption, unknown compression
            return None

    def xml(self, name: str) -> ElementTree.Element | None:
        """A member's tree, None if it is missing, damaged or no XML."""
        blob = self.blob(name)
        try:
            return None if blob is None else ElementTree.fromstring(blob)
        except ElementTree.ParseError:
            return None

    def required(self, name: str) -> ElementTree.Element:
        found = self.xml(name)
        if found is None:
            raise Unreadable("part", f"{name} is missing or damaged")
        return found


def image_size(blob: bytes) -> tuple[int, int] | None:
    """(width, height) in the header of a PNG, GIF or JPEG."""
    if blob.startswith(b"\x89PNG\r\n\x1a\n") and len(blob) >= 24:
        return int.from_bytes(blob[16:20], "big"), int.from_bytes(blob[20:24], "big")
    if blob[:4] == b"GIF8" and len(blob) >= 10:
        return int.from_bytes(blob[6:8], "little"), int.from_bytes(blob[8:10], "little")
    if blob[:2] != b"\xff\xd8":
        return None
    # JPEG: segments of a marker and a length, until one that starts a frame
    at = 2
    while at + 9 < len(blob) and blob[at] == 0xFF:
        marker = blob[at + 1]
        if marker == 0xFF:
            at += 1
        elif 0xC0 <= marker <= 0xCF and marker % 4:
            height, width = int.from_bytes(blob[at + 5 : at + 7], "big"), int.from_bytes(blob[at + 7 : at + 9], "big")
            return (width, height) if width and height else None
        else:
            at += 2 + int.from_bytes(blob[at + 2 : at + 4], "big")
    return None
