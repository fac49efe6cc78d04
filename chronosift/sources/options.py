"""How a file is read, and the identity that follows from it."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FileOptions:
    """Two readings of one file with different options are different virtual files."""
    jpath: str = ""
    no_header_row: bool = False
    ingest_tz: str = ""
    plugin_id: str = ""
    is_directory: bool = False
    file_pattern: str = ""
    include_source: bool = False

    def key(self) -> str:
        place = "file"
        if self.is_directory:
            place = ":".join(["dir", *([self.file_pattern] if self.file_pattern else []),
                              *(["src"] if self.include_source else [])])
        return "::".join((self.jpath, str(self.no_header_row).lower(), self.ingest_tz or "default",
                          self.plugin_id or "default", place))


def file_key(file_hash: str, options: FileOptions) -> str:
    return f"{file_hash}::{options.key()}"
