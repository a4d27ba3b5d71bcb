"""Readers and writers: libsvm files, libsvm text, plain text."""

from fitkit.sources.files import (
    parse_libsvm_text,
    read_libsvm,
    read_text,
    relayout,
    write_libsvm,
    write_text_split,
)

__all__ = [
    "parse_libsvm_text",
    "read_libsvm",
    "read_text",
    "relayout",
    "write_libsvm",
    "write_text_split",
]
