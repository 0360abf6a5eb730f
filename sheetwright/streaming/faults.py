"""Files that cannot be read, told apart from those that can and from other faults."""

from __future__ import annotations

import re
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

# What Spark's readers say when a file itself is at fault.
FILE_FAULT = re.compile(r"FAILED_READ_FILE|PATH_NOT_FOUND|FileNotFoundException|TextParsingException|MalformedInputException|ChecksumException|AccessControlException")


def reason_of(error: Exception) -> str:
    """The innermost message of a failed job, in one line."""
    text = str(error)
    if isinstance(error, Py4JJavaError):
        cause = error.java_exception
        while cause.getCause() is not None:
            cause = cause.getCause()
        text = str(cause.toString())
    return re.sub(r"\s+", " ", text).strip()[:500]


def is_file_fault(error: Exception) -> bool:
    return FILE_FAULT.search(str(error)) is not None


def failing(paths: list[str], probe: Callable[[list[str]], None]) -> dict[str, str]:
    """Those of ``paths`` that ``probe`` fails with, and why; the others are probed together.

    A failure halves the files until each one that fails is alone, so a few bad
    files among n cost a few times log n probes. An error that is no file's
    fault, such as a full disk, is raised.
    """
    if not paths:
        return {}
    try:
        probe(paths)
        return {}
    except (Py4JJavaError, PySparkException) as error:
        if not is_file_fault(error):
            raise
        if len(paths) == 1:
            return {paths[0]: reason_of(error)}
    middle = len(paths) // 2
    return {**failing(paths[:middle], probe), **failing(paths[middle:], probe)}
