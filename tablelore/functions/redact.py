"""Credential redaction as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a credential, and what replaces it.
USER_INFO = "//[^/@]*@"
PASSWORD_PAIR = r"(?i)\b(password|passwd|pwd)\s*=\s*(\"[^\"]*\"|'[^']*'|\S+)"


def redact(text: Column, every: bool = True) -> Column:
    """Removes user info from URIs and masks password values.

    A connection string holds one URI, a text column may hold many, so all of them are
    scrubbed; ``every=False`` leaves all but the first URI.
    """
    if every:
        text = F.regexp_replace(text, USER_INFO, "//")
    else:
        text = F.regexp_replace(text, f"(?s)^(.*?){USER_INFO}", "$1//")
    return F.regexp_replace(text, PASSWORD_PAIR, "$1=***")
