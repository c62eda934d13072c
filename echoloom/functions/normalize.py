"""Normalised code and its fingerprint.

Comment lines and blank lines also exist as native expressions on ``\\n``-separated text;
docstring removal needs Python's tokenizer and runs Arrow-batched.
"""

from __future__ import annotations

import io
import tokenize

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

BEFORE = (tokenize.INDENT, tokenize.DEDENT, tokenize.NEWLINE)
#: White space as Python's ``str.strip`` has it, for regular expressions.
BLANKS = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def standalone_strings(lines: list[str]) -> set[int]:
    """Numbers, from 1, of the lines that statements of one plain string cover.

    A string counts if a line end or a change of indentation (or nothing) precedes it
    and a line end follows.  Text that the tokenizer refuses has none; that includes inconsistent
    indentation, which is a stated deviation.
    """
    try:
        tokens = list(tokenize.generate_tokens(io.StringIO("\n".join(lines)).readline))
    except (tokenize.TokenError, SyntaxError):
        return set()
    kinds = [None, *(t.type for t in tokens), None]
    covered: set[int] = set()
    for i, token in enumerate(tokens, 1):
        if kinds[i] == tokenize.STRING and kinds[i + 1] == tokenize.NEWLINE and (kinds[i - 1] is None or kinds[i - 1] in BEFORE):
            covered.update(range(token.start[0], token.end[0] + 1))
    return covered


def normalized(code: str) -> str:
    """Code without comment-only lines, then without standalone strings, then without blank lines."""
    lines = [x for x in code.splitlines() if not x.lstrip().startswith("#")]
    gone = standalone_strings(lines)
    return "\n".join(x for i, x in enumerate(lines, 1) if i not in gone and x.strip())


@F.pandas_udf(StringType())
def normalize_code(code: pd.Series) -> pd.Series:
    return code.map(normalized, na_action="ignore")


def fingerprint(code: Column) -> Column:
    """Hex MD5 of the UTF-8 text."""
    return F.md5(code)


def without_comment_lines(text: Column) -> Column:
    """F6, S2, natively."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.rlike(x, F.lit(f"^{BLANKS}*#"))), "\n")


def without_blank_lines(text: Column) -> Column:
    """F7, natively."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.rlike(x, F.lit(f"^{BLANKS}*$"))), "\n")
