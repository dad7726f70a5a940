"""Lexing of JavaScript and TypeScript text into DataFrame rows, in one JVM regex pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A slash starts a regular expression after an operator, a line end, an opening bracket or one of these words.
BEFORE_REGEX = r"(?<=\b(?:return|typeof|case|in|of|void|delete|throw|new|else|do|await|yield))"
LINE_COMMENT = r"//[^\n]*+"
BLOCK_COMMENT = r"/\*[\s\S]*?(?:\*/|\z)"
SINGLE = r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'?"
DOUBLE = r'"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"?'
TEMPLATE = r"`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`?"
REGEX = r"/(?![*/])[^/\\\[\n]*+(?:(?:\\[^\n]|\[[^\]\\\n]*+(?:\\[^\n][^\]\\\n]*+)*+\])[^/\\\[\n]*+)*+/[a-zA-Z]*+"

_OPERATORS = r"=,:;!&|?+\-*%~^<>\n"
#: Anything without brackets and comments; literals, and brackets with nothing but plain text between, are part of it.
_PLAIN = "|".join([
    rf"[^'\"`/(){{}}\[\] \t{_OPERATORS}]++", r"[ \t]++(?!/)", rf"[{_OPERATORS}](?:\s*+{REGEX})?+", rf"{BEFORE_REGEX}[ \t]*+{REGEX}", r"[ \t]++", SINGLE, DOUBLE, TEMPLATE,
    r"\([^'\"`/(){}\[\]]*+\)", r"\[[^'\"`/(){}\[\]]*+\]", r"/(?![/*])",
])
#: Coarse tokens: comments, brackets (with the regular expression that may follow), and runs of anything else.
COARSE = "|".join([LINE_COMMENT, BLOCK_COMMENT, rf"[(\[{{}}](?:[ \t]*+{REGEX})?+", r"[)\]]", rf"(?:{_PLAIN})++", r"[\s\S]"])


def explode_tokens(rows: DataFrame, text: str, pattern: str = COARSE) -> DataFrame:
    """Every token of ``text`` as a row with ``pos`` and ``tok``; other columns are kept. Null text gives no rows."""
    keep = [c for c in rows.columns if c != text]
    return rows.select(*keep, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("pos", "tok"))


def newlines(tok: Column) -> Column:
    """Line ends within a token."""
    return F.when(tok.contains("\n"), F.length(tok) - F.length(F.replace(tok, F.lit("\n")))).otherwise(0)
