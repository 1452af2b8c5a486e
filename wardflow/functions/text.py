"""String rules on names, lines and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: patterns ---------------------------------------------------------------------
# (?d): only \n ends a line; (?s): a dot matches any character of one.
MAGIC_LINE = r"(?md)^[ \t]*[%!][^\n]*"
PIP_LINE = r"(?ds)^[ \t]*[!%]pip(?:[ \t]+(?:install|--quiet|-q))+[ \t]+(.+?)[ \t]*$"
DOWNLOAD_LINE = r"(?ds)^[ \t]*![ \t]*(wget|curl)\b[ \t]*(.+?)[ \t]*$"
PIP_FLAG = r"^--?[A-Za-z][\w-]*(=\S+)?$"
PINNED = r"==|~=|>|<|@|git\+|https?://"
CHECKSUM_HINT = r"sha256|sha512|md5sum|shasum|hashlib"
LABEL_PROXY = (
    r"(?i)^(?:difficulty(?:_level)?$|.+_label$|.+_target$|target_.+|label_.+|outcome$|result_class$"
    r"|class_id$|is_.+_fraud$|.+_leak$|leak_.+|cheat_.+)"
)
TEST_NAME_EXACT = r"(?i)^(?:X_?test|_?test_?[XY]|test_features|test_data)$"
TEST_NAME_PREFIX = r"^(?:X_?test|test_?[XY])"
RULE_NAMESPACE = "ml-hygiene."


def lines(text: Column) -> Column:
    """All lines of a text; only a newline ends one."""
    return F.split(text, "\n")


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    head = F.substring(text, F.lit(1), offset.cast("int"))
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def blank_magic(source: Column) -> Column:
    """Empty shell and magic lines but keep the line count."""
    return F.regexp_replace(source, MAGIC_LINE, "")


def package_specs(rest: Column) -> Column:
    """Package specs of an install command: flags dropped, the rest from a #-token on ignored."""
    tokens = F.filter(F.split(rest, r"\s+"), lambda t: t != "")
    comment = F.array_position(F.transform(tokens, lambda t: t.startswith("#")), True)
    kept = F.when(comment > 0, F.slice(tokens, F.lit(1), (comment - 1).cast("int"))).otherwise(tokens)
    return F.filter(kept, lambda t: ~t.rlike(PIP_FLAG))


def is_pinned(spec: Column) -> Column:
    return spec.rlike(PINNED)


def is_label_proxy(name: Column) -> Column:
    return name.rlike(LABEL_PROXY)


def is_test_name(name: Column) -> Column:
    return name.rlike(TEST_NAME_EXACT)


def has_test_prefix(text: Column) -> Column:
    return text.rlike(TEST_NAME_PREFIX)


def has_checksum_hint(text: Column) -> Column:
    return text.rlike(CHECKSUM_HINT)


def normalise_rule_id(raw: Column) -> Column:
    """Cut whatever path a scanner put before the rule namespace."""
    at = F.instr(raw, RULE_NAMESPACE)
    return F.when(at > 0, F.substring(raw, at, F.length(raw))).otherwise(raw)


def pascal_case(rule_id: Column) -> Column:
    """`a.b-c` to `ABC`-style words: first letter raised, the rest lowered."""
    parts = F.filter(F.split(rule_id, r"[-.]"), lambda p: p != "")
    words = F.transform(
        parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p))))
    )
    return F.array_join(words, "")


def relative_path(path: Column, root: str | None) -> Column:
    """Path below root with forward slashes; paths elsewhere stay as they are."""
    posix = F.replace(path, F.lit("\\"), F.lit("/"))
    if root is None:
        return posix
    prefix = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(posix.startswith(prefix), F.substring(posix, F.lit(len(prefix) + 1), F.length(posix))).otherwise(posix)


def redact(token: Column) -> Column:
    """Enough of a token to find it again, not enough to use it."""
    return F.concat(F.substring(token, 1, 8), F.lit("...("), F.length(token).cast("string"), F.lit(")"))
