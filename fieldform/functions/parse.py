"""Text to typed columns: places, times, ages, weights, categories."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldform.functions.contest import course_mask
from fieldform.functions.probability import col

# Fixed values -------------------------------------------------------------------------
# Result text -> (status, started); tried in order after a leading number.
STATUS_RULES = (
    (r"^(取|除)?$", "nonstarter", False),
    (r"中止", "dnf", True),
    (r"失格", "disqualified", True),
    (r"取消", "scratched", False),
    (r"除外", "excluded", False),
    (r"^中$", "dnf", True),
    (r"^失$", "disqualified", True),
)
SEXES = {"牡": "M", "牝": "F", "せん": "G", "セン": "G", "セ": "G"}
WEIGHT_MARKS = "▲△☆★◇"
# Keywords of contest classes in order of precedence.
CLASS_RULES = (
    (("新馬",), "Newcomer"),
    (("未勝利",), "Maiden"),
    (("1勝クラス", "500万"), "Class1"),
    (("2勝クラス", "1000万"), "Class2"),
    (("3勝クラス", "1600万"), "Class3"),
    (("オープン",), "Open"),
)
SURFACES = {"芝": "turf", "ダ": "dirt"}
TURNS = {"右": "right", "左": "left", "直": "straight"}
# Patterns of titles, without regard to case.
GRADE_PATTERN = r"(?i)(?:\(|（)(?:G[123]|JG[123])(?:\)|）)|GⅠ|GⅡ|GⅢ|J・GⅠ|J・GⅡ|J・GⅢ"
OBSTACLE_PATTERN = (
    r"(?i)障害|ジャンプ|Ｊ・Ｇ|J・G|JG[123ⅠⅡⅢ]|グランドジャンプ|大障害|ハイジャンプ|"
    r"スプリングJ|スプリングＪ"
)
# --------------------------------------------------------------------------------------


def parse_status(text: str | Column, rules: Sequence[tuple[str, str, bool]] = STATUS_RULES) -> Column:
    """Struct (position, status, is_starter).  A leading number wins over any other mark."""
    t = F.trim(F.coalesce(col(text), F.lit("")))
    number = F.try_to_number(F.nullif(F.regexp_extract(t, r"^(\d{1,9})", 1), F.lit("")), F.lit("999999999"))
    position = number.cast("int")
    status = F.when(position.isNotNull(), "finished")
    starter = F.when(position.isNotNull(), F.lit(True))
    for pattern, name, started in rules:
        status = status.when(t.rlike(pattern), name)
        starter = starter.when(t.rlike(pattern), F.lit(started))
    status = status.otherwise(F.concat(F.lit("other:"), t))
    return F.struct(
        position.alias("position"), status.alias("status"), starter.otherwise(F.lit(True)).alias("is_starter")
    )


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("double")


def parse_time(text: str | Column, whole: bool = True) -> Column:
    """``m:ss.s`` or ``ss.s`` to seconds; ``whole=False`` reads the leading time of a longer cell."""
    t = F.trim(col(text))
    pattern = r"^(?:(\d+):)?(\d+(?:\.\d+)?)" + ("$" if whole else "")
    return F.coalesce(_number(t, pattern, 1), F.lit(0.0)) * 60 + _number(t, pattern, 2)


def parse_first_rank(text: str | Column, direction: str | Column | None = None) -> Column:
    """First integer of a passage text; straight courses have no passage."""
    first = _number(col(text), r"(\d+)", 1).cast("int")
    return first if direction is None else F.when(~course_mask(direction), first)


def parse_sex_age(text: str | Column, sexes: Mapping[str, str] = SEXES) -> Column:
    """Struct (sex, age); sex is U where it cannot be read."""
    pattern = "(" + "|".join(sexes) + r")\s*(\d+)"
    mark = F.regexp_extract(col(text), pattern, 1)
    sex = F.when(mark == "", "U")
    for token, name in sexes.items():
        sex = sex.when(mark == token, name)
    return F.struct(F.coalesce(sex, F.lit("U")).alias("sex"), _number(col(text), pattern, 2).cast("int").alias("age"))


def parse_weight(text: str | Column, marks: str = WEIGHT_MARKS) -> Column:
    """Number after allowance marks, with or without a unit."""
    return _number(F.trim(col(text)), rf"^[{marks}]*([0-9]+(?:\.[0-9]+)?)(?:kg)?$", 1)


def normalize_category(
    text: str | Column, rules: Sequence[tuple[Sequence[str], str]], default: str | None = None
) -> Column:
    """First rule with a keyword in the text; unknown text gives the default."""
    t = F.coalesce(col(text), F.lit(""))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for words, name in rules:
        hit = F.lit(False)
        for word in words:
            hit = hit | t.contains(word)
        out = out.when(hit, name)
    return out.otherwise(F.lit(default).cast("string"))


def contest_class(raw: str, name: str, default: str | None = None) -> Column:
    """Class from the class text and the title; a graded title is open."""
    known = normalize_category(F.concat_ws(" ", raw, name), CLASS_RULES)
    graded = F.when(F.coalesce(F.col(name), F.lit("")).rlike(GRADE_PATTERN), "Open")
    return F.coalesce(known, graded, F.lit(default).cast("string"))


def map_values(value: str | Column, mapping: Mapping[str, str], keep: bool = False) -> Column:
    """Replace listed values; others become NULL, or stay when ``keep``."""
    v = col(value)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for old, new in mapping.items():
        out = out.when(v == old, new)
    return out.otherwise(v) if keep else out


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC without any white space; Spark has no built-in for it."""
    return text.map(lambda s: None if s is None else "".join(unicodedata.normalize("NFKC", s).split()))
