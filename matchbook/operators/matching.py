"""The matchers as operators of their own: populations in, member rows out.

Each ``match_...`` returns one row per member: group_key (unique in the pass), row_id,
quality, leads (true for one member of each group).  ``number_groups`` turns group keys
into MATCHING_IDs.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchbook.functions.predicates import column
from matchbook.functions.scores import pass_score
from matchbook.operators import many_to_many, one_to_many, one_to_one, partial_bucket
from matchbook.operators.numbering import matching_id, number_rows
from matchbook.spec import Attribute, MatchPass, SpecError


def _side_value(expr: str, side: str, names: list[str]):
    """An attribute expression over the fields of the struct column ``side``."""
    if expr in names:
        return F.col(side).getField(expr)
    words = "|".join(sorted((re.escape(n) for n in names), key=len, reverse=True))
    return F.expr(re.sub(rf"\b({words})\b", rf"{side}.`\1`", expr))


def score_pairs(pairs: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """``pairs`` (struct columns ``l`` and ``r``, a ledger row each) with the quality of every
    pair under the attributes, 0 to 100."""
    names = {s: pairs.schema[s].dataType.names for s in ("l", "r")}
    rule = MatchPass("score", "ONE_TO_ONE", tuple(attributes))
    return pairs.withColumn("quality", pass_score(
        rule, [_side_value(a.left, "l", names["l"]) for a in rule.attributes],
        [_side_value(a.right, "r", names["r"]) for a in rule.attributes]))


def _members(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("_o2").alias("group_key"), "row_id", F.col("q").alias("quality"),
                       F.col("_lead").alias("leads"))


def _expect(p: MatchPass, kind: str) -> None:
    if p.match_type != kind:
        raise SpecError(f"pass {p.id!r} is {p.match_type}, not {kind}")


def match_one_to_one(left: DataFrame, right: DataFrame, p: MatchPass) -> DataFrame:
    _expect(p, "ONE_TO_ONE")
    return _members(one_to_one.members(one_to_one.groups(left, right, p)))


def _match_totals(left: DataFrame, right: DataFrame, p: MatchPass) -> DataFrame:
    if p.partial_bucket:
        return _members(partial_bucket.members(partial_bucket.groups(left, right, p)))
    return _members(one_to_many.members(one_to_many.groups(left, right, p), left, right, p))


def match_one_to_many(left: DataFrame, right: DataFrame, p: MatchPass) -> DataFrame:
    _expect(p, "ONE_TO_MANY")
    return _match_totals(left, right, p)


def match_many_to_one(left: DataFrame, right: DataFrame, p: MatchPass) -> DataFrame:
    _expect(p, "MANY_TO_ONE")
    return _match_totals(left, right, p)


def match_many_to_many(left: DataFrame, right: DataFrame, p: MatchPass) -> DataFrame:
    _expect(p, "MANY_TO_MANY")
    return _members(many_to_many.members(many_to_many.groups(left, right, p)))


def number_groups(members: DataFrame, set_id: str, cycle_date: date, offset: int = 0) -> DataFrame:
    """``members`` with MATCHING_ID: groups numbered from ``offset`` + 1 by falling quality,
    then by group key, without sending them through one task."""
    heads = members.where("leads").select((-F.col("quality")).alias("_o1"), "group_key")
    numbered, _ = number_rows(heads, ["_o1", "group_key"], offset, with_count=False)
    ids = numbered.select("group_key", matching_id(F.col("_seq"), set_id, cycle_date)
                          .alias("MATCHING_ID"))
    return members.join(ids, "group_key").select(*map(column, members.columns), "MATCHING_ID")
