"""What a client keeps of a conversation: the question history and the relations of the last answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP = 15


def question_history(asked: DataFrame, user: str, question: str, at: str, keep: int = KEEP) -> DataFrame:
    """(user, position, question): a question that is there already is ignored, a new one goes first; the newest `keep`."""
    once = asked.where(F.col(question).isNotNull()).groupBy(user, question).agg(F.min(at).alias("first"))
    w = Window.partitionBy(user).orderBy(F.col("first").desc(), question)
    return once.withColumn("position", F.row_number().over(w)).where(F.col("position") <= keep).select(user, "position", question)


def last_turn(turns: DataFrame, conversation: str, order: list[str], role: str, wanted: str) -> DataFrame:
    """The last row of a role in each conversation, by the largest order columns."""
    own = turns.where(F.col(role) == wanted)
    rest = [c for c in turns.columns if c not in (conversation, *order)]
    return own.groupBy(conversation).agg(F.max(F.struct(*order, *rest)).alias("x")).select(conversation, "x.*")
