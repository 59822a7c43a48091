"""Explicit schemas of the records and tables."""

from pyspark.sql import types as T

TEXT, FLAG = T.StringType(), T.BooleanType()


def fields(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


# One post as it arrives.  retweeted_status matters only by its presence.
POST = fields(
    id_str=TEXT,
    created_at=TEXT,
    favorited=FLAG,
    retweeted=FLAG,
    in_reply_to_screen_name=TEXT,
    retweeted_status=fields(id_str=TEXT),
    user=fields(
        id_str=TEXT, name=TEXT, screen_name=TEXT, description=TEXT, lang=TEXT, location=TEXT
    ),
    extended_tweet=fields(
        full_text=TEXT, entities=fields(hashtags=T.ArrayType(fields(text=TEXT)))
    ),
)

LABELED_TEXT = fields(tweet=TEXT, label=TEXT)

JUDGED_TEXT = fields(tweet=TEXT, label=TEXT, predicted=TEXT)

JSON_TEXT = fields(id=T.LongType(), full_text=TEXT)
